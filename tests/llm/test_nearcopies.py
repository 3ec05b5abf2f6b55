import random

import corpus_pipeline as P
import numpy as np

from leafmill.llm import nearcopies as N


def grams(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rnd, words, n):
    words = list(words)
    for at in rnd.sample(range(len(words)), n):
        words[at] = f"x{rnd.getrandbits(40)}"
    return words


def classes(texts):
    sets = {i: grams(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in texts}


def corpus():
    """Copies at similarities from below 0.8 up to 1, a dense group, and a phrase that many share."""
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(3000)}"
    texts = []
    for length in (6, 20, 60, 90, 200, 700):
        for _ in range(8):
            base = [word() for _ in range(length)]
            texts += [" ".join(base), " ".join(base).upper()]
            texts += [" ".join(edited(rnd, base, n)) for n in {1, length // 80, length // 50, length // 40, length // 25} if n]
    dense = [word() for _ in range(250)]
    texts += [" ".join(edited(rnd, dense, 3)) for _ in range(70)]
    phrase = "one two three four five six seven eight nine"
    texts += [" ".join([phrase, *(word() for _ in range(rnd.randint(4, 40)))]) for _ in range(80)]
    texts += ["", None, " ", "a", "A b", "a  B"]
    return dict(enumerate(texts))


def test_classes_equal_brute_force(spark, monkeypatch):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id bigint, text string").repartition(3)
    wanted = classes(texts)
    assert {r.doc_id: r.component_id for r in N.near_copies(df).collect()} == wanted
    # the order is free: without the sample, with tiny buckets and with no close pairs at all, classes are the same
    monkeypatch.setattr(N, "frequent", lambda docs, n: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    monkeypatch.setattr(N, "BUCKET", 5000)
    monkeypatch.setattr(N, "CLOSE", 0)
    assert {r.doc_id: r.component_id for r in N.near_copies(df).collect()} == wanted


def test_edges(spark):
    rows = [(3, None), (2, ""), (None, " "), (7, "a"), (7, "a"), (5, "A"), (None, "alone here"), (9, "x " * 30_000), (8, "x " * 29_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, id int")
    got = N.near_copies(df).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 2), (2, 2), (3, 2), (5, 5), (7, 5), (7, 5), (8, 8), (9, 8)]
    assert N.near_copies(df.limit(0)).count() == 0


def test_ring_filter_is_the_full_distance():
    rnd = np.random.RandomState(4)
    base = rnd.randint(0, 1 << 32, (1, N.RING), np.int64).astype(np.uint32)
    bits = (rnd.rand(3000, N.RING * N.SEGMENT) < rnd.choice([0.05, 0.15, 0.2, 0.25, 0.3], 3000)[:, None]).astype(np.uint8)
    rows = base ^ np.packbits(bits, axis=1).view(np.uint32)
    for limit in (0, N.CLOSE, N.LIMIT):
        assert (N.ring_filter(base[0], rows, limit) == (bits.sum(1) <= limit)).all()
    assert (N.ring_filter(base[0], rows[:0], 5)).shape == (0,)


def test_similar_sets_have_near_fingerprints():
    rnd = np.random.RandomState(5)
    for n in (8, 30, 100, 900):
        for _ in range(60):
            h = rnd.randint(0, 1 << 63, n + n // 4, np.int64).astype(np.uint64)
            own = n // 9
            a, b = h[: n - own], np.concatenate([h[own : n - own], h[n : n + own]])
            if N.similar(np.unique(a), np.unique(b)):
                x, y = (np.frombuffer(N.fingerprint(s), np.uint32) for s in (a, b))
                assert N.ring_filter(x, y[None], N.LIMIT)[0]


def test_blobs_keep_hashes_and_sets():
    rnd = np.random.RandomState(6)
    h = np.sort(rnd.randint(0, 1 << 48, 1000, np.int64).astype(np.uint64) << np.uint64(16))
    doc, ids, df = rnd.randint(0, 9, 1000), rnd.randint(-1 << 62, 1 << 62, 20), rnd.randint(0, 256, 1000)
    got = N._unpacked(N._packed(h, doc, ids, df))
    assert (got[0] == h).all() and (got[1] == ids[doc]).all() and (got[2] == df).all()


def test_stage_drops_planted_copies(spark):
    rnd = random.Random(9)
    rows, copies = [], set()
    for k in range(40):
        base = [f"w{rnd.randrange(5000)}" for _ in range(120)]
        for n in (0, 1, 2):  # similarities of about 0.92 and 0.84 or more
            rows.append((10 * k + n, " ".join(edited(rnd, base, n))))
            if n:
                assert jaccard(grams(rows[-1][1]), grams(" ".join(base))) >= 0.8
                copies.add(10 * k + n)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in P.drop_near_copies(spark, df, "").collect()} == {i for i, _ in rows} - copies
