import hashlib
import random

import numpy as np
import pytest

from leafmill.llm import suffixes as S


def brute(rows):
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda r: (r[0], r[1] or "")):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - S.SPAN + 1):
            w = b[s : s + S.SPAN]
            if w in seen:
                gone[s : s + S.SPAN] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def corpus():
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdeé", k=rnd.randint(2, 9))) for _ in range(400)]
    base = [" ".join(rnd.choices(words, k=rnd.randint(5, 200))) for _ in range(40)]
    rows = list(enumerate(base))
    for i in range(120):
        x, y = rnd.choice(base), rnd.choice(base)
        a, c = rnd.randrange(len(x)), rnd.randrange(len(y))
        rows.append((100 + i, x[a : a + rnd.randint(30, 300)] + rnd.choice(["", "é", "zz"]) + y[c : c + rnd.randint(30, 200)]))
    return rows + [(900, None), (901, ""), (902, "a" * 3000), (903, "ab" * 500), (904, "a" * 99), (905, "a" * 100), (906, base[0]), (906, base[0])]


@pytest.mark.parametrize("slice_bytes", [1 << 20, 700])
def test_against_brute_force(spark, slice_bytes, monkeypatch):
    monkeypatch.setattr(S, "SLICE", slice_bytes)
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, pos int").repartition(3)
    out = S.remove_repeats(df).collect()
    wanted = brute(rows)
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) == wanted[r.doc_id], r.doc_id


@pytest.mark.parametrize(("n", "width", "symbols"), [(300, 21, 2), (4000, 21, 2), (3000, 40, 1), (2000, 9, 200), (1, 8, 2), (0, 8, 2)])
def test_sort_and_prefix_lengths(n, width, symbols):
    rnd = np.random.RandomState(1)
    rows = rnd.randint(0, symbols, (n, width)).astype(np.uint8)
    rows[n // 2 : n // 2 + n // 4] = rows[: n // 4]
    order, lcp = S.multikey_sort(rows)
    text = [rows[i].tobytes() for i in order]
    assert text == sorted(text) and sorted(order) == list(range(n))
    assert all(a < b for a, b, x, y in zip(order, order[1:], text, text[1:]) if x == y)  # stable
    for k in range(1, n):
        assert lcp[k] == next((i for i in range(width) if text[k][i] != text[k - 1][i]), width)


def test_classes_beyond_one_number(monkeypatch):
    """With so many suffixes that class and row don't fit in one number the result is the same."""
    rnd = np.random.RandomState(3)
    ctx = rnd.randint(97, 99, (400, S.WIDTH)).astype(np.uint8)
    ctx[200:] = ctx[:200]
    low, high = np.zeros(400, np.int64), np.full(400, S.PLACES - 1, np.int64)
    wanted = S.repeated(ctx, low, high)

    class Many(int):
        def bit_length(self):
            return 22

    monkeypatch.setattr(S, "int", Many, raising=False)
    got = S.repeated(ctx, low, high)
    assert (got[0] == wanted[0]).all() and (got[1] == wanted[1]).all() and wanted[0][200:].all() and not wanted[0][:200].any()


def test_repeated_rows_are_searched_once(spark, monkeypatch):
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choices("abcde", k=6)) for _ in range(80))
    rows = [(1, text)] * 60 + [(None, text[:300])] * 30 + [(2, "other " + text)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    counts = []
    plain = S.written
    monkeypatch.setattr(S, "written", lambda d, name, *a: (t := plain(d, name, *a), counts.append((name, t.count())))[0])
    out = S.remove_repeats(df).collect()
    assert len(out) == 91 and dict(counts)["suffixes"] < 3 * len(text)
    got = {(r.doc_id, r.n_removed) for r in out}
    assert got == {(None, 0), (1, 300), (2, len(text))}


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_one_document_and_kept_bytes(spark):
    df = spark.createDataFrame([(None, "xy" * 200)], "doc_id bigint, text string")
    r = S.remove_repeats(df, with_kept=True).first()
    assert bytes(r.kept) == b"xy" and r.n_removed == 398
