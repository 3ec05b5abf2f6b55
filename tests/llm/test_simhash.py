import itertools
import random
import re

import pytest
import xxhash

from leafmill.llm import simhash as S


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def classes(fps, bits=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {f: find(f) for f in root}


def test_fingerprint():
    for t in (None, "", " \t", "One", "a b c", "a b c d", "Éa B\x0bc d e f g h", "x " * 900):
        assert S.fingerprint(t) == plain(t), t


def test_keys_of_both_lengths_meet_all_pairs():
    """By the ring: of every way to spread up to four bits over the segments, some key leaves out all that differ."""
    for long, chain in ((False, S.CHAIN), (True, S.LONG_CHAIN)):
        outs = [set(p) for p in S.left_out(long)]
        for spots in itertools.combinations_with_replacement(range(S.SEGMENTS), 4):
            differ = set(spots)
            ok = any({(s - start) % S.SEGMENTS for s in differ if (s - start) % S.SEGMENTS < chain} <= out for start in range(S.SEGMENTS) for out in outs)
            assert ok, (long, spots)


@pytest.mark.parametrize("many", [S.MANY, 1])
def test_classes_of_planted_fingerprints(spark, monkeypatch, many):
    monkeypatch.setattr(S, "MANY", many)
    rnd = random.Random(2)
    fps = []
    for _ in range(60):
        base = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 40)):
            f = base
            for b in rnd.sample(range(64), rnd.randint(0, 6)):
                f ^= 1 << b
            fps.append(f)
    fps += [0, 1 << 63, (1 << 64) - 1]
    wanted = classes(set(fps))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in set(fps)], "fp bigint")
    label = {r.node: r.root for r in S.components(S.link_edges(df)).collect()}
    group = lambda f: label.get(signed(f), signed(f))
    mine, theirs = {}, {}
    for f in set(fps):
        mine.setdefault(group(f), set()).add(f)
        theirs.setdefault(wanted[f], set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_documents(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, text), (3, text.upper()), (9, None), (8, ""), (8, ""), (7, "alone here it stands by itself"), (1, text + " tail")]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id bigint, text string, fp int, component_id string")
    out = S.near_duplicates(df.select("doc_id", "text", "fp", "component_id"))
    got = {r.doc_id: r.component_id for r in out.collect()}
    assert out.count() == 7 and got[9] == got[8] == 8 and got[7] == 7 and got[5] == got[3]
    wanted = classes({plain(t) for _, t in rows})
    assert (got[1] == got[3]) == (wanted[plain(rows[-1][1])] == wanted[plain(text)])
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)], "a bigint, b bigint")
    assert {r.root for r in S.components(edges).collect()} == {0}


def test_null_ids_and_hot_fingerprints(spark):
    rows = [(None, "")] * 300 + [(7, " ")] + [(None, "alone for itself")] + [(i, f"w{i} a b c d e f") for i in range(20, 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    out = S.near_duplicates(df).collect()
    assert len(out) == len(rows)
    assert {r.component_id for r in out if r.fp == 0} == {7}
    wanted = classes({plain(t) for _, t in rows})
    root = {i: wanted[plain(t)] for i, t in rows if i is not None}
    got = {r.doc_id: r.component_id for r in out if r.doc_id is not None}
    assert all((root[a] == root[b]) == (got[a] == got[b]) for a in got for b in got)
    alone = [r.component_id for r in out if r.doc_id is None and r.fp != 0]
    assert len(alone) == 1 and (alone[0] is None or wanted[plain("alone for itself")] in root.values())
    with pytest.raises(ValueError):
        S.near_duplicates(df, words=4, similarity=0.8)
