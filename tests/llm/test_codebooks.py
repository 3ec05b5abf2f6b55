import duckdb
import numpy as np
import pytest

from leafmill.llm import codebooks
from leafmill.llm.queries import queries

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, code int, error double, n int"
DATA = "/root/testdata/sf0.01"


def plain(rows, parts=8, entries=16, rounds=6):
    """Loops over Python numbers."""
    kept = sorted(((i, [int(np.floor(np.float64(x) * 4096)) for x in v], label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: r[0])
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for c in cut:
                own[near(c[p], books[p])[0]].append(c[p])
            books[p] = [[sum(x) // len(m) for x in zip(*m)] if m else old for m, old in zip(own, books[p])]
    out = {}
    for (i, _, label), c in zip(kept, cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found), label)
    total = {}
    for _, e, label in out.values():
        total[label] = total.get(label, 0) + e
    return {i: (c, e, total[label]) for i, (c, e, label) in out.items()}, books


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 0.5, 3) for i, v, label in rows], SCHEMA).repartition(3)


def test_against_loops(spark):
    rnd = np.random.RandomState(3)
    rows = [(int(i), rnd.standard_normal(16).astype(np.float32).tolist(), None if i % 3 == 0 else int(i % 4)) for i in rnd.permutation(300)]
    rows += [(1000, None, 1), (1001, [1.0, None] + [0.0] * 14, 1), (1002, [float("nan")] * 16, 1), (-5, [float("inf")] + [0.0] * 15, None), (1003, [], 2)]
    wanted, books = plain(rows)
    found, made = codebooks.compress(frame(spark, rows))
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in found.collect()} == wanted and made.tolist() == books


def test_ties_few_rows_and_hot_labels(spark):
    rows = [(i, [float(i % 2)] * 8, None) for i in range(9)]
    wanted, books = plain(rows)
    found, made = codebooks.compress(frame(spark, rows))
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in found.collect()} == wanted and made.tolist() == books
    assert {c for c, _, _ in wanted.values()} == {"00" * 8, "01" * 8}  # of equal entries the first


def test_repeated_and_null_ids(spark):
    rows = [(None, [0.5] * 8, 1), (3, [0.1] * 8, 1), (3, [0.2] * 8, None), (3, [0.1] * 8, 1)]
    found, made = codebooks.compress(frame(spark, rows), entries=3)
    assert found.count() == 4 and found.where("vec_id IS NULL").count() == 1 and made.shape == (8, 3, 1)


def test_empty_and_wrong(spark):
    assert codebooks.compress(frame(spark, [(1, [1.0] * 8, 1)]).limit(0))[0].count() == 0
    assert codebooks.compress(frame(spark, [(1, None, 1)]))[0].collect() == []
    for bad in ([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], [(1, [1.0] * 9, 1)]):
        with pytest.raises(ValueError):
            codebooks.compress(frame(spark, bad))
    with pytest.raises(Exception, match="too large"):
        codebooks.compress(frame(spark, [(1, [1e30] * 8, 1)]))


def test_large_numbers_are_exact(spark):
    rows = [(i, [(-1) ** i * 30000.0 + i, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, float(i)], i % 2) for i in range(40)]
    wanted, books = plain(rows)
    found, made = codebooks.compress(frame(spark, rows))
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in found.collect()} == wanted and made.tolist() == books


def test_query_equals_sql(spark):
    name = next(n for n in queries() if n.startswith("op12_"))
    found = queries()[name](spark, DATA)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    wanted = con.execute(f"SELECT {', '.join(found.columns)} FROM ({codebooks.oracle_sql()})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(wanted) and len(wanted) == 500
