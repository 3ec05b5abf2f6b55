import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import vectors as V
from leafmill.plans.views import view
from leafmill.sources import vector_index as I

DATA = "/root/testdata/sf0.01"
ROWS = "id bigint, embedding array<float>, type string, manual_id string, part_numbers array<string>, page int"
ASKED = "query_id bigint, vector array<float>, manual_id string, codes array<string>"


def some(rnd, n, queries):
    kinds, manuals = ["text", "image", "table"], ["a", "b", "c", None]
    vector = lambda: rnd.choice(5, 4).tolist() if rnd.rand() < 0.9 else [None, [0.0] * 4, [1.0] * 3, [float("nan"), 1.0, 1.0, 1.0], [1.0, None, 1.0, 1.0]][rnd.randint(5)]
    codes = lambda: [None, [], ["P1"], ["P2", "P1"], ["P3"]][rnd.randint(5)]
    floats = lambda v: v and [None if x is None else float(x) for x in v]
    rows = [(i, floats(vector()), kinds[rnd.randint(3)], manuals[rnd.randint(4)], codes(), int(i)) for i in rnd.permutation(n).tolist()]
    asked = [(q, floats(rnd.choice(5, 4).tolist()), manuals[rnd.randint(4)], codes()) for q in range(queries)]
    return rows, [*asked, (queries, None, "a", ["P1"]), (queries + 1, [1.0, None, 1.0, 1.0], "b", ["P2"]), (queries + 2, [1.0], None, ["P1"])]


def plain(rows, asked, slots, exact):
    good = lambda v: v is not None and len(v) == 4 and not any(x is None or x != x for x in v)
    out = set()
    for q, v, manual, codes in asked:
        for s in slots:
            found = []
            for i, e, kind, owner, _, page in rows:
                own = owner is not None and owner == manual
                if good(v) and good(e) and (not s.types or kind in s.types) and (own if s.scope == "same" else not own if s.scope == "other" else True):
                    a, b = np.array(v), np.array(e)
                    n = np.sqrt((a @ a) * (b @ b))
                    found.append((-round(float(a @ b / n) if n else 0.0, 9), i, page))
            out |= {(q, s.name, k + 1, i, -x + 0.0, p) for k, (x, i, p) in enumerate(sorted(found)[: s.k])}
        named = sorted((i, p) for i, _, _, owner, listed, p in rows if owner is not None and owner == manual and set(listed or ()) & set(codes or ()))
        out |= {(q, V.EXACT, k + 1, i, 1.0, p) for k, (i, p) in enumerate(named[:exact])}
    return out


def found(hits):
    return {(r.query_id, r.slot, r["rank"], r.id, round(r.score, 9) + 0.0, r.page) for r in hits.collect()}


SLOTS = [V.Slot("mine", 3, ("text", "table")), V.Slot("pictures", 5, ("image",)), V.Slot("others", 4, (), "other"), V.Slot("all", 2, (), "any")]


def test_slots_against_all_pairs(spark, monkeypatch):
    rows, asked = some(np.random.RandomState(5), 400, 30)
    index, queries = spark.createDataFrame(rows, ROWS).repartition(3), spark.createDataFrame(asked, ASKED)
    wanted = plain(rows, asked, SLOTS, 4)
    assert found(V.slot_hits(index, queries, SLOTS, ("page",), exact=4)) == wanted and len(wanted) > 300
    monkeypatch.setattr(V, "BLOCK", 8)  # several blocks, thinned at every step
    monkeypatch.setattr(V, "HELD", 20)
    monkeypatch.setattr(V, "ROWS", 50)
    assert found(V.slot_hits(index, queries, SLOTS, ("page",), exact=4)) == wanted
    own = [s for s in SLOTS if s.scope == "same"]
    assert found(V.slot_hits(index, queries, own, ("page",))) == plain(rows, asked, own, 0)


def test_without_rows_or_queries(spark):
    rows, asked = some(np.random.RandomState(6), 20, 3)
    index, queries = spark.createDataFrame(rows, ROWS), spark.createDataFrame(asked, ASKED)
    assert V.slot_hits(index.limit(0), queries, SLOTS, ("page",), exact=2).count() == 0
    assert V.slot_hits(index, queries.limit(0), SLOTS, ("page",), exact=2).count() == 0


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = view(spark, DATA, "v_index").unionByName(spark.createDataFrame([(9000, None, "text", "M1"), (9001, [0.5], "text", None)], "id bigint, embedding array<float>, type string, manual_id string"), allowMissingColumns=True)
    return rows, I.build(rows, f"file://{tmp_path_factory.mktemp('index')}", cells=12, buckets=4)


def test_index_holds_every_row(spark, stored):
    rows, index = stored
    assert sorted(r.id for r in index.rows.select("id").collect()) == sorted(r.id for r in rows.select("id").collect())
    assert {r.id for r in index.rows.where("cell = -1").collect()} == {9000, 9001}


def test_index_is_exact_without_probes(spark, stored):
    rows, index = stored
    queries = view(spark, DATA, "v_query")
    for types, scope in ((("text", "table"), "same"), ((), "other"), ((), "any")):
        wanted = V.slot_hits(rows, queries, [V.Slot("", 6, types, scope)])
        key = lambda df: {(r.query_id, r.id, r["rank"], r.score) for r in df.collect()}
        assert key(index.search(queries, 6, types, scope)) == key(wanted)


def test_recall_and_pruning(spark, stored):
    _, index = stored
    queries = view(spark, DATA, "v_query")
    assert index.recall(queries, 3, probes=9) >= 0.9 and index.recall(queries, 3, probes=12) == 1.0
    assert 1 <= index.tuned(queries, 3, target=0.5) < index.tuned(queries, 3, target=1.0) <= 12
    some_ = index.search(queries.where("query_id = 50"), 3, probes=2)
    plan = some_._jdf.queryExecution().toString()
    filters = plan[plan.index("PartitionFilters"):].split("PushedFilters")[0]
    assert "cell" in filters and "bucket" in filters
    read = {f.rsplit("/", 2)[1] for f in index.rows.where("cell >= 0").inputFiles()}
    assert len(read) > 4


def test_composite_reads_the_index_twice(spark):
    from leafmill.plans.retrieval import composite_retrieval

    plan = composite_retrieval(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("embeddings.parquet") <= 1  # what the two passes over the index gave is held; the past fixes are a table of their own
