import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import models as M
from leafmill.operators import callouts as K
from leafmill.operators import parts as P
from leafmill.operators import readers as D
from leafmill.operators import registry as R
from leafmill.operators import search as S
from leafmill.operators import tables as G
from leafmill.operators import text as T
from leafmill.operators.matching import figure_matches


def test_code_evidence():
    assert K.snippets("7", "runs at 1700 rpm") == []
    assert K.snippets("7", "Item: 7 holds") == ["Item: 7 holds"]
    assert len(K.snippets("AB-1", "ab-1 " * 9)) == K.MAX_SNIPPETS


def test_evidence_join(spark):
    codes = spark.createDataFrame([("m", "7"), ("m", "AB-1"), ("n", "7"), ("m", "AB-9")], "manual_id string, code string")
    rows = [("m", 1, "item7 and 1700 rpm"), ("m", 2, "the AB-1 valve (7)"), ("m", 3, None), ("n", 4, "AB-1 at (7)"), ("m", 5, "ab ab ab")]
    chunks = spark.createDataFrame(rows, "manual_id string, chunk_id bigint, content string")
    got = {(r.manual_id, r.code, r.chunk_id) for r in K.evidence(codes, chunks).collect()}
    assert got == {("m", "7", 1), ("m", "7", 2), ("m", "AB-1", 2), ("n", "7", 4)}


def test_citations(spark):
    parts = [("5", "STATOR ASSY."), ("7", "PISTON"), ("8", None), ("5", "STATOR ASSY.")]
    texts = ["the caliper mount (5)", "the stator assembly (5) and piston (7)", "a bolt (9)", "The cap [8, 9] via the pistons (7)", "The piston (7) moves. The cup (5) leaks. It stops.", None, "The piston (7) moves. The cup (5) leaks."]
    df = spark.createDataFrame([(i, t, parts) for i, t in enumerate(texts)], "id int, caption string, refs array<struct<ref:string,description:string>>")
    got = {r.id: r for r in K.checked_captions(df).collect()}
    said = lambda i: [tuple(p) for p in got[i].problems]
    assert said(0) == [("misnamed", "5", "the caliper mount", "STATOR ASSY")]
    assert said(1) == [] and said(2) == [("unlisted", "9", None, None)] == said(3)
    assert got[4].kept == "The piston (7) moves. It stops." and got[5].kept == "" == got[6].kept


@pytest.mark.parametrize(("text", "wanted"), [('{"a":[1,2,{"b":"c', {"a": [1, 2]}), ('```json\n{"a": 1}\n```', {"a": 1}), ("nothing", None), ("", None), ('[1, "x,y", 3', [1, "x,y"]), ('{"a": {"b": [1, {"c": "d\\\\"}, 2', {"a": {"b": [1, {"c": "d\\"}]}}), ('{"a": "x]", "b": "y', {"a": "x]"}), ("```\n[1]", [1])])
def test_tolerant_json(text, wanted):
    assert M.tolerant_json(text) == wanted


@given(st.recursive(st.integers() | st.text(max_size=5), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=8), st.integers(0, 60))
@settings(max_examples=60, deadline=None)
def test_tolerant_json_never_fails(value, cut):
    import json

    M.tolerant_json(json.dumps(value)[:cut])


@given(st.text(alphabet="ab. \n", max_size=400), st.integers(20, 60))
@settings(max_examples=60, deadline=None)
def test_chunks_are_short_and_keep_all_words(text, size):
    chunks = T.split_text(text, size, 5)
    assert all(len(c) <= size for c in chunks)
    assert set(text.split()) <= set(" ".join(chunks).split()) or any(len(w) >= size for w in text.split()) or set("".join(text.split())) == set("".join("".join(chunks).split()))


REPAIRS = [([7, 2, 3], [1, 2, 3]), ([1, 2, 9, 4], [1, 2, 3, 4]), ([1, 1, 2], [None, 1, 2]), ([3, 5], [3, 5]), ([1, 3, 2, 3], [1, None, 2, 3]), ([5], [5]), ([2, 1], [None, 1])]


def test_refs_are_repaired(spark):
    rows = [(k, i, n, 0.5 if n == 5 else 0.9) for k, (l, _) in enumerate(REPAIRS) for i, n in enumerate(l)]
    got = D.with_repaired_refs(spark.createDataFrame(rows, "list_id bigint, seq int, no int, conf double")).collect()
    for k, (_, wanted) in enumerate(REPAIRS):
        mine = sorted((r for r in got if r.list_id == k), key=lambda r: r.seq)
        assert [r.fixed for r in mine] == wanted
        assert all(r.sure == (r.fixed is not None and (r.fixed != r.no or r.no != 5)) for r in mine)


def test_filled_refs(spark):
    rows = [("1", "1"), ("", "2"), ("", ""), ("", "2"), ("", "9"), ("4", "4"), ("", None), ("", "6"), ("", "5"), ("", "7")]
    got = D.filled_refs(spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "list_id int, seq int, ref string, second string")).orderBy("seq").collect()
    assert [r.filled for r in got] == ["1", "2", "", "", "", "4", "", "6", "", "7"]
    assert [r.fill for r in got] == [None, "second reader", "alternative", "alternative", "no ref", None, "no ref", "second reader", "no ref", "second reader"]


def test_scanned_list(spark):
    ocr = [(1, 0, "1", "10C-1", "BOLT", "2", 0.9), (1, 1, "", "20C-O", "NUT", "x", 0.9), (1, 2, "3", "30C-3", "", "[", 0.9), (1, 3, "", "77", "CAP", "1", 0.9)]
    vision = [(1, 0, "4", "99X", "RING", "1"), (1, 1, "1", "10C1", "Bolt", "2"), (1, 2, "2", "20C-0", "nut m6", "3"), (1, 3, "3", "30C-3", "PIN", "4"), (1, 4, "2", "55X", "odd", "many")]
    o = spark.createDataFrame(ocr, "list_id int, seq int, ref string, part_number string, description string, qty string, conf double")
    v = spark.createDataFrame(vision, "list_id int, seq int, ref string, part_number string, description string, qty string")
    got = D.scanned_list(o, v).orderBy("place").collect()
    assert [(r.ref, r.part_number, r.qty, r.status) for r in got] == [
        ("1", "10C1", "2", "confirmed"), ("2", "20C-0", "x", "part confirmed"), ("3", "30C-3", "4", "part confirmed"),
        ("", "77", "1", "unconfirmed"), ("4", "99X", "1", "unconfirmed"), ("", "55X", "", "unconfirmed"),
    ]
    assert got[2].description == "PIN" and got[4].notes == ["second reader only"]


def test_grouping(spark):
    rows = spark.createDataFrame([(1, 1, "2", "a"), (1, 2, "", "b"), (1, 3, "3", "c")], "list_id bigint, seq int, ref string, part_number string")
    assert [(r.ref, r.part_numbers) for r in P.group_lines(rows).orderBy("grp").collect()] == [("2", "a;b"), ("3", "c")]


def test_lookalikes(spark):
    tie = [(1, "A3-606Z")] * 2 + [(1, "A3-6062")] * 2
    clear = [(2, "A3-606Z")] + [(2, "A3-6062")] * 3
    rows = [(l, i, str(i), c) for i, (l, c) in enumerate(tie + clear)]
    got = P.lookalikes(spark.createDataFrame(rows, "list_id int, seq int, ref string, part_number string")).collect()
    assert {(r.list_id, r.spelling, *r.items) for r in got} == {(1, "A3-606Z", "2", "3"), (1, "A3-6062", "0", "1"), (2, "A3-606Z", "5", "6", "7")}


def test_window_and_runs(spark):
    rows = [(1, n, 56) for n in [10, *range(69, 125)]]
    w = P.best_window(spark.createDataFrame(rows, "table_id int, no int, n_rows int")).first()
    assert (w.lo, w.hi, w.n_stray, w.structure_ok) == (69, 124, 1, True)
    run = P.longest_run(spark.createDataFrame([(1, n) for n in range(4419, 4545)], "k int, no int"), "k").first()
    assert run.longest == 126 and run.discard


def test_columns_as_of(spark):
    words = spark.createDataFrame([(1, 36.5), (1, 1.0), (1, -9.0)], "page int, x0 double")
    columns = spark.createDataFrame([(1, "ref", 10.0), (1, "part", 40.0)], "page int, name string, start double")
    assert {r.x0: r.column for r in P.column_of(words, columns).collect()} == {36.5: "part", 1.0: "ref", -9.0: "ref"}


def test_split_groups(spark):
    df = spark.createDataFrame([(["x" * 1300] * 3,)], "rows array<string>")
    assert df.select(G.row_groups(F.col("rows"), 2500)).first()[0] == [0, 1, 2]
    assert df.select(G.row_groups(F.array().cast("array<string>"), 9)).first()[0] == []


def test_legend_title_alone_is_enough(spark):
    figures = spark.createDataFrame([(1, "m", 5, ["9"]), (2, "m", 5, [])], "figure_id int, manual_id string, page int, codes array<string>")
    rows = [(7, "m", 6, "Key to Fig. 2", ["1"]), (8, "m", 9, "legend", ["9"]), (9, "n", 5, "legend", ["9"])]
    grids = spark.createDataFrame(rows, "table_id int, manual_id string, page int, content string, cells array<string>")
    assert [tuple(r) for r in G.legend_pairs(figures, grids).collect()] == [(1, 7, 2)]


def test_legends_near_then_anywhere(spark):
    figures = spark.createDataFrame([(1, "m", 5, ["1", "2"]), (2, "m", 50, ["1", "2", "3", "4"]), (3, "n", 5, ["1", "2", "3", "4"])], "figure_id int, manual_id string, page int, codes array<string>")
    rows = [(7, "m", 6, "x", "| 1 | a |\n| --- |\n| 2 | 3 | 4 |"), (8, "m", 4, "y", "| 1 |"), (9, "m", 5, "legend", None)]
    tables = spark.createDataFrame(rows, "table_id int, manual_id string, page int, content string, render_markdown string")
    assert {tuple(r) for r in G.legends(figures, tables).collect()} == {(1, 7, True), (2, 7, False)}


def test_figures_meet_lists_of_their_manual(spark):
    f = "figure_id int, manual_id string, page int, page_text string, callouts array<string>, families array<string>, layout string"
    figures = spark.createDataFrame([(1, "m", 5, "x", ["1", "2"], ["CA3"], "single"), (2, "m", 5, "The BRAKE, (front)", [], [], "exploded_parts"), (3, "m", 5, "brake", [], [], "single"), (4, "n", 5, "x", ["1"], [], "single")], f)
    l = "list_id int, manual_id string, page int, title string, subtitle string, refs array<string>, families array<string>"
    lists = spark.createDataFrame([(10, "m", 90, "A", "", ["1", "2"], ["CA3"]), (11, "m", 90, "B", "", ["1", "2"], []), (12, "m", 7, "Other", "(Front)", ["8"], []), (13, "o", 5, "x", "", ["1"], [])], l)
    assert {(r.figure_id, r.list_id, r.score) for r in figure_matches(figures, lists).collect()} == {(1, 10, 1.8), (2, 12, 1.2)}


def test_shown_groups(spark):
    df = spark.sql("SELECT array(struct('' AS ref), struct('1' AS ref), struct('9' AS ref)) AS g, array('1', '2', '3') AS c UNION ALL SELECT array(struct('9' AS ref)), array('1')")
    assert sorted(len(r[0]) for r in df.select(P.shown_groups(F.col("g"), F.col("c"))).collect()) == [1, 2]


def test_search_ties_and_empty(spark):
    index = spark.createDataFrame([(i, [1.0, 0.0], "m", "text") for i in (5, 3, 9)], "id bigint, embedding array<float>, manual_id string, type string")
    queries = spark.createDataFrame([(1, [2.0, 0.0], "m")], "query_id bigint, vector array<float>, manual_id string")
    assert [r.id for r in S.search(index, queries, 2).orderBy("rank").collect()] == [3, 5]
    assert S.search(index.limit(0), queries, 2).count() == 0
    assert S.search(index, queries.limit(0), 2).count() == 0
    assert S.search(index, queries, 2, scope="other").count() == 0


def test_search_without_usable_vectors(spark):
    rows = [(1, None, "m"), (2, [0.0, 0.0], "m"), (3, [1.0, None], "m"), (4, [1.0], "m"), (5, [float("nan"), 1.0], "m"), (6, [-1.0, 0.0], "m"), (7, [1.0, 1.0], None)]
    index = spark.createDataFrame([(*r, "text") for r in rows], "id bigint, embedding array<float>, manual_id string, type string")
    queries = spark.createDataFrame([(1, [2.0, 0.0], "m"), (2, None, "m"), (3, [0.0, 0.0], "m"), (4, [1.0, 0.0], None)], "query_id bigint, vector array<float>, manual_id string")
    got = {(r.query_id, r.id): round(r.score, 6) for r in S.search(index, queries, 5).collect()}
    assert got == {(1, 2): 0.0, (1, 6): -1.0, (3, 2): 0.0, (3, 6): 0.0}
    assert {(r.query_id, r.id) for r in S.search(index, queries, 5, scope="other").collect()} == {(1, 7), (3, 7), (4, 2), (4, 6), (4, 7)}


def test_search_equals_brute_force(spark):
    import numpy as np

    rnd = np.random.RandomState(3)
    v, q = rnd.randint(-2, 3, (300, 4)).astype(float), rnd.randint(-2, 3, (20, 4)).astype(float)
    index = spark.createDataFrame([(i, [float(x) for x in r], f"m{i % 3}", "text") for i, r in enumerate(v)], "id bigint, embedding array<float>, manual_id string, type string").repartition(5)
    queries = spark.createDataFrame([(i, [float(x) for x in r], f"m{i % 4}") for i, r in enumerate(q)], "query_id bigint, vector array<float>, manual_id string")

    def cosine(a, b):
        n = np.sqrt((a * a).sum() * (b * b).sum())
        return round(float(a @ b / n), 9) if n else 0.0

    for scope, fits in (("same", lambda i, j: i % 3 == j % 4), ("other", lambda i, j: i % 3 != j % 4), ("any", lambda i, j: True)):
        wanted = {j: [i for _, i in sorted((-cosine(v[i], q[j]), i) for i in range(300) if fits(i, j))[:7]] for j in range(20)}
        got: dict = {j: [] for j in range(20)}
        for r in S.search(index, queries, 7, scope=scope).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.id)
        assert got == wanted


def test_changes(spark):
    t = {n: spark.createDataFrame([("a", 1), ("b", 2)], "manual_id string, x int") for n in ("chunks", "machines", "manuals")}
    assert R.rename_manual(t, "a", "c")["chunks"].where("manual_id = 'c'").count() == 1
    assert R.rename_manual(t, "a", "a") is t
    with pytest.raises(ValueError):
        R.rename_manual(t, "a", "b")
    with pytest.raises(LookupError):
        R.rename_manual(t, "z", "y")
    left, orphans = R.delete_manual(t, "a")
    assert left["chunks"].count() == 1 and orphans.count() == 1
    with pytest.raises(LookupError):
        R.delete_manual(t, "z")
    machines = spark.createDataFrame([("m", 1)], "machine_id string, x int")
    assert R.delete_machine(machines, "m").count() == 0
    with pytest.raises(LookupError):
        R.delete_machine(machines, "z")


def test_upserts_keep_one_row_a_key(spark):
    machines = spark.createDataFrame([("A", "old", "m")], "machine_id string, name string, manual_id string")
    rows = [(" A ", "first", "m1", 1), ("A", "second", " m2 ", 2), (" None ", "x", "m", 3), ("B", "x", "", 4), ("C", "c", "m", 5)]
    got = R.upsert_machines(machines, spark.createDataFrame(rows, "machine_id string, name string, manual_id string, seq int"), "seq")
    assert {tuple(r) for r in got.collect()} == {("A", "second", "m2"), ("C", "c", "m")}
    twice = spark.createDataFrame([("A", 1), ("A", 2)], "k string, v int")
    assert [tuple(r) for r in R.upsert(twice.limit(0), twice, "k").collect()] == [("A", 2)]
    sessions = spark.createDataFrame([(1, "m", "2024-01-02"), (2, "m", None), (3, "m", "2024-02-01")], "id int, machine_id string, updated_at string")
    assert [r.id for r in R.sessions_by_update(sessions).orderBy("place").collect()] == [3, 1, 2]


def test_boxes(spark):
    box = "array(struct(0D AS x0, 0D AS y0, 10D AS x1, 10D AS y1), struct(1D AS x0, 1D AS y0, 9D AS x1, 9D AS y1), struct(9D AS x0, 9D AS y0, 20D AS x1, 20D AS y1))"
    assert spark.range(1).select(F.size(K.kept_boxes(F.expr(box)))).first()[0] == 2
    circles = "array(struct(5D AS r, 0D AS x, 0D AS y), struct(4D AS r, 1D AS x, 0D AS y), struct(2D AS r, 9D AS x, 0D AS y))"
    assert spark.range(1).select(F.size(K.kept_circles(F.expr(circles)))).first()[0] == 2


def test_chunks_by_type(spark):
    rows = [(1, "m", 1, "text", "t", None), (2, "m", 1, "table", None, None), (3, "m", 1, "image", None, None), (4, "m", 1, "part", "p", None), (5, "m", 1, "image", "c", "part")]
    chunks = spark.createDataFrame(rows, "chunk_id int, manual_id string, page int, type string, content string, figure_role string")
    assert {(r.chunk_id, r.content, r.figure_role) for r in T.chunk_rows(chunks).collect()} == {(3, "", "full"), (4, "p", None), (5, "c", "part")}
    assert [r.chunk_id for r in T.raw_corpus(chunks).collect()] == [1]
    filled, empty = T.to_embed(chunks)
    assert filled.count() == 3 and empty.first().empty == 2


def test_resolved_figures(spark):
    rows = [(1, "m", "x", ["2", "1", "9"], False), (2, "m", "Parts shown in this diagram: 1 = a.", ["1"], False), (3, "m", "s", ["1"], True), (4, "n", "x", ["1"], None)]
    figures = spark.createDataFrame(rows, "figure_id int, manual_id string, content string, codes array<string>, scanned boolean")
    names = spark.createDataFrame([("m", "1", "cap"), ("m", "2", "nut")], "manual_id string, code string, name string")
    got = {r.figure_id: r.content for r in K.resolved(figures, names).collect()}
    assert got == {1: "x\n\nParts shown in this diagram: 2 = nut; 1 = cap.", 2: rows[1][2], 3: "s", 4: "x"}


def test_parts_lists_have_as_many_partitions_as_their_lines_need(spark, monkeypatch):
    from leafmill.plans import views

    plain = sorted(map(tuple, views.view(spark, "/root/testdata/sf0.001", "v_parts").collect()))
    monkeypatch.setattr(views, "LINES", 500)
    got = views.view(spark, "/root/testdata/sf0.001", "v_parts")
    assert got.rdd.getNumPartitions() > 4 and sorted(map(tuple, got.collect())) == plain


def test_pages_are_numbered_alike_in_blocks(spark, monkeypatch):
    from leafmill.plans import views

    plain = sorted(map(tuple, views.view(spark, "/root/testdata/sf0.001", "v_page").select("manual_id", "page", "doc_id").collect()))
    monkeypatch.setattr(views, "PAGES", 20)
    got = views.view(spark, "/root/testdata/sf0.001", "v_page")
    assert sorted(map(tuple, got.select("manual_id", "page", "doc_id").collect())) == plain


def test_chunks_are_alike_however_few_are_given_out_at_once(spark, monkeypatch):
    from leafmill.operators import text as T

    df = spark.createDataFrame([("m", k, k, "word " * 400 * k) for k in range(6)], "manual_id string, page int, doc_id bigint, content string").coalesce(1)
    monkeypatch.setattr(T, "SLICE", 1000)
    got = sorted((r.doc_id, r.chunk_no, r.content) for r in T.chunked(df).collect())
    assert got == [(k, n, c) for k in range(6) for n, c in enumerate(T.split_text("word " * 400 * k))]
