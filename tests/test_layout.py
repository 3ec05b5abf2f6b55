import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import captions as C
from leafmill.operators import layout as L
from leafmill.operators import parts as P
from leafmill.operators import sessions as S


def test_words_of_a_box(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 5.0, "ab cd", 0.9)], "page int, x0 double, y0 double, x1 double, y1 double, text string, conf double")
    assert sorted((r.text, r.x0, r.x1) for r in L.split_words(boxes).collect()) == [("ab", 0.0, 40.0), ("cd", 60.0, 100.0)]


def test_drawing_numbers(spark):
    df = spark.createDataFrame([(["a3-606", "4-M12x180L", "PT1/4", "PAGE-09", "B", "A3-606", "12345"],)], "x array<string>")
    assert df.select(L.drawing_numbers(F.col("x"))).first()[0] == ["A3-606"]


@pytest.mark.parametrize(("column", "given", "wanted"), [("part", "A - 3", "A-3"), ("description", "0-RING", "O-RING"), ("remarks", "WIO nut", "W/O nut"), ("ref", " 12.", "12")])
def test_cell_repair(spark, column, given, wanted):
    assert spark.createDataFrame([(given,)], "x string").select(L.repaired_cell(F.col("x"), column)).first()[0] == wanted


def test_vision_rows(spark):
    text = '{"rows":[{"ref":"x1","part_number":"A","description":"","qty":"2"},{"ref":"3","part_number":" ","description":null}]}'
    got = spark.createDataFrame([(text,), ("no json",)], "x string").select(L.vision_rows(F.col("x")).alias("r")).collect()
    assert [(r.ref, r.part_number) for r in got[0].r] == [("", "A")] and not got[1].r


def test_page_choices(spark):
    word = "page int, x0 double, text string"
    layer, ocr = spark.createDataFrame([(1, 0.0, str(i)) for i in range(5)] + [(2, 0.0, "a")], word), spark.createDataFrame([(1, 1.0, "o"), (2, 1.0, "o")], word)
    assert sorted((r.page, r.text) for r in L.page_words(layer, ocr).collect()) == [(1, str(i)) for i in range(5)] + [(2, "o")]
    turns = spark.createDataFrame([(1, 0, 32), (1, 90, 30), (2, 0, 90), (2, 90, 1)], "page int, rotation int, words int")
    assert {r.page: (r.rotation, r.tie) for r in L.upright(turns).collect()} == {1: (0, True), 2: (0, False)}
    angles = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, 45.0), (2, 5.0)], "page int, angle double")
    assert {r.page: r.skew for r in L.skew(angles).collect()} == {1: 2.0, 2: 0.0}


def test_verdicts(spark):
    df = spark.createDataFrame([(True, "logo", "odd"), (None, None, None), (False, "photo", "single")], "a boolean, k string, l string")
    assert [r[0]["keep"] for r in df.select(L.figure_verdict(F.col("a"), F.col("k"), F.col("l"))).collect()] == [False, True, False]


def test_legends_are_used_once(spark):
    pairs = spark.createDataFrame([(1, 0, 10, 7, 5), (1, 0, 10, 8, 3), (1, 1, 11, 7, 9), (1, 1, 11, 8, 4), (1, 2, 12, 7, 9)], "query_id int, figure_pos int, figure_id bigint, table_id bigint, score int")
    assert {(r.figure_id, r.table_id) for r in C.attached_legends(pairs).collect()} == {(10, 7), (11, 8)}


def test_captions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(C.guessed_caption(F.lit("x\n Key to Figure 1.1 \ny"))) == "Key to Figure 1.1"
    assert one(C.looks_like_legend(F.array(*map(F.lit, ("1", "2", "3", "x"))))) and not one(C.looks_like_legend(F.array(*map(F.lit, ("1", "200", "0")))))
    group = F.struct(F.lit("1").alias("ref"), F.array(F.lit("Bar; long"), F.lit("Bar; long")).alias("names"), F.array(F.lit("A1")).alias("numbers"))
    assert one(C.parts_line(F.array(group))) == "Parts shown in this diagram: 1 = Bar, long (A1)."
    empty = F.array().cast("array<string>")
    assert one(C.callout_codes(empty, F.array(F.lit("2")), F.array(F.lit("L"), F.lit("2")))) == ["2", "L"]
    assert one(C.caption_head(F.lit("Pump"), F.lit("exploded_view"), F.lit(3), F.lit(None).cast("string"), F.lit("Oil"))) == "### Pump (Exploded View) — page 3 (section: Oil)"
    groups = F.array(group, F.struct(F.lit("").alias("ref"), F.array(F.lit("x")).alias("names"), F.array(F.lit("B")).alias("numbers")), F.struct(F.lit("2").alias("ref"), empty.alias("names"), empty.alias("numbers")))
    line = "Parts shown in this diagram: 1 = Bar, long (A1); 2 = part (). (Parts list read by vision from a scanned page - unverified.)\nCallouts with no entry in the parts list: 7, 9."
    assert one(C.parts_line(groups, F.lit(False), F.array(F.lit("7"), F.lit("9")))) == line
    assert one(C.fallback_caption(F.array(group), F.lit("PUMP"))) == "Exploded parts view of PUMP. The drawing shows: Bar; long (1)."
    assert one(C.listing(groups, 1)) == "  1: Bar; long"
    codes = F.array(F.lit("7"))
    assert one(C.figure_caption(F.lit("H"), F.lit("b"), groups, F.lit(True), empty, codes, empty)) == "H\n\nb\nParts shown in this diagram: 1 = Bar, long (A1); 2 = part ()."
    assert one(C.figure_caption(F.lit("H"), F.lit("b"), F.lit(None).cast("array<struct<ref:string,names:array<string>,numbers:array<string>>>"), F.lit(True), empty, codes, F.array(F.lit("oil")))) == "H\n\nb\nCallout codes shown: 7\nLeader-line labels: oil"
    assert one(C.enriched_table(F.lit("rows"), F.lit(""), F.lit(None).cast("string"), F.lit("sum"), F.lit(False))) == "### Table — Technical Data\n\nsum\n\nrows"
    assert one(C.enriched_table(F.lit("rows"), F.lit("T"), F.lit("s"), F.lit("sum"), F.lit(True))) == "### Table — T\n\nrows"


def test_views_become_parts(spark):
    figures = spark.createDataFrame([("m", 3, "f", ["a", "b"]), ("m", 4, "g", [])], "manual_id string, page int, path string, views array<string>")
    got = [(r.path, r.figure_role, r.parent_path) for r in C.view_chunks(figures).orderBy("page", "nth").collect()]
    assert got == [("f", "full", None), ("a", "part", "f"), ("b", "part", "f"), ("g", "full", None)]


def test_first_column_lines(spark):
    words = spark.createDataFrame([("m", 1, 5.0, 0.0, 6.0, 2.0, "b"), ("m", 1, 0.0, 2.5, 1.0, 4.5, "a"), ("m", 1, 0.0, 5.0, 1.0, 7.0, "c"), ("n", 1, 0.0, 9.0, 1.0, 11.0, "d")], "manual_id string, page int, x0 double, y0 double, x1 double, y1 double, text string")
    assert {r.text: r.line_no for r in P.text_lines(words).collect()} == {"b": 0, "a": 0, "c": 1, "d": 0}


def test_fix_records(spark):
    df = spark.createDataFrame([("s", None, " ", " did it "), ("s", "c", "", "")], "symptom string, root_cause string, actions string, operator_fix string")
    assert [(r.actions, r.errors) for r in S.fix_record(df).collect()] == [("did it", ["root_cause"]), (None, ["actions"])]


def test_views_of_a_figure(spark):
    def rows(figure, axis, *bands):
        return [(figure, axis, r, 1, 400) for a, b in bands for r in range(a, b)]

    ink = rows(1, 0, (0, 100), (130, 150), (200, 300)) + rows(1, 1, (0, 400))  # the short band is a caption of the first view
    ink += rows(2, 0, (0, 20), (60, 200), (204, 300)) + rows(2, 1, (0, 100), (200, 300))  # a caption above, one view: side by side
    ink += rows(3, 0, (0, 400)) + rows(3, 1, (0, 400)) + rows(4, 0, *((k * 56, k * 56 + 50) for k in range(7)))
    got = {}
    for r in L.figure_views(spark.createDataFrame(ink, "figure_id int, axis int, row int, ink int, size int")).collect():
        got.setdefault((r.figure_id, r.axis), []).append((r.view, r["first"], r["last"]))
    assert {k: sorted(v) for k, v in got.items()} == {(1, 0): [(1, 0, 149), (2, 200, 299)], (2, 1): [(1, 0, 99), (2, 200, 299)]}


def test_drawing_rules(spark):
    ink = [(1, x, y, 100, 100) for x in range(30, 60) for y in range(40, 70)] + [(2, 1, 1, 100, 100)]
    got = L.ink_extent(spark.createDataFrame(ink, "figure_id int, x int, y int, width int, height int")).collect()
    assert [tuple(r) for r in got] == [(1, 10, 20, 79, 89)]
    one = lambda c: spark.range(1).select(c).first()[0]
    strings = lambda *v: F.array(*map(F.lit, v))
    assert one(L.all_callouts(strings("1"), strings("A1-2", "1"), F.lit("drawing"))) == ["1", "A1-2"]
    assert one(L.all_callouts(strings("1", "2", "3"), strings("A1-2"), F.lit("drawing"))) == ["1", "2", "3"]
    assert one(L.all_callouts(strings("1"), strings("A1-2"), F.lit("text"))) == ["1"]
    tables = spark.createDataFrame([(1, 10, 30, 100, 10), (2, 40, 10, 100, 10)], "page int, width int, height int, page_width int, page_height int")
    assert [r.page for r in L.small_tables(tables).collect()] == [1]
    box = lambda *v: F.struct(*(F.lit(x).alias(n) for n, x in zip(("x0", "y0", "x1", "y1"), v)))
    frames = F.array(box(0, 0, 1000, 1000), box(95, 95, 215, 215), box(98, 98, 204, 204))
    assert tuple(one(L.framed(box(100, 100, 200, 200), frames, F.lit(1000), F.lit(1000)))) == (94, 94, 208, 208)
    assert tuple(one(L.framed(box(5, 100, 200, 200), F.filter(frames, lambda f: F.lit(False)), F.lit(1000), F.lit(400)))) == (0, 94, 215, 206)


def test_corner_code_of_words_at_one_place_is_the_first_one_read(spark):
    # texts that fall in the order of reading, so that neither the text nor the place decides
    words = [(k, 1, 5.0, 5.0, 9.0, 9.0, f"B-{9999 - k}") for k in range(40)]
    figures = spark.createDataFrame([(7, 1, 0.0, 0.0, 30.0, 30.0)], "figure_id int, page int, x0 double, y0 double, x1 double, y1 double")
    for rows in (words, words[::-1], words[20:] + words[:20]):
        df = spark.createDataFrame(rows, "no int, page int, x0 double, y0 double, x1 double, y1 double, text string").coalesce(1)
        assert [r.code for r in L.corner_code(df, figures, "no").collect()] == ["B-9999"]
        assert [r.code for r in L.corner_code(df, figures).collect()] == ["B-9960"]


def test_corner_code_asks_once_for_figures_with_the_same_box(spark, monkeypatch):
    met, pairs = L.boxes_meet, []
    monkeypatch.setattr(L, "boxes_meet", lambda *a: pairs.append(met(*a)) or pairs[-1])
    words = spark.range(500).select(F.lit(1).alias("page"), (F.col("id") % 20).cast("double").alias("x0"), (F.col("id") % 25).cast("double").alias("y0"), F.format_string("B-%d", F.col("id") + 1000).alias("text"))
    words = words.withColumns({"x1": F.col("x0") + 5, "y1": F.col("y0") + 5})
    figures = spark.range(300).select(F.col("id").alias("figure_id"), F.lit(1).alias("page"), *(F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 30.0), ("y1", 30.0))))
    assert {r.figure_id: r.code for r in L.corner_code(words, figures).collect()} == dict.fromkeys(range(300), "B-1000")
    assert pairs[0].count() == 500


@pytest.mark.parametrize("order", [None, "no", "text"])
def test_corner_code_against_all_pairs(spark, order):
    rnd = random.Random(4)
    place = lambda most: float(rnd.randrange(0, most, 10))
    word, figure = "no int, page int, x0 double, y0 double, x1 double, y1 double, text string", "figure_id int, page int, x0 double, y0 double, x1 double, y1 double"
    words = [(no, rnd.randint(1, 3), x := place(100), y := place(100), x + 5, y + 5, rnd.choice(["CA--{}", "B-{}", "word {}"]).format(rnd.randint(1000, 1009))) for no in range(400)]
    words += [(None, 1, 0.0, 0.0, 5.0, 5.0, "B-2000"), (500, None, 0.0, 0.0, 5.0, 5.0, "B-2001"), (501, 1, float("nan"), 0.0, 5.0, 5.0, "B-2002")]
    # few places, so that boxes come again; a figure may have several boxes, also on several pages
    figures = [(None if i % 13 == 0 else i % 40, rnd.randint(1, 4), x := rnd.choice([0.0, -0.0, 20.0, 90.0]), y := place(90), x + rnd.choice([0.0, 15.0, 40.0]), y + 20) for i in range(120)]
    figures += [(60, 1, None, 0.0, 9.0, 9.0), (61, None, 0.0, 0.0, 9.0, 9.0), (62, 1, 0.0, 0.0, float("nan"), 9.0), (63, 1, 30.0, 0.0, 10.0, 30.0)]
    good = lambda r: None not in r and r[2] == r[2] and r[4] == r[4]
    wanted = {}
    for no, page, x0, y0, x1, y1, text in (w for w in words if good(w[1:2] + w[1:]) and not w[6].startswith("word")):
        key = (y0, x0, *((-1 if no is None else no,) if order == "no" else ()), text)
        for k, *b in (f for f in figures if good((0, *f[1:]))):
            if b[0] == page and x0 < b[3] and x1 > b[1] and y0 < b[4] and y1 > b[2]:
                wanted[k] = min(wanted.get(k, key), key)
    got = L.corner_code(spark.createDataFrame(words, word), spark.createDataFrame(figures, figure), order).collect()
    assert len(got) == len(wanted) > 30 and None in wanted
    assert {r.figure_id: r.code for r in got} == {k: v[-1].replace("--", "-") for k, v in wanted.items()}
