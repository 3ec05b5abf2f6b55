import pytest
from pyspark.sql import functions as F

from leafmill.functions import scalars as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (X.part_numbers, "what is 17c-612 and 6710415?", ["17C-612", "6710415"]),
        (X.part_numbers, "DSG-01-3C2", ["DSG-01-3C2"]),
        (X.part_numbers, "KCG-3-250-D-Z-M-U-HL1-10", ["KCG-3-250-D-Z-M-U-HL1-10"]),
        (X.part_numbers, "X-ray", []),
        (X.part_numbers, None, []),
        (X.clean, "83F--3", "83F-3"),
        (X.part_key, "1OC416", "10C416"),
        (X.part_key, "10C-416", "10C416"),
        (X.drawing_family, "CA3-15583-2", "CA3-15583"),
        (X.drawing_family, "A3-2590", "A3-2590"),
        (X.furniture_key, "225 Model 873", "# model #"),
        (X.item_code, "BO8-13", "B08-13"),
        (X.resolved_codes, "Parts shown in this diagram: 1 = Cutter bar assembly; 2 = Gearbox.", ["1", "2"]),
        (X.without_reasoning, "<think>x</think> ok", "ok"),
        (X.without_reasoning, "<think>x", None),
        (X.without_contd, "Frame (Cont'd)", "Frame"),
        (X.name_words, "Brake hoses, glass ASSY.", ["brake", "hose", "glass", "assembly"]),
        (X.shown_date, None, "Date not recorded"),
        (X.shown_date, "soon", "soon"),
        (X.lookalike_key, "A3-606Z", "A36062"),
        (X.table_key, "QO-1I", "0011"),
        (X.token_key, "Qty.", "qty"),
        (X.description_words, "0-RING, oil", ["ring", "oil"]),
        (X.whole_cells, "| 1 | a b |\n| --- | --- |", ["1", "a b"]),
        (X.without_manual_flag, X.NO_MANUAL + " why? ", "why?"),
        (lambda c: X.with_manual_flag(c, F.lit(0)), "why?", X.NO_MANUAL + " why?"),
        (lambda c: X.with_manual_flag(c, F.lit(3)), "why?", "why?"),
        (lambda c: X.tail(c, 3), "abcdef", "def"),
        (lambda c: X.tail(c, 9), "abc", "abc"),
        (lambda c: X.memory_text(c, F.lit(" "), F.lit("f"), F.lit(None).cast("string")), "s", "s\nf"),
        (X.json_list, '["a"]', ["a"]),
        (X.json_list, None, []),
        (X.json_list, "oops", []),
        (lambda c: X.json_or_null(F.array(c)), "a", '["a"]'),
        (lambda c: X.timestamp_text(c.cast("timestamp")), "2024-03-01 04:05:06.7", "2024-03-01 04:05:06"),
        (X.needs_translation, "油泵", True),
        (X.solves, "Problem solved, thanks", True),
        (X.solves, "Not: problem solved", False),
        (lambda c: X.chosen_answer(c, F.lit("b")), "a", "a — b"),
        (lambda c: X.absolute_url(c, "http://h/"), "data\\x.png", "http://h/static/x.png"),
        (lambda c: X.absolute_url(c, "http://h"), "https://a/b", "https://a/b"),
        (lambda c: X.chunk_title(c, F.lit("f")), "## **Oil** pump (Context: x)\nrest", "Oil pump"),
        (lambda c: X.chunk_title(c, F.lit("f")), None, "f"),
        (lambda c: X.session_title(c, F.lit("q")), '"A title"\nmore', "A title"),
        (lambda c: X.session_title(c, F.lit("q")), None, "q"),
        (lambda c: X.fallback_summary(c, F.lit(None).cast("string"), F.lit("b"), F.lit(" ")), "a", "Reported: a. Fixed by: b"),
    ],
)
def test_scalars(spark, f, given, wanted):
    assert one(spark, given, f) == wanted


def test_questions(spark):
    text = r"See. [ASK: Q? | Yes | yes | No] [ask: lonely | x]"
    found = one(spark, text, X.questions)
    assert [(q["question"], q["options"]) for q in found] == [("Q?", ["Yes", "No"])]
    assert one(spark, text, X.without_questions) == "See."


def test_dead_ends_of_sessions(spark):
    from leafmill.operators import layout as L
    from leafmill.operators import sessions as C

    shown = spark.range(1).select(C.as_attachments(F.array(F.lit("a"), F.lit("b")))).first()[0]
    assert [tuple(a) for a in shown] == [("IMAGE_0", "Figure 1", "a"), ("IMAGE_1", "Figure 2", "b")]
    pages = spark.createDataFrame([(1, 4), (1, None), (1, 2), (1, 4)], "query_id int, page int")
    assert C.cited_pages(pages).first().pages == [2, 4]
    fixes = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "answer_id int, pos int, x string")
    assert [r.x for r in C.first_incident(fixes).collect()] == ["a"]
    asked = spark.createDataFrame([("top", "q", True), ("top", "top ", True), (None, "q", True), ("top", "q", False)], "t string, q string, w boolean")
    assert [r[0] for r in asked.select(C.anchored_query(F.col("t"), F.col("q"), F.col("w"))).collect()] == ["top. q", "top ", "q", "q"]
    route = spark.createDataFrame([("parts_list",), ("text",), ("photo",)], "k string").select(L.page_route(F.col("k")).alias("r")).collect()
    assert [tuple(r.r) for r in route] == [(True, False, False), (False, True, True), (False, False, True)]
    files = spark.createDataFrame([("image/png", 5, "q"), ("image/png", 0, "q"), ("text/plain", 5, "q"), ("image/png", 5, " ")], "k string, n int, q string")
    assert [r[0] for r in files.select(L.valid_upload(F.col("k"), F.col("n"), F.col("q"))).collect()] == [True, False, False, False]
    pages = spark.createDataFrame([(1, 2, 9.0, 10.0), (2, 9, 9.0, 10.0), (3, 2, 1.0, 10.0)], "page int, n_words int, image_area double, page_area double")
    assert [r.page for r in L.scanned_pages(pages).collect()] == [1]


def test_models_offline(spark):
    from leafmill.functions import models as M

    class Fixed(M.Offline):
        def chat(self, prompts):
            return ['{"5": "PUMP", "9": "made up", "6": " "}' if ": " in p else "oil pump" if p.endswith("油泵") else "泵" for p in prompts]

    rows = spark.createDataFrame([("油泵", 1), ("油泵", 2), ("坏", 3), ("bolt", 4)], "description string, n int")
    assert [r.description for r in M.translated(rows, Fixed).orderBy("n").collect()] == ["油泵 (machine translation: oil pump)"] * 2 + ["坏", "bolt"]
    snippets = spark.createDataFrame([("m", "5", 0, "a (5)"), ("m", "6", 0, "b (6)")], "manual_id string, code string, nth int, snippet string")
    assert [tuple(r) for r in M.named_codes(snippets, Fixed).collect()] == [("m", "5", "PUMP")]
    got = spark.range(1).select(M.incident_summary(F.lit("h"), F.lit("s"), F.lit("c"), F.lit("a"), F.lit(None).cast("string")).alias("s"), M.chat_json(F.lit('{"x": 1'), "x int").alias("j"))
    assert got.first().s == "Reported: s. Cause: c. Fixed by: a"
    asked = spark.createDataFrame([(1, X.NO_MANUAL + " why", "ctx")], "query_id int, query string, context string")
    assert M.answers(asked).first().answer == "QUESTION: why"
    vectors = spark.createDataFrame([("a b",), (None,)], "t string").select(M.embed_column(F.col("t"))).collect()
    assert len(vectors[0][0]) == 64 and not any(vectors[1][0])
    assert spark.range(1).select(M.table_summary(F.lit("x" * 900), F.lit("c"))).first()[0] == "x" * 800
