from pyspark.sql import functions as F

from leafmill.sources.store import Table, conditions, payload, text_pages, uploads
from leafmill.streaming import ingest as I


def test_ingest_keeps_an_upload_and_replaces_older_ones(spark, tmp_path):
    source, target, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))
    ddl = "manual_id string, upload_id bigint, page int, doc_id bigint, content string, ended boolean"
    add = lambda rows: spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(source)

    def run():
        I.ingest(I.arriving(spark, source, ddl, files_per_batch=1), target, mark).awaitTermination()
        return {(r.manual_id, r.page, r.content) for r in I.stored(spark, target).collect()}

    add([("a", 1, 1, 1, "old text", None), ("b", 1, 1, 2, "kept", True)])
    assert run() == {("b", 1, "kept")}  # the upload of a has not ended
    add([("a", 1, 2, 3, "old too", None), ("a", 1, None, None, None, True)])  # another file of the same upload
    old = {("a", 1, "old text"), ("a", 2, "old too"), ("b", 1, "kept")}
    assert run() == old
    add([("a", 2, 1, 4, "new text", False)])
    assert run() == old  # half of the new upload
    add([("a", 2, 2, 5, "new too", True)])
    wanted = {("a", 1, "new text"), ("a", 2, "new too"), ("b", 1, "kept")}
    assert run() == wanted and run() == wanted
    add([("a", 3, 1, 6, "   ", None), ("a", 3, None, None, None, True)])  # a replacing upload without text
    assert run() == {("b", 1, "kept")}


def test_job_fields(spark):
    rows = [("j", 1, "started", None), ("j", 3, None, 7), ("j", 2, "done", 5), ("k", 1, None, None)]
    jobs = I.job_state(spark.createDataFrame(rows, "manual_id string, seq bigint, status string, chunks int"), ("status", "chunks"))
    assert {tuple(r) for r in jobs.collect()} == {("j", "done", 7, 3), ("k", None, None, 1)}
    asked = spark.createDataFrame([("j",), ("k",), ("z",)], "manual_id string")
    assert {(r.manual_id, r.status) for r in I.status_of(asked, jobs).collect()} == {("j", "done"), ("k", "unknown"), ("z", "unknown")}


def test_payload_and_uploads(spark, tmp_path):
    old = spark.createDataFrame([("1", "m", 3)], "id string, manual_id string, page int")
    row = payload(old).first()
    assert (row.manual_id, row.page, row.part_numbers, row.render_markdown) == ("m", 3, [], None)
    for name, body in (("man/a.PDF", b"x"), ("man/b.pdf", b""), ("man/c.txt", b"x"), ("big/d.pdf", b"xxxx")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    assert {r.manual_id for r in uploads(spark, f"file://{tmp_path}").collect()} == {"man", "big"}
    assert {r.manual_id for r in uploads(spark, f"file://{tmp_path}", most_bytes=2).collect()} == {"man"}


def test_latest_status_as_a_stream(spark, tmp_path):
    source = f"file://{tmp_path}/jobs"
    spark.createDataFrame([("j", 2, "success"), ("j", 1, "processing")], "manual_id string, seq bigint, status string").write.parquet(source)
    stream = spark.readStream.schema("manual_id string, seq bigint, status string").parquet(source)
    q = I.latest_status(stream).writeStream.outputMode("complete").format("memory").queryName("jobs").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("jobs").collect()] == [("j", "success", 2)]


def test_keyed_table(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", "id string, manual_id string, content string, kind string", "id", most=3)
    assert t.count() == 0
    t.upsert(spark.createDataFrame([("1", "m", "x"), ("2", "m", "y")], "id string, manual_id string, content string"))
    t.upsert(spark.createDataFrame([("2", "n", "z", "k")], "id string, manual_id string, content string, kind string"))
    assert {tuple(r) for r in t.read().collect()} == {("1", "m", "x", None), ("2", "n", "z", "k")}
    assert t.delete(F.col("manual_id") == "m") == 1 and t.count() == 1 and t.delete(F.col("manual_id") == "m") == 0
    t.upsert(spark.createDataFrame([("9", "a"), ("9", "b")], "id string, content string"))  # the fourth change: a whole version follows
    assert t.count(F.col("id") == "9") == 1 and t.count() == 2
    t.upsert(spark.createDataFrame([("m", "c")], "manual_id string, content string"))
    assert t.count() == 3 and t.count(F.col("id") == "1") == 0
    assert t.vacuum() == 4 and t.count() == 3 and t.vacuum() == 0


def test_conditions(spark):
    df = spark.createDataFrame([("a", "x"), (None, "y"), ("b", "y")], "manual_id string, type string")
    n = lambda **k: df.where(conditions(**k)).count()
    assert n() == 3 and n(must={"manual_id": "", "type": []}) == 3
    assert n(must_not={"manual_id": "a"}) == 2 and n(must={"type": ["y"], "manual_id": "b"}) == 1
    lists = spark.createDataFrame([(["a", "b"],), (["c"],), (None,)], "part_numbers array<string>")
    assert lists.where(conditions({"part_numbers": ["b", "z"]}, arrays=("part_numbers",))).count() == 1
    assert lists.where(conditions(None, {"part_numbers": "b"}, ("part_numbers",))).count() == 2


def test_text_pages(spark, tmp_path):
    (tmp_path / "book.txt").write_text("one\ftwo")
    got = text_pages(spark, f"file://{tmp_path}/book.txt").collect()
    assert [(r.manual_id, r.page, r.content) for r in got] == [("book", 1, "one"), ("book", 2, "two")]
