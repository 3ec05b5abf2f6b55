import pytest

from leafmill.llm import exactdup as D

ROWS = [(4, "a b\tc"), (2, "abc"), (9, "a  b c "), (1, "abd"), (5, None), (6, ""), (7, " \n\x0b"), (7, " \n\x0b"), (8, "a bc"), (3, "a  b c "), (None, "abd")]


def expected(rows):
    key = lambda t: (t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})
    out = []
    for d, t in rows:
        group = [r for r in rows if key(r[1]) == key(t)]
        keep = min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        out.append((d, keep, len(group)))
    return out


@pytest.mark.parametrize(("bits", "files"), [(256, None), (256, 1), (4, None), (4, 1)])
def test_groups(spark, bits, files):
    df = spark.createDataFrame([(*r, "x", 0) for r in ROWS], "doc_id bigint, text string, digest string, points int").repartition(3)
    got = D.exact_duplicates(df, digest_bits=bits, files_per_batch=files).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or 0, r[2])
    assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=order) == sorted(expected(ROWS), key=order)
    kept = sorted(r.doc_id for r in got if r.kept)
    assert kept == [1, 3, 7, 8]


def test_rows_that_stay(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id bigint, text string, kept int")
    out = D.without_duplicates(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 7, 8]
    assert D.exact_duplicates(df.limit(0)).count() == 0


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder, mark, out = (f"file://{tmp_path}/{n}" for n in ("log", "mark", "out"))
    for rows in ([(5, "x y"), (6, "q")], [(2, "xy "), (3, "xy")]):
        log = D.digest_log(spark.createDataFrame(rows, "doc_id bigint, text string"))
        log.coalesce(1).write.mode("append").parquet(folder)
        state = D.run_stream(spark, folder, log.schema, mark, out)
    assert sorted((r.stays.doc_id, r.group_size) for r in state.collect()) == [(2, 3), (6, 1)]


@pytest.mark.parametrize("bits", [4, 256])
def test_one_doc_id_with_many_texts(spark, bits):
    """Digests of four bits collide; rows of one doc_id, or of none, may have several texts in one digest."""
    rows = [(1, f"text {i % 7}") for i in range(40)] + [(None, f"text {i % 5}") for i in range(20)] + [(2, "text 3")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = D.exact_duplicates(df, digest_bits=bits).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or 0, r[2])
    assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=order) == sorted(expected(rows), key=order)
    assert sum(r.kept for r in got) == 7 and all(r.doc_id == r.keep_id == 1 for r in got if r.kept)
    left = D.without_duplicates(df).collect()
    assert sorted(r.text for r in left) == [f"text {i}" for i in range(7)] and {r.doc_id for r in left} == {1}


def test_hits_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_HITS", 0)
    test_groups(spark, 256, None)
    test_groups(spark, 4, None)


def test_settings_of_the_session_stay(spark):
    before = dict(spark.conf.getAll) if not callable(spark.conf.getAll) else dict(spark.conf.getAll())
    D.exact_duplicates(spark.createDataFrame([(1, "a")], "doc_id bigint, text string")).count()
    after = dict(spark.conf.getAll) if not callable(spark.conf.getAll) else dict(spark.conf.getAll())
    assert before == after
