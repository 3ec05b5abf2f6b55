from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leafmill.sources import uploads as U

ITEM = "manual_id string, upload_id bigint, page int, type string, content string"


def picky(items):
    """A store that takes no request with a bad item, and each flaky item only when it is tried again."""
    for i in items:
        if i["content"] == "bad":
            raise ValueError(f"page {i['page']} is bad")
        if i["content"] and i["content"].startswith("flaky:"):
            mark = Path(i["content"].removeprefix("flaky:"))
            if not mark.exists():
                mark.touch()
                raise ValueError("try again")


def killed(items):
    """Ends the task of page 7 once, after other requests have been stored."""
    for i in items:
        if i["page"] == 7:
            mark = Path(i["content"])
            if not mark.exists():
                mark.touch()
                raise SystemExit(3)


def items(spark, rows):
    return spark.createDataFrame(rows, ITEM)


def seen(spark, path):
    return sorted((r.manual_id, r.upload_id, r.page) for r in U.live(spark, path, ITEM).collect())


def test_failed_items_are_rows(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = [("m", 1, k, "text", "fine") for k in range(100)] + [("m", 1, 200, "text", "bad"), ("m", 1, 201, "text", f"flaky:{tmp_path}/mark"), ("n", 1, 1, None, None)]
    U.store(items(spark, rows).repartition(3), path, "one", accepts="tests.test_uploads:picky", size=8, wait=0)
    U.finish(items(spark, rows), path)
    assert seen(spark, path) == sorted((m, u, p) for m, u, p, _, _ in rows if p != 200)
    assert [(r.page, r.reason) for r in U.failed(spark, path, ITEM).collect()] == [(200, "page 200 is bad")]


def test_a_task_that_is_run_again_stores_each_item_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = [("m", 1, k, "text", f"{tmp_path}/killed") for k in range(40)]
    for attempt in range(2):  # local mode runs no task twice, so the job is run again, as a restarted batch is
        try:
            U.store(items(spark, rows).coalesce(1), path, "one", accepts="tests.test_uploads:killed", size=4)
            assert attempt == 1
        except Exception:  # noqa: BLE001
            assert attempt == 0 and U.files(spark, path).count() == 0
    U.store(items(spark, rows), path, "one")  # the same batch once more
    U.finish(items(spark, rows), path)
    assert seen(spark, path) == [("m", 1, k) for k in range(40)]
    listed = {r.file for r in U.files(spark, path).collect()}
    assert len(listed) >= 1


def test_uploads_replace_each_other_when_they_end(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert seen(spark, path) == []
    U.store(items(spark, [("m", 1, 1, "t", "a"), ("n", 1, 1, "t", "a")]), path, "a")
    assert seen(spark, path) == []
    U.finish(items(spark, [("m", 1, 1, "t", ""), ("n", 1, 1, "t", "")]), path)
    U.store(items(spark, [("m", 2, 5, "t", "b")]), path, "b")
    assert seen(spark, path) == [("m", 1, 1), ("n", 1, 1)]
    U.finish(items(spark, [("m", 2, 5, "t", "b")]), path)
    U.finish(items(spark, [("n", 2, 5, "t", "b")]), path)  # an upload that has no text
    assert seen(spark, path) == [("m", 2, 5)]
    read = U.live(spark, path, ITEM).inputFiles()
    assert len(read) == 1
    assert U.vacuum(spark, path) == 2 and U.vacuum(spark, path) == 0 and seen(spark, path) == [("m", 2, 5)]


def test_nulls_and_empty_batches(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    U.store(items(spark, []), path, "none")
    assert seen(spark, path) == [] and U.failed(spark, path, ITEM).count() == 0
    with pytest.raises(Exception, match="without a manual"):
        U.store(items(spark, [(None, 1, 1, "t", "a")]), path, "odd")
    U.store(items(spark, [("m", 1, None, None, None)] * 3).withColumn("other", F.lit(1)), path, "more")
    U.finish(items(spark, [("m", 1, 1, "t", "")]), path)
    assert seen(spark, path) == [("m", 1, None)] * 3
