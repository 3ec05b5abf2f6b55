from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leafmill.functions import models as M
from leafmill.sources import answers as A
from leafmill.sources import migration as G
from leafmill.sources import uploads as U


def counting(log):
    class Counting(M.Offline):
        """Writes down each prompt that it answers; fails on the first sight of ``flaky`` and always on ``bad``."""

        def chat(self, prompts):
            out = []
            for p in prompts:
                name = p.replace(" ", "")
                before = list(Path(log).glob(f"{name}-*"))
                (Path(log) / f"{name}-{len(before)}").touch()
                if p.startswith("bad") or p.startswith("flaky") and not before:
                    raise ValueError(p)
                out.append(None if p.startswith("none") else '{"a": "' + p + '", "b": "cut')
            return out

    return Counting


def said(word):
    return '{"a": "' + word + '", "b": "cut'


def calls(folder):
    return len(list(Path(folder).glob("*")))


def test_a_second_run_makes_no_call(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    folder, log = f"file://{tmp_path}/answers", str(tmp_path / "calls")
    provider = counting(log)
    rows = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, None), (5, " ")], "id int, prompt string")
    got = {r.id: r.answer for r in A.ask(rows, folder, "echo", provider=provider, wait=0, tasks=2).collect()}
    assert got == {1: said("one"), 2: said("two"), 3: said("one"), 4: None, 5: None} and calls(log) == 2
    assert {r.id: r.answer for r in A.ask(rows, folder, "echo", provider=provider, wait=0, tasks=2).collect()} == got and calls(log) == 2
    more = spark.createDataFrame([(1, "two"), (2, "three")], "id int, prompt string")
    assert {r.id: r.answer["a"] for r in A.ask_json(more, folder, "echo", "a string", provider=provider, wait=0, tasks=2).collect()} == {1: "two", 2: "three"} and calls(log) == 3
    A.ask(more, folder, "another question", provider=provider, wait=0, tasks=2)
    assert calls(log) == 5  # the kind is part of the address


def test_failed_calls_are_tried_again(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    folder, log = f"file://{tmp_path}/answers", str(tmp_path / "calls")
    provider = counting(log)
    rows = spark.createDataFrame([(1, "fine"), (2, "flaky"), (3, "bad"), (4, "none")], "id int, prompt string").coalesce(1)
    got = {r.id: r.answer for r in A.ask(rows, folder, "k", provider=provider, wait=0, tasks=1).collect()}
    assert got == {1: said("fine"), 2: said("flaky"), 3: None, 4: None} and A.kept(spark, folder).count() == 2
    before = calls(log)
    A.ask(rows, folder, "k", provider=provider, wait=0, tasks=1)
    assert calls(log) > before  # what failed is asked again
    with pytest.raises(ValueError):
        A.ask(rows.withColumn("answer", F.lit(1)), folder, "k")


def test_prompts_of_a_manual_are_bounded(spark):
    class Json(M.Offline):
        def chat(self, prompts):
            return ["{" + ", ".join(f'"{line.split(": ")[0]}": "part of {len(p)}"' for line in p.split("\n")) + ', "77": "invented"}' for p in prompts]

    rows = [("m", f"{k:03d}", n, "x" * 90) for k in range(40) for n in range(3)] + [("n", "1", 0, "y")]
    found = M.named_codes(spark.createDataFrame(rows, "manual_id string, code string, nth int, snippet string"), Json, most=1000).collect()
    assert {(r.manual_id, r.code) for r in found} == {(m, c) for m, c, _, _ in rows}
    assert max(int(r.name.split()[-1]) for r in found) < 1000 + 3 * 97


def test_migration_reads_no_range_twice(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(1, 96).select("id", F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("manual_id"), F.when(F.col("id") % 10 != 0, F.col("id").cast("string")).alias("embedding")).write.parquet(f"{path}-source")
    asked = []

    def read(low, high):
        asked.append(low)
        return spark.read.parquet(f"{path}-source").where(F.col("id").between(low, high - 1))

    first = G.migrate(spark, read, path, 1, 121, 20, most=2)
    assert (first.ranges, first.read, first.stored, first.skipped) == (6, 2, 36, 4)
    rest = G.migrate(spark, read, path, 1, 121, 20)
    assert (rest.read, rest.stored) == (4, 86) and sorted(asked) == [1, 21, 41, 61, 81, 101]
    assert G.migrate(spark, read, path, 1, 121, 20).read == 0 and len(asked) == 6
    ddl = "id bigint, manual_id string, embedding string, upload_id bigint"
    assert U.live(spark, path, ddl).count() == 0
    U.finish(U.files(spark, path), path)
    assert sorted(r.id for r in U.live(spark, path, ddl).collect()) == [i for i in range(1, 96) if i % 10]


def test_a_relational_table_in_ranges(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(50).selectExpr("id", "'m' AS manual_id").coalesce(1).write.format("jdbc").options(url=url, dbtable="chunks", driver=driver).save()
    read = G.relational(spark, url, "chunks", '"id"', parts=3, driver=driver)
    part = read(10, 30)
    assert sorted(r.id for r in part.collect()) == list(range(10, 30)) and part.rdd.getNumPartitions() == 3
