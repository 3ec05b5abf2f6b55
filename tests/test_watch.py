import random
from datetime import datetime, timedelta

import pytest

from leafmill.streaming import watch as W

POLLS = "manual_id string, at timestamp, seq bigint, status string"
START = datetime(2024, 1, 1)


def plain(rows, minutes=60, unknown=3):
    jobs, now = {}, max(r[1] for r in rows)
    for manual, at, seq, status in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1], r[2])):
        job = jobs.setdefault(manual, {"start": at, "streak": 0, "polls": 0, "end": None})
        if job["end"] or at >= job["start"] + timedelta(minutes=minutes):
            continue
        job["polls"] += 1
        job["streak"] = job["streak"] + 1 if status == "unknown" else 0
        if status in ("success", "failed") or job["streak"] >= unknown:
            job["end"] = (status if status in ("success", "failed") else "lost", at)
    out = set()
    for manual, j in jobs.items():
        limit = j["start"] + timedelta(minutes=minutes)
        outcome, ended = j["end"] or (("overdue", limit) if now >= limit else ("processing", None))
        out.add((manual, outcome, j["polls"], ended))
    return out


def some(rnd, n=400):
    rows = [(f"j{rnd.randint(0, 40)}", START + timedelta(seconds=int(k * 20)), k, rnd.choice(["processing"] * 9 + ["unknown"] * 6 + ["success", "failed", None])) for k in range(n)]
    return [*rows, (None, START, 0, "success"), ("late", rows[-1][1], n, "processing")]


def test_table_against_a_loop(spark):
    rows = some(random.Random(2))
    found = {tuple(r) for r in W.outcomes(spark.createDataFrame(rows, POLLS).repartition(3)).collect()}
    assert found == plain(rows) and len({o for _, o, _, _ in found}) == 5
    assert W.outcomes(spark.createDataFrame([], POLLS)).count() == 0


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_stream_that_is_started_again(spark, rocks, tmp_path):
    rows = some(random.Random(5))
    source, target, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))
    parts = [rows[:130], rows[130:260], rows[260:]]

    def run():
        polls = spark.readStream.schema(POLLS).option("maxFilesPerTrigger", 1).parquet(source)
        W.watch(polls).writeStream.format("parquet").option("path", target).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return {tuple(r) for r in spark.read.schema(W.OUTCOME).parquet(target).collect()}

    for part in parts[:2]:
        spark.createDataFrame(part, POLLS).coalesce(1).write.mode("append").parquet(source)
        run()  # each run is a query of its own that goes on from the checkpoint
    # the last poll of all only moves the clock
    last = [*parts[2], ("clock", START + timedelta(days=1), 999, "processing")]
    spark.createDataFrame(last, POLLS).coalesce(1).write.mode("append").parquet(source)
    run()
    spark.createDataFrame([("clock", START + timedelta(days=1, seconds=1), 1000, "processing")], POLLS).coalesce(1).write.mode("append").parquet(source)
    found = run()
    wanted = {r for r in plain([*rows, *last[-1:]]) if r[0] != "clock"}
    assert {r for r in found if r[0] != "clock"} == wanted and len(wanted) > 30
