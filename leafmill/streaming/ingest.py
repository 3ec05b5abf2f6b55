"""Incremental ingestion of arriving documents and the status of jobs, as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.text import chunked
from leafmill.sources import uploads


def arriving(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


#: A chunk as it is stored.
STORED = "manual_id string, upload_id bigint, page int, doc_id bigint, chunk_no int, content string"


def ingest(source: DataFrame, target: str, checkpoint: str):
    """Chunks arriving pages(manual_id, upload_id, page, doc_id, content, ended) into the snapshots of ``target``.

    The pages of an upload may come in any number of batches; a row with ``ended`` says that it is complete, and holds no page
    itself if its page is NULL.  A repeated batch changes nothing, and readers (``stored``) see an upload when it has ended."""

    def sink(batch: DataFrame, number: int) -> None:
        chunks = chunked(batch.where("page IS NOT NULL"), keep=("manual_id", "upload_id", "page", "doc_id"))
        uploads.store(chunks, target, f"ingest-{number}")
        uploads.finish(batch.where("ended"), target)

    return source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def stored(spark: SparkSession, target: str) -> DataFrame:
    """The chunks that count: of each manual those of its last ended upload."""
    return uploads.live(spark, target, STORED)


def latest_status(updates: DataFrame) -> DataFrame:
    """The last status of each job by sequence number, not by arrival; batch or streaming (update mode)."""
    return updates.groupBy("manual_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def job_state(updates: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """A shallow merge of partial updates(manual_id, seq, <fields>): of each field the last value that an
    update set (NULL sets nothing), and the last sequence number.  Batch or streaming (update mode)."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields]
    return updates.groupBy("manual_id").agg(*last, F.max("seq").alias("updated"))


def status_of(asked: DataFrame, jobs: DataFrame) -> DataFrame:
    """asked(manual_id) with what is known of the job; a job that nobody has heard of is ``unknown``."""
    found = asked.select("manual_id").distinct().join(jobs, "manual_id", "left")
    return found.withColumn("status", F.coalesce("status", F.lit("unknown")))


def summary(updates: DataFrame) -> DataFrame:
    """Counts of stored, failed and empty items and the state of each manual, with up to five failed items."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = updates.groupBy("manual_id").agg(n("success").alias("stored"), n("failed").alias("failed"), n("unknown").alias("empty"), F.slice(F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.col("seq")))), 1, 5).alias("samples"))
    return out.withColumn("state", F.when(F.col("failed") > 0, "partial").otherwise("success"))
