"""Moving a relational table into snapshots, range after range of its key; a run that is started again reads no range twice.

Each range is one batch of ``uploads.store``, named by its bounds, so the batches that are committed are the mark of how far
the migration is: a range is written and counted in one step, or not at all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources import uploads
from leafmill.sources.scratch import held


@dataclass
class Progress:
    ranges: int  # all ranges of the key
    read: int  # by this run
    stored: int  # rows of the migration, of all runs
    skipped: int  # rows without a vector, of this run


def relational(spark: SparkSession, url: str, table: str, key: str, parts: int = 4, **options: str) -> Callable[[int, int], DataFrame]:
    """A reader of rows with low <= key < high, in ``parts`` ranges at once."""

    def read(low: int, high: int) -> DataFrame:
        reader = spark.read.format("jdbc").options(url=url, dbtable=f"(SELECT * FROM {table} WHERE {key} >= {low} AND {key} < {high}) r", partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
        return reader.options(**options).load()

    return read


def migrate(spark: SparkSession, read: Callable[[int, int], DataFrame], path: str, low: int, high: int, step: int, migration: int = 1, vector: str | None = "embedding", most: int | None = None, **options) -> Progress:
    """Stores rows(manual_id, ...) with low <= key < high as upload ``migration`` of their manuals; ``most``: ranges of this run.

    Rows without a vector are left out.  Call ``uploads.finish`` when all ranges are read; until then readers see what was there before."""
    done = _batches(spark, path, migration)
    bounds = [(a, min(a + step, high)) for a in range(low, high, step)]
    n_read = skipped = 0
    for a, b in bounds:
        if most is not None and n_read >= most:
            break
        name = f"migration-{migration}-{a}-{b}"
        if name in done:
            continue
        rows = held(read(a, b).withColumn("upload_id", F.lit(migration).cast("bigint")))  # the source is read once
        good = rows if vector is None else rows.where(F.col(vector).isNotNull())
        uploads.store(good, path, name, **options)
        n_read += 1
        skipped += 0 if vector is None else rows.where(F.col(vector).isNull()).count()
    stored = uploads.files(spark, path).where(F.col("upload_id") == migration).agg(F.sum("n")).first()[0] or 0
    return Progress(len(bounds), n_read, stored, skipped)


def _batches(spark: SparkSession, path: str, migration: int) -> set[str]:
    """Names of the committed batches of a migration; an empty range has a commit file as well."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName().removesuffix(".json") for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return {n for n in names if n.startswith(f"migration-{migration}-")}
