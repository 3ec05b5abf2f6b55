"""Exact deduplication as a stateful stream (operator 5).

Texts are equal when identical after deleting every white-space character of
``[\x20\x09-\x0D]``.  Of equal texts, the row with the most code points in the
original text, then the least doc_id, stays.

The documents become a log of (digest, code points, doc_id, locator) without texts.
A Structured Streaming query reads the log and keeps, for each digest and without
expiry, the row that stays so far (its doc_id and its locator, which no other row has)
and how many rows there were.  The state lives in RocksDB on the executors' disks with its
checkpoint in the shared folder, so a new log file only touches its own digests and
a restarted query goes on where it stopped.  Map-side partial aggregation collapses
a hot digest before the shuffle, and rows of a hot digest learn its state by broadcast.

Hits are then checked on their full bytes: within every digest that came more than
once, the least and the greatest normalised text must be the same bytes.  Where they
are not, the rows of that digest are grouped by their bytes instead.  The digests that
came more than once are broadcast up to ``MAX_HITS``, so that only what may be equal
moves; beyond that they meet the texts by a shuffle.

Defined cases: null text counts as empty; empty and white-space-only texts are equal
to each other; of rows repeated with one doc_id exactly one stays; a null doc_id
comes after all others; an empty table gives an empty result; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import SPACES, dropped, evenly_joined, free_name, fresh_path, removed, written

#: Digests in a broadcast: about 20 MB.
MAX_HITS = 200_000

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # else every store sets aside 4 MB for its manifest, however little it holds
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _digest(text: Column, bits: int) -> Column:
    return F.substring(F.sha2(normalised(text), 256), 1, bits // 4)


def digest_log(df: DataFrame, digest_bits: int = 256) -> DataFrame:
    """(doc_id, text_sha256, digest, points, locator): what the stream reads; no text.

    The locator is the row's place in this log, once the log is written.  digest_bits below 256
    cuts the digest, which makes collisions; tests use that."""
    return df.select(
        "doc_id",
        F.sha2(normalised(F.col("text")), 256).alias("text_sha256"),
        _digest(F.col("text"), digest_bits).alias("digest"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("points"),
        F.struct(F.lit(uuid.uuid4().hex[:12]).alias("log"), F.monotonically_increasing_id().alias("row")).alias("locator"),
    )


def _rank() -> Column:
    """Least first: most code points, then doc_id (null last), then the place."""
    return F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("absent"), F.col("doc_id"), F.col("locator"))


_STATE = "digest string, stays struct<less:bigint,absent:boolean,doc_id:bigint,locator:struct<log:string,row:bigint>>, group_size bigint"


def run_stream(spark: SparkSession, log_path: str, schema, checkpoint: str, out: str, files_per_batch: int | None = None) -> DataFrame:
    """Feeds what is new in the log to the state; gives (digest, stays, group_size) of all digests so far.

    checkpoint and out may be those of an earlier call: then only new log files are read.
    """
    own = spark.newSession()  # the settings of the stores are those of this query alone
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(k, spark.conf.get(k))
    for k, v in _STORE.items():
        own.conf.set(k, v)
    reader = own.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    state = reader.parquet(log_path).groupBy("digest").agg(F.min(_rank()).alias("stays"), F.count("*").alias("group_size"))

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch replaces itself

    state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    changes = spark.read.schema(f"{_STATE}, batch bigint").parquet(out)
    return changes.groupBy("digest").agg(F.max_by(F.struct("stays", "group_size"), "batch").alias("s")).select("digest", "s.stays", "s.group_size")


def collisions(df: DataFrame, state: DataFrame, digest_bits: int) -> DataFrame:
    """The digests that came more than once with texts that differ; whole bytes are compared."""
    hits = state.where("group_size > 1").select("digest")
    keyed = df.select(normalised(F.col("text")).alias("body"), _digest(F.col("text"), digest_bits).alias("digest"))
    if hits.count() <= MAX_HITS:
        keyed = keyed.join(F.broadcast(hits), "digest", "left_semi")
    else:
        sizes = state.where("group_size > 1").select("digest", F.col("group_size").alias("count"))
        keyed = evenly_joined(keyed, hits, "digest", sizes)
    # equal bodies of a task are one row before they move
    ends = keyed.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    return ends.where("low <> high").select("digest")


def exact_duplicates(df: DataFrame, digest_bits: int = 256, files_per_batch: int | None = None) -> DataFrame:
    """One row per row of ``df(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256, locator."""
    spark = df.sparkSession
    df = df.select("doc_id", "text")
    log = written(digest_log(df, digest_bits), "digests")
    out, checkpoint = fresh_path(spark, "digest-state"), fresh_path(spark, "digest-checkpoint")
    if log.isEmpty():
        state = spark.createDataFrame([], _STATE)
        bad = state.select("digest")
    else:
        path = log.inputFiles()[0].rsplit("/", 1)[0]
        state = written(run_stream(spark, path, log.schema, checkpoint, out, files_per_batch), "digest-groups")
        bad = written(collisions(df, state, digest_bits), "digest-collisions")
    rows = evenly_joined(log, state, "digest", state.select("digest", F.col("group_size").alias("count")))
    if not bad.isEmpty():
        # grouped by their bytes; not one such digest is known for SHA-256
        full = df.select("doc_id", normalised(F.col("text")).alias("body"), F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("points"), _digest(F.col("text"), digest_bits).alias("digest"))
        full = full.join(F.broadcast(bad), "digest", "left_semi").withColumn("locator", F.struct(F.lit("collision").alias("log"), F.monotonically_increasing_id().alias("row")))
        full = written(full, "digest-collided")
        groups = full.groupBy("digest", "body").agg(F.min(_rank()).alias("stays"), F.count("*").alias("group_size"))
        parted = full.join(groups, ["digest", "body"]).withColumn("text_sha256", F.sha2("body", 256))
        rows = rows.join(F.broadcast(bad), "digest", "left_anti").unionByName(parted.select(rows.columns))
    result = rows.select("doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("locator") == F.col("stays.locator")).alias("kept"), "text_sha256", "locator")
    if log.isEmpty():
        return result
    result = written(result, "digest-result")
    dropped(log, state, bad)
    removed(spark, out, checkpoint)
    return result


def without_duplicates(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    found = exact_duplicates(df)
    keep, of, sha, place = (free_name(n, df.columns) for n in ("keep", "of", "sha", "place"))
    stay = found.where("kept").select(F.col("doc_id").alias(keep), F.col("text_sha256").alias(of))
    same = F.col("doc_id").eqNullSafe(F.col(keep)) & (F.col(sha) == F.col(of))
    left = df.withColumn(sha, F.sha2(normalised(F.col("text")), 256)).join(stay, same, "left_semi")
    again = found.groupBy(F.col("doc_id").alias(keep), F.col("text_sha256").alias(of)).count().where("count > 1").drop("count")
    if again.isEmpty():
        return left.drop(sha)
    # equal texts of one doc_id: one row, the longest
    several = left.join(again, same, "left_semi")
    first = Window.partitionBy("doc_id", sha).orderBy(F.desc(F.char_length(F.coalesce("text", F.lit("")))), F.xxhash64(*df.columns))
    several = several.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
    return left.join(again, same, "left_anti").unionByName(several).drop(sha)


#: The same result in SQL, for the driver's comparison.
ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body FROM documents),
r AS (
  SELECT doc_id, body, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size
  FROM t WINDOW w AS (PARTITION BY body ORDER BY length(text) DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM r
"""
