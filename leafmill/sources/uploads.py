"""Uploads of manuals as snapshots: a sink whose batches are committed as a whole, and readers of the live files.

A task stores its items in files of its own, in small requests: a request that fails is tried again item by item, and what still
fails becomes a row of the failed items.  Files count only when the driver has committed their batch, by one rename; a task
or a job that is run again leaves files that nobody lists, and a batch id that was committed before is not committed again.
An upload replaces the earlier ones of its manual when it has ended (``finish``), also if it holds no text at all; until then
readers see the one before.  Readers are given the files of live uploads only.

    {path}/data/{batch}/*.parquet    items          {path}/failed/{batch}/*.parquet    items that could not be stored
    {path}/commits/{batch}.json      files of a batch, with the upload of each       {path}/ended    ended uploads
"""

from __future__ import annotations

import importlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from leafmill import schema

#: Items of a request, and how often an item is tried by itself.
SIZE, TRIES = 32, 3

_FILE = "manual_id string, upload_id bigint, file string, n bigint"
_ENDED = "manual_id string, upload_id bigint"


def accepts(name: str | None) -> Callable[[list[dict]], None]:
    """``module:function``, called in the tasks with the items of a request; it raises if it can't take them."""
    if not name:
        return lambda items: None
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)


@dataclass
class _Files(WriterCommitMessage):
    stored: list[tuple[str, int, str, int]]
    failed: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.root, self.batch = options["path"].rstrip("/"), options["batch"]
        self.size, self.tries, self.wait = int(options.get("size", SIZE)), int(options.get("tries", TRIES)), float(options.get("wait", 0.2))
        self.store = options.get("accepts")

    def _open(self):
        return pafs.FileSystem.from_uri(self.root)

    def _taken(self, batch: pa.RecordBatch, accept: Callable[[list[dict]], None]) -> list[str | None]:
        """For each item of a request the reason why it can't be stored, or None."""
        items = batch.to_pylist()
        try:
            accept(items)
            return [None] * len(items)
        except Exception:  # noqa: BLE001  a single bad item must not take the others with it
            return [self._alone(i, accept) for i in items]

    def _alone(self, item: dict, accept: Callable[[list[dict]], None]) -> str | None:
        reason = None
        for k in range(self.tries):
            try:
                accept([item])
                return None
            except Exception as e:  # noqa: BLE001
                reason = str(e)[:200] or type(e).__name__
                if k + 1 < self.tries:
                    time.sleep(self.wait * 2**k)
        return reason

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Files:
        fs, base = self._open()
        accept, done, failed, now = accepts(self.store), [], [], None  # now: (upload, file, writer, items)

        def close() -> None:
            if now:
                now[2].close()
                done.append((*now[0], now[1], now[3]))

        def opened(kind: str, arrow: pa.Schema) -> tuple[str, pq.ParquetWriter]:
            fs.create_dir(f"{base}/{kind}/{self.batch}", recursive=True)
            name = f"{kind}/{self.batch}/{uuid.uuid4().hex}.parquet"
            return name, pq.ParquetWriter(f"{base}/{name}", arrow, filesystem=fs, compression="zstd")

        bad: list[pa.RecordBatch] = []
        for batch in iterator:
            for at in range(0, batch.num_rows, self.size):
                part = batch.slice(at, self.size)
                reasons = self._taken(part, accept)
                good = [i for i, r in enumerate(reasons) if r is None]
                if len(good) < part.num_rows:
                    lost = [i for i, r in enumerate(reasons) if r is not None]
                    bad.append(part.take(pa.array(lost)).append_column("reason", pa.array([reasons[i] for i in lost], pa.string())))
                    part = part.take(pa.array(good, pa.int64()))
                manuals, uploads = part.column("manual_id").to_pylist(), part.column("upload_id").to_pylist()
                start = 0
                for i in range(1, part.num_rows + 1):  # rows come sorted by upload: a file is closed when the next one begins
                    if i == part.num_rows or (manuals[i], uploads[i]) != (manuals[start], uploads[start]):
                        of = (manuals[start], uploads[start])
                        if now is None or now[0] != of:
                            close()
                            now = [of, *opened("data", part.schema), 0]
                        now[2].write_batch(part.slice(start, i - start))
                        now[3] += i - start
                        start = i
        close()
        if bad:
            name, writer = opened("failed", bad[0].schema)
            for b in bad:
                writer.write_batch(b)
            writer.close()
            failed.append(name)
        return _Files(done, failed)

    def commit(self, messages: list[_Files | None]) -> None:
        fs, base = self._open()
        name = f"{base}/commits/{self.batch}.json"
        if fs.get_file_info(name).type != pafs.FileType.NotFound:
            self.abort(messages)  # this batch was stored before; its first files stay
            return
        fs.create_dir(f"{base}/commits", recursive=True)
        lines = [json.dumps(dict(zip(("manual_id", "upload_id", "file", "n"), f))) for m in messages if m for f in m.stored]
        lines += [json.dumps({"file": f, "n": 0}) for m in messages if m for f in m.failed]
        hidden = f"{base}/commits/.{self.batch}-{uuid.uuid4().hex}"
        with fs.open_output_stream(hidden) as out:
            out.write("\n".join(lines).encode())
        fs.move(hidden, name)

    def abort(self, messages: list[_Files | None]) -> None:
        fs, base = self._open()
        for m in messages:
            for name in [*(f[2] for f in m.stored), *m.failed] if m else ():
                fs.delete_file(f"{base}/{name}")


class UploadSink(DataSource):
    """``df.write.format("leafmill_uploads")``; options path, batch, and size, tries, wait, accepts (``module:function``)."""

    @classmethod
    def name(cls) -> str:
        return "leafmill_uploads"

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def store(items: DataFrame, path: str, batch: str, **options: object) -> None:
    """Stores items(manual_id, upload_id, ...) as one batch; a repeated batch id changes nothing.  Items without a manual or upload are errors."""
    items.sparkSession.dataSource.register(UploadSink)
    named = items.withColumn("manual_id", F.coalesce("manual_id", F.raise_error(F.lit("an item without a manual")).cast("string")))
    placed = named.hint("rebalance", "manual_id", "upload_id").sortWithinPartitions("manual_id", "upload_id")
    placed.write.format("leafmill_uploads").options(path=path, batch=batch, **options).mode("append").save()


def finish(ended: DataFrame, path: str) -> None:
    """ended(manual_id, upload_id): from now on these uploads count, and those of a manual before them don't."""
    ended.select("manual_id", F.col("upload_id").cast("bigint")).distinct().write.mode("append").parquet(f"{path}/ended")


def _read(spark: SparkSession, path: str, ddl: str, kind: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return getattr(spark.read.schema(ddl), kind)(path) if there else spark.createDataFrame([], ddl)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """manual_id, upload_id of the upload that counts of each manual: the last one that has ended."""
    return _read(spark, f"{path}/ended", _ENDED, "parquet").groupBy("manual_id").agg(F.max("upload_id").alias("upload_id"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """manual_id, upload_id, file, n of all committed files."""
    return _read(spark, f"{path}/commits", _FILE, "json").where("manual_id IS NOT NULL")


def live(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The items that count, read from the files of live uploads alone."""
    names = files(spark, path).join(latest(spark, path), ["manual_id", "upload_id"], "left_semi").select("file").collect()
    return spark.read.schema(ddl).parquet(*(f"{path}/{r['file']}" for r in names)) if names else spark.createDataFrame([], schema.struct(ddl))


def failed(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Items of committed batches that could not be stored, each with its reason."""
    names = _read(spark, f"{path}/commits", _FILE, "json").where("manual_id IS NULL").select("file").collect()
    ddl = f"{ddl}, reason string"
    return spark.read.schema(ddl).parquet(*(f"{path}/{r['file']}" for r in names)) if names else spark.createDataFrame([], schema.struct(ddl))


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes the files of uploads that a later one has replaced; gives how many they were.  Not while older snapshots are read."""
    now = latest(spark, path).withColumnRenamed("upload_id", "last")
    old = [r["file"] for r in files(spark, path).join(now, "manual_id").where(F.col("upload_id") < F.col("last")).select("file").collect()]
    fs, base = pafs.FileSystem.from_uri(path)
    gone = 0
    for name in old:
        if fs.get_file_info(f"{base}/{name}").type != pafs.FileType.NotFound:
            fs.delete_file(f"{base}/{name}")
            gone += 1
    return gone
