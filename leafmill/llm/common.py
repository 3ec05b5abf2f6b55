"""What several operators share: the shared folder, written tables, hold-out rule."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Where the setting is absent, as in tests, a local session gets a temporary
    folder; a cluster without the setting is an error, because executors could
    not read what others wrote.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(context, "_leafmill_dir"):
        context._leafmill_dir = tempfile.mkdtemp(prefix="leafmill-")
    return f"file://{context._leafmill_dir}"


#: Paths that ``scratch`` watches, innermost last.
_WATCHED: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_dir(spark)}/leafmill/{name}-{uuid.uuid4().hex}"
    for made in _WATCHED:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """The paths that are taken within, in order; if it fails they are deleted."""
    made: list[str] = []
    _WATCHED.append(made)
    try:
        yield made
    except BaseException:
        removed(spark, *made)
        raise
    finally:
        _WATCHED.pop()


def free_name(name: str, taken: list[str] | tuple[str, ...]) -> str:
    """``name``, with underscores before it until no column has it; Spark's names have no case."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again.

    This cuts the lineage: a lost executor costs a read of the table, not a
    second run of what made it.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        removed(df.sparkSession, *(file.rsplit("/", 1)[0] for file in df.inputFiles()[:1]))


def evenly_joined(many: DataFrame, one: DataFrame, key: str, sizes: DataFrame | None = None) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has each key once, when a key may hold much of ``many``.

    A key with more than a share of 1 / (4 * shuffle partitions) of the rows is met by broadcast.  There are
    fewer than 4 * partitions such keys, whatever the data; the others meet by a shuffle.
    sizes(<key>, count) of ``many``, if they are known."""
    spark = many.sparkSession
    sizes = many.groupBy(key).count() if sizes is None else sizes
    total = sizes.agg(F.sum("count")).first()[0] or 0
    most = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = [r[key] for r in sizes.where(F.col("count") * most > total).select(key).collect()]
    if not hot:
        return many.join(one, key)
    names = spark.createDataFrame([(k,) for k in hot], many.select(key).schema)
    rows = one.join(F.broadcast(names), key, "left_semi").collect()
    known = spark.createDataFrame(rows, one.schema)
    few = many.join(F.broadcast(names), key, "left_anti").join(one, key)
    return many.join(F.broadcast(known), key).unionByName(few)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving the memory of a task back to the system when it is done.  A worker that waits for its
    next task else keeps what Arrow and the allocator hold, next to the memory of the JVM."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return task


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now, not at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bucket4(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 4; 2 marks held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
