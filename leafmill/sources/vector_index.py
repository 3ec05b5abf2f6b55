"""A vector index in a folder: rows in partitions by (bucket of the manual, cell), searched by pruning partitions.

Cells come from a coarse quantiser, spherical k-means over a bounded sample of the rows; every row goes to the
cell whose centre is most like it, rows without a usable vector to cell -1, so the index holds all rows.  A search
sends a query to its ``probes`` nearest cells (or to all of them: exact), reads only partitions that some query of a block
looks into, and ranks their rows exactly.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from leafmill.operators.vectors import Block, Slot, slot_hits, unit

#: Rows from which the centres are learned, whatever the size of the table: those with the least hash of their id.
MAX_SAMPLE = 16_384
ROUNDS = 12


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means; starts from evenly spaced rows of the sample, an empty cell takes the row that is least like its centre."""
    if not len(sample):
        return np.zeros((0, 0))
    x = unit(sample)
    found = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        s = x @ found.T
        of = s.argmax(1)
        sums = np.zeros_like(found)
        np.add.at(sums, of, x)
        empty = np.flatnonzero(np.bincount(of, minlength=len(found)) == 0)
        sums[empty] = x[np.argsort(s.max(1), kind="stable")[: len(empty)]]
        found = unit(sums)
    return found


def with_cell(rows: DataFrame, middle: np.ndarray) -> DataFrame:
    """``rows`` with ``cell``; the centres are broadcast (cells * dimensions numbers)."""
    shared = rows.sparkSession.sparkContext.broadcast(middle)
    names = rows.columns
    at = names.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            cell = np.full(batch.num_rows, -1, np.int32)
            vectors = batch.column(at)
            fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), m.shape[1]), False).to_numpy(zero_copy_only=False)) if len(m) else np.zeros(0, int)
            if len(fits):
                v = pc.list_flatten(vectors.take(pa.array(fits))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), -1)
                fine = np.isfinite(v).all(1)
                cell[fits[fine]] = (unit(v[fine]) @ m.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*names, "cell"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("cell", IntegerType())]))


def build(rows: DataFrame, path: str, cells: int = 64, buckets: int = 16, key: str = "manual_id") -> "VectorIndex":
    """Writes rows(id, embedding, type, <key>, ...) as an index; a folder that is there is replaced."""
    spark = rows.sparkSession
    good = rows.where("embedding IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x))").select("id", "embedding")
    sample = good.orderBy(F.xxhash64("id"), "id").limit(MAX_SAMPLE).collect()
    width = len(sample[0]["embedding"]) if sample else 0
    middle = centres(np.array([r["embedding"] for r in sample if len(r["embedding"]) == width], np.float64).reshape(-1, width), cells)
    placed = with_cell(rows, middle).withColumn("bucket", bucket_of(F.col(key), buckets))
    # partitions that are large are written by several tasks, small ones share a task; a manual's rows lie together in a file
    placed.hint("rebalance", "bucket", "cell").sortWithinPartitions("bucket", "cell", key, "type").write.mode("overwrite").partitionBy("bucket", "cell").parquet(f"{path}/rows")
    about = {"key": key, "buckets": buckets, "schema": rows.schema.json()}
    spark.createDataFrame([(json.dumps(about), [v.tolist() for v in middle])], "about string, centres array<array<double>>").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    return VectorIndex(spark, path)


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        known = spark.read.parquet(f"{path}/about").first()
        about = json.loads(known["about"])
        self.key, self.buckets = about["key"], about["buckets"]
        self.centres = np.array(known["centres"], np.float64)
        schema = StructType.fromJson(json.loads(about["schema"])).add("bucket", "integer").add("cell", "integer")
        self.rows = spark.read.schema(schema).parquet(f"{path}/rows")

    def hits(self, queries: DataFrame, slots: list[Slot], probes: int | None = None, payload: tuple[str, ...] = ()) -> DataFrame:
        """As ``vectors.slot_hits`` over the index.  probes: cells that a query looks into; None: all of them, which is exact."""

        def route(block: Block) -> Column:
            known = [n for n in block.by_key if n is not None]
            wanted = F.lit(True)
            if probes is not None and len(self.centres):
                near = np.nan_to_num(block.vectors, nan=0.0) @ self.centres.T
                block.probes = np.zeros((len(near), near.shape[1] + 1), bool)  # the last column is cell -1
                np.put_along_axis(block.probes, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
                wanted = F.col("cell").isin([int(c) for c in np.flatnonzero(block.probes.any(0)[:-1])])
            if all(s.scope == "same" for s in slots):  # else every bucket has rows of other manuals
                numbers = self.rows.sparkSession.createDataFrame([(str(n),) for n in known], "k string").select(bucket_of(F.col("k"), self.buckets).alias("b")).distinct()
                wanted &= F.col("bucket").isin([r["b"] for r in numbers.collect()])
            return wanted

        return slot_hits(self.rows, queries, slots, payload, self.key, route=route)

    def search(self, queries: DataFrame, k: int, types: tuple[str, ...] = (), scope: str = "same", probes: int | None = None) -> DataFrame:
        return self.hits(queries, [Slot("", k, types, scope)], probes).drop("slot")

    def recall(self, queries: DataFrame, k: int, probes: int, types: tuple[str, ...] = (), scope: str = "same") -> float:
        """The share of the exact k nearest rows that a search with ``probes`` finds."""
        exact = self.search(queries, k, types, scope).select("query_id", "id")
        found = exact.join(self.search(queries, k, types, scope, probes).select("query_id", "id"), ["query_id", "id"], "left_semi")
        return found.count() / max(1, exact.count())

    def tuned(self, queries: DataFrame, k: int, target: float = 0.9, types: tuple[str, ...] = (), scope: str = "same") -> int:
        """The fewest probes, in steps of an eighth of the cells, whose measured recall over ``queries`` reaches the target."""
        step = max(1, len(self.centres) // 8)
        for probes in range(step, len(self.centres), step):
            if self.recall(queries, k, probes, types, scope) >= target:
                return probes
        return max(1, len(self.centres))
