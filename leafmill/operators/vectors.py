"""Nearest rows by cosine for whole tables of queries: several slots in one pass over the rows.

Queries go out in blocks of a checked size, ordered by manual.  A task scores its rows against a block as matrix
products, once for all slots, and holds for each (query, slot) its k best; a row that is worse than those is
dropped at once.  Only these meet in a window, with the columns that later steps need, so nothing is looked up again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.sources.scratch import held

#: Queries in one broadcast block.
BLOCK = 4096
#: Rows that are scored at once against all queries of a block.
ROWS = 1024
#: A task thins out the hits of a slot when it holds so many.
HELD = 1 << 17
#: A block's manuals and cells go into the filter of the scan up to so many names.
MAX_NAMES = 512


@dataclass(frozen=True)
class Slot:
    """The k best rows of some types (none: all) with the query's key (``same``), without it (``other``), or all (``any``)."""

    name: str
    k: int
    types: tuple[str, ...] = ()
    scope: str = "same"


#: Rows that list a code of the query, in order of id; not scored.
EXACT = "exact"


@dataclass
class Block:
    """Queries in the driver and, by broadcast, in the tasks."""

    ids: np.ndarray
    vectors: np.ndarray  # of length one, or zero
    by_key: dict[object, np.ndarray]
    by_code: dict[tuple[object, str], list[int]] = field(default_factory=dict)
    probes: np.ndarray | None = None  # queries x cells: which cells a query looks into


def blocks(queries: DataFrame, key: str) -> Iterator[Block]:
    """All queries, at most about BLOCK at once, those of a manual together; they are computed once.

    A vector that is missing, holds a NULL or NaN, or is of another length than the first good one becomes NaN: like nothing at all."""
    good = lambda v: v is not None and len(v) > 0 and not any(x is None or x != x for x in v)
    if key not in queries.columns:
        queries = queries.withColumn(key, F.lit(None).cast("string"))
    n = queries.count()
    if n > BLOCK:
        parts = -(-n // BLOCK)
        queries = held(queries.repartitionByRange(parts, key, "query_id").withColumn("block", F.spark_partition_id()))
        found = (queries.where(F.col("block") == b).collect() for b in range(parts))
    else:
        found = iter([queries.collect()])
    width = 0
    for rows in found:
        if not rows:
            continue
        width = width or next((len(r["vector"]) for r in rows if good(r["vector"])), 0)
        fits = [good(r["vector"]) and len(r["vector"]) == width for r in rows]
        q = np.array([r["vector"] if ok else [np.nan] * max(1, width) for r, ok in zip(rows, fits)], np.float64)
        by_key: dict[object, list[int]] = {}
        by_code: dict[tuple[object, str], list[int]] = {}
        for i, r in enumerate(rows):
            if fits[i]:
                by_key.setdefault(r[key], []).append(i)
            for code in (r["codes"] or ()) if "codes" in queries.columns else ():
                by_code.setdefault((r[key], code), []).append(i)
        q = unit(q)
        q[~np.array(fits, bool)] = np.nan
        yield Block(np.array([r["query_id"] for r in rows], np.int64), q, {x: np.array(i) for x, i in by_key.items()}, by_code)


def unit(v: np.ndarray) -> np.ndarray:
    length = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, length, out=np.zeros_like(v), where=length > 0)


class Best:
    """The k best (query, score, id) of a slot, with their payload rows."""

    def __init__(self, k: int, n: int):
        self.k, self.floor, self.n = k, np.full(n, -np.inf), 0
        self.hits: list[tuple[np.ndarray, ...]] = []
        self.rows: list[pa.RecordBatch] = []

    def add(self, q: np.ndarray, s: np.ndarray, ids: np.ndarray, at: np.ndarray, batch: pa.RecordBatch) -> None:
        if len(q):
            kept, place = np.unique(at, return_inverse=True)
            self.hits.append((q, s, ids, place + sum(r.num_rows for r in self.rows)))
            self.rows.append(batch.take(pa.array(kept)))
            self.n += len(q)
            if self.n > HELD:
                self.thin()

    def thin(self) -> None:
        """Best score first, then lower id; what can't be among the k best of its query any more has a score below ``floor``."""
        if not self.hits:
            return
        q, s, i, r = (np.concatenate(c) for c in zip(*self.hits))
        order = np.lexsort((i, -s, q))
        q, s, i, r = q[order], s[order], i[order], r[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        last = place == self.k - 1
        self.floor[q[last]] = s[last]
        q, s, i, r = (x[place < self.k] for x in (q, s, i, r))
        kept, r = np.unique(r, return_inverse=True)
        table = pa.Table.from_batches(self.rows).take(pa.array(kept)).combine_chunks()
        self.rows = table.to_batches() or [self.rows[0].slice(0, 0)]
        self.hits, self.n = [(q, s, i, r)], len(q)

    def scored(self, s: np.ndarray, wanted: np.ndarray, at: np.ndarray, ids: np.ndarray, batch: pa.RecordBatch) -> None:
        """s: scores of the queries ``wanted`` against rows ``at``; -inf: not to be taken."""
        if not s.size:
            return
        if s.shape[1] > self.k:
            least = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            x, y = np.nonzero((s >= np.maximum(least, self.floor[wanted])[:, None]) & (s > -np.inf))
        else:
            x, y = np.nonzero((s >= self.floor[wanted][:, None]) & (s > -np.inf))
        self.add(wanted[x], s[x, y], ids[at[y]], at[y], batch)


def slot_hits(index: DataFrame, queries: DataFrame, slots: list[Slot], payload: tuple[str, ...] = (), key: str = "manual_id", exact: int = 0, route=None) -> DataFrame:
    """query_id, slot, id, score, rank (1 is best) and ``payload`` of the best rows of every slot.

    index(id, embedding, type, <key>, <payload>); queries(query_id, vector, <key>).  A NULL key is no one's own
    (``same`` finds nothing) and foreign to all (``other``).  Ties go to the lower id.  Rows and queries without a
    vector, with a NULL or NaN in it or of another length are left out; a vector of length zero is like nothing: score 0.
    exact: so many rows of the query's key that list one of its ``codes`` in ``part_numbers`` are found as well (slot ``exact``,
    score 1); they need no vector.  route: gives a Block its probes and the scan its filter (see ``sources.vector_index``)."""
    columns = ["id", "embedding", "type", F.col(key).alias("owner"), *([F.col("part_numbers")] if exact else []), *([F.col("cell")] if route else []), *(F.col(c).alias(f"p_{c}") for c in payload)]
    rows = index.select(*columns)
    own_only = all(s.scope == "same" for s in slots)
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("slot", T.StringType()), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType()), *(rows.schema[f"p_{c}"] for c in payload)])
    found = None
    for block in blocks(queries, key):
        part = index.where(route(block)).select(*columns) if route else rows
        names = {n for n in (*block.by_key, *(k for k, _ in block.by_code)) if n is not None}
        if own_only and len(names) <= MAX_NAMES:
            part = part.where(F.col("owner").isin(*names))
        if not exact:
            part = part.where(F.col("embedding").isNotNull())
        part = part.mapInArrow(_task(rows.sparkSession.sparkContext.broadcast(block), slots, payload, exact, bool(route)), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], schema)
    most = {s.name: s.k for s in slots} | {EXACT: exact}
    best = Window.partitionBy("query_id", "slot").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best))
    limit = F.create_map(*(F.lit(x) for pair in most.items() for x in pair))[F.col("slot")]
    return ranked.where(F.col("rank") <= max(most.values())).where(F.col("rank") <= limit).select("query_id", "slot", "id", "score", "rank", *(F.col(f"p_{c}").alias(c) for c in payload))


def _task(shared, slots: list[Slot], payload: tuple[str, ...], exact: int, routed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        width, n = block.vectors.shape[1], len(block.ids)
        best = {s.name: Best(s.k, n) for s in slots} | ({EXACT: Best(exact, n)} if exact else {})
        codes = pa.array(sorted({c for _, c in block.by_code}), pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                _score(block, whole.slice(at, ROWS), slots, best, payload, codes if exact else None, width, routed)
        for name, b in best.items():
            b.thin()
            if b.hits:
                q, s, i, r = b.hits[0]
                taken = pa.Table.from_batches(b.rows).take(pa.array(r)).combine_chunks()
                columns = [pa.array(block.ids[q]), pa.array([name] * len(q), pa.string()), pa.array(i), pa.array(s)]
                yield pa.RecordBatch.from_arrays([*columns, *(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in taken.columns[: len(payload)])], ["query_id", "slot", "id", "score", *(f"p_{c}" for c in payload)])

    return run


def _score(block: Block, batch: pa.RecordBatch, slots: list[Slot], best: dict[str, Best], payload: tuple[str, ...], codes: pa.Array | None, width: int, routed: bool) -> None:
    shown = batch.select([f"p_{c}" for c in payload] or ["id"])
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    owner = batch.column("owner").dictionary_encode()
    of, names = owner.indices.fill_null(-1).to_numpy(zero_copy_only=False), owner.dictionary.to_pylist()
    if codes is not None and len(codes):
        listed = batch.column("part_numbers")
        of_row, flat = pc.list_parent_indices(listed), pc.list_flatten(listed)
        some = pc.is_in(flat, value_set=codes)
        met = {(q, row) for row, code in zip(of_row.filter(some).to_pylist(), flat.filter(some).to_pylist()) for q in block.by_code.get((names[of[row]] if of[row] >= 0 else None, code), ()) if of[row] >= 0}
        if met:
            q, row = np.array(sorted(met)).T
            best[EXACT].add(q, np.ones(len(q)), ids[row], row, shown)
    vectors = batch.column("embedding")
    fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False).to_numpy(zero_copy_only=False))
    if not len(fits):
        return
    v = pc.list_flatten(vectors.take(pa.array(fits))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), width)
    fine = np.isfinite(v).all(1)
    fits, v = fits[fine], unit(v[fine])
    of = of[fits]
    kind = batch.column("type").to_numpy(zero_copy_only=False)[fits]
    typed = {s.types: np.isin(kind, s.types) if s.types else np.ones(len(fits), bool) for s in slots}
    near = block.probes[:, batch.column("cell").to_numpy(zero_copy_only=False)[fits]] if routed and block.probes is not None else None

    def scores(wanted: np.ndarray, at: np.ndarray) -> np.ndarray:
        s = np.round(block.vectors[wanted] @ v[at].T, 12)  # so that ties don't hang on the order of sums
        return s if near is None else np.where(near[np.ix_(wanted, at)], s, -np.inf)

    if any(s.scope == "same" for s in slots):  # only the queries of a manual meet its rows
        for n, name in enumerate(names):
            wanted = block.by_key.get(name)
            if name is not None and wanted is not None:
                at = np.flatnonzero(of == n)
                s_all = scores(wanted, at)
                for s in slots:
                    if s.scope == "same":
                        mine = typed[s.types][at]
                        best[s.name].scored(s_all[:, mine], wanted, fits[at[mine]], ids, shown)
    if any(s.scope != "same" for s in slots):
        everyone, everything = np.arange(len(block.ids)), np.arange(len(fits))
        s_all = scores(everyone, everything)
        foreign = s_all.copy() if any(s.scope == "other" for s in slots) else s_all
        for n, name in enumerate(names):
            if name is not None and name in block.by_key and foreign is not s_all:
                foreign[np.ix_(block.by_key[name], np.flatnonzero(of == n))] = -np.inf
        for s in slots:
            if s.scope != "same":
                mine = typed[s.types]
                best[s.name].scored((foreign if s.scope == "other" else s_all)[:, mine], everyone, fits[mine], ids, shown)

