"""Vector codes by integer product quantisation (operator 12).

Vectors become integers floor(scale * x) and are cut into equal parts; each part position has a
codebook of at most ``entries`` entries.  A round sends the codebooks out, computes all squared
distances of an Arrow batch as |x|^2 - 2 x c + |c|^2 with exact int64 matrix products, takes the first
least one, and adds up each entry's parts; the sums of the tasks meet in a grouped shuffle, and the
driver holds the codebooks only (entries * dimensions numbers, whatever the data).

Defined cases: rows whose vector is null, empty or holds null, NaN or an infinity are dropped; an empty table
gives an empty result; with fewer than ``entries`` kept rows there are as many entries; an entry
without parts stays as it is; of equal distances the lowest index counts; the first codebook takes rows
by id (nulls last) and, within equal ids, by the bytes of their integers; repeated rows are rows of their own; null labels
are one label; other columns are ignored, whatever their names.  Vectors of different lengths, of a
length that can't be cut, or with numbers so large that a distance leaves 62 bits are an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import dropped, evenly_joined, frugal, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096

#: So many rows are compared with the codebooks at once.
ROWS = 4096


def kept_rows(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """id, label, n (dimensions), ints (little-endian int32) of the rows whose vector is whole and finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(vectors).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            x = np.floor(flat * scale)
            borders = np.append(0, np.cumsum(np.maximum(sizes, 0)))
            wrong = np.append(0, np.cumsum(~np.isfinite(flat)))
            good = np.flatnonzero((sizes > 0) & (wrong[borders[1:]] == wrong[borders[:-1]]))
            values = [x[borders[r] : borders[r + 1]] for r in good]
            if any(np.abs(v).max() > math.isqrt((1 << 60) // len(v)) for v in values):
                raise ValueError("a component is too large for exact distances in 62 bits")
            take = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(sizes[good].astype(np.int32)), pa.array([v.astype("<i4").tobytes() for v in values], pa.binary())], ["id", "label", "n", "ints"])

    schema = rows.select("id", "label").schema.add("n", "integer").add("ints", "binary")
    return rows.mapInArrow(run, schema)


def blocks(column: pa.Array, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows x parts x width) of the integers of a batch."""
    for at in range(0, len(column), ROWS):
        part = column.slice(at, ROWS)
        joined = np.frombuffer(b"".join(part.to_pylist()), "<i4").astype(np.int64)
        yield at, joined.reshape(len(part), parts, -1)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part, and its squared distance.  books: parts x entries x width."""
    code, far = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2], np.int64)
    for p in range(x.shape[1]):
        own, book = x[:, p, :], books[p]
        d = (own * own).sum(1)[:, None] - 2 * (own @ book.T) + (book * book).sum(1)
        code[:, p] = d.argmin(1)
        far[:, p] = d[np.arange(len(d)), code[:, p]]
    return code, far


def moved(ints: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = books.shape
    shared = ints.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        sums, counts = np.zeros(known.shape, np.int64), np.zeros(known.shape[:2], np.int64)
        for batch in batches:
            for _, x in blocks(batch.column(0), parts):
                code, _ = nearest(x, known)
                for p in range(parts):
                    mine = (np.arange(entries)[:, None] == code[:, p]).astype(np.int64)
                    sums[p] += mine @ x[:, p, :]
                    counts[p] += mine.sum(1)
        at = np.flatnonzero(np.repeat(counts.ravel() > 0, width))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at]), pa.array(np.repeat(counts.ravel(), width)[at])], ["at", "total", "n"])

    merged = ints.select("ints").mapInArrow(frugal(run), "at bigint, total bigint, n bigint").groupBy("at")
    out = books.copy().ravel()
    for r in merged.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        out[r["at"]] = int(r["total"]) // r["n"]
    return out.reshape(books.shape)


def assigned(ints: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code (bytes as hex), error."""
    shared = ints.sparkSession.sparkContext.broadcast(books)
    parts = books.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in blocks(batch.column(2), parts):
                code, far = nearest(x, shared.value)
                text = code.astype(np.uint8).tobytes().hex()
                codes = [text[2 * parts * k : 2 * parts * (k + 1)] for k in range(len(x))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), batch.column(1).slice(at, len(x)), pa.array(codes, pa.string()), pa.array(far.sum(1))], ["id", "label", "code", "error"])

    return ints.select("id", "label", "ints").mapInArrow(frugal(run), ints.select("id", "label").schema.add("code", "string").add("error", "long"))


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(<key>, code, error, label_error) of every kept row, and the codebooks (parts x entries x width).

    label_error is the error summed over the rows of a label; a label may hold any share of the rows."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part")
    ints = written(kept_rows(rows.select(rows[key].alias("id"), rows[label].alias("label"), rows[vector].alias("vector")), scale), "vector-ints")
    sizes = [r["n"] for r in ints.select("n").distinct().limit(2).collect()]
    if len(sizes) > 1 or sizes and sizes[0] % parts:
        raise ValueError(f"vectors have lengths {sizes}; one multiple of {parts} is needed")
    width = sizes[0] // parts if sizes else 0
    least = ints.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    first = np.frombuffer(b"".join(r["ints"] for r in least), "<i4").astype(np.int64).reshape(len(least), parts, width)
    books = np.ascontiguousarray(first.transpose(1, 0, 2))
    for _ in range(rounds if least else 0):
        books = moved(ints, books)
    found = written(assigned(ints, books), "vector-codes")
    dropped(ints)
    # a struct is a key that equals itself where the label is null
    keyed = found.withColumn("of", F.struct("label"))
    sums = keyed.groupBy("of").agg(F.sum("error").alias("label_error"), F.count("*").alias("count"))
    joined = evenly_joined(keyed, sums.select("of", "label_error"), "of", sums.select("of", "count"))
    return joined.select(F.col("id").alias(key), "code", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    """sha256 of all integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB SQL of the op12 query, one group of common tables a round."""
    steps = [
        f"""WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
numbers AS MATERIALIZED (
    SELECT r, CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT) AS x, (i - 1) // (n // {parts}) AS part, (i - 1) % (n // {parts}) AS pos
    FROM (SELECT r, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i, len(embedding) AS n FROM kept)),
book0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, x FROM numbers WHERE r <= {entries})"""
    ]
    nearest = """near{k} AS MATERIALIZED (
    SELECT r, part, entry, d FROM (
        SELECT r, part, entry, d, row_number() OVER (PARTITION BY r, part ORDER BY d, entry) AS n FROM (
            SELECT v.r, v.part, c.entry, sum((v.x - c.x) * (v.x - c.x)) AS d
            FROM numbers v JOIN book{k} c ON v.part = c.part AND v.pos = c.pos GROUP BY v.r, v.part, c.entry)) WHERE n = 1)"""
    for k in range(rounds):
        steps.append(nearest.format(k=k))
        steps.append(f"""book{k + 1} AS MATERIALIZED (
    SELECT c.part, c.entry, c.pos, coalesce(m.x, c.x) AS x FROM book{k} c LEFT JOIN (
        SELECT part, entry, pos, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (
            SELECT v.part, a.entry, v.pos, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS n
            FROM numbers v JOIN near{k} a ON v.r = a.r AND v.part = a.part GROUP BY v.part, a.entry, v.pos)) m
    ON c.part = m.part AND c.entry = m.entry AND c.pos = m.pos)""")
    steps.append(nearest.format(k=rounds))
    steps.append(f"""coded AS MATERIALIZED (
    SELECT k.vec_id, k.label, string_agg(printf('%02x', a.entry), '' ORDER BY a.part) AS code, CAST(sum(a.d) AS BIGINT) AS error
    FROM kept k JOIN near{rounds} a ON k.r = a.r GROUP BY k.r, k.vec_id, k.label)""")
    return ",\n".join(steps) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM coded"""
