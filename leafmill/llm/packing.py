"""Packing of token sequences: concatenate and cut (operator 13).

All documents form one stream of ids, each closed by an end id; the stream is cut every ``length``
ids, so only the last sequence can be short.  Two passes: the first encodes a document once, stores
its ids with the number of ids before it in its partition, and gives partition totals; prefix sums
over these totals give the place of each document in the stream.  The second cuts at multiples of
``length``.  No row of ids is shuffled for that, and the order is that of the stored partitions, so a
repeated task changes nothing.

Defined cases: null text counts as empty, which is a document of the end id alone; repeated rows are
documents of their own; a null doc_id passes through; other columns are ignored, whatever their
names; an empty table has no pieces.  A text of any length is encoded whole; its ids fill at most
2**29 places, as a binary value of Spark holds 2 GB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm import pieces as P
from leafmill.llm.common import frugal, written

LENGTH, END_ID = 1024, 0

#: Partitions whose offsets may be broadcast (16 bytes each); beyond that they meet by a shuffle.
MAX_BROADCAST = 1_000_000

#: Totals of so many partitions are added up by one task of the first level of the prefix sums.
BLOCK = 1024


def encoded(docs: DataFrame, vocabulary: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table: doc_id, part, before (ids of the part before it), n_tokens, ids (little-endian int32).

    vocabulary: path of a tokenizers file on the driver; its content is broadcast."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    files = docs.sparkSession.sparkContext.broadcast((spec, True, P.ranks(spec)))
    end = np.array([end_id], "<i4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = P.loaded(P.ByteLevel, *files.value)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, texts in P.blocks(batch.column(1), P.BLOCK_BYTES):
                p = P.pieces(texts, coder.whole(texts))
                ids, counts = coder.encode(p).of(p.codes)
                ends = np.append(0, np.cumsum(counts))[p.row_ends]
                n = np.diff(ends, prepend=0) + 1
                closed = np.insert(ids, ends, end).astype("<i4")  # the end id after each document
                borders = np.append(0, np.cumsum(n))
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(borders * 4), pa.py_buffer(closed)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(np.full(len(texts), part)), pa.array(before + borders[:-1]), pa.array(n), blob], ["doc_id", "part", "before", "n_tokens", "ids"]
                )
                before += int(borders[-1])

    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    schema = rows.select("doc_id").schema.add("part", "long").add("before", "long").add("n_tokens", "long").add("ids", "binary")
    return written(rows.mapInArrow(frugal(run), schema), "packed-ids")


def offsets(tokens: DataFrame) -> DataFrame:
    """part, part_start: ids of all parts before each part, by two levels of prefix sums."""
    parts = tokens.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("total")).withColumn("block", F.floor(F.col("part") / BLOCK))
    blocks = parts.groupBy("block").agg(F.sum("total").alias("total"))
    blocks = blocks.select("block", (F.sum("total").over(Window.orderBy("block")) - F.col("total")).alias("from"))
    within = F.sum("total").over(Window.partitionBy("block").orderBy("part")) - F.col("total")
    return written(parts.withColumn("within", within).join(blocks, "block").select("part", (F.col("from") + F.col("within")).alias("part_start")), "packed-offsets")


def placed(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``first``, the place of a document's first id in the stream."""
    starts = offsets(tokens)
    if starts.count() <= MAX_BROADCAST:
        starts = F.broadcast(starts)
    return tokens.join(starts, "part").withColumn("first", F.col("part_start") + F.col("before"))


def cut(stream: DataFrame, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Boundary records of ``placed`` documents, one a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and the ids (little-endian int32) if asked for."""
    size, last = F.lit(length), F.col("first") + F.col("n_tokens")

    def piece(s):
        a, b = F.greatest("first", s * size), F.least(last, (s + 1) * size)
        part = F.substring("ids", (4 * (a - F.col("first")) + 1).cast("int"), (4 * (b - a)).cast("int"))
        known = [(a - F.col("first")).alias("start"), (b - a).alias("length"), F.crc32(part).alias("ids_crc32"), s.alias("sequence_id"), (a - s * size).alias("offset")]
        return F.struct(*known, *[part.alias("ids")] * with_ids)

    # the array is made before it is exploded, so a document's ids are not copied for each of its pieces
    found = F.transform(F.sequence(F.floor(F.col("first") / size), F.floor((last - 1) / size)), piece)
    rows = stream.select("doc_id", F.col("n_tokens").alias("doc_tokens"), found.alias("piece")).select("doc_id", "doc_tokens", F.explode("piece").alias("piece"))
    columns = ["doc_id", "piece.start", "piece.length", "piece.ids_crc32", "doc_tokens", "piece.sequence_id", "piece.offset", *["piece.ids"] * with_ids]
    return rows.select(*columns)


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents; see ``cut``."""
    return cut(placed(encoded(docs, vocabulary, end_id)), length, with_ids)


def sequences(found: DataFrame, length: int = LENGTH, pad_id: int | None = None) -> DataFrame:
    """Training rows from pieces with ids: sequence_id, n_tokens, token_ids, pieces (doc_id, start, offset, length).

    A sequence has at most ``length`` pieces.  With pad_id a short one is filled up to ``length``, unless its size is a power of two."""
    rows = found.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("parts"))
    kind = found.schema["doc_id"].dataType.simpleString()
    plain = rows.select("sequence_id", F.transform("parts", lambda p: p["ids"]).alias("ids"), F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.frombuffer(b"".join(x), "<i4") for x in batch.column(1).to_pylist()]
            sizes = [len(x) for x in made]
            if pad_id is not None:
                made = [np.append(x, np.full(length - len(x), pad_id, "<i4")) if len(x) < length and len(x) & (len(x) - 1) else x for x in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(made, pa.list_(pa.int32())), batch.column(2)], ["sequence_id", "n_tokens", "token_ids", "pieces"])

    return plain.mapInArrow(run, f"sequence_id bigint, n_tokens bigint, token_ids array<int>, pieces array<struct<doc_id: {kind}, start: bigint, offset: bigint, length: bigint>>")
