"""Removal of repeated byte strings by a distributed suffix sort (operator 6).

Every byte covered by a ``SPAN``-byte string that also starts earlier (smaller
doc_id, or earlier in the same document) is removed.

1. Anchors.  Of the ``GRAM``-byte strings inside each window of SPAN bytes, the one
   with the least hash (leftmost of equals) is the window's anchor.  Equal windows
   have equal anchors at the same place, and an anchor serves about 35 windows.
   A batch sends each hash once; hashes met twice are seeds, all other anchors
   cannot lie in a repeated window and end here.
2. Suffixes.  Each seed is a suffix of its document, kept to the depth that its
   windows need, with as many bytes before it.  Sampled splitters deal the suffixes
   by their leading bytes, then by place, so that one frequent beginning spreads
   over many buckets.
3. Buckets.  A bucket sorts its suffixes by multikey quicksort (keys of eight bytes; what
   equals the pivot goes on with the next key) and its reversed left contexts likewise,
   both with common-prefix lengths.  Two windows at the same offset from their
   anchors are equal if both lengths reach far enough; the earliest stays.
4. Boundaries.  The first and last beginning of a bucket may go on in its
   neighbours: the windows that stayed there are compared once more across buckets, by
   160-bit digests.

Within a bucket all compared strings are real bytes; hashes only choose the anchors.

Defined cases: null text counts as empty; documents shorter than SPAN lose nothing;
rows with equal doc_id and equal text are one document, which is searched once (each row
gets its result); equal doc_id with different texts are different documents, ordered by a
hash of the text; a null doc_id comes before all others; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import dropped, released, written

SPAN, GRAM = 100, 32
PLACES = SPAN - GRAM + 1  # of a gram in a window
LEFT = SPAN - GRAM
WIDTH = LEFT + SPAN
#: Text is turned into arrays in slices of so many bytes; longer documents overlap.
SLICE = 1 << 20
#: Suffixes that one bucket should hold, and bytes of text whose anchors one bucket should hold.
BUCKET, MEETING = 150_000, 64 << 20
#: Groups of the sort up to this size are finished by comparisons.
LEAF = 256
_U = np.uint64


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position, by doubling."""
    rnd = np.random.RandomState(20240229)
    h = rnd.randint(0, 1 << 63, 256, np.int64).astype(np.uint64)[data]
    step = 1
    while step < GRAM:
        h = h[:-step] * _U(0x9E3779B97F4A7C15) + (h[step:] ^ (h[step:] >> _U(29)))
        h ^= h >> _U(31)
        step *= 2
    return h


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of joined documents: (position, hash, least and largest offset of the windows served)."""
    if len(data) < SPAN:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    h = gram_hashes(data)
    low = _U((1 << 24) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= PLACES:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < PLACES:
        m = np.minimum(m[: len(m) - (PLACES - size)], m[PLACES - size :])
    # m[s]: hash and place of the anchor of the window from s
    whole = np.zeros(len(m) + 1, np.int64)
    last = ends - SPAN  # last window of each document
    ok = last >= starts
    np.add.at(whole, starts[ok], 1)
    np.add.at(whole, last[ok] + 1, -1)
    s = np.flatnonzero(np.cumsum(whole)[:-1])
    p = (m[s] & low).astype(np.int64)
    cut = np.flatnonzero((np.diff(p) != 0) | (np.diff(s) != 1)) + 1
    first, final = np.concatenate([[0], cut]), np.concatenate([cut, [len(p)]]) - 1
    if not len(p):
        first = final = np.zeros(0, np.int64)
    at = p[first]
    return at, h[at], at - s[final], at - s[first]


def slices(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined bytes, starts, ends, index of the document and its bytes before the piece."""
    parts: list[bytes] = []
    meta: list[tuple[int, int]] = []
    size = 0

    def full():
        lens = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(lens)
        m = np.array(meta, np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), ends - lens, ends, m[:, 0], m[:, 1]

    for i, t in enumerate(texts):
        for base in range(0, max(1, len(t) - SPAN + 1), SLICE):
            piece = t[base : base + SLICE + SPAN - 1]
            parts.append(piece)
            meta.append((i, base))
            size += len(piece)
            if size >= SLICE:
                yield full()
                parts, meta, size = [], [], 0
    if parts:
        yield full()


_SEED = pa.schema([("doc_id", pa.int64()), ("tie", pa.int32()), ("pos", pa.int64()), ("low", pa.int8()), ("high", pa.int8())])


#: Columns of a blob: hash, doc_id, whether it is null, tie, position, came again, least and largest offset.
_KINDS = ("<u8", "<i8", "u1", "<i4", "<i8", "u1", "i1", "i1")


def tie(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def whole(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", tie(F.col("text")))


def _deal(n: int):
    """Rows: seeds known at once (bucket null), and anchors for their bucket, as columns in one blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            absent = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ties = batch.column(2).to_numpy(zero_copy_only=False)
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            found = []
            for data, starts, ends, doc, base in slices(texts):
                at, h, low, high = anchors(data, starts, ends)
                of = np.searchsorted(ends, at, "right")
                found.append((h, doc[of], at - starts[of] + base[of], low, high))
            if not found:
                continue
            h, doc, pos, low, high = (np.concatenate(x) for x in zip(*found))
            # anchors have the least hashes of their windows: mixed again, they fill all buckets
            h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
            h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
            order = np.argsort(h, kind="stable")
            hs = h[order]
            new = np.ones(len(hs), bool)
            new[1:] = hs[1:] != hs[:-1]
            many = np.zeros(len(hs), bool)  # on the first of a hash: it came again
            many[:-1] = new[:-1] & ~new[1:]
            again, head = order[~new], order[new]
            blobs, where = [], []

            def packed(k: np.ndarray, flag: np.ndarray) -> bytes:
                d = doc[k]
                columns = zip((h[k], ids[d], absent[d], ties[d], pos[k], flag, low[k], high[k]), _KINDS)
                return np.int64(len(k)).tobytes() + b"".join(c.astype(kind).tobytes() for c, kind in columns)

            bucket = ((h[head] >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange(n + 1))
            flags = many[new]
            for b in range(n):
                x, y = cuts[b], cuts[b + 1]
                if x < y:
                    k = head[x:y]
                    by_doc = np.lexsort((pos[k], doc[k]))
                    blobs.append(packed(k[by_doc], flags[x:y][by_doc]))
                    where.append(b)
            for a in range(0, len(again), 4096):  # seeds already: dealt evenly, no bucket needs them
                k = again[a : a + 4096]
                blobs.append(packed(k, np.ones(len(k))))
                where.append(-1 - (int(ids[0]) + a // 4096 * 61) % n)
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


def _columns(blob: bytes) -> tuple[np.ndarray, ...]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    out, at = [], 8
    for kind in _KINDS:
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return tuple(out)


def _seed_batch(cols: tuple[np.ndarray, ...], keep: np.ndarray) -> Iterator[pa.RecordBatch]:
    _, ids, absent, ties, pos, _, low, high = cols
    where = np.flatnonzero(keep)
    for a in range(0, len(where), 50_000):
        k = where[a : a + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[k], mask=absent[k].astype(bool)), pa.array(ties[k]), pa.array(pos[k]), pa.array(low[k]), pa.array(high[k])], schema=_SEED)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the anchors of a bucket, those whose hash came more than once."""
    held = []
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            cols = _columns(blob.as_py())
            if bucket < 0:
                yield from _seed_batch(cols, np.ones(len(cols[0]), bool))
            else:
                held.append(cols)
    if held:
        cols = tuple(np.concatenate(x) for x in zip(*held))
        del held
        order = np.argsort(cols[0])
        hs, many = cols[0][order], cols[5][order].astype(bool)
        same = np.zeros(len(hs), bool)
        same[1:] = hs[1:] == hs[:-1]
        same[:-1] |= same[1:]
        keep = np.zeros(len(hs), bool)
        keep[order] = same | many
        yield from _seed_batch(cols, keep)


def seeds(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, pos, low, high): the anchors that came more than once."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << 14, 2 * -(-total // (2 * MEETING))))
    dealt = docs.select("doc_id", "text", "tie").mapInArrow(_deal(n), "bucket int, blob binary").repartition(n // 2, "bucket")
    return dealt.mapInArrow(_meet, "doc_id bigint, tie int, pos bigint, low tinyint, high tinyint")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of suffixes, from rows (doc_id, tie, text, list of seeds)."""
    column = np.arange(WIDTH)
    for batch in batches:
        for r in range(batch.num_rows):
            data = np.frombuffer(batch.column(2)[r].as_py().encode(), np.uint8)
            padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(SPAN, np.uint8)])
            at = batch.column(3)[r].values
            pos = at.field("pos").to_numpy()
            for a in range(0, len(pos), 20_000):
                p = pos[a : a + 20_000]
                low, high = (at.field(c).slice(a, len(p)) for c in ("low", "high"))
                rows = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[p]
                # bytes that no window of the anchor reaches are blanked, which compresses well
                reach = (column >= LEFT - high.to_numpy().astype(int)[:, None]) & (column < WIDTH - low.to_numpy().astype(int)[:, None])
                flat = pa.py_buffer(np.where(reach, rows, np.uint8(0)).tobytes())
                ctx = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), len(p), [None, flat]).cast(pa.binary())
                ids = pa.array([batch.column(0)[r].as_py()] * len(p), pa.int64())
                ties = pa.array(np.full(len(p), batch.column(1)[r].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays([ids, ties, pa.array(p), low, high, ctx], ["doc_id", "tie", "pos", "low", "high", "ctx"])


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings of one width, and the common-prefix length of each with the one before.

    Multikey quicksort over keys of eight bytes: a group is parted by a pivot into strings with a
    smaller key, with the same one, which go on with their next key, and with a greater one; small
    groups are finished by whole comparisons.  It is stable.
    """
    n, width = rows.shape
    steps = -(-width // 8)
    padded = np.zeros((n, steps * 8), np.uint8)
    padded[:, :width] = rows
    keys = padded.view(">u8").astype(np.uint64)
    whole = padded.view(f"S{steps * 8}")[:, 0]
    order = np.arange(n)
    todo = [(0, n, 0)]
    while todo:
        a, b, c = todo.pop()
        if b - a < 2 or c == steps:
            continue
        part = order[a:b]
        if b - a <= LEAF:
            order[a:b] = part[np.argsort(whole[part], kind="stable")]
            continue
        k = keys[part, c]
        pivot = np.sort(k[:: max(1, (b - a) // 9)])[4]
        less, same = k < pivot, k == pivot
        x = a + np.count_nonzero(less)
        y = x + np.count_nonzero(same)
        order[a:b] = np.concatenate([part[less], part[same], part[~(less | same)]])
        todo += [(a, x, c), (x, y, c + 1), (y, b, c)]
    lcp = np.zeros(n, np.int64)
    for at in range(1, n, 1 << 16):
        here = order[at : at + (1 << 16)]
        apart = keys[here] ^ keys[order[at - 1 : at - 1 + len(here)]]
        first = (apart != 0).argmax(1)
        key = np.take_along_axis(apart, first[:, None], 1).astype(">u8").view(np.uint8)
        lcp[at : at + len(here)] = np.where(key.any(1), np.minimum(width, 8 * first + (key != 0).argmax(1)), width)
    return order, lcp


def repeated(ctx: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ctx in the order of (document, position).  dup[i, o]: the window that starts o
    bytes before anchor i equals that of an earlier row; edge[i]: the row has the
    first or last beginning of the bucket."""
    n = len(ctx)
    order, lcp = multikey_sort(ctx[:, LEFT:])
    back_order, back_lcp = multikey_sort(ctx[:, :LEFT][:, ::-1])
    bits = max(1, int(n - 1).bit_length())
    dup = np.zeros((n, PLACES), bool)
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(PLACES):
        i = np.flatnonzero((low <= o) & (o <= high))
        if not len(i):
            continue
        right[order] = np.cumsum(lcp < SPAN - o)
        left[back_order] = np.cumsum(back_lcp < o) if o else 0
        r, l = right[i] - 1, np.maximum(left[i] - 1, 0)
        if 3 * bits <= 63:  # class and row in one number
            v = np.sort(r << (2 * bits) | l << bits | i)
            same = (v[1:] >> bits) == (v[:-1] >> bits)
            dup[v[1:][same] & ((1 << bits) - 1), o] = True
        else:
            by = np.lexsort((i, l, r))
            same = (r[by[1:]] == r[by[:-1]]) & (l[by[1:]] == l[by[:-1]])
            dup[i[by[1:]][same], o] = True
    begins = np.empty(n, np.int64)
    begins[order] = np.cumsum(lcp < GRAM)
    return dup, (begins == 1) | (begins == begins.max()) if n else np.zeros(0, bool)


_MARK = pa.schema([("doc_id", pa.int64()), ("tie", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("window", pa.binary())])


def _sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    absent = table["doc_id"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
    ids = table["doc_id"].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
    ties, pos, low, high = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("tie", "pos", "low", "high"))
    ctx = np.frombuffer(b"".join(b for c in table["ctx"].chunks for b in c.to_pylist()), np.uint8).reshape(-1, WIDTH)
    del table, batches
    order = np.lexsort((low, pos, ties, ids, ~absent))
    absent, ids, ties, pos, low, high, ctx = (x[order] for x in (absent, ids, ties, pos, low, high, ctx))
    again = np.ones(len(ids), bool)  # rows of one document that came more than once
    for x in (absent, ids, ties, pos, low, high):
        again[1:] &= x[1:] == x[:-1]
    again[:1] = False
    if again.any():
        absent, ids, ties, pos, low, high, ctx = (x[~again] for x in (absent, ids, ties, pos, low, high, ctx))
    dup, edge = repeated(ctx, low, high)
    # runs of repeated windows of one anchor, as byte ranges
    grown = np.zeros((len(ctx), PLACES + 2), np.int8)
    grown[:, 1:-1] = dup
    turn = np.diff(grown, axis=1)
    i, o = np.nonzero(turn == 1)
    _, e = np.nonzero(turn == -1)
    for a in range(0, len(i), 50_000):
        k, first, last = i[a : a + 50_000], o[a : a + 50_000], e[a : a + 50_000] - 1
        yield pa.RecordBatch.from_arrays([pa.array(ids[k], mask=absent[k]), pa.array(ties[k]), pa.array(pos[k] - last), pa.array(pos[k] - first + SPAN), pa.nulls(len(k), pa.binary())], schema=_MARK)
    # what stayed at the edges of the bucket is compared with other buckets
    places = np.arange(PLACES)
    i, o = np.nonzero(~dup & edge[:, None] & (low[:, None] <= places) & (places <= high[:, None]))
    for a in range(0, len(i), 20_000):
        k, off = i[a : a + 20_000], o[a : a + 20_000]
        windows = [hashlib.blake2b(ctx[x, LEFT - y : LEFT - y + SPAN].tobytes(), digest_size=20).digest() for x, y in zip(k, off)]
        start = pos[k] - off
        yield pa.RecordBatch.from_arrays([pa.array(ids[k], mask=absent[k]), pa.array(ties[k]), pa.array(start), pa.array(start + SPAN), pa.array(windows, pa.binary())], schema=_MARK)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, start, end): byte ranges to remove; they may overlap."""
    spark = docs.sparkSession
    if not docs.groupBy("doc_id", "tie").count().where("count > 1").isEmpty():
        docs = docs.dropDuplicates(["doc_id", "tie"])
    found = written(seeds(docs), "seeds")
    released(spark)
    per_doc = found.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("pos", "low", "high")).alias("at"))
    joined = docs.alias("d").join(per_doc.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.tie") == F.col("s.tie"))).select("d.doc_id", "d.tie", "d.text", "s.at")
    suffixes = written(joined.mapInArrow(_contexts, "doc_id bigint, tie int, pos bigint, low tinyint, high tinyint, ctx binary"), "suffixes")
    dropped(found)
    released(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes.count() // BUCKET))
    marks = written(suffixes.repartitionByRange(n, F.substring("ctx", LEFT + 1, GRAM), "doc_id", "tie", "pos").mapInArrow(_sort_bucket, "doc_id bigint, tie int, start bigint, end bigint, window binary"), "marks")
    dropped(suffixes)
    released(spark)
    edge = marks.where("window IS NOT NULL")
    place = F.struct(F.col("doc_id"), F.col("tie"), F.col("start"))
    first = edge.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("window", "first")
    later = edge.join(first, "window").where(place != F.col("first")).select("doc_id", "tie", "start", "end")
    return marks.where("window IS NULL").select("doc_id", "tie", "start", "end").union(later)


_OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string, kept binary"


def _cut(with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            rows = []
            for doc_id, text, ranges in zip(*(batch.column(c).to_pylist() for c in range(3))):
                data = text.encode()
                merged: list[list[int]] = []
                for r in sorted((r["start"], r["end"]) for r in ranges or ()):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append([*r])
                at, kept = 0, []
                for a, b in merged:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                rows.append((doc_id, len(data), len(data) - len(rest), [{"start": a, "end": b} for a, b in merged], hashlib.sha256(rest).hexdigest(), rest if with_kept else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.list_(span), pa.string(), pa.binary()))], ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])

    return run


def remove_repeats(df: DataFrame, with_kept: bool = False) -> DataFrame:
    """For every row of ``df(doc_id, text)``: byte counts, the removed spans and the
    digest of what is left (and these bytes, if asked for)."""
    docs = whole(df)
    ranges = repeated_ranges(docs).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    joined = docs.alias("d").join(ranges.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.tie") == F.col("r.tie")), "left")
    return joined.select("d.doc_id", "d.text", "r.ranges").mapInArrow(_cut(with_kept), _OUT)
