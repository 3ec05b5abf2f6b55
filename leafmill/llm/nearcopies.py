"""Texts with similar word shingles: SimHash near-duplicates with an exact decision (operator 7, wide bound).

``simhash.near_duplicates`` takes this path when it is asked for a similarity instead of a number of
bits: two texts link where the sets of their five-word shingles (bytes with A-Z folded, hashed with
XXH64) have a Jaccard similarity of 0.8 or more; a class is a connected component of links.  Similar
texts lie up to 13 of 64 bits apart, where keys made of bits are neither whole nor selective, so
candidates come from shared shingles, and fingerprints prune them:

1. Shared shingles.  Every text sends its shingles to their buckets; a shingle that no other text
   has ends there.  A text that shares less than 8/10 of its shingles has no similar text and ends too.
2. Keys.  The shingles of the others are put into one order, those that the fewest texts have first.
   Similar sets share 8/10 of either one, so they share one of the first n - ceil(0.8 n) + 1 of each
   (prefix filtering); the first of these are shingles that no other text has, so few keys are left.
   Shingles that are frequent in a sample come last in the order and are sent to no bucket.
3. Pigeonring filtering.  Rows of one key are searched breadth first: a text is compared only with
   those that nothing has reached yet.  Sizes and places in the order must allow the similarity; of
   two 512-bit SimHash fingerprints a ring of 16 segments must have a segment from which every chain
   of l segments differs in at most l * ``LIMIT`` / 16 bits, then the full distance must be at most ``LIMIT``.
4. Decision.  What is left is decided by the whole sets.  The first search gives a tree of close pairs
   for each key, so a dense group of near copies costs about one pass.  After these have been decided and
   joined to components, keys with several of them are searched once more, up to LIMIT and with sketches of the
   sets: parities differ in at most as many places as the sets have shingles that are not shared, so
   a pair whose sketches differ too much is turned down for certain.  This search gives a tree of components
   too; only where one of its pairs turns out not to be similar all pairs that are left are decided.

Fingerprints of sets with a similarity of just 0.8 lie 78 bits apart with a deviation of 8 (measured for
sets of 8 to 5,000 shingles), so LIMIT, five deviations more, loses about one such pair in ten million.

Defined cases: null text counts as empty; texts without words link to each other only; fewer words than
a shingle give one shingle of the whole sequence; repeated rows stay rows, with equal results; a null doc_id
counts as greater than all others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import dropped, evenly_joined, frugal, released, written
from leafmill.llm.simhash import components

WORDS, SEED = 5, 42
#: Similarity as a fraction, so that all bounds are whole numbers.
UP, DOWN = 4, 5
#: Documents in the sample that shows frequent shingles, and the most that it may list.
SAMPLED, LISTED = 4096, 1 << 17
#: Shingles that one bucket should hold, and rows of a batch that is given out.
BUCKET, EMITTED = 2_000_000, 1 << 18
#: Bits of a fingerprint by segments of the ring; the bound, and what counts as close in the first search.
RING, SEGMENT, LIMIT, CLOSE = 16, 32, 120, 84
#: Prefix sums of a chain are checked up to this length before the full distance.
CHAIN = 8
#: Places of a sketch.
PARITIES = 2048
_U = np.uint64
#: Bits of a hash that are not used: 48 tell the shingles of any two texts apart, and the rest would only be moved.
_LOW = _U(16)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes, ascending, their upper 48 bits; white space and case as in ``simhash.fingerprint``."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    n = len(found) - words + 1
    if n <= 1:
        grams = [line]
    else:
        ends = list(accumulate(map(len, found), lambda a, b: a + b + 1))
        grams = [line[a:b] for a, b in zip([0, *(e + 1 for e in ends[: n - 1])], ends[words - 1 :])]
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(SEED))), ">u8").astype(np.uint64)
    return np.unique(h >> _LOW << _LOW)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DOWN * both >= UP * (len(a) + len(b) - both)


def shared_least(n: np.ndarray | int):
    """Shingles that a set of n must share with a similar one."""
    return -(-UP * n // DOWN)


#: Odd factors that make the words of a fingerprint's hash out of a shingle's hash.
_FACTORS = np.random.RandomState(97).randint(0, 1 << 63, RING * SEGMENT // 64, np.int64).astype(np.uint64) << _U(1) | _U(1)


def fingerprint(found: np.ndarray) -> bytes:
    """The SimHash of a set of hashes, RING * SEGMENT bits."""
    votes = np.zeros(RING * SEGMENT, np.int64)
    for at in range(0, len(found), 1 << 14):  # bounded scratch memory for very long texts
        h = found[at : at + (1 << 14), None] * _FACTORS[None, :]
        h = (h ^ (h >> _U(32))) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
        votes += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(votes * 2 > len(found)).tobytes()


def sketch(found: np.ndarray) -> bytes:
    """The parity of the number of hashes at each of PARITIES places."""
    return np.packbits(np.bincount((found >> _LOW & _U(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1).tobytes()


def ring_filter(u: np.ndarray, others: np.ndarray, limit: int) -> np.ndarray:
    """Which of the fingerprints (rows of RING words) are within ``limit`` bits of u."""
    apart = np.bitwise_count(others ^ u).astype(np.int32)
    sums = np.zeros((len(apart), RING + CHAIN), np.int32)
    np.cumsum(np.concatenate([apart, apart[:, : CHAIN - 1]], axis=1), axis=1, out=sums[:, 1:])
    fits = np.ones((len(apart), RING), bool)
    for length in range(1, CHAIN + 1):
        fits &= sums[:, length : length + RING] - sums[:, :RING] <= length * limit // RING
    near = fits.any(1)
    near[near] = apart[near].sum(1) <= limit
    return near


def frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of three or more texts of a sample, ascending, and their counts; for the order only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t).view(np.int64))], ["h"])

    share = min(1.0, SAMPLED / max(1, n))
    some = docs.where(F.shiftrightunsigned("mark", 32) < int(share * (1 << 32))).select("text")
    counts = some.mapInArrow(frugal(run), "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n >= 3")
    rows = counts.orderBy(F.desc("n"), "h").limit(LISTED).toArrow()
    h, count = rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(h)
    return h[order], count[order]


def listed_of(found: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Counts in the sample of each shingle, 0 for those that are not listed."""
    h, count = known
    if not len(h) or not len(found):
        return np.zeros(len(found), np.int64)
    at = np.minimum(np.searchsorted(h, found), len(h) - 1)
    return np.where(h[at] == found, count[at], 0)


def set_ids(docs: DataFrame, known) -> DataFrame:
    """(doc_id, mark, id, n, n_listed, listed): equal ids for equal sets; listed: the frequent shingles that may be keys,
    in their order.  One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, listed, blobs = [], [], [], []
            for t in batch.column(2).to_pylist():
                found = shingles(t)
                counts = listed_of(found, known.value)
                some = np.flatnonzero(counts)
                first = some[np.argsort(counts[some], kind="stable")][: len(found) - shared_least(len(found)) + 1]
                ids.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                listed.append(len(some))
                blobs.append(found[first].tobytes())
            columns = [batch.column(0), batch.column(1), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(listed, pa.int32()), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "id", "n", "n_listed", "listed"])

    return docs.mapInArrow(frugal(run), "doc_id bigint, mark bigint, id bigint, n int, n_listed int, listed binary")


def _packed(h: np.ndarray, doc: np.ndarray, ids: np.ndarray, df: np.ndarray) -> bytes:
    """Hashes with the sets that have them and how many these are: steps between hashes by byte planes, which compress."""
    steps = np.diff(h, prepend=_U(0)) >> _LOW
    used, doc = np.unique(doc, return_inverse=True)
    parts = [np.array([len(h), len(used)], np.int64), ids[used], doc.astype(np.uint16 if len(used) < 1 << 16 else np.uint32), df.astype(np.uint8)]
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :6].T)
    return b"".join(p.tobytes() for p in (*parts, planes))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, ids and counts."""
    n, k = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    ids = np.frombuffer(blob, np.int64, k, 16)
    kind = np.uint16 if k < 1 << 16 else np.uint32
    at = 16 + 8 * k
    doc = np.frombuffer(blob, kind, n, at)
    at += n * np.dtype(kind).itemsize
    df = np.frombuffer(blob, np.uint8, n, at)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, at + n).reshape(6, -1).T
    return np.cumsum(steps.view(np.uint64)[:, 0] << _LOW, dtype=np.uint64), ids[doc], df


def _deal(known, buckets: int):
    """Rows (bucket, blob): the shingles of a batch that are not listed, with the sets that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, seen = [], set()
            for t in batch.column(0).to_pylist():
                found = shingles(t)
                i = xxhash.xxh64_intdigest(found.tobytes(), SEED)
                if i not in seen:
                    seen.add(i)
                    sets.append((i, found[listed_of(found, known.value) == 0]))
            if not sets:
                continue
            ids = np.array([i for i, _ in sets], np.uint64).view(np.int64)
            h = np.concatenate([f for _, f in sets])
            doc = np.repeat(np.arange(len(sets)), [len(f) for _, f in sets])
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            bucket = ((h >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            where = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            blobs = [_packed(h[cuts[b] : cuts[b + 1]], doc[cuts[b] : cuts[b + 1]], ids, np.zeros(cuts[b + 1] - cuts[b])) for b in where]
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


def _met(parts: int):
    """Rows (part, blob): the shingles of a bucket that several sets have, dealt by set, with how many these are (255: or more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpacked(blob.as_py())[:2] for batch in batches for blob in batch.column(1)]
        if not held:
            return
        h, ids = (np.concatenate(c) for c in zip(*held))
        del held
        order = np.lexsort((ids, h))
        h, ids = h[order], ids[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])  # one set may come in several batches
        h, ids = h[new], ids[new]
        if not len(h):
            return
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(h)]]))
        df = np.minimum(np.repeat(sizes, sizes), 255)
        many = df > 1
        h, ids, df = h[many], ids[many], df[many]
        part = ids % parts
        order = np.argsort(part, kind="stable")  # hashes stay ascending within a part
        h, ids, df, part = h[order], ids[order], df[order], part[order]
        cuts = np.searchsorted(part, np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[p], cuts[p + 1]
            used, doc = np.unique(ids[a:b], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([_packed(h[a:b], doc, used, df[a:b])], pa.binary())], ["part", "blob"])

    return run


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, int, int]]:
    """(columns, from, to) for each key, in a stream sorted by its first column."""
    open_: list[pa.RecordBatch] = []
    last = None

    def closed(parts: list[pa.RecordBatch]) -> Iterator[tuple[list, int, int]]:
        table = pa.Table.from_batches(parts).combine_chunks()
        columns = [c.combine_chunks() for c in table.columns]
        keys = columns[0].to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield columns, int(a), int(b)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        at = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
        if open_ and (at or last != keys[0]):
            yield from closed([*open_, batch.slice(0, at)])
            open_ = []
        elif at:
            yield from closed([batch.slice(0, at)])
        open_.append(batch.slice(at))
        last = keys[-1]
    if open_:
        yield from closed(open_)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, size, place) from rows (part, blob, id, n, n_listed, listed): sets, and blobs of their shared shingles."""
    heads: list[pa.RecordBatch] = []
    held = []
    for batch in batches:
        is_head = pc.is_null(batch.column(1))
        held += [_unpacked(b.as_py()) for b in batch.column(1).filter(pc.invert(is_head))]
        heads.append(batch.filter(is_head).select(["id", "n", "n_listed", "listed"]))
    heads = pa.Table.from_batches(heads).combine_chunks() if heads else None
    if heads is None or not heads.num_rows:
        return
    h, ids, df = (np.concatenate(c) for c in zip(*held)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8))
    del held
    order = np.lexsort((h, df, ids))
    h, ids = h[order], ids[order]
    mine, size, common = (heads[c].to_numpy() for c in ("id", "n", "n_listed"))
    at, to = np.searchsorted(ids, mine), np.searchsorted(ids, mine, "right")
    alone = size - common - (to - at)  # shingles that no other set has come first in the order
    wanted = size - shared_least(size) + 1 - alone
    out: list[tuple[np.ndarray, int, int, int]] = []
    n = 0

    def batch_of() -> pa.RecordBatch:
        lengths = [len(k) for k, *_ in out]
        place = np.concatenate([np.arange(u, u + len(k)) for k, _, _, u in out]).astype(np.int32)
        columns = [np.concatenate([k for k, *_ in out]).view(np.int64), np.repeat(np.array([i for _, i, _, _ in out], np.int64), lengths), np.repeat(np.array([s for _, _, s, _ in out], np.int32), lengths), place]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", "size", "place"])

    for k in np.flatnonzero((size > 0) & (wanted > 0)):
        keys = h[at[k] : to[k]][: wanted[k]]
        if len(keys) < wanted[k]:
            keys = np.concatenate([keys, np.frombuffer(heads["listed"][int(k)].as_py(), np.uint64)[: wanted[k] - len(keys)]])
        if len(keys):
            out.append((keys, mine[k], size[k], alone[k]))
            n += len(keys)
        if n >= EMITTED:
            yield batch_of()
            out, n = [], 0
    if out:
        yield batch_of()


def prefix_keys(docs: DataFrame, sets: DataFrame, known) -> DataFrame:
    """(key, id, size, place) of the sets that may have a similar one."""
    spark = docs.sparkSession
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    dealt = docs.select("text").mapInArrow(frugal(_deal(known, buckets)), "bucket int, blob binary").repartition(buckets, "bucket")
    shared = dealt.mapInArrow(frugal(_met(buckets)), "part int, blob binary")
    none = {"id": F.lit(None).cast("bigint"), "n": F.lit(None).cast("int"), "n_listed": F.lit(None).cast("int"), "listed": F.lit(None).cast("binary")}
    heads = sets.select(F.pmod("id", F.lit(buckets)).cast("int").alias("part"), F.lit(None).cast("binary").alias("blob"), "id", "n", "n_listed", "listed")
    rows = shared.withColumns(none).unionByName(heads)
    return rows.repartition(buckets, "part").mapInArrow(frugal(_keys), "key bigint, id bigint, size int, place int")


def whole_sets(docs: DataFrame, sets: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, fp, sketch, hashes) of the sets that have keys, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([made(f) for f in found], pa.binary()) for made in (fingerprint, sketch, np.ndarray.tobytes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "fp", "sketch", "hashes"])

    named = keys.select("id").distinct()
    one = sets.join(named, "id", "left_semi").groupBy("id").agg(F.min("mark").alias("mark"))
    texts = docs.join(one, "mark").select("id", "text")
    return texts.mapInArrow(frugal(run), "id bigint, fp binary, sketch binary, hashes binary").dropDuplicates(["id"])


def possible(size: np.ndarray, place: np.ndarray, i: int, j: np.ndarray) -> np.ndarray:
    """Whether sizes and places of the pairs (i, j) of a group allow the similarity.

    It holds for similar pairs at the first shingle of the order that they share."""
    a, b = int(size[i]), size[j].astype(np.int64)
    most = np.minimum(a - int(place[i]), b - place[j])
    return (DOWN * np.minimum(a, b) >= UP * np.maximum(a, b)) & ((UP + DOWN) * most >= UP * (a + b))


def _pair_rows(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(c) for c in zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def tree_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): for rows (key, id, size, place, fp), close pairs that join each key's rows to trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for columns, at, to in groups(batches):
            if to - at < 2:
                continue
            ids, size, place, fps = _group(columns, at, to)
            rest = np.arange(len(ids))
            while len(rest) > 1:
                queue, rest = [rest[0]], rest[1:]
                while queue and len(rest):
                    u = queue.pop()
                    near = possible(size, place, u, rest)
                    near[near] = ring_filter(fps[u], fps[rest[near]], CLOSE)
                    if near.any():
                        found = rest[near]
                        out.append((np.full(len(found), ids[u]), ids[found]))
                        held += len(found)
                        queue.extend(found)
                        rest = rest[~near]
            if held >= EMITTED:
                yield _pair_rows(out)
                out, held = [], 0
        if out:
            yield _pair_rows(out)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(frugal(run), "a bigint, b bigint").distinct()


def _group(columns: list, at: int, to: int) -> tuple[np.ndarray, ...]:
    """Ids, sizes, places and fingerprints of a group, and then its roots and sketches if it has them, by id; so trees
    of groups with the same rows are alike."""
    part = [c.slice(at, to - at) for c in columns[1:]]
    ids = part[0].to_numpy(zero_copy_only=False)
    order = np.argsort(ids)
    size, place, *root = (part[k].to_numpy(zero_copy_only=False)[order] for k in (1, 2, 4)[: 3 if len(part) > 4 else 2])
    words = [np.frombuffer(b"".join(part[k].to_pylist()), np.uint32).reshape(to - at, -1)[order] for k in (3, 5)[: 2 if len(part) > 5 else 1]]
    return ids[order], size, place, words[0], *root, *words[1:]


def other_pairs(rows: DataFrame, tree: bool) -> DataFrame:
    """(a, b): for rows (key, id, size, place, fp, root, sketch), pairs of one key and two roots that sizes, places,
    fingerprints and sketches allow: all of them, or of each key a tree that joins its roots."""

    def fits(u: int, others: np.ndarray, size, place, fps, marks) -> np.ndarray:
        near = others[possible(size, place, u, others)]
        near = near[ring_filter(fps[u], fps[near], LIMIT)] if len(near) else near
        apart = np.bitwise_count(marks[near] ^ marks[u]).sum(1, dtype=np.int64)
        return near[(UP + DOWN) * apart <= (DOWN - UP) * (int(size[u]) + size[near].astype(np.int64))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, at, to in groups(batches):
            ids, size, place, fps, root, marks = _group(columns, at, to)
            out = []
            if not tree:
                for x in range(len(ids) - 1):
                    y = np.arange(x + 1, len(ids))
                    y = fits(x, y[root[y] != root[x]], size, place, fps, marks)
                    if len(y):
                        out.append((np.full(len(y), ids[x]), ids[y]))
            else:
                rest = np.arange(len(ids))
                while len(rest):
                    own = root[rest] == root[rest[0]]
                    queue, rest = list(rest[own]), rest[~own]
                    while queue and len(rest):
                        u = queue.pop()
                        near = fits(u, rest, size, place, fps, marks)
                        if len(near):
                            reached, first = np.unique(root[near], return_index=True)  # one pair for each component
                            out.append((np.full(len(first), ids[u]), ids[near[first]]))
                            own = np.isin(root[rest], reached)
                            queue.extend(rest[own])
                            rest = rest[~own]
            if out:
                yield _pair_rows(out)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(frugal(run), "a bigint, b bigint").distinct()


def decided(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    both = evenly_joined(evenly_joined(pairs, left, "a"), right, "b").select("a", "b", "x", "y")
    return written(both.mapInArrow(frugal(run), "a bigint, b bigint"), "similar")


def near_copies(df: DataFrame) -> DataFrame:
    """(doc_id, component_id) for every row of ``df(doc_id, text)``; component_id is the
    least doc_id of the texts reachable over links, the own one included."""
    spark = df.sparkSession
    docs = df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    known = spark.sparkContext.broadcast(frequent(docs, docs.count()))
    sets = written(set_ids(docs, known), "sets")
    heads = sets.dropDuplicates(["id"])
    keys = written(prefix_keys(docs, heads, known), "keys")
    released(spark)
    wholes = written(whole_sets(docs, sets, keys), "whole-sets")
    pairs = written(tree_pairs(keys.join(wholes.select("id", "fp"), "id").select("key", "id", "size", "place", "fp")), "pairs")
    made = [sets, keys, wholes, pairs]
    links = decided(pairs, wholes)
    roots = components(links)
    for tree in (True, False):
        # keys whose rows are not all of one component yet
        rooted = keys.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "size", "place", F.coalesce("root", "id").alias("root"))
        split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        rest = rooted.join(split, "key", "left_semi").join(wholes.select("id", "fp", "sketch"), "id").select("key", "id", "size", "place", "fp", "root", "sketch")
        others = written(other_pairs(rest, tree), "pairs")
        more = decided(others, wholes)
        made += [links, roots, others, more]
        n, good = others.count(), more.count()
        if good:
            links = written(links.union(more), "links")
            roots = components(links)
        if n == good:  # all that could be joined is joined
            break
    ids = written(sets.groupBy("id").agg(F.min("doc_id").alias("least"), F.count("*").alias("count")).join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "least", "count", F.coalesce("root", "id").alias("root")), "classes")
    label = evenly_joined(ids.select("id", "root"), ids.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("id", "component_id")
    out = written(evenly_joined(sets.select("doc_id", "id"), label, "id", ids.select("id", "count")).select("doc_id", "component_id"), "near-copies")
    dropped(*made, links, roots, ids)
    released(spark)
    return out
