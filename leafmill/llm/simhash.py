"""SimHash near-duplicate classes by pigeonring filtering (operator 7).

Fingerprints: 64 bits over word shingles hashed with XXH64.  Two fingerprints link
at ``BITS`` (4) or fewer differing bits; a class is a connected component of links.

Candidates: the 64 bits form a ring of 16 segments of four bits.  By the pigeonring
principle, a pair within 4 bits has a segment from which *every* chain of l
consecutive segments differs in at most l * 4 / 16 bits.  So the first three
segments of that chain agree, and the first seven differ in at most one bit, which
lies in one of the segments four to seven.  A key is therefore (start, the segment
left out, the other six of the seven segments): 64 keys of 24 bits a fingerprint, of
which every linked pair shares one.  From ``MANY`` fingerprints on the chain of eleven is
used alike, for keys of 36 bits.  Rows of one key are then searched breadth
first: a fingerprint is compared only with those that nothing has reached yet,
first by the chain budgets of longer chains, then by the full Hamming distance.
So a dense group of near copies costs little more than one pass over it and gives
one edge for each member, never all pairs; no link between classes is lost.

Equal fingerprints are collapsed before any of this.  Components come from
alternating star contraction; every round is written to the shared folder.

Defined cases: null text counts as empty; a text without words has fingerprint
zero and links like any other; fewer words than a shingle give one shingle of the
whole sequence; repeated rows stay rows, with equal results; null doc_ids count as
greater than all others, and a class of them alone has a null component_id; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import dropped, evenly_joined, written

WORDS, BITS, SEED = 4, 4, 42
SEGMENTS, WIDTH, CHAIN, LONG_CHAIN = 16, 4, 7, 11
#: From so many distinct fingerprints on (two a key of 24 bits) keys are longer.
MANY = 1 << 25
_ALL = (1 << 64) - 1


def rotated(mask: int, by: int) -> int:
    return ((mask << by) | (mask >> (64 - by))) & _ALL if by else mask


def chain_mask(start: int, length: int) -> int:
    """The bits of ``length`` consecutive segments from segment ``start`` on the ring."""
    mask = 0
    for k in range(length):
        mask |= ((1 << WIDTH) - 1) << (((start + k) % SEGMENTS) * WIDTH)
    return mask


#: Longer chains that are checked before the full distance: (length, budget).
LONGER = [(8, 2), (11, 2), (12, 3), (15, 3)]


def fingerprint(text: str | None, words: int = WORDS, digest=xxhash.xxh64_digest) -> int:
    """bytes.lower() and bytes.split() treat just A-Z and [\\x20\\x09-\\x0D]."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    n = len(found) - words + 1
    if n <= 1:
        grams = [line]
    else:
        ends = list(accumulate(map(len, found), lambda a, b: a + b + 1))
        grams = [line[a:b] for a, b in zip([0, *(e + 1 for e in ends[: n - 1])], ends[words - 1 :])]
    packed = np.frombuffer(b"".join(map(digest, grams, repeat(SEED))), np.uint8)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(packed), 8 << 14):  # bounded scratch memory for very long texts
        votes += np.unpackbits(packed[at : at + (8 << 14)].reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(grams)).tobytes(), "big")


def fingerprints(df: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long.  One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


def left_out(long: bool) -> list[tuple[int, ...]]:
    """Segments after the start that a key leaves out, as places in its chain.

    Three segments agree, and a chain of seven differs in at most one bit: one of the places 3 to 6 is left
    out.  A chain of eleven differs in at most two bits, at most one of them in its first seven segments."""
    if not long:
        return [(k,) for k in range(3, CHAIN)]
    return [(a, b) for a in range(3, LONG_CHAIN) for b in range(max(a + 1, CHAIN), LONG_CHAIN)]


def ring_keys(fps: DataFrame, long: bool = False) -> DataFrame:
    """(key, fp): the keys of each distinct fingerprint, made without Python: 64 of 24 bits, or, where so many rows
    share 24 bits that groups would be large, 352 of 36 bits.  Both meet all linked pairs."""
    keys, number = [], 0
    for start in range(SEGMENTS):
        for places in left_out(long):
            mask = chain_mask(start, LONG_CHAIN if long else CHAIN)
            for k in places:
                mask &= ~chain_mask((start + k) % SEGMENTS, 1)
            signed = mask - (1 << 64) if mask >> 63 else mask
            number += 1
            # The masked bits and the number of the key, mixed to one long.  A chance
            # collision only adds a candidate that the distance check turns down.
            keys.append(F.xxhash64(F.col("fp").bitwiseAND(F.lit(signed)), F.lit(number)).bitwiseAND(F.lit(~15)).bitwiseOR(F.lit(start)))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def search(fps: np.ndarray, start: int, bits: int = BITS) -> list[tuple[int, int]]:
    """Edges that join the fingerprints of one key into their components."""
    masks = [(np.uint64(chain_mask(start, length)), budget) for length, budget in LONGER] if bits == BITS else []
    rest, edges = np.unique(fps), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            x = rest ^ u
            near = np.ones(len(rest), bool)
            for mask, budget in masks:
                near &= np.bitwise_count(x & mask) <= budget
            near[near] = np.bitwise_count(x[near]) <= bits
            if near.any():
                found = rest[near]
                edges += [(int(u), int(v)) for v in found]
                queue.extend(found)
                rest = rest[~near]
    return edges


def link_edges(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): edges between distinct fingerprints whose components are those of all links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges_of(keys: np.ndarray, values: np.ndarray) -> list[tuple[int, int]]:
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            out = []
            for k in np.flatnonzero(ends - starts > 1):
                a, b = starts[k], ends[k]
                if b - a == 2:
                    if int(values[a] ^ values[a + 1]).bit_count() <= bits:
                        out.append((int(values[a]), int(values[a + 1])))
                else:
                    out += search(values[a:b], int(keys[a]) & 15, bits)
            return out

        def batch_of(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            e = np.array(edges, np.uint64).view(np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

        open_: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the last key, which may go on in the next batch
        for batch in batches:
            k, v = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1]))
            if last or (open_ and open_[0][0][0] != k[0]):
                done = [*open_, (k[:last], v[:last])]
                open_ = []
                if edges := edges_of(*(np.concatenate(c) for c in zip(*done))):
                    yield batch_of(edges)
            open_.append((k[last:], v[last:]))
        if open_ and (edges := edges_of(*(np.concatenate(c) for c in zip(*open_)))):
            yield batch_of(edges)

    dealt = ring_keys(fps, long=fps.count() >= MANY).select("key", "fp").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge, root being the least node reachable.

    Alternating star contraction: each round hangs every node's larger neighbours,
    then its smaller ones, on the least node of the neighbourhood, until nothing
    changes.  Only counts reach the driver.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def directed(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()

    now = written(directed(edges), "edges")
    before = state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = written(directed(small), "edges")
        after = state(new)
        dropped(now)
        now, (before, same) = new, (after, after == before)
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(df: DataFrame, words: int = WORDS, bits: int = BITS, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``df(doc_id, text)``.

    component_id is the least doc_id of the documents whose fingerprints are
    reachable over links, the own one included.

    With a similarity texts link where the sets of their shingles are that similar; fingerprints then
    only prune candidates (see ``nearcopies``, made for five words and 0.8), and there is no column fp.
    """
    if similarity is not None:
        from leafmill.llm import nearcopies

        if (words, similarity) != (nearcopies.WORDS, nearcopies.UP / nearcopies.DOWN):
            raise ValueError(f"a similarity means {nearcopies.WORDS} words and {nearcopies.UP / nearcopies.DOWN}")
        return nearcopies.near_copies(df)
    if not 0 <= bits <= BITS:
        raise ValueError(f"the segment budgets hold for at most {BITS} bits")
    fps = written(fingerprints(df, words), "fingerprints")
    of_fp = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("count")), "nodes")
    roots = components(link_edges(of_fp.select("fp"), bits))
    # a frequent fingerprint, or a class of many, meets its label by broadcast
    grouped = of_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "count", F.coalesce("root", "fp").alias("root"))
    grouped = written(grouped, "classes")
    label = evenly_joined(grouped.select("fp", "root"), grouped.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    out = written(evenly_joined(fps, label.select("fp", "component_id"), "fp", of_fp.select("fp", "count")).select("doc_id", "fp", "component_id"), "near-duplicates")
    dropped(fps, of_fp, grouped, roots)
    return out
