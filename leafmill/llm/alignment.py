"""Alignment of the tokens of two tokenizers (operator 11).

Tokenizer A reads ``space + text``, tokenizer B the text, which puts the same space before it.  Where the
joined bytes of both are that text, every byte gets a label: no token ends here (0), one of A (1), one
of B (2), or one of both (3).  A regular expression takes the spans up to each 3; the labels counted in a span say how
many tokens of either side form a group.  Each byte with a label above 0 also closes the overlap of just one
token of A with just one of B, a link.

How often an id pair is linked in the corpus is counted in a shuffle of pairs that tasks have added up.  Pairs come back to
the documents in two ways: those that hold more than 1 / MAX_PAIRS of all links are broadcast (there are fewer
than MAX_PAIRS, whatever the data; all pairs, if there are no more than that), the others are joined by a shuffle, in
which no key is hot any more.

Defined cases: texts that are null, empty, or that either tokenizer doesn't give back byte by byte have no tokens, and all
numbers are zero; strings of special tokens are plain text; repeated rows and rows with a null doc_id are documents of
their own; other columns are ignored, whatever their names; an empty table has no rows.  A text of any length is
one slice of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm import pieces as P
from leafmill.llm.bpe import Table
from leafmill.llm.common import dropped, frugal, written

#: So many bytes of text are aligned at once, or one text.
SLICE_BYTES = 1_000_000

#: Pairs that may be broadcast, as two numbers and a flag each.
MAX_PAIRS = 1_000_000

#: Up to the next byte where tokens of both sides end.
GROUP = re.compile(b"[^3]*3")


@dataclass
class Slice:
    """Tokens of the documents of a slice that both tokenizers give back; all arrays are in the order of the text."""

    a: np.ndarray  # ids
    b: np.ndarray
    a_ends: np.ndarray  # of each document: where its tokens end
    b_ends: np.ndarray
    labels: np.ndarray  # of each byte
    byte_ends: np.ndarray  # of each document


class Pair:
    """Two tokenizers in a worker."""

    def __init__(self, a: str, b: bytes, known: dict[bytes, int] | None):
        self.coders = P.ByteLevel(a, False, known), P.SentencePiece(b)
        most = max(c.size for c in self.coders)
        #: decimal ids, followed by each separator
        self.most, self.decimals = most, Table([b"%d%c" % (i, s) for s in b",|;" for i in range(most)])

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, int, Slice]]:
        """(first row, rows, their tokens) of a block of texts, each with its space before it; empty ones have nothing to align."""
        p = P.pieces(texts, np.any([c.whole(texts) for c in self.coders], axis=0))
        coded = [c.encode(p) for c in self.coders]
        data, borders = P.contents(texts)
        row_starts, at = np.append(0, p.row_ends), 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(borders, borders[at] + SLICE_BYTES, "right")) - 1)
            codes, ends = p.codes[row_starts[at] : row_starts[to]], row_starts[at + 1 : to + 1] - row_starts[at]
            yield at, to - at, self.tokens(coded, codes, ends, data, borders[at : to + 1])
            at = to

    def tokens(self, coded: list[P.Coded], codes: np.ndarray, row_ends: np.ndarray, data: np.ndarray, borders: np.ndarray) -> Slice:
        ids, ends, good = [], [], np.ones(len(row_ends), bool)
        for coder, c in zip(self.coders, coded):
            found, counts = c.of(codes)
            to = np.append(0, np.cumsum(counts))[row_ends]
            ids.append(found)
            ends.append(to)
            odd = np.append(0, np.cumsum(~c.same[codes]))[row_ends]
            for row in np.flatnonzero(np.diff(odd, prepend=0)):  # a piece that doesn't come back: the whole text decides
                good[row] &= coder.table.gather(found[to[row - 1] if row else 0 : to[row]])[0] == data[borders[row] : borders[row + 1]].tobytes()
        for k in (0, 1):
            n = np.diff(ends[k], prepend=0)
            ids[k], ends[k] = ids[k][np.repeat(good, n)], np.cumsum(n * good)
        byte_ends = np.cumsum(np.diff(borders) * good)
        labels = np.zeros(byte_ends[-1] if len(byte_ends) else 0, np.uint8)
        for k in (0, 1):
            labels[np.cumsum(self.coders[k].table.len[ids[k]]) - 1] += k + 1
        return Slice(*ids, *ends, labels, byte_ends)

    def groups(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of A and of B in each group, and for each document where its groups end."""
        sizes = np.fromiter(map(len, GROUP.findall((s.labels + 48).tobytes())), np.int64)
        starts = np.cumsum(sizes) - sizes
        count = lambda bit: np.add.reduceat(s.labels & bit != 0, starts, dtype=np.int64) if len(starts) else starts
        return count(1), count(2), np.searchsorted(starts, s.byte_ends)

    def links(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Id pairs (A's id * size of B + B's id) of all links, and for each document where its links end."""
        at = np.flatnonzero(s.labels)
        ends_a, ends_b = s.labels[at] & 1 != 0, s.labels[at] & 2 != 0
        pairs = s.a[np.cumsum(ends_a) - ends_a].astype(np.int64) * self.coders[1].size + s.b[np.cumsum(ends_b) - ends_b]
        return pairs, np.searchsorted(at, s.byte_ends)

    def digests(self, s: Slice, na: np.ndarray, nb: np.ndarray) -> list[str]:
        """sha256 of ``a1,a2|b1;a3|b2,b3``, in decimal ids; '' without tokens."""
        last_a, last_b = np.cumsum(na) - 1, np.cumsum(nb) - 1
        sep_a, sep_b = np.zeros(len(s.a), np.int64), np.zeros(len(s.b), np.int64)
        sep_a[last_a], sep_b[last_b] = 1, 2
        line = np.empty(len(s.a) + len(s.b), np.int64)
        line[np.arange(len(s.a)) + np.repeat(np.cumsum(nb) - nb, na)] = s.a + sep_a * self.most
        line[np.arange(len(s.b)) + np.repeat(np.cumsum(na), nb)] = s.b + sep_b * self.most
        data, ends = self.decimals.gather(line)
        cuts = np.append(0, ends)[np.append(0, s.a_ends + s.b_ends)]
        return [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(cuts[:-1], cuts[1:])]


def spaced(texts: pa.Array) -> pa.Array:
    """Large binary texts with a space before them; empty ones stay empty."""
    none = pa.scalar(b"", pa.large_binary())
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), none, pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), texts, none))


def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values, pa.int32()))


def tally(pairs: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of each document in order, how often they come, and for each document where they end."""
    if not len(pairs):
        return pairs, pairs, ends
    order = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    width = int(pairs.max()) + 1
    both, n = np.unique(order * width + pairs, return_counts=True)
    return both % width, n, np.searchsorted(both, (np.arange(len(ends)) + 1) * width)


#: What align_documents can add, by name.  groups: token ids of both sides; pairs, pair_links: distinct id pairs
#: (A's id * size of B's vocabulary + B's id) in order and how often each is linked, as bytes of int64 and int32.
OUTPUTS = {
    "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "groups": "array<struct<a: array<int>, b: array<int>>>",
    "groups_sha256": "string", "row": "bigint", "pairs": "binary", "pair_links": "binary",
}


def align_documents(docs: DataFrame, a: str, b: str, outputs: tuple[str, ...] = ("n_a", "n_b", "n_groups", "n_links", "groups"), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``outputs`` (names of OUTPUTS) of every row; one pass, no shuffle.

    a: path of a byte-level BPE file of the tokenizers library; b: path of a sentencepiece BPE model.  Their contents are broadcast."""
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        spec = f.read()
        files = docs.sparkSession.sparkContext.broadcast((spec, g.read(), P.ranks(spec)))
    kinds = dict(zip(outputs, (t.dataType for t in docs.sparkSession.createDataFrame([], ", ".join(f"{o} {OUTPUTS[o]}" for o in outputs)).schema)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, row = P.loaded(Pair, *files.value), TaskContext.get().partitionId() << 33
        for batch, at, n_rows, s in ((batch, top + at, n, s) for batch in batches for top, texts in P.blocks(batch.column(1), P.BLOCK_BYTES) for at, n, s in pair.slices(spaced(texts))):
            na, nb, group_ends = pair.groups(s)
            made: dict[str, object] = {"n_a": np.diff(s.a_ends, prepend=0), "n_b": np.diff(s.b_ends, prepend=0), "n_groups": np.diff(group_ends, prepend=0)}
            made["row"] = row + np.arange(n_rows)
            row += n_rows
            if {"n_links", "pairs", "pair_links"} & set(outputs):
                pairs, link_ends = pair.links(s)
                made["n_links"] = np.diff(link_ends, prepend=0)
                if {"pairs", "pair_links"} & set(outputs):
                    known, n, ends = tally(pairs, link_ends)
                    cuts = np.append(0, ends)
                    made["pairs"] = [known[x:y].astype("<i8").tobytes() for x, y in zip(cuts[:-1], cuts[1:])]
                    made["pair_links"] = [n[x:y].astype("<i4").tobytes() for x, y in zip(cuts[:-1], cuts[1:])]
            if "groups_sha256" in outputs:
                made["groups_sha256"] = pair.digests(s, na, nb)
            if "groups" in outputs:
                both = pa.StructArray.from_arrays([lists(s.a, np.cumsum(na)), lists(s.b, np.cumsum(nb))], ["a", "b"])
                made["groups"] = pa.ListArray.from_arrays(pa.array(np.append(0, group_ends), pa.int32()), both)
            arrow = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            columns = [x if isinstance(x := made[o], pa.Array) else pa.array(x, arrow[OUTPUTS[o]]) for o in outputs]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n_rows), *columns], ["doc_id", *outputs])

    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    schema = rows.select("doc_id").schema
    for o in outputs:
        schema = schema.add(o, kinds[o])
    return rows.mapInArrow(frugal(run), schema)


def parted(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch by SLICE_BYTES of a binary column, or one row."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES * 8, "right")))
        yield batch.slice(at, to - at)
        at = to


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """pair, b, n (links in the corpus), best (none of B's id has more); from rows with pairs and pair_links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parted(batch, 0)):
            known = np.frombuffer(b"".join(part.column(0).to_pylist()), "<i8")
            if len(known):
                n = np.frombuffer(b"".join(part.column(1).to_pylist()), "<i4")
                distinct, place = np.unique(known, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(np.bincount(place, n).astype(np.int64))], ["pair", "n"])

    counts = aligned.select("pairs", "pair_links").mapInArrow(frugal(run), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    # an id of B has at most as many pairs as A has ids
    most = F.max("n").over(Window.partitionBy("b"))
    return written(counts.withColumn("b", F.col("pair") % size_b).withColumn("best", F.col("n") == most), "pair-counts")


def scored(aligned: DataFrame, counts: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """``aligned`` (row, pairs, pair_links and others) with n_best and count_sum in place of its pairs."""
    spark = aligned.sparkSession
    light = [c for c in aligned.columns if c not in ("pairs", "pair_links")]
    own = light.index("row")
    n, total = counts.agg(F.count("*"), F.sum("n")).first()
    common = F.col("n") * max_pairs > (total or 0) if n > max_pairs else F.lit(True)
    found = counts.where(common).select("pair", "n", "best").orderBy("pair").toArrow()
    columns = [found.column(c).to_numpy() for c in ("pair", "n", "best")]
    shared = spark.sparkContext.broadcast(columns)

    def lookup(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = shared.value[0]
        at = np.minimum(np.searchsorted(names, pairs), max(0, len(names) - 1))
        return at, names[at] == pairs if len(names) else np.zeros(len(pairs), bool)

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        blobs = batch.column(len(light)).to_pylist()
        borders = np.append(0, np.cumsum([len(x) // 8 for x in blobs]))
        return np.frombuffer(b"".join(blobs), "<i8"), np.frombuffer(b"".join(batch.column(len(light) + 1).to_pylist()), "<i4").astype(np.int64), borders.astype(np.int64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, counted, best = shared.value
        for batch in (p for batch in batches for p in parted(batch, len(light))):
            pairs, times, borders = read(batch)
            at, known = lookup(pairs)
            times = times * known
            worth = [np.append(0, np.cumsum(times * v[at] if len(counted) else times))[borders] for v in (best, counted)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(light)], *(pa.array(np.diff(w)) for w in worth)], [*light, "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for batch in batches for p in parted(batch, len(light))):
            pairs, times, borders = read(batch)
            rest = np.flatnonzero(~lookup(pairs)[1])
            row = np.repeat(batch.column(own).to_numpy(), np.diff(borders))
            yield pa.RecordBatch.from_arrays([pa.array(row[rest]), pa.array(pairs[rest]), pa.array(times[rest])], ["row", "pair", "times"])

    rows = aligned.select(*light, "pairs", "pair_links")
    done = rows.mapInArrow(frugal(sums), rows.select(*light).schema.add("n_best", "long").add("count_sum", "long"))
    if n <= max_pairs:
        return done
    rare = rows.mapInArrow(frugal(others), "row bigint, pair bigint, times bigint").join(counts.where(~common), "pair")
    more = rare.groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("int")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    both = done.join(more, "row", "left")
    return both.select(*light, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))


def align_corpus(docs: DataFrame, a: str, b: str, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every row."""
    from sentencepiece import SentencePieceProcessor

    aligned = written(align_documents(docs, a, b, ("row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "pair_links")), "aligned")
    counts = pair_counts(aligned, SentencePieceProcessor(model_file=b).get_piece_size())
    found = written(scored(aligned, counts, max_pairs).drop("row"), "alignment")
    dropped(aligned, counts)
    return found
