"""Token counts under a unigram vocabulary by a trie of pre-tokens (operator 2).

The model: pieces of a public vocabulary, ordered by rank; piece number r has the
log-probability -log(r + RANK_OFFSET) (a fixed Zipf rule, nothing is trained), and a
pre-token is cut into the pieces with the greatest sum.  Single bytes are pieces, so
every text has a cut.

The distinct pre-tokens of a worker are inserted in a trie.  Each node keeps the best
score and piece count of its prefix (the forward pass of the usual dynamic programme),
so a prefix shared by many pre-tokens is scored once; a terminal node keeps how many
pieces its pre-token has.  Documents then only add up terminal counts; ``corpus_counts``
also counts how often each terminal came.  The trie is emptied when it has MAX_NODES
nodes, within a text too; results never depend on it.

Pre-tokens are ``[ ]?\\S+`` and runs of other white space (ASCII white space, the same
class in all parts).  Of cuts with equal scores the one whose last piece is longest counts.

Defined cases: null text counts as empty and has no tokens; repeated rows give equal
rows; a pre-token of any length is handled whole, one longer than ``LONG`` bytes in a
forward pass of its own that keeps no nodes; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import math
import re
from array import array
from collections import deque
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK_OFFSET, MAX_NODES, LONG = 10, 1_000_000, 4096
#: A text is counted in parts of so many pre-tokens.
PART = 1 << 18
PRE_TOKEN = re.compile(rb" ?[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+?(?= [^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+")


def read_ranks(spec: bytes) -> dict[bytes, float]:
    """Scores from a file of lines ``base64 rank``."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, spec.splitlines())}
    return {piece: -math.log(r + RANK_OFFSET) for piece, r in ranks.items()}


class Trie:
    """Nodes are numbers; ``step`` maps node << 8 | byte to the child."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.uses = 0
        self.empty()

    def empty(self) -> None:
        self.step: dict[int, int] = {}
        #: by node: best score and its pieces
        self.forward, self.pieces = array("d", [0.0]), array("q", [0])
        trie = self

        class Terminals(dict):
            """Pre-token -> its terminal node; a new pre-token is inserted when first looked up."""

            def __missing__(self, token: bytes) -> int:
                return trie.insert(token)

        self.terminal = Terminals()

    def insert(self, token: bytes) -> int:
        """The terminal node; only nodes that are new are scored."""
        if len(token) > LONG:
            return self._alone(token)
        step, forward, pieces, scores, longest = self.step, self.forward, self.pieces, self.scores, self.longest
        path, node = [0], 0
        for depth, byte in enumerate(token, 1):
            key = node << 8 | byte
            child = step.get(key)
            if child is None:
                child = step[key] = len(forward)
                best, count = -math.inf, 0
                for start in range(max(0, depth - longest), depth):
                    s = scores.get(token[start:depth])
                    if s is not None and (s := s + forward[path[start]]) > best:
                        best, count = s, pieces[path[start]] + 1
                forward.append(best)
                pieces.append(count)
            node = child
            path.append(node)
        self.terminal[token] = node
        return node

    def _alone(self, token: bytes) -> int:
        """The node of a very long pre-token: the same forward pass over a window of it, one node in all."""
        best: deque[tuple[float, int]] = deque([(0.0, 0)], maxlen=self.longest)
        for end in range(1, len(token) + 1):
            top = (-math.inf, 0)
            for back, (score, count) in enumerate(best):
                start = end - len(best) + back
                s = self.scores.get(token[start:end])
                if s is not None and s + score > top[0]:
                    top = s + score, count + 1
            best.append(top)
        self.forward.append(best[-1][0])
        self.pieces.append(best[-1][1])
        self.terminal[token] = len(self.forward) - 1
        return len(self.forward) - 1

    def nodes(self, text: bytes) -> Iterator[np.ndarray]:
        """The terminal nodes of a text's pre-tokens, part by part; numbers hold until the next part."""
        for tokens in [PRE_TOKEN.findall(text)] if len(text) < 1 << 22 else batched((m.group() for m in PRE_TOKEN.finditer(text)), PART):
            if len(self.forward) > MAX_NODES:
                self.empty()
            yield np.fromiter(map(self.terminal.__getitem__, tokens), np.int64, len(tokens))

    def count(self, text: bytes) -> tuple[int, int, float]:
        """Pre-tokens, pieces and the sum of scores of a text."""
        n, total, score = 0, 0, 0.0
        for nodes in self.nodes(text):
            n += len(nodes)
            total += int(np.frombuffer(self.pieces, np.int64)[nodes].sum())
            score += float(np.frombuffer(self.forward)[nodes].sum())
        return n, total, score


_LOADED: dict[int, Trie] = {}


def token_counts(df: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes, n_pretokens, n_tokens, log_score of every row of df(doc_id, text).

    vocabulary: path of a rank file that the driver can read.  One pass, no shuffle.
    """
    with open(vocabulary, "rb") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(spec.value)
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = Trie(read_ranks(spec.value))
        trie = _LOADED[key]
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            found = [trie.count(t) for t in texts]
            columns = list(zip(*found)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                ["doc_id", "n_bytes", "n_pretokens", "n_tokens", "log_score"],
            )

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_pretokens bigint, n_tokens bigint, log_score double")


def corpus_counts(df: DataFrame, vocabulary: str) -> DataFrame:
    """pre_token, n_tokens, came: how often each pre-token stands in the whole corpus, and its pieces.

    Every task counts at the terminals of a trie and gives them out whenever it is full, so only sums of
    distinct pre-tokens are shuffled."""
    with open(vocabulary, "rb") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, came = Trie(read_ranks(spec.value)), np.zeros(0, np.int64)

        def given() -> pa.RecordBatch:
            rows = [(token, trie.pieces[node], int(came[node])) for token, node in trie.terminal.items() if node < len(came) and came[node]]
            columns = list(zip(*rows)) if rows else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["pre_token", "n_tokens", "came"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if len(trie.forward) > MAX_NODES // 2:  # before it could be emptied with its counts
                    yield given()
                    trie.empty()
                    came = np.zeros(0, np.int64)
                for nodes in trie.nodes((text or "").encode()):
                    if len(trie.forward) > len(came):
                        came = np.concatenate([came, np.zeros(2 * len(trie.forward) - len(came), np.int64)])
                    if len(nodes):
                        at, n = np.unique(nodes, return_counts=True)
                        came[at] += n
                    if len(trie.forward) > MAX_NODES:
                        yield given()
                        trie.empty()
                        came = np.zeros(0, np.int64)
        yield given()

    rows = df.select("text").mapInArrow(run, "pre_token binary, n_tokens bigint, came bigint")
    return rows.groupBy("pre_token").agg(F.max("n_tokens").alias("n_tokens"), F.sum("came").alias("came"))
