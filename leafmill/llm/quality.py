"""Quality by nearest-neighbour voting in a latent-semantic space (operator 8).

A bounded sample of labelled texts (``MAX_LABELLED``, those with the least hash of
their doc_id; every text of a repeated doc_id counts) gives term weights and a truncated singular value decomposition of its
weighted n-gram counts.  The sample's latent vectors and labels are broadcast; their
size depends on MAX_LABELLED and DIMENSIONS only.  Every document is projected and
compared with all of them in exact blocked cosine products; the NEIGHBOURS most
similar vote for their labels, weighted by a power of the similarity.

Only texts are inputs of a score.  Labels of rows whose crc32(doc_id as text) mod 4
is 2 are never read.

Defined cases: null text counts as empty; an empty text still has a length term, so
it is scored like the shortest labelled texts; ties between neighbours go to the one
that comes first in the sample, which is ordered by doc_id and text; of conflicting labels
of a doc_id the greatest counts; rows repeated with one doc_id and text are one labelled
text; labels without a doc_id are not read; without any usable label the score is 0.5;
repeated rows get equal scores; other columns of the documents are passed on or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import ngrams
from leafmill.llm.common import bucket4, free_name, frugal

MAX_LABELLED, DIMENSIONS, NEIGHBOURS, POWER, THRESHOLD = 4096, 64, 15, 8, 0.7


@dataclass
class Model:
    weights: np.ndarray  # of terms
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled x dimensions, of length one
    labels: np.ndarray

    def latent(self, counts: np.ndarray) -> np.ndarray:
        x = np.sqrt(counts) * self.weights
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        v = x @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        alike = self.latent(counts) @ self.vectors.T
        near = nearest(alike, min(NEIGHBOURS, alike.shape[1]))
        weight = np.maximum(np.take_along_axis(alike, near, 1), 1e-3).astype(np.float64) ** POWER
        return np.clip((weight * self.labels[near]).sum(1) / weight.sum(1), 0.0, 1.0)


def nearest(alike: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest values of each row; of equal ones the first."""
    near = np.argpartition(-alike, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(alike, near, 1).min(1)
    tied = np.flatnonzero((alike >= least[:, None]).sum(1) > k)
    if len(tied):
        near[tied] = np.argsort(-alike[tied], axis=1, kind="stable")[:, :k]
    return near


def sparse_counts(rows: DataFrame, counts, columns: list[str], schema: str) -> DataFrame:
    """Term counts of a bounded sample, as (columns, terms, values) for the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in ngrams.slices([t or "" for t in batch.column(len(columns)).to_pylist()]):
                c = counts(part)
                terms = [np.flatnonzero(r) for r in c]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(at, len(part)) for k in range(len(columns))] + [pa.array([t.astype(np.int32).tobytes() for t in terms], pa.binary()), pa.array([r[t].tobytes() for r, t in zip(c, terms)], pa.binary())],
                    [*columns, "terms", "values"],
                )
                at += len(part)

    return rows.select(*columns, "text").mapInArrow(frugal(run), f"{schema}, terms binary, values binary")


def dense(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.float32)
    for i, r in enumerate(rows):
        out[i, np.frombuffer(r.terms, np.int32)] = np.frombuffer(r["values"], np.float32)
    return out


def fit(df: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED, dimensions: int = DIMENSIONS) -> Model:
    """df(doc_id, text); labels(doc_id, <label>)."""
    usable = labels.where((bucket4(F.col("doc_id")) != 2) & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # one doc_id may have many rows: their distinct texts are chosen by narrow keys, so the bound holds for texts
    keyed = df.select("doc_id", "text").withColumn("mark", F.xxhash64("text"))
    keys = keyed.join(F.broadcast(chosen), "doc_id").select("doc_id", "mark", "label").distinct()
    keys = keys.orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(max_labelled)
    texts = keyed.join(F.broadcast(keys), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    rows = sparse_counts(texts, ngrams.all_counts, ["doc_id", "label"], "doc_id bigint, label int").collect()
    rows.sort(key=lambda r: (r.doc_id, r.terms, r["values"]))
    counts = dense(rows, ngrams.N_ALL)
    y = np.array([r.label for r in rows], np.float64)
    if not len(rows):
        return Model(np.ones(ngrams.N_ALL, np.float32), np.zeros((ngrams.N_ALL, 1), np.float32), np.zeros((0, 1), np.float32), y)
    seen = np.count_nonzero(counts, axis=0)
    weights = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)
    del rows
    # in place: the driver holds the sample once
    x = np.sqrt(counts, out=counts)
    x *= weights
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    # randomised subspace iteration for the leading right singular vectors
    width = min(dimensions + 16, *x.shape)
    basis = np.random.RandomState(11).standard_normal((x.shape[1], width)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, vt = np.linalg.svd(x @ basis, full_matrices=False)
    axes = (basis @ vt[:dimensions].T).astype(np.float32)
    v = x @ axes
    return Model(weights, axes, (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32), y)


def score_documents(df: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of df (all by default) and ``score``; one pass, no shuffle."""
    keep = keep or df.columns
    shared = df.sparkSession.sparkContext.broadcast(model)
    name = free_name("score", keep)
    schema = df.select(*keep).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            found = [m.score(ngrams.all_counts(part)) for part in ngrams.slices(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(keep))] + [pa.array(np.concatenate(found) if found else np.zeros(0))], [*keep, name])

    return df.select(*keep, df["text"].alias(free_name("text", keep))).mapInArrow(frugal(run), schema)
