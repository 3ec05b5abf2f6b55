"""Language identification with error-correcting output codes (operator 10).

Every learned language has a codeword; for each bit a linear classifier over hashed
letter pairs (ridge regression, bytes without case) predicts that bit.  Decoding adds
up, for each language, the logistic loss of every bit's margin against its codeword,
weighted by how reliable the bit was on the training rows; the least loss wins.  The
score is the winner's share of exp(-loss), and a small lead over the second language
flags the row as ambiguous.

Training reads at most MAX_ROWS texts of each language (least hash of doc_id; every text of
a repeated doc_id counts) and MAX_TOTAL in all, never rows whose crc32(doc_id as text) mod 4
is 2.  More than MAX_LANGUAGES languages are an error: no language is left out silently.

Defined cases: null texts and texts without a letter give ``und`` with score 0; with
no language to learn every row is ``und``; with one language each text with a letter
gets it, with score 1; repeated rows give equal results and are one text in training; a
column that is kept and has the name of an output is an error; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm import ngrams
from leafmill.llm.common import bucket4, free_name
from leafmill.llm.quality import dense, sparse_counts

MAX_ROWS, MAX_TOTAL, MAX_LANGUAGES, RIDGE, LEAD = 512, 4096, 1024, 1.0, 0.1


def codewords(n: int) -> np.ndarray:
    """n words of +1 and -1: all splits into two parts for few languages, else the
    best of some random codes, by the least distance of two words."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        return np.array([[1 if (split >> k) & 1 or k == n - 1 else -1 for split in range(2 ** (n - 1) - 1)] for k in range(n)])
    rnd = np.random.RandomState(7)
    bits = max(31, int(np.ceil(12 * np.log2(n))))

    def distance(code: np.ndarray) -> float:
        same = code @ code.T - 2 * bits * np.eye(n)
        return (bits - same.max()) / 2

    return max((rnd.choice([-1, 1], (n, bits)) for _ in range(64)), key=distance)


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    planes: np.ndarray  # terms x bits
    bias: np.ndarray
    reliable: np.ndarray  # weight of each bit

    def margins(self, counts: np.ndarray) -> np.ndarray:
        x = np.sqrt(counts)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return x @ self.planes + self.bias

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its score, and whether the lead is small."""
        f = self.margins(counts)
        loss = np.stack([(np.log1p(np.exp(-4 * f * word)) * self.reliable).sum(1) for word in self.code], axis=1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        two = np.sort(p, axis=1)[:, -2:]
        return best, p[np.arange(len(p)), best], (two[:, -1] - two[:, 0] < LEAD) if p.shape[1] > 1 else np.zeros(len(p), bool)


def fit(df: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """df(doc_id, text, lang)."""
    train = df.where((bucket4(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # distinct ids: a language whose rows repeat few ids keeps them all
    sizes = train.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("size"))
    n_langs = sizes.count()
    if n_langs > MAX_LANGUAGES:
        raise ValueError(f"{n_langs} languages; at most {MAX_LANGUAGES} can be learned")
    max_rows = max(1, min(max_rows, MAX_TOTAL // max(1, n_langs)))
    keyed = train.select("doc_id", "lang", "text").withColumn("mark", F.xxhash64("text"))
    # only hashes low enough to be among the least reach the window, however many tasks there are
    rows = keyed.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))).join(F.broadcast(sizes), "lang")
    rows = rows.where(F.col("h").cast("double") * F.col("size") <= F.lit(float(1 << 40)) * (4 * max_rows + 100))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "mark")
    rows = rows.select("lang", "doc_id", "h", "mark").distinct()
    chosen = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_rows).select("doc_id", "lang", "mark")
    texts = keyed.join(F.broadcast(chosen), ["doc_id", "lang", "mark"], "left_semi").dropDuplicates(["doc_id", "lang", "mark"])
    rows = sparse_counts(texts, ngrams.letter_pairs, ["doc_id", "lang"], "doc_id bigint, lang string").collect()
    rows.sort(key=lambda r: (r.lang, r.doc_id, r.terms, r["values"]))
    langs = sorted({r.lang for r in rows})
    code = codewords(len(langs))
    if len(langs) < 2:
        return Model(langs, code, np.zeros((ngrams.N_LETTERS, code.shape[1]), np.float32), np.ones(code.shape[1]), np.ones(code.shape[1]))
    x = np.sqrt(dense(rows, ngrams.N_LETTERS))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    of = np.array([langs.index(r.lang) for r in rows])
    y = code[of].astype(np.float64)
    # each language counts the same, however many rows it has
    weight = np.sqrt(len(rows) / len(langs) / np.bincount(of))[of][:, None]
    xw = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1) * weight.astype(np.float32)
    gram = (xw @ xw.T).astype(np.float64)
    planes = xw.T @ np.linalg.solve(gram + RIDGE * np.eye(len(rows)), y * weight)
    right = ((x @ planes[:-1] + planes[-1]) * y > 0).mean(0)
    reliable = np.clip(np.log(np.maximum(right, 0.51) / np.maximum(1 - right, 1e-3)), 0.05, None)
    return Model(langs, code, planes[:-1].astype(np.float32), planes[-1], reliable / reliable.mean())


def identify(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score, ambiguous; one pass, no shuffle."""
    if clash := {"lang_pred", "score", "ambiguous"} & set(keep):
        raise ValueError(f"rename {sorted(clash)}: outputs have these names")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            lettered = np.array([any(map(str.isalpha, t)) for t in texts], bool) & bool(m.langs)
            best, score, close = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), bool)
            at = 0
            for part in ngrams.slices(texts) if m.langs else ():
                to = at + len(part)
                best[at:to], score[at:to], close[at:to] = m.decode(ngrams.letter_pairs(part))
                at = to
            names = [m.langs[b] if ok else "und" for b, ok in zip(best, lettered)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(keep))] + [pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(close | ~lettered)], [*keep, "lang_pred", "score", "ambiguous"])

    schema = df.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return df.select(*keep, df["text"].alias(free_name("text", keep))).mapInArrow(run, schema)
