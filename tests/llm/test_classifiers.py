import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import langid as L
from leafmill.llm import ngrams as N
from leafmill.llm import quality as Q
from leafmill.llm.common import bucket4

DATA = "/root/testdata/sf0.01"


def test_hold_out_rule(spark):
    got = spark.range(200).select("id", bucket4(F.col("id")).alias("b")).collect()
    assert all(r.b == zlib.crc32(str(r.id).encode()) % 4 for r in got)


def test_counts_stay_in_their_document():
    part = [b"ab", b"", b"ba!", b"a"]
    counts = N.letter_pairs(part)
    assert counts.sum(1).tolist() == [1, 0, 2, 0]
    assert counts[0, 0 * 64 + 1] == 1 and counts[2, 1 * 64 + 0] == 1
    together, alone = N.all_counts(part), np.concatenate([N.all_counts([p]) for p in part])
    assert np.allclose(together, alone)


def test_scores_equal_plain_voting(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = Q.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"), max_labelled=200)
    rows = docs.limit(40).collect()
    counts = N.all_counts([r.text.encode() for r in rows])
    v = model.latent(counts)
    for i, s in enumerate(model.score(counts)):
        alike = [(float(v[i] @ m), -k) for k, m in enumerate(model.vectors)]
        near = sorted(alike, reverse=True)[: Q.NEIGHBOURS]
        w = [max(a, 1e-3) ** Q.POWER for a, _ in near]
        assert s == pytest.approx(sum(x * model.labels[-k] for x, (_, k) in zip(w, near)) / sum(w), abs=1e-2)


def test_quality_on_held_out_rows(spark):
    from leafmill.llm.queries import op8_knn_quality

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    held = op8_knn_quality(spark, DATA).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert np.mean([r.predicted == 1 for r in held if r.quality == 1]) > 0.97


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "", 6), (3, "x" * 200_000, 7)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    out = Q.score_documents(docs, Q.fit(docs, labels))
    assert out.columns == ["doc_id", "text", "score", "_score"] and {r["_score"] for r in out.collect()} == {0.5} and out.count() == 4
    some = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, None)], "doc_id bigint, quality int")
    got = Q.score_documents(docs, Q.fit(docs, some), ["doc_id"]).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert Q.score_documents(docs.limit(0), Q.fit(docs, some)).count() == 0


def test_languages_on_held_out_rows(spark):
    from leafmill.llm.queries import op10_ecoc_language_id

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    held = op10_ecoc_language_id(spark, DATA).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_language_edges(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([(None, "aa"), ("", None), ("123 !?", "aa"), ("hello world", "aa"), ("guten tag", "bb"), ("hello", None)] * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = L.identify(docs, L.fit(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.lang_pred == "und") == (rows[r.doc_id][1] in (None, "", "123 !?")) and 0 <= r.score <= 1
    none = L.identify(docs, L.fit(docs.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    one = L.identify(docs, L.fit(docs.where("lang = 'aa'"))).where("lang_pred = 'aa'").collect()
    assert one and all(r.score == 1.0 for r in one)


def test_codewords_differ():
    for n in (2, 3, 4, 6, 7, 30):
        code = L.codewords(n)
        assert min(np.count_nonzero(code[i] != code[j]) for i in range(n) for j in range(i)) >= (code.shape[1] // 4 or 1)


def test_a_wrong_bit_is_corrected():
    code = L.codewords(4)
    model = L.Model(list("abcd"), code, np.zeros((N.N_LETTERS, code.shape[1])), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    for k, word in enumerate(code):
        for bit in range(code.shape[1]):
            model.bias = word * np.where(np.arange(code.shape[1]) == bit, -0.3, 1.0)
            best, score, close = model.decode(np.zeros((1, N.N_LETTERS)))
            assert best[0] == k and 0 < score[0] <= 1
    model.bias = np.zeros(code.shape[1])
    assert model.decode(np.zeros((1, N.N_LETTERS)))[2][0]


def test_repeated_rows_get_equal_scores(spark):
    text = "".join(random.Random(1).choices("abc de", k=500))
    docs = spark.createDataFrame([(i, text) for i in range(6)], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id bigint, quality int")
    assert len({r.score for r in Q.score_documents(docs, Q.fit(docs, labels), ["doc_id"]).collect()}) == 1


def test_neighbours_of_equal_likeness_are_the_first_ones():
    rnd = np.random.RandomState(1)
    alike = rnd.randint(0, 4, (200, 40)).astype(np.float32)
    near = Q.nearest(alike, 7)
    for row, got in zip(alike, near):
        assert set(got) == set(sorted(range(40), key=lambda k: (-row[k], k))[:7])


#: Two ids whose rows are learned from.
ONE, TWO = [i for i in range(20) if zlib.crc32(str(i).encode()) % 4 != 2][:2]


def test_the_bound_holds_for_texts_of_one_doc_id(spark):
    docs = spark.range(3000).select(F.lit(ONE).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 50).cast("string")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(TWO, "other"), (None, "none")], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(ONE, 0), (ONE, 1), (TWO, 0), (None, 1), (TWO, None)], "doc_id bigint, quality int")
    model = Q.fit(docs, labels)
    assert len(model.labels) == 51 and model.labels.sum() == 50  # of conflicting labels the greatest
    assert len(Q.fit(docs, labels, max_labelled=2).labels) == 2


def test_language_sample_is_bounded_and_loses_no_language(spark, monkeypatch):
    many = spark.range(5000).select(F.lit(ONE).cast("bigint").alias("doc_id"), F.concat(F.lit("abc "), (F.col("id") % 30).cast("string")).alias("text"), F.lit("x").alias("lang"))
    few = spark.createDataFrame([(TWO, "zz yy", "y"), (TWO, "zz yy", "y"), (None, "q", "y")], "doc_id bigint, text string, lang string")
    model = L.fit(many.unionByName(few), max_rows=20)
    assert model.langs == ["x", "y"]
    with pytest.raises(ValueError):
        L.identify(few, model, ("doc_id", "score"))
    monkeypatch.setattr(L, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        L.fit(many.unionByName(few))


def test_languages_equal_plain_ridge_and_decoding(spark):
    """The whole operator by hand: bigram features, one ridge solution a bit by normal equations, loss-weighted decoding."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = L.fit(docs)
    rows = [r for r in docs.collect()]
    train = sorted((r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.text is not None and r.lang is not None), key=lambda r: r.lang)
    assert len(train) < 512

    def features(text):
        x = np.zeros(N.N_LETTERS)
        codes = N.LETTERS[np.frombuffer((text or "").encode(), np.uint8)]
        for a, b in zip(codes[:-1], codes[1:]):
            x[a * 64 + b] += 1
        x = np.sqrt(x)
        return np.append(x / max(np.linalg.norm(x), 1e-12), 1.0)

    langs = sorted({r.lang for r in train})
    code = L.codewords(len(langs))
    x = np.array([features(r.text) for r in train])
    n = {l: sum(r.lang == l for r in train) for l in langs}
    w = np.array([len(train) / len(langs) / n[r.lang] for r in train])
    y = np.array([code[langs.index(r.lang)] for r in train])
    used = np.flatnonzero(x.any(0))
    z = x[:, used]
    planes = np.linalg.solve(z.T @ (w[:, None] * z) + L.RIDGE * np.eye(len(used)), z.T @ (w[:, None] * y))
    reliable = np.log(np.maximum(((z @ planes) * y > 0).mean(0), 0.51) / np.maximum(1 - ((z @ planes) * y > 0).mean(0), 1e-3)).clip(0.05)
    reliable /= reliable.mean()
    agree = 0
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    lettered = [r for r in rows if any(c.isalpha() for c in r.text or "")]
    for r in lettered:
        f = features(r.text)[used] @ planes
        loss = [(np.log1p(np.exp(-4 * f * word)) * reliable).sum() for word in code]
        agree += got[r.doc_id].lang_pred == langs[int(np.argmin(loss))]
    assert agree == len(lettered)


def test_long_texts_count_whole():
    text = ("the machine stops " * 200_000).encode()
    short = N.letter_pairs([b"the machine stops " * 2])[0]
    long = N.letter_pairs([text])[0]
    assert long.sum() == len(text) - 1 and (np.flatnonzero(long) == np.flatnonzero(short)).all()
    assert [len(p) for p in N.slices(["a" * (3 << 20), "b"])] == [1, 1]
