import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leafmill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABC 0123456789'.,!\n\t\r  　\x1c\x1d\x85​éüñß漢字🎉Ⅷ²½٣"


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Bpe(f.read())


def test_same_ids_as_the_library(own):
    other, rnd = Tokenizer.from_file(PATH), random.Random(5)
    texts = ["", "<|endoftext|>", "a<|endoftext|> b", "x" * 5000, " \n \n  a"] + ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 60))) for _ in range(3000)]
    ids, ends = own.encode(texts)
    starts = np.concatenate([[0], ends])
    for i, (t, e) in enumerate(zip(texts, other.encode_batch(texts, add_special_tokens=False))):
        assert ids[starts[i] : starts[i + 1]].tolist() == e.ids, repr(t)
    assert own.decode(ids, ends) == texts


def test_pair_table_equals_plain_merges(own):
    rnd = random.Random(6)
    tokens = [t for t in own.of if len(t) < 8]
    for _ in range(20000):
        a, b = rnd.choice(tokens), rnd.choice(tokens)
        assert own._fits(own.of[a], own.of[b]) == (own.merged(a + b) == [own.of[a], own.of[b]])


def test_full_memory_changes_nothing(own, monkeypatch):
    first = own.encode(["one two three"])[0].tolist()
    monkeypatch.setattr(bpe, "CACHE_PIECES", 0)
    assert own.encode(["one two three"])[0].tolist() == first


def test_rows(spark):
    df = spark.createDataFrame([(1, "hi there", 7), (2, None, 8), (2, None, 8), (None, "", 9)], "doc_id bigint, text string, n_tokens int").repartition(2)
    out = bpe.encode_documents(df.withColumnRenamed("n_tokens", "ids"), PATH, outputs=("n_tokens", "token_ids", "decoded", "decoded_sha256", "ids_sha256"), keep=("doc_id", "ids"))
    got = {(r.doc_id, r.ids): (r.n_tokens, r.decoded) for r in out.collect()}
    assert got == {(1, 7): (2, "hi there"), (2, 8): (0, ""), (None, 9): (0, "")} and out.count() == 4
    assert bpe.encode_documents(df.limit(0), PATH).count() == 0


def test_long_texts_and_names(spark, monkeypatch):
    df = spark.createDataFrame([(1, "one two " * 3000), (2, "three"), (3, "one two " * 3000)], "doc_id bigint, text string").coalesce(1)
    wanted = {r.doc_id: r.ids_sha256 for r in bpe.encode_documents(df, PATH, outputs=("ids_sha256",)).collect()}
    monkeypatch.setattr(bpe, "SLICE_CHARS", 10)
    assert {r.doc_id: r.ids_sha256 for r in bpe.encode_documents(df, PATH, outputs=("ids_sha256",)).collect()} == wanted
    with pytest.raises(ValueError):
        bpe.encode_documents(df.withColumn("n_tokens", df.doc_id), PATH, keep=("doc_id", "n_tokens"))
