import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from leafmill.llm import packing, pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, part int, ids string, first int, n_tokens int"


def rows_of(texts):
    return [(i, t, 7, "x", 1, 2) for i, t in texts]


def plain(texts):
    library = Tokenizer.from_file(PATH)
    return sorted((i is None, i or 0, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in texts)


def glued(found):
    """Documents put together again from their pieces, after a check of every piece and sequence."""
    rows = [r.asDict() for r in found.collect()]
    by_sequence, by_document = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<i4")
        assert len(ids) == r["length"] > 0 and zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, parts in by_sequence.items():
        parts.sort()
        ends = np.cumsum([n for _, n in parts]).tolist()
        assert [at for at, _ in parts] == [0, *ends[:-1]]
        by_document[k] = ends[-1]
    return rows, by_document


def test_pieces_hold_each_id_once(spark):
    texts = [(1, "a few words here " * 40), (2, None), (3, ""), (4, "other words"), (5, "long text, " * 900), (None, "no id"), (6, "end<|endoftext|> of  <|endoftext|>")]
    df = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    rows, sizes = glued(packing.pack(df, PATH, length=64, with_ids=True))
    assert sorted(sizes) == list(range(len(sizes))) and [n for k, n in sorted(sizes.items())][:-1] == [64] * (len(sizes) - 1)
    documents = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        ids = documents.setdefault(r["doc_id"], [])
        assert len(ids) == r["start"]
        ids.extend(np.frombuffer(r["ids"], "<i4").tolist())
    assert sorted((i is None, i or 0, x) for i, x in documents.items()) == plain(texts)
    assert all(r["doc_tokens"] == len(documents[r["doc_id"]]) for r in rows)


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame(rows_of([(1, "same row")] * 5 + [(2, None)] * 3), SCHEMA).repartition(4)
    rows, sizes = glued(packing.pack(df, PATH, length=4, with_ids=True))
    assert sum(r["length"] for r in rows) == 5 * len(plain([(1, "same row")])[0][2]) + 3 == sum(sizes.values())
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_a_document_ends_with_a_sequence(spark):
    df = spark.createDataFrame(rows_of([(1, ""), (2, ""), (3, ""), (4, "")]), SCHEMA).coalesce(1)
    found = packing.pack(df, PATH, length=2).orderBy("sequence_id", "offset").collect()
    assert [(r.sequence_id, r.offset, r.start, r.length, r.doc_tokens) for r in found] == [(0, 0, 0, 1, 1), (0, 1, 0, 1, 1), (1, 0, 0, 1, 1), (1, 1, 0, 1, 1)]


def test_prefix_sums_over_blocks_and_without_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(rows_of([(i, f"text number {i}") for i in range(60)]), SCHEMA).repartition(12)
    monkeypatch.setattr(packing, "BLOCK", 5)
    monkeypatch.setattr(packing, "MAX_BROADCAST", 0)
    rows, sizes = glued(packing.pack(df, PATH, length=32, with_ids=True))
    assert sum(sizes.values()) == sum(len(x) for _, _, x in plain([(i, f"text number {i}") for i in range(60)])) == sum(r["length"] for r in rows)


def test_sequences(spark):
    texts = [(i, "some words " * (i % 7)) for i in range(40)]
    df = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    found = packing.pack(df, PATH, length=32, with_ids=True)
    made = {r.sequence_id: r for r in packing.sequences(found, 32, pad_id=9).collect()}
    for k, r in made.items():
        assert sum(p.length for p in r.pieces) == r.n_tokens
        assert len(r.token_ids) == (32 if r.n_tokens & (r.n_tokens - 1) else r.n_tokens) and set(r.token_ids[r.n_tokens :]) <= {9}
    wanted = {i: x for _, i, x in plain(texts)}
    for r in made.values():
        for p in r.pieces:
            assert r.token_ids[p.offset : p.offset + p.length] == wanted[p.doc_id][p.start : p.start + p.length]


def test_blocks_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(rows_of([(i, f"text {i} of  some\n words é 漢 " * 30) for i in range(20)]), SCHEMA).coalesce(1)
    key = lambda found: sorted((r.doc_id, r.start, r.ids_crc32, r.sequence_id) for r in found.collect())
    wanted = key(packing.pack(df, PATH))
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 10)
    monkeypatch.setattr(pieces, "JOINED_BYTES", 5)
    assert key(packing.pack(df, PATH)) == wanted
