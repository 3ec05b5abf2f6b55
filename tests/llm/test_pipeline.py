from pathlib import Path

import corpus_pipeline as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.llm import bpe, langid
from leafmill.llm.common import shared_dir
from leafmill.llm.queries import queries, vocabulary

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(f"file://{tmp_path}/{k}")
        out = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < len(P.STAGES) - 1:
            assert out.columns == columns and out.count() <= n, name
            docs, n = out, out.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    library = Tokenizer.from_file(vocabulary())
    rows = out.collect()
    assert len(rows) == n > 100
    for r in rows:
        assert r.token_ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1")
    left = P.classify_quality(spark, docs, DATA)
    assert left.join(good, "doc_id").count() >= 0.98 * docs.join(good, "doc_id").count()


def test_rejected_documents_go(spark):
    data = DATA.replace("sf0.001", "sf0.01")
    op8 = next(f for n, f in queries().items() if n.startswith("op8_"))
    wanted = sorted(r.doc_id for r in op8(spark, data).where("predicted = 1").collect())
    left = P.classify_quality(spark, spark.read.parquet(f"{data}/documents.parquet"), data)
    assert sorted(r.doc_id for r in left.collect()) == wanted


def test_nulls_and_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.limit(30).unionByName(spark.createDataFrame([(900_000, None, None, None, None), (None, "", "en", "s", 0), (900_001, "", None, None, None)], docs.schema))
    for name, stage in P.STAGES:
        assert stage(spark, odd, DATA).count() >= 1, name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name


def test_rows_that_share_a_doc_id_are_judged_by_their_texts(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").where("length(text) > 60").first().text
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(1, item), (1, "a clean text of its own that nobody else has"), (2, base), (2, base + " more"), (3, base), (None, item), (None, "another clean text"), (4, "last")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", True, 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, kept boolean, n bigint")
    left = P.drop_contaminated(spark, docs, DATA)
    assert left.columns == docs.columns and item not in {r.text for r in left.collect()} and left.count() == 6
    left = P.drop_near_copies(spark, docs, DATA)
    texts = [r.text for r in left.collect()]
    assert left.columns == docs.columns and sum(t.startswith("word0") for t in texts) in (1, 2) and len({t for t in texts if t.startswith("word0")}) == 1
    assert {item, "a clean text of its own that nobody else has", "another clean text", "last"} <= set(texts)
    left = P.drop_exact_copies(spark, docs, DATA)
    assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == sorted({t for _, t in rows})


def test_of_similar_documents_the_least_doc_id_stays(spark):
    base = [f"word{i}" for i in range(200)]
    docs = spark.createDataFrame([(k, " ".join([*base[:150], f"x{k}", *base[151:]]), "en", "s", 1) for k in (9, 4, 6)] + [(5, "other", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in P.drop_near_copies(spark, docs, DATA).collect()) == [4, 5]


def test_every_operator_is_registered():
    assert [sum(n.startswith(f"op{k}_") for n in queries()) for k in range(1, 14)] == [1] * 13


def test_columns_of_any_name_pass_through(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    names = ["__text", "__row", "row", "__sha", "sha", "keep", "of", "place", "score", "bad", "TEXT_", "component_id"]
    odd = docs.withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id")) for n in names}).unionByName(docs.limit(3).withColumns({n: F.lit("again") for n in names}))
    for name, stage in P.STAGES[:-1]:
        left = stage(spark, odd, DATA)
        assert left.columns == odd.columns, name
        rows = left.collect()
        assert len(rows) > 20 and all(r[n] in (f"{n} of {r.doc_id}", "again") for r in rows for n in names), name
    assert P.encode(spark, odd, DATA).count() == odd.count()


def test_kept_columns_named_like_scratch_columns(spark):
    docs = spark.createDataFrame([(1, "the oil pump", "x", 1)], "doc_id bigint, text string, __text string, _text int")
    keep = ("doc_id", "text", "__text", "_text")
    assert bpe.encode_documents(docs, vocabulary(), keep=keep).first()["__text"] == "x"
    model = langid.fit(docs.withColumn("lang", F.lit("en")))
    assert langid.identify(docs, model, keep).first()["_text"] == 1


def test_a_run_leaves_its_result_only(spark):
    folder = Path(shared_dir(spark).removeprefix("file://")) / "leafmill"
    before = set(folder.glob("*"))
    result = P.run(spark, DATA)
    left = set(folder.glob("*")) - before
    assert len(left) == 1 and result.count() > 100 and result.inputFiles()[0].removeprefix("file://").startswith(str(left.pop()))
