"""From raw documents to token ids: five stages of ``leafmill.llm``.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the
documents that go on, with all their columns; the last one returns the encoded rows.

Defined cases: each stage treats nulls, empty texts, repeated rows and empty tables as
its operator says.  Rows that share a doc_id are documents of their own where their texts
differ: the near-duplicate and the decontamination stage judge every text by itself; of
similar texts the one with the least doc_id stays, and any one where doc_ids are repeated or
missing.  Extra columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bpe, decontam, exactdup, quality, simhash
from leafmill.llm.common import documents, free_name, removed, scratch, written
from leafmill.llm.queries import vocabulary

#: Of two texts of the near-duplicate stage: words of a shingle, least similarity.
WORDS, SIMILARITY = 5, 0.8


def with_row_ids(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column of a free name: doc_id where it names one row, else a hash of doc_id and text."""
    name = free_name("row", docs.columns)
    unique = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty()
    return docs.withColumn(name, F.col("doc_id").cast("bigint") if unique else F.xxhash64("doc_id", "text")), name


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_documents(docs, model)
    return scored.where(F.col(scored.columns[-1]) >= quality.THRESHOLD).select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return exactdup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar texts one document stays, the one with the least doc_id."""
    rows, row = with_row_ids(docs)
    found = simhash.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), words=WORDS, similarity=SIMILARITY)
    stay = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(row))
    return rows.join(stay, row, "left_semi").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    rows, row = with_row_ids(docs)
    found = decontam.contaminated(rows.select(F.col(row).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(found.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digests of the round trip."""
    return bpe.encode_documents(docs, vocabulary(), outputs=("n_tokens", "token_ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality classifier", classify_quality),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("bpe encoding", encode),
]

#: Nearest neighbours, components and merges of BPE are not SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage, as a written table; all other tables of the run are deleted."""
    docs, before = documents(spark, sf_dir), []
    for number, (_, stage) in enumerate(STAGES):
        with scratch(spark) as made:
            docs = written(stage(spark, docs, sf_dir), f"stage{number}")
        removed(spark, *made[:-1], *before)  # what the stage has left, and its input
        before = made[-1:]
    return docs
