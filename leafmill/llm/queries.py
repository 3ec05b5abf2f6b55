"""The thin ``opN_<name>`` queries: contract columns from the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import bucket4, documents


def op1_patience_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import licenses

    return licenses.license_finds(documents(spark, sf_dir))


def op2_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import unigram

    return unigram.token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"))


def op3_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import chat

    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id bigint, turn bigint, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.expand(rows))


def op4_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import decontam

    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import exactdup

    return exactdup.exact_duplicates(documents(spark, sf_dir)).drop("locator")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import suffixes

    found = suffixes.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import simhash

    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import quality

    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = quality.score_documents(docs, model, ["doc_id"])
    return found.select("doc_id", (bucket4(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer file; the path is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import bpe

    return bpe.encode_documents(documents(spark, sf_dir), vocabulary(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op10_ecoc_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import langid

    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", (bucket4(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import alignment

    found = alignment.align_corpus(documents(spark, sf_dir), vocabulary(), vocabulary("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import codebooks

    found, books = codebooks.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("codebooks_sha256", F.lit(codebooks.digest(books)))


def op13_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm import packing

    return packing.pack(documents(spark, sf_dir), vocabulary())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from leafmill.llm import codebooks, exactdup

    return {"op5_exact_dedup": exactdup.ORACLE_SQL, "op12_vector_codes": codebooks.oracle_sql()}
