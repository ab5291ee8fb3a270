"""The registered queries of the numbered operators; each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm import alignment, curves, debruijn, decontam, langid, nndescent, pieces, pii, quality, shards, simhash, suffixes, variants
from ticketloom.llm.common import utf8

QUALITY_CUT = 0.3
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def registered(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@registered
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), "doc_id", "text", shingle=3, distance=2)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits().alias("fingerprint"), "component_id")


@registered
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shuffle_into_shards(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text", shards=8)
    return placed.select("doc_id", "size", F.crc32(utf8(F.col("text"))).alias("text_crc32"), "law", "shard", "slot", "grown_shard")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_model() -> str:
    return tokenizer("piece_bpe_32k.model")


@registered
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.with_pieces(documents(spark, sf_dir).select("doc_id", "text"), "text", piece_model())
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@registered
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.contamination(documents(spark, sf_dir).select("doc_id", "text"), items)
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@registered
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    base = pii.base_spans(F.col("spans"))
    counts = [F.size(pii.base_spans(F.col("spans"), kind)).cast("bigint").alias(f"n_{kind}") for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@registered
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = langid.fit(docs)
    found = langid.with_language(docs.select("doc_id", "text"), net)
    return found.select("doc_id", quality.in_fold("doc_id", 2, 4).alias("held_out"), "lang_pred", "score")


@registered
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.with_score(docs, model)
    return scored.select(
        "doc_id", quality.in_fold("doc_id").alias("held_out"), "score",
        F.when(F.col("score") >= QUALITY_CUT, 1).otherwise(0).alias("predicted"),
    )


@registered
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = debruijn.without_repeats(documents(spark, sf_dir), width=20)
    return cleaned.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@registered
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffixes.without_copies(documents(spark, sf_dir), width=200)
    return cleaned.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@registered
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nndescent.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.95)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


@registered
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(documents(spark, sf_dir).select("doc_id", "text"))


@registered
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = alignment.align(docs, "doc_id", "text", tokenizer("byte_bpe_50k.json"), piece_model()).documents
    return found.withColumnRenamed("id", "doc_id")


@registered
def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = curves.nearest(vectors, "vec_id", "embedding", F.col("vec_id") % 100 == 0, k=10)
    return found.withColumnRenamed("id", "vec_id")
