"""A corpus pipeline over ``documents``: each stage calls one operator and works on what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm import decontam, pieces, pii, quality, queries, simhash
from ticketloom.llm.common import column, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents under names that no operator gives a column, and which name each column has.

    So whatever the columns of ``documents`` are called, none meets a result of the same name.
    """
    names = {c: f"_column_{i}" for i, c in enumerate(docs.columns)}
    return docs.select([column(c).alias(n) for c, n in names.items()]), names


def _back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select([F.col(n).alias(c) for c, n in names.items()])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go.

    A null or empty text is scored like any other, rows that repeat an id each
    for itself. Without labelled rows every text scores one half and stays.
    """
    model = quality.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, names = _plain(docs)
    scored = quality.with_score(plain, model, names["text"], into="score")
    return _back(scored.where(F.col("score") >= queries.QUALITY_CUT), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    Texts without words (null ones too) are one group; of rows that repeat the
    smallest id one stays; null ids go before known ones.
    """
    plain, names = _plain(docs)
    found = simhash.near_duplicates(plain, names["doc_id"], names["text"], shingle=3, distance=2, keep=tuple(names.values()))
    return _back(found.where("first"), names)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; a null or empty text holds none, and an empty benchmark takes nothing."""
    plain, names = _plain(docs)
    found = decontam.contamination(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), names["doc_id"], names["text"])
    return _back(found.where("n_hit = 0"), names)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its personal data is replaced by kinds in brackets, and n_chars follows the new text.

    A null text stays null, with the n_chars it had.
    """
    plain, names = _plain(docs)
    clean = _back(pii.redacted(pii.personal_data(plain, names["doc_id"], names["text"]), names["text"]), names)
    length = F.coalesce(F.length("text"), F.col("n_chars")) if "n_chars" in docs.columns else None
    return clean.select([length.cast(t).alias(c) if c == "n_chars" else column(c) for c, t in docs.dtypes])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to; a null text has no ids and decodes to an empty one."""
    coded = pieces.with_pieces(docs.select("doc_id", "lang", "source", "text"), "text", queries.piece_model())
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("PII", without_personal_data),
    ("SentencePiece", tokens),
]

#: SQL has no zstandard, XXH64 bits or piece merges.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES):
            docs = stored(docs, f"pipeline-{at}")
    return docs
