"""Reading the five tables: CSV, Parquet, JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.schemas import KEYS, TABLES


#: Tables with free text, whose quoted fields may hold line breaks.
TEXT_TABLES = ("tickets",)


def read_csv(spark: SparkSession, path: str, table: str, *, line_breaks: bool | None = None) -> DataFrame:
    """One CSV (or a directory of them) with header; fails on malformed rows.

    An empty field is NULL; a quoted empty string reads as NULL too. With
    ``line_breaks`` (by default for tables with free text) quoted fields may
    span lines; a file is then read by one task, so large data comes in many files.
    """
    if line_breaks is None:
        line_breaks = table in TEXT_TABLES
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in TABLES[table].fields])
    return spark.read.schema(schema).csv(
        path, header=True, nullValue="", mode="FAILFAST", enforceSchema=False, quote='"', escape='"', multiLine=line_breaks
    )


def read_csv_directory(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    return {table: read_csv(spark, f"{directory}/{table}.csv", table) for table in TABLES}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc(
    spark: SparkSession, url: str, table: str, *, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """Database table read in parallel ranges of its key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    return (
        reader.option("partitionColumn", KEYS[table])
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
        .load()
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, row_count)`` for each table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    whole = counts[0]
    for c in counts[1:]:
        whole = whole.unionByName(c)
    return whole
