"""Exact distinct counts of whole-number keys by bitmaps: 32,768 keys in 4 KB, mergeable, no key is shuffled by itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.operators.quality import finding


def bitmaps(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, bucket, bitmap, rows)`` of the keys that are not NULL: which keys of a bucket there are, and in how many rows.

    Tasks set bits and OR their bitmaps, so a hot key costs a bit. Made for keys
    that lie close, such as serial numbers; bitmaps of scattered keys would be
    nearly empty.
    """
    known = df.where(F.col(key).isNotNull())
    return known.groupBy(*by, F.bitmap_bucket_number(key).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bitmap"), F.count(F.lit(1)).alias("rows")
    )


def merged(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bitmaps of coarser groups, by OR."""
    return parts.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"), F.sum("rows").alias("rows"))


def distinct_counts(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, rows, keys)`` of bitmaps in which a bucket is there once per group."""
    return parts.groupBy(*by).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("keys")
    )


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """``(key, n)`` of keys in more than one row; NULL is a key here.

    Only buckets with more rows than keys are looked at key by key.
    """
    crowded = bitmaps(df, key).where(F.col("rows") > F.bitmap_count("bitmap")).select("bucket")
    rows = df.select(F.col(key).alias("key"))
    suspects = rows.where("key IS NOT NULL").withColumn("bucket", F.bitmap_bucket_number("key")).join(crowded, "bucket", "left_semi")
    missing = rows.where("key IS NULL")
    return suspects.select("key").union(missing).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def fact_grain(fact: DataFrame, tickets: DataFrame) -> DataFrame:
    """What ``quality.view_grain`` finds: repeated ticket ids in the fact view, and a row count that differs from the table's."""
    repeats = repeated_keys(fact, "ticket_id")
    dupes = finding(repeats, "ticket_grain_duplicates", F.coalesce(F.col("key").cast("string"), F.lit("NULL")), F.col("n"))
    rows = fact.agg(F.count(F.lit(1)).alias("view_rows")).withColumn("ticket_rows", tickets.agg(F.count(F.lit(1))).scalar())
    shown = F.concat(F.col("view_rows").cast("string"), F.lit(" <> "), F.col("ticket_rows").cast("string"))
    off = rows.where(F.col("view_rows") != F.col("ticket_rows"))
    return dupes.unionByName(finding(off, "ticket_grain_row_count_mismatch", F.lit("vw_ticket_analytics"), shown))
