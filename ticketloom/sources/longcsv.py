"""CSV whose quoted fields hold line breaks, read by as many tasks as the files have splits.

Spark reads such a file in one task, since a line break alone does not tell
whether a record ends. Here the quotes of every split are counted first: with
the quotes of the splits before it, each split knows whether it begins inside
a field. Then each split puts its own records together; only the pieces of
records that cross a split, two a split at most, are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.schemas import TABLES

KIND = pa.schema([("file", pa.string()), ("block", pa.int64()), ("kind", pa.string()), ("record", pa.string())])
#: What a split holds of a record: all of it, its first lines, its last ones, or lines in between.
WHOLE, HEAD, TAIL, MIDDLE = "whole", "head", "tail", "middle"


def records(batches: Iterator[pa.RecordBatch], header: str) -> Iterator[pa.RecordBatch]:
    """The records of each split, and its pieces of records that cross into another split; header lines are checked and left out."""
    now, lines, inside, begun = None, [], False, False
    made: list[tuple[str, int, str, str]] = []

    def closed(kind: str) -> None:
        made.append((*now, kind, "\n".join(lines)))
        lines.clear()

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist([dict(zip(KIND.names, m, strict=True)) for m in made], KIND)
        made.clear()
        return batch

    for batch in batches:
        for file, block, value, opens in zip(*[batch.column(n).to_pylist() for n in ("file", "block", "value", "opens")], strict=True):
            if (file, block) != now:
                if lines:
                    closed(HEAD if begun else MIDDLE)
                now, inside, begun = (file, block), opens, not opens
                if block == 0:
                    if value.rstrip("\r").lstrip("﻿") != header:
                        raise ValueError(f"the header of {file} is not {header}")
                    continue
            lines.append(value)
            if value.count('"') % 2:
                inside = not inside
            if inside:
                continue
            if lines == [""] or lines == ["\r"]:
                lines.clear()
            else:
                closed(WHOLE if begun else TAIL)
            begun = True
        if made:
            yield flushed()
    if lines:
        closed(HEAD if begun else MIDDLE)
    if made:
        yield flushed()


def split_records(spark: SparkSession, path: str, header: str) -> DataFrame:
    """``(record)``: the text of every record of the files under a path; a file without a closing quote is an error."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").toDF("value", "file", "block")
    quotes = F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    splits = lines.groupBy("file", "block").agg(quotes.alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opens = splits.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("opens"))
    # One row a split: a thousand for every 128 GB of text.
    known = lines.join(F.broadcast(opens), ["file", "block"])
    found = known.mapInArrow(lambda it: records(it, header), "file string, block bigint, kind string, record string")
    pieces = found.where(F.col("kind") != WHOLE)
    upto = Window.partitionBy("file").orderBy("block", F.when(F.col("kind") == HEAD, 1).otherwise(0))
    owned = pieces.withColumn("of", F.last(F.when(F.col("kind") == HEAD, F.col("block")), ignorenulls=True).over(upto))
    joined = owned.groupBy("file", "of").agg(
        F.sort_array(F.collect_list(F.struct("block", "record"))).alias("parts"), F.count_if(F.col("kind") == TAIL).alias("ends")
    )
    text = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
    whole = joined.select(F.when(F.col("ends") == 1, text).otherwise(F.raise_error(F.concat(F.lit("a quote is not closed in "), "file"))).alias("record"))
    return found.where(F.col("kind") == WHOLE).select("record").union(whole)


def read_long_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One of the five tables from CSV with header, as ``tables.read_csv`` reads it, without its one task a file.

    An empty field is NULL; malformed rows fail. Line breaks inside fields stay as they are.
    """
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in TABLES[table].fields])
    rows = split_records(spark, path, ",".join(schema.names))
    options = {"mode": "FAILFAST", "nullValue": "", "quote": '"', "escape": '"'}
    return rows.select(F.from_csv(F.rtrim("record", F.lit("\r")), schema.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("r.*")
