"""Shared helpers: the workspace on shared storage, stored intermediate tables, free column names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def workspace(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one where it is unset in local mode, as in tests.

    On a cluster it must be set: a folder of the driver's machine is not there for the executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="ticketloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the workspace.

    Lineage ends here: a lost executor costs a reread, not a recomputation, and
    values that depend on the arrival order of rows are the same in every use.
    """
    path = f"{workspace(df.sparkSession)}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def forget(table: DataFrame) -> None:
    """Remove a table that ``stored`` made, once nothing reads it any more; rounds of a loop need only the last one."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the rows don't have yet (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a text; null: none."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def row_key(id_column: str, text_column: str) -> list[Column]:
    """What a row is joined back by: its id and a digest of its text, so rows that repeat an id stay apart."""
    return [column(id_column).alias("_id"), F.xxhash64(utf8(column(text_column))).alias("_digest")]


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Join condition on the row key; a null id equals a null id."""
    return a["_id"].eqNullSafe(b["_id"]) & (a["_digest"] == b["_digest"])


def sized(df: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """A stored table, marked for broadcast if its text columns' measured bytes stay within ``most_bytes``.

    A larger one is left as it is, and Spark joins it by shuffling.
    """
    weights = [
        F.coalesce(F.octet_length(column(c).cast("string")), F.lit(0)) if t in ("string", "binary") or t.startswith(("array", "struct")) else F.lit(8)
        for c, t in df.dtypes
    ]
    total = df.agg(F.sum(sum(weights, F.lit(16)).cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if total <= most_bytes else df


def materialized(df: DataFrame, **values: Column) -> DataFrame:
    """The rows with computed columns that later expressions read instead of computing them again.

    Projections are merged by the optimizer, which would put a costly expression
    into every place, lambdas included, that names it; a generator of one row stays.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in values.items()]))))
