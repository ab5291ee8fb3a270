"""Two-pass external shuffle into shards, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.common import column, sized, stored, utf8

BUCKET_BYTES = 8 << 20


def shard_of(key: str, shards: int, seed: int) -> F.Column:
    """Shard of a key by rendezvous: the shard whose hash with the key is highest.

    Key and shard count alone decide. One more shard adds one more bid, so rows
    move into the new shard only. A null key bids like a value of its own.
    """
    bids = [
        F.struct(F.xxhash64(F.lit(seed), F.lit(i), F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("bid"), F.lit(i).alias("shard"))
        for i in range(shards)
    ]
    return (F.greatest(*bids) if shards > 1 else bids[0])["shard"]


def shuffle_into_shards(
    df: DataFrame, id_column: str, text_column: str, shards: int = 8, seed: int = 7, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """The rows with ``shard, slot, grown_shard, size, law``, shuffled inside each shard.

    Law ``key``: the id and the shard count decide the shard; ``grown_shard`` is
    the shard when there is one more. Pass one scatters the rows by seeded hash
    into buckets of about ``bucket_bytes`` of text, one task a bucket; pass two
    shuffles each bucket with Fisher-Yates and gives its rows gapless slots
    behind those of the shard's earlier buckets. A bucket is one task's memory;
    their number grows with the input, so for very large inputs ``bucket_bytes``
    should be what an executor core can hold.

    Size is the text's UTF-8 bytes plus 1 (null text: 1); texts of any length
    are rows like others. The seed, the ids and the texts fix the order, not
    the partitions of the input. Only rows that repeat id and text, which would
    all scatter to one bucket, also go by their place in the input, so however
    often a row is there its copies spread. Rows with one id share a shard. A null
    id is a value of its own. Columns of the same names in the input give way to
    the results.
    """
    made = {"shard", "slot", "grown_shard", "size", "law"}
    own = [c for c in df.columns if c.lower() not in made or c in (id_column, text_column)]
    text = utf8(column(text_column))
    rows = df.select(
        F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(own)]).alias("row"),
        F.coalesce(column(id_column).cast("string"), F.lit("null")).alias("name"), column(id_column).isNull().alias("unnamed"),
        column(id_column).alias("key"), F.xxhash64(text).alias("digest"), (F.octet_length(text).cast("bigint") + 1).alias("size"),
    )
    rows = rows.select(
        "row", "name", "unnamed", "digest", "size", shard_of("key", shards, seed).alias("shard"), shard_of("key", shards + 1, seed).alias("grown_shard")
    )
    rows = stored(rows.withColumn("place", F.monotonically_increasing_id()), "shards")
    totals = {r.shard: r.bytes for r in rows.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    buckets = [max(1, -(-totals.get(i, 0) // bucket_bytes)) for i in range(shards)]
    first = [sum(buckets[:i]) for i in range(shards)]

    def of_shard(values: list[int]) -> F.Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("shard") + 1)

    repeated = rows.groupBy("name", "unnamed", "digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    repeated = sized(stored(repeated.withColumn("repeats", F.lit(True)), "shards-repeats"))
    rows = rows.join(repeated, ["name", "unnamed", "digest"], "left").withColumn("copy", F.when(F.col("repeats"), F.col("place")).otherwise(0))
    rows = rows.withColumn("scatter", F.xxhash64(F.lit(seed), F.lit("bucket"), "name", "unnamed", "digest", "copy"))
    rows = rows.withColumn("bucket", (of_shard(first) + F.pmod("scatter", of_shard(buckets))).cast("int"))
    behind = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(behind), F.lit(0)).alias("before"))
    # As many partitions as buckets; which buckets meet in a task, and in what order, depends on their numbers alone,
    # so the shuffle draws the same numbers in every run.
    members = F.struct("scatter", "name", "unnamed", "digest", "copy", "size", "grown_shard", "row")
    gathered = (
        rows.repartition(sum(buckets), "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list(members)).alias("members"))
        .join(before, "bucket").sortWithinPartitions("bucket")
    )
    slots = gathered.select("shard", "before", F.posexplode(F.shuffle("members", F.lit(seed))).alias("at", "m"))
    return slots.select(
        *[F.col(f"m.row.c{i}").alias(c) for i, c in enumerate(own)],
        F.col("m.size").alias("size"), F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("before") + F.col("at")).cast("bigint").alias("slot"), F.col("m.grown_shard").cast("int").alias("grown_shard"),
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Each shard as files of its own folder ``shard=N``; within a file, rows are in slot order."""
    parts = shuffled.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot")
    parts.write.partitionBy("shard").parquet(path)
