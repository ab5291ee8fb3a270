"""Tickets that arrive more than once or late: decided once, written back once a batch.

``root/decisions``, ``root/late`` and ``root/ledger`` have a folder per batch id. Every
step of a batch can be done again with the same result, and the ledger entry
comes last: a batch that died half-way is repeated as a whole, a batch that the
ledger names changes nothing when it is replayed.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ticketloom import vocab
from ticketloom.operators.routing import DECISION_COLUMNS, decision_updates, route_tickets
from ticketloom.sources import store
from ticketloom.sources.picks import rules_context
from ticketloom.vocab import DEFAULTS, Thresholds

LEDGER = "batch_id bigint, newest timestamp_ntz, arrived bigint, late bigint, repeated bigint, decided bigint"


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """One row per batch that is done."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{root}/ledger/*")
    except AnalysisException:  # no batch yet
        return spark.createDataFrame([], LEDGER)


def _kept(frame: DataFrame, path: str) -> DataFrame:
    """The rows as files of this batch, in place of what an earlier attempt left."""
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def take_batch(
    batch: DataFrame, batch_id: int, customers: DataFrame, orders: DataFrame, root: str, delay: str, sent_at: str = "sent_at",
    table: str | None = None, run_at: datetime | None = None, limits: Thresholds = DEFAULTS,
) -> None:
    """Decide the tickets of one batch that are neither late nor taken before.

    The watermark is the newest ``sent_at`` of earlier batches less ``delay`` (an
    interval such as '2 DAY'). Rows before it, and rows without a time, go to
    ``root/late``. Of a ticket that is in the batch twice the earliest counts; one
    that a batch within the delay took is left out. Only ids of batches that
    reach past the watermark are read for that, so what is looked at does not
    grow with the life of the stream.

    With ``table`` (see ``store``) the decisions are written back as version
    ``batch-<id>``, behind the owner gate.
    """
    spark = batch.sparkSession
    done = ledger(spark, root)
    if not done.where(F.col("batch_id") == batch_id).isEmpty():
        return
    earlier = done.where(F.col("batch_id") < batch_id)
    edge = earlier.agg(F.max("newest").alias("newest")).select("newest", F.expr(f"newest - INTERVAL {delay}").alias("watermark")).first()
    since = F.lit(edge.watermark).cast("timestamp_ntz")
    on_time = F.coalesce(F.col(sent_at) >= F.coalesce(since, F.col(sent_at)), F.lit(False))
    rows = _kept(batch.withColumn("_on_time", on_time), f"{root}/work/{batch_id}")
    _kept(rows.where("NOT _on_time").drop("_on_time"), f"{root}/late/{batch_id}")
    fresh = rows.where("_on_time").drop("_on_time")
    rest = [c for c in fresh.columns if c != "ticket_id"]
    # The whole row breaks ties of the time, so that every attempt takes the same one.
    once = fresh.groupBy("ticket_id").agg(F.min(F.struct(F.col(sent_at).alias("_first"), *rest)).alias("_row")).select("ticket_id", "_row.*").drop("_first")
    recent = [r[0] for r in earlier.where(F.col("newest") >= since).select("batch_id").collect()]
    if recent:
        seen = spark.read.parquet(*[f"{root}/taken/{b}" for b in recent]).select("ticket_id")
        once = once.join(seen, "ticket_id", "left_anti")
    taken = _kept(once, f"{root}/taken/{batch_id}")
    decided = route_tickets(rules_context(taken, customers, orders), limits).select("ticket_id", *DECISION_COLUMNS)
    decided = _kept(decided, f"{root}/decisions/{batch_id}")
    if table is not None:
        now = F.lit(run_at or datetime.now()).cast("timestamp_ntz")
        try:
            store.write_back(spark, table, decision_updates(decided, now), vocab.ROUTING_COLUMNS, now, f"batch-{batch_id}", orders)
        except store.NameTaken:
            pass  # an earlier attempt at this batch came as far as this
    counts = rows.agg(F.max(sent_at).alias("newest"), F.count(F.lit(1)).alias("arrived"), F.count_if(~F.col("_on_time")).alias("late"))
    numbers = {"taken": taken.count(), "decided": decided.count()}
    entry = counts.select(
        F.lit(batch_id).cast("bigint").alias("batch_id"), F.greatest("newest", F.lit(edge.newest).cast("timestamp_ntz")).alias("newest"), "arrived", "late",
        (F.col("arrived") - F.col("late") - F.lit(numbers["taken"])).cast("bigint").alias("repeated"), F.lit(numbers["decided"]).cast("bigint").alias("decided"),
    )
    entry.coalesce(1).write.mode("overwrite").parquet(f"{root}/ledger/{batch_id}")


def start_intake(
    tickets: DataFrame, customers: DataFrame, orders: DataFrame, root: str, checkpoint: str, *, delay: str, sent_at: str = "sent_at",
    table: str | None = None, run_at: datetime | None = None, limits: Thresholds = DEFAULTS,
) -> StreamingQuery:
    """Takes what has arrived, batch by batch, and stops; see ``take_batch``. Late tickets are under ``root/late``."""

    def take(batch: DataFrame, batch_id: int) -> None:
        take_batch(batch, batch_id, customers, orders, root, delay, sent_at, table, run_at, limits)

    return tickets.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
