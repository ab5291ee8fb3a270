"""Column-scoped write-back and all-or-nothing publication.

Parquet tables are not updated in place. A write-back is a left join of the
tickets with the update rows that may change the owned columns only; its
result goes to a new snapshot directory, which readers see once the manifest
names it. A run that dies half-way leaves the old snapshot current.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ticketloom.operators.joins import quarantine_reasons, split_by_owner
from ticketloom.operators.quality import RowCheck

MANIFEST = "_current"


@dataclass(frozen=True)
class Settled:
    """One row ``(ticket_id, _new)`` per ticket whose updates agree, and one per ticket whose updates don't.

    greatest: the greatest update of every ticket, whether they agree or not.
    """

    clean: DataFrame
    clashing: DataFrame
    greatest: DataFrame


def settle(updates: DataFrame, owned: Sequence[str]) -> Settled:
    """Updates brought to one per ticket; updates that repeat each other are one, those that contradict each other go to ``clashing``.

    clashing: ``(ticket_id, n, least, greatest)``, the two extremes of the owned
    columns as JSON. Least and greatest are combined in each task before the
    shuffle, which is the one that the join by ticket needs anyway. Updates
    without a ticket id are neither.
    """
    extra = set(updates.columns) - {"ticket_id", *owned}
    if extra:
        raise ValueError(f"columns not owned by this write-back: {sorted(extra)}")
    new = F.struct(*owned)
    one = updates.where(F.col("ticket_id").isNotNull()).groupBy("ticket_id").agg(
        F.min(new).alias("_new"), F.max(new).alias("_other"), F.count(F.lit(1)).alias("n")
    )
    agree = F.col("_new").eqNullSafe(F.col("_other"))
    clashing = one.where(~agree).select("ticket_id", "n", F.to_json("_new").alias("least"), F.to_json("_other").alias("greatest"))
    return Settled(one.where(agree).select("ticket_id", "_new"), clashing, one.select("ticket_id", F.col("_other").alias("_new")))


def overlaid(tickets: DataFrame, settled: DataFrame, owned: Sequence[str], updated_at: Column) -> DataFrame:
    """Tickets with the owned columns, and ``updated_at``, taken from their one settled update."""
    return tickets.join(settled, "ticket_id", "left").select(*overlay_columns(tickets, owned, updated_at))


def overlay_columns(tickets: DataFrame, owned: Sequence[str], updated_at: Column) -> list[Column]:
    """The columns of the tickets, where a row has ``_new`` beside them."""
    matched = F.col("_new").isNotNull()
    columns = []
    for name in tickets.columns:
        if name in owned:
            kind = tickets.schema[name].dataType
            columns.append(F.when(matched, F.col(f"_new.{name}").cast(kind)).otherwise(F.col(name)).alias(name))
        elif name == "updated_at":
            columns.append(F.when(matched, updated_at).otherwise(F.col(name)).alias(name))
        else:
            columns.append(F.col(name))
    return columns


def apply_overlay(
    tickets: DataFrame, updates: DataFrame, owned: Sequence[str], updated_at: Column, orders: DataFrame | None = None, clashing: str = "greatest"
) -> DataFrame:
    """Tickets with the owned columns taken from the matching update row.

    ``updates`` is ``(ticket_id, *owned)``. Every other column keeps its value,
    but ``updated_at``, which is set on matched rows. An update may set a
    column to NULL. Rows are never added. Of updates for one ticket that
    contradict each other the ``greatest`` by the owned columns in order applies
    (NULL is the least), or with ``leave`` none: runs use that, and ``settle``
    and ``store.write_back`` return such updates. With ``orders`` tickets that
    fail the owner gate stay as they are.
    """
    settled = settle(updates, owned)
    chosen = {"greatest": settled.greatest, "leave": settled.clean}[clashing]
    if orders is not None:
        keys = tickets.select("ticket_id", "order_id", "customer_id").join(chosen.select("ticket_id"), "ticket_id", "left_semi")
        chosen = chosen.join(split_by_owner(keys, orders).quarantine.select("ticket_id"), "ticket_id", "left_anti")
    return overlaid(tickets, chosen, owned, updated_at)


def is_live(config_live: bool, live: bool) -> bool:
    """A write needs both the configuration and the caller to say live."""
    return config_live and live


def publish(df: DataFrame, root: str, version: str, *, config_live: bool, live: bool) -> DataFrame:
    """Write ``df`` as snapshot ``version`` under ``root`` and make it current.

    Without both live flags nothing is written and the frame comes back as is.
    """
    if not is_live(config_live, live):
        return df
    stage_snapshot(df, root, version)
    return make_current(df.sparkSession, root, version)


def stage_snapshot(df: DataFrame, root: str, version: str) -> DataFrame:
    """Write the snapshot without making it current, e.g. to run the checks on it. A version that is there is refused, never replaced."""
    df.write.mode("errorifexists").parquet(f"{root}/snapshot={version}")
    return df.sparkSession.read.parquet(f"{root}/snapshot={version}")


def set_current(spark: SparkSession, root: str, version: str) -> None:
    """Add a manifest entry with the next number. Earlier entries stay, so readers and a crash find the old or the new one."""
    latest = _latest(spark, root)
    entry = spark.createDataFrame([(latest[0] + 1 if latest else 1, version)], "number long, version string")
    entry.coalesce(1).write.mode("append").json(f"{root}/{MANIFEST}")


def _entries(spark: SparkSession, root: str) -> DataFrame | None:
    """The manifest; None before its first entry."""
    fs, path = place(spark, f"{root}/{MANIFEST}")
    return spark.read.schema("number long, version string").json(f"{root}/{MANIFEST}") if fs.exists(path) else None


def place(spark: SparkSession, path: str):
    """The file system that a path lies on, and the path on it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def _latest(spark: SparkSession, root: str) -> tuple[int, str] | None:
    entries = _entries(spark, root)
    if entries is None:
        return None
    row = entries.orderBy(F.col("number").desc(), F.col("version").desc()).first()
    return (row["number"], row["version"]) if row else None


def current_version(spark: SparkSession, root: str) -> str:
    latest = _latest(spark, root)
    if latest is None:
        raise ValueError(f"no snapshot is current under {root}")
    return latest[1]


def make_current(spark: SparkSession, root: str, version: str) -> DataFrame:
    set_current(spark, root, version)
    return read_current(spark, root)


def read_current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/snapshot={current_version(spark, root)}")


def read_tables(spark: SparkSession, root: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The reloaded tables, all at the one version that the root's manifest names."""
    version = current_version(spark, root)
    return {name: spark.read.parquet(f"{root}/{name}/snapshot={version}") for name in names}


def gated(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with the owner gate in front: tickets that it stops become the table ``tickets_quarantine``, with ``reason``."""
    split = split_by_owner(tables["tickets"], tables["orders"])
    return tables | {"tickets": split.accepted, "tickets_quarantine": quarantine_reasons(split.quarantine, tables["orders"])}


@dataclass(frozen=True)
class Staged:
    """tables: what was written. counts: per table ``rows`` and, by name, how many rows fail each check."""

    tables: dict[str, DataFrame]
    counts: dict[str, dict[str, int]]

    def failures(self) -> dict[str, dict[str, int]]:
        return {t: bad for t, c in self.counts.items() if (bad := {n: k for n, k in c.items() if k and n != "rows"})}


class LoadRefused(ValueError):
    """Rows that fail checks; nothing became current and nothing stays staged."""

    def __init__(self, failures: dict[str, dict[str, int]]):
        super().__init__(f"the staged tables violate the checks; the current snapshot is unchanged: {failures}")
        self.failures = failures


def stage_checked(
    tables: dict[str, DataFrame], root: str, version: str, checks: Mapping[str, Sequence[RowCheck]], *, over: bool = False
) -> Staged:
    """Write every table and count its rows and failed row checks in the same pass, by metrics observed on the write.

    ``over`` replaces what an earlier attempt at this version left.
    """
    staged, counts = {}, {}
    for name, df in tables.items():
        seen = Observation(f"load {name}")
        failed = [F.count_if(F.coalesce(F.expr(c.bad), F.lit(False))).alias(c.name) for c in checks.get(name, ())]
        path = f"{root}/{name}/snapshot={version}"
        mode = "overwrite" if over else "errorifexists"
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *failed).write.mode(mode).parquet(path)
        staged[name], counts[name] = df.sparkSession.read.parquet(path), dict(seen.get)
    return Staged(staged, counts)


def _remove(spark: SparkSession, paths: Sequence[str]) -> None:
    for p in paths:
        fs, target = place(spark, p)
        fs.delete(target, True)


def _made(spark: SparkSession, root: str, version: str) -> bool:
    """Whether the version was ever current."""
    entries = _entries(spark, root)
    return entries is not None and not entries.where(F.col("version") == version).isEmpty()


def load_checked(
    spark: SparkSession, tables: dict[str, DataFrame], root: str, version: str, checks: Mapping[str, Sequence[RowCheck]],
    between: Callable[[dict[str, DataFrame]], DataFrame] | None = None, gate: bool = False,
) -> Staged:
    """Full reload, all or nothing, that can be repeated after a refusal or a crash.

    Each table is read once: the write that stages it also counts its rows and
    failed row checks. ``between`` may check the staged tables against each
    other. If anything fails, what was staged is removed and ``LoadRefused``
    tells the counts; the same version can then be loaded again. A version that
    was current is never written over. With ``gate`` see ``gated``.
    """
    tables = gated(tables) if gate else tables
    if _made(spark, root, version):
        raise ValueError(f"version {version} is there already")
    staged = stage_checked(tables, root, version, checks, over=True)
    failures = staged.failures()
    if not failures and between is not None and not (found := between(staged.tables)).isEmpty():
        failures = {"between tables": {r["check_name"]: r["count"] for r in found.groupBy("check_name").count().collect()}}
    if failures:
        _remove(spark, [f"{root}/{name}/snapshot={version}" for name in tables])
        raise LoadRefused(failures)
    set_current(spark, root, version)
    return Staged(read_tables(spark, root, list(tables)), staged.counts)


def reload_tables(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    root: str,
    version: str,
    check: Callable[[dict[str, DataFrame]], DataFrame] | None = None,
    gate: bool = False,
) -> dict[str, DataFrame]:
    """Full reload of all tables, all or nothing. ``load_checked`` can be repeated under the same version.

    Every table is staged first. ``check`` gets the staged tables and returns
    a frame of violations; if it has any row, no table becomes current. One
    manifest entry then switches all tables at once; see ``read_tables``. With
    ``gate`` see ``gated``.
    """
    tables = gated(tables) if gate else tables
    staged = {name: stage_snapshot(df, f"{root}/{name}", version) for name, df in tables.items()}
    if check is not None and not check(staged).isEmpty():
        raise ValueError("the staged tables violate the checks; the current snapshot is unchanged")
    set_current(spark, root, version)
    return read_tables(spark, root, list(tables))
