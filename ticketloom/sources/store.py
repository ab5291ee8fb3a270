"""A ticket table in id ranges, of which a write-back rewrites only those that hold an update.

``root/data/<attempt>/_part=N`` holds the rows whose id falls into range N, as one
attempt wrote them. ``root/versions/<number>`` lists, for one version, the attempt
that each range comes from. An attempt that dies leaves files that no version
names: the call can be repeated. A number is claimed by creating a file that
must not exist, so of two writers one fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketloom.operators.joins import quarantine_reasons, split_by_owner
from ticketloom.sources.snapshots import overlay_columns, place, settle

IDS_PER_PART = 1_000_000
PART = "_part"
REJECTED = "ticket_id bigint, reason string, detail string"


@dataclass(frozen=True)
class Version:
    """number counts the versions; parts names each range's attempt; ids_per_part is fixed by the first version."""

    number: int
    name: str
    ids_per_part: int
    parts: dict[int, str]


@dataclass(frozen=True)
class WriteBack:
    """version: what is current now, before: what was. rewritten: the ranges that were written.

    rejected: updates that were not applied, and why. applied: ``(ticket_id, _new)``, the updates of the tickets that changed.
    """

    version: Version
    before: Version
    rewritten: list[int]
    rejected: DataFrame
    applied: DataFrame
    owned: Sequence[str]
    updated_at: Column


class VersionTaken(ValueError):
    """Another writer made a version from the same state, or there is a table already."""


class NameTaken(VersionTaken):
    """A version of that name is there already."""


def _part(ids_per_part: int) -> Column:
    return F.floor(F.col("ticket_id") / F.lit(ids_per_part)).cast("int")


def _listed(spark: SparkSession, path: str) -> list[str]:
    fs, folder = place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def _versions(spark: SparkSession, root: str) -> dict[int, str]:
    """Number and name of the versions that were written whole, in order."""
    found = {}
    for entry in _listed(spark, f"{root}/versions"):
        number, _, name = entry.partition(".")
        if "_SUCCESS" in _listed(spark, f"{root}/versions/{entry}"):
            found[int(number)] = name
    return dict(sorted(found.items()))


def current(spark: SparkSession, root: str) -> Version | None:
    """The last version that was written whole."""
    versions = _versions(spark, root)
    if not versions:
        return None
    number, name = next(reversed(versions.items()))
    rows = spark.read.schema("ids_per_part long, part int, attempt string").json(f"{root}/versions/{number}.{name}").collect()
    return Version(number, name, rows[0].ids_per_part, {r.part: r.attempt for r in rows if r.part is not None})


def _switch(spark: SparkSession, root: str, version: Version) -> None:
    """Make the version current: one row per range, a list as long as there are ranges."""
    fs, claim = place(spark, f"{root}/claims/{version.number}")
    if not fs.createNewFile(claim):
        raise VersionTaken(f"version {version.number} of {root} is made by another writer; read the table again and repeat")
    rows = [(version.ids_per_part, p, a) for p, a in sorted(version.parts.items())] or [(version.ids_per_part, None, None)]
    entry = spark.createDataFrame(rows, "ids_per_part long, part int, attempt string")
    entry.coalesce(1).write.mode("errorifexists").json(f"{root}/versions/{version.number}.{version.name}")


def release_claims(spark: SparkSession, root: str) -> list[int]:
    """Numbers that a writer claimed and never made a version of, given back. Only while nobody writes."""
    made, freed = _versions(spark, root), []
    for number in map(int, _listed(spark, f"{root}/claims")):
        if number not in made:
            fs, claim = place(spark, f"{root}/claims/{number}")
            fs.delete(claim, False)
            freed.append(number)
    return freed


def _by_range(rows: DataFrame, ids_per_part: int) -> DataFrame:
    """The rows in the order of the files, with their range."""
    # One task a range: ranges are equally wide and ids are unique, so none is hot.
    return rows.withColumn(PART, _part(ids_per_part)).repartition(PART).sortWithinPartitions(PART, "ticket_id")


def _written(placed: DataFrame, root: str) -> tuple[str, list[int]]:
    """The rows as files of a new attempt, by range; and the ranges that there are."""
    attempt = uuid.uuid4().hex
    placed.write.partitionBy(PART).parquet(f"{root}/data/{attempt}")
    ranges = [n for n in _listed(placed.sparkSession, f"{root}/data/{attempt}") if n.startswith(f"{PART}=")]
    return attempt, sorted(int(n.partition("=")[2]) for n in ranges)


def _rewritten(old: DataFrame, settled: DataFrame, owned: Sequence[str], updated_at: Column, ids_per_part: int) -> DataFrame:
    """What ``overlaid`` gives, in the order of the files.

    Updates travel with the tickets and meet them where their range is sorted, so
    the table is shuffled once; a join by ticket would shuffle it for itself as well.
    """
    tickets = old.withColumns({"_new": F.lit(None).cast(settled.schema["_new"].dataType), "_is_ticket": F.lit(True)})
    both = tickets.unionByName(settled.withColumn("_is_ticket", F.lit(False)), allowMissingColumns=True)
    met = F.max("_new").over(Window.partitionBy(PART, "ticket_id"))
    placed = _by_range(both, ids_per_part).withColumn("_new", met).where("_is_ticket")
    return placed.select(*overlay_columns(old, owned, updated_at), PART)


def create(tickets: DataFrame, root: str, name: str, ids_per_part: int = IDS_PER_PART) -> Version:
    """The first version of a table; it needs a row at least, and ids that are unique and not null."""
    spark = tickets.sparkSession
    if current(spark, root) is not None:
        raise VersionTaken(f"there is a table under {root}")
    attempt, parts = _written(_by_range(tickets, ids_per_part), root)
    if not parts:
        raise ValueError("a table without rows has no ranges")
    version = Version(1, name, ids_per_part, {p: attempt for p in parts})
    _switch(spark, root, version)
    return version


def read(spark: SparkSession, root: str, version: Version | None = None, parts: Sequence[int] | None = None) -> DataFrame:
    """The table at a version (the current one by default), or some ranges of it."""
    version = version or current(spark, root)
    if version is None:
        raise ValueError(f"there is no table under {root}")
    wanted = [p for p in version.parts if parts is None or p in set(parts)]
    if not wanted:
        part, attempt = next(iter(version.parts.items()))
        return spark.read.parquet(f"{root}/data/{attempt}/{PART}={part}").where("false")
    # Files of a range hold all columns but the range, which their folder names.
    return spark.read.parquet(*[f"{root}/data/{version.parts[p]}/{PART}={p}" for p in sorted(wanted)])


def write_back(
    spark: SparkSession, root: str, updates: DataFrame, owned: Sequence[str], updated_at: Column, name: str, orders: DataFrame | None = None
) -> WriteBack:
    """A new version in which the updates are applied; ranges without an update keep their files.

    Rejected, with the reason and never applied: updates without a ticket id
    (``no_ticket_id``), for a ticket that is not there (``no_such_ticket``), that contradict
    another update of the ticket (``clashing_updates``), and, with ``orders``, of a ticket that
    the owner gate stops (``order_of_other_customer``, ``no_such_order``). They are kept
    under ``root/rejected`` by attempt.

    The driver reads the numbers of the touched ranges and nothing else of the
    data. The updates are evaluated once. Without an applied update no version is made.
    """
    before = current(spark, root)
    if before is None:
        raise ValueError(f"there is no table under {root}")
    if name in _versions(spark, root).values():
        raise NameTaken(f"{root} has a version {name}")
    work = f"{root}/work/{uuid.uuid4().hex}"

    def kept(frame: DataFrame, purpose: str) -> DataFrame:
        frame.write.parquet(f"{work}/{purpose}")
        return spark.read.schema(frame.schema).parquet(f"{work}/{purpose}")

    updates = kept(updates, "updates")
    settled = settle(updates, owned)
    clean = kept(settled.clean, "settled")
    asked = [r[0] for r in clean.select(_part(before.ids_per_part)).distinct().collect()]
    old = read(spark, root, before, asked)
    keys = old.select("ticket_id", "order_id", "customer_id") if orders is not None else old.select("ticket_id")
    hit = kept(keys.join(clean.select("ticket_id"), "ticket_id", "left_semi"), "hit")
    reasons = [
        updates.where("ticket_id IS NULL").selectExpr("ticket_id", "'no_ticket_id' AS reason", "CAST(NULL AS STRING) AS detail"),
        settled.clashing.selectExpr("ticket_id", "'clashing_updates' AS reason", "concat(least, ' <> ', greatest) AS detail"),
        clean.join(hit.select("ticket_id"), "ticket_id", "left_anti").selectExpr("ticket_id", "'no_such_ticket' AS reason", "CAST(NULL AS STRING) AS detail"),
    ]
    if orders is not None:
        stopped = quarantine_reasons(kept(split_by_owner(hit, orders).quarantine, "stopped"), orders)
        reasons.append(stopped.selectExpr("ticket_id", "reason", "concat(customer_id, ' <> ', order_id) AS detail"))
    whole = reasons[0]
    for r in reasons[1:]:
        whole = whole.unionByName(r)
    rejected = f"{root}/rejected/{uuid.uuid4().hex}"
    whole.write.parquet(rejected)
    rejected = spark.read.schema(REJECTED).parquet(rejected)
    accepted = kept(clean.join(rejected.where("ticket_id IS NOT NULL").select("ticket_id"), "ticket_id", "left_anti"), "accepted")
    touched = sorted(r[0] for r in accepted.select(_part(before.ids_per_part)).distinct().collect())
    if not touched:
        return WriteBack(before, before, [], rejected, accepted, owned, updated_at)
    attempt, parts = _written(_rewritten(read(spark, root, before, touched), accepted, owned, updated_at, before.ids_per_part), root)
    version = Version(before.number + 1, name, before.ids_per_part, before.parts | {p: attempt for p in parts})
    _switch(spark, root, version)
    return WriteBack(version, before, parts, rejected, accepted, owned, updated_at)


def changes(spark: SparkSession, root: str, done: WriteBack, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows that a write-back changed, as they were with ``sign`` -1 and as they are with 1; some columns or all.

    Both come from one join of the ranges as they were with the applied updates,
    which is written once under ``root/work``, whatever is computed from it.
    """
    old = read(spark, root, done.before, done.rewritten)
    columns = old.columns if columns is None else list(columns)
    if not done.rewritten:
        return old.select(*columns).withColumn("sign", F.lit(1))
    needed = [c for c in old.columns if c in {"ticket_id", *columns}]
    signed = old.select(*needed).join(done.applied, "ticket_id").withColumn("sign", F.explode(F.array(F.lit(-1), F.lit(1))))
    signed = signed.withColumn("_new", F.when(F.col("sign") == 1, F.col("_new")))
    kept = signed.select(*overlay_columns(old.select(*needed), done.owned, done.updated_at), "sign").select(*columns, "sign")
    path = f"{root}/work/{uuid.uuid4().hex}/changes"
    kept.write.parquet(path)
    return spark.read.schema(kept.schema).parquet(path)
