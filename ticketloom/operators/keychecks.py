"""Checks between rows in two reads of each table: keys, references, sums and owners from one counting aggregate.

First read: every row expands to the keys it owns and the keys it refers to, and
one aggregate over all of them, combined in each task, leaves the keys with
something wrong. Second read: rows that touch such a key are listed, together
with the findings that a row shows by itself; what a key alone tells, such as an
order that does not add up, needs no row. Both results are written, so nothing
reads a table a third time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom import schemas
from ticketloom.functions.numeric import money
from ticketloom.functions.sql import q

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Own:
    """A key that rows of a table own: ``id`` and ``part`` are whole numbers, ``text`` anything else, each may be missing."""

    space: int
    check: str
    table: str
    id: str = "NULL"
    part: str = "NULL"
    text: str = "NULL"


@dataclass(frozen=True)
class Reference:
    """A key that rows of a table refer to."""

    check: str
    table: str
    column: str
    space: int
    null_is_orphan: bool = True


# --- Fixed values: which keys there are, and the names that findings carry -------------
CUSTOMER, PRODUCT, ORDER, ITEM, TICKET, EMAIL, SKU, LINE, REQUIRED = range(9)
OWNED = [
    Own(CUSTOMER, "customers_pk_dupes", "customers", id="customer_id"),
    Own(PRODUCT, "products_pk_dupes", "products", id="product_id"),
    Own(ORDER, "orders_pk_dupes", "orders", id="order_id"),
    Own(ITEM, "order_items_pk_dupes", "order_items", id="order_item_id"),
    Own(TICKET, "tickets_pk_dupes", "tickets", id="ticket_id"),
    Own(EMAIL, "duplicate_customer_emails", "customers", text="email"),
    Own(SKU, "duplicate_product_skus", "products", text="sku"),
    Own(LINE, "duplicate_order_item_product_within_order", "order_items", id="order_id", part="product_id"),
]
REFERENCES = [
    Reference("orphan_orders_customer", "orders", "customer_id", CUSTOMER),
    Reference("orphan_order_items_order", "order_items", "order_id", ORDER),
    Reference("orphan_order_items_product", "order_items", "product_id", PRODUCT),
    Reference("orphan_tickets_customer", "tickets", "customer_id", CUSTOMER),
    Reference("orphan_tickets_order", "tickets", "order_id", ORDER, null_is_orphan=False),
]
REQUIRED_COLUMNS = {
    "customers": ["first_name", "last_name", "email", "signup_date", "customer_segment", "country"],
    "orders": ["customer_id", "order_date", "order_status", "total_amount", "payment_method", "expected_delivery_date"],
    "tickets": ["customer_id", "channel", "message_text", "category", "priority", "status", "created_at"],
}

#: The columns of an expanded row: its key, what it is to the key, and what it brings along.
EXPANDED = {
    "space": "INT", "id": "BIGINT", "part": "BIGINT", "text": "STRING", "role": "INT", "amount": "DECIMAL(14,2)", "who": "BIGINT",
}
OWNS, LINES, ASKS, REFERS = range(4)
#: Bits that number the words of the second read's filter: 2**26 bits in all, 16 MB.
FILTER_WORDS = 20
#: Bytes of a table that one task of the first read expands: about 3 million keys of order lines, which its aggregate holds without spilling.
SPLIT_BYTES = 12 << 20


def _keys_of(table: str, listed: bool = False) -> list[dict[str, str]]:
    """The keys that a row of the table owns or refers to, as SQL text by column; without a space where there is none.

    listed: only keys for which rows have to be listed, which are references and the orders themselves.
    """
    made = []
    for own in (o for o in OWNED if o.table == table and (o.space == ORDER or not listed)):
        key = {"space": f"{own.space}", "id": own.id, "part": own.part, "text": own.text, "role": f"{OWNS}"}
        made.append(key | ({"amount": "total_amount", "who": "customer_id"} if own.space == ORDER else {}))
    for r in (r for r in REFERENCES if r.table == table):
        key = {"space": f"IF({r.column} IS NULL, NULL, {r.space})", "id": r.column, "role": f"{REFERS}"}
        if r.space == ORDER:
            key |= {"role": f"{LINES}", "amount": "line_total"} if table == "order_items" else {"role": f"{ASKS}", "who": "customer_id"}
        made.append(key)
    if table in REQUIRED_COLUMNS and not listed:
        missing = " OR ".join(f"{c} IS NULL" for c in REQUIRED_COLUMNS[table])
        made.append({"space": f"IF({missing}, {REQUIRED}, NULL)", "text": q(table), "role": f"{OWNS}"})
    return made


def _expanded(df: DataFrame, entries: Sequence[dict[str, str]], types: dict[str, str], *more: str) -> DataFrame:
    """A row per entry of every row, with ``more`` columns beside it.

    Only the number of the entry is generated; its columns are picked by that
    number, so no structs are built, and what is not picked is not computed.
    """
    numbered = df.selectExpr("*", f"explode(array({', '.join(map(str, range(len(entries))))})) AS _entry")

    def picked(column: str) -> str:
        cases = "".join(f" WHEN {i} THEN CAST({e[column]} AS {types[column]})" for i, e in enumerate(entries) if e.get(column, "NULL") != "NULL")
        return f"CASE _entry{cases} END AS {column}" if cases else f"CAST(NULL AS {types[column]}) AS {column}"

    return numbered.selectExpr(*more, *[picked(c) for c in types])


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def problem_keys(tables: Tables) -> DataFrame:
    """One row per key with something wrong: how often it is owned, who refers to it, what its lines sum up to.

    Counts, sums and extremes are combined in each task, so a hot key sends one
    row a task. Missing keys are one key.
    """
    entries = _union([_expanded(tables[t], _keys_of(t), EXPANDED).where("space IS NOT NULL") for t in schemas.KEYS])
    own, line, ticket = F.col("role") == OWNS, F.col("role") == LINES, F.col("role") == ASKS
    # Cents as two halves of a long: the sums cannot overflow, and the buffer holds whole numbers of fixed width only.
    cents = F.when(line, F.expr("CAST(amount * 100 AS BIGINT)"))
    counted = entries.groupBy("space", "id", "part", "text").agg(
        F.count_if(own).alias("owned"), F.count_if(line).alias("lines"),
        F.sum(F.shiftright(cents, 32)).alias("_high"), F.sum(cents.bitwiseAND(F.lit(0xFFFFFFFF))).alias("_low"),
        F.max(F.when(own, F.col("amount"))).alias("total"), F.max(F.when(own, F.col("who"))).alias("owner"),
        F.min(F.when(ticket, F.col("who"))).alias("least_asker"), F.max(F.when(ticket, F.col("who"))).alias("greatest_asker"),
    )
    line_sum = "CAST((CAST(_high AS DECIMAL(19,0)) * 4294967296BD + CAST(_low AS DECIMAL(19,0))) * 0.01BD AS DECIMAL(24,2))"
    counted = counted.withColumn("computed_total", F.expr(money(line_sum)))
    is_order = F.col("space") == ORDER
    wrong = {
        "repeated": F.when(F.col("space") == REQUIRED, F.col("owned") > 0).otherwise(F.col("owned") > 1),
        "dangling": F.col("owned") == 0,
        "no_lines": is_order & (F.col("owned") > 0) & (F.col("lines") == 0),
        # Of an order that is there more than once the rows are compared one by one, in the second read.
        "off_total": is_order & (F.col("lines") > 0) & ((F.col("owned") > 1) | (F.col("total") != F.col("computed_total"))),
        "other_owner": is_order & F.col("least_asker").isNotNull()
        & ((F.col("owned") > 1) | (F.col("least_asker") != F.col("owner")) | (F.col("greatest_asker") != F.col("owner"))),
    }
    names = ["space", "id", "part", "text", "owned", "total", "owner", "computed_total"]
    flagged = counted.select(*names, *[F.coalesce(c, F.lit(False)).alias(n) for n, c in wrong.items()])
    return flagged.where(" OR ".join(wrong))


def _maybe_listed(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The findings, and the rows whose key may be among the keys: nearly all others go before anything is shuffled.

    One bit per hash of a key, in 2**FILTER_WORDS longs at most, however many
    keys there are; that is what is broadcast. More keys let more rows through.
    """
    word, bit = f"shiftright(xxhash64(space, id), {64 - FILTER_WORDS})", "shiftleft(1L, CAST(xxhash64(space, id) & 63 AS INT))"
    words = keys.groupBy(F.expr(word).alias("_word")).agg(F.expr(f"bit_or({bit})").alias("_bits"))
    met = rows.join(F.broadcast(words), F.expr(f"IF(space IS NULL, NULL, {word}) = _word"), "left")
    return met.where(f"check_name IS NOT NULL OR (_bits & {bit}) <> 0").drop("_word", "_bits")


def touching(tables: Tables, problems: DataFrame, row_findings: dict[str, list[str]]) -> DataFrame:
    """The rows that touch a problem key, and the findings that rows show by themselves (``check_name`` is set there).

    An order that is there once is known whole from its key: only the rows of
    repeated orders are listed. row_findings: per table, SQL texts that give a
    struct ``(check_name, detail)`` or NULL.
    """
    types = {"f": "struct<check_name:string,detail:string>", **{c: t for c, t in EXPANDED.items() if c not in ("part", "text")}}
    frames = []
    for table, key in schemas.KEYS.items():
        # No line can name an order without an id.
        alone = {r.check: f"{r.column} IS NULL" for r in REFERENCES if r.table == table and r.null_is_orphan}
        alone |= {"orders_with_no_items": "order_id IS NULL"} if table == "orders" else {}
        own = [f"IF({missing}, named_struct('check_name', {q(check)}, 'detail', CAST(NULL AS STRING)), NULL)" for check, missing in alone.items()]
        entries = [{"f": f} for f in own + row_findings.get(table, [])] + _keys_of(table, listed=True)
        if not entries:
            continue
        rows = _expanded(tables[table], entries, types, f"{q(table)} AS table_name", f"{key} AS row_id")
        frames.append(rows.where("f IS NOT NULL OR (space IS NOT NULL AND id IS NOT NULL)"))
    rows = _union(frames).selectExpr(
        "table_name", "row_id", "f.*", "space", "id", "role", "amount", "who",
        # Findings need no key: they spread by the row's own id and match nothing.
        "coalesce(id, xxhash64(table_name, row_id)) AS meet",
    )
    listed = problems.where("id IS NOT NULL AND (dangling OR other_owner OR (owned > 1 AND (no_lines OR off_total)))")
    told = "struct(owned, owner, dangling, no_lines, off_total, other_owner, computed_total) AS p"
    keys = listed.selectExpr("space AS p_space", "id AS p_id", told)
    rows = _maybe_listed(rows, listed)
    joined = rows.join(keys, (F.col("meet") == F.col("p_id")) & (F.col("space") == F.col("p_space")), "left")
    concerned = (
        f"(role <> {OWNS} AND p.dangling) OR (role = {ASKS} AND p.other_owner) "
        f"OR (role = {OWNS} AND p.owned > 1 AND (p.no_lines OR p.other_owner OR (p.off_total AND amount <> p.computed_total)))"
    )
    return joined.where(f"check_name IS NOT NULL OR {concerned}").drop("meet", "p_space", "p_id")


def findings(problems: DataFrame, touched: DataFrame) -> DataFrame:
    """Violations ``(check_name, key, detail)`` from the two written tables."""
    names = F.create_map(*[x for o in OWNED for x in (F.lit(o.space), F.lit(o.check))])
    number, part = (F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in ("id", "part"))
    shown = (
        F.when(F.col("space") == LINE, F.concat_ws("|", number, part))
        .when(F.col("space").isin(EMAIL, SKU, REQUIRED), F.coalesce("text", F.lit("NULL"))).otherwise(number)
    )
    check = F.when(F.col("space") == REQUIRED, F.concat(F.lit("null_required_"), "text")).otherwise(names[F.col("space")])
    repeated = problems.where("repeated").select(check.alias("check_name"), shown.alias("key"), F.col("owned").cast("string").alias("detail"))

    row, matched = F.col("row_id").cast("string").alias("key"), touched.where("check_name IS NULL")
    alone = touched.where("check_name IS NOT NULL").select("check_name", row, "detail")
    referring = F.create_map(*[x for r in REFERENCES for x in (F.lit(f"{r.table} {r.space}"), F.lit(r.check))])
    dangling = matched.where(f"role <> {OWNS} AND p.dangling").select(
        referring[F.concat_ws(" ", "table_name", "space")].alias("check_name"), row, F.col("id").cast("string").alias("detail")
    )
    # Orders that are there once, by their key, and the rows of the others. One without an id has been found by itself.
    once = problems.where(f"space = {ORDER} AND owned = 1 AND id IS NOT NULL").selectExpr("id", "total AS amount", "no_lines", "off_total", "computed_total")
    again = matched.where(f"role = {OWNS}")
    orders = once.unionByName(again.selectExpr("id", "amount", "p.no_lines", "p.off_total", "p.computed_total"))
    one = F.col("id").cast("string").alias("key")
    empty = orders.where("no_lines").select(F.lit("orders_with_no_items").alias("check_name"), one, F.lit(None).cast("string").alias("detail"))
    off = orders.where("off_total AND amount <> computed_total").select(
        F.lit("order_total_mismatch").alias("check_name"), one,
        F.concat(F.col("amount").cast("decimal(10,2)").cast("string"), F.lit(" <> "), F.col("computed_total").cast("decimal(18,2)").cast("string")).alias("detail"),
    )
    asking = matched.where(f"role = {ASKS} AND p.other_owner")
    owners = again.where("p.other_owner").select(F.col("id").alias("_order"), F.col("who").alias("_owner"))
    of_once = asking.where("p.owned = 1 AND who <> p.owner").withColumn("_owner", F.col("p.owner"))
    of_again = asking.where("p.owned > 1").join(owners, (F.col("id") == F.col("_order")) & (F.col("who") != F.col("_owner"))).drop("_order")
    foreign = of_once.unionByName(of_again).select(
        F.lit("ticket_order_customer_mismatch").alias("check_name"), row,
        F.concat(F.col("who").cast("string"), F.lit(" <> "), F.col("_owner").cast("string")).alias("detail"),
    )
    return _union([repeated, alone, dangling, empty, off, foreign])


@contextmanager
def small_splits(spark: SparkSession, size: int) -> Iterator[None]:
    """What is run inside reads files in splits of at most so many bytes; the session's own setting comes back afterwards."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(size, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def two_read_suite(tables: Tables, stage: str, row_findings: dict[str, list[str]]) -> DataFrame:
    """All findings; ``stage`` is a new path in the shared folder for the two small tables."""
    spark = next(iter(tables.values())).sparkSession

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("errorifexists").parquet(f"{stage}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{stage}/{name}")

    # Most keys are there once, so a task's aggregate holds nearly a row per key: its size follows the split's.
    with small_splits(spark, SPLIT_BYTES):
        problems = kept(problem_keys(tables), "problems")
    return findings(problems, kept(touching(tables, problems, row_findings), "touched"))
