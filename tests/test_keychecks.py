"""The tables suite in two reads against the suite made of one query per check."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from ticketloom.operators import keychecks, quality
from ticketloom.plans.testmodel import Model


@pytest.fixture(scope="module")
def files(spark, small, tmp_path_factory):
    """The broken tables as files, with missing keys, keys that a third of the rows share, and repeated rows."""
    root = tmp_path_factory.mktemp("tables")
    m, out = Model(spark, small), {}
    for name, df in m.broken_tables.items():
        if name == "orders":
            df = df.withColumn("customer_id", F.when(F.col("order_id") % 5 == 0, None).otherwise(F.col("customer_id")))
            df = df.union(df.where("order_id % 50 = 3"))
        if name == "order_items":
            df = df.withColumn("order_id", F.when(F.col("order_item_id") % 3 == 0, 1).when(F.col("order_item_id") % 47 == 0, None).otherwise(F.col("order_id")))
            df = df.withColumn("product_id", F.when(F.col("order_item_id") % 61 == 0, None).otherwise(F.col("product_id")))
        if name == "tickets":
            df = df.withColumn("order_id", F.when(F.col("ticket_id") % 3 == 1, 3).otherwise(F.col("order_id")))
            df = df.withColumn("customer_id", F.when(F.col("ticket_id") % 43 == 0, None).otherwise(F.col("customer_id")))
            df = df.withColumn("ticket_id", F.when(F.col("ticket_id") % 59 == 0, None).otherwise(F.col("ticket_id")))
        if name == "customers":
            df = df.withColumn("email", F.when(F.col("customer_id") % 13 == 0, None).otherwise(F.col("email")))
        path = f"{root}/{name}"
        df.write.parquet(path)
        out[name] = path
    return out


def opened(spark, files):
    return {name: spark.read.parquet(path) for name, path in files.items()}


def rows(frame):
    return sorted(map(str, frame.select("check_name", "key", "detail").collect()))


def test_same_findings_as_one_query_per_check(spark, files, tmp_path):
    tables = opened(spark, files)
    lazy = rows(quality.tables_suite(tables))
    assert rows(quality.tables_suite(tables, stage=str(tmp_path / "stage"))) == lazy
    names = {r.split("'")[1] for r in lazy}
    assert {"orders_pk_dupes", "tickets_pk_dupes", "duplicate_customer_emails", "orphan_orders_customer", "order_total_mismatch", "ticket_order_customer_mismatch"} <= names


def test_sound_and_empty_tables_have_no_findings(spark, files, tmp_path):
    empty = {n: t.where("false") for n, t in opened(spark, files).items()}
    assert rows(quality.tables_suite(empty, stage=str(tmp_path / "none"))) == []


def test_each_table_is_read_twice(spark, files):
    tables = opened(spark, files)

    def scans(frame):
        text = io.StringIO()
        with redirect_stdout(text):
            frame.explain()
        return [sum(path.rsplit("/", 1)[1] + "]" in line and "FileScan" in line for line in text.getvalue().split("\n")) for path in files.values()]

    problems = keychecks.problem_keys(tables)
    assert scans(problems) == [1] * 5
    stored = spark.createDataFrame([], problems.schema)
    checks = {"order_items": [quality.failed_check(quality.line_total_check())]}
    assert max(scans(keychecks.touching(tables, stored, checks))) == 1
    assert all("PartialAggregation" in p or "partial_count" in p for p in [problems._jdf.queryExecution().toString()])


def listed_problems(spark, tables, tmp_path):
    keychecks.problem_keys(tables).write.parquet(str(tmp_path / "problems"))
    return spark.read.parquet(str(tmp_path / "problems"))


def test_orders_that_are_there_once_need_no_row(spark, files, tmp_path):
    tables = opened(spark, files)
    problems = listed_problems(spark, tables, tmp_path)
    assert problems.where("owned = 1 AND off_total").count() > 100
    touched = keychecks.touching(tables, problems, {})
    assert touched.where(f"check_name IS NULL AND role = {keychecks.OWNS} AND p.owned = 1").count() == 0


def test_references_that_are_met_go_before_the_shuffle(spark, files, tmp_path):
    tables = opened(spark, files)
    problems = listed_problems(spark, tables, tmp_path)
    lines = tables["order_items"].selectExpr(
        "order_item_id AS row_id", "CAST(NULL AS STRING) AS check_name", f"CAST({keychecks.PRODUCT} AS INT) AS space", "CAST(product_id AS BIGINT) AS id",
    ).where("id IS NOT NULL")
    dangling = problems.where(f"space = {keychecks.PRODUCT} AND dangling")
    left = keychecks._maybe_listed(lines, dangling)
    met = lines.join(dangling.select("id"), "id", "left_semi")
    assert 0 < met.count() == left.count() < lines.count() / 10
    assert met.select("row_id").exceptAll(left.select("row_id")).isEmpty()


def test_line_sums_are_exact(spark, small):
    empty = {n: t.where("false") for n, t in Model(spark, small).tables.items()}
    large = "CAST(999999999999.99 AS DECIMAL(14,2))"
    amounts = [(1, large)] * 200 + [(2, "-0.01"), (2, "-42949672.97"), (3, "NULL"), (4, "NULL"), (4, "0.05")]
    items = spark.sql(" UNION ALL ".join(f"SELECT {i}L AS order_item_id, {o}L AS order_id, 1L AS product_id, 1 AS quantity, CAST({a} AS DECIMAL(14,2)) AS line_total" for i, (o, a) in enumerate(amounts)))
    orders = spark.range(1, 5).selectExpr("id AS order_id", "1L AS customer_id", *[f"CAST(NULL AS {t}) AS {c}" for c, t in empty["orders"].dtypes[2:4]], "CAST(7 AS DECIMAL(10,2)) AS total_amount", *[f"CAST(NULL AS {t}) AS {c}" for c, t in empty["orders"].dtypes[5:]])
    found = keychecks.problem_keys(empty | {"order_items": items, "orders": orders}).where("off_total").select("id", "computed_total").collect()
    assert {r.id: str(r.computed_total) for r in found} == {1: "199999999999998.00", 2: "-42949672.98", 4: "0.05"}


def test_the_first_read_expands_small_splits(spark, files, tmp_path, monkeypatch):
    name, tables, seen = "spark.sql.files.maxPartitionBytes", opened(spark, files), []
    before, made = spark.conf.get(name), keychecks.problem_keys
    monkeypatch.setattr(keychecks, "problem_keys", lambda t: seen.append(spark.conf.get(name)) or made(t))
    lazy = rows(quality.tables_suite(tables))
    assert rows(quality.tables_suite(tables, stage=str(tmp_path / "stage"))) == lazy
    assert seen == [str(keychecks.SPLIT_BYTES)] and spark.conf.get(name) == before
    spark.range(20000).selectExpr("id", "uuid() AS text").coalesce(1).write.option("parquet.block.size", 1 << 14).parquet(str(tmp_path / "long"))
    with pytest.raises(ZeroDivisionError), keychecks.small_splits(spark, 1 << 16):
        assert spark.read.parquet(str(tmp_path / "long")).rdd.getNumPartitions() > 4
        with keychecks.small_splits(spark, 1 << 30):  # a session with smaller ones keeps them
            assert spark.conf.get(name) == str(1 << 16)
        1 / 0
    assert spark.conf.get(name) == before
