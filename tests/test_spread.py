"""Work that grows with the rows is dealt to all tasks, and what repeats is read once."""

from datetime import datetime

import __spark_entry__
from pyspark.sql import functions as F
from tallyloom.operators import evidence, headers, memory, understanding
from tallyloom.plans import queries
from tallyloom.sources import register

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_headers_of_exports_are_dealt_to_all_tasks(spark):
    per = [r["count"] for r in queries.sheets(spark, SF).groupBy(F.spark_partition_id()).count().collect()]
    assert len(per) >= spark.sparkContext.defaultParallelism and max(per) < sum(per) / 2


def test_tasks_of_exports_grow_with_their_number(spark):
    owners = spark.range(3 * queries.SHEETS_A_TASK * spark.sparkContext.defaultParallelism).withColumnRenamed("id", "sheet")
    per = [r["count"] for r in queries.spread(owners, "sheet").groupBy(F.spark_partition_id()).count().collect()]
    assert len(per) == 3 * spark.sparkContext.defaultParallelism and max(per) < 1.5 * queries.SHEETS_A_TASK


def test_shapes_read_each_value_once(spark):
    rows = [("5", "a"), ("5", "b"), ("x", "2024-01-02"), (" ", "3 May 2024"), (None, "May")] * 3
    df = spark.createDataFrame(rows, "n string, t string")
    shape = evidence.shape(df, ["n", "t"])
    assert "Expand" not in plan(shape)
    got = {r["column"]: r for r in shape.collect()}
    assert [round(x, 6) for x in (got["n"]["null_ratio"], got["n"]["numeric_ratio"], got["n"]["unique_ratio"], got["n"]["mean_length"])] == [0.4, 0.666667, 0.222222, 1.0]
    assert (got["t"]["null_ratio"], got["t"]["date_ratio"], got["t"]["numeric_ratio"], got["t"]["all_integer"]) == (0.0, 0.4, 0.0, False)
    empty = evidence.shape(df.limit(0), ["n", "t"]).collect()
    assert {tuple(r)[1:] for r in empty} == {(None, 0.0, 0.0, 0.0, None, False)} and len(empty) == 2


def test_rules_of_headers_are_no_work_for_each_row(spark):
    df = spark.createDataFrame([("B1", 2.0, 3.0, 6.0, "₹ 6.00", 1.5)], "bill string, q double, p double, amount double, total string, notes double")
    found = understanding.verdicts(df, ["amount", "total", "notes"], {"Invoice No": "bill", "Quantity": "q", "Selling Price": "p"})
    scans = [line for line in plan(found).splitlines() if "explode" in line]
    assert scans and not any("amt" in line or "split" in line for line in plan(found.drop("decision")).splitlines() if "Generate" in line or "bill" in line)
    assert {r["header"] for r in found.collect()} == {"amount", "total", "notes"}
    facts = understanding.column_facts(df, {"amount": "amount", "total": "amount", "notes": None}, {"Invoice No": "bill", "Quantity": "q", "Selling Price": "p"})
    assert {(r["column"], r["n"], r["n_numbers"], r["match_share"]) for r in facts.collect()} == {("amount", 1, 1, 1.0), ("total", 1, 1, 1.0)}


def test_templates_take_their_rows_once(spark):
    at = datetime(2026, 1, 1)
    rows = [(" Ann", 1, "Qty", at), ("ann ", 1, "Rate:", at), ("ann", 1, "qty", at), ("bob", 1, "é\\", at), (None, 1, "Qty", at)]
    t = memory.templates(spark.createDataFrame(rows, "owner string, sheet int, header string, at timestamp"), "at")
    assert "Join" not in plan(t)
    got = {(r["raw"], r["header"], r["alone"], r["signature"]) for r in t.collect()}
    ann, bob = memory.signature(["Qty", "Rate:", "qty"]), memory.signature(["é\\"])
    assert got == {("Qty", "qty", False, ann), ("Rate:", "rate", True, ann), ("qty", "qty", False, ann), ("é\\", "é\\", True, bob)}


def test_headers_are_read_once_and_meet_no_shuffle_by_header(spark):
    rows = [(0, "  \ufeffDATE"), (1, "Customer Phone"), (2, "Qty sold today"), (3, None), (4, "Remarks"), (5, "Zzz"), (6, "Invoice Date of item")]
    df = spark.createDataFrame(rows, "ordinal int, header string")
    g = understanding.classified_headers(df)
    assert plan(g).count("ltrim") == 1 and plan(g).count("arrays_overlap") == 1
    assert "broadcast" in plan(headers.guessed(df))
    got = {r["ordinal"]: (r["label"], r["field"], r["score"]) for r in g.collect()}
    assert got == {0: ("date", "Date", 1.0), 1: ("personal", None, 0.0), 2: ("quantity", "Quantity", 0.5), 3: ("other", None, 0.0), 4: ("notes", None, 1.0), 5: ("other", None, 0.0), 6: ("date", "Date", 0.5)}
    assert [r["field"] for r in headers.guessed(df).orderBy("ordinal").collect()] == ["Date", None, "Quantity", None, None, None, "Date"]


def test_shapes_count_values_as_they_are(spark):
    rows = [(0.0, 1, " a", None, True), (-0.0, 1, "a", "2.5", None), (float("nan"), -7, "", "2.50", False), (float("nan"), None, None, "x", True), (1e20, 2**40, "Ä", " ", True), (None, 1, "a ", "2.5", True)]
    df = spark.createDataFrame(rows, "d double, `n.o` long, t string, i string, b boolean").withColumn("at", F.expr("timestamp_ntz'2024-01-02 03:04:05'")).withColumn("day", F.expr("date'2024-01-02'")).withColumn("m", F.expr("1.50BD"))
    columns = df.columns
    got = {(r["column"], r["t"]): r["k"] for r in evidence.value_counts(df, columns).collect()}
    want = {(c, r["t"]): r["count"] for c in columns for r in df.groupBy(F.trim(F.col(f"`{c}`").cast("string")).alias("t")).count().collect()}
    assert got == want and got["d", "-0.0"] == got["d", "0.0"] == 1 and got["d", "NaN"] == 2 and got["t", "a"] == 3
    counted = plan(evidence.value_counts(df.select("at", "`n.o`"), ["at", "n.o"])).split("Generate")
    assert len(counted) == 2 and "cast(" in counted[0] and "as string" not in counted[1] and "explode([0,1])" in counted[1]
    assert "as string" not in counted[0].split("Aggregate")[1].split("\n", 1)[1]


def test_shapes_join_orders_last(spark):
    joins = {name: [line for line in plan(__spark_entry__.queries()[name](spark, SF)).splitlines() if "Join Inner" in line] for name in ("map10_shape", "map11_shape_fit")}
    assert all("o_orderkey" in lines[0] and "l_orderkey" in lines[0] and len(lines) == 5 for lines in joins.values())
    narrow, wide = (register.star_register(spark, SF, orders_last=last) for last in (True, False))
    assert narrow.columns == wide.columns and narrow.exceptAll(wide).count() == wide.exceptAll(narrow).count() == 0
