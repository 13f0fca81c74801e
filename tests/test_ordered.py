"""Orders across tasks, exact medians, evidence of many columns at once."""

import random

import pytest
from pyspark.sql import functions as F
from tallyloom.functions import ordered, selection
from tallyloom.operators import evidence, reports, understanding


def middle(values):
    values = sorted(values)
    return values[(len(values) - 1) // 2] / 2 + values[len(values) // 2] / 2


@pytest.fixture
def spread(spark):
    """Ranges stay apart, as they would with much data."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sums_before_equal_values_are_dealt_to_all_tasks(spread):
    rows = spread.range(20_000).select(F.when(F.col("id") % 10 == 0, 7.25).otherwise(2.0).alias("v"), F.concat(F.lit("g"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"))
    out = ordered.with_sum_before(rows.repartition(5), "v", "name", "before")
    got = [(r["v"], r["name"], r["before"]) for r in out.collect()]
    got.sort(key=lambda r: (-r[0], r[1]))
    total = 0.0
    for v, _, before in got:
        assert before == total
        total += v
    per = ordered.ranges(ordered.in_order(rows, F.desc("v"), "name")).collect()
    assert len(per) >= 3 and max(r["n"] for r in per) < 12_000  # 18,000 rows share one value


def test_sums_before_take_null_and_negative_values(spark):
    rows = spark.createDataFrame([(None, "a"), (-1.5, "b"), (3.0, "c"), (3.0, "d"), (0.0, None)], "v double, name string")
    out = {r["name"]: r["before"] for r in ordered.with_sum_before(rows, "v", "name", "before").collect()}
    assert out == {"c": 0.0, "d": 3.0, None: 6.0, "b": 6.0, "a": 4.5}
    assert ordered.with_sum_before(rows.limit(0), "v", "name", "before").collect() == []


def test_deep_pages_read_one_range(spread):
    r = random.Random(2)
    rows = [(f"2024-01-{r.randint(1, 9):02d}", i, float(i % 7), 2.0) for i in range(3000)]
    df = spread.createDataFrame(rows, "d string, k1 long, selling_price double, quantity double").select(F.col("d").cast("date").cast("timestamp_ntz").alias("sale_date"), "k1", "selling_price", "quantity", F.lit(None).cast("double").alias("line_total"))
    at, index = reports.ledger_index(df, ["k1"])
    assert index.count() >= 3 and index.agg(F.sum("n")).first()[0] == 3000
    plain = [x[1] for x in sorted(rows)]
    for page in (1, 17, 59, 60):
        one = reports.indexed_page(at, index, page, 50)
        assert sorted(x["k1"] for x in one.collect()) == sorted(plain[(page - 1) * 50 : page * 50])
        assert "PushedFilters: [Or" in one._jdf.queryExecution().toString() or "GreaterThanOrEqual(at" in one._jdf.queryExecution().toString()
    assert {x["page"] for x in reports.indexed_page(at, index, 10**6, 50).collect()} == {60}
    assert reports.indexed_page(*reports.ledger_index(df.limit(0), ["k1"]), 4).collect() == []


def test_medians_are_exact(spark):
    r = random.Random(9)
    values = [(k, v) for k, n in (("a", 1), ("b", 2), ("c", 999), ("d", 1000)) for v in [r.choice([r.gauss(0, 1), r.gauss(0, 1e-9), 10 ** r.uniform(-300, 300), -0.0, 0.0, 5.0, -5.0]) for _ in range(n)]]
    values += [("e", 1.5)] * 500 + [("e", -2.0)] * 499 + [(None, 3.0), (None, 4.0), ("f", None), ("f", float("nan"))]
    df = spark.createDataFrame(values, "k string, v double")
    got = {x["k"]: (x["n"], x["median"]) for x in selection.medians(df, "v", "k").collect()}
    for k in ("a", "b", "c", "d", "e", None):
        own = [v for kk, v in values if kk == k]
        assert got[k] == (len(own), middle(own)), k
    assert "f" not in got
    fine = [v for _, v in values if v is not None and v == v]
    assert [tuple(x) for x in selection.medians(df, "v").collect()] == [(len(fine), middle(fine))]
    assert selection.medians(df.limit(0), "v", "k").collect() == []


def test_invoice_totals_on_dirty_cells(spark):
    bills = [("B1", "₹1,200"), ("B1", "1200"), ("B2", "90"), ("B2", "90.0"), ("B3", "7"), ("B3", "7")]
    of = lambda rows: understanding.line_total_guard(spark.createDataFrame(rows, "bill string, total string"), "total", "bill").first()["verdict"]
    assert of(bills) == "reject"
    assert of([*bills[:4], *[(x, str(i)) for i, x in enumerate([None, "", " n/a", "NaN", "None", "<NA>"])]]) == "reject"  # rows without a number are no invoice
    assert of([*bills[:4], ("B4", "5"), ("B4", None)]) == "reject"  # a null is no second row
    assert of([("B1", "x"), ("B1", "x"), ("B2", "y"), ("B2", "z")]) == "ok"
    assert of([("B1", "1,000"), ("B1", "1000")]) == "warn"
    one = evidence.invoice_repeat(spark.createDataFrame(bills[:4] + [(None, "1"), (None, "2")], "bill string, total string"), "total", "bill").first()
    assert (one["n"], one["share"], one["repeats"]) == (2, 1.0, True)


def test_a_hundred_columns_take_two_passes(spark):
    wide = spark.range(300).select(
        F.concat(F.lit("B"), F.floor(F.col("id") / 3).cast("string")).alias("Bill No"), (F.col("id") % 4 + 1.0).alias("Qty"), (F.col("id") + 10.0).alias("Price"),
        *[((F.col("id") % 4 + 1) * (F.col("id") + 10)).alias(f"Amount {i}") for i in range(40)], *[F.element_at(F.array(*[F.lit(x) for x in (5.0, 12.0, 18.0)]), (F.col("id") % 3 + 1).cast("int")).alias(f"GST {i}") for i in range(30)],
        *[F.floor(F.col("id") / 3).alias(f"Rate {i}") for i in range(30)],
    )
    fields = {"Invoice No": "Bill No", "Quantity": "Qty", "Selling Price": "Price"}
    columns = [c for c in wide.columns if c.split()[0] in ("Amount", "GST", "Rate")]
    out = understanding.verdicts(wide, columns, fields)
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Range (") <= 2
    got = {r["header"]: (r["decision"], r["field"], r["semantic"], tuple(r["candidates"])) for r in out.collect()}
    assert len(got) == 100 and got["Amount 0"] == ("auto", "Line Total", "revenue", ("Line Total",))
    assert {got[f"Amount {i}"] for i in range(1, 40)} == {("ask", None, None, ("Line Total",))}
    assert {got[f"GST {i}"] for i in range(30)} == {("auto", "Tax", "tax", ("Tax",))}
    assert {got[f"Rate {i}"] for i in range(30)} == {("ask", None, None, ("MRP", "Cost Price", "Selling Price"))}
    free = {r["header"]: r["candidates"] for r in understanding.verdicts(wide, columns[-2:], {"Invoice No": "Bill No"}).collect()}
    assert set(map(tuple, free.values())) == {("MRP", "Tax", "Discount")}  # the same on all lines of a bill


def test_many_numbers_are_not_few(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4600, 18.0).otherwise(F.col("id") / 7).alias("Tax %"), F.when(F.col("id") < 4600, 18.0).otherwise(F.col("id") % 5 + 0.5).alias("GST %"), F.when(F.col("id") < 4600, 18.0).otherwise(F.col("id") % 6 + 0.5).alias("VAT %"))
    got = {r["header"]: r["field"] for r in understanding.verdicts(df, df.columns, {}).collect()}
    assert got == {"Tax %": None, "GST %": "Tax", "VAT %": None}  # 401, 6 and 7 different numbers


def test_a_ledger_moves_only_what_its_pages_show(spark):
    df = spark.range(200).select(F.lit("2024-01-01").cast("timestamp_ntz").alias("sale_date"), F.col("id").alias("k1"), F.lit(2.0).alias("quantity"), F.lit(3.0).alias("selling_price"), F.lit("x").alias("item"), F.lit(1.0).alias("cost_price"))
    rows, index = reports.ledger_index(df, ["k1"], ["item", "row_revenue"])
    assert rows.columns == ["sale_date", "item", "row_revenue", "k1", "at"]
    assert {(r["k1"], r["row_revenue"], r["page"]) for r in reports.indexed_page(rows, index, 2, 3).collect()} == {(3, 6.0, 2), (4, 6.0, 2), (5, 6.0, 2)}
