"""Column understanding and the dashboard's rules beyond what the SQL queries show."""

import pytest
from pyspark.sql import functions as F
from tallyloom.functions import text
from tallyloom.operators import charts, headers, slicing, understanding


@pytest.fixture(scope="module")
def sheet(spark):
    rows = [(f"B{k // 3}", 1.0 + k % 4, 10.0 + k, (1.0 + k % 4) * (10.0 + k), 100.0 * (k // 3), 18.0 if k % 2 else 5.0) for k in range(30)]
    return spark.createDataFrame(rows, "bill string, qty double, price double, line double, total double, gst double")


FIELDS = {"Invoice No": "bill", "Quantity": "qty", "Selling Price": "price"}


def one(df):
    r = df.first()
    return r["decision"], r["field"], r["semantic"], list(r["candidates"])


def test_rules_of_evidence(spark, sheet):
    assert one(understanding.percentage_rule(sheet, "gst")) == ("auto", "Tax", "tax", ["Tax"])
    assert one(understanding.percentage_rule(sheet, "qty"))[0] == "ask"
    assert one(understanding.amount_rule(sheet, "total", FIELDS)) == ("auto", None, "invoice_total", [])
    assert one(understanding.amount_rule(sheet, "line", FIELDS)) == ("auto", "Line Total", "revenue", ["Line Total"])
    assert one(understanding.amount_rule(sheet, "line", FIELDS | {"Line Total": "other"})) == ("ask", None, None, ["Line Total"])
    assert one(understanding.amount_rule(sheet, "line", {})) == ("ask", None, None, ["Line Total"])
    assert one(understanding.rate_rule(sheet, "price", {"Quantity": "qty", "Line Total": "line"})) == ("auto", "Selling Price", "unit_price", ["Selling Price"])
    assert one(understanding.rate_rule(sheet, "total", {"Invoice No": "bill"})) == ("ask", None, None, ["MRP", "Tax", "Discount"])
    assert one(understanding.rate_rule(sheet, "gst", {})) == ("auto", "Tax", "tax", ["Tax"])
    assert one(understanding.rate_rule(sheet.limit(3), "price", {})) == ("ask", None, None, [])
    assert one(understanding.rate_rule(sheet.limit(0), "price", {})) == ("ask", None, None, [])


def test_guard_of_the_line_total(sheet):
    verdict = lambda df, c: understanding.line_total_guard(df, c, "bill").first()["verdict"]
    assert verdict(sheet, "total") == "reject" and verdict(sheet, "line") == "ok"
    assert verdict(sheet.filter("bill = 'B1'"), "total") == "warn"
    assert verdict(sheet.withColumn("bill", F.lit("n/a")), "total") == "ok" and verdict(sheet.limit(0), "total") == "ok"
    assert understanding.line_total_guard(sheet, "total", None).first()["verdict"] == "ok"


def test_verdicts_see_what_was_decided_before(sheet):
    df = sheet.select("bill", "qty", "price", F.col("line").alias("Amount"), F.col("line").alias("Net Value"), F.lit("x").alias("Name"))
    out = {r["header"]: (r["decision"], r["field"]) for r in understanding.verdicts(df, ["Amount", "Net Value", "Name"], FIELDS).collect()}
    assert out == {"Amount": ("auto", "Line Total"), "Net Value": ("ask", None), "Name": ("ask", None)}


def test_perturbed_headers_are_read_alike(spark):
    base = headers.header_table(spark, ["voucher date", "cost_price", "qty"])
    out = headers.perturbed(base)
    kinds = {r["kind"] for r in out.collect()}
    assert {"upper", "title", "pad_spaces", "bom_prefix", "underscore_for_space", "fullwidth", "nbsp_for_space"} <= kinds
    wide = out.filter("kind = 'fullwidth' and ordinal = 2").first()["header"]
    assert wide == "".join(chr(ord(c) + 0xFEE0) for c in "qty")
    read = headers.guessed(out.filter("kind in ('upper', 'pad_spaces', 'bom_prefix', 'title')").select("ordinal", "header"))
    assert {(r["ordinal"], r["field"]) for r in read.collect()} == {(0, "Date"), (1, "Cost Price"), (2, "Quantity")}


def test_notes_are_normalised(spark):
    df = spark.createDataFrame([("\uff31\uff54\uff59 \u0007 ok",), (None,), ("plain",), ("",)], "x string")
    assert [r[0] for r in df.select(text.sanitised(F.col("x"))).collect()] == ["Qty ok", None, "plain", ""]


def test_small_rules(spark):
    points = spark.createDataFrame([("a", 2.0, False, 1.0), ("b", -1.0, False, None), ("Other (3)", 4.0, True, 2.0)], "label string, value double, is_other boolean, price double")
    assert [r[0] for r in charts.treemap_cells(points).collect()] == ["a", "Other (3)"] and [r[0] for r in charts.bubbles(points, "price").collect()] == ["a"]
    few = spark.range(4)
    assert sorted(r[0] for r in slicing.head_and_tail(few, ["id"], 3).collect()) == [0, 1, 2, 3]
    shown = spark.sql("select date'2024-07-14' as d, cast(null as double) as n, -71.44D as p").select(text.day_text(F.col("d")), text.percent_text(F.col("n")), text.percent_text(F.col("p"))).first()
    assert tuple(shown) == ("14 Jul", "an unmeasurable amount", "71.4%")


def test_kinds_of_cells(spark):
    numbers = ["₹ 1,200.00", "Rs. 1,200", "12%", "-3", "INR 5", "1e3"]
    dates = ["2026-04-05", "05/04/2026", "5.4.26", "5 Apr 2026", "april 5, 2026", "20260405", "31-02-2026", " 5-apr-26 "]
    neither = ["", "abc", "12 ab", "Rs", None, "2026", "1-2", "5 Foo 2026"]
    rows = spark.createDataFrame([(x,) for x in numbers + dates + neither], "x string").select("x", text.number_like(F.col("x")), text.date_like(F.col("x"))).collect()
    assert {r[0] for r in rows if r[1]} == {*numbers, "20260405", "2026"} and {r[0] for r in rows if r[2]} == set(dates)


def test_aliases_come_from_a_file(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"phrase": " Mal ", "field": "Item"}\n{"phrase": "x", "field": "Nothing"}\n')
    assert [tuple(r) for r in headers.read_aliases(spark, str(tmp_path / "a.jsonl")).collect()] == [("mal", "Item")]
    assert charts.week_label(F.lit("2026-01-01").cast("date")) is not None
    assert spark.range(1).select(charts.week_label(F.lit("2026-01-04").cast("date")), charts.week_label(F.lit("2026-12-31").cast("date"))).first()[:] == ("W01", "W53")
