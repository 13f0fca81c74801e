"""Invariants of the register's operators on small shops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from tallyloom.fields import QueryError
from tallyloom.functions import numbers, text
from tallyloom.operators import charts, derive, evidence, extras, forecast, headers, ingest, insights, inventory, memory, reports, slicing
from tallyloom.operators.slicing import AnalysisQuery, build_slice, resolve_window
from tallyloom.sources import files, workbooks

SCHEMA = "row_id long, sale_date timestamp_ntz, category string, item string, quantity double, selling_price double, cost_price double, line_total double, discount double, tax double, stock_on_hand double, mrp double, branch string, payment_mode string, customer string, invoice_no string"


def shop(days=60, seed=1, gap=1):
    r = random.Random(seed)
    rows = []
    for d in range(0, days, gap):
        for k in range(r.randint(2, 6)):
            i = r.randrange(12)
            q, p = r.randint(1, 5), 10.0 + i
            rows.append((len(rows), dt.datetime(2026, 1, 1) + dt.timedelta(days=d), f"C{i % 3}", f"I{i:02}", float(q), p, p * (0.5 + i / 40), q * p, float(r.choice([0, 0, 1])), q * p * 0.05, float(i), p * 1.1, f"B{i % 2}", r.choice(["COD", "Prepaid"]), f"P{k}", f"V{len(rows) // 2}"))
    return rows


@pytest.fixture(scope="module")
def register(spark):
    return spark.createDataFrame(shop(), SCHEMA).cache()


def test_folding_keeps_totals_and_pareto(register):
    for top in (3, 50):
        points = charts.chart(register, "item", "revenue", top).orderBy("position").collect()
        assert sum(p.value for p in points) == pytest.approx(points[0].total)
        assert points[-1].cumulative == pytest.approx(100) and len(points) == min(top + 1, points[0].group_count)
        assert points[-1].is_other == (top == 3) and 1 <= points[0].pareto_count <= points[0].group_count
    ratio = charts.chart(register, "item", "margin_pct", 3).orderBy("position").collect()
    assert ratio[-1].share is None and ratio[-1].label.startswith("Other (")


def test_time_dimensions_keep_their_order(register):
    days = [p.label for p in charts.chart(register, "weekday", "units").orderBy("position").collect()]
    assert days == ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
    months = [p.label for p in charts.chart(register, "month", "revenue").orderBy("position").collect()]
    assert months == sorted(months)
    with pytest.raises(QueryError):
        charts.chart(register, "item", "nonsense")


def test_discount_bases(spark):
    row = spark.createDataFrame([(2.0, 10.0, 12.0, 3.0, 4.0, 100.0)], "quantity double, selling_price double, mrp double, discount double, cost_price double, line_total double")
    one = derive.derived(row).first()
    assert (one.row_revenue, one.row_discount, one.row_cost, one.row_profit) == (17.0, 3.0, 8.0, 9.0)
    one = derive.derived(row.drop("discount")).first()
    assert (one.row_revenue, one.row_discount) == (20.0, 4.0)
    one = derive.derived(row.select("line_total")).first()
    assert (one.row_revenue, one.row_discount, one.row_cost) == (100.0, 0.0, None)
    assert derive.derived(row.withColumn("discount", F.lit(99.0))).first().row_revenue == 0.0
    with pytest.raises(QueryError):
        derive.derived(row.select("mrp"))


def test_windows():
    a, b = dt.date(2026, 1, 1), dt.date(2026, 3, 10)
    w = resolve_window(a, b, AnalysisQuery("week"))
    assert (w.start, w.end, w.previous_start) == (dt.date(2026, 3, 4), dt.date(2026, 3, 11), dt.date(2026, 2, 25))
    assert resolve_window(a, b, AnalysisQuery("month")).start == dt.date(2026, 3, 1)
    w = resolve_window(a, b, AnalysisQuery("all"))
    assert w.previous_start == w.previous_end
    w = resolve_window(a, b, AnalysisQuery("custom", dt.date(2025, 12, 1), dt.date(2026, 1, 5)))
    assert (w.start, w.end) == (a, dt.date(2026, 1, 6))
    w = resolve_window(a, b, AnalysisQuery("custom", dt.date(2024, 1, 1), dt.date(2024, 1, 2)))
    assert w.start == dt.date(2024, 1, 1)
    with pytest.raises(QueryError):
        resolve_window(a, b, AnalysisQuery("custom", b, a))
    with pytest.raises(QueryError):
        AnalysisQuery("fortnight")
    with pytest.raises(QueryError):
        AnalysisQuery(filters={str(k): [] for k in range(9)})


def test_filters_options_and_drill_down(register):
    s = build_slice(register, AnalysisQuery("30days", filters={"branch": ["B1"], "item": []}))
    assert s.current.select("branch").distinct().collect() == [("B1",)] and s.previous.count() > 0
    many = slicing.filtered(register, {"item": [f"I{k:02}" for k in range(6)] + [str(k) for k in range(1100)]})
    assert many.count() == register.filter("item < 'I06'").count()
    with pytest.raises(QueryError):
        slicing.filtered(register, {"row_id": ["1"]})
    values = [r.value for r in slicing.cascading_options(register, AnalysisQuery(filters={"branch": ["B1"]}), "branch").collect()]
    assert values == ["B0", "B1"]
    q = slicing.drill_down(AnalysisQuery(), "month", "2026-02")
    assert (q.start_date, q.end_date) == (dt.date(2026, 2, 1), dt.date(2026, 2, 28)) and slicing.drill_down(q, "weekday", "Mon") is None
    assert slicing.drill_down(q, "item", "I01").filters == {"item": ["I01"]}


def test_everything_reconciles(register):
    for q in (AnalysisQuery(), AnalysisQuery("week"), AnalysisQuery("custom", dt.date(2020, 1, 1), dt.date(2020, 1, 2))):
        assert tuple(reports.reconciliation(build_slice(register, q)).first()) == (0.0, 0.0, 0.0)


def test_kpi_of_an_empty_previous_period(register):
    s = build_slice(register, AnalysisQuery("all"))
    k = reports.kpi(s.current, s.previous).first()
    assert k.prev_revenue == 0 and k.revenue_change == 0 and k.cur_items == 12


def test_ledger_pages(register):
    n = register.count()
    ids = [r.row_id for p in range(1, n // 50 + 2) for r in reports.ledger_page(register, ["row_id"], p, 50).collect()]
    assert sorted(ids) == list(range(n))
    assert reports.ledger_pages(register, 10**6, 50).first().page == -(-n // 50)


def test_abc_partitions_the_catalogue(register):
    rows = inventory.intelligence(register, ["row_id"]).collect()
    assert len(rows) == 12 and {r.abc for r in rows} <= {"A", "B", "C"} and all(0 <= r.priority <= 100 for r in rows)
    assert all(0.25 <= r.trend <= 4 for r in rows)
    assert sum(r.item_count for r in inventory.buckets(register, ["row_id"], "abc").collect()) == 12
    assert inventory.intelligence(register.drop("stock_on_hand"), ["row_id"]).columns.count("days_cover") == 0


def test_forecast_refuses_short_history_and_backtests(spark, register):
    short = spark.createDataFrame(shop(10), SCHEMA)
    assert forecast.forecast(short).count() == 0 and forecast.backtest(short).count() == 0
    points = forecast.forecast(register, 500).collect()
    assert len(points) == 90 and all(0 <= p.lower <= p.expected <= p.upper for p in points)
    assert forecast.backtest(register).first().basis == "daily"
    assert forecast.backtest(spark.createDataFrame(shop(90, gap=3), SCHEMA)).first().basis == "total"
    assert forecast.trend(register).first().direction in ("up", "down", "flat")


def test_anomaly_is_found(spark, register):
    day = dt.datetime(2026, 1, 20)
    spike = [(9000 + k, day, "C0", "I00", 500.0, 50.0, 20.0, 25000.0, 0.0, 0.0, 1.0, 60.0, "B0", "COD", "P", "V") for k in range(3)]
    found = insights.anomalies(register.union(spark.createDataFrame(spike, SCHEMA))).collect()
    assert max(found, key=lambda r: abs(r.z)).day == day.date() and max(found, key=lambda r: abs(r.z)).severity == "critical"


@pytest.mark.parametrize("rows", [[], shop(1)[:1], [r[:4] + (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, None, None) + r[12:] for r in shop(30)], [r[:6] + (r[5] * 3,) + r[7:] for r in shop(30)]], ids=["empty", "one row", "no revenue", "losses only"])
def test_degenerate_shops(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    s = build_slice(df, AnalysisQuery("week"))
    assert reports.kpi(s.current, s.previous).count() == 1 and reports.profit_and_loss(df).count() >= 1
    for out in (charts.chart(df, "item", "revenue"), charts.heatmap(df, "profit"), inventory.intelligence(df, ["row_id"]), insights.insights(df, s.previous), forecast.forecast(df), reports.daily(df)):
        out.collect()


def test_dirty_cells_become_numbers_and_dates(spark):
    cells = spark.createDataFrame([("₹ 1,299.00",), ("12",), ("inf",), ("abc",), (None,), (" ",), ("-3.5",), ("NaN",)], "x string")
    assert [r[0] for r in cells.select(text.number(F.col("x"))).collect()] == [1299.0, 12.0, None, None, None, None, -3.5, None]
    dates = spark.createDataFrame([("2026-04-05",), ("05-04-2026",), ("5/4/2026",), ("31-02-2026",), ("10 Mar 2026",), ("x",), (None,)], "x string")
    got = [r[0] and r[0].strftime("%Y-%m-%d") for r in dates.select(text.timestamp(F.col("x"))).collect()]
    assert got == ["2026-04-05", "2026-04-05", "2026-04-05", None, "2026-03-10", None, None]


def test_ingest_reports_what_it_drops(spark):
    cells = [(1, "01-02-2026", "2", "10", "Pen"), (2, "31-02-2026", "2", "10", "Pen"), (3, "2026-02-03", "x", "10", " "), (4, "2026-02-03", "-1", "10", "Cup"), (5, "2026-02-03", "2.5", None, "Cup"), (6, None, "1", "5", "Cup")]
    df = spark.createDataFrame(cells, "row_id long, d string, q string, p string, i string")
    good, errors = ingest.normalised(df, {"d": "Date", "q": "Quantity", "p": "Selling Price", "i": "Item"})
    assert [r.row_id for r in good.collect()] == [1]
    assert {(r.row, r.column) for r in errors.collect()} == {(2, "Date"), (3, "Quantity"), (4, "Quantity"), (5, "Quantity"), (5, "Selling Price"), (6, "Date")}
    none, lacking = ingest.normalised(df, {"i": "Item"})
    assert none.count() == 0 and lacking.filter("row = 0").count() == 2


def test_masking_formats_and_slugs(spark):
    one = lambda x, f: spark.createDataFrame([(x,)], "x string").select(f(F.col("x"))).first()[0]
    assert one("a.b@shop.co.in or +91 98765 43210, 123456789012", text.masked) == "[email] or [phone], [number]"
    assert one("Delivery Charge %", text.slug) == "delivery_charge_pct"
    assert spark.range(1).select(numbers.indian_grouping(F.lit(-1234567.0))).first()[0] == "-12,34,567"
    assert spark.range(1).select(numbers.compact_money(F.lit(234567.0))).first()[0] == "2.35L"
    assert spark.range(1).select(text.claimed_numbers(F.lit("Up 1,20,000 or 1.5 lakh on 3 days"))).first()[0] == [120000.0, 150000.0, 3.0]
    assert spark.range(1).select(text.supported(F.lit(100.4), F.array(F.lit(100.0)))).first()[0]


def test_headers(spark):
    names = ["Voucher Date", "Qty.", "Purchase Rate", "Total Qty", "Customer Phone", "Discount %", "Net Amount", "Notes", "date", "Date"]
    got = [r.field for r in headers.guessed(headers.header_table(spark, names)).orderBy("ordinal").collect()]
    assert got == ["Date", "Quantity", "Cost Price", "Quantity", None, "Discount", "Line Total", None, "Date", "Date"]
    kept = [r.field for r in headers.suggested(headers.header_table(spark, names)).orderBy("ordinal").collect()]
    assert kept.count("Date") == 1 and kept.count("Quantity") == 1
    assert memory.signature(["b ", "A"]) == memory.signature(["a", "B"]) != memory.signature(["a"])
    own = spark.createDataFrame([("notes", "Item"), ("qty.", "Stock On Hand")], "alias string, alias_field string")
    got = {r.header: (r.field, r.confidence) for r in headers.guessed(headers.header_table(spark, ["Notes", "Qty.", "date", "Customer Phone"]), own).collect()}
    assert got == {"Notes": ("Item", "exact"), "Qty.": ("Stock On Hand", "exact"), "date": ("Date", "exact"), "Customer Phone": (None, "none")}
    with pytest.raises(QueryError):
        headers.checked(["a", "b"], {"a": "Date", "b": "Date"})
    new = spark.createDataFrame([("Qty", "Quantity"), ("Foo", None), ("Bar", "Item"), ("Bar", "Size"), ("Baz", "Item")], "phrase string, target string")
    known = spark.createDataFrame([("qty", "Quantity")], "phrase string, target string")
    assert {r.phrase: r.state for r in headers.staged(new, known).collect()} == {"qty": "present", "foo": "unmapped", "bar": "conflict", "baz": "new"}


def test_extra_columns(spark):
    rows = [(f"{k % 4} City", str(100 + k * 3 % 17), f"{k % 5 * 5}", f"p{k}@x.org", f"00{k}", f"long free text {k}") for k in range(40)]
    df = spark.createDataFrame(rows, "City string, `Delivery Charge` string, `GST %` string, Person string, `Order Code` string, Remarks string")
    got = extras.classified(df, df.columns)
    assert [got[c]["role"] for c in df.columns] == ["x_dim", "x_meas", "x_meas", "x_col", "x_col", "x_col"] and got["GST %"]["aggregation"] == "average"
    out = extras.with_extras(df, got).first()
    assert out["x_col_person"] == "[redacted]" and out["x_dim_city"] == "0 City" and out["x_col_order_code"] == "000"
    assert extras.slugs(["A b", "a-b", "%"]) == {"A b": "a_b", "a-b": "a_b_2", "%": "pct"}


def test_evidence_and_capabilities(register):
    assert evidence.product_match(register, F.col("line_total")).first().matches
    assert evidence.invoice_repeat(register.withColumn("t", F.col("invoice_no")), "t").first().repeats
    assert not evidence.invoice_repeat(register, "line_total").first().repeats
    assert evidence.slab_coverage(register, F.lit(18.0)).first().is_rate
    blank = register.withColumn("cost_price", F.when(F.col("row_id") > 0, F.col("cost_price")))
    reasons = {r.name: r for r in extras.capabilities(blank).collect()}
    assert not reasons["profit"].available and "cost_price" in reasons["profit"].reason and reasons["revenue"].available and not reasons["size"].available


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Date;Code;Name\n01-02-2026;00123;Café\n".encode())
    df = files.read_cells(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["Date", "Code", "Name"] and df.first().Code == "00123" and df.first().Name == "Café"
    (tmp_path / "b.csv").write_bytes("Date,Name\n01-02-2026,Caf\xe9\n".encode("latin-1"))
    assert files.read_cells(spark, str(tmp_path / "b.csv")).first().Name == "Café"
    assert files.preview(df, ["Name"]).first().Name == "[redacted]"
    with pytest.raises(QueryError):
        files.read_cells(spark, str(tmp_path / "c.xls"))
    import zipfile

    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Item</t></si><si><t>Pen</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Qty</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>3</v></c></row></sheetData></worksheet>')
    assert workbooks.read_workbook(spark, str(tmp_path / "d.xlsx")).collect() == [("Pen", "3")]
