"""Every registered query with its SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fields import MEASURES, TIME_DIMENSIONS
from ..functions import numbers, text
from ..operators import charts, derive, evidence, extras, forecast, headers, ingest, insights, inventory, reports, slicing
from ..operators.slicing import AnalysisQuery, build_slice
from ..sources.register import ROW_ORDER, star_days, star_register
from ..streaming import events
from . import column_queries, sql, store_queries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, run: Query, oracle: str | None) -> None:
    QUERIES[name] = run
    if oracle:
        SQL[name] = oracle


def sliced(run: Callable[[slicing.Slice], DataFrame], query: AnalysisQuery = AnalysisQuery()) -> Query:  # noqa: B008
    return lambda spark, d: run(build_slice(star_register(spark, d), query, star_days(spark, d)))


def whole(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: run(star_register(spark, d))


MONTH, WEEK, DAYS30, TODAY = (AnalysisQuery(k) for k in ("month", "week", "30days", "today"))
BRANCHES = ["NATION_9", "NATION_6", "NATION_11"]
FILTERED = AnalysisQuery("30days", filters={"branch": BRANCHES, "payment_mode": []})
CUSTOM = AnalysisQuery("custom", date(1997, 3, 1), date(1997, 8, 31))
IN_CUSTOM = "sale_date >= TIMESTAMP '1997-03-01' AND sale_date < TIMESTAMP '1997-09-01'"
LAST30, BEFORE30 = sql.last_days(30)
BASE, BASE30 = sql.base(), sql.base(LAST30, BEFORE30)


def _charts() -> None:
    for dimension, measure, kind in [
        ("category", "revenue", "month"), ("category", "revenue", "all"), ("item", "revenue", "all"), ("branch", "profit", "all"), ("brand", "units", "30days"), ("payment_mode", "transactions", "all"),
        ("salesperson", "cost", "all"), ("colour", "discount", "all"), ("size", "margin_pct", "all"), ("item", "avg_price", "all"), ("x_dim_returnflag", "revenue", "all"), ("customer", "revenue", "all"),
        ("month", "revenue", "all"), ("weekday", "profit", "all"), ("day", "units", "30days"), ("month", "margin_pct", "all"), ("invoice_no", "revenue", "week"), ("category", "margin_pct", "today"),
    ]:
        q = AnalysisQuery(kind)
        add(f"agg01_{measure}_by_{dimension}_{kind}", sliced(lambda s, d=dimension, m=measure: charts.chart(s.current, d, m), q), sql.chart(dimension, measure, sql.RANGE[kind], MEASURES[measure][0], dimension in TIME_DIMENSIONS))
    add("srt01_top3_fold", sliced(lambda s: charts.chart(s.current, "item", "revenue", 3)), sql.chart("item", "revenue", "TRUE", True, False, 3))
    add("flt05_filtered_chart", sliced(lambda s: charts.chart(s.current, "category", "revenue"), FILTERED), sql.chart("category", "revenue", f"{LAST30} AND branch IN ('NATION_9','NATION_6','NATION_11')", True, False))
    add("flt02_custom_range", sliced(lambda s: charts.chart(s.current, "category", "revenue"), CUSTOM), sql.chart("category", "revenue", IN_CUSTOM, True, False))
    add("agg04_extra_sum", whole(lambda r: charts.extra_measure(r, "category", "x_meas_order_total", False)), BASE + f"SELECT category AS label, {sql.s('x_meas_order_total')} AS value, COUNT(x_meas_order_total) AS n FROM cur GROUP BY 1")
    add("agg04_extra_mean", whole(lambda r: charts.extra_measure(r, "branch", "x_meas_order_total", True)), BASE + f"SELECT branch AS label, {sql.s('x_meas_order_total')} / COUNT(x_meas_order_total) AS value, COUNT(x_meas_order_total) AS n FROM cur GROUP BY 1")
    cells = sql.base(LAST30) + f", c AS (SELECT CAST(date_trunc('week', sale_date) AS DATE) AS week_start, strftime(sale_date, '%a') AS weekday, {sql.s('row_revenue')} AS value FROM p GROUP BY 1, 2)"
    add("agg07_heatmap", sliced(lambda s: charts.heatmap(s.current, "revenue"), DAYS30), cells + "SELECT week_start, 'W' || strftime(week_start, '%V') AS week, weekday, value, 0.08::DOUBLE + 0.92::DOUBLE * COALESCE((value - MIN(value) OVER ()) / NULLIF(MAX(value) OVER () - MIN(value) OVER (), 0), 0.0) AS intensity FROM c")
    add("jn12_heatmap_grid", sliced(lambda s: charts.heatmap_grid(s.current, "revenue"), DAYS30), cells + ", w AS (SELECT DISTINCT week_start FROM c), k AS (SELECT unnest(['Mon','Tue','Wed','Thu','Fri','Sat','Sun']) AS weekday) SELECT w.week_start, k.weekday, COALESCE(value, 0.0) AS value FROM w CROSS JOIN k LEFT JOIN c ON c.week_start = w.week_start AND c.weekday = k.weekday")


def _slices() -> None:
    add("agg15_date_range", whole(slicing.date_range), BASE + "SELECT MIN(CAST(sale_date AS DATE)) AS min_day, MAX(CAST(sale_date AS DATE)) AS max_day, CAST(date_diff('day', MIN(CAST(sale_date AS DATE)), MAX(CAST(sale_date AS DATE))) + 1 AS INTEGER) AS span_days FROM cur")
    add("flt08_completeness", whole(derive.completeness), BASE + "SELECT COUNT(*) AS n_rows, " + ", ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL) AS blank_{c}" for c in ("quantity", "selling_price", "cost_price", "line_total", "discount", "tax", "stock_on_hand", "mrp")) + " FROM cur")
    dims = ["category", "item", "branch", "payment_mode", "customer", "salesperson", "brand", "size", "colour", "invoice_no", "x_dim_returnflag"]
    add("flt10_dimension_options", whole(slicing.dimension_options), BASE + "SELECT dimension, value FROM (SELECT dimension, value, row_number() OVER (PARTITION BY dimension ORDER BY value) AS rn FROM (" + " UNION ".join(f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value FROM cur" for d in dims) + ")) WHERE rn <= 200")
    add("flt09_cascading_options", whole(lambda r: slicing.cascading_options(r, FILTERED, "branch", "_1")), sql.base(LAST30) + "SELECT DISTINCT branch AS value FROM cur WHERE contains(lower(branch), '_1')")
    add("set01_selected_options", sliced(lambda s: slicing.selected_options(s.current, "branch", BRANCHES), WEEK), sql.base(sql.RANGE["week"]) + "SELECT branch FROM cur INTERSECT SELECT unnest(['NATION_9','NATION_6','NATION_11'])")
    add("ing16_derived_totals", whole(lambda r: derive.derived(r).groupBy("category").agg(*[numbers.exact_sum(F.col(c)).alias(c) for c in ("row_revenue", "row_discount", "row_cost", "row_profit", "row_tax")])), BASE + "SELECT category, " + ", ".join(f"{sql.s(c)} AS {c}" for c in ("row_revenue", "row_discount", "row_cost", "row_profit", "row_tax")) + " FROM p GROUP BY 1")
    mrp = BASE + f"SELECT category, {sql.s('CASE WHEN mrp > 0 AND mrp >= selling_price THEN GREATEST((mrp - selling_price) * quantity, 0.0) ELSE 0.0 END')} AS row_discount, {sql.s('quantity * selling_price')} AS row_revenue FROM cur GROUP BY 1"
    add("ing16_mrp_discount_basis", whole(lambda r: derive.derived(r.drop("discount", "line_total")).groupBy("category").agg(numbers.exact_sum(F.col("row_discount")).alias("row_discount"), numbers.exact_sum(F.col("row_revenue")).alias("row_revenue"))), mrp)


def _reports() -> None:
    sums = lambda src, p: f"SELECT {', '.join(f'COALESCE({sql.s(x)}, 0) AS {p}_{n}' for n, x in (('revenue', 'row_revenue'), ('cost', 'row_cost'), ('profit', 'row_profit'), ('units', 'quantity')))}, COUNT(DISTINCT CASE WHEN item <> 'Unspecified' THEN item END) AS {p}_items FROM {src}"
    prev = sql.DERIVED.replace("FROM cur", "FROM prev").replace(", d AS", ", d2 AS").replace("FROM d)", "FROM d2)").replace(", p AS", ", p2 AS")
    change = ", ".join(f"COALESCE((cur_{m} - prev_{m}) / NULLIF(prev_{m}, 0) * 100, 0.0) AS {m}_change" for m in ("revenue", "cost", "profit", "units"))
    add("agg08_kpi", sliced(lambda s: reports.kpi(s.current, s.previous), DAYS30), BASE30 + prev + f", a AS ({sums('p', 'cur')}), b AS ({sums('p2', 'prev')}) SELECT cur_revenue, cur_cost, cur_profit, cur_units, prev_revenue, prev_cost, prev_profit, prev_units, cur_items, {change}, COALESCE(cur_profit / NULLIF(cur_revenue, 0) * 100, 0.0) AS margin_pct, cur_cost / NULLIF(cur_revenue, 0) * 100 AS cost_pct, cur_units / NULLIF(cur_items, 0) AS units_per_item FROM a, b")
    add("agg11_daily_summary", sliced(lambda s: reports.daily(s.current), MONTH), sql.base(sql.RANGE["month"]) + sql.DAILY + "SELECT *, COALESCE(profit / NULLIF(revenue, 0) * 100, 0.0) AS margin_pct FROM daily")
    one = AnalysisQuery("all", filters={"branch": ["NATION_9"], "brand": ["Brand#11"]})
    add("jn01_zero_filled_days", sliced(lambda s: reports.daily(s.current), one), sql.base("branch = 'NATION_9' AND brand = 'Brand#11'") + sql.DAILY + "SELECT *, COALESCE(profit / NULLIF(revenue, 0) * 100, 0.0) AS margin_pct FROM daily")
    add("win06_trailing_mean", sliced(lambda s: reports.trailing_mean(reports.daily(s.current)), DAYS30), sql.base(LAST30) + sql.DAILY + f"SELECT day, revenue, CASE WHEN COUNT(*) OVER (ORDER BY day ROWS 6 PRECEDING) = 7 THEN {sql.over('revenue', 'ORDER BY day ROWS 6 PRECEDING')} / 7 END AS mean_7 FROM daily")
    add("agg13_category_ledger", whole(reports.category_ledger), BASE + f", g AS (SELECT category AS label, {sql.TOTALS} FROM p GROUP BY 1) SELECT label, units, revenue, cost, profit, COALESCE(profit / NULLIF(revenue, 0) * 100, 0.0) AS margin_pct FROM g")
    add("agg32_ledger_total", whole(reports.ledger_total), BASE + f", g AS (SELECT {sql.TOTALS}, COUNT(DISTINCT CAST(sale_date AS DATE)) AS days FROM p) SELECT units, revenue, cost, profit, profit / NULLIF(revenue, 0) * 100 AS margin_pct, revenue / NULLIF(days, 0) AS revenue_per_day FROM g")
    add("agg32_revenue_mix", whole(reports.revenue_mix), BASE + f", g AS (SELECT category AS label, {sql.TOTALS} FROM p GROUP BY 1) SELECT label, revenue, revenue / {sql.over('revenue')} * 100 AS share FROM g WHERE revenue > 0 ORDER BY revenue DESC, label LIMIT 6")
    add("srt03_top_items", whole(reports.top_items), BASE + f"SELECT item, units, revenue FROM (SELECT item, {sql.TOTALS} FROM p GROUP BY 1) ORDER BY units DESC, item LIMIT 5")
    slow = f", g AS (SELECT item, {sql.s('quantity')} AS units, MAX(CAST(sale_date AS DATE)) AS last_sale FROM cur GROUP BY 1), h AS (SELECT item, units, last_sale, CAST(date_diff('day', last_sale, MAX(last_sale) OVER ()) AS INTEGER) AS days_idle FROM g) SELECT * FROM h WHERE units <= 40"
    add("anl11_slow_items", sliced(lambda s: reports.slow_items(s.current, 40), AnalysisQuery("week", filters={"branch": ["NATION_9", "NATION_7"]})), sql.base(sql.RANGE["week"] + " AND branch IN ('NATION_9','NATION_7')") + slow)
    pnl = f""", t AS (SELECT {sql.s('row_revenue')} AS net, {sql.s('row_discount')} AS given, {sql.s('row_cost')} AS cost, {sql.s('row_profit')} AS profit, {sql.s('row_tax')} AS tax FROM p),
 l AS (SELECT 1 AS position, 'Gross Sales' AS line, net + given AS amount FROM t WHERE given > 0 UNION ALL SELECT 2, 'Less: Discounts Allowed', -given FROM t WHERE given > 0 UNION ALL SELECT 3, 'Net Revenue', net FROM t WHERE given > 0
 UNION ALL SELECT 1, 'Gross Revenue', net FROM t WHERE COALESCE(given, 0) <= 0 UNION ALL SELECT 4, 'Cost of Goods Sold', cost FROM t UNION ALL SELECT 5, 'Gross Profit', profit FROM t UNION ALL SELECT 6, 'Tax Collected (memo)', tax FROM t WHERE tax > 0)
 SELECT position, line, amount, amount / NULLIF((SELECT net FROM t), 0) * 100 AS pct FROM l"""
    add("agg14_profit_and_loss", whole(reports.profit_and_loss), BASE + pnl)
    add("srt04_ledger_page", sliced(lambda s: reports.ledger_page(s.current, ROW_ORDER, 3, 50).select("sale_date", "item", "quantity", "row_revenue", "row_profit", *ROW_ORDER), DAYS30), sql.base(LAST30) + f"SELECT sale_date, item, quantity, row_revenue, row_profit, {sql.ORDER} FROM p ORDER BY sale_date, {sql.ORDER} LIMIT 50 OFFSET 100")
    add("srt04_deep_page", lambda spark, d: _deep_page(star_register(spark, d)), BASE + f", c AS (SELECT COUNT(*) AS n FROM cur), g AS (SELECT CAST(ceil(ceil(n / 50.0) * 0.7) AS BIGINT) AS page FROM c), o AS (SELECT sale_date, item, row_revenue, {sql.ORDER}, row_number() OVER (ORDER BY sale_date, {sql.ORDER}) AS rn FROM p) SELECT sale_date, item, row_revenue, {sql.ORDER}, page FROM o, g WHERE rn > (page - 1) * 50 AND rn <= page * 50")
    add("srt04_ledger_pages", whole(lambda r: reports.ledger_pages(r, 10**9)), BASE + "SELECT COUNT(*) AS n_rows, GREATEST(CAST(ceil(COUNT(*) / 50.0) AS BIGINT), 1) AS total_pages, GREATEST(CAST(ceil(COUNT(*) / 50.0) AS BIGINT), 1) AS page FROM cur")
    fine, usable = "mrp > 0 AND selling_price <= mrp", "mrp IS NOT NULL AND mrp > 0"
    gap, listed = sql.s("(mrp - selling_price) * quantity"), sql.s("mrp * quantity")
    add("agg16_discount_metrics", whole(reports.discount_metrics), BASE + f"SELECT COALESCE({sql.s(f'CASE WHEN {fine} THEN (mrp - selling_price) * quantity END')}, 0.0) AS given, COALESCE({sql.s(f'CASE WHEN {fine} THEN (mrp - selling_price) * quantity END')} / NULLIF({sql.s(f'CASE WHEN {fine} THEN mrp * quantity END')}, 0) * 100, 0.0) AS pct_of_mrp, COUNT(*) FILTER (WHERE {fine}) AS valid_rows, COUNT(*) FILTER (WHERE NOT ({usable})) AS missing_rows, COUNT(*) FILTER (WHERE {usable} AND selling_price > mrp) AS above_mrp_rows FROM cur")
    add("agg17_discount_by_item", whole(reports.discount_by_item), BASE + f", g AS (SELECT item, {gap} AS given, {listed} AS listed, {sql.s('row_revenue')} AS revenue, {sql.s('row_profit')} AS profit FROM p WHERE {fine} GROUP BY 1) SELECT item, given / NULLIF(listed, 0) * 100 AS discount_pct, profit / NULLIF(revenue, 0) * 100 AS margin_pct, revenue FROM g ORDER BY discount_pct DESC, item LIMIT 15")
    some = sql.base(f"{LAST30} AND branch IN ('NATION_9','NATION_6','NATION_11')")
    part = lambda key: f"(SELECT {sql.s('v')} FROM (SELECT {sql.s('row_revenue')} AS v FROM p GROUP BY {key}))"
    less = lambda x: f"CAST(CAST(COALESCE((SELECT {sql.s('row_revenue')} FROM p), 0.0) - COALESCE({x}, 0.0) AS DECIMAL(20,2)) AS DOUBLE)"
    net = "(SELECT " + sql.s("COALESCE(quantity * selling_price, line_total) - discount") + " FROM cur)"
    add("agg29_reconciliation", sliced(reports.reconciliation, FILTERED), some + f" SELECT {less(net)} AS kpi_less_pnl, {less(part('category'))} AS kpi_less_categories, {less(part('CAST(sale_date AS DATE)'))} AS kpi_less_days")


def _deep_page(register: DataFrame) -> DataFrame:
    """The page at 70 % of the ledger: it reads one range of the index, not the rows before it."""
    rows, index = reports.ledger_index(register, ROW_ORDER, ["item", "row_revenue"])
    pages = -(-index.agg(F.sum("n")).first()[0] // 50)
    return reports.indexed_page(rows, index, math.ceil(pages * 0.7), 50).select("sale_date", "item", "row_revenue", *ROW_ORDER, "page")


def _inventory() -> None:
    columns = "item, category, units, revenue, last_sale, active_days, mean_cost, stock, velocity, velocity_active, days_idle, trend, abc, priority, ageing, days_cover, reorder, capital"
    pick = [c.strip() for c in columns.split(",")]
    france = AnalysisQuery("30days", filters={"branch": ["NATION_9"]})
    in_france = sql.base(LAST30 + " AND branch = 'NATION_9'") + sql.INVENTORY
    idle = "CAST(days_idle AS INTEGER) AS days_idle"
    add("inv01_intelligence", sliced(lambda s: inventory.intelligence(s.current, ROW_ORDER).select(*pick), france), in_france + f"SELECT {columns.replace('days_idle', idle)} FROM inv")
    add("inv04_ranked", sliced(lambda s: inventory.ranked(s.current, ROW_ORDER, 10).select("item", "priority"), DAYS30), sql.base(LAST30) + sql.INVENTORY + "SELECT item, priority FROM inv ORDER BY priority DESC, item LIMIT 10")
    bucket = lambda by: f"SELECT {by} AS bucket, COUNT(*) AS item_count, {sql.s('units')} AS units, {sql.s('revenue')} AS revenue FROM inv GROUP BY 1"
    add("win04_abc_buckets", sliced(lambda s: inventory.buckets(s.current, ROW_ORDER, "abc"), DAYS30), sql.base(LAST30) + sql.INVENTORY + f", b AS ({bucket('abc')}), k AS (SELECT unnest(['A','B','C']) AS bucket), j AS (SELECT k.bucket, COALESCE(item_count, 0) AS item_count, COALESCE(units, 0.0) AS units, COALESCE(revenue, 0.0) AS revenue FROM k LEFT JOIN b ON b.bucket = k.bucket) SELECT *, COALESCE(revenue / NULLIF({sql.over('revenue')}, 0) * 100, 0.0) AS revenue_share FROM j")
    add("agg19_ageing_buckets", sliced(lambda s: inventory.buckets(s.current, ROW_ORDER, "ageing"), AnalysisQuery("all", filters={"salesperson": ["Supplier#000000001", "Supplier#000000002"]})), sql.base("salesperson IN ('Supplier#000000001','Supplier#000000002')") + sql.INVENTORY + f", b AS ({bucket('ageing')}) SELECT *, COALESCE(revenue / NULLIF({sql.over('revenue')}, 0) * 100, 0.0) AS revenue_share FROM b")
    add("fcs04_item_demand", sliced(lambda s: inventory.item_demand(s.current, ROW_ORDER, 14), DAYS30), sql.base(LAST30) + sql.INVENTORY + ", z AS (SELECT item, units, velocity, LEAST(GREATEST(CASE WHEN early > 0 AND late > 0 THEN late / early WHEN late > 0 THEN 2.0 ELSE 0.5 END, 0.25), 4.0) AS trend FROM i2) SELECT item, units, trend, velocity * trend * 14 AS expected FROM z ORDER BY units DESC, item LIMIT 20")


def _insights() -> None:
    z = "CASE WHEN mad > 0 THEN 0.6745::DOUBLE * (revenue - med) / mad ELSE (revenue - med) / NULLIF(sd, 0) END"
    anomaly = sql.DAILY + f""", a0 AS (SELECT day, revenue, AVG(CASE WHEN revenue <= 0 THEN 1.0 ELSE 0.0 END) OVER () > 0.25 AS sparse FROM daily), a1 AS (SELECT day, revenue FROM a0 WHERE NOT sparse OR revenue > 0),
 a2 AS (SELECT median(revenue) AS med, {sql.six('stddev_pop(revenue)')} AS sd, COUNT(*) AS n FROM a1), a3 AS (SELECT median(abs(revenue - med)) AS mad FROM a1, a2),
 a4 AS (SELECT day, revenue, {z} AS z FROM a1, a2, a3 WHERE n >= 7 AND med > 0)
 SELECT day, revenue, z, CASE WHEN abs(z) >= 3 THEN 'critical' WHEN z < 0 THEN 'warning' ELSE 'positive' END AS severity FROM a4 WHERE abs(z) >= 2"""
    add("anl01_anomalies", sliced(lambda s: insights.anomalies(s.current)), BASE + anomaly)
    add("anl01_anomalies_sparse", sliced(lambda s: insights.anomalies(s.current), AnalysisQuery("all", filters={"branch": ["NATION_9"], "brand": ["Brand#11"]})), sql.base("branch = 'NATION_9' AND brand = 'Brand#11'") + anomaly)
    change = f"""SELECT a.item, {sql.six('a.revenue - b.revenue')} AS change FROM (SELECT item, {sql.s('row_revenue')} AS revenue FROM p GROUP BY 1) a JOIN (SELECT item, {sql.s('GREATEST(COALESCE(quantity*selling_price, line_total) - COALESCE(discount, 0.0), 0.0)')} AS revenue FROM prev GROUP BY 1) b USING (item)"""
    add("anl02_movers", sliced(lambda s: insights.movers(s.current, s.previous), DAYS30), BASE30 + f", ch AS ({change}), u AS (SELECT * FROM ch ORDER BY change DESC, item DESC LIMIT 1), v AS (SELECT * FROM ch ORDER BY change, item LIMIT 1) SELECT * FROM u WHERE change > 1 UNION SELECT * FROM v WHERE change < -1")
    leak = sql.ITEMS + f""", m0 AS (SELECT item, category, revenue, profit / revenue * 100 AS margin, revenue / {sql.over('revenue')} AS share FROM it WHERE revenue > 0), cm AS (SELECT category, median(margin) AS cmed, COUNT(*) AS n FROM m0 GROUP BY 1), sm AS (SELECT median(margin) AS smed FROM m0),
 m1 AS (SELECT item, share, margin, CASE WHEN n >= 3 THEN cmed ELSE smed END AS benchmark FROM m0 JOIN cm USING (category), sm), m2 AS (SELECT *, CASE WHEN margin < 0 THEN abs(margin) + 100 ELSE benchmark - margin END AS gap FROM m1) SELECT item, margin, benchmark, gap FROM m2 WHERE share >= 0.03 AND gap >= 10"""
    few = AnalysisQuery("week", filters={"branch": ["NATION_9"]})
    add("anl03_margin_leaks", sliced(lambda s: insights.margin_leaks(s.current), few), sql.base(sql.RANGE["week"] + " AND branch = 'NATION_9'") + leak)
    add("anl04_discount_leader", sliced(lambda s: insights.discount_leader(s.current)), BASE + f", g AS (SELECT item, {sql.s('(mrp - selling_price) * quantity')} AS given, {sql.s('mrp * quantity')} AS listed FROM cur WHERE mrp > 0 AND selling_price <= mrp GROUP BY 1), h AS (SELECT item, given / listed * 100 AS discount_pct, {sql.over('given')} / {sql.over('listed')} * 100 AS overall_pct, COUNT(*) OVER () AS n FROM g WHERE listed > 0), f AS (SELECT * FROM h ORDER BY discount_pct DESC, item LIMIT 1) SELECT item, discount_pct, overall_pct FROM f WHERE n >= 3 AND discount_pct - overall_pct >= 3")
    add("anl05_margin_gaps", sliced(lambda s: insights.margin_gaps(s.current), AnalysisQuery("month", filters={"branch": ["NATION_14"]})), sql.base(sql.RANGE["month"] + " AND branch = 'NATION_14'") + sql.ITEMS + f", g AS (SELECT item, profit / NULLIF(revenue, 0) * 100 AS margin, {sql.over('profit')} / {sql.over('revenue')} * 100 AS overall, row_number() OVER (ORDER BY revenue DESC, item) AS rn FROM it) SELECT item, margin, overall FROM g WHERE rn <= 3 AND margin < overall - 5")
    add("anl06_payment_mix", sliced(lambda s: insights.payment_mix(s.current)), BASE + f", g AS (SELECT payment_mode, {sql.TOTALS} FROM p GROUP BY 1), h AS (SELECT payment_mode, revenue, revenue / {sql.over('revenue')} * 100 AS share, profit / NULLIF(revenue, 0) * 100 AS margin FROM g) SELECT *, share >= 50 AS is_dominant FROM h")
    add("anl07_concentration", sliced(lambda s: insights.concentration(s.current)), BASE + sql.ITEMS + f", g AS (SELECT {sql.over('revenue', 'ORDER BY revenue DESC, item ROWS UNBOUNDED PRECEDING')} / {sql.over('revenue')} AS running FROM it WHERE revenue > 0), h AS (SELECT COUNT(*) AS n_items, COUNT(*) FILTER (WHERE running < 0.8) + 1 AS n_needed FROM g) SELECT *, n_items >= 8 AND n_needed / n_items::DOUBLE <= 0.2 AS is_concentrated FROM h")
    add("anl08_weekday_timing", sliced(lambda s: insights.weekday_timing(s.current)), BASE + f", g AS (SELECT CAST(sale_date AS DATE) AS day, {sql.s('row_revenue')} AS revenue FROM p GROUP BY 1), h AS (SELECT strftime(day, '%a') AS weekday, {sql.s('revenue')} / COUNT(*) AS mean_revenue, COUNT(*) AS days FROM g GROUP BY 1) SELECT weekday, mean_revenue, days, row_number() OVER (ORDER BY mean_revenue DESC, weekday) = 1 AS is_best, row_number() OVER (ORDER BY mean_revenue, weekday) = 1 AS is_worst FROM h WHERE days >= 2")
    add("anl09_dead_stock", sliced(lambda s: insights.dead_stock(s.current), AnalysisQuery("all", filters={"salesperson": ["Supplier#000000001"]})), sql.base("salesperson = 'Supplier#000000001'") + sql.ITEMS + ", g AS (SELECT item, CAST(date_diff('day', last_sale, MAX(last_sale) OVER ()) AS INTEGER) AS days_idle, revenue FROM it) SELECT * FROM g WHERE days_idle >= 30")
    month = lambda rest: f"({BASE30}{rest})"
    best = f", g AS (SELECT CAST(sale_date AS DATE) AS day, {sql.s('row_revenue')} AS revenue FROM p GROUP BY 1), h AS (SELECT strftime(day, '%a') AS weekday, {sql.s('revenue')} / COUNT(*) AS mean_revenue, COUNT(*) AS days FROM g GROUP BY 1) SELECT weekday, mean_revenue FROM h WHERE days >= 2 ORDER BY mean_revenue DESC, weekday LIMIT 1"
    moved = f", ch AS ({change}), u AS (SELECT * FROM ch ORDER BY change DESC, item DESC LIMIT 1), v AS (SELECT * FROM ch ORDER BY change, item LIMIT 1) SELECT * FROM u WHERE change > 1 UNION SELECT * FROM v WHERE change < -1"
    leader = f", g AS (SELECT item, {sql.s('(mrp - selling_price) * quantity')} AS given, {sql.s('mrp * quantity')} AS listed FROM cur WHERE mrp > 0 AND selling_price <= mrp GROUP BY 1), h AS (SELECT item, given / listed * 100 AS discount_pct, {sql.over('given')} / {sql.over('listed')} * 100 AS overall_pct, COUNT(*) OVER () AS n FROM g WHERE listed > 0), f AS (SELECT * FROM h ORDER BY discount_pct DESC, item LIMIT 1) SELECT item, discount_pct FROM f WHERE n >= 3 AND discount_pct - overall_pct >= 3"
    gaps = sql.ITEMS + f", g AS (SELECT item, profit / NULLIF(revenue, 0) * 100 AS margin, {sql.over('profit')} / {sql.over('revenue')} * 100 AS overall, row_number() OVER (ORDER BY revenue DESC, item) AS rn FROM it) SELECT item, overall - margin AS gap FROM g WHERE rn <= 3 AND margin < overall - 5"
    modes = f", g AS (SELECT payment_mode, {sql.TOTALS} FROM p GROUP BY 1), h AS (SELECT payment_mode, revenue / {sql.over('revenue')} * 100 AS share FROM g) SELECT payment_mode, share FROM h WHERE share >= 50"
    dense = sql.ITEMS + f", g AS (SELECT {sql.over('revenue', 'ORDER BY revenue DESC, item ROWS UNBOUNDED PRECEDING')} / {sql.over('revenue')} AS running FROM it WHERE revenue > 0), h AS (SELECT COUNT(*) AS n_items, COUNT(*) FILTER (WHERE running < 0.8) + 1 AS n_needed FROM g) SELECT * FROM h WHERE n_items >= 8 AND n_needed / n_items::DOUBLE <= 0.2"
    idle = sql.ITEMS + ", g AS (SELECT item, date_diff('day', last_sale, MAX(last_sale) OVER ()) AS days_idle FROM it) SELECT * FROM g WHERE days_idle >= 30 ORDER BY days_idle DESC, item LIMIT 1"
    enough = f"(SELECT COUNT(*) >= 30 FROM {month(' SELECT 1 FROM cur')})"
    parts = [
        f"(SELECT 'anomaly' AS kind, CAST(day AS VARCHAR) AS subject, severity, abs(z) AS impact FROM {month(anomaly)} ORDER BY abs(z) DESC, day LIMIT 2)",
        f"(SELECT 'mover', item, CASE WHEN change > 0 THEN 'positive' ELSE 'warning' END, abs(change) FROM {month(moved)})",
        f"(SELECT 'margin leak', item, 'critical', gap FROM {month(leak)} ORDER BY gap DESC, item LIMIT 1)",
        f"(SELECT 'dead stock', item, 'warning', CAST(days_idle AS DOUBLE) FROM {month(idle)})",
        f"(SELECT 'best weekday', weekday, 'neutral', mean_revenue FROM {month(best)})",
        f"(SELECT 'discount leader', item, 'warning', discount_pct FROM {month(leader)} WHERE {enough})",
        f"(SELECT 'margin gap', item, 'warning', gap FROM {month(gaps)} WHERE {enough})",
        f"(SELECT 'payment mix', payment_mode, 'neutral', share FROM {month(modes)} WHERE {enough})",
        f"(SELECT 'concentration', CAST(n_needed AS VARCHAR), 'warning', CAST(n_items AS DOUBLE) FROM {month(dense)} WHERE {enough})",
    ]
    add("anl10_insights", sliced(lambda s: insights.insights(s.current, s.previous), DAYS30), f"SELECT kind, subject, severity, impact FROM ({' UNION ALL '.join(parts)}) ORDER BY list_position(['critical', 'warning', 'positive', 'neutral'], severity), impact DESC, kind, subject LIMIT 6")


def _forecast() -> None:
    fit = sql.fitted("daily", 21)
    base = BASE + sql.DAILY + fit
    window = AnalysisQuery("custom", date(2001, 6, 1), date(2001, 8, 31))
    where = "sale_date >= TIMESTAMP '2001-06-01' AND sale_date < TIMESTAMP '2001-09-01'"
    recent = sql.base(where) + sql.DAILY + fit
    one = f", o AS (SELECT MAX(day) AS last, MIN(n) AS n, MIN(slope) AS slope, MIN(intercept) AS intercept, {sql.six('stddev_pop(revenue - fit * season)')} AS sigma FROM fit), se AS (SELECT strftime(day, '%a') AS wd, MIN(season) AS season FROM fit GROUP BY 1), ah AS (SELECT o.*, h, CAST(last + CAST(h AS INTEGER) AS DATE) AS day FROM o, (SELECT unnest(generate_series(1, 14)) AS h)), e AS (SELECT day, GREATEST((intercept + slope * (n - 1 + h)) * COALESCE(season, 1.0), 0.0) AS e, 1.2816::DOUBLE * sigma * sqrt(1 + h / n::DOUBLE) AS s FROM ah LEFT JOIN se ON strftime(day, '%a') = wd) "
    add("fcs01_forecast", sliced(lambda s: forecast.forecast(s.current), window), recent + one + f"SELECT day, {sql.six('e')} AS expected, {sql.six('GREATEST(e - s, 0.0)')} AS lower, {sql.six('e + s')} AS upper FROM e")
    add("fcs02_weekday_index", sliced(lambda s: forecast.weekday_index(s.current)), base + "SELECT strftime(day, '%a') AS weekday, MIN(season) AS season FROM fit GROUP BY 1")
    add("fcs05_trend", sliced(lambda s: forecast.trend(s.current)), base + ", o AS (SELECT MIN(slope) AS slope, AVG(revenue) AS mean FROM fit) SELECT slope, CASE WHEN slope > GREATEST(0.01 * abs(mean), 1e-9) THEN 'up' WHEN slope < -GREATEST(0.01 * abs(mean), 1e-9) THEN 'down' ELSE 'flat' END AS direction FROM o")
    back = sql.base(where) + sql.DAILY + ", bs AS (SELECT day, revenue, row_number() OVER (ORDER BY day) AS k, COUNT(*) OVER () AS alldays FROM daily), tr AS (SELECT day, revenue FROM bs WHERE k <= alldays - 7)" + sql.fitted("tr", 0) + f""", se AS (SELECT strftime(day, '%a') AS wd, MIN(season) AS season FROM fit GROUP BY 1), li AS (SELECT MIN(slope) AS slope, MIN(intercept) AS intercept FROM fit),
 te AS (SELECT revenue, GREATEST((intercept + slope * (k - 1)) * COALESCE(season, 1.0), 0.0) AS p FROM bs CROSS JOIN li LEFT JOIN se ON strftime(day, '%a') = wd WHERE k > alldays - 7 AND alldays >= 21)
 SELECT 'daily' AS basis, {sql.six('GREATEST(100 * (1 - AVG(abs(p - revenue) / revenue) FILTER (WHERE revenue > 0)), 0.0)')} AS accuracy FROM te"""
    add("fcs03_backtest", sliced(lambda s: forecast.backtest(s.current), window), back)
    add("jn08_forecast_with_actuals", sliced(lambda s: forecast.with_actuals(reports.daily(s.current), forecast.forecast(s.current)), window), recent + one + f", j AS (SELECT day, revenue FROM daily), k AS (SELECT day, {sql.six('e')} AS expected FROM e) SELECT COALESCE(j.day, k.day) AS day, revenue, expected FROM j FULL OUTER JOIN k ON j.day = k.day")


DIRTY = """SELECT l_orderkey * 1000003 + l_partkey * 1009 + l_suppkey * 8 + l_linenumber AS row_id, l_shipdate, l_quantity, l_extendedprice, p_name, l_tax
 FROM lineitem JOIN part ON l_partkey = p_partkey"""


def dirty_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells as an export would have them, some of them broken: a made-up input for the ingest queries."""
    r = spark.sql(DIRTY.replace("FROM lineitem", "FROM {l} AS lineitem").replace("JOIN part", "JOIN {p} AS part"), l=spark.read.parquet(f"{d}/lineitem.parquet"), p=spark.read.parquet(f"{d}/part.parquet"))
    k = F.col("row_id")
    return r.select(
        k, F.when(k % 41 == 0, "31-02-2026").when(k % 43 == 0, None).when(k % 2 == 0, F.date_format("l_shipdate", "dd-MM-yyyy")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("Bill Date"),
        F.when(k % 37 == 0, "n/a").when(k % 31 == 0, "-2").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("Qty"),
        F.when(k % 29 == 0, "").otherwise(F.concat(F.lit("₹ "), F.col("l_extendedprice").cast("decimal(20,2)").cast("string"))).alias("Amount"), F.when(k % 23 == 0, "  ").otherwise(F.col("p_name")).alias("Particulars"),
    )


#: dirty_cells() in SQL.
DIRTY_CELLS = {
    "Bill Date": "CASE WHEN row_id % 41 = 0 THEN '31-02-2026' WHEN row_id % 43 = 0 THEN NULL WHEN row_id % 2 = 0 THEN strftime(l_shipdate, '%d-%m-%Y') ELSE strftime(l_shipdate, '%Y-%m-%d') END",
    "Qty": "CASE WHEN row_id % 37 = 0 THEN 'n/a' WHEN row_id % 31 = 0 THEN '-2' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END",
    "Amount": "CASE WHEN row_id % 29 = 0 THEN '' ELSE '₹ ' || CAST(CAST(l_extendedprice AS DECIMAL(20,2)) AS VARCHAR) END",
    "Particulars": "CASE WHEN row_id % 23 = 0 THEN '  ' ELSE p_name END",
}
MAPPING = {"Bill Date": "Date", "Qty": "Quantity", "Amount": "Line Total", "Particulars": "Item"}
DIRTY_SQL = f"""WITH c AS ({DIRTY}), t AS (SELECT row_id, CASE WHEN row_id % 41 = 0 OR row_id % 43 = 0 THEN NULL ELSE l_shipdate END AS sale_date,
 CASE WHEN row_id % 37 = 0 THEN NULL WHEN row_id % 31 = 0 THEN -2.0 ELSE CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) END AS quantity, CASE WHEN row_id % 29 = 0 THEN NULL ELSE CAST(CAST(l_extendedprice AS DECIMAL(20,2)) AS DOUBLE) END AS line_total,
 CASE WHEN row_id % 23 = 0 THEN 'Unspecified' ELSE trim(p_name) END AS item, row_id % 41 = 0 AS bad_date, row_id % 37 = 0 AS bad_quantity FROM c),
 u AS (SELECT *, CASE WHEN quantity > 0 THEN line_total / quantity END AS selling_price FROM t)
"""


def _ingest() -> None:
    good = "sale_date IS NOT NULL AND line_total IS NOT NULL AND (quantity IS NULL OR quantity > 0)"
    add("ing06_normalised_register", lambda s, d: ingest.normalised(dirty_cells(s, d), MAPPING)[0].select("row_id", "sale_date", "quantity", "line_total", "item", "selling_price"), DIRTY_SQL + f"SELECT row_id, sale_date, quantity, line_total, item, selling_price FROM u WHERE {good}")
    add("agg33_error_counts", lambda s, d: reports.error_counts(ingest.normalised(dirty_cells(s, d), MAPPING)[1]), DIRTY_SQL + """, e AS (SELECT 'Date' AS "column" FROM u WHERE sale_date IS NULL UNION ALL SELECT 'Quantity' FROM u WHERE bad_quantity UNION ALL SELECT 'Quantity' FROM u WHERE quantity <= 0 AND sale_date IS NOT NULL AND line_total IS NOT NULL) SELECT "column", COUNT(*) AS n FROM e GROUP BY 1""")
    add("ing08_whole_quantities", whole(ingest.whole_quantities), BASE + "SELECT bool_and(quantity = round(quantity)) AS is_whole FROM cur")
    add("fn12_masked_mail", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.contains(text.masked(F.col("text"), 2**31 - 1), F.lit("[email]")).alias("has_mail")), r"SELECT doc_id, regexp_matches(text, '[\w.+-]+@[\w-]+\.[\w.-]+') AS has_mail FROM documents")


def _evidence() -> None:
    near = "abs(quantity * selling_price - line_total) <= GREATEST(abs(line_total) * 0.01, 0.01)"
    add("evd02_product_match", whole(lambda r: evidence.product_match(r, F.col("line_total"))), BASE + f"SELECT COUNT(*) AS n, AVG(CASE WHEN {near} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share, COUNT(*) >= 5 AND AVG(CASE WHEN {near} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.9 AS matches FROM cur WHERE quantity > 0 AND selling_price > 0 AND line_total IS NOT NULL")
    for column in ("x_meas_order_total", "line_total"):
        per = BASE + f", g AS (SELECT invoice_no, COUNT({column}) AS k, COUNT(DISTINCT {column}) AS u FROM cur GROUP BY 1), h AS (SELECT COUNT(*) AS n, AVG(CASE WHEN u = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share FROM g WHERE k >= 2) SELECT n, share, n >= 2 AND share >= 0.9 AS repeats FROM h"
        add(f"agg26_invoice_repeat_{column}", whole(lambda r, c=column: evidence.invoice_repeat(r, c)), per)
    slabs = ", ".join(f"{x}::DOUBLE" for x in evidence.SLABS)
    add("evd01_slab_coverage", lambda s, d: evidence.slab_coverage(s.read.parquet(f"{d}/lineitem.parquet"), F.round(F.col("l_tax") * 100)), f"WITH v AS (SELECT round(l_tax * 100) AS v FROM lineitem), h AS (SELECT COUNT(DISTINCT v) AS n_distinct, AVG(CASE WHEN v IN ({slabs}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share FROM v WHERE v IS NOT NULL) SELECT n_distinct, share, n_distinct <= 6 AND share >= 0.9 AS is_rate FROM h")
    add("map12_cosine", lambda s, d: _cosine(s, d), f"WITH a AS (SELECT embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id = 0) SELECT vec_id, {sql.six('list_cosine_similarity(embedding::DOUBLE[], a)')} AS likeness FROM embeddings, a")


def _cosine(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    first = e.filter("vec_id = 0").select(F.col("embedding").alias("a")).limit(1)
    return e.crossJoin(F.broadcast(first)).select("vec_id", numbers.cosine("embedding", "a").cast("decimal(20,6)").cast("double").alias("likeness"))  # one row


def _functions() -> None:
    words = whole(lambda r: r.select("item").distinct().select("item", text.slug(F.col("item")).alias("slug"), F.size(text.tokens(F.col("item"))).alias("n_tokens"), numbers.shortened(F.col("item"), 8).alias("short")))
    add("fn15_slugs", words, BASE + "SELECT DISTINCT item, trim(regexp_replace(regexp_replace(lower(trim(item)), '%', '_pct_', 'g'), '[^a-z0-9]+', '_', 'g'), '_') AS slug, CAST(len(regexp_extract_all(lower(trim(item)), '[a-z0-9]+')) AS INTEGER) AS n_tokens, CASE WHEN length(item) > 8 THEN substr(item, 1, 7) || '…' ELSE item END AS short FROM cur")
    kinds = lambda r: r.select("row_id", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("cell")) for c in MAPPING])).alias("x")).select("row_id", "x.*")
    cells = " UNION ALL ".join(f"SELECT row_id, '{c}' AS \"column\", {x} AS cell FROM c" for c, x in DIRTY_CELLS.items())
    number = r"trim(regexp_replace(regexp_replace(cell, '(?i)\b(?:rs|inr|rupees?|usd|eur|gbp)\b\.?\s*', '', 'g'), '[₹$€£,\s%]', '', 'g'))"
    add("fn13_cell_kinds", lambda s, d: kinds(dirty_cells(s, d)).groupBy("column").agg(F.count_if(text.number_like(F.col("cell"))).alias("numbers"), F.count_if(text.date_like(F.col("cell"))).alias("dates")), f"WITH c AS ({DIRTY}), k AS ({cells}) SELECT \"column\", COUNT(*) FILTER (WHERE TRY_CAST({number} AS DOUBLE) IS NOT NULL) AS numbers, COUNT(*) FILTER (WHERE regexp_full_match(cell, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}|[0-9]{{8}}')) AS dates FROM k GROUP BY 1")
    ratio = "CASE WHEN l_linenumber % 5 = 0 THEN 'NaN'::DOUBLE WHEN l_linenumber % 5 = 1 THEN 'Infinity'::DOUBLE WHEN l_linenumber % 5 = 2 THEN NULL ELSE l_extendedprice END"
    lines = lambda s, d: s.read.parquet(f"{d}/lineitem.parquet")
    odd = lambda: F.when(F.col("l_linenumber") % 5 == 0, F.lit(float("nan"))).when(F.col("l_linenumber") % 5 == 1, F.lit(float("inf"))).when(F.col("l_linenumber") % 5 != 2, F.col("l_extendedprice"))
    add("fn01_finite_numbers", lambda s, d: lines(s, d).select("l_linenumber", numbers.finite(odd()).alias("x")).groupBy("l_linenumber").agg(F.count("x").alias("n"), numbers.exact_sum(F.col("x")).alias("total")), f"WITH t AS (SELECT l_linenumber, {ratio} AS r FROM lineitem) SELECT l_linenumber, COUNT(*) FILTER (WHERE isfinite(r)) AS n, {sql.s('CASE WHEN isfinite(r) THEN r END')} AS total FROM t GROUP BY 1")
    whole_text = "CAST(CAST(floor(o_totalprice) AS BIGINT) * 37 AS VARCHAR)"
    pairs = f"CASE WHEN length(t) <= 3 THEN t ELSE reverse(rtrim(regexp_replace(reverse(t[:-4]), '([0-9][0-9])', '\\1,', 'g'), ',')) || ',' || t[-3:] END"
    add("fn08_grouped_amounts", lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", numbers.indian_grouping(F.floor("o_totalprice") * 37).alias("shown")), f"SELECT o_orderkey, {pairs} AS shown FROM (SELECT o_orderkey, {whole_text} AS t FROM orders)")
    add("fn16_sanitised_notes", lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", text.sanitised(F.col("text")).alias("note")), r"SELECT conv_id, turn, left(trim(regexp_replace(regexp_replace(text, '[\p{Cc}\p{Cf}]', ' ', 'g'), '\s+', ' ', 'g')), 200) AS note FROM conversations")
    hidden = r"regexp_replace(regexp_replace(regexp_replace(x, '[\w.+-]+@[\w-]+\.[\w.-]+', '[email]', 'g'), '(^|[^0-9.])[6-9][0-9]{4}[- ]?[0-9]{5}($|[^0-9.])', '\1[phone]\2', 'g'), '[0-9]{9,}', '[number]', 'g')"
    add("ing15_masked_customers", lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", text.masked(F.concat_ws(" ", "c_name", F.concat(F.lit("c"), "c_custkey", F.lit("@mail.example.com")), F.concat(F.lit("9812"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")))).alias("shown"), text.redacted(F.col("c_name")).alias("redacted")), f"SELECT c_custkey, left({hidden}, 60) AS shown, '[redacted]' AS redacted FROM (SELECT c_custkey, c_name || ' c' || c_custkey || '@mail.example.com 9812' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS x FROM customer)")
    add("fn17_customer_keys", whole(lambda r: r.select("customer").distinct().select("customer", text.digest(F.col("customer")).alias("digest"))), BASE + "SELECT DISTINCT customer, sha256(customer) AS digest FROM cur")


GOLDEN = [
    ("date", "Date"), ("Voucher Date", "Date"), ("item group", "Category"), ("Particulars", "Item"), ("Qty.", "Quantity"), ("Rate/Unit", "Selling Price"), ("Net Amount", "Line Total"), ("Closing Stock", "Stock On Hand"), ("Cashier Name", "Salesperson"),
    ("Count of Boxes", "none"), ("Customer Phone", "none"), ("Notes", "none"), ("Total", "ambiguous"), ("Net Tax Amount", "Tax"), ("Colour", "Colour"), ("Store Code", "Branch"), ("date", "Date"),
]


#: Exports that one task spells out: the table of owners is small beside its headers, so tasks are counted by exports, not by bytes.
SHEETS_A_TASK = 10_000


def spread(owners: DataFrame, key: str) -> DataFrame:
    """A row an export, dealt to tasks of about SHEETS_A_TASK each: a scan deals by bytes, and each of these rows becomes many."""
    tasks = max(owners.sparkSession.sparkContext.defaultParallelism, math.ceil(owners.count() / SHEETS_A_TASK))
    return owners.repartition(tasks, key)


def sheets(spark: SparkSession, d: str, table: str = "customer") -> DataFrame:
    """(sheet, ordinal, header, expected): the headers of one export for each customer (or supplier), the golden ones in a spelling that follows from the key, and two more from its own row."""
    key, more = ("c_custkey", "c_mktsegment") if table == "customer" else ("s_suppkey", "s_name")
    owners = spread(spark.read.parquet(f"{d}/{table}.parquet").select(F.col(key).alias("sheet"), F.col(more).alias("more"), F.col(f"{table[0]}_name").alias("name")), "sheet")
    n, ends = len(GOLDEN), ("none", "Customer") if table == "customer" else ("ambiguous", "ambiguous")
    golden = spark.createDataFrame([(i, h, e) for i, (h, e) in enumerate(GOLDEN)] + [(n + i, None, e) for i, e in enumerate(ends)], "ordinal int, base string, expected string")
    k = (F.col("sheet") + F.col("ordinal")) % 4
    spelled = F.when(k == 0, F.col("base")).when(k == 1, F.upper("base")).when(k == 2, F.concat(F.lit("  "), "base")).otherwise(F.concat(F.lit("\ufeff"), "base"))
    header = F.when(F.col("ordinal") == n, F.col("more")).when(F.col("ordinal") == n + 1, F.col("name")).otherwise(spelled)
    return owners.crossJoin(F.broadcast(golden)).select("sheet", "ordinal", header.alias("header"), "expected")  # a fixed table


def sheets_sql(table: str = "customer") -> str:
    key, more = ("c_custkey", "c_mktsegment") if table == "customer" else ("s_suppkey", "s_name")
    ends = ("none", "Customer") if table == "customer" else ("ambiguous", "ambiguous")
    rows, n = ", ".join(f"({i}, '{h}', '{e}')" for i, (h, e) in enumerate(GOLDEN)), len(GOLDEN)
    return f"""h AS (SELECT {key} AS sheet, CAST(ordinal AS INTEGER) AS ordinal, CASE ({key} + ordinal) % 4 WHEN 0 THEN base WHEN 1 THEN upper(base) WHEN 2 THEN '  ' || base ELSE chr(65279) || base END AS header, expected FROM {table}, (VALUES {rows}) t(ordinal, base, expected)
 UNION ALL SELECT {key}, {n}, {more}, '{ends[0]}' FROM {table} UNION ALL SELECT {key}, {n + 1}, {table[0]}_name, '{ends[1]}' FROM {table})"""


def _headers() -> None:
    aliases = ", ".join(f"('{a}', '{f}')" for f, names in headers.ALIASES.items() for a in names)
    words = " ".join(f"WHEN contains(k, '{k}') THEN '{f}'" for k, f in headers.KEYWORDS)
    personal = "|".join(headers.PERSONAL_TOKENS)
    guess = f"""WITH {sheets_sql()}, a AS (SELECT * FROM (VALUES {aliases}) t(alias, alias_field)), n AS (SELECT *, lower(ltrim(trim(header), chr(65279))) AS k FROM h),
 j AS (SELECT sheet, ordinal, header, expected, k, alias_field FROM n LEFT JOIN a ON alias = k), g AS (SELECT sheet, ordinal, header, expected, alias_field, CASE WHEN regexp_matches(k, '(^|[^a-z0-9])({personal})([^a-z0-9]|$)') THEN NULL ELSE COALESCE(alias_field, CASE {words} END) END AS field FROM j),
 q AS (SELECT sheet, ordinal, header, expected, field, CASE WHEN field IS NULL THEN 'none' WHEN alias_field IS NOT NULL THEN 'exact' ELSE 'fuzzy' END AS confidence FROM g)
"""
    add("map05_guessed_headers", lambda s, d: headers.guessed(sheets(s, d)), guess + "SELECT sheet, ordinal, header, expected, field, confidence FROM q")
    keep = "field IS NULL OR row_number() OVER (PARTITION BY sheet, field ORDER BY ordinal) = 1"
    add("map06_suggested_headers", lambda s, d: headers.suggested(sheets(s, d), "sheet"), guess + f", k AS (SELECT *, {keep} AS keep FROM q) SELECT sheet, ordinal, header, CASE WHEN keep THEN field END AS field, CASE WHEN keep THEN confidence ELSE 'none' END AS confidence FROM k")
    add("set07_colliding_headers", lambda s, d: headers.colliding(sheets(s, d), "sheet"), guess + "SELECT sheet, lower(ltrim(trim(header), chr(65279))) AS key, COUNT(*) AS n FROM q GROUP BY 1, 2 HAVING COUNT(*) > 1")
    share = lambda k: f"AVG(CASE WHEN confidence = '{k}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS {k}_share"
    right = "COALESCE(field, 'none') = expected"
    add("map20_header_evaluation", lambda s, d: headers.evaluation(headers.guessed(sheets(s, d)).withColumnRenamed("field", "predicted")), guess + f"SELECT COUNT(*) AS n, AVG(CASE WHEN expected <> 'ambiguous' THEN CASE WHEN {right} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END) AS accuracy, {share('exact')}, {share('fuzzy')}, {share('none')}, COUNT(*) FILTER (WHERE expected <> 'ambiguous' AND field IS NOT NULL AND NOT ({right})) AS false_mappings FROM q")
    full = lambda *xs: "(SELECT COUNT(*) FILTER (WHERE " + " OR ".join(f"{x} IS NULL" for x in xs) + ") = 0 FROM cur)"
    measured = {"revenue": "TRUE", "profit": full("quantity", "cost_price"), "cost": full("quantity", "cost_price"), "units": full("quantity"), "transactions": "TRUE", "discount": full("discount"), "margin_pct": full("quantity", "cost_price"), "avg_price": full("quantity")}
    sides = {x: f"(SELECT COUNT(DISTINCT {x}) > 0 FROM cur)" for x in ("category", "item", "branch", "payment_mode", "customer", "salesperson", "brand", "size", "invoice_no")} | {"colour": "FALSE", "day": "TRUE", "weekday": "TRUE", "month": "TRUE"}
    flags = [f"SELECT '{k}' AS kind, '{n}' AS name, {x} AS available" for k, names in (("measure", measured), ("dimension", sides)) for n, x in names.items()]
    add("sch01_capabilities", whole(lambda r: extras.capabilities(r.drop("colour")).select("kind", "name", "available")), BASE + " " + " UNION ALL ".join(flags))
    column_queries.register(add, sheets, sheets_sql, guess)
    store_queries.register(add, sheets, sheets_sql)
    read = lambda s, d: s.read.parquet(f"{d}/events.parquet")
    add("stream_tumbling_days", lambda s, d: events.tumbling(read(s, d)).withColumn("start", F.col("start").cast("timestamp_ntz")), f"SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, COUNT(*) AS n, {sql.s('value')} AS total FROM events GROUP BY 1, 2")
    add("stream_sessions", lambda s, d: events.sessions(read(s, d)).withColumn("start", F.col("start").cast("timestamp_ntz")), "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT user_id, ts, SUM(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, MIN(ts) AS start, COUNT(*) AS n FROM k GROUP BY user_id, k")


for _register in (_headers, _charts, _slices, _reports, _inventory, _insights, _forecast, _ingest, _evidence, _functions):
    _register()


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["agg01_revenue_by_category_month"](spark, folder)
