"""SQL that says the same as the queries, for the engine that checks them."""

from __future__ import annotations

from ..sources.register import STAR_SQL

SUM = "CAST(SUM(CAST({} AS DECIMAL(20,6))) AS DOUBLE)"


def s(x: str) -> str:
    return SUM.format(x)


def over(x: str, window: str = "") -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(20,6))) OVER ({window}) AS DOUBLE)"


def six(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(20,6)) AS DOUBLE)"


DERIVED = """, d AS (SELECT *, GREATEST(COALESCE(quantity*selling_price, line_total) - COALESCE(discount, 0.0), 0.0) AS row_revenue,
 COALESCE(discount, 0.0) AS row_discount, quantity*cost_price AS row_cost, COALESCE(tax, 0.0) AS row_tax FROM cur)
, p AS (SELECT *, row_revenue - row_cost AS row_profit FROM d)
"""
TOTALS = f"{s('row_revenue')} AS revenue, {s('row_cost')} AS cost, {s('row_profit')} AS profit, {s('row_discount')} AS discount, {s('quantity')} AS units, COUNT(*) AS transactions"
KEY = {"day": "strftime(sale_date, '%Y-%m-%d')", "weekday": "strftime(sale_date, '%a')", "month": "strftime(sale_date, '%Y-%m')"}
VALUE = {"margin_pct": "COALESCE(profit / NULLIF(revenue, 0) * 100, 0.0)", "avg_price": "COALESCE(revenue / NULLIF(units, 0), 0.0)"}
RANGE = {
    "all": "TRUE", "today": "sale_date >= (SELECT MAX(sale_date) FROM r)", "week": "sale_date >= (SELECT MAX(sale_date) FROM r) - INTERVAL 6 DAY",
    "30days": "sale_date >= (SELECT MAX(sale_date) FROM r) - INTERVAL 29 DAY", "month": "sale_date >= date_trunc('month', (SELECT MAX(sale_date) FROM r))",
}


def base(where: str = "TRUE", before: str = "FALSE") -> str:
    """CTEs r (register), cur (slice), prev (period before it), p (derived slice)."""
    return f"WITH r AS ({STAR_SQL}), cur AS (SELECT * FROM r WHERE {where}), prev AS (SELECT * FROM r WHERE {before}){DERIVED}"


def last_days(n: int) -> tuple[str, str]:
    last = "(SELECT MAX(sale_date) FROM r)"
    return f"sale_date >= {last} - INTERVAL {n - 1} DAY", f"sale_date >= {last} - INTERVAL {2 * n - 1} DAY AND sale_date < {last} - INTERVAL {n - 1} DAY"


def chart(dimension: str, measure: str, where: str, additive: bool, timed: bool, top_n: int = 10) -> str:
    key, value = KEY.get(dimension, dimension), VALUE.get(measure, f"CAST({measure} AS DOUBLE)")
    order = "list_position(['Mon','Tue','Wed','Thu','Fri','Sat','Sun'], label)" if dimension == "weekday" else "label" if timed else "value DESC, label"
    total = over("value") if additive else VALUE[measure].replace("profit", "(SELECT " + s("profit") + " FROM g)").replace("revenue", "(SELECT " + s("revenue") + " FROM g)").replace("units", "(SELECT " + s("units") + " FROM g)")
    sql = base(where) + f", g AS (SELECT {key} AS label, {TOTALS} FROM p GROUP BY 1), v AS (SELECT *, {value} AS value FROM g)"
    before = f"COALESCE({over('value', f'ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')}, 0.0)"
    sql += f", o AS (SELECT *, row_number() OVER (ORDER BY {order}) AS position, COUNT(*) OVER () AS group_count, {total} AS total, {before if additive else '0.0'} AS before FROM v)"
    pareto = "CASE WHEN total > 0 THEN COUNT(*) FILTER (WHERE NOT (before / total >= 0.8)) OVER () END" if additive and not timed else "CAST(NULL AS BIGINT)"
    sql += f", q AS (SELECT *, {pareto} AS pareto_count FROM o)"
    if timed:
        sql += ", f AS (SELECT position, label, value, total, group_count, pareto_count FROM q)"
    else:
        parts = ", ".join(f"{s(x)} AS {x}" for x in ("revenue", "cost", "profit", "discount", "units")) + ", SUM(transactions) AS transactions"
        sql += f", f0 AS (SELECT LEAST(position, {top_n + 1}) AS position, CASE WHEN position > {top_n} THEN 'Other (' || CAST(group_count - {top_n} AS VARCHAR) || ')' ELSE label END AS label, group_count, total, pareto_count, {parts} FROM q GROUP BY 1, 2, 3, 4, 5), f AS (SELECT *, {value} AS value FROM f0)"
    share = f"value / NULLIF(total, 0) * 100 AS share, {over('value', 'ORDER BY position ROWS UNBOUNDED PRECEDING')} / NULLIF(total, 0) * 100 AS cumulative" if additive else "CAST(NULL AS DOUBLE) AS share, CAST(NULL AS DOUBLE) AS cumulative"
    return sql + f" SELECT CAST(position AS BIGINT) AS position, label, value, {share}, total, group_count, pareto_count, {'FALSE' if timed else f'position > {top_n}'} AS is_other FROM f"


DAILY = f""", days AS (SELECT CAST(unnest(generate_series(MIN(CAST(sale_date AS DATE)), MAX(CAST(sale_date AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day FROM cur),
 ds AS (SELECT CAST(sale_date AS DATE) AS day, {TOTALS} FROM p GROUP BY 1),
 daily AS (SELECT days.day, COALESCE(transactions, 0) AS transactions, COALESCE(units, 0.0) AS units, COALESCE(revenue, 0.0) AS revenue, COALESCE(cost, 0.0) AS cost, COALESCE(profit, 0.0) AS profit FROM days LEFT JOIN ds ON days.day = ds.day)
"""
ITEMS = f""", it AS (SELECT item, MIN(category) AS category, {TOTALS}, MAX(CAST(sale_date AS DATE)) AS last_sale FROM p GROUP BY item)"""

ORDER = "k1, k2, k3, k4, line_total"
INVENTORY = f""", sp AS (SELECT MIN(CAST(sale_date AS DATE)) AS first_day, MAX(CAST(sale_date AS DATE)) AS last_day FROM cur),
 sw AS (SELECT *, date_diff('day', first_day, last_day) + 1 AS window_days, GREATEST(CAST(floor((date_diff('day', first_day, last_day) + 1) / 3.0) AS INTEGER), 1) AS third FROM sp),
 pi AS (SELECT p.*, CAST(sale_date AS DATE) AS day, sw.* FROM p, sw),
 i0 AS (SELECT item, window_days, last_day, {s('quantity')} AS units, {s('row_revenue')} AS revenue, MAX(day) AS last_sale, COUNT(DISTINCT day) AS active_days,
  {s('cost_price')} / COUNT(cost_price) AS mean_cost,
  COALESCE({s('CASE WHEN day < first_day + third THEN quantity END')}, 0.0) AS early, COALESCE({s('CASE WHEN day >= last_day + 1 - third THEN quantity END')}, 0.0) AS late FROM pi GROUP BY 1, 2, 3),
 fc AS (SELECT item, category FROM (SELECT item, category, row_number() OVER (PARTITION BY item ORDER BY {ORDER}) AS rn FROM p) WHERE rn = 1),
 ls AS (SELECT item, stock_on_hand AS stock FROM (SELECT item, stock_on_hand, row_number() OVER (PARTITION BY item ORDER BY sale_date DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC, line_total DESC) AS rn FROM p WHERE stock_on_hand IS NOT NULL) WHERE rn = 1),
 i1 AS (SELECT i0.*, fc.category, ls.stock, units / window_days AS velocity, units / active_days AS velocity_active, date_diff('day', last_sale, last_day) AS days_idle,
  LEAST(GREATEST(CASE WHEN early > 0 AND late > 0 THEN late / early WHEN late > 0 THEN 4.0 WHEN early > 0 THEN 0.25 ELSE 1.0 END, 0.25), 4.0) AS trend FROM i0 JOIN fc USING (item) LEFT JOIN ls USING (item)),
 i2 AS (SELECT *, COALESCE({over('revenue', 'ORDER BY revenue DESC, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')}, 0.0) AS before, {over('revenue')} AS total FROM i1),
 inv AS (SELECT item, category, units, revenue, last_sale, active_days, mean_cost, stock, velocity, velocity_active, days_idle, trend,
  CASE WHEN total > 0 AND before / total < 0.8 THEN 'A' WHEN total > 0 AND before / total < 0.95 THEN 'B' ELSE 'C' END AS abc,
  {six('100 * (0.5 * COALESCE(velocity / NULLIF(MAX(velocity) OVER (), 0), 0.0) + 0.3 * LEAST(GREATEST((trend - 0.25) / 3.75, 0.0), 1.0) + 0.2 * LEAST(GREATEST(1 - days_idle / 60.0::DOUBLE, 0.0), 1.0))')} AS priority,
  CASE WHEN days_idle <= 15 THEN '0-15' WHEN days_idle <= 30 THEN '16-30' WHEN days_idle <= 60 THEN '31-60' ELSE '60+' END AS ageing,
  stock / NULLIF(velocity, 0) AS days_cover, stock / NULLIF(velocity, 0) < 7 AS reorder, stock * mean_cost AS capital FROM i2)
"""


def fitted(source: str, seasonal_from: int, name: str = "") -> str:
    """CTEs that fit a series (day, revenue); the last is fit<name>."""
    n = name
    return f""", s0{n} AS (SELECT day, revenue, COUNT(*) OVER () AS n, CAST(date_diff('day', MIN(day) OVER (), day) AS DOUBLE) AS x FROM {source}),
 s1{n} AS (SELECT *, pow(0.5::DOUBLE, (n - 1 - x) / 14) AS w FROM s0{n} WHERE n >= 14),
 m{n} AS (SELECT SUM(w * x) / SUM(w) AS mx, SUM(w * revenue) / SUM(w) AS my FROM s1{n}),
 l0{n} AS (SELECT SUM(w * (x - mx) * (revenue - my)) AS sxy, SUM(w * (x - mx) * (x - mx)) AS sxx, MIN(mx) AS mx, MIN(my) AS my FROM s1{n}, m{n}),
 l1{n} AS (SELECT {six('CASE WHEN sxx > 0 THEN sxy / sxx ELSE 0.0 END')} AS slope, mx, my FROM l0{n}),
 l2{n} AS (SELECT slope, {six('my - slope * mx')} AS intercept FROM l1{n}),
 f0{n} AS (SELECT day, revenue, n, x, slope, intercept, intercept + slope * x AS fit FROM s1{n}, l2{n}),
 r0{n} AS (SELECT strftime(day, '%a') AS wd, median(revenue / fit) AS m FROM f0{n} WHERE fit > 0 GROUP BY 1),
 r1{n} AS (SELECT wd, LEAST(GREATEST({six('COALESCE(m / NULLIF(AVG(m) OVER (), 0), 1.0)')}, 0.3), 3.0) AS idx FROM r0{n}),
 fit{n} AS (SELECT f0{n}.*, CASE WHEN n >= {seasonal_from} THEN COALESCE(idx, 1.0) ELSE 1.0 END AS season FROM f0{n} LEFT JOIN r1{n} ON strftime(day, '%a') = wd)
"""
