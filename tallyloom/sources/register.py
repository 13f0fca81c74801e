"""The register as one flat table: from a written register, or from a star schema of orders.

cost_price, stock_on_hand and the two extras of the star schema's register are made up from its other columns, as that
schema has no such fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STAR = ["lineitem", "orders", "customer", "part", "supplier", "nation"]

#: Runs unchanged on Spark and on the SQL engine that checks the results.
STAR_SQL = """
SELECT l_shipdate AS sale_date, p_type AS category, p_name AS item, l_quantity AS quantity,
 l_extendedprice/l_quantity AS selling_price, p_retailprice*0.5 AS cost_price, l_extendedprice AS line_total,
 l_extendedprice*l_discount AS discount, l_extendedprice*(1-l_discount)*l_tax AS tax,
 CAST(p_size*10 AS DOUBLE) AS stock_on_hand, p_retailprice AS mrp, n_name AS branch, o_orderpriority AS payment_mode,
 c_name AS customer, s_name AS salesperson, p_brand AS brand, CAST(p_size AS VARCHAR(10)) AS size,
 split_part(p_name,' ',1) AS colour, CAST(o_orderkey AS VARCHAR(20)) AS invoice_no,
 l_returnflag AS x_dim_returnflag, o_totalprice AS x_meas_order_total,
 l_orderkey AS k1, l_partkey AS k2, l_suppkey AS k3, l_linenumber AS k4
FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
 JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey
"""
#: The same joins in another order, for readers of few columns: small tables come first, orders last and with their customers. The rows of an order then lie side by side in one
#: task, and no later join deals all rows again by another key.
ORDERS_LAST = """FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey JOIN part ON l_partkey=p_partkey
 JOIN (SELECT * FROM orders JOIN customer ON o_custkey=c_custkey) ON l_orderkey=o_orderkey
"""
#: The star register's extra columns, as a registry has them.
STAR_EXTRAS = {"x_dim_returnflag": {"role": "x_dim", "aggregation": "", "reason": "few values"}, "x_meas_order_total": {"role": "x_meas", "aggregation": "sum", "reason": "numeric"}}
#: Order of rows where an operator needs one.
ROW_ORDER = ["k1", "k2", "k3", "k4", "line_total"]


def star_register(spark: SparkSession, folder: str, orders_last: bool = False) -> DataFrame:
    """The register view over Parquet tables; Catalyst prunes columns and picks joins by size. Its joins are inner ones, so all of them run."""
    query = STAR_SQL[: STAR_SQL.index("FROM lineitem")] + ORDERS_LAST if orders_last else STAR_SQL
    df = spark.sql(_bound(query), **{f"t_{t}": spark.read.parquet(f"{folder}/{t}.parquet") for t in STAR})
    for name, entry in STAR_EXTRAS.items():
        df = df.withMetadata(name, entry)
    return df


def star_days(spark: SparkSession, folder: str) -> DataFrame:
    """The sale dates of the star schema, from the fact table alone: each of its rows has its order, part and supplier."""
    return spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("l_shipdate AS sale_date")


def _bound(sql: str) -> str:
    for t in STAR:
        sql = sql.replace(f"FROM {t} ", f"FROM {{t_{t}}} AS {t} ").replace(f"JOIN {t} ", f"JOIN {{t_{t}}} AS {t} ")
    return sql


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """A normalised register that was written as Parquet."""
    return spark.read.parquet(path)


def write_register(df: DataFrame, path: str, files: int = 8) -> None:
    """Month partitions, of `files` files each: a window then reads only its months, and no month is one task."""
    from pyspark.sql import functions as F

    df.withColumn("month", F.date_format("sale_date", "yyyy-MM")).repartition("month", F.pmod(F.xxhash64(*df.columns), F.lit(files))).write.mode("overwrite").partitionBy("month").parquet(path)
