"""Revenue forecast: weighted least squares with weekday seasons over the daily series, with a band and a backtest.

Fitted parameters and what follows from them are rounded to six places, so that they don't depend on the order of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fields import HORIZON, MAX_HORIZON
from .reports import daily

MIN_DAYS, SEASON_DAYS, HALF_LIFE = 14, 21, 14
SEASON = (0.3, 3.0)
Z80 = 1.2816
BACKTEST, SPARSE, FLAT = 7, 0.25, 0.01


def everything():
    """The window of all rows of a frame that is already an aggregate."""
    return Window.partitionBy()


def _six(x: Column) -> Column:
    return x.cast("decimal(20,6)").cast("double")


def fitted(series: DataFrame, seasonal_from: int = SEASON_DAYS) -> DataFrame:
    """(day, revenue) -> + x, n, slope, intercept, fit, season (weekday index of the row's day). No rows if the series is short.

    Weights halve every 14 days of age; sums are centred. The index of a weekday is the median of revenue over fit, over the mean
    of these medians, within bounds; it is 1 for short series.
    """
    s = series.withColumn("n", F.count(F.lit(1)).over(everything())).filter(F.col("n") >= MIN_DAYS)
    s = s.withColumn("x", F.datediff("day", F.min("day").over(everything())).cast("double")).withColumn("w", F.pow(F.lit(0.5), (F.col("n") - 1 - F.col("x")) / HALF_LIFE))
    means = s.agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mx"), (F.sum(F.col("w") * F.col("revenue")) / F.sum("w")).alias("my"))
    s = s.crossJoin(F.broadcast(means))  # one row
    dx, dy = F.col("x") - F.col("mx"), F.col("revenue") - F.col("my")
    line = s.agg(F.sum(F.col("w") * dx * dy).alias("sxy"), F.sum(F.col("w") * dx * dx).alias("sxx"), F.first("mx").alias("mx"), F.first("my").alias("my"))
    line = line.select(_six(F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx")).otherwise(0.0)).alias("slope"), "mx", "my")
    line = line.select("slope", _six(F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))
    s = s.drop("mx", "my", "w").crossJoin(F.broadcast(line)).withColumn("fit", F.col("intercept") + F.col("slope") * F.col("x"))  # one row
    ratios = s.filter(F.col("fit") > 0).groupBy(F.weekday("day").alias("wd")).agg(F.percentile(F.col("revenue") / F.col("fit"), F.lit(0.5)).alias("m"))
    mean = F.avg("m").over(everything())
    index = F.least(F.greatest(_six(F.coalesce(F.col("m") / F.when(mean > 0, mean), F.lit(1.0))), F.lit(SEASON[0])), F.lit(SEASON[1]))
    ratios = ratios.select("wd", index.alias("index"))  # seven rows
    s = s.join(F.broadcast(ratios), F.weekday("day") == F.col("wd"), "left")
    return s.withColumn("season", F.when(F.col("n") >= seasonal_from, F.coalesce("index", F.lit(1.0))).otherwise(1.0)).drop("wd", "index")


def weekday_index(df: DataFrame) -> DataFrame:
    return fitted(daily(df).select("day", "revenue")).groupBy(F.date_format("day", "EEE").alias("weekday")).agg(F.first("season").alias("season"))


def forecast(df: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """(day, expected, lower, upper): the next days, with an 80 % band. Empty with fewer than 14 days of data."""
    horizon = max(1, min(horizon, MAX_HORIZON))
    s = fitted(daily(df).select("day", "revenue"))
    one = s.agg(F.max("day").alias("last"), F.first("n").alias("n"), F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), _six(F.stddev_pop(F.col("revenue") - F.col("fit") * F.col("season"))).alias("sigma")).filter("last is not null")
    seasons = s.groupBy(F.weekday("day").alias("wd")).agg(F.first("season").alias("season"))
    ahead = one.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")).withColumn("day", F.date_add("last", F.col("h")))
    ahead = ahead.join(F.broadcast(seasons), F.weekday("day") == F.col("wd"), "left").withColumn("season", F.coalesce("season", F.lit(1.0)))  # seven rows
    expected = F.greatest((F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("h"))) * F.col("season"), F.lit(0.0))
    spread = Z80 * F.col("sigma") * F.sqrt(1 + F.col("h") / F.col("n"))
    out = ahead.select("day", expected.alias("e"), spread.alias("s"))
    return out.select("day", _six(F.col("e")).alias("expected"), _six(F.greatest(F.col("e") - F.col("s"), F.lit(0.0))).alias("lower"), _six(F.col("e") + F.col("s")).alias("upper"))


def trend(df: DataFrame) -> DataFrame:
    """One row: slope and direction; flat within 1 % of the mean day."""
    s = fitted(daily(df).select("day", "revenue"))
    one = s.agg(F.first("slope").alias("slope"), F.avg("revenue").alias("mean"))
    limit = F.greatest(FLAT * F.abs("mean"), F.lit(1e-9))
    return one.filter("slope is not null").select("slope", F.when(F.col("slope") > limit, "up").when(F.col("slope") < -limit, "down").otherwise("flat").alias("direction"))


def backtest(df: DataFrame) -> DataFrame:
    """One row: basis (daily or total) and accuracy in percent of a forecast of the last 7 days from the days before them; needs 21 days.

    Where over a quarter of the days have no sales, the totals are compared.
    """
    series = daily(df).select("day", "revenue").withColumn("k", F.row_number().over(Window.orderBy("day"))).withColumn("all_days", F.count(F.lit(1)).over(everything())).filter(F.col("all_days") >= SEASON_DAYS)
    train = series.filter(F.col("k") <= F.col("all_days") - BACKTEST).select("day", "revenue")
    s = fitted(train, seasonal_from=0)
    line = s.agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.first("n").alias("n"))
    seasons = s.groupBy(F.weekday("day").alias("wd")).agg(F.first("season").alias("season"))
    test = series.filter(F.col("k") > F.col("all_days") - BACKTEST).crossJoin(F.broadcast(line)).join(F.broadcast(seasons), F.weekday("day") == F.col("wd"), "left")  # one row, seven rows
    test = test.withColumn("p", F.greatest((F.col("intercept") + F.col("slope") * (F.col("k") - 1)) * F.coalesce("season", F.lit(1.0)), F.lit(0.0)))
    share = series.agg(F.avg((F.col("revenue") <= 0).cast("double")).alias("empty_share"))
    out = test.agg(F.avg(F.when(F.col("revenue") > 0, F.abs(F.col("p") - F.col("revenue")) / F.col("revenue"))).alias("mape"), F.sum("p").alias("sp"), F.sum("revenue").alias("sr")).filter("sr is not null").crossJoin(F.broadcast(share))
    off = F.when(F.col("empty_share") > SPARSE, F.abs(F.col("sp") - F.col("sr")) / F.when(F.col("sr") > 0, F.col("sr"))).otherwise(F.col("mape"))
    return out.select(F.when(F.col("empty_share") > SPARSE, "total").otherwise("daily").alias("basis"), _six(F.greatest(100 * (1 - off), F.lit(0.0))).alias("accuracy"))


def with_actuals(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """(day, revenue, expected): actual and forecast days side by side."""
    return actual.select("day", "revenue").join(predicted.select("day", "expected"), "day", "full_outer")
