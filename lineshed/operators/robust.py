"""Exact quantiles of groups of any size, and the robust statistics built on them.

The built-in exact median keeps every distinct value of a group in one aggregate. Here a bounded sketch
first brackets the quantile, and only the values within the bracket, counted, are put in order; a group's
other values are counted and never move. So no task holds more than about 2 / accuracy of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAD_SCALE = 1.4826
MAD_FLOOR = 1e-10
ACCURACY = 10_000


def exact_quantile(df: DataFrame, value: str, q: float, by: Sequence[str] = (), out: str = "quantile", accuracy: int = ACCURACY) -> DataFrame:
    """One row a group: the quantile with linear interpolation between order statistics; nulls don't count."""
    keys = list(by) or ["__all"]
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).filter("__v is not null")
    rows = rows if by else rows.withColumn("__all", F.lit(0))
    reach = 4.0 / accuracy  # the sketch is off by 1 / accuracy of the ranks at most
    sketch = F.percentile_approx("__v", [max(0.0, q - reach), min(1.0, q + reach)], accuracy)
    bounds = rows.groupBy(*keys).agg(sketch.alias("__b"), F.count("*").alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    small = F.col("__n") <= accuracy  # ranks are too far apart for the sketch; the group is held whole
    low = F.when(F.lit(q - reach <= 0) | small, F.col("__min")).otherwise(F.col("__b")[0])
    high = F.when(F.lit(q + reach >= 1) | small, F.col("__max")).otherwise(F.col("__b")[1])
    bounds = bounds.select(*keys, "__n", low.alias("__low"), high.alias("__high"))
    near = rows.join(bounds, keys).filter(F.col("__v") <= F.col("__high"))
    counted = near.withColumn("__v", F.when(F.col("__v") < F.col("__low"), F.lit(float("-inf"))).otherwise(F.col("__v"))).groupBy(*keys, "__n", "__v").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__v"))
    place = F.lit(q) * (F.col("__n") - 1)
    ranked = counted.withColumn("__upto", upto).withColumn("__place", place)
    lower = F.min(F.when(F.col("__upto") > F.floor("__place"), F.col("__v")))
    upper = F.min(F.when(F.col("__upto") > F.ceil("__place"), F.col("__v")))
    found = ranked.groupBy(*keys).agg(lower.alias("__lo"), upper.alias("__up"), F.first(F.col("__place") - F.floor("__place")).alias("__part"))
    return found.select(*by, (F.col("__lo") + (F.col("__up") - F.col("__lo")) * F.col("__part")).alias(out))


def mad_thresholds(df: DataFrame, value: str, by: Sequence[str] = (), k: float = 3.0, accuracy: int | None = None) -> DataFrame:
    """One row per group: center, mad, threshold = center + k 1.4826 mad.

    Exact unless an accuracy is given; then one pass of sketches each, in half as many scans.
    """
    keys = list(by)

    def middle(rows: DataFrame, column: str, groups: Sequence[str], out: str) -> DataFrame:
        if accuracy is None:
            return exact_quantile(rows, column, 0.5, groups, out)
        return rows.groupBy(*groups).agg(F.percentile_approx(column, 0.5, accuracy).alias(out))

    def beside(rows: DataFrame, per_group: DataFrame) -> DataFrame:
        return rows.join(per_group, keys) if keys else rows.crossJoin(F.broadcast(per_group))  # one row

    rows = df.select(*keys, F.col(value).cast("double").alias("__x"))
    centers = middle(rows, "__x", keys, "center")
    off = beside(rows, centers).withColumn("__off", F.abs(F.col("__x") - F.col("center")))
    return beside(centers, middle(off, "__off", keys, "mad")).withColumn("threshold", F.col("center") + F.lit(k) * F.lit(MAD_SCALE) * F.col("mad"))


def mad_outliers(df: DataFrame, value: str, by: Sequence[str] = (), k: float = 3.0, accuracy: int | None = None) -> DataFrame:
    """Rows above their group's threshold; a group whose MAD is under the floor has none."""
    t = mad_thresholds(df, value, by, k, accuracy).filter(F.col("mad") >= MAD_FLOOR)
    joined = df.join(t, list(by)) if by else df.crossJoin(F.broadcast(t))
    return joined.filter(F.col(value) > F.col("threshold"))


def error_stats(df: DataFrame, error: str, by: Sequence[str]) -> DataFrame:
    """bias, std (population), rmse, mae (the median of absolute errors) and p95 by group."""
    e = F.col(error)
    moments = df.groupBy(*by).agg(F.avg(e).alias("bias"), F.stddev_pop(e).alias("std"), F.sqrt(F.avg(e * e)).alias("rmse"))
    size = df.select(*by, F.abs(e).alias("__e"))
    return moments.join(exact_quantile(size, "__e", 0.5, by, "mae"), list(by)).join(exact_quantile(size, "__e", 0.95, by, "p95"), list(by))
