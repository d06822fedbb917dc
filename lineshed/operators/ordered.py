"""Operators over points in order, in long form: one row a point, keys name the spectrum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineshed.session import materialize


def _w(by: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def trapezoid_area(df: DataFrame, x: str, y: str, by: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One row a group: area, by the trapezoid rule along the order."""
    w = _w(by, order or [x])
    part = (F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w))
    return df.withColumn("__part", part).groupBy(*by).agg(F.coalesce(F.sum("__part"), F.lit(0.0)).alias("area"))


def running_integral(df: DataFrame, x: str, y: str, by: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Adds integral, the trapezoid area up to each point, as a share of the whole."""
    w = _w(by, order or [x])
    part = F.coalesce((F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w)), F.lit(0.0))
    rows = df.withColumn("__part", part)
    running = F.sum("__part").over(w.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("__part").over(Window.partitionBy(*by))
    return rows.withColumn("integral", F.when(whole != 0, running / whole)).drop("__part")


def shirley_step(df: DataFrame, y: str, by: Sequence[str], order: Sequence[str], background: str | None = None) -> DataFrame:
    """One Proctor-Sherwood step as a cumulative sum; from no background unless one is named."""
    signal = F.col(y) - (F.col(background) if background else F.lit(0.0))
    w = _w(by, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.sum(signal).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(signal).over(whole)
    first, last = F.first(y).over(whole), F.last(y).over(whole)
    return df.withColumn("background", F.when(F.abs(F.sum(signal).over(whole)) < 1e-10, F.lit(0.0)).otherwise(first + (last - first) * share))


def linear_background(df: DataFrame, x: str, y: str, by: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """The straight line between the end points."""
    whole = _w(by, order or [x]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x0, x1, y0, y1 = F.first(x).over(whole), F.last(x).over(whole), F.first(y).over(whole), F.last(y).over(whole)
    return df.withColumn("background", F.when(x1 != x0, y0 + (y1 - y0) / (x1 - x0) * (F.col(x) - x0)).otherwise(y0))


def constant_background(df: DataFrame, y: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The lower of the two end points."""
    whole = _w(by, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("background", F.least(F.first(y).over(whole), F.last(y).over(whole)))


def lag1_autocorrelation(df: DataFrame, residual: str, by: Sequence[str], order: Sequence[str], most: float = 4.0) -> DataFrame:
    """acf1, z = acf1 sqrt(n), and whether residuals are structured; 0 for fewer than 3 points or no residual."""
    rows = df.withColumn("__next", F.col(residual) * F.lag(residual).over(_w(by, order)))
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("__next").alias("a"), F.sum(F.col(residual) * F.col(residual)).alias("b"))
    acf = F.when((F.col("n") >= 3) & (F.col("b") != 0), F.col("a") / F.col("b")).otherwise(F.lit(0.0))
    return s.withColumn("acf1", acf).withColumn("z", F.col("acf1") * F.sqrt(F.col("n"))).withColumn("structured", F.abs("z") > most).drop("a", "b")


def flattest_window(df: DataFrame, slope: str, by: Sequence[str], order: Sequence[str], size: int = 7, preference: float = 3.0) -> DataFrame:
    """The start of the window of `size` points with the least mean slope, nearer to the edge preferred."""
    w = _w(by, order)
    n = F.count("*").over(Window.partitionBy(*by))
    rows = df.withColumn("__k", F.row_number().over(w) - 1).withColumn("__n", n)
    mean = F.avg(slope).over(w.rowsBetween(0, size - 1))
    rows = rows.withColumn("score", mean * (1 + preference * (F.col("__k") + size / 2) / F.col("__n"))).filter(F.col("__k") <= F.col("__n") - size)
    return rows.groupBy(*by).agg(F.min_by(F.col("__k"), F.struct("score", "__k")).cast("long").alias("start"), F.min("score").alias("score"))


def parabola_vertex(left, middle, right):
    """Offset of the vertex through three equally spaced values, in steps, at most half a step."""
    den = 2 * (2 * middle - left - right)
    return F.when(F.abs(den) > 1e-30, F.least(F.greatest((right - left) / den, F.lit(-0.5)), F.lit(0.5))).otherwise(F.lit(0.0))


def savitzky_golay_center(df: DataFrame, y: str, by: Sequence[str], order: Sequence[str], half: int = 5, degree: int = 3) -> DataFrame:
    """Adds smooth for points with `half` neighbours on both sides, null for the others."""
    import numpy as np

    k = np.arange(-half, half + 1)
    weights = np.linalg.pinv(np.vander(k, degree + 1, increasing=True))[0]
    w = _w(by, order)
    terms = [F.lag(y, int(-j)).over(w) * float(a) if j < 0 else F.lead(y, int(j)).over(w) * float(a) for j, a in zip(k, weights)]
    return df.withColumn("smooth", sum(terms[1:], terms[0]))


def islands(df: DataFrame, x: str, gap: float, by: Sequence[str] = (), width: str | None = None) -> DataFrame:
    """Adds island: a new one begins where the distance to the point before reaches `gap`.

    width names a column of widths; the distance then counts in means of both points' widths. Without `by`
    the whole table is one line: it is cut into ranges, each of which learns where the one before it ends
    and how many islands began before it, so no task holds the table.
    """
    own = list(by)
    if not by:
        df = materialize(df.repartitionByRange(x).withColumn("__part", F.spark_partition_id()), "islands")
        own = ["__part"]
    w = Window.partitionBy(*own).orderBy(x)
    rows = df.withColumns({"__x": F.lag(x).over(w), "__w": F.lag(width).over(w) if width else F.lit(None).cast("double")})
    if not by:
        line = Window.orderBy("__part")  # a row a range
        last = F.max_by(F.struct(F.col(x).alias("x"), (F.col(width) if width else F.lit(None).cast("double")).alias("w")), x)
        ends = df.groupBy("__part").agg(last.alias("__last")).withColumn("__last", F.lag("__last").over(line))
        rows = rows.join(F.broadcast(ends), "__part").withColumns({"__w": F.when(F.col("__x").isNull(), F.col("__last.w")).otherwise(F.col("__w")), "__x": F.coalesce("__x", "__last.x")}).drop("__last")
    step = F.col(x) - F.col("__x")
    if width:
        step = step / ((F.col(width) + F.col("__w")) / 2)
    rows = rows.withColumn("__new", F.when(step >= gap, 1).otherwise(0))
    inside = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    if by:
        return rows.withColumn("island", inside.cast("long")).drop("__new", "__x", "__w")
    begun = rows.groupBy("__part").agg(F.sum("__new").alias("__n"))
    before = begun.select("__part", F.coalesce(F.sum("__n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return rows.withColumn("island", inside).join(F.broadcast(before), "__part").withColumn("island", (F.col("island") + F.col("__before")).cast("long")).drop("__new", "__x", "__w", "__part", "__before")


def evenly_spaced(df: DataFrame, order: str, n: int) -> DataFrame:
    """n rows at equal distances in the order, the first and last included; all if there are fewer.

    Numbers rows by range partitions, so no task holds the table.
    """
    total = df.count()
    if total <= n:
        return df
    wanted = sorted({int(k * (total - 1) / (n - 1)) if n > 1 else 0 for k in range(n)})
    return numbered(df, order).filter(F.col("__number").isin(wanted)).drop("__number")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Adds __number, the row's place in the order from 0, without gathering rows in one task."""
    parts = materialize(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("__before", before).drop("__size")  # a row a partition
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return parts.withColumn("__inside", inside).join(F.broadcast(offsets), "__part").withColumn("__number", F.col("__before") + F.col("__inside") - 1).drop("__part", "__inside", "__before")
