"""Queries of information, covariances and steps, on edges whose points are the parts of a brand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineshed.functions import axis, information, lineshape
from lineshed.plans.registry import query
from lineshed.session import read

_T = 30000.0
#: A step at 25 of height 100 over a base of 5, at a temperature that makes it some 2.6 wide.
_POINTS = f"""WITH k AS (SELECT p_brand, p_partkey, p_size, (p_size - 25) / (8.617333262e-5 * {_T}) AS t, p_retailprice / 20 AS y FROM part),
p AS (SELECT *, 1 / (1 + exp(t)) AS f, 5 + 100 / (1 + exp(t)) AS mu FROM k),
j AS (SELECT *, 100 * f * (1 - f) / (8.617333262e-5 * {_T}) AS je, 100 * f * (1 - f) * t / {_T} AS jt, y - mu AS r FROM p)"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    f, by_edge, by_temperature = lineshape.fermi_edge_derivatives("p_size", 25.0, _T)
    return read(spark, d, "part").select("p_brand", (5 + 100 * f).alias("mu"), (100 * by_edge).alias("je"), (100 * by_temperature).alias("jt"), (F.col("p_retailprice") / 20).alias("y"))


@query(
    f"""{_POINTS}, s AS (SELECT p_brand, sum(je * je / mu) AS ee, sum(je * jt / mu) AS et, sum(jt * jt / mu) AS tt FROM j GROUP BY 1)
    SELECT p_brand, round(ee, 8) AS ee, round(et * 1e4, 8) AS et, round(tt * 1e8, 8) AS tt, round(ee - et * et / tt, 8) AS edge_alone, round((tt - et * et / ee) * 1e8, 8) AS width_alone FROM s"""
)
def edge_fisher(spark: SparkSession, d: str) -> DataFrame:
    s = _points(spark, d).groupBy("p_brand").agg(information.poisson_fisher(["je", "jt"], "mu").alias("m"))
    edge, width = information.effective(F.col("m"))
    return s.select("p_brand", F.round("m.m00", 8).alias("ee"), F.round(F.col("m.m01") * 1e4, 8).alias("et"), F.round(F.col("m.m11") * 1e8, 8).alias("tt"), F.round(edge, 8).alias("edge_alone"), F.round(width * 1e8, 8).alias("width_alone"))


@query(
    f"""{_POINTS}, s AS (SELECT p_brand, sum(je * je) AS a, sum(je * jt) AS b, sum(jt * jt) AS d, sum(mu * je * je) AS p, sum(mu * je * jt) AS q, sum(mu * jt * jt) AS r FROM j GROUP BY 1),
    i AS (SELECT *, d / (a * d - b * b) AS ia, -b / (a * d - b * b) AS ib, a / (a * d - b * b) AS id FROM s)
    SELECT p_brand, round(ia * ia * p + 2 * ia * ib * q + ib * ib * r, 6) AS var_edge, round((ib * ib * p + 2 * ib * id * q + id * id * r) * 1e-6, 4) AS var_temperature FROM i"""
)
def edge_wls_covariance(spark: SparkSession, d: str) -> DataFrame:
    s = _points(spark, d).groupBy("p_brand").agg(information.gram(["je", "jt"], 1.0).alias("n"), information.gram(["je", "jt"], "mu").alias("m"))
    v = s.select("p_brand", information.sandwich_2(F.col("n"), F.col("m")).alias("v"))
    return v.select("p_brand", F.round("v.m00", 6).alias("var_edge"), F.round(F.col("v.m11") * 1e-6, 4).alias("var_temperature"))


@query(
    f"""{_POINTS}, s AS (SELECT p_brand, sum(je * je / mu) AS a, sum(je * jt / mu) AS b, sum(jt * jt / mu) AS d, sum(je * r / mu) AS g, sum(jt * r / mu) AS h FROM j GROUP BY 1),
    x AS (SELECT *, (1.1 * d * g - b * h) / (1.21 * a * d - b * b) AS x, (1.1 * a * h - b * g) / (1.21 * a * d - b * b) AS y FROM s)
    SELECT p_brand, round(x, 6) AS d0, round(y, 2) AS d1, round(g * x + h * y - (a * x * x + 2 * b * x * y + d * y * y) / 2, 4) AS gain FROM x"""
)
def damped_step(spark: SparkSession, d: str) -> DataFrame:
    s = _points(spark, d).withColumn("r", F.col("y") - F.col("mu")).groupBy("p_brand").agg(information.poisson_fisher(["je", "jt"], "mu").alias("h"), information.gradient(["je", "jt"], "r", 1 / F.col("mu")).alias("g"))
    step = s.select("p_brand", information.damped_step_2(F.col("h"), F.col("g"), 0.1).alias("x"))
    return step.select("p_brand", F.round("x.d0", 6).alias("d0"), F.round("x.d1", 2).alias("d1"), F.round("x.gain", 4).alias("gain"))


@query("SELECT p_brand, round(avg(0.04::DOUBLE) / avg(pow(p_size - 25, 2)), 9) AS efficiency FROM part GROUP BY 1")
def bound_efficiency(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").groupBy("p_brand").agg(F.round(information.efficiency("p_size", 25.0, 0.2), 9).alias("efficiency"))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS y FROM embeddings)
    SELECT vec_id, round(list_sum(y[1:6]) / 6, 8) AS low, round(list_sum(y[-6:]) / 6, 8) AS high FROM e"""
)
def end_means(spark: SparkSession, d: str) -> DataFrame:
    low, high = axis.end_means(F.col("embedding").cast("array<double>"))
    return read(spark, d, "embeddings").select("vec_id", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS y FROM embeddings), m AS (SELECT vec_id, y, list_max(y) AS top, list_min(y) AS low FROM e),
    r AS (SELECT vec_id, unnest(y) AS v, generate_subscripts(y, 1)::INT - 1 AS k, top, low FROM m)
    SELECT vec_id, k, round(v / top, 8) AS by_max, round((v - low) / (top - low), 8) AS by_range FROM r"""
)
def normalise_arrays(spark: SparkSession, d: str) -> DataFrame:
    y = F.col("embedding").cast("array<double>")
    both = F.arrays_zip(axis.normalise(y, "max").alias("a"), axis.normalise(y, "minmax").alias("b"))
    rows = read(spark, d, "embeddings").select("vec_id", F.posexplode(both).alias("k", "x"))
    return rows.select("vec_id", "k", F.round(F.col("x")["a"], 8).alias("by_max"), F.round(F.col("x")["b"], 8).alias("by_range"))
