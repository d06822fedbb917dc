"""Queries on synthetic spectra, one for each row of a table; no SQL can tell their results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineshed.functions import encode
from lineshed.operators import analyse, background, fit, kernels, poisson, quantify, refine, synthetic, templates
from lineshed.operators.kernels import Peaks
from lineshed.plans.registry import query
from lineshed.session import read, spread

ENERGY = np.linspace(-3.0, 3.0, 151)
ONE = Peaks(ENERGY, (0.0,), (0.5,), 0.2)
TWO = Peaks(np.linspace(96.0, 106.0, 128), (99.3, 103.4), (0.45, 0.6), 0.1, n_shift=13)


def truth(spark: SparkSession, d: str, n_comp: int = 1) -> DataFrame:
    """Parameters of one spectrum for each part."""
    k = F.col("p_partkey")
    return read(spark, d, "part").select(
        k.alias("spectrum_id"),
        F.array(*[(0.5 + F.pmod(F.xxhash64(k, F.lit(c)), F.lit(1000)) / 1000.0) for c in range(n_comp)]).alias("amplitudes"),
        (0.25 * (F.pmod(F.xxhash64(k, F.lit(11)), F.lit(2001)) / 1000.0 - 1)).alias("shift"),
        (0.08 * (F.pmod(F.xxhash64(k, F.lit(12)), F.lit(2001)) / 1000.0 - 1)).alias("width"),
    )


def spectra(spark: SparkSession, d: str, peaks: Peaks = ONE, noise: float = 0.01) -> DataFrame:
    return synthetic.generate(truth(spark, d, len(peaks.centers)), peaks, noise)


@query()
def gamma_calibrated_fit(spark: SparkSession, d: str) -> DataFrame:
    return fit.fit(spectra(spark, d), Peaks(ENERGY, (0.0,), (0.5,), 0.16), "gamma_calibrated")


def _some(spark: SparkSession, d: str) -> DataFrame:
    """Counts over a sloping base, one spectrum for each supplier."""
    k = F.col("s_suppkey")
    t = spread(read(spark, d, "supplier").select("s_suppkey")).select(k.alias("spectrum_id"), F.array(F.lit(300.0), 150.0 + k % 100).alias("amplitudes"), F.lit(0.0).alias("shift"), F.lit(0.0).alias("width"))
    y = synthetic.generate(t, TWO, 1.0)
    energy = F.array(*[F.lit(float(e)) for e in TWO.energy])
    return y.select("spectrum_id", energy.alias("energy"), F.transform("intensity", lambda v, j: v + 20 + 0.2 * j).alias("intensity"))


@query()
def auto_fit(spark: SparkSession, d: str) -> DataFrame:
    return analyse.auto_fit(_some(spark, d), "linear")


@query()
def exact_k(spark: SparkSession, d: str) -> DataFrame:
    net = background.subtract(_some(spark, d), "linear").select("spectrum_id", "energy", F.col("net").alias("intensity"))
    return analyse.verdicts(analyse.exact_k(net, 3, 2))


@query()
def bootstrap_area(spark: SparkSession, d: str) -> DataFrame:
    draws = analyse.bootstrap(_some(spark, d), lambda e, y: np.trapezoid(y, e), 50)
    return quantify.weibull_quantile(draws, "value", 0.95, ["spectrum_id"])


@query()
def identifiability(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_partkey").alias("spectrum_id"), F.col("p_retailprice").alias("area"), F.lit(0.0).alias("center"), (0.2 + F.col("p_size") / 100).alias("sigma"), ((F.col("p_partkey") % 5) / 10.0).alias("gamma"))
    return analyse.identifiability(p, ENERGY)


@query()
def roundtrip_pixels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    pixels = read(spark, d, "part").select(k.alias("spectrum_id"), *[F.pmod(F.xxhash64(k, F.lit(c)), F.lit(256)).cast("int").alias(c) for c in "rgb"])
    return synthetic.round_trip(pixels, ONE)


@query()
def cross_section_status(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    table = p.filter("p_size % 2 = 0").groupBy("p_brand", F.col("p_size").cast("double").alias("energy")).agg(F.avg("p_retailprice").alias("cross_section"))
    rows = p.select("p_partkey", "p_brand", (F.col("p_retailprice") / 30).alias("photon_energy"))
    return analyse.cross_section(rows, table, ["p_brand"]).select("p_partkey", "value", "status")


@query()
def grouped_fit(spark: SparkSession, d: str) -> DataFrame:
    return refine.fit_grouped(spectra(spark, d, TWO), TWO)


@query()
def gauss_newton_refine(spark: SparkSession, d: str) -> DataFrame:
    y = spectra(spark, d)
    flagged = fit.flag_anomalies(fit.fit(y, ONE, "preview")).filter("is_anomaly").select("spectrum_id")
    return refine.refine(y.join(flagged, "spectrum_id", "left_semi"), ONE, "full")


@query(
    """WITH p AS (SELECT p_partkey AS k, (p_partkey % 7) / 100.0::DOUBLE AS e FROM part)
    SELECT k AS spectrum_id, round(0.1 + e, 6) AS first, round(-0.2 + e, 6) AS second, round(0.4 + e, 6) AS third, k % 3 <> 0 AS swapped FROM p"""
)
def swap_correction(spark: SparkSession, d: str) -> DataFrame:
    """Found values in three orders, all a little off the true ones."""
    k = F.col("p_partkey")
    off = (k % 7) / 100.0
    true = F.array(F.lit(0.1), F.lit(-0.2), F.lit(0.4))
    found = F.when(k % 3 == 0, true).when(k % 3 == 1, F.array(F.lit(-0.2), F.lit(0.1), F.lit(0.4))).otherwise(F.array(F.lit(0.4), F.lit(0.1), F.lit(-0.2)))
    rows = read(spark, d, "part").select(k.alias("spectrum_id"), true.alias("true"), F.transform(found, lambda v: v + off).alias("found"))
    got = refine.correct_swaps(rows, "found", "true", ["found"])
    return got.select("spectrum_id", *[F.round(F.col("found")[i], 6).alias(n) for i, n in enumerate(("first", "second", "third"))], "swapped")


@query()
def poisson_mle(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    t = spread(read(spark, d, "supplier").select("s_suppkey")).select(k.alias("spectrum_id"), F.array(F.lit(200.0)).alias("amplitudes"), F.lit(0.05).alias("shift"), F.lit(0.0).alias("width"))
    counts = synthetic.generate(t, ONE, poisson=100.0).select("spectrum_id", F.transform("intensity", lambda v: F.round(v)).alias("intensity"))
    return poisson.fit_counts(counts, poisson.peak_model(ENERGY, 0.0, 0.5, 0.2), (150.0, 0.0, 1.0), (1e-3, -1.0, 1e-3), 1)


@query()
def crlb_grid_sweep(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    grid = read(spark, d, "nation").select(n.alias("cell"), (0.2 + 0.1 * n).alias("separation"), F.lit(0.4).alias("sigma"), F.lit(0.1).alias("gamma"), F.lit(1e4).alias("height"))
    return poisson.grid_sweep(grid, ENERGY)


@query(
    """WITH p AS (SELECT p_partkey AS id, p_size % 32 AS x, p_partkey * 7 % 32 AS y FROM part), c AS (SELECT *, x * 32 + y AS code FROM p),
    d AS (SELECT a.id AS q, b.id, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) AS s, abs(a.code - b.code) AS t FROM c a JOIN c b ON a.id % 20 = 0 AND a.id <> b.id),
    n AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY s, id) <= 10 AS space, row_number() OVER (PARTITION BY q ORDER BY t, id) <= 10 AS code FROM d)
    SELECT q, count(*) FILTER (space AND code) / 10.0::DOUBLE AS preserved FROM n GROUP BY q"""
)
def encoder_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """How well a code row by row keeps neighbours; every 20th part is a query against all."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 32).alias("x"), (F.col("p_partkey") * 7 % 32).alias("y"))
    coded = p.withColumn("code", F.col("x") * 32 + F.col("y"))
    return poisson.neighbour_preservation(coded, coded.filter("id % 20 = 0"), ["x", "y"], "code")


@query()
def template_fit(spark: SparkSession, d: str) -> DataFrame:
    t = templates.TEMPLATES["C1s_organic"]
    e = np.linspace(281.0, 293.0, 121)
    k = F.col("s_suppkey")
    total = F.array(*[F.lit(float(sum(p.area * 1000 * kernels.voigt(np.array([x]), t.reference + 0.2 + p.shift, p.fwhm_g / kernels.FWHM_PER_SIGMA, p.fwhm_l / 2)[0] for p in t.peaks))) for x in e])
    y = spread(read(spark, d, "supplier").select("s_suppkey")).select(k.alias("spectrum_id"), F.array(*[F.lit(float(x)) for x in e]).alias("energy"), F.transform(total, lambda v, j: v + 10 + F.pmod(F.xxhash64(k, j), F.lit(100)) / 100.0).alias("intensity"))
    return templates.fit_template(y, t)


@query("SELECT p_partkey, round(2.0 * (p_size / 50.0 - 0.5) + 1.0 * (p_retailprice / 2000 - 0.5), 8) AS u, round(3.0 * (p_retailprice / 2000 - 0.5), 8) AS v FROM part")
def fisher_coordinates(spark: SparkSession, d: str) -> DataFrame:
    lower = np.array([[2.0, 0.0], [1.0, 3.0]])
    u, v = encode.fisher_coordinates(lower @ lower.T, [F.col("p_size") / 50.0, F.col("p_retailprice") / 2000], np.array([0.5, 0.5]))
    return read(spark, d, "part").select("p_partkey", F.round(u, 8).alias("u"), F.round(v, 8).alias("v"))


@query(
    """WITH a AS (SELECT p_partkey, greatest(p_size / 2.0, 0) AS a0, greatest(p_retailprice / 400.0, 0) AS a1 FROM part), m AS (SELECT greatest(max(a0), max(a1)) AS top FROM a)
    SELECT p_partkey, round(a0 / top, 8) AS a0, round(a1 / top, 8) AS a1 FROM a, m"""
)
def image_decomposition(spark: SparkSession, d: str) -> DataFrame:
    pixels = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("r"), (F.col("p_retailprice") / 100).alias("g"), F.lit(0.0).alias("b"))
    out = encode.image_amplitudes(pixels, np.array([[2.0, 0.0], [0.0, 4.0], [0.0, 0.0]]))
    return out.select("p_partkey", F.round("a0", 8).alias("a0"), F.round("a1", 8).alias("a1"))
