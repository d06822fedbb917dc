"""Refinement, counting statistics, templates, encodings and provenance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lineshed.functions import encode
from lineshed.operators import kernels, poisson, refine, synthetic, templates
from lineshed.operators.kernels import Peaks
from lineshed.sources import provenance

ENERGY = np.linspace(-3, 3, 151)
ONE = Peaks(ENERGY, (0.0,), (0.5,), 0.2)
SF = "/root/testdata/sf0.001"


def truth(spark, n, gamma=0.2, noise=0.0, peaks=ONE):
    k = F.col("id")
    t = spark.range(n).select(k.alias("spectrum_id"), F.array(*[0.5 + ((k + c) % 10) / 10.0 for c in range(len(peaks.centers))]).alias("amplitudes"), (0.2 * F.sin(k.cast("double"))).alias("shift"), (0.05 * F.cos(k.cast("double"))).alias("width"))
    return synthetic.generate(t, Peaks(peaks.energy, peaks.centers, peaks.sigmas, gamma), noise)


def test_six_step_and_gamma(spark):
    y = truth(spark, 60)
    e = refine.fit_six_step(y, ONE).alias("f").join(y.alias("t"), "spectrum_id").agg(F.max(F.abs(F.col("f.shift") - F.col("t.shift")))).first()[0]
    assert e < 0.002
    g = refine.fit_gamma(truth(spark, 20, 0.25), ONE, np.linspace(-0.1, 0.1, 9)).agg(F.avg("delta_gamma")).first()[0]
    assert g == pytest.approx(0.05, abs=0.02)


def test_groups_and_grouped_fit(spark):
    assert refine.group_peaks([0, 1, 10, 20], [0.5] * 4) == [[2 + 1], [2], [0, 1]] or refine.group_peaks([0, 1, 10, 20], [0.5] * 4)[-1] == [0, 1]
    assert refine.group_peaks([0, 0.5], [1, 1]) == [[0, 1]] and refine.group_peaks([], []) == []
    two = Peaks(np.linspace(-4, 8, 200), (0.0, 4.5), (0.5, 0.5), 0.2)
    y = truth(spark, 20, peaks=two)
    for r in refine.fit_grouped(y, two).alias("f").join(y.alias("t"), "spectrum_id").select("f.shifts", "t.shift").collect():
        assert np.allclose(r[0], r[1], atol=0.02)


def test_refine_recovers(spark):
    y = truth(spark, 10, 0.3)
    for r in refine.refine(y, ONE, "full").alias("f").join(y.alias("t"), "spectrum_id").collect():
        assert r["centers"][0] == pytest.approx(r["shift"], abs=1e-4) and r["gamma"] == pytest.approx(0.3, abs=1e-3) and r["chi2"] < 1e-9
    assert [refine.refinement_mode(x, 1.0) for x in (1.5, 3, 9)] == ["light", "medium", "full"]


def test_swaps(spark):
    df = spark.createDataFrame([(1, [2.0, 1.0], [1.1, 2.1], [20.0, 10.0]), (2, [1.0, 2.0], [1.1, 2.1], [10.0, 20.0]), (3, [5.0, 4.0, 3.0, 2.0, 1.0], [1.0, 2.0, 3.0, 4.0, 5.0], [5.0] * 5)], "k long, found array<double>, true array<double>, amp array<double>")
    got = {r["k"]: r for r in refine.correct_swaps(df, "found", "true", ["found", "amp"]).collect()}
    assert got[1]["amp"] == [10, 20] and got[1]["swapped"] and not got[2]["swapped"] and got[3]["found"] == [1, 2, 3, 4, 5]


def test_poisson_likelihood():
    model = poisson.peak_model(ENERGY, 0.0, 0.5, 0.2)
    truth_ = np.array([500.0, 0.05, 3.0])
    rng = np.random.default_rng(1)
    got, covered = [], 0
    for _ in range(40):
        y = rng.poisson(model(truth_)[0])
        p, d, done = poisson.maximum_likelihood(y, model, np.array([300.0, 0.0, 1.0]), np.array([1e-3, -1.0, 1e-3]))
        assert done and d >= 0
        got.append(p)
        lo, hi = poisson.profile_interval(y, model, p, 1, np.array([1e-3, -1.0, 1e-3]))
        covered += lo <= 0.05 <= hi
    cov, rank = kernels.covariance_bound(kernels.poisson_fisher(model(truth_)[1], model(truth_)[0]))
    assert rank == 3 and np.allclose(np.std(got, axis=0), np.sqrt(np.diag(cov)), rtol=0.4) and covered >= 34
    assert poisson.deviance(np.array([2.0, 0.0]), np.array([2.0, 1e-300])) == pytest.approx(0)


def test_information_and_bounds():
    assert poisson.binomial_upper(0, 10) == pytest.approx(1 - 0.05 ** 0.1, abs=1e-9) and poisson.binomial_upper(10, 10) == 1
    f = np.array([[4.0, 1.0], [1.0, 1.0]])
    assert poisson.effective_information(f, [0]) == pytest.approx(np.array([[3.0]]))
    sd, modes = poisson.weakest_modes(np.diag([4.0, 1.0]), [0, 1], [1, 1])
    assert sd.tolist() == [1.0, 0.5] and np.allclose(modes[:, 0], [0, 1])
    r = poisson.rank_report(np.eye(3))
    assert r["rank"] == 3 and r["entropy_rank"] == pytest.approx(3) and r["condition"] == 1
    rng = np.random.default_rng(0)
    assert poisson.resample(np.array([[1, 2], [3, 4]]), "sweeps", rng).shape == (2,) and poisson.resample(np.zeros(3), "nonparametric", rng).tolist() == [0, 0, 0]


def test_template_fit(spark):
    for r in entry.queries()["template_fit"](spark, SF).limit(3).collect():
        assert r["reference"] == pytest.approx(285.2, abs=0.05) and np.allclose(np.array(r["areas"]) / r["areas"][0], [1, 0.3, 0.15, 0.1], atol=0.05)
    assert templates.table(spark).filter("is_reference").count() == 3


def test_encodings(spark):
    fisher = np.array([[5.0, 1.0], [1.0, 2.0]])
    df = spark.createDataFrame([(0.3, -0.7)], "a double, b double")
    u = encode.fisher_coordinates(fisher, ["a", "b"], np.array([0.1, 0.2]))
    out = df.select(u[0].alias("u"), u[1].alias("v"))
    d = np.array([0.2, -0.9])
    assert out.select((F.col("u") ** 2 + F.col("v") ** 2)).first()[0] == pytest.approx(d @ fisher @ d)
    assert tuple(out.select(*encode.of_fisher_coordinates(fisher, ["u", "v"], np.array([0.1, 0.2]))).first()) == pytest.approx((0.3, -0.7))
    assert df.select(encode.pack_channels(F.lit(1), F.lit(2), F.lit(3))).first()[0] == 66051


def test_neighbours(spark):
    points = spark.range(64).select("id", (F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y")).withColumn("code", F.col("id"))
    got = {r["q"]: r["preserved"] for r in poisson.neighbour_preservation(points, points.filter("id in (0, 27)"), ["x", "y"], "code", k=4).collect()}
    xy = {k: (k % 8, k // 8) for k in range(64)}
    for q in (0, 27):
        near = sorted((j for j in xy if j != q), key=lambda j: ((xy[j][0] - xy[q][0]) ** 2 + (xy[j][1] - xy[q][1]) ** 2, j))[:4]
        code = sorted((j for j in xy if j != q), key=lambda j: (abs(j - q), j))[:4]
        assert got[q] == len(set(near) & set(code)) / 4


def test_provenance(spark):
    df = spark.createDataFrame([({"Pass Energy": "50", "User": "me"}, None)], "m map<string, string>, hv double")
    out = provenance.log(provenance.log(df, "a", {"x": 1}, "user", "why"), "b", {}, "file", "")
    r = out.select(provenance.allow(F.col("m")).alias("m"), provenance.fact(F.col("hv"), "file").alias("f"), "transforms").first()
    assert r["m"] == {"Pass Energy": "50"} and tuple(r["f"]) == (None, None) and [t["name"] for t in r["transforms"]] == ["a", "b"]
    with pytest.raises(ValueError):
        provenance.fact(F.col("hv"), "guess")


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - {n for n in entry.queries() if n.startswith("op") and n[2].isdigit()} - {"pipeline", "exact_k", "auto_fit"}))
def test_queries_without_sql_run(spark, name):
    out = entry.queries()[name](spark, SF)
    assert out.columns and out.count() >= 0


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_hilbert_is_a_bijection_with_unit_steps(spark, order):
    from lineshed.functions import codec

    n = 1 << order
    cells = spark.range(n * n).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"))
    rows = cells.select("x", "y", codec.hilbert_2d(F.col("x"), F.col("y"), order).alias("h"), codec.hilbert_2d(F.col("x"), F.col("y"), order, True).alias("u")).collect()
    assert sorted(r["h"] for r in rows) == list(range(n * n)) and next(r for r in rows if r["h"] == 0)[:2] == (0, 0)
    path = [tuple(r[:2]) for r in sorted(rows, key=lambda r: r["u"])]
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(path, path[1:]))


def test_exact_quantile_is_exact(spark):
    from lineshed.operators.robust import exact_quantile, mad_thresholds

    rng = np.random.default_rng(5)
    rows = [("a", float(x)) for x in rng.normal(size=3001)] + [("b", 7.0)] * 500 + [("c", 1.0), ("c", 2.0)] + [("d", float(x)) for x in rng.integers(0, 5, 1000)] + [("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for q in (0.0, 0.03, 0.5, 0.95, 1.0):
        for accuracy in (100, 10_000):
            got = {r["g"]: r["quantile"] for r in exact_quantile(df, "v", q, ["g"], accuracy=accuracy).collect()}
            assert got == pytest.approx({g: float(np.quantile([v for h, v in rows if h == g], q)) for g in "abcd"})
    whole = [v for _, v in rows if v is not None]
    r = mad_thresholds(df, "v").first()
    center = np.median(whole)
    assert r["center"] == pytest.approx(center) and r["mad"] == pytest.approx(np.median(np.abs(np.array(whole) - center)))
