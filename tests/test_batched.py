"""Solvers for many spectra against those for one, and how the queries deal them out."""

import numpy as np
import pytest

import __spark_entry__ as entry
from lineshed.operators import analyse, batched, kernels, poisson, templates
from lineshed.plans import spectra

SF = "/root/testdata/sf0.001"
E = np.linspace(96, 106, 128)


def counts(n: int) -> np.ndarray:
    rng = np.random.default_rng(3)
    return np.stack([300 * kernels.voigt(E, 99.3, 0.45, 0.1) + (150 + k) * kernels.voigt(E, 103.4, 0.6, 0.1) + rng.normal(0, 1, len(E)) for k in range(n)])


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize("sigma,gamma", [(0.4, 0.2), (0.05, 0.0), (3.0, 1e-3), (0.0, 0.3)])
def test_profiles_of_many(sigma, gamma):
    got = batched.voigt_derivatives(np.stack([E, E + 1]), np.array([[100.0], [101.5]]), np.array([[sigma], [sigma]]), np.array([[gamma], [gamma]]))
    assert np.allclose(got[0][:, 0], [kernels.voigt(E, 100.0, sigma, gamma), kernels.voigt(E + 1, 101.5, sigma, gamma)], rtol=1e-12, atol=1e-13)
    if sigma:
        for a, b in zip(got, kernels.voigt_derivatives(E, 100.0, sigma, gamma)):
            assert np.allclose(a[0, 0], b, rtol=1e-10, atol=1e-10)


def test_variable_projections_of_many():
    n = 300  # more than are solved at a time
    y = counts(n)
    e, centers = np.broadcast_to(E, y.shape), np.tile([99.0, 103.8], (n, 1))
    rest, cost, done = batched.varpro(e, y, np.arange(n), centers, 0.5, 0.1, 1.5)
    assert done.all() and np.allclose(np.einsum("ij,ij->i", rest, rest), cost)
    for k in (0, 130, 299):
        assert kernels.varpro(E, y[k], [99.0, 103.8], [0.5, 0.5], 0.1, 1.5)["chi2"] * len(E) == pytest.approx(cost[k], rel=1e-8)


def test_projection_on_dependent_profiles():
    b = np.stack([E - 100, 2 * (E - 100), np.ones_like(E)])[None]
    q, inverse = batched.orthogonal(b)
    assert not q[0, 1].any() and np.allclose(inverse[0, ::2] @ b[0, ::2].T, np.eye(2)) and np.allclose(q[0, ::2] @ q[0, ::2].T, np.eye(2))


def test_exact_k_is_dealt_out_and_fits_once(spark):
    assert spectra._some(spark, SF).rdd.getNumPartitions() > 1
    assert plan(entry.queries()["exact_k"](spark, SF)).count("MapInPandas") == 2  # the background, the fits


def test_exact_k_of_odd_spectra(spark):
    y = counts(1)[0].tolist()
    rows = [(1, E.tolist(), y), (2, None, None), (3, E.tolist(), [float("nan")] * len(E)), (4, E[:60].tolist(), y[:60]), (5, E.tolist(), y[:-1])]
    df = spark.createDataFrame(rows, "spectrum_id long, energy array<double>, intensity array<double>")
    got = analyse.exact_k(df, 2, 2).collect()
    assert len(got) == 10 and all((r["rss"] is None) == (r["spectrum_id"] in (2, 3, 5)) for r in got)
    assert {r["spectrum_id"]: r["k"] for r in analyse.verdicts(analyse.exact_k(df, 2, 2)).collect()} == {1: 2, 2: None, 3: None, 4: 1, 5: None}


def test_verdicts(spark):
    rows = [(1, 1, 50.0, 0.0, True), (1, 2, 20.0, 0.1, True), (1, 3, 10.0, 0.0, False), (2, 1, 5.0, 0.0, True), (2, 2, 5.0, 0.0, True), (3, 1, 1.0, 0.0, False), (4, 2, 3.0, 0.9, True), (5, 1, 3.0, 0.0, True)]
    df = spark.createDataFrame(rows, "spectrum_id long, k int, bic double, acf1 double, success boolean")
    got = {r["spectrum_id"]: tuple(r)[1:] for r in analyse.verdicts(df).collect()}
    assert got == {1: (2, 20.0, 30.0, "supported"), 2: (1, 5.0, 0.0, "ambiguous"), 3: (None, None, None, "unsupported"), 4: (2, 3.0, None, "unsupported"), 5: (1, 3.0, None, "supported")}


AXIS = np.linspace(-3, 3, 151)
LOW = np.array([1e-3, -1.0, 1e-3])


def test_likelihoods_and_intervals_of_many():
    rng = np.random.default_rng(5)
    model = poisson.peak_model(AXIS, 0.0, 0.5, 0.2)
    truth = np.stack([np.geomspace(0.5, 3000, 8), np.linspace(-0.4, 0.4, 8), np.full(8, 0.3)], axis=1)
    y = rng.poisson(model(truth)[0]).astype(float)
    start = np.tile([150.0, 0.0, 1.0], (8, 1))
    p, d, done = poisson.maximum_likelihoods(y, model, start, LOW)
    lo, hi = poisson.profile_intervals(y, model, p, 1, LOW)
    plain = poisson.by_rows(lambda q: model(q))  # takes no rows by itself
    assert all(np.allclose(a, b) for a, b in zip(poisson.maximum_likelihoods(y, plain, start, LOW), (p, d, done)))
    for k in range(8):
        q, least, converged = poisson.maximum_likelihood(y[k], model, start[k], LOW)
        assert d[k] == pytest.approx(least, abs=1e-8) and done[k] == converged and np.allclose(p[k], q, rtol=1e-4, atol=1e-4)
        assert (lo[k], hi[k]) == pytest.approx(poisson.profile_interval(y[k], model, q, 1, LOW), abs=1e-5)


def test_poisson_mle_is_dealt_out(spark):
    out = entry.queries()["poisson_mle"](spark, SF)
    assert out.rdd.getNumPartitions() > 1 and out.filter("success and low < 0.05 and high > 0.05").count() > 0


def test_counts_that_cannot_be_fitted(spark):
    model = poisson.peak_model(AXIS, 0.0, 0.5, 0.2)
    y = np.round(model(np.array([200.0, 0.05, 5.0]))[0]).tolist()
    df = spark.createDataFrame([(1, y), (2, None), (3, [float("nan")] * 151)], "spectrum_id long, intensity array<double>")
    got = {r["spectrum_id"]: r for r in poisson.fit_counts(df, model, (150.0, 0.0, 1.0), LOW, 1).collect()}
    assert got[1]["success"] and got[1]["low"] < got[1]["parameters"][1] < got[1]["high"]
    assert all(not got[k]["success"] and got[k]["parameters"] is None and got[k]["deviance"] is None and got[k]["low"] is None for k in (2, 3))


def system(template, e, place, sign=1.0):
    lines = [(p, place + sign * (p.shift + s), r) for p in template.peaks for s, r in ((0.0, 1.0), (template.split, template.ratio)) if r]
    return sum(r * 500 * p.area * kernels.voigt(e, c, p.fwhm_g / kernels.FWHM_PER_SIGMA, p.fwhm_l / 2) for p, c, r in lines)


@pytest.mark.parametrize("name,kinetic", [("Si2p_oxide", False), ("Ta4f_oxide", True), ("C1s_organic", False)])
def test_templates_of_many_axes(spark, name, kinetic):
    t = templates.TEMPLATES[name]
    nominal = 1000 - t.reference if kinetic else t.reference
    rows = []
    for k in range(6):  # other axes, lengths and places
        e = np.linspace(nominal - 12 - k % 3, nominal + 12, 200 + k // 3)
        y = system(t, e, nominal + 0.1 * k - 0.2, -1.0 if kinetic else 1.0)
        rows.append((k, e.tolist(), (y - np.interp(e, e[[0, -1]], y[[0, -1]])).tolist()))
    rows.append((6, None, None))
    df = spark.createDataFrame(rows, "spectrum_id long, energy array<double>, intensity array<double>")
    got = {r["spectrum_id"]: r for r in templates.fit_template(df, t, kinetic, 1000.0, "constant").collect()}
    assert got[6]["reason"] == "no spectrum" and got[6]["areas"] is None
    for k in range(6):
        assert got[k]["success"] and got[k]["reference"] == pytest.approx(nominal + 0.1 * k - 0.2, abs=0.02)
        assert np.allclose(got[k]["areas"], [500 * p.area for p in t.peaks], rtol=0.1, atol=15)


def test_template_fit_is_dealt_out(spark):
    out = entry.queries()["template_fit"](spark, SF)
    assert out.rdd.getNumPartitions() > 1 and out.filter("success").count() == out.count()


def test_auto_fit_of_unequal_spectra(spark):
    rng = np.random.default_rng(7)
    cases = []
    for n, lines in ((128, [(300, 99.3, 0.5)]), (128, [(300, 98.6, 0.45), (200, 103.4, 0.6)]), (160, [(300, 98.0, 0.4), (250, 101.0, 0.5), (200, 104.0, 0.4)]), (128, [(900, 101.5, 1.2)]), (128, [])):
        e = np.linspace(96, 106, n)
        y = sum((a * kernels.voigt(e, c, s, 0.1) for a, c, s in lines), np.zeros(n))
        if lines == [(900, 101.5, 1.2)]:
            y += 6 * kernels.voigt(e, 97.4, 0.08, 0.0)  # found, then dropped for its area
        cases.append((e, y + rng.normal(0, 0.05, n) if lines else y))
    df = spark.createDataFrame([(k, e.tolist(), y.tolist()) for k, (e, y) in enumerate(cases)], "spectrum_id long, energy array<double>, intensity array<double>").coalesce(1)
    got = {r["spectrum_id"]: r for r in analyse.auto_fit(df, "constant").collect()}
    assert got[4]["n_components"] == 0 and not got[4]["success"] and got[4]["centers"] is None
    for r, (e, y) in enumerate(cases[:4]):
        net, width = y - min(y[0], y[-1]), 10 / 30
        f = analyse._fit_peaks(e, net, e[analyse.detect_peaks(e, net)], width)  # one at a time, forward differences
        k = len(f["p"]) // 3
        keep = f["p"][:k] >= 0.01 * f["p"][:k].max()
        assert keep.all() == (r != 3)
        if not keep.all():
            f = analyse._fit_peaks(e, net, f["p"][k : 2 * k][keep], width)
            k = int(keep.sum())
        assert got[r]["n_components"] == k and np.allclose(got[r]["centers"], f["p"][k : 2 * k], atol=1e-5) and np.allclose(got[r]["areas"], f["p"][:k], rtol=1e-4)
        assert got[r]["chi2"] * len(e) == pytest.approx(f["cost"], rel=1e-6) and got[r]["success"] == f["done"]


def test_auto_fit_is_dealt_out(spark):
    out = entry.queries()["auto_fit"](spark, SF)
    assert out.rdd.getNumPartitions() > 1 and out.filter("success and n_components = 2").count() == out.count()
