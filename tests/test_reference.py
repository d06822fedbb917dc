"""Reference-table operators, solver refinements and what holds without the corpus part."""

import json
import math
import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineshed import session, tools
from lineshed.functions import codec, scores
from lineshed.operators import analyse, fit, kernels, reference
from lineshed.operators.kernels import Peaks

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_json_tasks_return_all_rows(spark):
    table = spark.range(1001).select(F.lit("Si").alias("element"), F.lit("2p3/2").alias("orbital"), F.col("id").cast("double").alias("binding_energy"))
    assert len(json.loads(tools.lookup_binding_energy(table, "Si", "2p"))) == 1001


def test_spectra_that_cannot_be_read_say_why(spark):
    e = [float(k) for k in range(20)]
    rows = [(1, e, [1.0] * 20), (2, e[:5], [1.0] * 5), (3, e, [1.0] * 19), (4, None, None), (5, e, [float("nan")] * 20)]
    df = spark.createDataFrame(rows, "spectrum_id long, energy array<double>, intensity array<double>")
    got = {r["spectrum_id"]: r["reason"] for r in analyse.auto_fit(df, "linear").collect()}
    assert got == {1: None, 2: "fewer than 12 points", 3: "lengths differ", 4: "no spectrum", 5: "not finite"}


def test_withheld_cells_must_be_those_of_the_table(spark):
    table = spark.createDataFrame([("Si", 1.0), ("O", 2.0)], "element string, v double")
    assert {tuple(r) for r in reference.withhold(table, table.filter("element = 'O'"), ["element"], "v").collect()} == {("Si", 1.0, False), ("O", None, True)}
    with pytest.raises(Exception, match="another value"):
        reference.withhold(table, spark.createDataFrame([("O", 3.0)], "element string, v double"), ["element"], "v").collect()


def test_splittings_and_means(spark):
    lines = [("Si", "2p1/2", 100.0), ("Si", "2p3/2", 99.4), ("Si", "1s", 1839.0), ("Au", "4f7/2", 84.0), ("X", "bad", 1.0)]
    got = {tuple(r) for r in reference.spin_orbit_split(spark.createDataFrame(lines, "element string, orbital string, binding_energy double")).select("element", "shell", F.round("split", 6)).collect()}
    assert got == {("Si", "2p", 0.6), ("Si", "1s", 0.0), ("Au", "4f", None)}
    t = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0), ("AVERAGE", 9.0, None)], "name string, x double, y double")
    assert tuple(reference.average_row(t, "name", ["x", "y"]).first()) == (9.0, 3.0)
    assert {r["name"] for r in reference.search(t, "name", "Aver").collect()} == {"AVERAGE"}


def test_catalogue_lists_formats(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.vms").write_text("x")
    (tmp_path / "deep" / "b.unknown").write_text("yy")
    got = {(os.path.basename(r["path"]), r["bytes"], r["format"]) for r in reference.catalogue(spark, str(tmp_path)).collect()}
    assert got == {("a.vms", 1, "vamas"), ("b.unknown", 2, None)}


def test_samples_do_not_depend_on_partitions(spark):
    one = reference.sample_exactly(spark.range(500), "id", 20, 3).collect()
    two = reference.sample_exactly(spark.range(500).repartition(7), "id", 20, 3).collect()
    assert sorted(r[0] for r in one) == sorted(r[0] for r in two) and len({r[0] for r in one}) == 20
    assert reference.sample_exactly(spark.range(3), "id", 20).count() == 3


def test_neighbours_on_the_cube_curve(spark):
    cells = spark.range(512).select(codec.hilbert_cell(F.col("id"), 3, 3).alias("c"), "id")
    back = cells.select("id", "c.*", codec.hilbert_index([F.col("c.v0"), F.col("c.v1"), F.col("c.v2")], 3).alias("again")).orderBy("id").collect()
    assert [r["again"] for r in back] == list(range(512)) and len({tuple(r)[1:4] for r in back}) == 512
    assert tuple(back[0])[1:4] == (0, 0, 0)


def test_log_gamma(spark):
    xs = [0.1, 0.5, 1.0, 2.0, 3.7, 25.0, 1e4]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(scores.log_gamma("x")).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-10, abs=1e-10)


def test_curvature_is_the_second_derivative():
    p = Peaks(np.linspace(-3, 3, 61), (0.0, 0.7), (0.5, 0.4), 0.2, split=0.6, ratio=2.0)
    h = 1e-4
    assert np.allclose(p.curvature(0.1, 0.05), (p.basis(0.1 + h, 0.05)[1] - p.basis(0.1 - h, 0.05)[1]) / (2 * h), atol=1e-5)


def test_six_steps_take_curvature_for_no_width():
    p = Peaks(np.linspace(-3, 3, 151), (0.0,), (0.5,), 0.2)
    d = kernels.build_dictionary(p)
    y = 2 * p.basis(0.12, 0.0)[0].T
    four = kernels.solve_four_step(y, d, d.nominal)
    six = kernels.solve_four_step(y, d, d.nominal, p.curvature(d.shifts[d.nominal // len(d.widths)], 0.0))
    assert abs(six[2][0]) < 0.5 * abs(four[2][0]) and six[1][0] == four[1][0]


def test_adaptive_modes():
    p = Peaks(np.linspace(-3, 3, 151), (0.0,), (0.5,), 0.2)
    d = kernels.build_dictionary(p)
    rng = np.random.default_rng(1)
    y = np.concatenate([p.basis(s, 0.0)[0].T for s in (0.01, 0.05, 0.29)]) * 3
    near = kernels.solve_dictionary(y, d, "taylor", p)
    assert np.allclose([x[0] for x in kernels.solve_four_step(y[:1], d, d.nominal)[1:]], [x[0] for x in near[1:]])
    assert near[1][2] == pytest.approx(0.29, abs=0.01)
    noisy = y + rng.normal(0, 0.3, y.shape)
    clean = kernels.solve_dictionary(np.concatenate([y, noisy]), d, "clean")
    plain = kernels.solve_dictionary(noisy, d, "none")
    assert np.allclose(clean[0][3:], plain[0]) and np.allclose(clean[1][3:], plain[1]) and clean[1][1] == pytest.approx(0.05, abs=1e-3)


def test_multipeak_recovers_three_components():
    e = np.linspace(-4, 4, 161)
    each = [Peaks(e, (c,), (0.4,), 0.15, n_shift=13) for c in (-1.8, 0.0, 1.9)]
    rng = np.random.default_rng(2)
    a, s = rng.uniform(1, 3, (50, 3)), rng.uniform(-0.15, 0.15, (50, 3))
    y = sum(a[:, [k]] * np.stack([kernels.voigt(e, p.centers[0] + s[n, k], 0.4, 0.15) for n in range(50)]) for k, p in enumerate(each))
    got = kernels.solve_multipeak(y, [kernels.build_dictionary(p) for p in each], 8)
    assert np.abs(got[0] - a).max() < 0.15 and np.abs(got[1] - s).max() < 0.05


def test_hybrid_refines_as_far_as_needed(spark):
    p = Peaks(np.linspace(-3, 3, 61), (0.0,), (0.5,), 0.2)
    rng = np.random.default_rng(5)
    rows = [(k, (2 * kernels.voigt(p.energy, 0.02 if k % 25 else 0.28, 0.5, 0.2) + rng.normal(0, 0.004, 61)).tolist()) for k in range(200)]
    got = {r["spectrum_id"]: r for r in fit.hybrid(spark.createDataFrame(rows, "spectrum_id long, intensity array<double>"), p, second="auto").collect()}
    assert all(got[k]["is_anomaly"] and got[k]["shift"] == pytest.approx(0.28, abs=0.01) for k in range(0, 200, 25)) and len(got) == 200


def test_scratch_must_be_shared_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": lambda self, key, default=None: None})()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.scratch_root(Session())


@pytest.mark.parametrize("also", [True, False])
def test_the_rest_stands_without_the_corpus_part(tmp_path, also):
    for name in ("lineshed", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(source) and (also or name != "corpus_pipeline.py"):
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert len(q) > 90 and set(o) <= set(q) and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_composition_uncertainty_follows_counts(spark):
    e = np.linspace(0, 10, 41)
    rows = [(s, x, e.tolist(), (20 + n * kernels.voigt(e, 5, 0.6, 0.1)).tolist(), 1.0, 1.0) for s, n in (("much", 40_000), ("little", 400)) for x in ("A", "B")] + [("none", "A", e.tolist(), [0.0] * 41, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "sample string, element string, energy array<double>, intensity array<double>, cross_section double, imfp double")
    got = {(r["sample"], r["element"]): r for r in analyse.composition_uncertainty(df, 100).collect()}
    assert got["much", "A"]["mean"] == pytest.approx(0.5, abs=0.01) and got["much", "A"]["sd"] < 0.5 * got["little", "A"]["sd"]
    assert got["none", "A"]["n_refused"] == 100 and got["none", "A"]["mean"] is None and got["much", "B"]["n_refused"] == 0
    again = {(r["sample"], r["element"]): r["sd"] for r in analyse.composition_uncertainty(df.repartition(3), 100).collect()}
    assert again["much", "A"] == pytest.approx(got["much", "A"]["sd"])


def test_bootstrap_kinds(spark):
    e = np.linspace(0, 1, 20)
    df = spark.createDataFrame([(1, e.tolist(), [100.0] * 20)], "spectrum_id long, energy array<double>, intensity array<double>")
    total = lambda e, y: float(y.sum())
    plain = [r["value"] for r in analyse.bootstrap(df, total, 200).collect()]
    twice = [r["value"] for r in analyse.bootstrap(df, total, 200, kind="parametric", mean=lambda e, y: 2 * y).collect()]
    sweeps = spark.createDataFrame([(1, e.tolist(), [[float(k)] * 20 for k in range(5)])], "spectrum_id long, energy array<double>, intensity array<array<double>>")
    drawn = [r["value"] for r in analyse.bootstrap(sweeps, total, 50, kind="sweeps").collect()]
    assert np.mean(plain) == pytest.approx(2000, rel=0.01) and np.mean(twice) == pytest.approx(4000, rel=0.01)
    assert np.std(plain) == pytest.approx(math.sqrt(2000), rel=0.25) and {v % 20 for v in drawn} == {0} and len(set(drawn)) > 3


def test_neighbours_in_blocks_of_queries(spark):
    from lineshed.operators import poisson

    rng = np.random.default_rng(7)
    xy = rng.integers(0, 12, (300, 2))
    code = (xy[:, 0] * 12 + xy[:, 1]).tolist()
    df = spark.createDataFrame([(k, int(a), int(b), c) for k, ((a, b), c) in enumerate(zip(xy.tolist(), code))], "id long, x long, y long, code long")
    got = {r["q"]: r["preserved"] for r in poisson.neighbour_preservation(df, df.filter("id % 20 = 0"), ["x", "y"], "code", block=4).collect()}
    for q in range(0, 300, 20):
        others = [k for k in range(300) if k != q]
        space = sorted(others, key=lambda k: (((xy[k] - xy[q]) ** 2).sum(), k))[:10]
        near = sorted(others, key=lambda k: (abs(code[k] - code[q]), k))[:10]
        assert got[q] == pytest.approx(len(set(space) & set(near)) / 10)
    assert poisson.neighbour_preservation(df, df.filter("false"), ["x", "y"], "code").count() == 0


def _pair(e, gamma=0.15):
    return [Peaks(e, (c,), (0.4,), gamma, n_shift=13) for c in (-0.9, 0.8)]


def test_multipeak_with_base_and_polish(spark):
    e = np.linspace(-4, 4, 161)
    rng = np.random.default_rng(3)
    a, s = rng.uniform(1, 3, (40, 2)), rng.uniform(-0.12, 0.12, (40, 2))
    y = sum(a[:, [k]] * np.stack([kernels.voigt(e, c + s[n, k], 0.4, 0.15) for n in range(40)]) for k, c in enumerate((-0.9, 0.8))) + 0.5 + 0.1 * e
    df = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(y)] + [(99, None), (98, [1.0])], "spectrum_id long, intensity array<double>")
    got = {r["spectrum_id"]: r for r in fit.fit_multipeak(df, _pair(e), degree=1, polish=6).collect()}
    for n in range(40):
        assert np.allclose(got[n]["amplitudes"], a[n], atol=1e-4) and np.allclose(got[n]["shifts"], s[n], atol=1e-4) and got[n]["chi2"] < 1e-9
    assert got[99]["amplitudes"] is None and got[98]["chi2"] is None and len(got) == 42


def test_multipeak_gamma_gate_and_two_stages(spark):
    e = np.linspace(-4, 4, 161)
    y = [sum(2 * kernels.voigt(e, c, 0.4, g) for c in (-0.9, 0.8)) for g in (0.15, 0.25, 0.25)]
    df = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(y)], "spectrum_id long, intensity array<double>")
    got = {r["spectrum_id"]: r["delta_gamma"] for r in fit.fit_multipeak(df, _pair(e), deltas=(-0.05, 0.05, 0.1)).collect()}
    assert got == {0: 0.0, 1: pytest.approx(0.1), 2: pytest.approx(0.1)}
    second, delta = fit.fit_multipeak_twice(df, _pair(e), (-0.05, 0.05, 0.1))
    chi2 = {r["spectrum_id"]: r["chi2"] for r in second.collect()}
    assert delta == pytest.approx(0.1) and chi2[1] < chi2[0]


def test_broadened_asymmetric_lines():
    e = np.linspace(-10, 10, 2001)
    assert np.allclose(kernels.doniach_sunjic(e, 0.0, 0.6, 0.0) / kernels.doniach_sunjic(e, 0.0, 0.6, 0.0).max(), 0.09 / (e * e + 0.09))
    y = kernels.doniach_sunjic(e, 0.0, 0.4, 0.0, 0.8)
    assert abs(np.trapezoid(y, e)) == pytest.approx(1) and np.allclose(y[800:1200] / y.max(), kernels.voigt(e, 0, 0.8 / kernels.FWHM_PER_SIGMA, 0.2)[800:1200] / kernels.voigt(np.zeros(1), 0, 0.8 / kernels.FWHM_PER_SIGMA, 0.2), atol=2e-3)
    tail = kernels.doniach_sunjic(e, 0.0, 0.4, 0.2, 0.3)
    assert tail[1300] > tail[700] and kernels.doniach_sunjic(e, 0.0, 0.4, 0.2, 0.3, True)[700] == pytest.approx(tail[1300])
    basis = kernels.mixed_basis(e, [{"shape": "voigt", "center": 1.0, "sigma": 0.3, "gamma": 0.1}, {"shape": "doniach_sunjic", "center": -1.0, "fwhm_l": 0.3, "asymmetry": 0.1}])
    assert basis.shape == (2001, 2) and e[basis[:, 0].argmax()] == pytest.approx(1.0)
    assert kernels.quantile_grid(np.array([1.0, 1, 1, 2, 5]), 3).tolist() == [1.0, 5.0]


def test_doublets_are_each_others_best(spark):
    rows = [(1, 0, 99.4, 2.0), (1, 1, 100.0, 1.0), (1, 2, 100.05, 0.9), (1, 3, 103.0, 5.0), (2, 0, 99.4, 2.0), (2, 1, 100.0, 3.0)]
    from lineshed.operators import relate

    got = {(r["spectrum_id"], r["main"], r["partner"]) for r in relate.pair_doublets(spark.createDataFrame(rows, "spectrum_id long, comp int, center double, area double"), 0.6, 2.0).collect()}
    assert got == {(1, 0, 1)}


def test_folders_are_compressed(spark, tmp_path):
    from lineshed.sources import tables

    source = tmp_path / "in"
    source.mkdir()
    e = np.linspace(90, 100, 4000)
    for k in range(3):
        (source / f"s{k}.txt").write_text("# e i\n" + "\n".join(f"{a:.5f}\t{1000 + (j * 7) % 50}" for j, a in enumerate(e)) + "\n")
    got = tables.compress_folder(spark, str(source), str(tmp_path / "out")).first()
    assert got["spectra"] == 3 and got["bytes_after"] < got["bytes_before"]
    assert spark.read.parquet(str(tmp_path / "out")).filter("counts is not null and intensity is null").count() == 3


def test_dos_forms_agree_on_a_flat_band_and_differ_on_a_slope(spark):
    e = np.linspace(-1, 1, 160)
    occupied = 1 / (1 + np.exp(e / (8.617333262e-5 * 300)))
    rows = [(1, e.tolist(), (5 + 100 * occupied).tolist()), (2, e.tolist(), (5 + (100 - 60 * np.minimum(e, 0)) * occupied).tolist())]
    got = {r["spectrum_id"]: r for r in analyse.compare_dos(spark.createDataFrame(rows, "spectrum_id long, energy array<double>, intensity array<double>")).collect()}
    assert got[1]["edge_spread"] < 2e-3 and got[2]["edge_occupied"] == pytest.approx(0, abs=5e-3) and got[2]["success"]


def test_profiles_follow_fisher_near_the_estimate():
    from lineshed.operators import poisson

    e = np.linspace(-3, 3, 61)
    model = poisson.peak_model(e, 0.0, 0.5, 0.2)
    truth = np.array([400.0, 0.1, 5.0])
    y = np.round(model(truth)[0])
    p, _, done = poisson.maximum_likelihood(y, model, truth, np.array([1e-3, -1, 1e-3]))
    sd = 1 / math.sqrt(poisson.effective_information(kernels.poisson_fisher(model(p)[1], model(p)[0]), [1])[0, 0])
    rows = poisson.mode_profile(y, model, p, np.array([0.0, 1.0, 0.0]), [-sd, 0.0, sd])
    assert done and rows[1][1] == pytest.approx(0, abs=1e-6) and [r[1] for r in rows[::2]] == pytest.approx([1, 1], rel=0.1) and rows[0][2] == pytest.approx(1, rel=1e-6)


def test_presets_elements_and_profiles(spark):
    from lineshed.operators import synthetic

    synthetic.register_preset("X1s", 0.4, 0.1)
    e = np.linspace(-4, 4, 101)
    each = {"X1s": synthetic.preset("X1s", e, (0.0,)), "Si2p": synthetic.preset("Si2p", e, (0.0,))}
    rows = {n: spark.createDataFrame([(k, [a] if n == "X1s" else [4 - a], 0.0, 0.0) for k, a in ((1, 1.0), (2, 3.0))], "spectrum_id long, amplitudes array<double>, shift double, width double") for n in each}
    fitted = fit.fit_elements({n: synthetic.generate(rows[n], p) for n, p in each.items()}, each)
    got = {r["spectrum_id"]: r["X1s"] for r in fit.depth_profile(fitted).collect()}
    assert got == {1: pytest.approx(0.25, abs=1e-3), 2: pytest.approx(0.75, abs=1e-3)}


def test_streams_tell_their_progress(spark, tmp_path):
    from lineshed.streaming import fits

    p = Peaks(np.linspace(-3, 3, 61), (0.0,), (0.5,), 0.2)
    for k in range(3):
        spark.createDataFrame([(k, p.basis()[0][:, 0].tolist())], "spectrum_id long, intensity array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = fits.stream_fit(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at"), p, files_per_batch=1)
    frames = list(fits.progress(query, 0.2))
    assert sum(f["rows"] for f in frames) == 3 and spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_islands_of_a_whole_table(spark):
    from lineshed.operators import ordered

    rng = np.random.default_rng(4)
    xs = np.cumsum(rng.choice([0.1, 0.5, 3.0], 400))
    df = spark.createDataFrame([(float(x), float(1 + k % 3)) for k, x in enumerate(xs)], "x double, s double").repartition(5)
    got = [r["island"] for r in ordered.islands(df, "x", 2.0).orderBy("x").collect()]
    assert got == np.concatenate([[0], np.cumsum(np.diff(xs) >= 2.0)]).tolist()
    wide = [r["island"] for r in ordered.islands(df, "x", 1.0, width="s").orderBy("x").collect()]
    s = 1 + np.arange(400) % 3
    assert wide == np.concatenate([[0], np.cumsum(np.diff(xs) / ((s[1:] + s[:-1]) / 2) >= 1.0)]).tolist()
