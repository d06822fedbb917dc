"""Kernels, fits, backgrounds, readers and streams against closed forms and brute force."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineshed.functions import axis, lineshape, physics
from lineshed.operators import analyse, background, fit, kernels, ordered, quantify, relate, synthetic
from lineshed.operators.kernels import Peaks
from lineshed.sources import instruments, tables
from lineshed.streaming import fits

ENERGY = np.linspace(-3, 3, 151)
ONE = Peaks(ENERGY, (0.0,), (0.5,), 0.2)


def test_faddeeva_by_quadrature():
    t = np.linspace(-12, 12, 200_001)
    for z in (0.1 + 0.5j, 2 + 1j, -3 + 0.2j, 0.5j, 6 + 0.05j):
        want = 1j / math.pi * np.trapezoid(np.exp(-t * t) / (z - t), t)
        assert abs(kernels.faddeeva(np.array([z]))[0] - want) < 1e-6
    x = np.linspace(-4, 4, 33)
    assert np.allclose(kernels.faddeeva(x + 0j).real, np.exp(-x * x), atol=1e-10)


def test_voigt_area_limits_and_derivatives():
    e = np.linspace(-400, 400, 400_001)
    assert np.trapezoid(kernels.voigt(e, 0.3, 0.5, 0.2), e) == pytest.approx(1, abs=1e-3)
    assert np.allclose(kernels.voigt(e, 0, 0.5, 1e-9), np.exp(-e * e / 0.5) / (0.5 * math.sqrt(2 * math.pi)), atol=1e-8)
    v = kernels.voigt_derivatives(ENERGY, 0.1, 0.5, 0.2)
    h = 1e-6
    for k, (lo, hi) in enumerate([((0.1 - h, 0.5, 0.2), (0.1 + h, 0.5, 0.2)), ((0.1, 0.5 - h, 0.2), (0.1, 0.5 + h, 0.2)), ((0.1, 0.5, 0.2 - h), (0.1, 0.5, 0.2 + h))], 1):
        assert np.allclose(v[k], (kernels.voigt(ENERGY, *hi) - kernels.voigt(ENERGY, *lo)) / (2 * h), atol=1e-6)


def test_dictionary_columns_and_nominal_cell():
    d = kernels.build_dictionary(ONE)
    assert np.allclose(np.linalg.norm(d.columns, axis=0), 1, atol=1e-12)
    assert (d.shifts[d.nominal // len(d.widths)], d.widths[d.nominal % len(d.widths)]) == (0, pytest.approx(0, abs=1e-12))
    assert np.allclose(d.weights[d.nominal] @ d.profiles[d.nominal], 1, atol=1e-6)


@pytest.mark.parametrize("mode,shift_error,amplitude_error", [("fast", 0.03, 0.05), ("dictionary", 0.012, 0.03), ("balanced", 0.004, 0.02), ("precise", 0.002, 0.005)])
def test_fit_recovers_truth(spark, mode, shift_error, amplitude_error):
    k = F.col("id")
    truth = spark.range(400).select(k.alias("spectrum_id"), F.array(0.5 + (k % 10) / 10.0).alias("amplitudes"), (0.2 * F.sin(k.cast("double"))).alias("shift"), (0.05 * F.cos(k.cast("double") * 3)).alias("width"))
    got = fit.fit(synthetic.generate(truth, ONE), ONE, mode).alias("f").join(truth.alias("t"), "spectrum_id")
    e = got.agg(F.max(F.abs(F.col("f.shift") - F.col("t.shift"))), F.max(F.abs(F.col("f.amplitudes")[0] - F.col("t.amplitudes")[0]))).first()
    assert e[0] < shift_error and e[1] < amplitude_error


def test_fit_is_the_same_in_any_partitioning_and_skips_bad_rows(spark):
    truth = spark.range(50).select(F.col("id").alias("spectrum_id"), F.array(F.lit(1.0)).alias("amplitudes"), F.lit(0.1).alias("shift"), F.lit(0.0).alias("width"))
    y = synthetic.generate(truth, ONE, noise=0.01)
    a = sorted(tuple(r) for r in y.repartition(7).select("spectrum_id", F.col("intensity")[3]).collect())
    assert a == sorted(tuple(r) for r in y.coalesce(1).select("spectrum_id", F.col("intensity")[3]).collect())
    bad = spark.createDataFrame([(1, None), (2, [1.0, 2.0]), (3, [float("nan")] * 151), (4, [0.0] * 151)], "spectrum_id long, intensity array<double>")
    got = {r["spectrum_id"]: r for r in fit.fit(bad, ONE, "balanced").collect()}
    assert [got[k]["chi2"] for k in (1, 2, 3)] == [None] * 3 and got[4]["amplitudes"] == [0.0]
    assert fit.fit(bad.filter("false"), ONE).count() == 0


def test_gamma_calibration(spark):
    truth = spark.range(60).select(F.col("id").alias("spectrum_id"), F.array(F.lit(1.0)).alias("amplitudes"), F.lit(0.0).alias("shift"), F.lit(0.0).alias("width"))
    y = synthetic.generate(truth, ONE, noise=0.001)
    assert fit.calibrate_gamma(y, Peaks(ENERGY, (0.0,), (0.5,), 0.16, n_width=1)) == pytest.approx(0.04, abs=0.01)


def test_multipeak_and_hybrid(spark):
    e = np.linspace(96, 106, 128)
    two = Peaks(e, (99.3, 103.4), (0.45, 0.6), 0.1)
    k = F.col("id")
    truth = spark.range(40).select(k.alias("spectrum_id"), F.array(1.0 + (k % 3) / 3.0, 0.5 + (k % 5) / 5.0).alias("amplitudes"), (0.1 * F.sin(k.cast("double"))).alias("shift"), F.lit(0.0).alias("width"))
    got = fit.fit_multipeak(synthetic.generate(truth, two), [Peaks(e, (c,), (s,), 0.1) for c, s in zip(two.centers, two.sigmas)]).alias("f").join(truth.alias("t"), "spectrum_id").collect()
    for r in got:
        assert np.allclose(r[1], r[6], atol=0.02) or np.allclose(r[1], r[6], rtol=0.03)
        assert np.allclose(r["shifts"], r["shift"], atol=0.01)
    y = synthetic.generate(truth, two)
    assert fit.to_components(fit.hybrid(y, two), two).count() == 80


def test_round_trip(spark):
    pixels = spark.range(300).select(F.col("id").alias("spectrum_id"), *[F.pmod(F.xxhash64("id", F.lit(c)), F.lit(256)).cast("int").alias(c) for c in "rgb"])
    r = synthetic.round_trip(pixels, ONE).first()
    assert r["psnr_r"] > 45 and r["psnr_g"] > 40 and r["psnr_b"] > 25


def test_backgrounds(spark):
    e = np.linspace(100, 110, 101)
    y = 50 + 100 * kernels.voigt(e, 105, 0.6, 0.2) + 20 * (e > 105)
    b = kernels.shirley(e, y)
    assert b[0] == pytest.approx(y[0], abs=1.0) and b[-1] == pytest.approx(y[-1], abs=1e-6) and (np.diff(b) > -1e-9).all()
    assert np.allclose(kernels.shirley(e[::-1], y[::-1])[::-1], b)
    t = kernels.tougaard(e, y)
    n = len(e)
    step = (e[-1] - e[0]) / (n - 1)
    brute = [sum((y[j] - min(y[:10].mean(), y[-10:].mean())) * (i - j) * step / (1643 + ((i - j) * step) ** 2) ** 2 for j in range(i + 1)) for i in range(n)]
    scale = (y[-10:].mean() - y[:10].mean()) / np.mean(brute[-10:])
    assert np.allclose(t, scale * np.array(brute) + y[:10].mean())
    df = spark.createDataFrame([(1, e.tolist(), y.tolist()), (2, None, None)], "spectrum_id long, energy array<double>, intensity array<double>")
    for kind in background.BACKGROUNDS:
        got = {r["spectrum_id"]: r for r in background.subtract(df, kind).collect()}
        assert got[2]["net"] is None and np.allclose(np.add(got[1]["net"], got[1]["background"]), y)


def test_savgol_peaks_pchip_lm():
    x = np.arange(30.0)
    cubic = 1 + x - 0.1 * x**2 + 0.01 * x**3
    assert np.allclose(kernels.savitzky_golay(cubic), cubic)
    y = np.zeros(50)
    y[[10, 13, 30]] = [5, 3, 4]
    places, prominence = kernels.find_peaks(y)
    assert places.tolist() == [10, 13, 30] and prominence.tolist() == [5, 3, 4]
    assert kernels.find_peaks(y, distance=5)[0].tolist() == [10, 30]
    g = np.array([0.0, 1, 2, 4, 5])
    v = np.array([0.0, 1, 1, 3, 10])
    at = np.linspace(0, 5, 200)
    p = kernels.pchip(g, v, at)
    assert np.allclose(kernels.pchip(g, v, g), v) and (np.diff(p) > -1e-12).all()
    t = np.linspace(0, 4, 60)
    fitted, _, cost, done = kernels.least_squares(lambda q: 3 * np.exp(-1.3 * t) - q[0] * np.exp(-q[1] * t), np.array([1.0, 0.5]), np.zeros(2), np.full(2, 10.0))
    assert done and np.allclose(fitted, [3, 1.3], atol=1e-5) and cost < 1e-9


def test_varpro_recovers():
    e = np.linspace(95, 107, 200)
    y = 2 * kernels.voigt(e, 99.4, 0.5, 0.1) + kernels.voigt(e, 103.1, 0.7, 0.1)
    got = kernels.varpro(e, y, [99.2, 103.3], [0.6, 0.6], 0.1)
    assert np.allclose(got["centers"], [99.4, 103.1], atol=1e-4) and np.allclose(got["sigmas"], [0.5, 0.7], atol=1e-3)
    assert np.allclose(got["amplitudes"], [2, 1], atol=1e-3) and got["chi2"] < 1e-10


def spectra_frame(spark, n=6):
    e = np.linspace(96, 106, 128)
    rows = []
    for k in range(n):
        rng = np.random.default_rng(k)
        rows.append((k, e.tolist(), (40 + e + 300 * kernels.voigt(e, 99.3, 0.45, 0.1) + 200 * kernels.voigt(e, 103.4, 0.6, 0.1) + rng.normal(0, 0.5, 128)).tolist()))
    return spark.createDataFrame(rows, "spectrum_id long, energy array<double>, intensity array<double>")


def test_auto_fit_and_model_order(spark):
    df = spectra_frame(spark, 3)
    for r in analyse.auto_fit(df, "linear").collect():
        assert r["n_components"] == 2 and np.allclose(r["centers"], [99.3, 103.4], atol=0.05) and r["r2"] > 0.99
    net = background.subtract(df, "linear").select("spectrum_id", "energy", F.col("net").alias("intensity"))
    assert {r["k"] for r in analyse.verdicts(analyse.exact_k(net, 3, 2)).collect()} <= {2, 3}


def test_fermi_edge(spark):
    e = np.linspace(-1, 1, 120)
    y = 5 + (100 + 10 * (e - 0.05)) / (1 + np.exp((e - 0.05) / (8.617333262e-5 * 300)))
    df = spark.createDataFrame([(1, e.tolist(), y.tolist())], "spectrum_id long, energy array<double>, intensity array<double>")
    r = analyse.fermi_edge(df).first()
    assert r["edge"] == pytest.approx(0.05, abs=0.005)


def test_identifiability_labels(spark):
    p = spark.createDataFrame([(1, 1e6, 0.0, 0.5, 0.3), (2, 20.0, 0.0, 0.5, 0.3), (3, 1e6, 0.0, 0.5, 0.0)], "spectrum_id long, area double, center double, sigma double, gamma double")
    got = {r["spectrum_id"]: r for r in analyse.identifiability(p, ENERGY).collect()}
    assert got[1]["label"] == "identified" and got[2]["label"] != "identified" and got[3]["label"] == "near_boundary"


def test_bootstrap_and_quantiles(spark):
    df = spectra_frame(spark, 2)
    draws = analyse.bootstrap(df, lambda e, y: y.sum(), 300)
    q = {r["spectrum_id"]: r["quantile"] for r in quantify.weibull_quantile(draws, "value", 0.5, ["spectrum_id"]).collect()}
    sums = {r["spectrum_id"]: sum(r["intensity"]) for r in df.collect()}
    assert all(abs(q[k] - sums[k]) < 4 * math.sqrt(sums[k]) for k in q)


def test_goldens(spark):
    one = spark.range(1)
    assert one.select(F.round(physics.imfp_tpp2m(1386.6, 16.0, 2.2, 60.08, 8.9), 2)).first()[0] == 3.88
    assert one.select(physics.imfp_tpp2m(-1.0, 16.0, 2.2, 60.08, 8.9)).first()[0] is None
    assert one.select(lineshape.voigt_width(0.0, 1.0)).first()[0] == pytest.approx(1.0, abs=1e-3)
    e = F.array(*[F.lit(float(x)) for x in (3, 2, 1)])
    i = F.array(*[F.lit(float(x)) for x in (1, 2, 4)])
    r = one.select(axis.trapezoid(e, i).alias("t"), axis.ascending(i, e).alias("a"), axis.valid(e, i).alias("v"), axis.normalise(i, "area", e).alias("n"), axis.other_axis(e, 10.0).alias("k")).first()
    assert (r["t"], r["a"], r["v"], r["k"]) == (-4.5, [4, 2, 1], True, [7, 8, 9]) and r["n"][0] == pytest.approx(1 / 4.5)
    with pytest.raises(Exception, match="photon energy"):
        one.select(axis.other_axis(e, F.lit(None).cast("double"))).collect()
    names = spark.createDataFrame([("Si2p3/2",), ("C1s",), ("x",)], "n string")
    assert [tuple(r) for r in names.select(axis.element_of(F.col("n")), axis.orbital_of(F.col("n"))).collect()] == [("Si", "2p3/2"), ("C", "1s"), ("", "")]
    assert [r[0] for r in spark.createDataFrame([("2p",), ("1s",), ("4f5/2",)], "o string").select(axis.main_orbital(F.col("o"))).collect()] == ["2p3/2", "1s", "4f5/2"]


def test_composition(spark):
    rows = [("a", "Si", 10.0, 2.0, 1.0), ("a", "O", 20.0, 4.0, 1.0), ("b", "Si", -1.0, 2.0, 1.0), ("b", "O", 1.0, None, 1.0), ("c", "C", 1.0, 1.0, 1.0), ("c", "C", 1.0, 1.0, 1.0)]
    got = quantify.composition(spark.createDataFrame(rows, "sample string, element string, area double, cross_section double, imfp double")).collect()
    by = {(r["sample"], r["element"]): r for r in got}
    assert by["a", "Si"]["fraction"] == 0.5 and by["a", "Si"]["status"] == "inputs_stated"
    assert by["b", "O"]["status"] == "refused" and by["b", "O"]["reasons"] == ["O: no cross-section", "Si: net area is not positive"]
    assert by["c", "C"]["status"] == "refused"


def test_joins(spark):
    a = spark.createDataFrame([(k,) for k in (5, 20, 35)], "i long")
    cache = spark.createDataFrame([(k,) for k in (4, 6, 5, 33, 50)], "c long")
    assert {r["i"]: r["inherited_from"] for r in relate.nearest(a, cache, "i", "c").collect()} == {5: 6, 20: None, 35: 33}
    table = spark.createDataFrame([("x", float(g), float(g * g)) for g in range(1, 8)], "line string, energy double, cross_section double")
    rows = spark.createDataFrame([("x", 2.5), ("x", 0.5), ("x", 70.0), ("y", 1.0)], "line string, photon_energy double")
    got = {(r["line"], r["photon_energy"]): r for r in analyse.cross_section(rows, table, ["line"]).collect()}
    assert got["x", 2.5]["value"] == pytest.approx(6.25) and got["x", 70.0]["value"] == pytest.approx(4900) and got["x", 70.0]["status"] == "extrapolated_above"
    assert got["x", 0.5]["status"] == "outside_range_below" and got["y", 1.0]["status"] == "not_in_table"
    numbered = {r["i"]: r["__number"] for r in ordered.numbered(spark.range(1000).select((F.col("id") * 3).alias("i")), "i").collect()}
    assert numbered == {3 * k: k for k in range(1000)}


def vamas(blocks=1, points=5, technique="XPS"):
    head = ["VAMAS Surface Chemical Analysis Standard Data Transfer Format 1988 May 4", "a", "b", "c", "d", "1", "note", "NORM", "REGULAR", "0", "1", "Exp Variable 1", "d", "0", "0", "0", "0", str(blocks)]
    out = list(head)
    for b in range(blocks):
        out += [f"C 1s/{b}", "sample", "2026", "1", "15", "10", "30", "0", "0", "0", technique, "0", "Al", "1486.6", "1e+037", "1e+037", "1e+037", "1e+037", "1e+037", "FAT", "50"]
        out += ["1e+037", "1e+037", "0", "0", "0", "0", "0", "C", "", "-1", "Kinetic Energy", "eV", "1186.6", "0.1", "2", "Counts", "d", "Transmission", "d"]
        out += ["pulse counting", "0.05", "4", "0", "0", "0", "0", "0", str(2 * points), "0", "1", "0", "1"]
        for k in range(points):
            out += [str(1000 + 10.5 * k), "0.9"]
    return ("\r\n".join([*out, "end of experiment"]) + "\r\n").encode()


def igor_v5(values, notes):
    head = bytearray(384)
    struct.pack_into("<h", head, 0, 5)
    struct.pack_into("<i", head, 12, len(notes))
    struct.pack_into("<H", head, 80, 2)
    struct.pack_into("<4i", head, 132, *([*values.shape, 0, 0, 0, 0][:4]))
    struct.pack_into("<4d", head, 148, 0.05, 1, 0, 0)
    struct.pack_into("<4d", head, 180, 100.0, 0, 0, 0)
    return bytes(head) + values.astype("<f4").tobytes(order="F") + notes


def test_instrument_files(spark, tmp_path):
    (tmp_path / "a.vms").write_bytes(vamas(2))
    (tmp_path / "b.vms").write_bytes(vamas(1, technique="UPS"))
    (tmp_path / "c.vms").write_bytes(vamas()[:300])
    (tmp_path / "d.ibw").write_bytes(igor_v5(np.arange(12.0).reshape(4, 3), b"Region Name=Au4f\rExcitation Energy=21.2\rUser=secret\r"))
    packed = bytearray(392)
    struct.pack_into("<h", packed, 0, 3)
    struct.pack_into("<H", packed, 88, 2)
    struct.pack_into("<4i", packed, 140, 3, 0, 0, 0)
    struct.pack_into("<4d", packed, 156, 0.5, 0, 0, 0)
    wave = bytes(packed) + np.array([1, 2, 4], dtype="<f4").tobytes()
    (tmp_path / "e.pxt").write_bytes(struct.pack("<HHI", 3, 5, len(wave)) + wave + struct.pack("<HHI", 0, 0, 0))
    ses = "[Info]\nNumber of Regions=1\n\n[Region 1]\nDimension 1 scale=1 2 3\nDimension 2 scale=0 1\n[Info 1]\nRegion Name=Si2p\nEnergy Scale=Binding\nExcitation Energy=none\n[Data 1]\n1 10 20\n2 11 21\n3 12 22\n"
    (tmp_path / "f.txt").write_text(ses)
    (tmp_path / "g.txt").write_text("# x\n1.0\t5\n2.0\t6\n3.0\t7\n")
    npl = ["x"] * 14 + ["0"] * 31 + ["0"] * 19 + ["500", "505", "510"]
    npl[7], npl[14 + 14], npl[14 + 29], npl[14 + 30] = "1", "1486.6", "Au4f", "1"
    npl[45 + 1], npl[45 + 3], npl[45 + 4], npl[45 + 5], npl[45 + 16] = "kinetic energy", "1100.0", "-0.1", "1", "3"
    (tmp_path / "h.npl").write_text("\n".join(npl) + "\n")
    (tmp_path / "i.bin").write_bytes(b"?")
    got = {}
    for r in instruments.read_spectra(spark, str(tmp_path)).collect():
        got.setdefault(r["file"].rsplit("/", 1)[-1], []).append(r)
    assert len(got["a.vms"]) == 2 and got["a.vms"][0]["intensity"] == [1000 + 10.5 * k for k in range(5)]
    assert got["a.vms"][0]["metadata"]["source_energy"] == "1486.6" and "work_function" not in got["a.vms"][0]["metadata"]
    assert "not XPS" in got["b.vms"][0]["problem"] and "ends" in got["c.vms"][0]["problem"] and "not known" in got["i.bin"][0]["problem"]
    assert len(got["d.ibw"]) == 3 and got["d.ibw"][1]["intensity"] == [1.0, 4.0, 7.0, 10.0] and got["d.ibw"][0]["energy"][1] == pytest.approx(100.05)
    assert got["d.ibw"][0]["name"] == "Au4f" and "User" not in got["d.ibw"][0]["metadata"]
    assert got["e.pxt"][0]["intensity"] == [1, 2, 4] and got["f.txt"][1]["intensity"] == [20, 21, 22] and got["f.txt"][0]["energy_type"] == "BE"
    assert "source_energy" not in got["f.txt"][0]["metadata"] and got["g.txt"][0]["energy"] == [1, 2, 3]
    assert got["h.npl"][0]["energy"][2] == pytest.approx(1099.8)
    summed = instruments.ingest(instruments.read_spectra(spark, str(tmp_path / "d.ibw")), integrate=True, to="BE").collect()
    assert summed[0]["intensity"] == [3, 12, 21, 30] and summed[0]["energy"][0] == pytest.approx(21.2 - 100)


def test_reference_tables(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"Si": {"2p": {"1000": 1.5, "2000": null}}}')
    assert [tuple(r) for r in tables.read_nested_json(spark, str(tmp_path / "t.json")).orderBy("energy").collect()] == [("Si", "2p", 1000.0, 1.5), ("Si", "2p", 2000.0, None)]
    (tmp_path / "p.par").write_text("# h\nSi | 2p | 99.4\nbad\n")
    assert [tuple(r) for r in tables.read_pipe_table(spark, str(tmp_path / "p.par"), ["e", "o", "b"]).collect()] == [("Si", "2p", "99.4", None), (None, None, None, "1 cells instead of 3: bad")]
    (tmp_path / "Slit0p5_spot1x0p3.tsv").write_text("ratio\tT\n1.0\t2.5\n")
    assert tuple(tables.read_transmission(spark, str(tmp_path / "Slit0p5_spot1x0p3.tsv")).first()) == (1.0, 2.5, 0.5, "1x0p3")
    tables.write_results(spark.range(100).withColumnRenamed("id", "spectrum_id"), str(tmp_path / "r"))
    assert [r[0] for r in tables.read_range(spark, str(tmp_path / "r"), 10, 20, step=5).orderBy("spectrum_id").collect()] == [10, 15]


def test_stream_fit(spark, tmp_path):
    truth = spark.range(30).select(F.col("id").alias("spectrum_id"), F.array(F.lit(1.0)).alias("amplitudes"), F.lit(0.1).alias("shift"), F.lit(0.0).alias("width"))
    y = synthetic.generate(truth, ONE, noise=0.01).select("spectrum_id", "intensity")
    paths = [str(tmp_path / x) for x in ("in", "out", "check")]
    y.filter("spectrum_id < 20").repartition(3).write.parquet(paths[0])
    fits.stream_fit(spark, *paths, ONE, files_per_batch=2).awaitTermination()
    assert spark.read.parquet(paths[1]).count() == 20
    y.filter("spectrum_id >= 20").coalesce(1).write.mode("append").parquet(paths[0])
    assert fits.missing_fits(y, spark.read.parquet(paths[1])).count() == 10
    fits.stream_fit(spark, *paths, ONE).awaitTermination()
    out = spark.read.parquet(paths[1])
    assert out.count() == 30 and fits.running_summary(out).first()["n"] == 30
