"""JSON tasks, the command line, edges and fits in order."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineshed import tools
from lineshed.__main__ import main
from lineshed.operators import analyse, kernels
from lineshed.operators.kernels import Peaks


def test_tools(spark, tmp_path, capsys):
    table = spark.createDataFrame([("Si", "2p3/2", 99.4), ("Si", "2p1/2", 100.0)], "element string, orbital string, binding_energy double")
    assert json.loads(tools.lookup_binding_energy(table, "Si", "2p")) == [{"element": "Si", "orbital": "2p3/2", "binding_energy": 99.4}]
    s = json.loads(tools.sensitivity(spark, 2.0, 1386.6, 16.0, 2.2, 60.08, 8.9))[0]
    assert s["sensitivity"] == pytest.approx(2 * s["imfp_nm"]) and s["imfp_range"] == "inside"
    e = np.linspace(96, 106, 160)
    y = 30 + 400 * kernels.voigt(e, 101, 0.5, 0.1)
    (tmp_path / "a.txt").write_text("# e i\n" + "\n".join(f"{a:.5f}\t{b:.6f}" for a, b in zip(e, y)) + "\n")
    fitted = json.loads(tools.fit_file(spark, str(tmp_path / "a.txt"), "linear"))[0]
    assert fitted["n_components"] == 1 and fitted["centers"][0] == pytest.approx(101, abs=0.01)
    pixels = spark.range(50).select(F.col("id").alias("spectrum_id"), *[F.lit(100 + k).alias(c) for k, c in enumerate("rgb")])
    levels = json.loads(tools.round_trip(pixels, Peaks(np.linspace(-3, 3, 151), (0.0,), (0.5,), 0.2), levels=(None, 1e6)))
    assert float(levels[0]["psnr_r"]) >= float(levels[1]["psnr_r"]) > 30  # infinite without an error
    assert main(["import", str(tmp_path / "a.txt"), str(tmp_path / "out")]) == 0 and spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert main(["templates"]) == 0 and "Si2p_oxide" in capsys.readouterr().out


def test_edges(spark):
    e = np.linspace(-1, 1, 120)
    rows = [(k, e.tolist(), (5 + 100 / (1 + np.exp((e - x) / (8.617333262e-5 * 300)))).tolist()) for k, x in ((1, 0.05), (2, 0.12))]
    df = spark.createDataFrame(rows, "spectrum_id long, energy array<double>, intensity array<double>")
    got = {r["spectrum_id"]: r["delta"] for r in analyse.differential_edge(df, 1).collect()}
    assert got[1] == 0 and got[2] == pytest.approx(0.07, abs=0.002)
    assert analyse.detect_convention(e, np.array(rows[0][2])) == "KE" and analyse.detect_convention(-e, np.array(rows[0][2])) == "BE"
    assert df.select(analyse.edge_axis(F.col("energy"), F.lit(0.5))[0]).first()[0] == 1.5


def test_fit_in_order(spark):
    e = np.linspace(-3, 3, 120)
    rows = [(k, k, e.tolist(), (5 * kernels.voigt(e, 0.02 * k, 0.4, 0.1)).tolist()) for k in range(12)]
    df = spark.createDataFrame(rows, "spectrum_id long, i long, energy array<double>, intensity array<double>")
    got = {r["spectrum_id"]: r for r in analyse.fit_in_order(df, "i", 6, [0.0], 0.4).collect()}
    assert all(abs(got[k]["centers"][0] - 0.02 * k) < 1e-3 for k in got) and got[0]["inherited_from"] is None and got[6]["inherited_from"] is None and got[4]["inherited_from"] == 3
    assert math.isclose(got[5]["areas"][0], 5, rel_tol=1e-2)
