"""Queries of the solvers on spectra of 31 channels, one for each part, and SQL that solves them by itself.

The SQL is given the dictionary's profiles and derivatives as numbers and does all the rest: projections,
best cells, steps, thresholds and merges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineshed.operators import background, fit, kernels, refine
from lineshed.operators.kernels import Peaks
from lineshed.plans.registry import query
from lineshed.session import read

ENERGY = np.linspace(-3.0, 3.0, 31)
ONE = Peaks(ENERGY, (0.0,), (0.5,), 0.2, n_shift=9, n_width=3)
PAIR = [Peaks(ENERGY, (c,), (s,), 0.2, n_shift=7, n_width=3) for c, s in ((-0.9, 0.4), (0.9, 0.5))]
GAMMAS = np.linspace(-0.1, 0.1, 5)
#: What the spectra are made of: a peak off the grid, a little noise, and in each 40th a second peak.
TRUTH = [ONE.basis(s, w)[0][:, 0] for s in np.linspace(-0.27, 0.27, 11) for w in (-0.06, 0.01, 0.07)]
SECOND = kernels.voigt(ENERGY, 1.1, 0.4, 0.2)


def _literal(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def spectra(spark: SparkSession, d: str, pair: bool = False) -> DataFrame:
    """(spectrum_id, intensity). pair: the second peak is in all, at 0.9."""
    k = F.col("p_partkey")
    truth = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in TRUTH])
    second = F.array(*[F.lit(float(v)) for v in SECOND])
    amplitude = 0.5 + (k % 1000) / 1000.0
    more = 0.4 + (k % 7) / 10.0 if pair else F.when(k % 40 == 0, 0.15).otherwise(0.0)
    noise = lambda j: 0.02 * ((k * 7919 + j * 104729) % 2003 / 2003.0 - 0.5)
    at = lambda table, j: F.element_at(table, (j + 1).cast("int"))
    y = F.transform(F.element_at(truth, (k % len(TRUTH) + 1).cast("int")), lambda v, j: amplitude * v + more * at(second, j) + noise(j))
    return read(spark, d, "part").select(k.alias("spectrum_id"), y.alias("intensity"))


def _rows(pair: bool = False) -> str:
    more = "0.4::DOUBLE + (p_partkey % 7) / 10.0::DOUBLE" if pair else "CASE WHEN p_partkey % 40 = 0 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END"
    truth = "[" + ", ".join(_literal(row) for row in TRUTH) + "]"
    return f"""t AS (SELECT {truth} AS truth, {_literal(SECOND)} AS second),
y AS (SELECT p_partkey AS id, list_transform(truth[p_partkey % {len(TRUTH)} + 1], lambda v, i: (0.5::DOUBLE + (p_partkey % 1000) / 1000.0::DOUBLE) * v + ({more}) * second[i]
  + 0.02::DOUBLE * ((p_partkey * 7919 + (i - 1) * 104729) % 2003 / 2003.0::DOUBLE - 0.5::DOUBLE)) AS y FROM part, t)"""


def _cells(peaks: Peaks, name: str = "cells", gammas=(0.0,)) -> str:
    """The dictionary as a table: cell, its shift and width, unit profile, profile, weights, derivatives, coupling."""
    rows = []
    for g, gamma in enumerate(gammas):
        d = kernels.build_dictionary(peaks, gamma)
        for cell in range(d.columns.shape[1]):
            i, j = divmod(cell, len(d.widths))
            h = peaks.curvature(d.shifts[i], d.widths[j], gamma)[:, 0]
            lists = ", ".join(_literal(v) for v in (d.columns[:, cell], d.profiles[cell, :, 0], d.weights[cell, 0], d.by_center[cell, :, 0], d.by_sigma[cell, :, 0], h))
            rows.append(f"({g}, {cell}, {i}, {j}, {float(d.shifts[i])!r}::DOUBLE, {float(d.widths[j])!r}::DOUBLE, {lists}, {float(d.coupling[cell][0, 0])!r}::DOUBLE)")
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(rows)}) v(g, cell, i, j, cs, cw, col, phi, wt, bc, bs, hc, pull))"


N_WIDTH = len(kernels.build_dictionary(ONE).widths)
NOMINAL = kernels.build_dictionary(ONE).nominal
_SCORED = "s AS (SELECT id, g, cell, list_dot_product(y, col) AS score FROM y, cells)"
_BEST = "best AS (SELECT id, arg_max(cell, (score, -cell)) AS cell, max(score) AS top FROM s GROUP BY id)"


def _steps(name: str, cell: str, six: bool = False) -> str:
    """Four or six steps at the cells that `cell` (id, cell) names: amplitude, amplitude at the cell, shift, width, chi2."""
    bend = " - 0.5::DOUBLE * shift * shift * a * a * list_dot_product(hc, bs)" if six else ""
    return f"""{name}_a AS (SELECT y.id, y.y, c.*, list_dot_product(y.y, wt) AS a FROM y JOIN {cell} b ON b.id = y.id JOIN cells c ON c.cell = b.cell),
{name}_r AS (SELECT *, list_transform(y, lambda v, i: v - a * phi[i]) AS r FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN a * a * list_dot_product(bc, bc) > 1e-20 THEN a * list_dot_product(r, bc) / (a * a * list_dot_product(bc, bc)) ELSE 0 END AS shift FROM {name}_r),
{name}_w AS (SELECT *, CASE WHEN a * a * list_dot_product(bs, bs) > 1e-20 THEN (a * list_dot_product(r, bs) - shift * a * a * list_dot_product(bc, bs){bend}) / (a * a * list_dot_product(bs, bs)) ELSE 0 END AS width FROM {name}_c),
{name} AS (SELECT id, a / (CASE WHEN abs(1 + width * pull) > 1e-6 THEN 1 + width * pull ELSE 1 END) AS amplitude, a AS plain, cs + shift AS shift, cw + width AS width, cs, cw, list_dot_product(r, r) / {len(ENERGY)} AS chi2, list_max(y) AS top FROM {name}_w)"""


_NOMINAL = f"nominal AS (SELECT id, {NOMINAL} AS cell FROM y)"
_OUT = "round(amplitude, 6) AS amplitude, round(shift, 6) AS shift, round(width, 6) AS width, round(chi2, 9) AS chi2"


def rounded(df: DataFrame, *more) -> DataFrame:
    return df.select("spectrum_id", F.round(F.col("amplitudes")[0], 6).alias("amplitude"), F.round("shift", 6).alias("shift"), F.round("width", 6).alias("width"), F.round("chi2", 9).alias("chi2"), *more)


_FLAGS = """m AS (SELECT median(chi2) AS center FROM {0}), mad AS (SELECT any_value(center) AS center, median(abs(chi2 - center)) AS mad FROM {0}, m),
flagged AS (SELECT f.*, mad >= 1e-10 AND chi2 > center + 3 * 1.4826 * mad AS is_anomaly FROM {0} f, mad)"""


@query(f"""WITH {_rows()}, {_cells(ONE)}, {_NOMINAL}, {_steps("f", "nominal")}, {_FLAGS.format("f")}
SELECT id AS spectrum_id, round(plain, 6) AS amplitude, 0.0::DOUBLE AS shift, 0.0::DOUBLE AS width, round(chi2, 9) AS chi2, is_anomaly FROM flagged""")
def voigt_fit_amp(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fit.flag_anomalies(fit.materialize(fit.fit(spectra(spark, d), ONE, "preview"), "fitted")), "is_anomaly")


@query(f"WITH {_rows()}, {_cells(ONE)}, {_NOMINAL}, {_steps('f', 'nominal')} SELECT id AS spectrum_id, {_OUT} FROM f")
def four_step_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fit.fit(spectra(spark, d), ONE, "fast"))


@query(f"WITH {_rows()}, {_cells(ONE)}, {_SCORED}, {_BEST}, {_steps('f', 'best')} SELECT id AS spectrum_id, round(plain, 6) AS amplitude, round(cs, 6) AS shift, round(cw, 6) AS width, round(chi2, 9) AS chi2 FROM f")
def dict2d_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fit.fit(spectra(spark, d), ONE, "dictionary"))


_STEP = {"i": float(np.diff(kernels.build_dictionary(ONE).shifts)[0]), "j": float(np.diff(kernels.build_dictionary(ONE).widths)[0])}
_LAST = {"i": ONE.n_shift - 1, "j": N_WIDTH - 1}


def _vertex(axis: str, step: int) -> str:
    """How far the parabola's top lies from the best cell along an axis."""
    den = f"(2 * (2 * b.top - l{axis}.score - r{axis}.score))"
    inner = f"CASE WHEN abs({den}) > 1e-30 THEN (r{axis}.score - l{axis}.score) / {den} ELSE 0 END"
    return f"CASE WHEN c.{axis} > 0 AND c.{axis} < {_LAST[axis]} THEN least(greatest({inner}, -0.5), 0.5) * {_STEP[axis]!r}::DOUBLE ELSE 0 END"


@query(f"""WITH {_rows()}, {_cells(ONE)}, {_SCORED}, {_BEST}, {_steps("f", "best")},
v AS (SELECT b.id, {_vertex("i", N_WIDTH)} AS di, {_vertex("j", 1)} AS dj FROM best b JOIN cells c ON c.cell = b.cell
  LEFT JOIN s li ON li.id = b.id AND li.cell = b.cell - {N_WIDTH} LEFT JOIN s ri ON ri.id = b.id AND ri.cell = b.cell + {N_WIDTH}
  LEFT JOIN s lj ON lj.id = b.id AND lj.cell = b.cell - 1 LEFT JOIN s rj ON rj.id = b.id AND rj.cell = b.cell + 1)
SELECT f.id AS spectrum_id, round(plain, 6) AS amplitude, round(cs + di, 6) AS shift, round(cw + dj, 6) AS width, round(chi2, 9) AS chi2 FROM f JOIN v ON v.id = f.id""")
def dict2d_parabola_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fit.fit(spectra(spark, d), ONE, "balanced"))


@query(f"WITH {_rows()}, {_cells(ONE)}, {_SCORED}, {_BEST}, {_steps('f', 'best')} SELECT id AS spectrum_id, {_OUT} FROM f")
def dict2d_hybrid_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fit.fit(spectra(spark, d), ONE, "precise"))


@query(f"WITH {_rows()}, {_cells(ONE)}, {_SCORED}, {_BEST}, {_steps('f', 'best', six=True)} SELECT id AS spectrum_id, {_OUT} FROM f")
def six_step_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(refine.fit_six_step(spectra(spark, d), ONE))


@query(f"""WITH {_rows()}, {_cells(ONE)}, {_SCORED}, {_BEST},
near AS (SELECT id, CASE WHEN abs(cs) / 0.5 < 0.35 AND abs(cw) / 0.5 < 0.35 THEN {NOMINAL} ELSE b.cell END AS cell FROM best b JOIN cells c ON c.cell = b.cell),
{_steps("f", "near")} SELECT id AS spectrum_id, {_OUT} FROM f""")
def adaptive_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fit.fit(spectra(spark, d), ONE, "adaptive"))


@query(f"""WITH {_rows()}, {_cells(ONE)}, {_SCORED}, {_BEST}, {_steps("f", "best")}
SELECT id AS spectrum_id, round(CASE WHEN clean THEN amplitude ELSE plain END, 6) AS amplitude, round(CASE WHEN clean THEN shift ELSE cs END, 6) AS shift,
  round(CASE WHEN clean THEN width ELSE cw END, 6) AS width, round(chi2, 9) AS chi2 FROM (SELECT *, chi2 < 3e-4 * (top * top + 1e-20) AS clean FROM f)""")
def dict2d_adaptive_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fit.fit(spectra(spark, d), ONE, "clean"))


@query(f"""WITH {_rows()}, {_cells(ONE, gammas=GAMMAS)}, {_SCORED},
per AS (SELECT id, g, arg_max(cell, (score, -cell)) AS cell, max(score) AS top FROM s GROUP BY id, g),
best AS (SELECT id, arg_max(g, (top, -g)) AS g, arg_max(cell, (top, -g)) AS cell, max(top) AS top FROM per GROUP BY id),
n AS (SELECT b.*, l.top AS lt, r.top AS rt FROM best b LEFT JOIN per l ON l.id = b.id AND l.g = b.g - 1 LEFT JOIN per r ON r.id = b.id AND r.g = b.g + 1)
SELECT n.id AS spectrum_id, round(list_dot_product(y, wt), 6) AS amplitude,
  round(({_literal(GAMMAS)})[n.g + 1] + CASE WHEN lt IS NULL OR rt IS NULL OR abs(2 * (2 * n.top - lt - rt)) <= 1e-30 THEN 0 ELSE least(greatest((rt - lt) / (2 * (2 * n.top - lt - rt)), -0.5), 0.5) * {float(GAMMAS[1] - GAMMAS[0])!r}::DOUBLE END, 6) AS delta_gamma
FROM n JOIN y ON y.id = n.id JOIN cells c ON c.cell = n.cell AND c.g = n.g""")
def dict3d_fit(spark: SparkSession, d: str) -> DataFrame:
    got = refine.fit_gamma(spectra(spark, d), ONE, GAMMAS)
    return got.select("spectrum_id", F.round(F.col("amplitudes")[0], 6).alias("amplitude"), F.round("delta_gamma", 6).alias("delta_gamma"))


_UNIT = float(kernels.voigt(np.zeros(1), 0.0, 0.5, 0.2)[0])


@query(f"""WITH {_rows()}, {_cells(ONE)}, {_NOMINAL}, {_SCORED}, {_BEST}, {_steps("f", "nominal")}, {_steps("p", "best")}, {_FLAGS.format("f")},
merged AS (SELECT f.id, is_anomaly, CASE WHEN is_anomaly THEN p.amplitude ELSE f.amplitude END AS amplitude, CASE WHEN is_anomaly THEN p.shift ELSE f.shift END AS shift,
  CASE WHEN is_anomaly THEN p.width ELSE f.width END AS width, CASE WHEN is_anomaly THEN p.chi2 ELSE f.chi2 END AS chi2 FROM flagged f JOIN p ON p.id = f.id)
SELECT id AS spectrum_id, 0::INT AS comp, round(amplitude * {_UNIT!r}::DOUBLE, 6) AS height, round(shift, 6) AS center, round((0.5 + width) * {kernels.FWHM_PER_SIGMA!r}::DOUBLE, 6) AS fwhm_g,
  0.4::DOUBLE AS fwhm_l, round(amplitude, 6) AS area, round(chi2, 9) AS chi2 FROM merged""")
def hybrid_pipeline(spark: SparkSession, d: str) -> DataFrame:
    rows = fit.to_components(fit.hybrid(spectra(spark, d), ONE), ONE)
    return rows.select("spectrum_id", "comp", *[F.round(c, 6).alias(c) for c in ("height", "center", "fwhm_g", "fwhm_l", "area")], F.round("chi2", 9).alias("chi2"))


def _multipeak() -> str:
    """One round of alternating projections over two components."""
    d = [kernels.build_dictionary(p) for p in PAIR]

    def joint(name: str, source: str) -> str:
        return f"""{name} AS (SELECT id, y, c0, c1, (g11 * r0 - g01 * r1) / (g00 * g11 - g01 * g01) AS a0, (g00 * r1 - g01 * r0) / (g00 * g11 - g01 * g01) AS a1, p0, p1 FROM
  (SELECT b.*, p.phi AS p0, q.phi AS p1, list_dot_product(p.phi, p.phi) + 1e-8 AS g00, list_dot_product(q.phi, q.phi) + 1e-8 AS g11, list_dot_product(p.phi, q.phi) AS g01,
    list_dot_product(p.phi, y) AS r0, list_dot_product(q.phi, y) AS r1 FROM {source} b JOIN first p ON p.cell = b.c0 JOIN second_ q ON q.cell = b.c1))"""

    def match(name: str, source: str, own: int) -> str:
        other, table = 1 - own, ("first", "second_")[own]
        kept = f"any_value(c{other}) AS c{other}"
        return f"""{name}_l AS (SELECT id, y, c0, c1, list_transform(y, lambda v, i: v - a{other} * p{other}[i]) AS rest FROM {source}),
{name} AS (SELECT id, any_value(y) AS y, arg_max(cell, (list_dot_product(rest, col), -cell)) AS c{own}, {kept} FROM {name}_l, {table} GROUP BY id)"""

    return f"""WITH {_rows(True)}, {_cells(PAIR[0], "first")}, {_cells(PAIR[1], "second_")},
start AS (SELECT id, y, {d[0].nominal} AS c0, {d[1].nominal} AS c1 FROM y), {joint("j0", "start")}, {match("m0", "j0", 0)}, {joint("j1", "m0")}, {match("m1", "j1", 1)}, {joint("j2", "m1")}
SELECT id AS spectrum_id, round(a0, 6) AS a0, round(a1, 6) AS a1, round(list_sum(list_transform(y, lambda v, i: pow(v - a0 * p0[i] - a1 * p1[i], 2))) / {len(ENERGY)}, 9) AS chi2 FROM j2"""


@query(_multipeak())
def multipeak_fit(spark: SparkSession, d: str) -> DataFrame:
    got = fit.fit_multipeak(spectra(spark, d, pair=True), PAIR, rounds=1)
    return got.select("spectrum_id", *[F.round(F.col("amplitudes")[k], 6).alias(f"a{k}") for k in range(2)], F.round("chi2", 9).alias("chi2"))


_N = len(ENERGY)
_TILTED = f"{_rows()}, b AS (SELECT id, list_transform(y, lambda v, i: v + 0.02::DOUBLE * (i - 1)) AS y FROM y)"


def tilted(spark: SparkSession, d: str) -> DataFrame:
    """The spectra over a rising base, with their axis."""
    y = F.transform("intensity", lambda v, i: v + 0.02 * i)
    return spectra(spark, d).select("spectrum_id", F.array(*[F.lit(float(e)) for e in ENERGY]).alias("energy"), y.alias("intensity"))


def _points(df: DataFrame) -> DataFrame:
    return df.select("spectrum_id", F.posexplode("background").alias("k", "x")).select("spectrum_id", "k", F.round("x", 6).alias("background"))


@query(f"""WITH RECURSIVE {_TILTED},
s AS (SELECT id, y, list_transform(y, lambda v: 0.0::DOUBLE) AS b, 0 AS n, false AS done FROM b
  UNION ALL SELECT id, y, new, n + 1, list_max(list_transform(new, lambda v, i: abs(v - b[i]))) < 1e-5
  FROM (SELECT id, y, b, n, list_transform(run, lambda v: y[1] + (y[{_N}] - y[1]) * v / run[{_N}]) AS new
    FROM (SELECT id, y, b, n, list_transform(y, lambda v, i: list_sum(list_transform(y[1:i], lambda w, j: w - b[j]))) AS run FROM s WHERE NOT done AND n < 50))),
f AS (SELECT id, arg_max(b, n) AS b FROM s GROUP BY id)
SELECT id AS spectrum_id, generate_subscripts(b, 1)::INT - 1 AS k, round(unnest(b), 6) AS background FROM f""")
def shirley_background(spark: SparkSession, d: str) -> DataFrame:
    return _points(background.subtract(tilted(spark, d), "shirley"))


_M = _N // 10


@query(f"""WITH {_TILTED},
m AS (SELECT id, y, list_sum(y[1:{_M}]) / {_M} AS first, list_sum(y[{_N - _M + 1}:{_N}]) / {_M} AS last FROM b),
s AS (SELECT id, least(first, last) AS low, CASE WHEN last >= first THEN list_transform(y, lambda v: v - least(first, last)) ELSE list_reverse(list_transform(y, lambda v: v - least(first, last))) END AS x, last < first AS turned FROM m),
l AS (SELECT *, list_transform(x, lambda v, k: list_sum(list_transform(x[1:k], lambda w, j: w * ((k - j) * 0.2::DOUBLE) / pow(1643 + pow((k - j) * 0.2::DOUBLE, 2), 2)))) AS loss FROM s),
f AS (SELECT id, list_transform(loss, lambda v: low + v * list_sum(x[{_N - _M + 1}:{_N}]) / list_sum(loss[{_N - _M + 1}:{_N}])) AS b, turned FROM l),
o AS (SELECT id, CASE WHEN turned THEN list_reverse(b) ELSE b END AS b FROM f)
SELECT id AS spectrum_id, generate_subscripts(b, 1)::INT - 1 AS k, round(unnest(b), 6) AS background FROM o""")
def tougaard_background(spark: SparkSession, d: str) -> DataFrame:
    return _points(background.subtract(tilted(spark, d), "tougaard"))
