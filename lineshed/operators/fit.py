"""Peak fits of many spectra: the dictionary is built on the driver, Arrow batches are solved by matrix products.

A dictionary's size depends on the grid and the axis only, never on how many spectra there are; it is
checked against `MOST_CELLS` before it is sent to the workers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineshed.operators import kernels, robust
from lineshed.operators.kernels import Dictionary, Peaks
from lineshed.session import materialize

MOST_CELLS = 20_000_000
ROWS = 2048  # spectra solved at a time, so that their scores stay near the processor
MODES = {"preview": "amp_only", "fast": "four_step", "balanced": "parabola", "precise": "hybrid", "gamma_calibrated": "gamma", "adaptive": "taylor"}
#: What the modes ask of the dictionary solver.
REFINEMENTS = {"hybrid": "four_step", "dictionary": "none", "six_step": "six_step", "taylor": "taylor", "clean": "clean"}
FIT_FIELDS = "amplitudes array<double>, shift double, width double, chi2 double"


def _matrix(column: pa.ChunkedArray | pa.Array, n_energy: int) -> np.ndarray:
    """Rows of a list column as a matrix, of floats if they are, else doubles; null rows and rows of another length become NaN."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(array.offsets.to_numpy())
    fine = (sizes == n_energy) & (~np.asarray(array.is_null()))
    kind = np.float32 if array.type.value_type == pa.float32() else np.float64
    if fine.all():
        return array.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_energy).astype(kind, copy=False)
    out = np.full((len(array), n_energy), np.nan, dtype=kind)
    if fine.any():
        out[fine] = np.stack([np.asarray(array[int(k)].as_py(), dtype=np.float64) for k in np.flatnonzero(fine)])
    return out


def values(df: DataFrame, intensity: str) -> Column:
    """The intensities as the solvers take them: lists of floats or doubles go as they are."""
    kind = dict(df.select(F.col(intensity).alias("y")).dtypes)["y"]
    return F.col(intensity) if kind in ("array<float>", "array<double>") else F.col(intensity).cast("array<double>")


def _lists(v: np.ndarray, good: np.ndarray | None = None) -> pa.ListArray:
    """The rows of a matrix as lists; null where good is false, for which the matrix has no rows."""
    n, k = v.shape
    if good is None:
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(v.ravel()))
    flat = np.concatenate([[0], np.cumsum(np.where(good, k, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(flat), pa.array(v.ravel()), mask=pa.array(~good))


def _check(d: Dictionary) -> Dictionary:
    if d.profiles.size > MOST_CELLS:
        raise ValueError(f"a dictionary of {d.profiles.size} cells is over {MOST_CELLS}; take a coarser grid or group the peaks")
    return d


def fit(df: DataFrame, peaks: Peaks, mode: str = "balanced", intensity: str = "intensity", keep: Sequence[str] = ("spectrum_id",)) -> DataFrame:
    """The columns in `keep`, amplitudes, shift, width and chi2 of every spectrum.

    mode: a name of MODES, or amp_only, dictionary, four_step, parabola, hybrid, gamma, six_step, taylor,
    clean. A spectrum that is null, of another length or holds NaN gets nulls.
    """
    mode = MODES.get(mode, mode)
    delta = calibrate_gamma(df, peaks, intensity) if mode == "gamma" else 0.0
    d = _check(kernels.build_dictionary(peaks, delta))
    n_energy = len(peaks.energy)

    def solve(y: np.ndarray, d: Dictionary) -> tuple[np.ndarray, ...]:
        if mode == "amp_only":
            a, chi2 = kernels.solve_amplitudes(y, d.weights[d.nominal], d.profiles[d.nominal])
            return a, np.zeros(len(y)), np.zeros(len(y)), chi2
        if mode == "four_step":
            return kernels.solve_four_step(y, d, d.nominal)
        return kernels.solve_dictionary(y, d, REFINEMENTS.get(mode, "parabola"), peaks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column(batch.schema.get_field_index("__y")), n_energy)
            good = np.isfinite(y).all(axis=1)
            n = int(good.sum())
            y = y if n == len(y) else y[good]
            own = d.astype(y.dtype)
            parts = [solve(y[k : k + ROWS], own) for k in range(0, max(n, 1), ROWS)]
            a, shift, width, chi2 = (np.concatenate(p).astype(np.float64, copy=False) for p in zip(*parts))
            at = np.cumsum(good) - 1

            def spread(v: np.ndarray) -> pa.Array:
                return pa.array(v[np.maximum(at, 0)] if n else np.zeros(len(good)), mask=~good)

            lists = _lists(a, good)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, lists, spread(shift), spread(width), spread(chi2)], names=[*batch.schema.names[:-1], "amplitudes", "shift", "width", "chi2"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", " + FIT_FIELDS
    return df.select(*keep, values(df, intensity).alias("__y")).mapInArrow(run, schema)


#: A fit with another gamma stands only if it lowers chi2 by this share.
GATE = 0.01


def fit_multipeak(df: DataFrame, each: Sequence[Peaks], rounds: int = 3, intensity: str = "intensity", keep: Sequence[str] = ("spectrum_id",), degree: int | None = None, deltas: Sequence[float] = (), polish: int = 0) -> DataFrame:
    """As fit, with a shift and a width for each component: arrays shifts and widths, and delta_gamma.

    degree: of a polynomial background that is fitted along. deltas: other gammas to try, of which the best
    is taken where it lowers chi2 by `GATE` or more; delta_gamma is 0 elsewhere. polish: so many damped
    Gauss-Newton steps off the grid. A spectrum that is null, of another length or holds NaN gets nulls.
    """
    energy = each[0].energy
    base = kernels.polynomial_base(energy, degree) if degree is not None else None
    tried = [0.0, *[float(x) for x in deltas]]
    held = [[_check(kernels.build_dictionary(p, x)) for p in each] for x in tried]
    products = {np.dtype(kind): [kernels.Products([d.astype(kind) for d in ds], base) for ds in held] for kind in (np.float32, np.float64)}

    def solve(y: np.ndarray) -> list[np.ndarray]:
        first, *others = [list(kernels.solve_multipeak(y, p, rounds)) for p in products[y.dtype]]
        got = [np.array(v, dtype=np.float64) for v in first] + [np.zeros(len(y))]
        best = first[3] * (1 - GATE)
        for delta, other in zip(tried[1:], others):
            better = other[3] < best
            best = np.where(better, other[3], best)
            for old, new in zip(got, [*other, np.full(len(y), delta)]):
                old[better] = new[better]
        if polish:
            for delta in np.unique(got[4]):
                rows = got[4] == delta
                own = [replace(p, gamma=p.gamma + delta) for p in each]
                got[0][rows], got[1][rows], got[2][rows], got[3][rows] = kernels.polish(y[rows].astype(np.float64), own, got[0][rows], got[1][rows], got[2][rows], base, polish)
        return got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                y = _matrix(batch.column(batch.num_columns - 1), len(energy))
                good = np.isfinite(y).all(axis=1)
                a, shifts, widths, chi2, delta = solve(y[good])
                at = np.maximum(np.cumsum(good) - 1, 0)
                lists = [_lists(np.ascontiguousarray(x), good) for x in (a, shifts, widths)]
                plain = [pa.array(x[at] if len(x) else np.zeros(len(good)), mask=~good) for x in (chi2, delta)]
                kept = [batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, *lists, *plain], names=[*batch.schema.names[:-1], "amplitudes", "shifts", "widths", "chi2", "delta_gamma"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return df.select(*keep, values(df, intensity).alias("__y")).mapInArrow(run, schema + ", amplitudes array<double>, shifts array<double>, widths array<double>, chi2 double, delta_gamma double")


def fit_multipeak_twice(df: DataFrame, each: Sequence[Peaks], deltas: Sequence[float], rounds: int = 3, intensity: str = "intensity", keep: Sequence[str] = ("spectrum_id",), degree: int | None = None) -> tuple[DataFrame, float]:
    """Two stages: each spectrum's gamma first, then all again with the median correction of those that took one.

    Returns the second fit and the correction, 0 if no spectrum took one.
    """
    first = fit_multipeak(df, each, rounds, intensity, keep, degree, deltas).select("delta_gamma")
    delta = float(first.filter("delta_gamma != 0").agg(F.median("delta_gamma")).first()[0] or 0.0)
    return fit_multipeak(df, [replace(p, gamma=p.gamma + delta) for p in each], rounds, intensity, keep, degree), delta


def fit_elements(spectra: dict[str, DataFrame], peaks: dict[str, Peaks], mode: str = "balanced", key: str = "spectrum_id") -> DataFrame:
    """(element, key, amplitudes, shift, width, chi2) of several elements' spectra, each with its own peaks."""
    out = None
    for name in sorted(spectra):
        part = fit(spectra[name], peaks[name], mode, keep=(key,)).select(F.lit(name).alias("element"), key, "amplitudes", "shift", "width", "chi2")
        out = part if out is None else out.unionByName(part)
    return out


def depth_profile(fitted: DataFrame, key: str = "spectrum_id") -> DataFrame:
    """One row a point with each element's share of the total amplitude, for what `fit_elements` returns; null where one is missing."""
    total = F.aggregate("amplitudes", F.lit(0.0), lambda acc, x: acc + x)
    wide = fitted.groupBy(key).pivot("element").agg(F.sum(total))
    names = [c for c in wide.columns if c != key]
    whole = sum((F.col(f"`{n}`") for n in names[1:]), F.col(f"`{names[0]}`"))
    return wide.select(key, *[F.when(whole > 0, F.col(f"`{n}`") / whole).alias(n) for n in names])


def calibrate_gamma(df: DataFrame, peaks: Peaks, intensity: str = "intensity", half: float = 0.5, n: int = 11) -> float:
    """The correction of gamma, of a grid up to half of gamma either way, with the least total chi2.

    One job: every spectrum is fitted with each gamma in turn, tasks sum, one row reaches the driver.
    """
    deltas = np.linspace(-half, half, n) * peaks.gamma
    ds = [_check(kernels.build_dictionary(peaks, g)) for g in deltas]
    n_energy = len(peaks.energy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for batch in batches:
            y = _matrix(batch.column(0), n_energy)
            y = y[np.isfinite(y).all(axis=1)]
            if len(y):
                total += [kernels.solve_dictionary(y, d, "none")[3].sum() for d in ds]
        yield pa.RecordBatch.from_arrays([pa.array(range(n), type=pa.int32()), pa.array(total)], names=["k", "chi2"])

    sums = df.select(values(df, intensity).alias("__y")).mapInArrow(run, "k int, chi2 double").groupBy("k").agg(F.sum("chi2").alias("chi2")).collect()
    chi2 = np.array([r["chi2"] for r in sorted(sums, key=lambda r: r["k"])])
    if not len(chi2):
        return 0.0
    best = int(chi2.argmin())
    inner = 0 < best < n - 1
    return float(deltas[best] + (kernels.vertex(-chi2[best - 1], -chi2[best], -chi2[best + 1]) * (deltas[1] - deltas[0]) if inner else 0.0))


def flag_anomalies(fitted: DataFrame, k: float = 3.0, accuracy: int | None = None) -> DataFrame:
    """Adds is_anomaly by the robust threshold of chi2 over all rows, exact or with bounded state."""
    t = robust.mad_thresholds(fitted.filter("chi2 is not null"), "chi2", (), k, accuracy)
    one = t.select("mad", "threshold")  # one row
    return fitted.crossJoin(F.broadcast(one)).withColumn("is_anomaly", F.coalesce((F.col("mad") >= robust.MAD_FLOOR) & (F.col("chi2") > F.col("threshold")), F.lit(False))).drop("mad", "threshold")


def hybrid(df: DataFrame, peaks: Peaks, first: str = "fast", second: str = "precise", intensity: str = "intensity", key: str = "spectrum_id") -> DataFrame:
    """Fits all with a quick mode, then the anomalies again with a precise one, whose values replace the first.

    second `auto` refines by Gauss-Newton instead, as freely as the anomalies are far off (`refinement_mode`);
    shift and width are then means over the components. The first fit is written, so that its quantiles and
    the flags don't fit anew.
    """
    from lineshed.operators.refine import refine, refinement_mode
    from lineshed.operators.relate import merge

    stage1 = flag_anomalies(materialize(fit(df, peaks, first, intensity, (key,)), "stage1"))
    again = df.join(stage1.filter("is_anomaly").select(key), key, "left_semi")
    columns = ["amplitudes", "shift", "width", "chi2"]
    if second == "auto":
        off = stage1.groupBy("is_anomaly").agg(F.median("chi2").alias("chi2")).collect()
        median = {r["is_anomaly"]: r["chi2"] or 0.0 for r in off}
        refined = refine(again, peaks, refinement_mode(median.get(True, 0.0), median.get(False, 0.0)), intensity=intensity, keep=(key,))
        off_by = lambda name, nominal: (F.aggregate(name, F.lit(0.0), lambda acc, x: acc + x) - float(sum(nominal))) / len(nominal)
        return merge(stage1, refined.select(key, "amplitudes", off_by("centers", peaks.centers).alias("shift"), off_by("sigmas", peaks.sigmas).alias("width"), "chi2"), key, columns)
    return merge(stage1, fit(again, peaks, second, intensity, (key,)), key, columns)


def to_components(fitted: DataFrame, peaks: Peaks, key: str = "spectrum_id") -> DataFrame:
    """One row a component: height, center, widths, area. Height is the value at the center, area the integral."""
    unit = [float(kernels.voigt(np.zeros(1), 0.0, s, peaks.gamma)[0]) for s in peaks.sigmas]
    table = F.array(*[F.struct(F.lit(float(c)).alias("center"), F.lit(float(s)).alias("sigma"), F.lit(u).alias("unit")) for c, s, u in zip(peaks.centers, peaks.sigmas, unit)])
    rows = fitted.filter("amplitudes is not null").select(key, "shift", "width", "chi2", F.posexplode(F.arrays_zip(F.col("amplitudes").alias("amplitude"), table.alias("p"))).alias("comp", "x"))
    return rows.select(
        key,
        "comp",
        (F.col("x.amplitude") * F.col("x.p.unit")).alias("height"),
        (F.col("x.p.center") + F.col("shift")).alias("center"),
        ((F.col("x.p.sigma") + F.col("width")) * kernels.FWHM_PER_SIGMA).alias("fwhm_g"),
        F.lit(2 * peaks.gamma).alias("fwhm_l"),
        F.col("x.amplitude").alias("area"),
        "chi2",
    )


def two_amplitudes(df: DataFrame, a: str, b: str, y: str, by: Sequence[str]) -> DataFrame:
    """amp_0 and amp_1 of y = amp_0 a + amp_1 b by group, from five sums."""
    s = df.groupBy(*by).agg(
        F.sum(F.col(a) * F.col(a)).alias("aa"), F.sum(F.col(a) * F.col(b)).alias("ab"), F.sum(F.col(b) * F.col(b)).alias("bb"), F.sum(F.col(a) * F.col(y)).alias("ay"), F.sum(F.col(b) * F.col(y)).alias("by_")
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    return s.select(*by, F.when(F.abs(det) > 1e-12, (F.col("bb") * F.col("ay") - F.col("ab") * F.col("by_")) / det).alias("amp_0"), F.when(F.abs(det) > 1e-12, (F.col("aa") * F.col("by_") - F.col("ab") * F.col("ay")) / det).alias("amp_1"))


def four_step_rows(df: DataFrame, by: Sequence[str], y: str = "y", phi: str = "phi", jc: str = "jc", js: str = "js") -> DataFrame:
    """The four steps for one component over rows (y, profile, derivatives): amplitude, shift, width, chi2 by group.

    All products the steps need are sums over the group, so one aggregate suffices.
    """
    names = {"y": y, "p": phi, "c": jc, "s": js}
    pairs = ["yy", "yp", "yc", "ys", "pp", "pc", "ps", "cc", "cs", "ss"]
    t = df.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(F.col(names[u]) * F.col(names[v])).alias(u + v) for u, v in pairs])
    t = t.withColumn("a", F.col("yp") / F.col("pp"))
    a = F.col("a")
    rc, rs = a * (F.col("yc") - a * F.col("pc")), a * (F.col("ys") - a * F.col("ps"))
    cc, cs, ss = a * a * F.col("cc"), a * a * F.col("cs"), a * a * F.col("ss")
    t = t.withColumn("shift", F.when(cc > 1e-20, rc / cc).otherwise(F.lit(0.0)))
    t = t.withColumn("width", F.when(ss > 1e-20, (rs - F.col("shift") * cs) / ss).otherwise(F.lit(0.0)))
    pull = 1 + F.col("width") * F.col("ps") / F.col("pp")
    chi2 = (F.col("yy") - 2 * a * F.col("yp") + a * a * F.col("pp")) / F.col("n")
    return t.select(*by, (a / F.when(F.abs(pull) > 1e-6, pull).otherwise(F.lit(1.0))).alias("amplitude"), "shift", "width", chi2.alias("chi2"))
