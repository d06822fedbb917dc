"""Per-spectrum analyses in Arrow batches: automatic and template fits, model order, edges, uncertainty."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineshed.operators import batched, kernels
from lineshed.operators.background import BACKGROUNDS
from lineshed.operators.poisson import resample
from lineshed.operators.quantify import composition

FEWEST = 12  # points that the smoothing and the peak search need


def _per_spectrum(df: DataFrame, function: Callable[[np.ndarray, np.ndarray, int], dict], schema: str, key: str, energy: str, intensity: str) -> DataFrame:
    """One result row a spectrum; one that can't be read gives nulls besides its key, and why in `reason`."""
    return _many_spectra(df, lambda e, y, keys: list(map(function, e, y, keys)), schema, key, energy, intensity)


def _many_spectra(df: DataFrame, function: Callable[[np.ndarray, np.ndarray, list], list[dict]], schema: str, key: str, energy: str, intensity: str) -> DataFrame:
    """_per_spectrum for a function of many spectra of as many points each: axes, intensities (rows, points), keys."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            keys, es, ys = list(pdf[key]), pdf[energy].tolist(), pdf[intensity].tolist()
            reasons = [unreadable(e, y) for e, y in zip(es, ys)]
            got: list[dict] = [{} for _ in keys]
            for own, e, y in batched.by_length(es, ys, [r for r, why in enumerate(reasons) if why is None]):
                for r, found in zip(own, function(e, y, [keys[r] for r in own])):
                    got[r] = found
            yield pd.DataFrame([[k, *[g.get(n) for n in names], why] for k, g, why in zip(keys, got, reasons)], columns=[key, *names, "reason"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, energy, intensity).mapInPandas(run, f"{key} {kind}, {schema}, reason string")


def unreadable(energy: np.ndarray | None, intensity: np.ndarray | None) -> str | None:
    """Why a spectrum can't be analysed, or None."""
    if energy is None or intensity is None:
        return "no spectrum"
    if len(energy) != len(intensity):
        return "lengths differ"
    if len(intensity) < FEWEST:
        return f"fewer than {FEWEST} points"
    return None if np.isfinite(np.asarray(intensity, dtype=np.float64)).all() else "not finite"


def ranked_peaks(energy: np.ndarray, net: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and prominences of peaks: smoothed, with a prominence that rises with the noise."""
    window = min(11, len(net) // 2 * 2 - 1)
    smooth = kernels.savitzky_golay(net, window, 3)
    noise = 1.4826 * np.median(np.abs(net - smooth - np.median(net - smooth)))
    height = smooth.max() - min(smooth.min(), 0.0)
    return kernels.find_peaks(smooth, 0.03 * height, max(2, len(net) // 50), max(0.05 * height, 4 * noise))


def most_prominent(places: np.ndarray, prominences: np.ndarray, most: int) -> np.ndarray:
    return places[np.sort(np.argsort(-prominences, kind="stable")[:most])]


def detect_peaks(energy: np.ndarray, net: np.ndarray, most: int = 10) -> np.ndarray:
    """Places of the most prominent peaks by position."""
    return most_prominent(*ranked_peaks(energy, net), most)


def _fit_peaks(e: np.ndarray, y: np.ndarray, centers: Sequence[float], width: float, sd: np.ndarray | None = None) -> dict:
    """Bounded fit of Voigt peaks with amplitudes, centers, sigmas and a common gamma."""
    k = len(centers)
    span = abs(e[-1] - e[0])
    top = max(float(np.ptp(y)), 1e-12)
    weight = 1.0 if sd is None else 1 / sd

    def model(p: np.ndarray) -> np.ndarray:
        return sum(p[c] * kernels.voigt(e, p[k + c], p[2 * k + c], p[3 * k]) for c in range(k))

    start = np.concatenate([[top * width * 2.5] * k, centers, [width] * k, [width / 3]])
    low = np.concatenate([[0.0] * k, [c - 3 * width for c in centers], [width / 5] * k, [1e-3]])
    high = np.concatenate([[top * span * 10] * k, [c + 3 * width for c in centers], [width * 5] * k, [width * 3]])
    p, jacobian, cost, done = kernels.least_squares(lambda q: (y - model(q)) * weight, start, low, high, 200)
    return {"p": p, "jacobian": jacobian, "cost": cost, "done": done, "model": model(p)}


def _fit_many(e: np.ndarray, y: np.ndarray, centers: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_fit_peaks for many spectra of as many peaks each: parameters, costs, converged."""
    k = centers.shape[1]
    span = np.abs(e[:, -1:] - e[:, :1])
    top = np.maximum(np.ptp(y, axis=1), 1e-12)[:, None]
    width = width[:, None]
    ones = np.ones_like(centers)

    def evaluate(rows: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v, dc, ds, dg = batched.voigt_derivatives(e[rows], p[:, k : 2 * k], p[:, 2 * k : 3 * k], p[:, 3 * k :])
        a = p[:, :k, None]
        jacobian = np.concatenate([v, a * dc, a * ds, (a * dg).sum(axis=1, keepdims=True)], axis=1)
        return batched.normal(y[rows] - (a * v).sum(axis=1), -jacobian)

    start = np.concatenate([top * width * 2.5 * ones, centers, width * ones, width / 3], axis=1)
    low = np.concatenate([0 * ones, centers - 3 * width, width / 5 * ones, np.full_like(width, 1e-3)], axis=1)
    high = np.concatenate([top * span * 10 * ones, centers + 3 * width, width * 5 * ones, width * 3], axis=1)
    return batched.least_squares(evaluate, start, low, high, 200)


def auto_fit(df: DataFrame, background: str = "shirley", most: int = 10, key: str = "spectrum_id", energy: str = "energy", intensity: str = "intensity") -> DataFrame:
    """(n_components, centers, heights, areas, sigmas, gamma, chi2, r2, success) of each spectrum.

    Background, detection, a joint fit, then peaks under 1 % of the largest area are dropped.
    """

    def fitted(e: np.ndarray, net: np.ndarray, centers: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Parameters, costs, converged; spectra of as many peaks each are fitted together."""
        p: list[np.ndarray] = [np.empty(0)] * len(e)
        cost, done = np.empty(len(e)), np.empty(len(e), dtype=bool)
        counts = np.array([len(c) for c in centers])
        for k in np.unique(counts):
            own = np.flatnonzero(counts == k)
            found, cost[own], done[own] = _fit_many(e[own], net[own], np.stack([centers[r] for r in own]), np.abs(e[own, -1] - e[own, 0]) / 30)
            for r, q in zip(own, found):
                p[r] = q
        return p, cost, done

    def many(e: np.ndarray, y: np.ndarray, _) -> list[dict]:
        net = np.stack([v - BACKGROUNDS[background](x, v) for x, v in zip(e, y)])
        places = [detect_peaks(*x, most) for x in zip(e, net)]
        out: list[dict] = [{"n_components": 0, "success": False} for _ in places]
        rows = np.array([r for r, at in enumerate(places) if len(at)], dtype=np.int64)
        if not len(rows):
            return out
        p, cost, done = fitted(e[rows], net[rows], [e[r, places[r]] for r in rows])
        kept = [q[: len(q) // 3] >= 0.01 * q[: len(q) // 3].max() for q in p]
        again = np.array([r for r, keep in enumerate(kept) if not keep.all()], dtype=np.int64)
        if len(again):
            better, cost[again], done[again] = fitted(e[rows[again]], net[rows[again]], [p[r][len(kept[r]) : 2 * len(kept[r])][kept[r]] for r in again])
            for r, q in zip(again, better):
                p[r] = q
        for r, q, c, d in zip(rows, p, cost, done):
            k = len(q) // 3
            heights = batched.voigt_derivatives(q[k : 2 * k, None], q[k : 2 * k, None], q[2 * k : 3 * k, None], q[3 * k])[0][:, 0, 0] * q[:k]
            total = float(((net[r] - net[r].mean()) ** 2).sum())
            out[r] = {
                "n_components": k, "centers": q[k : 2 * k].tolist(), "heights": heights.tolist(), "areas": q[:k].tolist(), "sigmas": q[2 * k : 3 * k].tolist(), "gamma": float(q[3 * k]),
                "chi2": float(c) / e.shape[1], "r2": 1 - float(c) / total if total else None, "success": bool(d),
            }
        return out

    schema = "n_components int, centers array<double>, heights array<double>, areas array<double>, sigmas array<double>, gamma double, chi2 double, r2 double, success boolean"
    return _many_spectra(df, many, schema, key, energy, intensity)


def exact_k(df: DataFrame, most: int = 4, starts: int = 4, sigma: float = 0.5, gamma: float = 0.1, key: str = "spectrum_id", energy: str = "energy", intensity: str = "intensity") -> DataFrame:
    """One row a spectrum and number of peaks: rss, aicc, bic, residual autocorrelation, success.

    The variable projection starts from the found peaks and from shifted copies of them; the best counts.
    A spectrum that can't be read has rows without figures, and no success.
    """
    schema = "k int, rss double, aicc double, bic double, acf1 double, success boolean"
    ks = range(1, most + 1)

    def starting(s: int, k: int, e: np.ndarray, y: np.ndarray, places: np.ndarray) -> list[list[float]]:
        rng = np.random.default_rng([s, k])
        seed = list(e[places]) or [float(e[y.argmax()])]
        out = []
        for t in range(starts):
            centers = seed + [float(rng.uniform(min(seed) - 2 * sigma, max(seed) + 2 * sigma)) for _ in range(k - len(seed))]
            out.append(centers if t == 0 else [c + rng.normal(0, sigma / 2) for c in centers])
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            keys, es, ys = pdf[key].tolist(), pdf[energy].tolist(), pdf[intensity].tolist()
            fine = [r for r in range(len(pdf)) if unreadable(es[r], ys[r]) is None]
            bad = sorted(set(range(len(pdf))) - set(fine))
            rows = [(keys[r], k, None, None, None, None, False) for r in bad for k in ks]
            for own, e, y in batched.by_length(es, ys, fine):
                n = e.shape[1]
                found = [ranked_peaks(*x) for x in zip(e, y)]
                for k in ks:
                    m = 3 * k + 1
                    centers = np.array([c for r, *x, f in zip(own, e, y, found) for c in starting(int(keys[r]), k, *x, most_prominent(*f, k))])
                    rest, cost, done = batched.varpro(e, y, np.repeat(np.arange(len(own)), starts), centers, sigma, gamma, 3 * sigma)
                    best = np.arange(len(own)) * starts + cost.reshape(-1, starts).argmin(axis=1)
                    rss, acf = cost[best], np.einsum("ij,ij->i", rest[best, :-1], rest[best, 1:])
                    head = n * np.log(np.maximum(rss, 1e-300) / n)
                    aicc = head + 2 * m + 2 * m * (m + 1) / (n - m - 1) if n > m + 1 else np.full(len(own), math.inf)
                    acf = np.where(rss > 0, acf / np.where(rss > 0, rss, 1), 0.0)
                    rows += zip([keys[r] for r in own], [k] * len(own), rss.tolist(), aicc.tolist(), (head + m * math.log(n)).tolist(), acf.tolist(), done[best].tolist())
            yield pd.DataFrame(rows, columns=[key, *[c.split()[0] for c in schema.split(", ")]])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, energy, intensity).mapInPandas(run, f"{key} {kind}, {schema}")


def verdicts(candidates: DataFrame, key: str = "spectrum_id", margin: float = 10.0, structured: float = 4.0, n_points: int = 128) -> DataFrame:
    """The number of peaks of least BIC and whether the data support it.

    supported: the next best is `margin` or more away and the residual has no structure; ambiguous:
    nearer; unsupported: the best leaves structure or no candidate converged. The candidates are read once.
    """
    able = F.when(F.col("success"), F.struct("bic", "k", "acf1"))
    ranked = candidates.groupBy(key).agg(F.array_sort(F.collect_list(able)).alias("__able"))
    best, after = F.get("__able", F.lit(0)), F.get("__able", F.lit(1))
    judged = ranked.select(key, best["k"].alias("k"), best["bic"].alias("bic"), (after["bic"] - best["bic"]).alias("delta"), (best["acf1"] * math.sqrt(n_points)).alias("z"))
    word = F.when(F.col("k").isNull(), "unsupported").when(F.abs("z") > structured, "unsupported").when(F.coalesce(F.col("delta") >= margin, F.lit(True)), "supported").otherwise("ambiguous")
    return judged.select(key, "k", "bic", "delta", word.alias("verdict"))


#: Where the line of the density of states slopes: on the occupied side of the edge only, or on both.
DOS_FORMS = ("occupied", "both_sides")


def fermi_edge(df: DataFrame, temperature: float = 300.0, key: str = "spectrum_id", energy: str = "energy", intensity: str = "intensity", dos: str = "occupied") -> DataFrame:
    """(edge, height, slope, base, broadening, edge_sd) of each spectrum on a kinetic axis: occupation x line, broadened.

    dos: one of DOS_FORMS.
    """
    if dos not in DOS_FORMS:
        raise ValueError(f"unknown form {dos}")
    kt = 8.617333262e-5 * temperature

    def one(e: np.ndarray, y: np.ndarray, _) -> dict:
        fine = np.linspace(-1, 1, 41)

        def model(p: np.ndarray) -> np.ndarray:
            edge, height, slope, base, width = p
            shift = 4 * width * fine
            weights = np.exp(-0.5 * (4 * fine) ** 2)
            z = np.clip((e[:, None] - edge - shift) / kt, -500, 500)
            away = e[:, None] - edge - shift
            line = height + slope * (np.minimum(away, 0) if dos == "occupied" else away)
            return base + (line / (1 + np.exp(z))) @ (weights / weights.sum())

        rise = float(y.max() - y.min()) or 1.0
        middle = float(e[np.argmin(np.abs(y - (y.max() + y.min()) / 2))])
        span = abs(e[-1] - e[0])
        start = np.array([middle, rise, 0.0, float(y.min()), span / 50])
        low = np.array([e.min(), 0.0, -10 * rise / span, y.min() - rise, 1e-4])
        high = np.array([e.max(), 10 * rise, 10 * rise / span, y.max(), span / 2])
        p, jacobian, cost, done = kernels.least_squares(lambda q: y - model(q), start, low, high, 200)
        cov = np.linalg.pinv(jacobian.T @ jacobian) * cost / max(1, len(e) - 5)
        return {"edge": p[0], "height": p[1], "slope": p[2], "base": p[3], "broadening": p[4], "edge_sd": math.sqrt(max(cov[0, 0], 0)), "success": bool(done)}

    return _per_spectrum(df, one, "edge double, height double, slope double, base double, broadening double, edge_sd double, success boolean", key, energy, intensity)


def compare_dos(df: DataFrame, temperature: float = 300.0, key: str = "spectrum_id", energy: str = "energy", intensity: str = "intensity") -> DataFrame:
    """(key, edge and broadening by form, their spreads, success): every spectrum fitted with each form.

    The data near an edge hardly tell the forms apart, so the spread is reported beside the statistical error
    instead of a choice by chi2.
    """
    out = None
    for dos in DOS_FORMS:
        part = fermi_edge(df, temperature, key, energy, intensity, dos).select(key, F.col("edge").alias(f"edge_{dos}"), F.col("broadening").alias(f"broadening_{dos}"), F.col("success").alias(f"success_{dos}"))
        out = part if out is None else out.join(part, key)
    spread = {f"{name}_spread": F.abs(F.col(f"{name}_{DOS_FORMS[0]}") - F.col(f"{name}_{DOS_FORMS[1]}")) for name in ("edge", "broadening")}
    return out.withColumns(spread).withColumn("success", F.col(f"success_{DOS_FORMS[0]}") & F.col(f"success_{DOS_FORMS[1]}")).drop(*[f"success_{dos}" for dos in DOS_FORMS])


def identifiability(parameters: DataFrame, energy: np.ndarray, exposure: float = 1.0, background: float = 1.0, key: str = "spectrum_id") -> DataFrame:
    """(sd_center, sd_sigma, sd_gamma, rank, condition, label) of one Voigt peak under Poisson counts.

    parameters: (key, area, center, sigma, gamma). Bounds come from the Fisher information with the flat
    background estimated too.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, area, center, sigma, gamma in pdf.itertuples(index=False):
                v, dc, ds, dg = kernels.voigt_derivatives(energy, center, sigma, max(gamma, 1e-6))
                jacobian = np.stack([v, area * dc, area * ds, area * dg, np.ones_like(energy)], axis=1)
                fisher = kernels.poisson_fisher(jacobian, area * v + background, exposure)
                bound, rank = kernels.covariance_bound(fisher)
                scale = np.sqrt(np.diag(fisher))
                condition = float(np.linalg.cond(fisher / np.outer(scale, scale)))
                sd = np.sqrt(np.diag(bound)) if bound is not None else np.full(5, np.nan)
                near = gamma < 2 * sd[3] if bound is not None else False
                label = "rank_deficient" if bound is None else "near_boundary" if near else "weakly_identified" if sd[2] > 0.25 * sigma else "identified"
                rows.append((k, *[None if np.isnan(x) else float(x) for x in sd[1:4]], rank, condition, label))
            yield pd.DataFrame(rows, columns=[key, "sd_center", "sd_sigma", "sd_gamma", "rank", "condition", "label"])

    kind = parameters.schema[key].dataType.simpleString()
    return parameters.select(key, "area", "center", "sigma", "gamma").mapInPandas(run, f"{key} {kind}, sd_center double, sd_sigma double, sd_gamma double, rank int, condition double, label string")


def bootstrap(df: DataFrame, statistic: Callable[[np.ndarray, np.ndarray], float], draws: int = 200, seed: int = 0, key: str = "spectrum_id", energy: str = "energy", intensity: str = "intensity", kind: str = "nonparametric", mean: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """One row a spectrum and draw: the statistic of counts drawn anew.

    kind: nonparametric, from Poisson distributions of the counts; parametric, of what mean(energy, counts)
    says; sweeps, where the intensity is a list of sweeps, which are drawn with replacement and summed.
    Draws are seeded by the spectrum's id, so they don't depend on partitions.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for k, e, y in zip(pdf[key], pdf[energy], pdf[intensity]):
                rng = np.random.default_rng([seed, int(k)])
                e = np.asarray(e, dtype=np.float64)
                y = np.stack([np.asarray(v, dtype=np.float64) for v in y]) if kind == "sweeps" else np.asarray(y, dtype=np.float64)
                expected = np.maximum(mean(e, y), 0) if kind == "parametric" else None
                values = [float(statistic(e, resample(y, kind, rng, expected))) for _ in range(draws)]
                yield pd.DataFrame({key: k, "draw": np.arange(draws, dtype=np.int32), "value": values})

    named = df.schema[key].dataType.simpleString()
    return df.select(key, energy, intensity).mapInPandas(run, f"{key} {named}, draw int, value double")


def composition_uncertainty(lines: DataFrame, draws: int = 200, seed: int = 0, sample: str = "sample", element: str = "element", energy: str = "energy", intensity: str = "intensity", cross_section: str = "cross_section", imfp: str = "imfp") -> DataFrame:
    """(sample, element, mean, sd, area_noise, n_drawn, n_refused) over Poisson replicates of each line's counts.

    Every replicate is quantified anew: a line's area is the trapezoid above a linear background, and a
    sample with an area that isn't positive is refused in that replicate. area_noise is the sd of the
    replicates' areas over the area as measured.
    """

    def areas(e: np.ndarray, y: np.ndarray) -> np.ndarray:
        slope = (y[..., -1:] - y[..., :1]) / (e[-1] - e[0])
        return np.abs(np.trapezoid(y - y[..., :1] - slope * (e - e[0]), e, axis=-1))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for s, x, e, y, cs, path in pdf.itertuples(index=False):
                rng = np.random.default_rng([seed, zlib.crc32(f"{s}\t{x}".encode())])
                e, y = np.asarray(e, dtype=np.float64), np.maximum(np.asarray(y, dtype=np.float64), 0)
                got = areas(e, rng.poisson(y, (draws, len(y))).astype(np.float64))
                yield pd.DataFrame({"s": s, "x": x, "draw": np.arange(draws, dtype=np.int32), "area": got, "measured": float(areas(e, y)), "cs": cs, "path": path})

    kind = dict(lines.dtypes)
    drawn = lines.select(sample, element, energy, intensity, cross_section, imfp).mapInPandas(run, f"s {kind[sample]}, x {kind[element]}, draw int, area double, measured double, cs double, path double")
    rows = composition(drawn.withColumn("rep", F.struct("s", "draw")), "rep", "x", "area", "cs", "path")
    return rows.groupBy(F.col("s").alias(sample), F.col("x").alias(element)).agg(
        F.avg("fraction").alias("mean"), F.stddev("fraction").alias("sd"), F.try_divide(F.stddev("area"), F.first("measured")).alias("area_noise"), F.count("*").alias("n_drawn"), F.count_if(F.col("status") == "refused").alias("n_refused")
    )


def cross_section(df: DataFrame, table: DataFrame, by: Sequence[str], x: str = "photon_energy", grid: str = "energy", value: str = "cross_section", extrapolate: bool = True) -> DataFrame:
    """Adds value and status from a tabulated line: monotone cubic in logarithms inside the grid.

    Above it, where allowed, a power law through the last four points; below it, and for unknown lines,
    null with the status saying why. The grid of a line travels as one array by an equi-join.
    """
    cells = table.filter((F.col(value) > 0) & (F.col(grid) > 0)).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(grid).alias("x"), F.col(value).alias("y")))).alias("__grid"))
    joined = df.join(cells, list(by), "left")

    def at(x0: pd.Series, grids: pd.Series) -> pd.DataFrame:
        out = []
        for v, g in zip(x0, grids):
            if g is None or len(g) == 0:
                out.append((None, "not_in_table"))
                continue
            xs = np.log10([p["x"] for p in g])
            ys = np.log10([p["y"] for p in g])
            t = math.log10(v) if v and v > 0 else math.nan
            if math.isnan(t):
                out.append((None, "outside_range_below"))
            elif len(xs) == 1:
                out.append((10 ** ys[0], "tabulated") if abs(t - xs[0]) < 1e-12 else (None, "outside_range_above" if t > xs[0] else "outside_range_below"))
            elif t < xs[0]:
                out.append((None, "outside_range_below"))
            elif t > xs[-1]:
                m = min(4, len(xs))
                slope, level = np.polyfit(xs[-m:], ys[-m:], 1)
                out.append((10 ** (slope * t + level), "extrapolated_above") if extrapolate else (None, "outside_range_above"))
            else:
                out.append((10 ** float(kernels.pchip(xs, ys, np.array([t]))[0]), "tabulated"))
        return pd.DataFrame(out, columns=["value", "status"])

    udf = F.pandas_udf(at, "value double, status string")
    return joined.withColumn("__r", udf(F.col(x).cast("double"), "__grid")).withColumns({"value": F.col("__r.value"), "status": F.col("__r.status")}).drop("__r", "__grid")


def detect_convention(energy: np.ndarray, intensity: np.ndarray) -> str:
    """KE if the filled side, the brighter one, lies at lower energies, else BE."""
    order = np.argsort(energy)
    y = np.asarray(intensity, dtype=np.float64)[order]
    m = max(1, len(y) // 5)
    return "KE" if y[:m].mean() > y[-m:].mean() else "BE"


def edge_axis(energy, edge, kinetic: bool = True):
    """The binding energy axis with the edge at 0, as an array expression."""
    return F.transform(energy, lambda x: (edge - x) if kinetic else (x - edge))


def differential_edge(df: DataFrame, baseline: int, temperature: float = 300.0, key: str = "spectrum_id", energy: str = "energy", intensity: str = "intensity") -> DataFrame:
    """(key, delta, delta_sd): each edge less that of the baseline spectrum, fitted alike; errors add in squares."""
    edges = fermi_edge(df, temperature, key, energy, intensity).select(key, "edge", "edge_sd")
    base = edges.filter(F.col(key) == baseline).agg(F.min_by("edge", "edge").alias("__e"), F.min_by("edge_sd", "edge").alias("__s"))  # the lowest, if the id repeats
    return edges.crossJoin(F.broadcast(base)).select(key, (F.col("edge") - F.col("__e")).alias("delta"), F.sqrt(F.col("edge_sd") ** 2 + F.col("__s") ** 2).alias("delta_sd"))  # one row


def fit_in_order(df: DataFrame, index: str, chunk: int, centers: Sequence[float], width: float, key: str = "spectrum_id", energy: str = "energy", intensity: str = "intensity") -> DataFrame:
    """Fits along an index; each fit starts where the one before it in its chunk ended, if that succeeded.

    Chunks are ranges of the index, so the result doesn't depend on partitions, and no group is larger
    than a chunk.
    """
    k = len(centers)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, start = [], list(centers)
        origin = None
        for _, r in pdf.sort_values(index).iterrows():
            e, y = np.asarray(r[energy], dtype=np.float64), np.asarray(r[intensity], dtype=np.float64)
            f = _fit_peaks(e, y, start, width)
            rows.append((r[key], f["p"][k : 2 * k].tolist(), f["p"][:k].tolist(), f["cost"] / len(e), bool(f["done"]), origin))
            if f["done"]:
                start, origin = f["p"][k : 2 * k].tolist(), int(r[index])
        return pd.DataFrame(rows, columns=[key, "centers", "areas", "chi2", "success", "inherited_from"]).astype({"inherited_from": "Int64"})

    kind = df.schema[key].dataType.simpleString()
    chunks = df.select(key, index, energy, intensity).withColumn("__chunk", F.floor(F.col(index) / chunk))
    return chunks.groupBy("__chunk").applyInPandas(run, f"{key} {kind}, centers array<double>, areas array<double>, chi2 double, success boolean, inherited_from long")
