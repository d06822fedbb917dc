"""Second-stage fits: curvature-corrected steps, width of the Lorentzian part, grouping, Gauss-Newton refinement."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from lineshed.operators import kernels
from lineshed.operators.fit import FIT_FIELDS, _check, _lists, _matrix, values
from lineshed.operators.kernels import Peaks



def _map_matrix(df: DataFrame, solve, fields: str, n_energy: int, intensity: str, keep: Sequence[str]) -> DataFrame:
    """Applies solve(matrix) -> columns to the finite spectra of each batch; the others get nulls."""
    names = [f.split()[0] for f in fields.split(", ")]

    def column(v: np.ndarray, field: str, good: np.ndarray) -> pa.Array:
        v = np.asarray(v, dtype=np.float64)
        if "array" in field:
            return _lists(np.ascontiguousarray(v), good)
        at = np.maximum(np.cumsum(good) - 1, 0)
        return pa.array(v[at] if len(v) else np.zeros(len(good)), mask=~good)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column(batch.num_columns - 1), n_energy)
            good = np.isfinite(y).all(axis=1)
            got = solve(y[good]) if good.any() else [np.zeros((0, 1) if "array" in f else 0) for f in fields.split(", ")]
            columns = [column(v, f, good) for v, f in zip(got, fields.split(", "))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns - 1)], *columns], names=[*batch.schema.names[:-1], *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", " + fields
    return df.select(*keep, values(df, intensity).alias("__y")).mapInArrow(run, schema)


def fit_six_step(df: DataFrame, peaks: Peaks, intensity: str = "intensity", keep: Sequence[str] = ("spectrum_id",)) -> DataFrame:
    """Best cell of the dictionary, then six steps from it."""
    from lineshed.operators.fit import fit

    return fit(df, peaks, "six_step", intensity, keep)


def fit_gamma(df: DataFrame, peaks: Peaks, deltas: Sequence[float], intensity: str = "intensity", keep: Sequence[str] = ("spectrum_id",)) -> DataFrame:
    """As the parabola fit, over a third grid axis: the Lorentzian width of each spectrum.

    The dictionaries are one a delta; the best cell over all decides, and a vertex through the
    neighbouring deltas' best scores refines it.
    """
    deltas = np.asarray(deltas, dtype=np.float64)
    ds = [_check(kernels.build_dictionary(peaks, g)) for g in deltas]

    def solve(y: np.ndarray) -> list:
        scores = np.stack([(y @ d.columns).max(axis=1) for d in ds], axis=1)
        best = scores.argmax(axis=1)
        out = [np.empty((len(y), len(peaks.centers))), np.empty(len(y)), np.empty(len(y)), np.empty(len(y)), deltas[best].copy()]
        for k in np.unique(best):
            rows = best == k
            out[0][rows], out[1][rows], out[2][rows], out[3][rows] = kernels.solve_dictionary(y[rows], ds[k], "parabola")
        inner = (best > 0) & (best < len(deltas) - 1)
        if inner.any():
            r, b = np.flatnonzero(inner), best[inner]
            out[4][inner] += kernels.vertex(scores[r, b - 1], scores[r, b], scores[r, b + 1]) * (deltas[1] - deltas[0])
        return out

    return _map_matrix(df, solve, FIT_FIELDS + ", delta_gamma double", len(peaks.energy), intensity, keep)


def group_peaks(centers: Sequence[float], sigmas: Sequence[float], threshold: float = 4.0) -> list[list[int]]:
    """Peaks that can be fitted alone, outermost first, and last those that need a joint fit.

    Distances count in mean widths of neighbours in the order of the axis. The more isolated end goes
    first, the lower one where both are equally far.
    """
    chain = sorted(range(len(centers)), key=lambda k: centers[k])
    groups: list[list[int]] = []

    def apart(i: int, j: int) -> float:
        return abs(centers[i] - centers[j]) / ((sigmas[i] + sigmas[j]) / 2)

    while len(chain) > 1:
        ends = [(apart(chain[0], chain[1]), 0), (apart(chain[-1], chain[-2]), -1)]
        distance, end = ends[0] if ends[0][0] >= ends[1][0] else ends[1]
        if distance < threshold:
            break
        groups.append([chain.pop(end)])
    return groups + ([chain] if chain else [])


def fit_grouped(df: DataFrame, peaks: Peaks, threshold: float = 4.0, rounds: int = 2, intensity: str = "intensity", keep: Sequence[str] = ("spectrum_id",)) -> DataFrame:
    """Fits groups in turn against what the others leave: amplitudes, shifts and widths of each component, chi2."""
    groups = group_peaks(peaks.centers, peaks.sigmas, threshold)
    ds = [_check(kernels.build_dictionary(replace(peaks, centers=(c,), sigmas=(s,)))) for c, s in zip(peaks.centers, peaks.sigmas)]
    nominal = peaks.basis()[0]

    def solve(y: np.ndarray) -> list:
        n, k = len(y), len(ds)
        a = np.linalg.lstsq(nominal, y.T, rcond=None)[0].T
        model = a[:, None, :] * nominal[None]
        shifts, widths = np.zeros((n, k)), np.zeros((n, k))
        for _ in range(rounds):
            for group in groups:
                left = y - model.sum(axis=2) + model[:, :, group].sum(axis=2)
                ga, gs, gw, _ = kernels.solve_multipeak(left, [ds[c] for c in group])
                a[:, group], shifts[:, group], widths[:, group] = ga, gs, gw
                for at, c in enumerate(group):
                    x = peaks.energy[None, :] - peaks.centers[c] - gs[:, at : at + 1]
                    s = peaks.sigmas[c] + gw[:, at : at + 1]
                    v = kernels.faddeeva((x + 1j * peaks.gamma) / (s * np.sqrt(2))).real / (s * np.sqrt(2 * np.pi))
                    model[:, :, c] = ga[:, at : at + 1] * v
        rest = y - model.sum(axis=2)
        return [a, shifts, widths, np.einsum("ij,ij->i", rest, rest) / y.shape[1]]

    return _map_matrix(df, solve, "amplitudes array<double>, shifts array<double>, widths array<double>, chi2 double", len(peaks.energy), intensity, keep)


def refinement_mode(chi2_anomalies: float, chi2_normal: float) -> str:
    """light, medium or full, by the ratio of both medians."""
    ratio = chi2_anomalies / chi2_normal if chi2_normal else float("inf")
    return "light" if ratio < 2 else "medium" if ratio < 5 else "full"


def refine(df: DataFrame, peaks: Peaks, mode: str = "medium", rounds: int = 20, damping: float = 1.0, intensity: str = "intensity", keep: Sequence[str] = ("spectrum_id",)) -> DataFrame:
    """Gauss-Newton with amplitudes projected out: centers (light), and sigmas (medium), and a gamma (full).

    Meant for the few spectra that a quick fit flags; one at a time in an Arrow batch.
    """
    k = len(peaks.centers)

    def one(y: np.ndarray) -> tuple:
        p = np.array([*peaks.centers, *peaks.sigmas, peaks.gamma])
        free = np.array([True] * k + [mode != "light"] * k + [mode == "full"])
        low = np.array([*[c - 2 * peaks.shift_half for c in peaks.centers], *[0.2 * s for s in peaks.sigmas], 0.01])
        high = np.array([*[c + 2 * peaks.shift_half for c in peaks.centers], *[3 * s for s in peaks.sigmas], 2.0])
        before = np.inf
        for _ in range(rounds):
            cells = [kernels.voigt_derivatives(peaks.energy, p[c], p[k + c], p[2 * k]) for c in range(k)]
            basis = np.stack([v[0] for v in cells], axis=1)
            a = np.linalg.lstsq(basis, y, rcond=None)[0]
            rest = y - basis @ a
            cost = float(rest @ rest)
            if abs(before - cost) <= 1e-12 * max(cost, 1e-300):
                break
            before = cost
            j = np.stack([*[a[c] * cells[c][1] for c in range(k)], *[a[c] * cells[c][2] for c in range(k)], sum(a[c] * cells[c][3] for c in range(k))], axis=1)[:, free]
            whole = np.concatenate([basis, j], axis=1)  # amplitudes move along
            step = np.linalg.lstsq(whole, rest, rcond=1e-10)[0][k:]
            p[free] += damping * step
            p = np.clip(p, low, high)
        return a, p[:k], p[k : 2 * k], p[2 * k], cost / len(y)

    def solve(y: np.ndarray) -> list:
        got = list(zip(*[one(row) for row in y]))
        return [np.stack(got[0]), np.stack(got[1]), np.stack(got[2]), np.array(got[3]), np.array(got[4])]

    return _map_matrix(df, solve, "amplitudes array<double>, centers array<double>, sigmas array<double>, gamma double, chi2 double", len(peaks.energy), intensity, keep)


def correct_swaps(df: DataFrame, found: str, true: str, columns: Sequence[str]) -> DataFrame:
    """Reorders each row's arrays in `columns` so that `found` lies nearest to `true`.

    Of up to 4 components all orders are tried, the given one first; of more, each true one takes the
    nearest that is left.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            orders = []
            for f, t in zip(pdf[found], pdf[true]):
                f, t = np.asarray(f), np.asarray(t)
                if len(f) <= 4:
                    orders.append(min(itertools.permutations(range(len(f))), key=lambda o: float(((f[list(o)] - t) ** 2).sum())))
                else:
                    left = list(range(len(f)))
                    orders.append([left.pop(int(np.argmin(np.abs(f[left] - v)))) for v in t])
            swapped = [list(o) != list(range(len(o))) for o in orders]
            yield pdf.assign(**{c: [np.asarray(v)[list(o)] for v, o in zip(pdf[c], orders)] for c in columns}, swapped=swapped)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", swapped boolean"
    return df.mapInPandas(run, schema)
