"""Declared peak systems: template tables, and fits that move a whole system onto a spectrum."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lineshed.operators import batched, kernels
from lineshed.operators.analyse import _many_spectra
from lineshed.operators.background import BACKGROUNDS


@dataclass(frozen=True)
class TemplatePeak:
    """A chemical state: its shift to higher binding energy from the reference, widths, rough relative area."""

    name: str
    shift: float
    fwhm_g: float
    fwhm_l: float
    area: float = 1.0
    asymmetry: float = 0.0


@dataclass(frozen=True)
class Template:
    """A system of states; partner stands at +split in binding energy with `ratio` of the main line's area."""

    name: str
    element: str
    reference: float
    peaks: tuple[TemplatePeak, ...]
    split: float = 0.0
    ratio: float = 0.0
    ordered_widths: bool = False


# Shifts, widths and rough areas of the built-in systems.
TEMPLATES: dict[str, Template] = {
    t.name: t
    for t in (
        Template("Si2p_oxide", "Si2p", 99.3, (TemplatePeak("Si0", 0.0, 0.35, 0.15, 1.0), TemplatePeak("Si1+", 0.95, 0.45, 0.20, 0.3), TemplatePeak("Si2+", 1.80, 0.55, 0.25, 0.2), TemplatePeak("Si3+", 2.60, 0.65, 0.30, 0.15), TemplatePeak("Si4+", 3.60, 0.80, 0.35, 0.8)), 0.608, 0.5, True),
        Template("Ta4f_oxide", "Ta4f", 21.6, (TemplatePeak("Ta0", 0.0, 0.30, 0.25, 1.0, 0.04), TemplatePeak("Ta_sub", 2.0, 0.50, 0.30, 0.3), TemplatePeak("Ta5+", 4.5, 0.70, 0.35, 0.8)), 1.91, 0.75, True),
        Template("C1s_organic", "C1s", 285.0, (TemplatePeak("C-C", 0.0, 0.60, 0.20, 1.0), TemplatePeak("C-O", 1.5, 0.65, 0.20, 0.3), TemplatePeak("C=O", 3.0, 0.65, 0.20, 0.15), TemplatePeak("O-C=O", 4.25, 0.70, 0.25, 0.1))),
    )
}


def register(template: Template) -> None:
    """Makes a template of one's own known by name."""
    TEMPLATES[template.name] = template


def table(spark: SparkSession) -> DataFrame:
    """All templates in long form."""
    rows = [(t.name, t.element, p.name, p.shift, p.fwhm_g, p.fwhm_l, p.asymmetry, p.shift == 0, p.area) for t in TEMPLATES.values() for p in t.peaks]
    return spark.createDataFrame(rows, "template string, element string, peak string, delta_be double, fwhm_g double, fwhm_l double, asymmetry double, is_reference boolean, relative_area double")


def fit_template(df: DataFrame, template: Template, kinetic: bool = False, photon_energy: float = 0.0, background: str = "linear", reach: float = 1.0, key: str = "spectrum_id", energy: str = "energy", intensity: str = "intensity") -> DataFrame:
    """(reference, areas, shifts, scale, chi2, success) of each spectrum.

    First the place of the system is searched within `reach` by least squares of the areas; then that
    place, small shifts of the states and a common width scale are fitted. On a kinetic axis shifts and
    the partner lie on the other side.
    """
    sign = -1.0 if kinetic else 1.0
    shifts = np.array([p.shift for p in template.peaks])
    sigma = np.array([p.fwhm_g for p in template.peaks]) / kernels.FWHM_PER_SIGMA
    gamma = np.array([p.fwhm_l for p in template.peaks]) / 2
    nominal = photon_energy - template.reference if kinetic else template.reference

    count = len(shifts)

    def basis(e: np.ndarray, place: np.ndarray, moved: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Profiles (rows, states, points), their derivatives by place and by scale."""
        centers = place[:, None] + sign * (shifts + moved)
        width, half = sigma * scale[:, None], gamma * scale[:, None]
        lines = [(1.0, batched.voigt_derivatives(e, centers, width, half))]
        if template.split:
            lines.append((template.ratio, batched.voigt_derivatives(e, centers + sign * template.split, width, half)))
        v, dc, ds, dg = (sum(r * line[k] for r, line in lines) for k in range(4))
        return v, dc, ds * sigma[:, None] + dg * gamma[:, None]

    def areas(b: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Areas of 0 or more, by dropping the most negative one until none is; and the profiles in use, others as zeros."""
        b = b.copy()
        a = np.zeros(b.shape[:2])
        rows = np.arange(len(b))
        while len(rows):
            a[rows] = batched.product(batched.orthogonal(b[rows])[1], y[rows])
            rows = rows[(a[rows] < 0).any(axis=1)]
            b[rows, a[rows].argmin(axis=1)] = 0
        return a, b

    def searched(e: np.ndarray, net: np.ndarray) -> np.ndarray:
        """The best place of each spectrum; profiles are made once for each axis."""
        tried = nominal + np.linspace(-reach, reach, 41)
        out = np.empty(len(e))
        axes, of = np.unique(e, axis=0, return_inverse=True)
        members = np.split(np.argsort(of.ravel(), kind="stable"), np.cumsum(np.bincount(of.ravel()))[:-1])
        for axis, own in zip(axes, members):
            b = basis(np.broadcast_to(axis, (len(tried), len(axis))), tried, np.zeros((len(tried), count)), np.ones(len(tried)))[0]
            costs = np.empty((len(own), len(tried)))
            for k in range(len(tried)):
                each = np.broadcast_to(b[k], (len(own), *b[k].shape))
                rest = net[own] - np.einsum("nk,ke->ne", areas(each, net[own])[0], b[k])
                costs[:, k] = np.einsum("ij,ij->i", rest, rest)
            out[own] = tried[costs.argmin(axis=1)]
        return out

    def fitted(e: np.ndarray, net: np.ndarray) -> dict:
        def evaluate(rows: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            v, dc, dw = basis(e[rows], q[:, 0], np.pad(q[:, 2:], ((0, 0), (1, 0))), q[:, 1])
            rest, jacobian = batched.projected(net[rows], areas(v, net[rows])[1], [(dc, range(count)), (dw, range(count))])
            # the place moves all states, the scale widens all, each shift moves one
            jacobian = np.concatenate([jacobian[:, :count].sum(axis=1, keepdims=True), jacobian[:, count:].sum(axis=1, keepdims=True), sign * jacobian[:, 1:count]], axis=1)
            return batched.normal(rest, jacobian)

        places = np.concatenate([searched(e[part], net[part]) for part in batched.slices(len(e))])
        still = np.zeros((len(e), count - 1))
        start = np.column_stack([places, np.ones(len(e)), still])
        low = np.column_stack([places - reach / 5, np.full(len(e), 0.6), still - 0.3])
        high = np.column_stack([places + reach / 5, np.full(len(e), 1.8), still + 0.3])
        q, best, done = batched.least_squares(evaluate, start, low, high, 60)
        moved = np.pad(q[:, 2:], ((0, 0), (1, 0)))
        sizes = np.concatenate([areas(basis(e[part], q[part, 0], moved[part], q[part, 1])[0], net[part])[0] for part in batched.slices(len(e))])
        return {"reference": q[:, 0], "areas": sizes, "shifts": shifts + moved, "scale": q[:, 1], "chi2": best / e.shape[1], "success": done}

    def many(e: np.ndarray, y: np.ndarray, _) -> list[dict]:
        net = np.stack([v - BACKGROUNDS[background](x, v) for x, v in zip(e, y)])
        found = {name: values.tolist() for name, values in fitted(e, net).items()}
        return [dict(zip(found, row)) for row in zip(*found.values())]

    return _many_spectra(df, many, "reference double, areas array<double>, shifts array<double>, scale double, chi2 double, success boolean", key, energy, intensity)
