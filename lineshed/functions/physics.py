"""Electron transport and sensitivity as column expressions. Outside their domain they give null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineshed.functions.lineshape import Value, c

# Slopes of the published linear relations between the ratio and the albedo.
EAL_SLOPES = {"jp2020_unpolarized": 0.738, "jp2020_polarized_haxpes": 0.836}
ESCAPE_DEPTH_SLOPE = 0.736
INFORMATION_DEPTH_SLOPE = 0.787
TPP2M_RANGE = (50.0, 2000.0)


def imfp_tpp2m(energy: Value, valence: Value, density: Value, weight: Value, gap: Value) -> Column:
    """Inelastic mean free path in nm by TPP-2M; null where the formula has no meaning."""
    e, rho, u = c(energy), c(density), c(valence) * c(density) / c(weight)
    ep2 = F.pow(28.8 * F.sqrt(u), 2.0)
    beta = -0.10 + 0.944 / F.sqrt(ep2 + F.pow(c(gap), 2.0)) + 0.069 * F.pow(rho, 0.1)
    bracket = beta * F.ln(0.191 * F.pow(rho, -0.5) * e) - (1.97 - 0.91 * u) / e + (53.4 - 20.8 * u) / (e * e)
    fine = (e > 0) & (c(valence) > 0) & (rho > 0) & (c(weight) > 0) & (c(gap) >= 0) & (bracket > 0)
    return F.when(fine, e / (ep2 * bracket) / 10)


def sampling_depth(imfp: Value, fraction: Value = 0.95) -> Column:
    return F.when((c(fraction) >= 0) & (c(fraction) < 1), -c(imfp) * F.ln(1 - c(fraction)))


def albedo(imfp: Value, trmfp: Value) -> Column:
    return F.when((c(imfp) > 0) & (c(trmfp) > 0), c(imfp) / (c(imfp) + c(trmfp)))


def overlayer_eal(imfp: Value, trmfp: Value, model: str = "jp2020_unpolarized") -> Column:
    """Effective attenuation length for an overlayer."""
    return c(imfp) * (1 - EAL_SLOPES[model] * albedo(imfp, trmfp))


def mean_escape_depth(imfp: Value, trmfp: Value, emission_deg: Value) -> Column:
    return c(imfp) * F.cos(F.radians(c(emission_deg))) * (1 - ESCAPE_DEPTH_SLOPE * albedo(imfp, trmfp))


def information_depth(imfp: Value, trmfp: Value, emission_deg: Value, percentage: Value) -> Column:
    part = F.when((c(percentage) >= 1) & (c(percentage) < 100), F.ln(1 / (1 - c(percentage) / 100)))
    return c(imfp) * F.cos(F.radians(c(emission_deg))) * part * (1 - INFORMATION_DEPTH_SLOPE * albedo(imfp, trmfp))


def _p2(cosine: Column) -> Column:
    return (3 * cosine * cosine - 1) / 2


def angular_dipole(beta: Value, psi_deg: Value) -> Column:
    return 1 - c(beta) / 2 * _p2(F.cos(F.radians(c(psi_deg))))


def angular_unpolarized(beta: Value, gamma: Value, delta: Value, alpha_deg: Value) -> Column:
    cosine, sine = F.cos(F.radians(c(alpha_deg))), F.sin(F.radians(c(alpha_deg)))
    return 1 - c(beta) / 2 * _p2(cosine) + (c(delta) + c(gamma) / 2 * sine * sine) * cosine


def transmission_power_law(ratio: Value, scale: Value = 45.0, exponent: Value = -0.35, low: float = 1.0, high: float = 200.0) -> Column:
    """Analyser transmission; the ratio of kinetic to pass energy is held to the tabulated range."""
    return c(scale) * F.pow(F.least(F.greatest(c(ratio), F.lit(low)), F.lit(high)), c(exponent))


def sensitivity(cross_section: Value, imfp: Value) -> Column:
    return c(cross_section) * c(imfp)


def range_status(value: Value, low: Value, high: Value) -> Column:
    """inside, below, above or not_recorded."""
    v = c(value)
    return F.when(v.isNull(), "not_recorded").when(v < c(low), "below").when(v > c(high), "above").otherwise("inside")


def solvability(variance: Value, sigma: Value) -> Column:
    """easy, hard, shoulder or impossible, by the bound on the shift over the width."""
    ratio = F.when(c(sigma) > 0, F.sqrt(F.greatest(c(variance), F.lit(0.0))) / c(sigma)).otherwise(F.lit(math.inf))
    return F.when(ratio < 0.02, "easy").when(ratio < 0.10, "hard").when(ratio < 0.40, "shoulder").otherwise("impossible")


def within_taylor(shift: Value, sigma: Value, most: float = 0.35) -> Column:
    return F.abs(c(shift) / c(sigma)) < most
