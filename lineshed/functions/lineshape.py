"""Peak profiles as column expressions, evaluated by Spark without Python workers.

All take columns or numbers; x may be a scalar column or, with `over`, an array axis. Areas are 1
unless said otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BOLTZMANN = 8.617333262e-5  # eV / K
FWHM_PER_SIGMA = 2 * math.sqrt(2 * math.log(2))
Value = Column | float | int | str


def c(v: Value) -> Column:
    """A column of a column, a column name or a number."""
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))


def over(axis: Value, profile: Callable[..., Column], *parameters: Value) -> Column:
    """A profile at every point of an array axis."""
    return F.transform(c(axis), lambda x: profile(x, *parameters))


def gaussian(x: Value, center: Value, fwhm: Value, area: Value = 1.0) -> Column:
    sigma = c(fwhm) / FWHM_PER_SIGMA
    return c(area) / (sigma * math.sqrt(2 * math.pi)) * F.exp(-F.pow((c(x) - c(center)) / sigma, 2.0) / 2)


def lorentzian(x: Value, center: Value, fwhm: Value, area: Value = 1.0) -> Column:
    half = c(fwhm) / 2
    return c(area) / math.pi * half / (F.pow(c(x) - c(center), 2.0) + half * half)


def pseudo_voigt(x: Value, center: Value, fwhm: Value, eta: Value, area: Value = 1.0) -> Column:
    share = F.least(F.greatest(c(eta), F.lit(0.0)), F.lit(1.0))
    return share * lorentzian(x, center, fwhm, area) + (1 - share) * gaussian(x, center, fwhm, area)


def voigt_width(fwhm_g: Value, fwhm_l: Value) -> Column:
    """Full width at half maximum of a Voigt profile, by Olivero and Longbothum."""
    return 0.5346 * c(fwhm_l) + F.sqrt(0.2166 * F.pow(c(fwhm_l), 2.0) + F.pow(c(fwhm_g), 2.0))


def tch_width(fwhm_g: Value, fwhm_l: Value) -> Column:
    """Full width by Thompson, Cox and Hastings."""
    g, w = c(fwhm_g), c(fwhm_l)
    # The published coefficients of g^5, g^4 l, ..., l^5
    terms = [1.0, 2.69269, 2.42843, 4.47163, 0.07842, 1.0]
    total = sum((k * F.pow(g, float(5 - i)) * F.pow(w, float(i)) for i, k in enumerate(terms)), F.lit(0.0))
    return F.pow(total, 0.2)


def tch_eta(fwhm_g: Value, fwhm_l: Value) -> Column:
    """Lorentzian share of the pseudo-Voigt profile nearest to a Voigt profile; 0.5 without width."""
    width = tch_width(fwhm_g, fwhm_l)
    r = c(fwhm_l) / width
    eta = 1.36603 * r - 0.47719 * r * r + 0.11116 * r * r * r
    return F.when(width < 1e-10, F.lit(0.5)).otherwise(F.least(F.greatest(eta, F.lit(0.0)), F.lit(1.0)))


def doniach_sunjic(x: Value, center: Value, fwhm_l: Value, alpha: float, kinetic: bool = False) -> Column:
    """The core of the asymmetric profile, not normalised; its tail lies on the side of energy loss."""
    a = min(max(alpha, 0.0), 0.9999)
    gamma = F.greatest(c(fwhm_l) / 2, F.lit(1e-10))
    delta = (c(x) - c(center)) if kinetic else (c(center) - c(x))
    phase = math.pi * a / 2 + (1 - a) * F.atan(delta / gamma)
    return math.gamma(1 - a) * F.cos(phase) / F.pow(delta * delta + gamma * gamma, (1 - a) / 2)


def fermi_dirac(x: Value, edge: Value, temperature: Value, kinetic: bool = False) -> Column:
    """Occupation; on a binding axis states above the edge energy are filled."""
    z = (c(x) - c(edge)) / (BOLTZMANN * c(temperature))
    z = z if kinetic else -z
    return 1 / (1 + F.exp(F.least(F.greatest(z, F.lit(-700.0)), F.lit(700.0))))


def gaussian_height(area: Value, fwhm: Value) -> Column:
    return c(area) * FWHM_PER_SIGMA / (c(fwhm) * math.sqrt(2 * math.pi))


def lorentzian_height(area: Value, fwhm: Value) -> Column:
    return c(area) * 2 / (math.pi * c(fwhm))


def gaussian_area(height: Value, fwhm: Value) -> Column:
    return c(height) * c(fwhm) * math.sqrt(2 * math.pi) / FWHM_PER_SIGMA


def lorentzian_area(height: Value, fwhm: Value) -> Column:
    return c(height) * math.pi * c(fwhm) / 2


def pseudo_voigt_height(area: Value, fwhm: Value, eta: Value) -> Column:
    return c(eta) * lorentzian_height(area, fwhm) + (1 - c(eta)) * gaussian_height(area, fwhm)


def pseudo_voigt_area(height: Value, fwhm: Value, eta: Value) -> Column:
    return c(height) / (c(eta) * lorentzian_height(1.0, fwhm) + (1 - c(eta)) * gaussian_height(1.0, fwhm))


def eta_of_widths(sigma: Value, gamma: Value) -> Column:
    """Lorentzian width over Voigt width, of the Gaussian sigma and the Lorentzian half width."""
    w = voigt_width(c(sigma) * FWHM_PER_SIGMA, 2 * c(gamma))
    return F.when(w < 1e-30, F.lit(0.0)).otherwise(2 * c(gamma) / w)


def sigma_of_eta(eta: Value, width: Value) -> Column:
    """Gaussian sigma of a Voigt profile of a given width and Lorentzian share; 0 beyond a pure Lorentzian."""
    left = c(width) - 0.5346 * c(eta) * c(width)
    square = left * left - 0.2166 * F.pow(c(eta) * c(width), 2.0)
    return F.sqrt(F.greatest(square, F.lit(0.0))) / FWHM_PER_SIGMA


SHAPES: dict[str, Callable[..., Column]] = {"gaussian": gaussian, "lorentzian": lorentzian, "pseudo_voigt": pseudo_voigt, "doniach_sunjic": doniach_sunjic}


def register(name: str, profile: Callable[..., Column]) -> None:
    """Makes a profile of one's own known by name."""
    SHAPES[name.lower()] = profile


def gaussian_derivatives(x: Value, center: Value, fwhm: Value) -> tuple[Column, Column, Column]:
    """A Gaussian of area 1 and its derivatives by center and full width."""
    d, w = c(x) - c(center), c(fwhm)
    sigma2 = F.pow(w / FWHM_PER_SIGMA, 2.0)
    g = gaussian(x, center, fwhm)
    return g, g * d / sigma2, g * (d * d / sigma2 - 1) / w


def lorentzian_derivatives(x: Value, center: Value, fwhm: Value) -> tuple[Column, Column, Column]:
    """A Lorentzian of area 1 and its derivatives by center and full width."""
    d, half = c(x) - c(center), c(fwhm) / 2
    under = d * d + half * half
    lor = lorentzian(x, center, fwhm)
    return lor, lor * 2 * d / under, lor * (1 / half - 2 * half / under) / 2


def pseudo_voigt_derivatives(x: Value, center: Value, fwhm: Value, eta: Value) -> tuple[Column, ...]:
    """A pseudo-Voigt profile of area 1 and common width, and its derivatives by center, width and Lorentzian share."""
    g, lor = gaussian_derivatives(x, center, fwhm), lorentzian_derivatives(x, center, fwhm)
    share = c(eta)
    mixed = [share * b + (1 - share) * a for a, b in zip(g, lor)]
    return (*mixed, lor[0] - g[0])


def fermi_edge_derivatives(x: Value, edge: Value, temperature: Value) -> tuple[Column, Column, Column]:
    """The Fermi-Dirac function and its derivatives by edge and temperature."""
    t = (c(x) - c(edge)) / (BOLTZMANN * c(temperature))
    f = 1 / (1 + F.exp(t))
    slope = f * (1 - f)
    return f, slope / (BOLTZMANN * c(temperature)), slope * t / c(temperature)
