"""Fit scores as expressions over sums: information criteria, deviance, likelihood, residuals, PSNR."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineshed.functions.lineshape import Value, c


def gaussian_aic(rss: Value, n: Value, k: Value) -> Column:
    return c(n) * F.ln(c(rss) / c(n)) + 2 * c(k)


def aicc_correction(n: Value, k: Value) -> Column:
    """Infinite where there are too few points for it."""
    return F.when(c(n) - c(k) - 1 > 0, 2 * c(k) * (c(k) + 1) / (c(n) - c(k) - 1)).otherwise(F.lit(float("inf")))


def gaussian_bic(rss: Value, n: Value, k: Value) -> Column:
    return c(n) * F.ln(c(rss) / c(n)) + c(k) * F.ln(c(n))


def deviance_term(y: Value, mu: Value) -> Column:
    """A point's part of the Poisson deviance; null where the mean can't have made it."""
    yy, m = c(y), c(mu)
    log = F.when(yy > 0, yy * F.ln(yy / m)).otherwise(F.lit(0.0))
    return F.when((yy >= 0) & ((m > 0) | ((m == 0) & (yy == 0))), 2 * (log - (yy - m)))


def psnr(mean_square: Value, peak: Value) -> Column:
    """In decibels; infinite for equal images."""
    return F.when(c(mean_square) == 0, F.lit(float("inf"))).otherwise(20 * F.log10(c(peak) / F.sqrt(c(mean_square))))


def log_gamma(x: Value) -> Column:
    """The logarithm of the gamma function of x > 0: Stirling's series at x + 8, stepped back."""
    v = c(x)
    z = v + 8
    # The first coefficients of the series, B(2k) / (2k (2k - 1))
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3.0)) + 1 / (1260 * F.pow(z, 5.0)) - 1 / (1680 * F.pow(z, 7.0)) + 1 / (1188 * F.pow(z, 9.0))
    steps = sum((F.ln(v + k) for k in range(1, 8)), F.ln(v))
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - steps


def poisson_log_likelihood_term(y: Value, mu: Value) -> Column:
    """A point's part of the Poisson log-likelihood; null where the mean can't have made it."""
    yy, m = c(y), c(mu)
    return F.when((yy >= 0) & (m > 0), yy * F.ln(m) - m - log_gamma(yy + 1)).when((yy == 0) & (m == 0), F.lit(0.0))


def poisson_aic(log_likelihood: Value, k: Value) -> Column:
    return 2 * c(k) - 2 * c(log_likelihood)


def poisson_bic(log_likelihood: Value, n: Value, k: Value) -> Column:
    return c(k) * F.ln(c(n)) - 2 * c(log_likelihood)


def best_k(df: DataFrame, by: Sequence[str], k: str, criterion: str) -> DataFrame:
    """Adds delta, how far each criterion lies above the group's least, and best; the fewest parameters win ties."""
    least = df.groupBy(*by).agg(F.min(criterion).alias("__least"), F.min_by(k, F.struct(criterion, k)).alias("__k"))
    joined = df.join(least, list(by))
    return joined.withColumns({"delta": F.col(criterion) - F.col("__least"), "best": F.col(k) == F.col("__k")}).drop("__least", "__k")


def whitened(value: Value, expected: Value, spread: Value, kind: str = "std") -> Column:
    """A residual in its standard deviations: spread is a deviation (std), a variance, or expected counts."""
    s = c(spread)
    scale = {"std": s, "variance": F.sqrt(s), "counts": F.sqrt(F.greatest(s, F.lit(1.0)))}[kind]
    return F.when(s > 0 if kind != "counts" else s >= 0, (c(value) - c(expected)) / scale)


def fit_quality(chi2: Value, hessian: tuple[Value, Value, Value]) -> tuple[Column, Column, Column, Column]:
    """Condition, both parameters' deviations and that of the softest mode, from chi2 and a 2 x 2 Hessian (aa, ab, bb)."""
    a, b, d = (c(v) for v in hessian)
    half, root = (a + d) / 2, F.sqrt(F.pow((a - d) / 2, 2.0) + b * b)
    low, det = half - root, a * d - b * b
    fine = low > 0
    x = c(chi2)
    return F.when(fine, (half + root) / low), F.when(fine, F.sqrt(x * d / det)), F.when(fine, F.sqrt(x * a / det)), F.when(fine, F.sqrt(x / low))
