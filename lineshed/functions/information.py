"""Fisher information, covariances and steps of least squares as aggregates: sums over a spectrum's points.

Derivatives are columns of point rows; matrices are structs of their upper triangles, named m00, m01, m11
and so on, so every result is one aggregation per spectrum without Python workers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineshed.functions.lineshape import Value, c


def gram(derivatives: Sequence[Value], weight: Value) -> Column:
    """Sums of weight times each product of derivatives: an aggregate."""
    j = [c(d) for d in derivatives]
    return F.struct(*[F.sum(c(weight) * j[a] * j[b]).alias(f"m{a}{b}") for a in range(len(j)) for b in range(a, len(j))])


def poisson_fisher(derivatives: Sequence[Value], mean: Value, least: float = 1e-12) -> Column:
    """The information of counts of this mean about the parameters: an aggregate."""
    return gram(derivatives, 1 / F.greatest(c(mean), F.lit(least)))


def effective(fisher: Column) -> tuple[Column, Column]:
    """Of a 2 x 2 matrix what is known of each parameter with the other unknown: the Schur complements."""
    a, b, d = fisher["m00"], fisher["m01"], fisher["m11"]
    return F.when(d > 0, a - b * b / d), F.when(a > 0, d - b * b / a)


def inverse_2(m: Column) -> Column:
    """The inverse of a symmetric 2 x 2 matrix; null where it is singular."""
    a, b, d = m["m00"], m["m01"], m["m11"]
    det = a * d - b * b
    return F.when(det > 0, F.struct((d / det).alias("m00"), (-b / det).alias("m01"), (a / det).alias("m11")))


def sandwich_2(normal: Column, middle: Column) -> Column:
    """Covariance of weighted least squares whose weights aren't the inverse variances.

    normal sums w J J', middle w^2 v J J' with the points' true variances v.
    """
    n = inverse_2(normal)
    a, b, d = n["m00"], n["m01"], n["m11"]
    p, q, r = middle["m00"], middle["m01"], middle["m11"]
    return F.when(
        n.isNotNull(),
        F.struct(
            (a * a * p + 2 * a * b * q + b * b * r).alias("m00"),
            (a * b * p + (a * d + b * b) * q + b * d * r).alias("m01"),
            (b * b * p + 2 * b * d * q + d * d * r).alias("m11"),
        ),
    )


def gradient(derivatives: Sequence[Value], rest: Value, weight: Value) -> Column:
    """Sums of weight times derivative times residual: an aggregate."""
    return F.struct(*[F.sum(c(weight) * c(d) * c(rest)).alias(f"g{k}") for k, d in enumerate(derivatives)])


def damped_step_2(normal: Column, slope: Column, damping: Value) -> Column:
    """The step of two parameters that solves (H + damping diag H) step = g, and what it should gain."""
    a, b, d = normal["m00"], normal["m01"], normal["m11"]
    more = 1 + c(damping)
    det = a * more * d * more - b * b
    x = (d * more * slope["g0"] - b * slope["g1"]) / det
    y = (a * more * slope["g1"] - b * slope["g0"]) / det
    gain = slope["g0"] * x + slope["g1"] * y - (a * x * x + 2 * b * x * y + d * y * y) / 2
    return F.when(det > 0, F.struct(x.alias("d0"), y.alias("d1"), gain.alias("gain")))


def efficiency(estimate: Value, truth: Value, bound: Value) -> Column:
    """The bound's variance over the mean squared error of estimates: an aggregate; 1 for the best there can be."""
    error = c(estimate) - c(truth)
    return F.try_divide(F.avg(c(bound) * c(bound)), F.avg(error * error))
