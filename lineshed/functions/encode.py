"""Linear encodings as column expressions: Fisher coordinates, images as amplitudes and back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineshed.functions.codec import hilbert_cell, hilbert_index
from lineshed.functions.lineshape import Value, c


def linear_map(matrix: np.ndarray, columns: list[Value], offset: np.ndarray | None = None) -> list[Column]:
    """matrix @ (columns - offset), one column a row of the matrix."""
    shifted = [c(v) - float(offset[k]) if offset is not None else c(v) for k, v in enumerate(columns)]
    return [sum((float(w) * v for w, v in zip(row[1:], shifted[1:])), float(row[0]) * shifted[0]) for row in np.asarray(matrix, dtype=np.float64)]


def fisher_coordinates(fisher: np.ndarray, columns: list[Value], reference: np.ndarray) -> list[Column]:
    """Coordinates in which distances count in standard deviations: L'(theta - reference) of the Cholesky factor."""
    return linear_map(np.linalg.cholesky(np.asarray(fisher)).T, columns, reference)


def of_fisher_coordinates(fisher: np.ndarray, columns: list[Value], reference: np.ndarray) -> list[Column]:
    back = linear_map(np.linalg.inv(np.linalg.cholesky(np.asarray(fisher)).T), columns)
    return [v + float(reference[k]) for k, v in enumerate(back)]


def fisher_hilbert(fisher: np.ndarray, columns: list[Value], reference: np.ndarray, half: float, order: int) -> Column:
    """One index for parameters: Fisher coordinates within half either way, on a grid of 2^order a side, along a Hilbert curve.

    Neighbouring indices are then parameters that the data can hardly tell apart; values beyond are held to the ends.
    """
    cells = 1 << order
    at = [F.least(F.greatest(F.floor((u + half) / (2 * half) * cells), F.lit(0)), F.lit(cells - 1)).cast("bigint") for u in fisher_coordinates(fisher, columns, reference)]
    return hilbert_index(at, order)


def of_fisher_hilbert(fisher: np.ndarray, index: Column, reference: np.ndarray, half: float, order: int) -> list[Column]:
    """The parameters at the middle of an index's cell."""
    n = len(reference)
    cell = hilbert_cell(index, order, n)
    middle = [(cell[f"v{k}"] + 0.5) / (1 << order) * 2 * half - half for k in range(n)]
    return of_fisher_coordinates(fisher, middle, reference)


def image_amplitudes(pixels: DataFrame, colours: np.ndarray, rgb: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """Adds a0, a1, ...: non-negative amplitudes of elements whose colours are the columns of a 3 x n matrix.

    The pseudo-inverse maps pixels to amplitudes; all are scaled so that the largest is 1.
    """
    raw = linear_map(np.linalg.pinv(colours), list(rgb))
    n = len(raw)
    mapped = pixels.withColumns({f"a{k}": F.greatest(v, F.lit(0.0)) for k, v in enumerate(raw)})
    top = mapped.agg(F.greatest(*[F.max(f"a{k}") for k in range(n)], F.lit(0.0)).alias("__top"))  # one row
    scaled = mapped.crossJoin(F.broadcast(top))
    return scaled.withColumns({f"a{k}": F.when(F.col("__top") > 0, F.col(f"a{k}") / F.col("__top")).otherwise(F.lit(0.0)) for k in range(n)}).drop("__top")


def poisson_mean(intensity: Column, level: float, peak: Column | None = None) -> Column:
    """The mean counts of a noise level: (10^4 / level)^2 times the share of the peak; a level of 0 has none."""
    scale = (1e4 / level) ** 2
    top = peak if peak is not None else F.array_max(intensity)
    return F.transform(intensity, lambda x: F.greatest(x / top, F.lit(0.0)) * scale)


def pack_channels(r: Value, g: Value, b: Value) -> Column:
    """Three channels in 24 bits."""
    return c(r).cast("int") * 65536 + c(g).cast("int") * 256 + c(b).cast("int")
