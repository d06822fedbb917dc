"""Backgrounds of spectra held as arrays, one row a spectrum."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineshed.operators import kernels


def tougaard_loss(intensity: Column, step: float, c: float = 1643.0) -> Column:
    """The loss integral before scaling, point by point, without Python workers."""

    def at(_, k):
        upto = F.slice(intensity, 1, k + 1)
        return F.aggregate(F.transform(upto, lambda y, j: y * ((k - j) * step) / F.pow(c + F.pow((k - j) * step, 2.0), 2.0)), F.lit(0.0), lambda a, x: a + x)

    return F.transform(intensity, at)


def linear(energy: np.ndarray, intensity: np.ndarray) -> np.ndarray:
    return intensity[0] + (intensity[-1] - intensity[0]) * (energy - energy[0]) / (energy[-1] - energy[0])


def constant(energy: np.ndarray, intensity: np.ndarray) -> np.ndarray:
    return np.full(len(intensity), min(intensity[0], intensity[-1]), dtype=np.float64)


BACKGROUNDS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"linear": linear, "constant": constant, "shirley": kernels.shirley, "tougaard": kernels.tougaard}


def register(name: str, function: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Makes a background of one's own known by name."""
    BACKGROUNDS[name] = function


def subtract(df: DataFrame, kind: str, energy: str = "energy", intensity: str = "intensity") -> DataFrame:
    """Adds background and net, arrays as long as the intensity; null arrays give null."""
    find = BACKGROUNDS[kind]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            curves, nets = [], []
            for e, y in zip(pdf[energy], pdf[intensity]):
                if e is None or y is None or len(y) < 2:
                    curves.append(None)
                    nets.append(None)
                    continue
                y = np.asarray(y, dtype=np.float64)
                curves.append(find(np.asarray(e, dtype=np.float64), y))
                nets.append(y - curves[-1])
            yield pdf.assign(background=curves, net=nets)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", background array<double>, net array<double>"
    return df.mapInPandas(run, schema)
