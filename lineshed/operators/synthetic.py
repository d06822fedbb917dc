"""Synthetic spectra and the round trip parameters -> spectra -> fit -> parameters.

Noise is seeded by the spectrum's id, so a spectrum is the same however rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineshed.operators import kernels
from lineshed.operators.kernels import Peaks


#: Lines to make spectra of: sigma, gamma, and the partner's distance and the ratio to it. Fixed values of common lines.
PRESETS: dict[str, dict[str, float]] = {
    "Si2p": {"sigma": 0.55, "gamma": 0.10, "split": 0.608, "ratio": 2.0},
    "O1s": {"sigma": 0.70, "gamma": 0.05, "split": 0.0, "ratio": 1.0},
    "Au4f": {"sigma": 0.55, "gamma": 0.30, "split": 3.70, "ratio": 4 / 3},
    "C1s": {"sigma": 0.60, "gamma": 0.05, "split": 0.0, "ratio": 1.0},
}


def register_preset(name: str, sigma: float, gamma: float, split: float = 0.0, ratio: float = 1.0) -> None:
    """Makes a line of one's own known by name."""
    PRESETS[name] = {"sigma": sigma, "gamma": gamma, "split": split, "ratio": ratio}


def preset(name: str, energy: np.ndarray, centers: tuple[float, ...], **more) -> Peaks:
    """Peaks of a known line at the centers."""
    p = PRESETS[name]
    return Peaks(energy, tuple(centers), (p["sigma"],) * len(centers), p["gamma"], p["split"], p["ratio"], **more)


def generate(parameters: DataFrame, peaks: Peaks, noise: float = 0.0, poisson: float | None = None, seed: int = 0, key: str = "spectrum_id") -> DataFrame:
    """Adds intensity to rows (key, amplitudes, shift, width): a single shift and width for all components.

    noise is the standard deviation of Gaussian noise; poisson a count scale: intensities become counts of
    mean scale x intensity / (peak of the spectrum), scaled back.
    """
    centers, sigmas = np.array(peaks.centers), np.array(peaks.sigmas)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.to_pandas()
            a = np.stack(t["amplitudes"].to_numpy())
            x = peaks.energy[None, :, None] - centers - t["shift"].to_numpy()[:, None, None]
            s = sigmas + t["width"].to_numpy()[:, None, None]
            y = np.zeros((len(t), len(peaks.energy)))
            for at, part in ((0.0, 1.0), (peaks.split, 1 / peaks.ratio)) if peaks.split else ((0.0, 1.0),):
                v = kernels.faddeeva((x - at + 1j * peaks.gamma) / (s * np.sqrt(2))).real / (s * np.sqrt(2 * np.pi))
                y += part * np.einsum("nec,nc->ne", v, a)
            for row, k in enumerate(t[key].tolist()):
                rng = np.random.default_rng([seed, k])
                if poisson is not None and y[row].max() > 0:
                    scale = poisson / y[row].max()
                    y[row] = rng.poisson(np.maximum(y[row], 0) * scale) / scale
                if noise:
                    y[row] += rng.normal(0, noise, y.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(y), type=pa.list_(pa.float64()))], names=[*batch.schema.names, "intensity"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parameters.schema) + ", intensity array<double>"
    return parameters.mapInArrow(run, schema)


def parameters_of_pixels(pixels: DataFrame, peaks: Peaks, key: str = "spectrum_id", reach: tuple[float, float] = (0.3, 0.1)) -> DataFrame:
    """(key, amplitudes, shift, width) of channels r, g, b in 0 to 255: amplitude, shift, width."""
    amplitude = 0.1 + 0.9 * F.col("r") / 255
    n = len(peaks.centers)
    return pixels.select(
        key,
        F.array(*[amplitude / (k + 1) for k in range(n)]).alias("amplitudes"),
        (reach[0] * (2 * F.col("g") / 255 - 1)).alias("shift"),
        (reach[1] * (2 * F.col("b") / 255 - 1)).alias("width"),
    )


def pixels_of_parameters(fitted: DataFrame, key: str = "spectrum_id", reach: tuple[float, float] = (0.3, 0.1)) -> DataFrame:
    """The channels back, rounded to the nearest level."""

    def level(t):
        return F.bround(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")

    return fitted.select(
        key, level((F.col("amplitudes")[0] - 0.1) / 0.9).alias("r"), level((F.col("shift") / reach[0] + 1) / 2).alias("g"), level((F.col("width") / reach[1] + 1) / 2).alias("b")
    )


def round_trip(pixels: DataFrame, peaks: Peaks, mode: str = "precise", poisson: float | None = None, key: str = "spectrum_id") -> DataFrame:
    """PSNR in decibels of each channel after encode, generate, fit and decode."""
    from lineshed.functions.scores import psnr
    from lineshed.operators.fit import fit

    spectra = generate(parameters_of_pixels(pixels, peaks, key), peaks, poisson=poisson, key=key)
    back = pixels_of_parameters(fit(spectra, peaks, mode, keep=(key,)), key)
    both = pixels.alias("a").join(back.alias("b"), key)
    errors = [F.avg(F.pow(F.col(f"a.{x}") - F.col(f"b.{x}"), 2.0)).alias(x) for x in "rgb"]
    return both.agg(*errors).select(*[F.round(psnr(x, 255.0), 2).alias(f"psnr_{x}") for x in "rgb"])
