"""The engine's tasks as plain functions with JSON results, for agents and the command line."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineshed.functions import axis, physics
from lineshed.operators import analyse, background, synthetic, templates
from lineshed.operators.kernels import Peaks
from lineshed.sources import instruments


def _json(df: DataFrame) -> str:
    """All rows as a JSON list, fetched a partition at a time."""
    return json.dumps([json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()])


def lookup_binding_energy(table: DataFrame, element: str, orbital: str) -> str:
    """Rows of a table (element, orbital, binding_energy); an orbital without j means its main line."""
    return _json(table.filter((F.col("element") == element) & (F.col("orbital") == axis.main_orbital(F.lit(orbital)))))


def sensitivity(spark: SparkSession, cross_section: float, kinetic_energy: float, valence: float, density: float, weight: float, gap: float) -> str:
    """Cross-section times mean free path, and whether the energy lies in the formula's fitted range."""
    imfp = physics.imfp_tpp2m(kinetic_energy, valence, density, weight, gap)
    return _json(spark.range(1).select(imfp.alias("imfp_nm"), physics.sensitivity(cross_section, imfp).alias("sensitivity"), physics.range_status(kinetic_energy, *physics.TPP2M_RANGE).alias("imfp_range")))


def list_templates(spark: SparkSession) -> str:
    return _json(templates.table(spark))


def fit_file(spark: SparkSession, path: str, kind: str = "shirley") -> str:
    """Reads a file, sums the slices of each region and fits it."""
    rows = instruments.ingest(instruments.read_spectra(spark, path), integrate=True)
    return _json(analyse.auto_fit(rows.select(F.col("region").cast("long").alias("spectrum_id"), "energy", "intensity"), kind))


def round_trip(pixels: DataFrame, peaks: Peaks, mode: str = "precise", levels: tuple[float | None, ...] = (None,)) -> str:
    """PSNR of the channels at each count level; null is without noise."""
    out = [json.loads(_json(synthetic.round_trip(pixels, peaks, mode, level)))[0] | {"counts": level} for level in levels]
    return json.dumps(out)


def backgrounds() -> list[str]:
    return sorted(background.BACKGROUNDS)
