"""What was done to a file's spectra: typed facts with origins, a log of transforms, allowed vendor fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORIGINS = ("file", "user", "inferred")
ALLOWED = ("Region Name", "Lens Mode", "Pass Energy", "Energy Scale", "Number of Sweeps", "Acquisition Mode", "source_energy", "pass_energy", "analyser_mode", "transition_label", "species_label")


def allow(metadata: Column, names: Sequence[str] = ALLOWED) -> Column:
    """The metadata without fields that aren't allowed, such as users and paths."""
    return F.map_filter(metadata, lambda k, _: k.isin(*names))


def fact(value: Column, origin: str) -> Column:
    """A value and where it comes from; an unknown value stays null."""
    if origin not in ORIGINS:
        raise ValueError(f"origin must be one of {ORIGINS}")
    return F.struct(value.cast("string").alias("value"), F.when(value.isNotNull(), F.lit(origin)).alias("origin"))


def log(df: DataFrame, name: str, parameters: dict[str, object], source: str, reason: str) -> DataFrame:
    """Appends a transform to the column `transforms`, which is made if there is none."""
    step = F.struct(
        F.lit(name).alias("name"),
        F.create_map(*[F.lit(str(x)) for kv in parameters.items() for x in kv]).cast("map<string, string>").alias("parameters"),
        F.lit(source).alias("source"),
        F.lit(reason).alias("reason"),
    )
    if "transforms" not in df.columns:
        return df.withColumn("transforms", F.array(step))
    return df.withColumn("transforms", F.array_append("transforms", step))
