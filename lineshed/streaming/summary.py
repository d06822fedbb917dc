"""Running summaries: the same aggregate for a table and for a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summarize(df: DataFrame, value: str, by: Sequence[str], over: Column) -> DataFrame:
    """n, mean, std (population), low, high and n_over, how many rows meet the condition."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"), F.count_if(over).alias("n_over")
    )
