"""Quantification: areas over sensitivities, normalised, refused with reasons where inputs don't allow it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def beside(df: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """Each row with aggregates of its group.

    Aggregates are taken partially before the shuffle and joined back, so that a group with very many rows
    isn't gathered in one task, as a window would.
    """
    return df.join(df.groupBy(*by).agg(*[a.alias(name) for name, a in aggregates.items()]), list(by))


def shares(df: DataFrame, weight: str, by: Sequence[str], out: str = "fraction") -> DataFrame:
    """Each row's weight over its group's; null unless all weights of the group are positive."""
    rows = beside(df, by, __sum=F.sum(weight), __fine=F.min(F.coalesce(F.col(weight) > 0, F.lit(False))))
    return rows.withColumn(out, F.when(F.col("__fine"), F.col(weight) / F.col("__sum"))).drop("__sum", "__fine")


def composition(lines: DataFrame, sample: str = "sample", element: str = "element", area: str = "area", cross_section: str = "cross_section", imfp: str = "imfp", assumed: str | None = None) -> DataFrame:
    """Adds fraction, status and reasons to the lines of each sample.

    A sample is refused if a line has no positive area, cross-section or path, or if an element has two
    lines; it is conditional if any line says so in the column `assumed`.
    """
    w = Window.partitionBy(sample)
    again = F.count("*").over(Window.partitionBy(sample, element)) > 1
    problems = F.filter(
        F.array(
            F.when(~F.coalesce(F.col(area) > 0, F.lit(False)), F.concat(element, F.lit(": net area is not positive"))),
            F.when(~F.coalesce(F.col(cross_section) > 0, F.lit(False)), F.concat(element, F.lit(": no cross-section"))),
            F.when(~F.coalesce(F.col(imfp) > 0, F.lit(False)), F.concat(element, F.lit(": no mean free path"))),
            F.when(again, F.concat(element, F.lit(": more than one line"))),
        ),
        lambda p: p.isNotNull(),
    )
    rows = lines.withColumn("__p", problems).withColumn("reasons", F.array_sort(F.array_distinct(F.flatten(F.collect_list("__p").over(w)))))
    weight = F.col(area) / (F.col(cross_section) * F.col(imfp))
    refused = F.size("reasons") > 0
    doubt = F.max(F.col(assumed).cast("int")).over(w) == 1 if assumed else F.lit(False)
    return rows.withColumn("fraction", F.when(~refused, weight / F.sum(weight).over(w))).withColumn("status", F.when(refused, "refused").when(doubt, "conditional").otherwise("inputs_stated")).drop("__p")


def condition_dependence(df: DataFrame, value: str, condition: str, baseline: str, by: Sequence[str]) -> DataFrame:
    """By group: the baseline's value, and the least and largest change under the other conditions."""
    base = F.max(F.when(F.col(condition) == baseline, F.col(value)))
    s = df.groupBy(*by).agg(base.alias("base"), F.min(value).alias("__low"), F.max(value).alias("__high"))
    return s.withColumn("low_change", F.col("__low") - F.col("base")).withColumn("high_change", F.col("__high") - F.col("base")).drop("__low", "__high")


def weibull_quantile(df: DataFrame, value: str, q: float, by: Sequence[str]) -> DataFrame:
    """The quantile at plotting positions k / (n + 1), as replicates of a bootstrap need it.

    Rows are ranked by a sort that can spill, and only the two about the position are kept.
    """
    rows = beside(df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v")), by, __n=F.count("*"))
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__v")))
    place = F.least(F.greatest(F.lit(q) * (F.col("__n") + 1), F.lit(1.0)), F.col("__n").cast("double"))
    about = ranked.withColumn("__p", place).filter((F.col("__r") >= F.floor("__p")) & (F.col("__r") <= F.floor("__p") + 1))
    ends = about.groupBy(*by).agg(F.min("__v").alias("__a"), F.max("__v").alias("__b"), F.first("__p").alias("__p"))
    return ends.select(*by, (F.col("__a") + (F.col("__p") - F.floor("__p")) * (F.col("__b") - F.col("__a"))).alias("quantile"))


def detector_gain(df: DataFrame, sweep: str, channel: str, value: str) -> DataFrame:
    """gain and offset: the line of half the squared differences of adjacent sweeps against the channel means."""
    totals = df.groupBy(sweep).agg(F.sum(value).alias("__t"))
    mean_total = totals.agg(F.avg("__t").alias("__m"))
    scaled = df.join(totals, sweep).crossJoin(F.broadcast(mean_total)).withColumn("__x", F.col(value) / (F.col("__t") / F.col("__m")))
    step = F.col("__x") - F.lag("__x").over(Window.partitionBy(channel).orderBy(sweep))
    per_channel = scaled.withColumn("__d", step * step / 2).groupBy(channel).agg(F.avg("__x").alias("mean"), F.avg("__d").alias("half_var"))
    return per_channel.agg(F.regr_slope("half_var", "mean").alias("gain"), F.regr_intercept("half_var", "mean").alias("offset"), F.count("*").alias("n_channels"))
