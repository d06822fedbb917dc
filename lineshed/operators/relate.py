"""Joins: lookups, nearest earlier fits, merges of refined rows, dictionary matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    """Left join of a reference table; status says tabulated or not_in_table."""
    marked = table.withColumn("__found", F.lit(True))
    return df.join(marked, list(keys), "left").withColumn(status, F.when(F.col("__found"), "tabulated").otherwise("not_in_table")).drop("__found")


def nearest(df: DataFrame, cache: DataFrame, index: str, cached_index: str, by: Sequence[str] = (), most: int = 10) -> DataFrame:
    """For each row the cached index nearest to its own at a distance of 1 to `most`; ahead wins ties.

    An equi-join over blocks of `most` indices, each row meeting three blocks, instead of a range join.
    """
    left = df.withColumn("__block", F.explode(F.array(*[F.floor(F.col(index) / most) + d for d in (-1, 0, 1)])))
    right = cache.select(*by, F.col(cached_index).alias("__cached"), F.floor(F.col(cached_index) / most).alias("__block"))
    step = F.col("__cached") - F.col(index)
    hits = left.join(right, [*by, "__block"]).filter((F.abs(step) >= 1) & (F.abs(step) <= most))
    best = hits.groupBy(*by, index).agg(F.min_by(F.col("__cached"), F.struct(F.abs(step), -step)).alias("inherited_from"))
    return df.join(best, [*by, index], "left")


def merge(base: DataFrame, refined: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Values of refined where it has the row, else those of base."""
    r = refined.select(key, *[F.col(x).alias(f"__{x}") for x in columns])
    out = base.join(r, key, "left")
    return out.withColumns({x: F.coalesce(f"__{x}", x) for x in columns}).drop(*[f"__{x}" for x in columns])


def upsert(base: DataFrame, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of base that changed doesn't have, and all of changed."""
    return base.join(changed, list(keys), "left_anti").unionByName(changed)


def missing(requested: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    return requested.join(cache, list(keys), "left_anti")


def wanted(rows: DataFrame, flagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(flagged, list(keys), "left_semi")


def dictionary_match(df: DataFrame, vector: str, dictionary: Sequence[Sequence[float]]) -> DataFrame:
    """Adds dict_idx and score of the dictionary column with the largest dot product; the first wins ties.

    The dictionary is a driver-side parameter and becomes a literal; large ones go through the Arrow
    operators in lineshed.operators.fit.
    """
    literal = F.array(*[F.array(*[F.lit(float(x)) for x in d]) for d in dictionary])
    scores = F.transform(literal, lambda d: F.aggregate(F.zip_with(F.col(vector), d, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x))
    with_scores = df.withColumn("__s", scores)
    return with_scores.withColumn("score", F.array_max("__s")).withColumn("dict_idx", (F.array_position("__s", F.col("score")) - 1).cast("int")).drop("__s")


def pairs_within(df: DataFrame, key: str, value: str, most: float) -> DataFrame:
    """Pairs a < b by key whose values differ by at most `most`, by an equi-join over cells of that width."""
    cell = F.floor(F.col(value) / most)
    a = df.select(F.col(key).alias("a"), F.col(value).alias("va"), cell.alias("__c"))
    b = df.select(F.col(key).alias("b"), F.col(value).alias("vb"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("__c"))
    return a.join(b, "__c").filter((F.col("a") < F.col("b")) & (F.abs(F.col("va") - F.col("vb")) <= most)).select("a", "b", F.abs(F.col("va") - F.col("vb")).alias("distance"))


def log_log(df: DataFrame, table: DataFrame, x: str, grid: str, value: str, by: Sequence[str]) -> DataFrame:
    """Linear interpolation of a tabulated value in logarithms, held to the ends of the grid.

    The grid becomes intervals, and each row meets the interval it lies in: the keys are equi-joined, so
    a row meets only its own key's few intervals.
    """
    w = Window.partitionBy(*by).orderBy(grid)
    cells = table.select(
        *by,
        F.col(grid).alias("__x0"),
        F.col(value).alias("__y0"),
        F.lead(grid).over(w).alias("__x1"),
        F.lead(value).over(w).alias("__y1"),
        F.min(grid).over(Window.partitionBy(*by)).alias("__low"),
        F.max(grid).over(Window.partitionBy(*by)).alias("__high"),
    )
    held: Column = F.least(F.greatest(F.col(x), F.col("__low")), F.col("__high"))
    inside = (held >= F.col("__x0")) & (F.col("__x1").isNull() | (held < F.col("__x1")))
    t = (F.ln(held) - F.ln("__x0")) / (F.ln("__x1") - F.ln("__x0"))
    out = F.when(F.col("__x1").isNull(), F.col("__y0")).otherwise(F.exp(F.ln("__y0") + t * (F.ln("__y1") - F.ln("__y0"))))
    return df.join(cells, list(by)).filter(inside).withColumn("interpolated", out).drop("__x0", "__y0", "__x1", "__y1", "__low", "__high")


def pair_doublets(components: DataFrame, split: float, ratio: float, by: str = "spectrum_id", comp: str = "comp", center: str = "center", area: str = "area", most_off: float = 0.15, ratio_off: float = 0.35) -> DataFrame:
    """(by, main, partner, off): pairs of peaks `split` apart whose areas stand in about the doublet's ratio.

    split and ratio are those of the partner against the main line, both off by no more than their bounds.
    off adds the distance from the split and the relative distance from the ratio. A pair stands if each of
    the two is the other's best partner; the lower numbers win ties. Peaks of a spectrum are few, so the
    equi-join on the spectrum meets only these.
    """
    main = components.select(by, F.col(comp).alias("main"), F.col(center).alias("__c1"), F.col(area).alias("__a1"))
    partner = components.select(by, F.col(comp).alias("partner"), F.col(center).alias("__c2"), F.col(area).alias("__a2"))
    apart = F.abs(F.col("__c2") - F.col("__c1") - split)
    unlike = F.abs(F.col("__a1") / F.col("__a2") / ratio - 1)
    near = main.join(partner, by).filter((F.col("main") != F.col("partner")) & (F.col("__a2") > 0) & (apart <= most_off) & (unlike <= ratio_off)).select(by, "main", "partner", (apart + unlike).alias("off"))
    first = near.groupBy(by, "main").agg(F.min_by(F.struct("partner", "off"), F.struct("off", "partner")).alias("x")).select(by, "main", "x.*")
    back = near.groupBy(by, "partner").agg(F.min_by("main", F.struct("off", "main")).alias("main")).select(by, "main", "partner")
    return first.join(back, [by, "main", "partner"], "left_semi")
