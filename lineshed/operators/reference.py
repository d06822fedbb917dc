"""Operators on reference tables: searches, means, withheld cells, splittings, ratios, keys, samples, catalogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineshed.functions.lineshape import Value, c
from lineshed.operators.analyse import cross_section
from lineshed.sources.instruments import EXTENSIONS


def search(table: DataFrame, name: str, text: str) -> DataFrame:
    """Rows whose name holds the text, whatever the case; an empty text finds all."""
    return table.filter(F.contains(F.lower(name), F.lower(F.lit(text))))


def average_row(table: DataFrame, name: str, columns: Sequence[str], stored: str = "AVERAGE") -> DataFrame:
    """One row of properties: the stored one of that name, if the table has it, else the means of the others."""
    own = F.col(name) == stored
    return table.agg(*[F.coalesce(F.max(F.when(own, F.col(x))), F.avg(F.when(~own, F.col(x)))).alias(x) for x in columns])


def withhold(table: DataFrame, cells: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The table with null for the values that `cells` (keys, value) lists as misprints, and `withheld`, whether that is so.

    A cell listed with another value than the printed one is an error: the list was made for another table.
    """
    listed = cells.select(*keys, F.col(value).alias("__listed")).distinct()
    joined = table.join(listed, list(keys), "left")
    wrong = F.col("__listed").isNotNull() & (F.col("__listed") != F.col(value))
    out = F.when(wrong, F.raise_error(F.lit("a withheld cell has another value"))).when(F.col("__listed").isNull(), F.col(value))
    return joined.withColumns({value: out, "withheld": F.col("__listed").isNotNull()}).drop("__listed")


def spin_orbit_split(table: DataFrame, element: str = "element", orbital: str = "orbital", energy: str = "binding_energy") -> DataFrame:
    """(element, shell, split): how far the two lines of a shell such as 2p lie apart; 0 for s, null where one is missing."""
    shell = F.regexp_extract(orbital, "^([0-9][spdf])", 1)
    rows = table.select(element, shell.alias("shell"), F.regexp_extract(orbital, "([0-9])/2$", 1).alias("__j"), F.col(energy).alias("__e")).filter("shell != ''")
    last = F.substring("shell", 2, 1)
    low = F.translate(last, "pdf", "135")
    high = F.translate(last, "pdf", "357")
    ends = rows.groupBy(element, "shell").agg(F.max(F.when(F.col("__j") == low, F.col("__e"))).alias("a"), F.max(F.when(F.col("__j") == high, F.col("__e"))).alias("b"))
    return ends.select(element, "shell", F.when(last == "s", F.lit(0.0)).otherwise(F.abs(F.col("a") - F.col("b"))).alias("split"))


def sensitivity_ratio(pairs: DataFrame, table: DataFrame, x: str = "photon_energy") -> DataFrame:
    """Adds ratio, of the cross-sections of (element, orbital) and (element_2, orbital_2) at x, and both states."""
    first = cross_section(pairs, table, ["element", "orbital"], x).withColumnsRenamed({"value": "__one", "status": "status"})
    other = table.withColumnsRenamed({"element": "element_2", "orbital": "orbital_2"})
    both = cross_section(first.withColumnRenamed("status", "__status"), other, ["element_2", "orbital_2"], x)
    ratio = F.when(F.col("value") != 0, F.col("__one") / F.col("value"))
    return both.withColumn("ratio", ratio).withColumnsRenamed({"__status": "status_1", "status": "status_2"}).drop("__one", "value")


def cache_key(*parameters: Value) -> Column:
    """12 hexadecimal digits that name a set of parameters, in their order."""
    return F.substring(F.md5(F.to_json(F.struct(*[c(p).alias(f"p{k}") for k, p in enumerate(parameters)]), {"ignoreNullFields": "false"})), 1, 12)


def sample_exactly(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same ones whatever the partitions: those whose keys have the least digests.

    Tasks keep n rows each, so nothing is sorted as a whole.
    """
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, modified, format) of all files below a folder, read from their listing alone; format is null where unknown."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    extension = F.lower(F.element_at(F.split("path", "[.]"), -1))
    kinds = F.create_map(*[F.lit(x) for pair in sorted(EXTENSIONS.items()) for x in pair])
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.try_element_at(kinds, extension).alias("format"))
