"""Reference tables and stores: long-form lookup tables, result stores, resumable writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_nested_json(spark: SparkSession, path: str) -> DataFrame:
    """element -> orbital -> energy -> value as rows (element, orbital, energy, value); null cells stay null."""
    text = spark.read.text(path, wholetext=True)
    kind = "map<string, map<string, map<string, double>>>"
    rows = text.select(F.explode(F.from_json("value", kind)).alias("element", "a")).select("element", F.explode("a").alias("orbital", "b"))
    return rows.select("element", "orbital", F.explode("b").alias("energy", "value")).withColumn("energy", F.col("energy").cast("double"))


def read_pipe_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of text parted by |, without empty lines and those that start with #.

    A line of another width has nulls and says so in `problem`, which is null for the others.
    """
    cells = F.transform(F.split("value", "\\|"), lambda x: F.trim(x))
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select("value", cells.alias("c"))
    fine = F.size("c") == len(columns)
    problem = F.when(~fine, F.concat(F.size("c").cast("string"), F.lit(f" cells instead of {len(columns)}: "), F.col("value")))
    return rows.select(*[F.when(fine, F.col("c")[k]).alias(name) for k, name in enumerate(columns)], problem.alias("problem"))


def read_transmission(spark: SparkSession, path: str) -> DataFrame:
    """Tab-parted (ratio, transmission), with slit and spot from names such as Slit0p5_spot1x0p3."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("c"), F.input_file_name().alias("f")).filter(F.size("c") >= 2)
    name = F.element_at(F.split("f", "/"), -1)

    def decimal(group: str):
        return F.regexp_replace(F.regexp_extract(name, group, 1), "p", ".").cast("double")

    return rows.select(F.col("c")[0].try_cast("double").alias("ratio"), F.col("c")[1].try_cast("double").alias("transmission"), decimal(r"[Ss]lit(\d+(?:p\d+)?)").alias("slit"), F.regexp_extract(name, r"[Ss]pot([0-9px]+)", 1).alias("spot")).filter("ratio is not null and transmission is not null")


def write_results(df: DataFrame, path: str, key: str = "spectrum_id", rows_per_file: int = 1_000_000) -> None:
    """Sorted files of bounded size, so that ranges of the key are read by their statistics."""
    df.sortWithinPartitions(key).write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(path)


def read_range(spark: SparkSession, path: str, low: int, high: int, key: str = "spectrum_id", step: int = 1) -> DataFrame:
    """Rows low <= key < high, every step-th of them; the bounds reach the Parquet scan."""
    rows = spark.read.parquet(path).filter((F.col(key) >= low) & (F.col(key) < high))
    return rows if step == 1 else rows.filter((F.col(key) - low) % step == 0)


def store_counts(df: DataFrame, intensity: str = "intensity") -> DataFrame:
    """Adds counts, the intensities as integers where all lie in 0 to 65535, else null; they are truncated."""
    fine = (F.array_min(intensity) >= 0) & (F.array_max(intensity) <= 65535)
    return df.withColumn("counts", F.when(fine, F.transform(intensity, lambda x: x.cast("int"))))


def compress_folder(spark: SparkSession, source: str, target: str, codec: str = "zstd") -> DataFrame:
    """Rewrites the instrument files of a folder as compressed Parquet, counts as integers where they are; (bytes_before, bytes_after, spectra).

    Files that can't be read are kept as rows that say why.
    """
    from lineshed.sources.instruments import read_spectra

    rows = store_counts(read_spectra(spark, source))
    rows.withColumn("intensity", F.when(F.col("counts").isNull(), F.col("intensity"))).write.option("compression", codec).mode("overwrite").parquet(target)
    size = lambda path, name: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.sum("length").alias(name))
    return size(source, "bytes_before").crossJoin(size(target, "bytes_after")).crossJoin(spark.read.parquet(target).agg(F.count("*").alias("spectra")))  # one row each
