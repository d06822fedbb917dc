"""Fits of spectra as they arrive: files in, fitted rows and a running summary out, resumed by checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lineshed.operators.fit import fit, flag_anomalies
from lineshed.operators.kernels import Peaks
from lineshed.session import materialize


def stream_fit(spark: SparkSession, source: str, target: str, checkpoint: str, peaks: Peaks, mode: str = "balanced", files_per_batch: int = 16, key: str = "spectrum_id") -> StreamingQuery:
    """Fits Parquet files of (key, intensity) as they come; anomalies are judged within each micro-batch.

    Every batch is written to its own folder of the target, over what an interrupted attempt left there, so
    a batch that runs again after a failure leaves no second copy.
    """
    schema = f"{key} bigint, intensity array<double>"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        flag_anomalies(materialize(fit(batch, peaks, mode, keep=(key,)), "batch")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query: StreamingQuery, wait: float = 0.5) -> Iterator[dict]:
    """One frame a micro-batch, (batch, rows, rows_per_second), as they end, until the query does; its error is raised."""
    seen = -1
    going = True
    while going:
        going = not query.awaitTermination(wait)
        for p in query.recentProgress:
            if p["batchId"] > seen:
                seen = p["batchId"]
                yield {"batch": seen, "rows": p["numInputRows"], "rows_per_second": p["processedRowsPerSecond"]}


def running_summary(fitted: DataFrame, value: str = "chi2") -> DataFrame:
    """count, mean, population std, bounds and anomalies so far; for tables and, in complete mode, streams."""
    return fitted.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"), F.count_if("is_anomaly").alias("n_anomalies"))


def missing_fits(spectra: DataFrame, fitted: DataFrame, key: str = "spectrum_id") -> DataFrame:
    """What an interrupted run has still to do."""
    return spectra.join(fitted.select(key), key, "left_anti")


def windowed(events: DataFrame, time: str, value: str, width: str = "1 hour", late: str = "2 hours", by: str | None = None) -> DataFrame:
    """Sums over tumbling windows; rows later than the watermark are dropped on a stream."""
    keys = [F.window(time, width).alias("w"), *([F.col(by)] if by else [])]
    return events.withWatermark(time, late).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
