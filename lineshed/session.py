"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per SparkContext.

    Workers then import the operators by name wherever the driver was started.
    """
    sc = spark.sparkContext
    if getattr(sc, "_lineshed_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="lineshed"), "lineshed_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent).as_posix())
    sc.addPyFile(target)
    sc._lineshed_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset, a session of one machine takes a temporary folder; on a cluster that is an error, as
    no task could read what another machine has written there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lineshed-scratch")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str, *partition_cols: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts the lineage.

    A lost executor then costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_cols:
        writer = writer.partitionBy(*partition_cols)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out evenly, some tasks a core, before work that weighs far more than its input: a small file is one task otherwise."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
