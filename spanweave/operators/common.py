"""Small helpers of the graph operators: the shared folder, written tables, calendar constants."""

from __future__ import annotations

import re
import tempfile
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession


def seconds_between_epochs() -> int:
    """From the start of year 1 to the start of 1970."""
    return int((datetime(1970, 1, 1) - datetime(1, 1, 1)).total_seconds())


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a local one is set only where spark.checkpoint.dir is unset and Spark runs on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        folder = f"file://{tempfile.mkdtemp(prefix='spanweave-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once in the shared folder and reads it back, which cuts lineage and survives lost executors.

    The shuffle files of the writing query go once it is done, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
