"""Shared scratch tables: lineage is cut by writing Parquet to the folder that every executor sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; only where that is unset, a temporary one (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        named = "file://" + tempfile.mkdtemp(prefix="medialake-")
        sc.setCheckpointDir(named)
    return named


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back; survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
