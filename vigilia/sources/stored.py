"""Intermediate results written once to the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under `spark.checkpoint.dir`. Where that is unset, local mode takes its warehouse; a cluster has no folder to fall back on."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """The frame written once and read back, for what several branches of a plan need; a lost executor costs no more than its part of it."""
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
