"""Stored layouts: folders of days that are rewritten one by one, and bucketed tables that join without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def write_days(frame: DataFrame, path: str, day: str = "day", files: int = 1) -> None:
    """Parquet in a folder per day; days that the frame has are replaced, all others stay as they are.

    Rows are dealt by day first, so that a day is `files` files at most,
    whatever the frame's partitions.
    """
    part = F.pmod(F.xxhash64(*frame.columns), F.lit(files))
    frame.repartition(day, part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def read_days(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, day: str = "day", schema: str | None = None) -> DataFrame:
    """The days from `first` to `last`, both counted; folders of other days are not opened."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.parquet(path)
    if first is not None:
        rows = rows.where(F.col(day) >= F.lit(first).cast("date"))
    return rows if last is None else rows.where(F.col(day) <= F.lit(last).cast("date"))


def save_bucketed(frame: DataFrame, name: str, by: list[str], buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """A table in `buckets` buckets of the columns `by`, sorted inside: two tables of as many buckets join on these columns, and group by them, without an exchange.

    Rows are dealt to the buckets first, so there is a file per bucket, not one
    per task and bucket. Tables that join on (actor, value) are bucketed by both,
    which also keeps an actor with most rows from being one bucket.
    """
    writer = frame.repartition(buckets, *by).write.mode("overwrite").format("parquet").bucketBy(buckets, *by).sortBy(*by)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return frame.sparkSession.table(name)
