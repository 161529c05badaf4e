"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import pickle
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder, as a full URI, under `spark.checkpoint.dir`, which all executors share. Without that setting only local mode has one: a folder of its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def cut(frame: DataFrame) -> DataFrame:
    """The frame written once to the shared folder and read back: its lineage ends there and outlives lost executors."""
    path = shared_dir(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each followed by as many underscores as keep it apart from those taken (Spark does not tell capital letters)."""
    lower, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in lower:
            name += "_"
        lower.add(name.lower())
        out.append(name)
    return out


def one_a_key(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, columns) of one row for each key, that whose first column hashes lowest: a sample stays bounded where a key repeats."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row")).select(key, *(f"_row.{c}" for c in columns))


def lowest(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows whose keys hash lowest: a sample that does not depend on how the rows are dealt.

    Rows beyond a bound of the hash that leaves about twice as many are dropped
    where they stand, so the sort sees a few times n rows, not n from each task.
    """
    total, h = rows.count(), F.xxhash64(key)
    if total > 4 * n:
        rows = rows.where(h < int(2 * n / total * 2**64) - 2**63)
    return rows.orderBy(h, key).limit(n)


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo `modulus`; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def _release() -> None:
    """Give freed memory back to the system: the C library keeps it in a worker process, which later tasks use again."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(frame: DataFrame, function, schema: str) -> DataFrame:
    """`mapInArrow` for functions of this package, which executors need not have installed."""
    _ship(frame.sparkSession)

    def run(batches):
        yield from function(batches)
        _release()

    return frame.mapInArrow(run, schema)


def train_in_task(rows: DataFrame, order: list[str], train):
    """`train(batches)` over a bounded sample in the given order, run by one task so that the driver holds the model alone."""

    def run(batches):
        model = pickle.dumps(train(batches))
        _release()
        yield pa.RecordBatch.from_pydict({"model": pa.array([model], pa.binary())})

    got = arrow_map(rows.repartition(1).sortWithinPartitions(*order), run, "model binary").collect()
    return pickle.loads(bytes(got[0].model)) if got else train(iter(()))  # a plan that is known to be empty runs no task


def _ship(spark: SparkSession) -> None:
    """Add the package's source to the application once, as with `spark-submit --py-files`."""
    context = spark.sparkContext
    if getattr(context, "_vigilia_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    name = os.path.join(tempfile.mkdtemp(prefix="spark-"), "vigilia_src.zip")
    with zipfile.ZipFile(name, "w") as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, source.relative_to(top.parent).as_posix())
    context.addPyFile(name)
    context._vigilia_shipped = True
