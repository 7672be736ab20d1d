"""What every part needs from the session: importable workers and a shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
ROOT = str(Path(__file__).resolve().parent.parent)


#: Workers give large arrays back to the system as soon as they are freed: they live on between stages, and an executor has several.
WORKER_ENV = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(8 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


#: Rows travel to Python and back in batches of at most so many bytes: by number alone, long texts would make batches of any size.
BATCH_BYTES_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ensure_importable(spark: SparkSession) -> None:
    """Put this checkout on the Python path of the workers started from now on, have them give memory back, and bound their batches."""
    if spark.conf.get(BATCH_BYTES_SETTING) == "67108864b":  # the default; a session's own choice stays
        spark.conf.set(BATCH_BYTES_SETTING, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, known] if known else [ROOT])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that setting is absent and all runs in this one process (local runs and tests) a folder of this machine is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        found = getattr(spark, "_docloom_dir", None) or tempfile.mkdtemp(prefix="docloom-")
        spark._docloom_dir = found
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which clean deletes."""
    _written.append(path := f"{shared_dir(spark)}/docloom/{label}-{uuid.uuid4().hex}")
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._docloom_path = path
    return found


def forget(df: DataFrame) -> None:
    """Delete what materialize wrote for df, once whatever reads it has been written."""
    path = getattr(df, "_docloom_path", None)
    if path in _written:
        _written.remove(path)
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Delete what this process has materialized; results that were not written out yet can no longer be read then."""
    while _written:
        _delete(spark, _written.pop())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
