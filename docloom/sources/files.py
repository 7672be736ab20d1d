"""Files as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.limits import FORMATS, MAX_FILE_BYTES

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
ACCEPT = "*.{" + ",".join(e for f in FORMATS for e in f.extensions) + "}"


def _named(raw: DataFrame) -> DataFrame:
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(None).cast("string").alias("mime"), F.col("length").alias("size"), "modificationTime", "content")


def read_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True, largest: int | None = None) -> DataFrame:
    """path, name, mime, size, modificationTime, content of the files below a path; `largest` is pushed into the scan."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return _named(raw if largest is None else raw.where(F.col("length") <= largest))


def stream_files(spark: SparkSession, path: str, glob: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """The same as a stream: every new file once."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger)
    return _named((reader.option("pathGlobFilter", glob) if glob else reader).load(path))


def size_report(files: DataFrame) -> DataFrame:
    """Counts and bytes, and how many files are over the limit; contents are not read."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(F.col("size") > MAX_FILE_BYTES).alias("too_large"))
