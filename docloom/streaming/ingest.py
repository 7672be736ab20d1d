"""Continuous conversion of files that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.functions.limits import Options
from docloom.operators.convert import convert
from docloom.sources.files import stream_files


def start(spark: SparkSession, source: str, target: str, checkpoint: str, options: Options | None = None, recognizer: object | None = None, glob: str | None = None, files_per_trigger: int = 1000, once: bool = True, override: str = "auto") -> StreamingQuery:
    """Convert every new file below source once into target/epoch=N.

    The checkpoint remembers which files were seen. An epoch that is run again after a failure overwrites its own folder, so a
    file has one result whatever happens. once: take what is there and stop; else go on.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        done = convert(batch.select("path", "name", "mime", "size", "content"), mime="mime", override=override, options=options, recognizer=recognizer)
        done.withColumn("converted_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    writer = stream_files(spark, source, glob, files_per_trigger).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def results(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)
