"""Model files for recognition: checked by size and digest, never fetched over a network."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.limits import MODEL_BYTES, ConversionError
from docloom.operators.batch import evicted_oldest_first, live, retained


@dataclass(frozen=True)
class Model:
    id: str
    bytes: int
    sha256: str
    language: str | None = None


def check_model(model: Model, data: bytes | None) -> bytes:
    """The bytes, if they are the model's."""
    from hashlib import sha256

    if data is None:
        raise ConversionError("MODEL_UNAVAILABLE", "OCR models are not available offline. Provide the model files and retry.")
    if model.bytes > MODEL_BYTES:
        raise ConversionError("MODEL_BUDGET", "The model exceeds the model storage budget.")
    if len(data) != model.bytes or sha256(data).hexdigest() != model.sha256:
        raise ConversionError("MODEL_INTEGRITY", "The model file does not match its pinned size and digest.")
    return data


def load_models(spark: SparkSession, path: str, catalogue: list[Model]) -> DataFrame:
    """id, bytes, language, content of the catalogue's models found below a path; a file that is not what its entry says has a null content."""
    known = spark.createDataFrame([(m.id, m.bytes, m.sha256, m.language) for m in catalogue], "id string, bytes bigint, sha256 string, language string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("id"), "content")
    good = (F.octet_length("content") == F.col("bytes")) & (F.sha2("content", 256) == F.col("sha256"))
    return files.join(F.broadcast(known), "id").select("id", "bytes", "language", F.when(good, F.col("content")).alias("content"))


def model_set(catalogue: list[Model], language: str) -> list[Model]:
    """The detector and what a language needs."""
    return [m for m in catalogue if m.language in (None, language)]


def supported(records: DataFrame, catalogue: list[Model]) -> DataFrame:
    """Stored records that the catalogue still has."""
    return records.where(F.col("id").isin([m.id for m in catalogue]))


def model_stats(records: DataFrame) -> DataFrame:
    """(count, bytes); the models' data is not read."""
    return records.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def kept(records: DataFrame, catalogue: list[Model] | None, at: int, hours: int = 24, budget: int = MODEL_BYTES) -> DataFrame:
    """Stored records (id, bytes, created_at) that stay: known to the catalogue (None: all are), not older than `hours`, and, newest first, within the budget."""
    known = records if catalogue is None else supported(records, catalogue)
    return retained(live(known, at, hours), budget, id_col="id")


class ModelStore:
    """Model files kept below a path that all executors reach, by identifier."""

    SCHEMA = "id string, bytes bigint, language string, created_at bigint, content binary"

    def __init__(self, spark: SparkSession, root: str, catalogue: list[Model]):
        self.spark, self.path, self.catalogue = spark, f"{root.rstrip('/')}/models", catalogue

    def records(self) -> DataFrame:
        """All that is stored; of an identifier the last."""
        try:
            rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self.SCHEMA)
        newest = rows.groupBy("id").agg(F.max("created_at").alias("created_at"))
        return rows.join(F.broadcast(newest), ["id", "created_at"]).select(*rows.columns)  # of a catalogue's few models

    def get(self, model: Model, at: int, hours: int = 24) -> bytes | None:
        """A model's bytes, unless they are too old or not what the catalogue says."""
        row = live(self.records().where(F.col("id") == model.id), at, hours).select("content").first()
        return None if row is None else check_model(model, bytes(row["content"]))

    def put(self, model: Model, data: bytes, at: int, budget: int = MODEL_BYTES) -> None:
        """Keep a checked model; the oldest others go until it fits."""
        row = self.spark.createDataFrame([(model.id, model.bytes, model.language, at, check_model(model, data))], self.SCHEMA)
        self._replace(with_room_for(self.records().where(F.col("id") != model.id), model, budget).unionByName(row))

    def prune(self, at: int, hours: int = 24, budget: int = MODEL_BYTES) -> None:
        """Drop what the catalogue does not know, what is too old, and what lies beyond the budget."""
        self._replace(kept(self.records(), self.catalogue, at, hours, budget))

    def clear(self) -> None:
        self._replace(self.records().limit(0))

    def _replace(self, rows: DataFrame) -> None:
        known = rows.collect()  # a budget's bytes at most
        self.spark.createDataFrame(known, self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(self.path)


def with_room_for(records: DataFrame, model: Model, budget: int = MODEL_BYTES) -> DataFrame:
    """records that stay when the oldest go until a new model fits."""
    return evicted_oldest_first(records, budget, model.bytes)
