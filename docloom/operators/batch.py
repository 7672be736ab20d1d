"""Batches of files: staged durably, run with recovery, with results that expire."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import limits
from docloom.functions.limits import ConversionError, Options
from docloom.functions.markdown import output_name
from docloom.operators.convert import convert

JOBS = "batch_id string, job_id string, ordinal bigint, name string, mime string, size bigint, options struct<cache_hours: int, model_cache_hours: int, ocr_language: string, ocr_rotation: int, pdf_force_ocr: boolean, download_directory: string>, created_at bigint"
INPUTS = "batch_id string, job_id string, content binary"
RESULTS = "batch_id string, job_id string, ordinal bigint, name string, state string, markdown string, warnings array<string>, error struct<code: string, message: string>, bytes bigint, created_at bigint"


def now_ms() -> int:
    return int(time.time() * 1000)


def batch_fault(files: DataFrame, max_files: int | None = limits.MAX_FILES, max_bytes: int | None = limits.MAX_BATCH_BYTES, order: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, files, bytes, code, message) of files (name, size), code and message null where the batch may be staged; keys: a batch each.

    The count comes first, then the first file, by `order` or as the rows stand, that breaks a rule of its own, then the sum. None lifts
    a limit, for batches of a cluster's size. One aggregation that never reads a content.
    """
    invalid = F.col("name").isNull() | (F.col("name") == "") | F.col("size").isNull() | (F.col("size") < 0)
    large = F.col("size") > limits.MAX_FILE_BYTES
    place = F.monotonically_increasing_id() if order is None else F.col(order)
    first = F.min(F.when(invalid | large, F.struct("__place", (~invalid).alias("large"), F.col("name").alias("name"))))
    judged = files.withColumn("__place", place).groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), first.alias("first"))
    rules = [
        (F.col("files") == 0, "EMPTY_BATCH", F.lit("Select at least one file.")),
        (F.col("files") > (1 << 62 if max_files is None else max_files), "TOO_MANY_FILES", F.lit(f"Select up to {max_files} files per batch.")),
        (~F.col("first.large"), "INVALID_FILE", F.lit("The file selection is invalid.")),
        (F.col("first.large"), "FILE_TOO_LARGE", F.concat("first.name", F.lit(" exceeds the 20 MB file limit."))),
        (F.col("bytes") > (1 << 62 if max_bytes is None else max_bytes), "BATCH_TOO_LARGE", F.lit("Select at most 100 MB per batch.")),
    ]
    code, message = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for broken, name, text in rules:
        code, message = code.when(broken, F.lit(name)), message.when(broken, text)
    return judged.select(*keys, "files", "bytes", code.alias("code"), message.alias("message"))


def check_batch(files: DataFrame, max_files: int | None = limits.MAX_FILES, max_bytes: int | None = limits.MAX_BATCH_BYTES, order: str | None = None) -> None:
    """Refuse a batch that breaks the limits."""
    fault = batch_fault(files, max_files, max_bytes, order).first()
    if fault["code"]:
        raise ConversionError(fault["code"], fault["message"])


class BatchStore:
    """Tables jobs, inputs and results below a path that all executors reach, one partition for each batch.

    A batch's results are written by a few atomic appends, and inputs are only dropped afterwards: whatever has no result when a run
    ends early is run again by the next one, and nothing else. Opening a store ends what a run that broke off has left half done.
    """

    def __init__(self, spark: SparkSession, root: str, prune_hours: int | None = None):
        """prune_hours: prune at once, as at every start of a service."""
        self.spark, self.root = spark, root.rstrip("/")
        self._running: set[str] = set()
        self._recover()
        if prune_hours is not None:
            self.prune(hours=prune_hours)

    def _recover(self) -> None:
        """Take up an exchange of results that broke off between its two renamings; drop what was not finished before."""
        fs, root = self._path("results")
        for status in fs.globStatus(self._path("results-*")[1]) or []:
            path = status.getPath()
            whole = fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))
            if whole and path.getName().startswith("results-new") and not fs.exists(root):
                fs.rename(path, root)
            else:
                fs.delete(path, True)

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def jobs(self) -> DataFrame:
        return self._read("jobs", JOBS)

    def inputs(self) -> DataFrame:
        return self._read("inputs", INPUTS)

    def results(self) -> DataFrame:
        return self._read("results", RESULTS)

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _drop(self, path: str) -> None:
        fs, p = self._path(path)
        fs.delete(p, True)

    def stage(self, files: DataFrame, options: Options | None = None, at: int | None = None, max_files: int | None = limits.MAX_FILES, max_bytes: int | None = limits.MAX_BATCH_BYTES) -> str:
        """Store files (name, content, optionally mime) with a snapshot of the options; returns the batch's id."""
        files = files.select("name", (F.col("mime") if "mime" in files.columns else F.lit(None).cast("string")).alias("mime"), F.octet_length("content").cast("long").alias("size"), "content")
        check_batch(files.select("name", "size"), max_files, max_bytes)
        batch, at = str(uuid.uuid4()), now_ms() if at is None else at
        path = f"{self.root}/staging/{batch}"
        files.select(F.uuid().alias("job_id"), F.monotonically_increasing_id().alias("ordinal"), "*").write.parquet(path)
        staged = self.spark.read.parquet(path)  # ids are fixed from here on
        settings = F.struct(*[F.lit(v).alias(k) for k, v in asdict(options or Options()).items()])
        staged.select("job_id", "content").write.parquet(f"{self.root}/inputs/batch_id={batch}")
        staged.select("job_id", "ordinal", "name", "mime", "size", settings.alias("options"), F.lit(at).alias("created_at")).write.parquet(f"{self.root}/jobs/batch_id={batch}")
        self._drop(f"staging/{batch}")
        return batch

    def pending(self, batch: str) -> DataFrame:
        """Jobs without a result."""
        return self.jobs().where(F.col("batch_id") == batch).join(self.results().where(F.col("batch_id") == batch).select("job_id"), "job_id", "left_anti")

    def _touch(self, batch: str, at: int) -> None:
        self.spark.range(1).select(F.lit(at).cast("long").alias("at")).write.mode("append").parquet(f"{self.root}/touched/batch_id={batch}")

    def touched(self) -> DataFrame:
        """(batch_id, at): when something last happened to a batch: it was staged, a run began, or a result came."""
        events = self.jobs().select("batch_id", F.col("created_at").alias("at")).unionByName(self.results().select("batch_id", F.col("created_at").alias("at")))
        return last_events(events.unionByName(self._read("touched", "batch_id string, at bigint")))

    def run(self, batch: str, recognizer: object | None = None, at: int | None = None, commits: int = 4) -> None:
        """Convert what is pending; a job whose input is gone ends as INPUT_MISSING. spark.interruptTag(batch) ends a run, which can then be taken up again.

        commits: parts of the jobs, by a hash of their ids, whose results are committed one after the other; a run that fails loses one part's work.
        """
        self.spark.addTag(batch)
        self._running.add(batch)
        try:
            pending = self.pending(batch).select("job_id").count()
            if pending:
                self._touch(batch, now_ms() if at is None else at)
            parts = min(commits, pending)
            for part in range(parts):
                self._run(batch, recognizer, at, F.pmod(F.xxhash64("job_id"), F.lit(parts)) == part)
            if pending:
                self._drop(f"inputs/batch_id={batch}")
        finally:
            self._running.discard(batch)
            self.spark.removeTag(batch)

    def _run(self, batch: str, recognizer: object | None, at: int | None, part: Column) -> None:
        jobs = self.pending(batch).where(part)
        first = jobs.select("options").first()
        if first is None:
            return
        options = Options(**first["options"].asDict())
        files = jobs.join(self.inputs().where(F.col("batch_id") == batch).drop("batch_id"), "job_id", "left").select("job_id", "ordinal", "name", "mime", "content")
        done = convert(files, mime="mime", options=options, recognizer=recognizer)
        done = done.select("job_id", "ordinal", "name", "state", "markdown", "warnings", "error", "bytes", F.lit(now_ms() if at is None else at).alias("created_at"))
        done.write.mode("append").parquet(f"{self.root}/results/batch_id={batch}")

    def update(self, batch: str, label: str, at: int | None = None) -> bool:
        """Give a batch another label and note that something happened to it; a batch that is not there stays so, and the answer is False."""
        if not self.jobs().where(F.col("batch_id") == batch).head(1):
            return False
        now = now_ms() if at is None else at
        self.spark.range(1).select(F.lit(label).alias("label"), F.lit(now).cast("long").alias("at")).write.mode("append").parquet(f"{self.root}/labels/batch_id={batch}")
        self._touch(batch, now)
        return True

    def batches(self) -> DataFrame:
        """batch_id, created_at, updated_at and the last label (null without one)."""
        made = self.jobs().groupBy("batch_id").agg(F.min("created_at").alias("created_at"))
        labels = self._read("labels", "batch_id string, label string, at bigint").groupBy("batch_id").agg(F.max_by("label", "at").alias("label"))
        return made.join(self.touched().withColumnRenamed("at", "updated_at"), "batch_id").join(labels, "batch_id", "left")

    def cancel(self, batch: str, at: int | None = None) -> None:
        """End what is pending as cancelled."""
        error = F.struct(F.lit("CANCELLED").alias("code"), F.lit("Conversion was cancelled.").alias("message"))
        rows = self.pending(batch).select("job_id", "ordinal", "name", F.lit("cancelled").alias("state"), F.lit(None).cast("string").alias("markdown"), F.array().cast("array<string>").alias("warnings"), error.alias("error"), F.lit(None).cast("long").alias("bytes"), F.lit(now_ms() if at is None else at).alias("created_at"))
        rows.write.mode("append").parquet(f"{self.root}/results/batch_id={batch}")
        self._drop(f"inputs/batch_id={batch}")

    def status(self) -> DataFrame:
        """batch_id, total, finished, errors, cancelled, state (queued, running, interrupted, done or cancelled); running is what this store runs just now."""
        joined = self.jobs().join(self.results().select("job_id", "state"), "job_id", "left")
        counts = joined.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total"), F.count("state").alias("finished"), F.count_if(F.col("state") == "error").alias("errors"), F.count_if(F.col("state") == "cancelled").alias("cancelled"))
        runs = F.col("batch_id").isin(sorted(self._running)) & (F.col("finished") < F.col("total"))
        state = F.when(runs, "running").when(F.col("finished") == 0, "queued").when(F.col("finished") < F.col("total"), "interrupted").when(F.col("cancelled") > 0, "cancelled").otherwise("done")
        return counts.withColumn("state", state)

    def outputs(self, at: int | None = None, hours: int = 24) -> DataFrame:
        """Results that are done and not expired; one is kept while created_at + hours lies after now."""
        at = now_ms() if at is None else at
        return live(self.results().where("state = 'done'"), at, hours)

    def in_order(self, batch: str) -> DataFrame:
        """All results of a batch in the order of its files."""
        return self.results().where(F.col("batch_id") == batch).orderBy("ordinal")

    def messages(self, at: int | None = None, hours: int = 24) -> DataFrame:
        """job_id and what to show for it: its Markdown, its error, that it expired or that it is pending."""
        at = now_ms() if at is None else at
        rows = self.jobs().select("job_id", "name").join(self.results().select("job_id", "state", "markdown", "warnings", "error", "created_at"), "job_id", "left")
        alive = F.col("created_at") + hours * 3_600_000 > at
        shown = F.when((F.col("state") == "done") & alive, F.col("markdown")).when(F.col("state") == "done", "This result has expired.").when(F.col("state").isNull(), "Pending.").otherwise(F.col("error.message"))
        return rows.select("job_id", "name", F.coalesce("state", F.lit("pending")).alias("state"), shown.alias("shown"), F.array_join("warnings", " ").alias("notes"))

    def prune(self, at: int | None = None, hours: int = 24, budget: int = limits.CACHE_BYTES) -> None:
        """Drop expired outputs and those beyond the budget, newest kept first, and batches to which nothing happened for a day.

        The results that stay are written whole, then take the old ones' place; a crash in between is mended when the store is next opened.
        """
        at = now_ms() if at is None else at
        gone = [row["batch_id"] for row in self.touched().where(abandoned(F.col("at"), at)).toLocalIterator()]
        kept = retained(self.outputs(at, hours), budget).select("job_id")
        rest = self.results().where("state <> 'done'").unionByName(self.results().join(kept, "job_id", "left_semi"))
        mark = uuid.uuid4().hex
        rest.write.partitionBy("batch_id").parquet(f"{self.root}/results-new-{mark}")
        fs, results = self._path("results")
        if fs.exists(results):
            fs.rename(results, self._path(f"results-old-{mark}")[1])
        fs.rename(self._path(f"results-new-{mark}")[1], results)
        self._drop(f"results-old-{mark}")
        for batch in gone:
            for name in ("jobs", "inputs", "touched", "labels"):
                self._drop(f"{name}/batch_id={batch}")

    def stats(self) -> DataFrame:
        """(count, bytes) of the outputs; their text is not read."""
        return self.results().where("state = 'done'").agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))

    def clear(self) -> None:
        self._drop("results")


def runnable(jobs: DataFrame, state: str = "state") -> DataFrame:
    """Jobs that a run takes up: those queued, and those a run that ended early left running."""
    return jobs.where(F.col(state).isin("queued", "running"))


def update_if_exists(rows: DataFrame, changes: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """rows with the columns of changes (one row a key) where their key is there, and `updated`; a change without its row is left out, a null in it changes nothing."""
    renamed = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("updated"))
    joined = rows.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else c for c in rows.columns], F.coalesce("updated", F.lit(False)).alias("updated"))


class SettingsStore:
    """Options that outlive a session: defaults, the stored changes over them, checked as a whole before they are kept."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/settings"

    def load(self) -> Options:
        try:
            last = self.spark.read.schema("at bigint, options string").parquet(self.path).agg(F.max_by("options", "at")).first()[0]
        except AnalysisException:
            last = None
        return Options(**(json.loads(last) if last else {}))

    def save(self, **changes: object) -> Options:
        """The options with changes; what they may not be raises ValueError and is not kept."""
        options = Options(**(asdict(self.load()) | changes))
        row = self.spark.range(1).select(F.lit(time.time_ns()).cast("long").alias("at"), F.lit(json.dumps(asdict(options))).alias("options"))
        row.write.mode("append").parquet(self.path)
        return options


def last_events(events: DataFrame) -> DataFrame:
    """(batch_id, at): the last of each batch's events (batch_id, at)."""
    return events.groupBy("batch_id").agg(F.max("at").alias("at"))


def abandoned(last: Column, at: int) -> Column:
    """Whether nothing has happened for a day to a batch whose last event was then."""
    return last < at - limits.ABANDONED_MS


def live(rows: DataFrame, at: int, hours: int) -> DataFrame:
    return rows.where(F.col("created_at") + hours * 3_600_000 > at)


def retained(outputs: DataFrame, budget: int, keys: tuple[str, ...] = (), id_col: str = "job_id") -> DataFrame:
    """outputs that a greedy scan keeps, newest first: one that does not fit is skipped and uses nothing up. keys: a budget for each.

    The scan depends on order, so a key's rows pass one task, but as a stream of (key, created_at, bytes, id) sorted beforehand, of which
    nothing but the sum so far is kept; the rows themselves are then selected by id. A key or bytes that are null take no part.
    """
    narrow = outputs.select(*keys, F.col("created_at").alias("__at"), F.col("bytes").cast("long").alias("__bytes"), F.col(id_col).alias("__id")).where(F.col("__bytes") <= budget)
    order = [*keys, F.desc("__at"), "__id"]
    dealt = narrow.repartition(*keys).sortWithinPartitions(*order) if keys else narrow.orderBy(*order).coalesce(1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used = None, 0
        for batch in batches:
            sizes = batch.column("__bytes").to_numpy(zero_copy_only=False)
            owners = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * len(sizes)
            keep = np.zeros(len(sizes), bool)
            start = 0
            while start < len(sizes):
                if owners[start] != key:
                    key, used = owners[start], 0
                end = next((k for k in range(start, len(sizes)) if owners[k] != key), len(sizes)) if keys else len(sizes)
                while start < end:
                    upto = used + np.cumsum(sizes[start:end])
                    fits = int(np.searchsorted(upto, budget, "right"))  # sizes are not negative, so the sum only grows
                    keep[start : start + fits] = True
                    used = int(upto[fits - 1]) if fits else used
                    small = np.flatnonzero(sizes[start + fits : end] <= budget - used)  # what cannot fit any more is passed over at once
                    start = start + fits + (int(small[0]) if len(small) else end - start - fits)
            yield pa.RecordBatch.from_arrays([batch.column("__id").filter(pa.array(keep))], names=[id_col])

    kept = dealt.mapInArrow(scan, f"`{id_col}` {dict(outputs.dtypes)[id_col]}")
    return outputs.join(kept, id_col, "left_semi")


def evicted_oldest_first(items: DataFrame, budget: int, incoming: int, order: str = "created_at", size: str = "bytes", keys: tuple[str, ...] = ()) -> DataFrame:
    """items that stay when the oldest are dropped until an incoming one fits."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("__upto", F.sum(size).over(newest)).where(F.col("__upto") + incoming <= budget).drop("__upto")


#: Parts in which the rows of one name are ranked before those that can still get a name meet.
NAME_PARTS = 64


def numbered_names(outputs: DataFrame, name: str = "name", order: str = "ordinal", taken: DataFrame | None = None) -> DataFrame:
    """outputs with `file`: the Markdown file's name, or that with (2), (3) ... for repeated ones, each the first that is free.

    Names in taken (file) are not free, nor are the plain names of other rows. Beyond SAVE_ATTEMPTS numbers there is none, and file is null.
    """
    base = outputs.withColumn("file", output_name(F.col(name)))
    numbered = r"(?s)\A(.*) \((\d{1,6})\)\.md\z"
    plain = base.select("file").distinct()
    held = plain if taken is None else plain.unionByName(taken.select("file")).distinct()
    numbers = held.select(F.concat(F.regexp_extract("file", numbered, 1), F.lit(".md")).alias("file"), F.regexp_extract("file", numbered, 2).alias("digits"))
    numbers = numbers.where("digits <> '' AND digits NOT LIKE '0%'").select("file", F.col("digits").try_cast("int").alias("n")).where(F.col("n").between(2, limits.SAVE_ATTEMPTS))
    used = numbers.groupBy("file").agg(F.collect_set("n").alias("used"))  # of at most SAVE_ATTEMPTS numbers
    if taken is not None:
        used = used.join(taken.select("file", F.lit(True).alias("gone")).distinct(), "file", "full")
    else:
        used = used.withColumn("gone", F.lit(False))
    # A name may have very many rows: their first SAVE_ATTEMPTS are found in parts, and only these are ranked together.
    part = F.pmod(F.xxhash64(order), F.lit(NAME_PARTS))
    ranked = base.withColumn("__part", F.row_number().over(Window.partitionBy("file", part).orderBy(order)))
    may = F.col("__part") <= limits.SAVE_ATTEMPTS
    ranked = ranked.withColumn("__group", F.when(may, 0).otherwise(part + 1)).withColumn("__place", F.row_number().over(Window.partitionBy("file", "__group").orderBy(order)))
    ranked = ranked.join(used, "file", "left")
    gone = F.coalesce("gone", F.lit(False))
    extra = F.col("__place") - F.when(gone, 0).otherwise(1)  # how many numbers the rows up to this one need
    free = F.array_except(F.sequence(F.lit(2), F.lit(limits.SAVE_ATTEMPTS)), F.coalesce("used", F.array().cast("array<int>")))
    number = F.when(F.col("used").isNull(), extra + 1).otherwise(F.get(free, extra - 1))
    file = F.when(extra == 0, F.col("file")).when(number <= limits.SAVE_ATTEMPTS, F.concat(F.regexp_replace("file", r"\.md\z", ""), F.lit(" ("), number.cast("string"), F.lit(").md")))
    return ranked.withColumn("file", F.when(F.col("__group") == 0, file)).select(*[f"`{c}`" for c in base.columns])


def save_markdown(outputs: DataFrame, directory: str) -> None:
    """Write each output to a file of its own in a directory that all executors see, never over an existing file."""

    def write(rows) -> None:
        import os

        for row in rows:
            if row["file"] is None:
                raise OSError("Too many files with the same name. Choose a different output folder.")
            with open(os.path.join(directory, row["file"]), "x", encoding="utf-8", newline="") as f:
                f.write(row["markdown"])

    outputs.select("file", "markdown").foreachPartition(write)
