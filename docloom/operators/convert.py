"""Conversion as a DataFrame operator: files in, one row with Markdown or an error for each, never a failed job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import limits
from docloom.functions import markdown as md
from docloom.functions.limits import ConversionError, Options, error_info
from docloom.kernels.base import Context
from docloom.kernels.router import Kernel, convert as convert_file
from docloom.session import ensure_importable

RESULT = "state string, markdown string, warnings array<string>, error struct<code: string, message: string>, bytes bigint"
#: Markdown that is held before it goes out as a batch.
BATCH_BYTES = 8 * limits.MIB
#: Input of a core up to which files are dealt out anew where nothing is said: a scan of a few small files has fewer splits than cores.
SPREAD_BYTES = 64 * limits.MIB
_ERROR = pa.struct([("code", pa.string()), ("message", pa.string())])


def convert(files: DataFrame, *, name: str = "name", content: str = "content", mime: str | None = None, override: str = "auto", options: Options | None = None, recognizer: object | None = None, kernels: dict[str, Kernel] | None = None, spread: int | None = None, report: Callable[[str], None] | None = None) -> DataFrame:
    """files with format, state (done or error), markdown, warnings, error and bytes in place of the content.

    Routing and size checks are columns; all else happens in one Python stage, which is opaque to the optimizer and so runs
    once for a row. A file over the limit is not sent there. spread: deal the files to so many tasks first; left out, an input that
    the optimizer takes for small (SPREAD_BYTES a core) is dealt out, and a larger one keeps the scan's own splits; 0 never deals.
    report: told on the worker what each file has come to, for instance an accumulator's add. A missing content is INPUT_MISSING; a null name is no format's.
    """
    ensure_importable(files.sparkSession)
    options = options or Options()
    fmt = F.lit(override) if override != "auto" else md.detect_format(F.col(name), F.col(mime) if mime else None)
    size = F.octet_length(F.col(content))
    large = size > limits.MAX_FILE_BYTES
    keep = [c for c in files.columns if c != content]
    routed = files.select(*keep, fmt.alias("format"), F.coalesce(large, F.lit(False)).alias("__large"), F.when(~large, F.col(content)).alias("__content"))
    if spread is None:
        cores = files.sparkSession.sparkContext.defaultParallelism
        spread = 4 * cores if _estimated_bytes(files) <= SPREAD_BYTES * cores else 0
    if spread:
        routed = routed.repartition(spread, F.xxhash64(*[f"`{c}`" for c in routed.columns if not dict(routed.dtypes)[c].startswith("map")]))
    at_name, kinds = keep.index(name), dict(files.dtypes)
    mime_at = keep.index(mime) if mime else None

    def one(file: str | None, kind: str | None, fmt: str | None, is_large: bool, data: bytes | None) -> dict:
        try:
            if is_large:
                raise ConversionError("FILE_TOO_LARGE", f"{file} exceeds the 20 MB file limit.")
            if data is None:
                raise ConversionError("INPUT_MISSING", "The input of this job is missing.")
            result = convert_file(file or "", data, Context(options=options, recognizer=recognizer, **({"report": report} if report else {})), fmt or "auto", kind, kernels)
            return {"state": "done", "markdown": result.markdown, "warnings": result.warnings, "error": None}
        except Exception as error:  # one file's failure is its own row
            code, message = error_info(error)
            return {"state": "error", "markdown": None, "warnings": [], "error": {"code": code, "message": message}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, start, held, size = batch.columns, 0, [], 0
            for k in range(batch.num_rows):
                held.append(one(columns[at_name][k].as_py(), columns[mime_at][k].as_py() if mime_at is not None else None, columns[-3][k].as_py(), columns[-2][k].as_py(), columns[-1][k].as_py()))
                size += len(held[-1]["markdown"] or "")
                if size >= BATCH_BYTES or k == batch.num_rows - 1:
                    text = pa.array([_clean(x["markdown"]) for x in held], pa.string())
                    warnings = pa.array([[_clean(w) for w in x["warnings"]] for x in held], pa.list_(pa.string()))
                    errors = pa.array([x["error"] and {n: _clean(v) for n, v in x["error"].items()} for x in held], _ERROR)
                    yield pa.RecordBatch.from_arrays(
                        [*[c.slice(start, len(held)) for c in columns[:-2]], pa.array([x["state"] for x in held], pa.string()), text, warnings, errors, pc.cast(pc.binary_length(text), pa.int64())],
                        names=[*batch.schema.names[:-2], "state", "markdown", "warnings", "error", "bytes"],
                    )
                    start, held, size = k + 1, [], 0

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "format string", RESULT])
    return routed.mapInArrow(run, schema)


def _estimated_bytes(df: DataFrame) -> int:
    """What the optimizer takes df's size for; nothing is run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _clean(text: str | None) -> str | None:
    """Lone surrogates, which no UTF-8 has, become U+FFFD."""
    return text if text is None else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def html_to_markdown(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with the html column replaced by state, markdown, warnings, error and bytes."""
    named = pages.withColumn("__name", F.lit("page.html")).withColumn("__html", F.encode(html, "UTF-8")).drop(html)
    return convert(named, name="__name", content="__html").drop("__name", "format")


def xml_to_markdown(files: DataFrame, content: str = "content") -> DataFrame:
    """files with markdown (null where the bytes are not UTF-8) for XML source, in built-in expressions only."""
    return files.withColumn("markdown", md.md_fence(md.decode_utf8(F.col(content)), "xml")).drop(content)
