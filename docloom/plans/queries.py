"""Queries that apply the operators to the driver's tables, one for each operator or small family of them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import limits
from docloom.functions import markdown as md
from docloom.kernels.base import Context
from docloom.kernels.layout import Token, layout_text
from docloom.kernels.text import convert_json, parse_csv
from docloom.operators import batch
from docloom.operators import convert as conversion
from docloom.plans import samples
from docloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def last_segment(url: Column) -> Column:
    """What follows a URL's last slash, without query and fragment: a page's file name."""
    return F.substring_index(F.regexp_replace(url, r"[?#].*", ""), "/", -1)


def epoch_ms(ts: str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    t = F.col(ts)
    second = F.extract(F.lit("SECOND"), t)
    return F.unix_date(F.to_date(t)).cast("long") * 86_400_000 + F.hour(t) * 3_600_000 + F.minute(t) * 60_000 + F.floor(second * 1000).cast("long")


# --- scalars ------------------------------------------------------------------------------------------------------------


@query
def md_cell_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", md.md_cell(F.col("text")).alias("cell"))


@query
def md_heading_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", md.md_heading(F.col("text")).alias("heading"), md.md_text(F.col("text")).alias("body"))


@query
def md_fence_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", md.md_fence(F.col("text"), "xml").alias("block"))


@query
def sql_functions_documents(spark: SparkSession, d: str) -> DataFrame:
    """The same through SQL functions, which become part of the plan."""
    md.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("docloom_documents")
    return spark.sql("SELECT doc_id, md_cell(text) AS cell, md_fence(text, 'text') AS block, usable_text(text) AS usable FROM docloom_documents")


@query
def usable_text_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", md.usable_text(F.col("text")).alias("usable"))


@query
def output_name_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", md.output_name(F.col("url")).alias("whole_name"), md.output_name(last_segment(F.col("url"))).alias("file_name"))


@query
def detect_format_pages(spark: SparkSession, d: str) -> DataFrame:
    name = last_segment(F.col("url"))
    return table(spark, d, "pages").select("page_id", name.alias("name"), md.detect_format(name).alias("by_name"), md.detect_format(name, F.lit("text/html")).alias("with_mime"))


@query
def safe_path_pages(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace("url", r"^https?://", "")
    return table(spark, d, "pages").select("page_id", md.unsafe_path(F.col("url")).alias("url_unsafe"), md.unsafe_path(path).alias("path_unsafe"), md.unsafe_path(F.concat(F.lit("../"), path)).alias("up_unsafe"))


@query
def has_entities_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", md.has_entities(F.col("html")).alias("refused"))


@query
def decode_text_documents(spark: SparkSession, d: str) -> DataFrame:
    """Bytes with a byte order mark to text, and bytes that are no UTF-8 to null."""
    raw = F.encode("text", "UTF-8")
    marked, broken = F.concat(F.unhex(F.lit("EFBBBF")), raw), F.concat(raw, F.unhex(F.lit("FF")))
    return table(spark, d, "documents").select("doc_id", md.decode_utf8(marked).alias("text"), md.decode_utf8(broken).isNull().alias("malformed"))


@query
def file_signature_documents(spark: SparkSession, d: str) -> DataFrame:
    heads = F.array(*[F.lit(x) for x in ("504B0304", "D0CF11E0A1B11AE1", "FFD8FFE0", "89504E470D0A1A0A", "25504446")])
    content = F.concat(F.unhex(F.element_at(heads, (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))), F.encode("text", "UTF-8"))
    return table(spark, d, "documents").select("doc_id", md.file_signature(content).alias("kind"))


@query
def sha_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


@query
def estimate_memory_documents(spark: SparkSession, d: str) -> DataFrame:
    fmt = F.element_at(F.array(*[F.lit(f.id) for f in limits.FORMATS]), (F.pmod("doc_id", F.lit(13)) + 1).cast("int"))
    need = md.memory_estimate(F.octet_length("text"), fmt)
    return table(spark, d, "documents").select("doc_id", fmt.alias("format"), need.alias("bytes"), (need > 1024 * limits.MIB).alias("over_budget"))


@query
def render_scale_part(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("p_retailprice") * 2, (F.col("p_size") * 60).cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(md.render_scale(w, h), 9).alias("scale"))


@query
def image_size_part(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.floor(F.col("p_retailprice") * 4), (F.col("p_size").cast("long") * 180)
    size = md.bounded_size(w, h)
    return table(spark, d, "part").select("p_partkey", md.image_ok(w, h).alias("verdict"), size["width"].alias("width"), size["height"].alias("height"))


@query
def cer_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Error rate of each turn against the turn before, letters beyond ASCII seen as `?`."""
    turns = table(spark, d, "conversations").withColumn("plain", F.regexp_replace("text", r"[^\x00-\x7F]", "?"))
    before = F.lag("plain").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("before", before).where("before is not null").select("conv_id", "turn", F.round(md.error_rate(F.col("before"), F.col("plain")), 9).alias("rate"))


@query
def json_pretty_events(spark: SparkSession, d: str) -> DataFrame:
    """The JSON converter over every event's properties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = Context()
        for b in batches:
            text = [convert_json(x.encode(), context).markdown for x in b.column("props").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("event_id"), pa.array(text, pa.string())], names=["event_id", "markdown"])

    return table(spark, d, "events").select("event_id", "props").mapInArrow(run, "event_id bigint, markdown string")


# --- tables, sections, folds ----------------------------------------------------------------------------------------------


def _ordered_rows(header: list[str], order: Column, cells: list[Column]) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.array(*[c.cast("string") for c in cells]).alias("r"))))
    return F.concat(F.array(F.array(*[F.lit(h) for h in header])), F.transform(rows, lambda x: x["r"]))


@query
def md_table_nation(spark: SparkSession, d: str) -> DataFrame:
    cells = [F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey")]
    rows = table(spark, d, "nation").agg(_ordered_rows(["n_nationkey", "n_name", "n_regionkey"], F.col("n_nationkey"), cells).alias("rows"))
    return rows.select(md.md_table(F.col("rows")).alias("markdown"))


@query
def md_table_region_nation(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    rows = joined.groupBy("r_name").agg(_ordered_rows(["Key", "Name"], F.col("n_nationkey"), [F.col("n_nationkey"), F.col("n_name")]).alias("rows"))
    return rows.select("r_name", F.size("rows").cast("long").alias("n_rows"), md.md_table(F.col("rows")).alias("markdown"))


@query
def ragged_rows_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Each turn's lines as rows of comma-separated fields of different widths: the width is the longest row's."""
    rows = F.transform(F.split("text", "\n"), lambda line: F.split(line, ","))
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    ragged = F.size(F.array_distinct(F.transform(rows, lambda r: F.size(r)))) > 1
    return table(spark, d, "conversations").select("conv_id", "turn", width.cast("long").alias("width"), ragged.alias("ragged"), md.md_table(rows).alias("markdown"))


@query
def md_sections_conversations(spark: SparkSession, d: str) -> DataFrame:
    section = F.concat(F.lit("## Turn "), F.col("turn").cast("string"), F.lit(" "), md.md_heading(F.col("role")), F.lit("\n\n"), F.col("text"), F.lit("\n"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(md.ordered_concat(F.col("turn"), section, "\n---\n\n").alias("markdown"))


@query
def md_spine_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents whose chapters are their lines, in order; an order without lines is kept, empty."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("spine"))
    joined = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    chapters = F.transform(F.coalesce("spine", F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint>>")), lambda x, i: F.concat(F.lit("## Chapter "), (i + 1).cast("string"), F.lit("\n\n"), x["l_partkey"].cast("string"), F.lit("\n")))
    return joined.select("o_orderkey", F.array_join(F.concat(F.array(F.concat(F.lit("# "), md.md_heading(F.col("o_orderpriority")), F.lit("\n"))), chapters), "\n").alias("markdown"))


@query
def page_numbers_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Numbering, the distance to the section before, and bytes so far."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    size = F.octet_length("text").cast("long")
    return table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w).cast("long").alias("page"), (size - F.lag(size).over(w)).alias("gap"), F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"))


@query
def output_budget_documents(spark: SparkSession, d: str) -> DataFrame:
    """By source: whether documents in order stay within an output budget, and the document that breaks it."""
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sized = table(spark, d, "documents").withColumn("upto", F.sum(F.octet_length("text").cast("long")).over(w))
    return sized.groupBy("source").agg(F.max("upto").alias("bytes"), F.min(F.when(F.col("upto") > 65536, F.col("doc_id"))).alias("breaks_at"))


@query
def distinct_warnings_labels(spark: SparkSession, d: str) -> DataFrame:
    """The distinct warnings of each source's documents, as first seen."""
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    w = F.concat(F.lit("quality "), F.col("quality").cast("string"), F.lit(" toxic "), F.col("toxic").cast("string"))
    lists = joined.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", w.alias("w")))), lambda x: x["w"]).alias("all"))
    return lists.select("source", F.array_join(md.distinct_in_order(F.col("all")), "; ").alias("warnings"), F.size("all").cast("long").alias("n"))


@query
def warnings_append_documents(spark: SparkSession, d: str) -> DataFrame:
    """Warnings of two origins one after the other, and the allow-listed ones among them."""
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("lang "), F.col("lang")).alias("warning"))
    b = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("warning"))
    allowed = spark.createDataFrame([("lang en",), ("quality 0",)], "warning string")
    return a.unionByName(b).join(F.broadcast(allowed), "warning", "left_semi").groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


@query
def dup_entries_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("entry")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query
def size_guard_pages(spark: SparkSession, d: str) -> DataFrame:
    size = F.octet_length("html").cast("long")
    return table(spark, d, "pages").agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"), F.count_if(size > 8192).alias("too_large"), F.count_if(F.col("url").isNull() | (F.col("url") == "")).alias("invalid"))


@query
def majority_direction_documents(spark: SparkSession, d: str) -> DataFrame:
    """By source: whether most documents are in a language, and the least and greatest size."""
    return table(spark, d, "documents").groupBy("source").agg((F.avg(F.when(F.col("lang") == "en", 1).otherwise(0)) > 0.5).alias("mostly_en"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))


# --- state, lookups, sinks --------------------------------------------------------------------------------------------------


@query
def batch_status_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as batches, turns as jobs: assistant is done, system an error, a user's text without an answer is pending."""
    role = F.col("role")
    counts = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(role != "user").alias("finished"), F.count_if(role == "system").alias("errors"))
    return counts.withColumn("state", F.when(F.col("finished") == 0, "queued").when(F.col("finished") < F.col("total"), "interrupted").otherwise("done"))


@query
def cache_stats_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes"))


@query
def ttl_filter_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as results: those that have not expired 24 hours before the last one, and whether a day has passed since."""
    events = table(spark, d, "events").select("event_id", epoch_ms("ts").alias("created_at"))
    now = events.agg(F.max("created_at")).first()[0] or 0
    return batch.live(events, now, 24).select("event_id", "created_at", (F.col("created_at") < now - limits.ABANDONED_MS // 2).alias("old"))


@query
def cache_retain_events(spark: SparkSession, d: str) -> DataFrame:
    """By user: the events that a greedy scan keeps within a budget, newest first."""
    items = table(spark, d, "events").select("event_id", "user_id", epoch_ms("ts").alias("created_at"), F.floor(F.col("value") * 1000).cast("long").alias("bytes"))
    return batch.retained(items, 200_000, ("user_id",), "event_id").select("event_id", "user_id", "bytes")


@query
def model_evict_documents(spark: SparkSession, d: str) -> DataFrame:
    """By source: what stays when the oldest documents go until another fits."""
    items = table(spark, d, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return batch.evicted_oldest_first(items, 40_000, 5000, "doc_id", "bytes", ("source",))


@query
def runnable_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Recovery: customers (jobs) without any pending order (result)."""
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query
def runnable_jobs_orders(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    return batch.runnable(table(spark, d, "orders").withColumn("state", state)).select("o_orderkey", "state")


@query
def job_input_orders(spark: SparkSession, d: str) -> DataFrame:
    """Jobs with their inputs; one without is an error of its own."""
    inputs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    joined = table(spark, d, "orders").join(inputs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.when(F.col("lines").isNull(), "error").otherwise("done").alias("state"), F.when(F.col("lines").isNull(), "INPUT_MISSING").alias("code"))


@query
def update_if_exists_customer(spark: SparkSession, d: str) -> DataFrame:
    """A result put into its job, where there is one: the last order's price over the balance."""
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("value"))
    return batch.update_if_exists(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("value")), last, "c_custkey", ("value",))


@query
def tag_names_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """Tags by a dictionary, with a default name."""
    names = F.create_map(*[F.lit(x) for pair in ((1, "Make"), (2, "Model"), (3, "DateTime")) for x in pair])
    tag = F.col("l_linenumber")
    return table(spark, d, "lineitem").groupBy(F.coalesce(F.try_element_at(names, tag), F.concat(F.lit("Tag "), tag.cast("string"))).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query
def first_match_orders(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's first order in order of keys."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("first_priority"), F.min("o_orderkey").alias("first_key"))


@query
def output_name_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Documents saved under their source's name: repeated names are numbered."""
    named = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit(".html")).alias("name"))
    return batch.numbered_names(named, "name", "doc_id").select("doc_id", "file")


@query
def error_messages_documents(spark: SparkSession, d: str) -> DataFrame:
    """Messages cut to their greatest length."""
    return table(spark, d, "documents").select("doc_id", md.left_units(F.col("text"), limits.ERROR_CHARS).alias("message"))


# --- converters -----------------------------------------------------------------------------------------------------------


@query
def html_to_markdown_pages(spark: SparkSession, d: str) -> DataFrame:
    done = conversion.html_to_markdown(table(spark, d, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", "state", F.col("error.code").alias("error_code"), F.size("warnings").cast("long").alias("n_warnings"), "bytes", "markdown")


@query
def html_links_pages(spark: SparkSession, d: str) -> DataFrame:
    """Links in the source against links in the Markdown, and that scripts and styles are gone."""
    pages = table(spark, d, "pages").select("page_id", "html", F.col("html").alias("source"))
    done = conversion.html_to_markdown(pages)
    return done.select("page_id", F.regexp_count("source", F.lit("<a href=")).cast("long").alias("links"), F.regexp_count("markdown", F.lit(r"\]\([^)]*\)")).cast("long").alias("rendered"), F.contains("markdown", F.lit("track(")).alias("has_script"), F.contains("markdown", F.lit("margin:0")).alias("has_style"))


@query
def csv_roundtrip_nation(spark: SparkSession, d: str) -> DataFrame:
    """The table written as one CSV file and parsed again."""
    quoted = F.concat(F.lit('"'), F.replace("n_name", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("n_nationkey").cast("string"), quoted, F.col("n_regionkey").cast("string"))
    whole = table(spark, d, "nation").agg(md.ordered_concat(F.col("n_nationkey"), line, "\r\n").alias("csv"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column("csv").to_pylist():
                rows = parse_csv(text)
                yield pa.RecordBatch.from_arrays([pa.array([int(r[0]) for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([int(r[2]) for r in rows], pa.int32())], names=["n_nationkey", "n_name", "n_regionkey"])

    return whole.mapInArrow(parse, "n_nationkey int, n_name string, n_regionkey int")


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document as an archive with its text as XML, a page and a file of no known format."""
    for b in batches:
        files = []
        for text in b.column("text").to_pylist():
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                z.writestr("doc.xml", text)
                z.writestr("sub/page.html", "<h1>Page</h1>")
                z.writestr("notes.txt", "x")
            files.append(out.getvalue())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(["a.zip"] * len(files)), pa.array(files, pa.binary())], names=["doc_id", "name", "content"])


@query
def zip_roundtrip_documents(spark: SparkSession, d: str) -> DataFrame:
    archives = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_zipped, "doc_id bigint, name string, content binary")
    done = conversion.convert(archives)
    return done.select("doc_id", "state", "markdown", F.array_join("warnings", "; ").alias("warnings"))


@query
def xml_source_conversations(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("content"))
    return conversion.xml_to_markdown(files)


@query
def layout_text_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages whose lines are placed tokens, some of them right to left, brought into reading order."""
    line = F.col("l_linenumber")
    token = F.struct(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("text"), ((F.col("l_suppkey") % 500).cast("double") + line / 10).alias("x"), (F.floor(line / 2) * 15).cast("double").alias("y"), (F.col("l_suppkey") % 3 == 0).alias("rtl"))
    pages = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(token)).alias("tokens"))

    @F.pandas_udf("string")
    def lay(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda page: layout_text([Token(t["text"], t["x"], t["y"], 5.0 * len(t["text"]), 10.0, t["rtl"]) for t in page])[0])

    return pages.select("l_orderkey", lay("tokens").alias("text"))


def _converted(spark: SparkSession, d: str, build: Callable, name: str) -> DataFrame:
    """One document whose parts are regions with their nations, made by `build` and converted."""
    joined = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    parts = joined.groupBy("r_regionkey", "r_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
    whole = parts.agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name", "names"))).alias("parts"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = [build([(x["r_name"], x["names"]) for x in parts]) for parts in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(files)), pa.array(files, pa.binary())], names=["name", "content"])

    return conversion.convert(whole.mapInArrow(make, "name string, content binary")).select("name", "format", "state", "markdown")


@query
def docx_region_nation(spark: SparkSession, d: str) -> DataFrame:
    return _converted(spark, d, samples.docx, "nations.docx")


@query
def xlsx_region_nation(spark: SparkSession, d: str) -> DataFrame:
    return _converted(spark, d, samples.xlsx, "nations.xlsx")


@query
def pptx_region_nation(spark: SparkSession, d: str) -> DataFrame:
    return _converted(spark, d, samples.pptx, "nations.pptx")


@query
def epub_region_nation(spark: SparkSession, d: str) -> DataFrame:
    return _converted(spark, d, samples.epub, "nations.epub")


@query
def pdf_region_nation(spark: SparkSession, d: str) -> DataFrame:
    return _converted(spark, d, samples.pdf, "nations.pdf")


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = [samples.jpeg(n) for n in b.column("s_name").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("s_suppkey"), pa.array(["a.jpg"] * len(files)), pa.array(files, pa.binary())], names=["s_suppkey", "name", "content"])

    return table(spark, d, "supplier").select("s_suppkey", "s_name").mapInArrow(make, "s_suppkey bigint, name string, content binary")


@query
def exif_supplier(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of pictures that name each supplier as their maker."""
    return conversion.convert(_pictures(spark, d), override="exif").select("s_suppkey", "state", "markdown")


@query
def image_without_models(spark: SparkSession, d: str) -> DataFrame:
    """Pictures where no recognizer is given."""
    return conversion.convert(_pictures(spark, d)).groupBy("format", "state", F.col("error.code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query
def convert_mixed_batch(spark: SparkSession, d: str) -> DataFrame:
    """A batch of every text format and of broken files: each has its own row, and none fails another."""
    nation, events, documents, pages = (table(spark, d, t) for t in ("nation", "events", "documents", "pages"))
    parts = [
        nation.select(F.concat("n_name", F.lit(".csv")).alias("name"), F.concat_ws(",", "n_name", F.col("n_regionkey").cast("string")).alias("text")),
        events.select(F.concat(F.lit("event"), F.col("event_id").cast("string"), F.lit(".json")).alias("name"), F.col("props").alias("text")),
        documents.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".json")).alias("name"), "text"),
        documents.select(F.concat(F.lit("sheet"), F.col("doc_id").cast("string"), F.lit(".xlsx")).alias("name"), "text"),
        pages.select(F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".htm")).alias("name"), F.col("html").alias("text")),
        documents.select(F.concat(F.lit("audio"), F.col("doc_id").cast("string"), F.lit(".mp3")).alias("name"), "text"),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    done = conversion.convert(whole.select("name", F.encode("text", "UTF-8").alias("content")))
    return done.groupBy("format", "state", F.col("error.code").alias("code")).agg(F.count(F.lit(1)).alias("n"))
