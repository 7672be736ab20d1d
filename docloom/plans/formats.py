"""Queries over files that are built from the driver's tables: every format, every rule that refuses one, state and stores; each with its SQL."""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import limits, scalars, udtfs
from docloom.functions.limits import Options
from docloom.kernels import image
from docloom.operators import batch, convert as conversion
from docloom.plans import samples
from docloom.plans.oracle import _cell, _fence
from docloom.plans.queries import QUERIES, Query, _converted, epoch_ms
from docloom.session import scratch, table
from docloom.sources import files as sources, models
from docloom.streaming import ingest

ORACLE: dict[str, str] = {}


def with_sql(sql: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return put


def _files(rows: DataFrame, key: str, make: Callable[..., tuple[str, bytes]], *columns: str) -> DataFrame:
    """rows' key with a file (name, content) that `make` builds of the key and columns.

    Keys are dealt out before anything is built: a table of narrow rows is a scan of a few splits, whatever its files will weigh.
    """
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [make(*row) for row in zip(*(b.column(c).to_pylist() for c in (key, *columns)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([n for n, _ in made]), pa.array([d for _, d in made], pa.binary())], names=[key, "name", "content"])

    return rows.select(key, *columns).repartition(tasks, key).mapInArrow(build, f"{key} {dict(rows.dtypes)[key]}, name string, content binary")


def _convert(rows: DataFrame, key: str, make: Callable[..., tuple[str, bytes]], *columns: str, recognizer: object | None = None) -> DataFrame:
    """The files of _files converted where they are built."""
    return conversion.convert(_files(rows, key, make, *columns), recognizer=recognizer, spread=0)


_NL = "chr(10)"

# --- converters -------------------------------------------------------------------------------------------------------------


@with_sql(f"""WITH n AS (SELECT r_regionkey, r_name, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS i FROM region JOIN nation ON r_regionkey = n_regionkey),
    p AS (SELECT r_regionkey, r_name, string_agg('| ' || i || ' | ' || {_cell('n_name')} || ' |', {_NL} ORDER BY i) AS rows FROM n GROUP BY 1, 2)
    SELECT 'nations.xls' AS name, 'xls' AS format, 'done' AS state, string_agg('## ' || r_name || {_NL} || {_NL} || '| No | Name |' || {_NL} || '| --- | --- |' || {_NL} || rows || {_NL}, {_NL} ORDER BY r_regionkey) AS markdown FROM p""")
def xls_region_nation(spark: SparkSession, d: str) -> DataFrame:
    """A legacy workbook with a sheet for each region."""
    return _converted(spark, d, samples.xls, "nations.xls")


def _styled(key: int, price: float, size: int) -> tuple[str, bytes]:
    rows = [[("Day", 0), ("Price", 0), ("Share", 0), ("Total", 0)], [(45000 + key % 700, 1), (price, 2), (size / 64, 3), (1000 * size, 4)]]
    return "parts.xlsx", samples.styled_xlsx(rows, formula=key % 2 == 0, merged=key % 3 == 0)


@with_sql(f"""SELECT p_partkey, '## Data' || {_NL} || {_NL} || '| Day | Price | Share | Total |' || {_NL} || '| --- | --- | --- | --- |' || {_NL} || '| ' || strftime(DATE '1899-12-30' + CAST(45000 + p_partkey % 700 AS INTEGER), '%-m/%-d/%y')
    || ' | ' || printf('%.2f', p_retailprice) || ' | ' || printf('%.2f', p_size * 100 / 64.0 + 1e-9) || '% | ' || p_size || ',000 |' || {_NL} AS markdown,
    concat_ws(' ', CASE WHEN p_partkey % 3 = 0 THEN 'Merged cells retain their top-left value; other cells remain blank.' END, CASE WHEN p_partkey % 2 = 0 THEN 'Formulas use cached values; formulas are not recalculated.' END) AS notes FROM part""")
def xlsx_styles_part(spark: SparkSession, d: str) -> DataFrame:
    """Workbooks with days, decimals, percentages, thousands, a formula's value and merged cells."""
    done = _convert(table(spark, d, "part"), "p_partkey", _styled, "p_retailprice", "p_size")
    return done.select("p_partkey", "markdown", F.array_join("warnings", " ").alias("notes"))


@with_sql(f"""WITH n AS (SELECT r_regionkey, r_name, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS i FROM region JOIN nation ON r_regionkey = n_regionkey)
    SELECT r_regionkey, '## Slide 1' || {_NL} || {_NL} || '### ' || r_name || {_NL} || {_NL} || '| No | Name |' || {_NL} || '| --- | --- |' || {_NL} || string_agg('| ' || i || ' | ' || {_cell('n_name')} || ' |', {_NL} ORDER BY i) || {_NL} || {_NL} || {_NL}
    || '### Speaker notes' || {_NL} || {_NL} || 'Say ' || r_name || {_NL} AS markdown, 'Slide 1: Unsupported presentation content (chart) is omitted; embedded images are not recognized.' AS note FROM n GROUP BY r_regionkey, r_name""")
def pptx_notes_region(spark: SparkSession, d: str) -> DataFrame:
    """Slides with a table, a chart and speaker notes."""
    joined = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    parts = joined.groupBy("r_regionkey", "r_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
    done = _convert(parts, "r_regionkey", lambda key, title, names: ("deck.pptx", samples.noted_pptx(title, names, f"Say {title}")), "r_name", "names")
    return done.select("r_regionkey", "markdown", F.element_at("warnings", -1).alias("note"))


FONT, BODY = ("http://www.idpf.org/2008/embedding", "t/f.otf"), ("http://www.w3.org/2001/04/xmlenc#aes256-cbc", "t/c0.xhtml")


def _guarded(key: int, name: str) -> tuple[str, bytes]:
    """Books without an encryption record, with an empty one, with an obfuscated font, with that and encrypted text."""
    record = lambda about: f'<EncryptedData><EncryptionMethod Algorithm="{about[0]}"/><CipherReference URI="{about[1]}"/></EncryptedData>'
    book = samples.epub([(name, ["text"])])
    kinds = [None, [], [FONT], [FONT, BODY]][key % 4]
    if kinds is None:
        return "b.epub", book
    out = samples.io.BytesIO(book)
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("META-INF/encryption.xml", f"<encryption>{''.join(map(record, kinds))}</encryption>")
    return "b.epub", out.getvalue()


@with_sql(f"SELECT n_nationkey, CASE WHEN n_nationkey % 4 IN (1, 3) THEN 'ENCRYPTED_EPUB' ELSE 'ok' END AS outcome, CASE WHEN n_nationkey % 4 IN (0, 2) THEN '# Names' || chr(10) || chr(10) || '## Chapter 1' || chr(10) || chr(10) || '# ' || {_cell('n_name')} || chr(10) || chr(10) || 'text' || chr(10) END AS markdown, CASE WHEN n_nationkey % 4 = 2 THEN 'Obfuscated font assets are omitted; chapter text is unaffected.' ELSE '' END AS notes FROM nation")
def epub_encryption_nation(spark: SparkSession, d: str) -> DataFrame:
    done = _convert(table(spark, d, "nation"), "n_nationkey", _guarded, "n_name")
    return done.select("n_nationkey", F.coalesce("error.code", F.lit("ok")).alias("outcome"), "markdown", F.array_join("warnings", " ").alias("notes"))


def _nested(depth: int) -> bytes:
    data = samples.zipped({"d.json": "1"})
    for _ in range(depth):
        data = samples.zipped({"in.zip": data})
    return data


def _odd_archive(key: int) -> tuple[str, bytes]:
    good = samples.zipped({"a.json": "[1]"})
    stored = bytearray(samples.zipped({"a.json": "[1]", "b.json": "2"}, zipfile.ZIP_STORED))
    stored[36] = 0x5D  # the first byte of the first file
    with_twice = samples.zipped({"a.json": "1", "b.json": "2"}).replace(b"b.json", b"a.json")
    cases = [
        good, samples.zipped({"../a.json": "1"}), samples.zipped({"C:/a.json": "1"}), samples.zipped({"a\\b.json": "1"}), with_twice,
        samples.patched(good, b"PK\1\2", 8, 1), samples.patched(good, b"PK\1\2", 10, 9), samples.patched(good, b"PK\5\6", 4, 1), samples.patched(good, b"PK\5\6", 10, 0xFFFF), good[:-3], good + b"x",
        samples.zipped({"x.xml": "x" * 300_000}), samples.zipped({f"{k}.txt": "" for k in range(limits.ARCHIVE_ENTRIES + 1)}), _nested(2), _nested(3), bytes(stored), samples.zipped({"a.txt": "x"}), samples.zipped({"i.zip": samples.zipped({"../e.json": "1"})}),
    ]
    return "a.zip", cases[key % len(cases)]


@with_sql("""SELECT n_nationkey, CASE k WHEN 0 THEN 'ok' WHEN 13 THEN 'ok' WHEN 14 THEN 'ARCHIVE_DEPTH' WHEN 15 THEN 'ok' WHEN 16 THEN 'ok' ELSE 'UNSAFE_ARCHIVE' END AS outcome,
    CASE k WHEN 15 THEN 'a.json: CRC checksum mismatch: a.json' WHEN 16 THEN 'Skipped unsupported file: a.txt' ELSE '' END AS notes FROM (SELECT n_nationkey, n_nationkey % 18 AS k FROM nation)""")
def archive_rules_nation(spark: SparkSession, d: str) -> DataFrame:
    """Archives that break one rule each: paths, names, flags, sizes, ratios, numbers, depth, checksums."""
    done = _convert(table(spark, d, "nation"), "n_nationkey", _odd_archive)
    return done.select("n_nationkey", F.coalesce("error.code", F.lit("ok")).alias("outcome"), F.array_join("warnings", " ").alias("notes"))


def _at_limit(key: int) -> tuple[str, bytes]:
    """Files at a limit (even) and one beyond it (odd), a pair for each limit; then files that are not what they say."""
    k, over = divmod(key, 2)
    nodes = "<i>" * (limits.TREE_DEPTH - 1 + over) + "x"
    line = lambda n: b"\n".join([b"x"] * n)
    pages = [("t", ["n"])] * (limits.PDF_PAGES + over)
    cases = [
        ("c.csv", b",".join([b"a"] * (limits.CSV_COLUMNS + over))), ("r.csv", line(limits.CSV_ROWS + over)), ("h.html", nodes.encode()), ("s.pptx", samples.pptx([("t", [])] * (limits.SLIDES + over))),
        ("p.pdf", samples.pdf(pages)), ("o.xml", b"x" * (limits.MAX_OUTPUT_BYTES - 12 + over)), ("q.csv", b'a,"b"' + b"c" * over), ("j.json", b"[1" + b"," * over + b"]"),
        ("d.docx", samples.zipped({"word/document.xml": "<!DOCTYPE a>" * over + f'<w:document xmlns:w="{samples.WORD}"><w:body/></w:document>'})),
        ("e.epub", samples.epub([("t", ["x"])] * (limits.EPUB_SPINE + over))), ("i.png", samples.picture([9], 8, 8) if not over else b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", limits.IMAGE_SIDE + 1, 1)), ("t.xml", b"<a/>" + b"\xff" * over),
    ]
    return cases[k % len(cases)]


@with_sql("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'ok' ELSE ['CSV_LIMIT', 'CSV_LIMIT', 'HTML_LIMIT', 'PPTX_LIMIT', 'PDF_LIMIT', 'OUTPUT_TOO_LARGE', 'INVALID_CSV', 'INVALID_JSON', 'UNSAFE_XML', 'INVALID_EPUB', 'IMAGE_LIMIT', 'INVALID_ENCODING'][CAST(n_nationkey // 2 % 12 AS INTEGER) + 1] END AS outcome FROM nation""")
def limits_nation(spark: SparkSession, d: str) -> DataFrame:
    """The outcome of files at each limit and just beyond."""
    return _convert(table(spark, d, "nation"), "n_nationkey", _at_limit).select("n_nationkey", F.coalesce("error.code", F.lit("ok")).alias("outcome"))


def _broken(key: int) -> tuple[str, bytes]:
    pdf = samples.pdf([("t", ["n"])])
    cases = [
        ("a.pdf", pdf.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt << /Filter /Standard >>")), ("b.pdf", b"%PDF-1.4 nothing"), ("c.docx", samples.zipped({"x": "y"})), ("d.pptx", samples.zipped({"x": "y"})), ("e.epub", samples.zipped({"x": "y"})),
        ("f.xlsx", b"no workbook"), ("g.xls", b"no workbook"), ("h.zip", b"no archive"), ("i.png", b"no picture"), ("j.jpg", b"\xff\xd8\xff\xd9"), ("k.docx", samples.zipped({"word/document.xml": "<open>"})), ("l.mp3", b""), ("m.pdf", samples.pdf([("t", ["n"])]).replace(b"[0 0 600 800]", b"[0 0 99999 9]")),
    ]
    return cases[key % len(cases)]


@with_sql("""SELECT n_nationkey, ['PDF_PASSWORD', 'INVALID_PDF', 'INVALID_DOCX', 'INVALID_PPTX', 'MISSING_ARCHIVE_ENTRY', 'INVALID_SPREADSHEET', 'INVALID_SPREADSHEET', 'UNSAFE_ARCHIVE', 'INVALID_IMAGE', 'INVALID_IMAGE', 'INVALID_XML', 'UNSUPPORTED_FORMAT', 'PDF_LIMIT'][CAST(n_nationkey % 13 AS INTEGER) + 1] AS code FROM nation""")
def broken_files_nation(spark: SparkSession, d: str) -> DataFrame:
    """The code for files that are not what their names say."""
    return _convert(table(spark, d, "nation"), "n_nationkey", _broken).select("n_nationkey", F.col("error.code").alias("code"))


@with_sql(f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'INVALID_ENCODING' ELSE 'ok' END AS outcome, CASE WHEN doc_id % 7 <> 0 THEN {_fence('text', 'xml')} END AS markdown FROM documents")
def decode_utf16_documents(spark: SparkSession, d: str) -> DataFrame:
    """Texts as UTF-16 of either byte order, and with a lone surrogate at the end."""
    odd = F.pmod("doc_id", F.lit(2)) == 1
    content = F.concat(F.unhex(F.when(odd, "FEFF").otherwise("FFFE")), F.when(odd, F.encode("text", "UTF-16BE")).otherwise(F.encode("text", "UTF-16LE")), F.unhex(F.when(F.pmod("doc_id", F.lit(7)) != 0, "").when(odd, "D800").otherwise("00D8")))
    done = conversion.convert(table(spark, d, "documents").select("doc_id", F.lit("t.xml").alias("name"), content.alias("content")))
    return done.select("doc_id", F.coalesce("error.code", F.lit("ok")).alias("outcome"), "markdown")


@with_sql(f"""SELECT event_id, '```json' || {_NL} || '{{' || {_NL} || '  "2": null,' || {_NL} || '  "10": [' || {_NL} || '    "' || event_type || '",' || {_NL} || '    true,' || {_NL} || '    {{}}' || {_NL} || '  ],' || {_NL} || '  "user": {{' || {_NL} || '    "id": ' || user_id || ',' || {_NL} || '    "half": '
    || user_id // 2 || CASE WHEN user_id % 2 = 1 THEN '.5' ELSE '' END || ',' || {_NL} || '    "say": "\\"' || event_type || '\\\\"' || {_NL} || '  }},' || {_NL} || '  "none": []' || {_NL} || '}}' || {_NL} || '```' || {_NL} AS markdown FROM events""")
def json_nested_events(spark: SparkSession, d: str) -> DataFrame:
    """Objects, lists, numbers, escapes and keys that are put in order."""
    source = F.concat(F.lit('{"user":{"id":'), F.col("user_id").cast("string"), F.lit('.0,"half":'), (F.col("user_id") / 2).cast("string"), F.lit(',"say":"\\u0022'), "event_type", F.lit('\\\\"},"none":[],"10":["'), "event_type", F.lit('",true,{}],"2":null}'))
    return conversion.convert(table(spark, d, "events").select("event_id", F.lit("e.json").alias("name"), F.encode(source, "UTF-8").alias("content"))).select("event_id", "markdown")


HREFS = ("'javascript:alert(' || page_id || ')'", "' JAVA' || chr(9) || 'script:x'", "'http://h.test/' || page_id", "'//h.test/a b'", "'mailto:a@b.test'", "'ftp://h.test/x'", "'/p(' || page_id || ')[q]<r>'", "'data:text/html,x'", "'http://'", "'#' || page_id")
SAFE = ("''", "''", "'http://h.test/' || page_id", "'//h.test/ab'", "'mailto:a@b.test'", "''", "'/p%28' || page_id || '%29%5bq%5d%3cr%3e'", "''", "''", "'#' || page_id")


def _choose(items: tuple[str, ...]) -> str:
    return "CASE page_id % 10 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(items)) + " END"


@with_sql(f"SELECT page_id, {_choose(HREFS)} AS href, {_choose(SAFE)} AS safe, 'go' AS text FROM pages")
def safe_links_pages(spark: SparkSession, d: str) -> DataFrame:
    """Links of every kind, hostile ones among them, and what is kept of each."""
    udtfs.register(spark)
    case = "CASE page_id % 10 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(HREFS)) + " END"
    rows = table(spark, d, "pages").select("page_id", F.expr(case.replace("chr(9)", "char(9)")).alias("h"))
    escaped = F.replace(F.replace("h", F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows.select("page_id", F.concat(F.lit('<p><a href="'), escaped, F.lit('">go</a></p>')).alias("html")).createOrReplaceTempView("docloom_links")
    return spark.sql("SELECT page_id, l.href, l.safe, l.text FROM docloom_links, LATERAL html_links(html) l")


@with_sql("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'order ' || o_orderkey ELSE translate(CAST(o_custkey AS VARCHAR), '0123456789', 'ابتثجحخدذر') || ' ' || o_orderkey END AS text FROM orders""")
def logical_arabic_orders(spark: SparkSession, d: str) -> DataFrame:
    """Lines as they are seen, from right to left, brought into the order in which they are read; lines without Arabic stay."""
    letters = F.translate(F.col("o_custkey").cast("string"), "0123456789", "ابتثجحخدذر")
    key = F.col("o_orderkey").cast("string")
    seen = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.concat(F.lit("order "), key)).otherwise(F.concat(key, F.lit(" "), F.reverse(letters)))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([image.logical_arabic(x) for x in b.column(1).to_pylist()], pa.string())], names=["o_orderkey", "text"])

    return table(spark, d, "orders").select("o_orderkey", seen.alias("seen")).mapInArrow(turn, "o_orderkey bigint, text string")


@with_sql(r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '[^\x21-\x7E]', ' ', 'g'), ' +', ' ', 'g')) AS x FROM conversations)
    SELECT conv_id, turn, 0.0::DOUBLE AS same, round(1.0::DOUBLE / (length(x) + 3), 9) AS one_off FROM t WHERE x <> ''""")
def nfkc_error_rate_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Error rates of texts that differ in ligatures, wide digits and spaces only, and of ones with one wrong letter."""
    text = F.trim(F.regexp_replace(F.regexp_replace("text", r"[^\x21-\x7E]", " "), " +", " "))
    dealt = table(spark, d, "conversations").repartition(4 * spark.sparkContext.defaultParallelism, "conv_id", "turn")  # short rows are a scan of a few splits
    turns = dealt.select("conv_id", "turn", text.alias("x")).where("x <> ''")
    expected = F.concat("x", F.lit(" \ufb01"))  # the ligature fi
    wide = F.translate("x", "0123456789", "".join(chr(0xFF10 + k) for k in range(10)))
    rate = lambda actual: F.round(scalars.character_error_rate(expected, actual), 9)
    return turns.select("conv_id", "turn", rate(F.concat(F.replace(wide, F.lit(" "), F.lit("\u3000 ")), F.lit("  fi"))).alias("same"), rate(F.concat("x", F.lit(" fo"))).alias("one_off"))


_CRC = "list_transform(range(256), lambda c: " + "list_reduce([c] || range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END))"


@with_sql(f"""WITH t AS (SELECT {_CRC} AS t)
    SELECT c_custkey, xor(list_reduce([4294967295] || list_transform(range(1, length(c_name) + 1), lambda i: CAST(ascii(substr(c_name, CAST(i AS INTEGER), 1)) AS BIGINT)), lambda a, b: xor(t[CAST(xor(a, b) % 256 AS INTEGER) + 1], a // 256)), 4294967295) AS own, own AS stored FROM customer, t""")
def crc_customer(spark: SparkSession, d: str) -> DataFrame:
    """CRC-32 of every name, by expression and as an archive's entry has it when it is read."""
    udtfs.register(spark)
    made = _files(table(spark, d, "customer"), "c_custkey", lambda key, name: ("n.zip", samples.zipped({"n.txt": name})), "c_name")
    made.join(table(spark, d, "customer").select("c_custkey", F.crc32(F.col("c_name").cast("binary")).alias("own")), "c_custkey").createOrReplaceTempView("docloom_crc")
    return spark.sql("SELECT c_custkey, own, z.crc32 AS stored FROM docloom_crc, LATERAL zip_entries(content) z")


# --- pictures and recognition -------------------------------------------------------------------------------------------------


def _drawn(key: int, price: float, size: int) -> tuple[str, bytes]:
    return "p.png", samples.picture([200] if key % 2 else [0, 255], 10 + size, 10)


class SizeReader:
    """Stands in for an engine: it "reads" a picture's width, and is the surer the wider it is."""

    def recognize(self, data: bytes, options: Options) -> image.Recognized:
        width, height = image.image_dimensions(data)
        return image.Recognized(f"wide {max(width, height)}" if width % 5 or options.ocr_rotation else "", width / 60, [])


_LOW = "'Low-confidence OCR (engine score ' || printf('%.2f', (10 + p_size) / 60.0 + 1e-9) || '). This score is not a measured accuracy percentage; review the text.'"


@with_sql(f"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_size % 5 <> 0 THEN 'wide ' || (10 + p_size) || {_NL} ELSE '_No text recognized._' || {_NL} END AS markdown,
    CASE WHEN p_partkey % 2 = 1 THEN 'Blank image/page: no visible text to recognize.' WHEN p_size % 5 = 0 THEN 'No text was recognized. The image may be unreadable, rotated, or in a different language. Check language/rotation in Settings and retry.' WHEN 10 + p_size < 48 THEN {_LOW} ELSE '' END AS notes FROM part""")
def recognized_part(spark: SparkSession, d: str) -> DataFrame:
    """Pictures, blank ones among them, through a recognizer that states how sure it is."""
    done = _convert(table(spark, d, "part"), "p_partkey", _drawn, "p_retailprice", "p_size", recognizer=SizeReader())
    return done.select("p_partkey", "markdown", F.array_join("warnings", " ").alias("notes"))


@with_sql("SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN 'ok' ELSE 'MODEL_UNAVAILABLE' END AS outcome FROM part")
def blank_pictures_part(spark: SparkSession, d: str) -> DataFrame:
    """Blank pictures need no recognizer; others do."""
    done = _convert(table(spark, d, "part"), "p_partkey", _drawn, "p_retailprice", "p_size")
    return done.select("p_partkey", F.coalesce("error.code", F.lit("ok")).alias("outcome"))


def _declared(key: int, price: float, size: int) -> tuple[str, bytes]:
    """The head of a PNG, or of a JPEG, that declares a size."""
    width, height = int(price * 4), size * 180
    if key % 2:
        return "p.jpg", b"\xff\xd8\xff\xc0" + struct.pack(">HBHHB", 11, 8, min(height, 65535), min(width, 65535), 1) + b"\1\x11\0\xff\xd9"
    return "p.png", b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", width, height) + b"\1\0\0\0\0" + bytes(4)


@with_sql("""SELECT p_partkey, CASE WHEN w < 1 OR h < 1 THEN 'INVALID_IMAGE' WHEN greatest(w, h) > 8192 OR w * h > 16000000 THEN 'IMAGE_LIMIT' ELSE 'MODEL_UNAVAILABLE' END AS code
    FROM (SELECT p_partkey, CAST(floor(p_retailprice * 4) AS BIGINT) AS w, CAST(p_size AS BIGINT) * 180 AS h FROM part)""")
def declared_sizes_part(spark: SparkSession, d: str) -> DataFrame:
    """Sizes that pictures declare, checked before anything is decoded."""
    done = _convert(table(spark, d, "part"), "p_partkey", _declared, "p_retailprice", "p_size")
    return done.select("p_partkey", F.col("error.code").alias("code"))


# --- batches, stores and streams ------------------------------------------------------------------------------------------------


@with_sql("""WITH f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 = 0 THEN '' ELSE 'f' || l_linenumber END AS name, CAST(CASE WHEN l_partkey % 13 = 0 THEN -1 ELSE l_quantity * 450000 END AS BIGINT) AS size FROM lineitem),
    j AS (SELECT *, name = '' OR size < 0 AS invalid, size > 20971520 AS large FROM f),
    b AS (SELECT l_orderkey, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, first(invalid ORDER BY l_linenumber, NOT invalid, name) FILTER (invalid OR large) AS bad, first(name ORDER BY l_linenumber, NOT invalid, name) FILTER (invalid OR large) AS name FROM j GROUP BY 1)
    SELECT l_orderkey, files, bytes, CASE WHEN files > 6 THEN 'TOO_MANY_FILES' WHEN bad THEN 'INVALID_FILE' WHEN bad = false THEN 'FILE_TOO_LARGE' WHEN bytes > 60000000 THEN 'BATCH_TOO_LARGE' END AS code,
    CASE WHEN files > 6 THEN 'Select up to 6 files per batch.' WHEN bad THEN 'The file selection is invalid.' WHEN bad = false THEN name || ' exceeds the 20 MB file limit.' WHEN bytes > 60000000 THEN 'Select at most 100 MB per batch.' END AS message FROM b""")
def batch_rules_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """Orders as batches of files: the first rule that each breaks, in the order of its files."""
    name = F.when(F.col("l_partkey") % 11 == 0, "").otherwise(F.concat(F.lit("f"), F.col("l_linenumber").cast("string")))
    size = F.when(F.col("l_partkey") % 13 == 0, -1).otherwise(F.col("l_quantity") * 450_000).cast("long")
    files = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name"), size.alias("size"))
    return batch.batch_fault(files, 6, 60_000_000, "l_linenumber", ("l_orderkey",))


def _nation_files(spark: SparkSession, d: str) -> DataFrame:
    content = F.when(F.col("n_nationkey") % 6 == 5, F.lit('a,"')).otherwise(F.concat(F.lit("Name,Region\n"), "n_name", F.lit(","), F.col("n_regionkey").cast("string")))
    return table(spark, d, "nation").orderBy("n_nationkey").coalesce(1).select(F.concat("n_name", F.lit(".csv")).alias("name"), F.encode(content, "UTF-8").alias("content"))


_TABLE = f"'| Name | Region |' || {_NL} || '| --- | --- |' || {_NL} || '| ' || {_cell('n_name')} || ' | ' || n_regionkey || ' |' || {_NL}"


@with_sql(f"""SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS place, n_name || '.csv' AS name, CASE WHEN n_nationkey % 6 = 5 THEN 'error' ELSE 'done' END AS state, CASE WHEN n_nationkey % 6 = 5 THEN 'CSV has an unclosed quoted field.' ELSE {_TABLE} END AS shown,
    'done' AS batch_state, (SELECT count(*) FROM nation WHERE n_nationkey % 6 = 5) AS errors FROM nation""")
def batch_store_nation(spark: SparkSession, d: str) -> DataFrame:
    """A batch staged, run in several commits, and read back in order with what is shown for each file."""
    store = batch.BatchStore(spark, scratch(spark, "store"))
    key = store.stage(_nation_files(spark, d), at=1)
    store.run(key, at=2)
    rows = store.in_order(key).select("job_id", "ordinal").join(store.messages(at=3), "job_id").withColumn("place", F.row_number().over(Window.orderBy("ordinal")).cast("long") - 1)  # of one batch's 25 files
    status = store.status().select(F.col("state").alias("batch_state"), "errors")
    return rows.select("place", "name", "state", "shown").join(F.broadcast(status))


@with_sql("""WITH s AS (SELECT o_orderkey, epoch_us(o_orderdate) // 1000 AS e FROM orders UNION ALL SELECT l_orderkey, epoch_us(l_shipdate) // 1000 FROM lineitem),
    t AS (SELECT o_orderkey, max(e) AS last_event FROM s GROUP BY 1) SELECT o_orderkey, last_event, last_event < (SELECT max(last_event) FROM t) - 86400000 AS abandoned FROM t""")
def abandoned_batches_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as batches, shipments as what happens to them: the last event of each, and whether a day has passed since by the time of the latest of all."""
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("batch_id"), epoch_ms("o_orderdate").alias("at")).unionByName(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch_id"), epoch_ms("l_shipdate").alias("at")))
    last = batch.last_events(events)
    now = events.agg(F.max("at")).first()[0] or 0
    return last.select(F.col("batch_id").alias("o_orderkey"), F.col("at").alias("last_event"), batch.abandoned(F.col("at"), now).alias("abandoned"))


_MODELS = "SELECT p_partkey AS id, CAST(p_size AS BIGINT) * 1000000 AS bytes, CAST(p_partkey AS BIGINT) * 7919 % 1000 * 3600000 AS created_at FROM part"


@with_sql(f"""WITH RECURSIVE m AS ({_MODELS}), l AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, CAST(id AS VARCHAR)) AS rn FROM m WHERE id % 3 <> 0 AND created_at + 1800000000 > 3596400000),
    r AS (SELECT rn, id, bytes, CASE WHEN bytes <= 64000000 THEN bytes ELSE 0 END AS used, bytes <= 64000000 AS kept FROM l WHERE rn = 1 UNION ALL SELECT l.rn, l.id, l.bytes, r.used + CASE WHEN r.used + l.bytes <= 64000000 THEN l.bytes ELSE 0 END, r.used + l.bytes <= 64000000 FROM r JOIN l ON l.rn = r.rn + 1)
    SELECT CAST(id AS VARCHAR) AS id, bytes FROM r WHERE kept""")
def models_kept_part(spark: SparkSession, d: str) -> DataFrame:
    """Parts as stored models: unknown ones and old ones go, and the newest that fit a budget stay."""
    records = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_size").cast("long") * 1_000_000).alias("bytes"), (F.col("p_partkey") * 7919 % 1000 * 3_600_000).alias("created_at"), (F.col("p_partkey") % 3 != 0).alias("known"))
    return models.kept(records.where("known"), None, 999 * 3_600_000, 500, 64_000_000).select("id", "bytes")


@with_sql(f"SELECT CASE WHEN n_nationkey % 6 = 5 THEN 'error' ELSE 'done' END AS state, CASE WHEN n_nationkey % 6 = 5 THEN 'INVALID_CSV' END AS code, CASE WHEN n_nationkey % 6 <> 5 THEN {_TABLE} END AS markdown FROM nation")
def stream_nation(spark: SparkSession, d: str) -> DataFrame:
    """Files that lie in a folder, converted by a stream that takes each once."""
    folder = scratch(spark, "inbox")
    _nation_files(spark, d).select(F.decode("content", "UTF-8").alias("value")).repartition(25, "value").write.option("maxRecordsPerFile", 1).text(folder)
    target, state = scratch(spark, "converted"), scratch(spark, "stream-state")
    for _ in range(2):  # the second run finds nothing new
        ingest.start(spark, folder, target, state, glob="part-*", override="csv").awaitTermination()
    return ingest.results(spark, target).select("state", F.col("error.code").alias("code"), "markdown")


@with_sql("SELECT count(*) AS files, CAST(sum(strlen(CASE WHEN n_nationkey % 6 = 5 THEN 'a,\"' ELSE 'Name,Region' || chr(10) || n_name || ',' || n_regionkey END) + 1) AS BIGINT) AS bytes, 0 AS too_large, count(*) AS named FROM nation")
def read_files_nation(spark: SparkSession, d: str) -> DataFrame:
    """Files of a folder by a pattern, with their sizes; contents are not read."""
    folder = scratch(spark, "inbox")
    _nation_files(spark, d).select(F.decode("content", "UTF-8").alias("value")).repartition(25, "value").write.option("maxRecordsPerFile", 1).text(folder)
    found = sources.read_files(spark, folder, glob="part-*.txt").where("size > 0")
    return sources.size_report(found).join(F.broadcast(found.agg(F.count_if(F.endswith("name", F.lit(".txt"))).alias("named"))))


# --- pages ------------------------------------------------------------------------------------------------------------------------


def _text(x: str) -> str:
    """A text node as Markdown: entities, white space, then what would be taken for markup."""
    for a, b in (("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    x = rf"trim(regexp_replace({x}, '[ \t\r\n]+', ' ', 'g'))"
    for a, b in (("\\", "\\\\"), ("*", "\\*")):
        x = f"replace({x}, '{a}', '{b}')"
    for a, b in ((r"^-", r"\\-"), (r"^\+ ", r"\\+ "), (r"^(=+)", r"\\\1"), (r"^(#{1,6}) ", r"\\\1 ")):
        x = f"regexp_replace({x}, '{a}', '{b}')"
    x = rf"regexp_replace(replace({x}, '`', '\`'), '^~~~', '\\~~~')"
    x = rf"replace(replace({x}, '[', '\['), ']', '\]')"
    return rf"regexp_replace(replace(regexp_replace({x}, '^>', '\\>'), '_', '\_'), '^(\d+)\. ', '\1\\. ')"


_PAGE = rf"""WITH b AS (SELECT page_id, url, html, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav, regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ad, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS title,
    regexp_extract_all(regexp_extract(html, '(?s)</h1>(.*?)</article>', 1), '(?s)<p>(?:<b>)?([^<]+)', 0) AS paragraphs, regexp_extract(html, '(?s)<footer>([^<]*)', 1) AS footer FROM pages),
    m AS (SELECT *, array_to_string(list_transform(regexp_extract_all(nav, '(?s)<a href="[^"]*">[^<]*', 0), lambda a: '-   [' || {_text("regexp_extract(a, '(?s)>(.*)$', 1)")} || '](' || regexp_extract(a, '"([^"]*)"', 1) || ')'), chr(10)) AS links,
    list_transform(paragraphs, lambda p: CASE WHEN starts_with(p, '<p><b>') THEN '**' || {_text("regexp_extract(p, '(?s)^<p><b>(.*)$', 1)")} || '**' ELSE {_text("regexp_extract(p, '(?s)^<p>(.*)$', 1)")} END) AS blocks FROM b),
    o AS (SELECT page_id, url, array_to_string(list_filter([links, {_text('ad')}, '# ' || {_text('title')}] || blocks || [{_text('footer')}], lambda x: x <> ''), chr(10) || chr(10)) || chr(10) AS markdown FROM m)
    SELECT page_id, url, 'done' AS state, CAST(NULL AS VARCHAR) AS error_code, 0::BIGINT AS n_warnings, strlen(markdown) AS bytes, markdown FROM o"""
ORACLE["html_to_markdown_pages"] = _PAGE

ORACLE["layout_text_lineitem"] = """WITH t AS (SELECT l_orderkey, 'p' || l_partkey AS text, CAST(l_suppkey % 500 AS DOUBLE) + l_linenumber / 10.0::DOUBLE AS x, CAST(l_linenumber // 2 * 15 AS DOUBLE) AS y, l_suppkey % 3 = 0 AS rtl FROM lineitem),
    w AS (SELECT *, 5.0::DOUBLE * length(text) AS w FROM t), s AS (SELECT *, x + w < 279 AS l, x > 321 AS r FROM w),
    p AS (SELECT l_orderkey, count(*) AS n, least(count(*) FILTER (l), count(*) FILTER (r)) >= 2 AND count(*) FILTER (l) + count(*) FILTER (r) = count(*) AS two, 2 * count(*) FILTER (rtl) > count(*) AS rtl FROM s GROUP BY 1),
    c AS (SELECT s.*, CASE WHEN NOT two THEN 0 WHEN p.rtl THEN CASE WHEN r THEN 0 ELSE 1 END ELSE CASE WHEN r THEN 1 ELSE 0 END END AS col FROM s JOIN p USING (l_orderkey)),
    d AS (SELECT *, 2 * count(*) FILTER (rtl) OVER g > count(*) OVER g AS line_rtl FROM c WINDOW g AS (PARTITION BY l_orderkey, col, y)),
    e AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, col, y ORDER BY CASE WHEN line_rtl THEN -x ELSE x END, text) AS k FROM d),
    f AS (SELECT *, CASE WHEN line_rtl THEN lag(x) OVER o - x - w ELSE x - lag(x) OVER o - lag(w) OVER o END AS gap FROM e WINDOW o AS (PARTITION BY l_orderkey, col, y ORDER BY k)),
    g AS (SELECT l_orderkey, col, y, string_agg(CASE WHEN gap > 1.5 THEN ' ' ELSE '' END || text, '' ORDER BY k) AS line FROM f GROUP BY 1, 2, 3),
    h AS (SELECT *, lag(y) OVER (PARTITION BY l_orderkey, col ORDER BY y DESC) - y > 17 AS wide FROM g),
    i AS (SELECT l_orderkey, col, string_agg(CASE WHEN wide THEN chr(10) ELSE '' END || line, chr(10) ORDER BY y DESC) AS text FROM h GROUP BY 1, 2)
    SELECT l_orderkey, string_agg(text, chr(10) || chr(10) ORDER BY col) AS text FROM i GROUP BY 1"""
