"""Markdown rendering and file checks as Spark columns, and as SQL functions of the same names.

All but error_rate are built-in expressions, so they stay in generated code and can be pushed down.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from docloom.functions import limits
from docloom.functions.edits import levenshtein

#: What is escaped in a cell, in this order (fixed values).
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\\", "\\\\"), ("|", "\\|"), ("`", "\\`"), ("*", "\\*"), ("_", "\\_"), ("[", "\\["), ("]", "\\]"))
EMPTY_TABLE = "_Empty CSV file._\n"
#: White space as ECMAScript's \s has it, for Java's regular expressions.
SPACE = r"[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def md_cell(value: Column) -> Column:
    """A value as the text of a table cell; null is empty."""
    out = F.coalesce(value.cast("string"), F.lit(""))
    for a, b in ESCAPES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, "\r\n|\r|\n", "<br>")


def md_heading(value: Column) -> Column:
    return F.replace(md_cell(value), F.lit("<br>"), F.lit(" "))


def md_text(value: Column) -> Column:
    """Escaped like a cell, with line ends kept as such."""
    return F.replace(md_cell(value), F.lit("<br>"), F.lit("\n"))


def md_fence(text: Column, language: str | Column = "") -> Column:
    """A code block whose fence is longer than any run of backticks in it."""
    language = F.lit(language) if isinstance(language, str) else language
    length = F.aggregate(F.regexp_extract_all(text, F.lit("(`+)"), 1), F.lit(3), lambda m, x: F.greatest(m, F.length(x) + 1))
    fence = F.repeat(F.lit("`"), length)
    return F.concat(fence, language, F.lit("\n"), text, F.lit("\n"), fence, F.lit("\n"))


def md_table(rows: Column) -> Column:
    """A table of array<array<string>>; the first row is the header, short rows are filled up with blanks."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def places(f) -> Column:
        return F.transform(F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>")), f)

    body = F.transform(rows, lambda r: line(places(lambda i: md_cell(F.get(r, i)))))
    rule = line(places(lambda i: F.lit("---")))
    lines = F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, F.lit(2), F.greatest(F.size(body) - 1, F.lit(0))))
    return F.when(F.size(rows) == 0, F.lit(EMPTY_TABLE)).otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n")))


def left_units(text: Column, n: int) -> Column:
    """The first n UTF-16 units of a text; a character that is cut in two leaves U+FFFD."""
    units = F.encode(text, "UTF-16LE")
    cut = F.substring(units, 1, 2 * n)
    torn = F.rlike(F.hex(F.substring(units, 2 * n, 1)), F.lit("^D[89AB]"))
    whole = F.decode(F.when(torn, F.substring(cut, 1, 2 * n - 2)).otherwise(cut), "UTF-16LE")
    return F.when(F.length(text) * 2 <= n, text).when(F.octet_length(units) <= 2 * n, text).when(torn, F.concat(whole, F.lit("\ufffd"))).otherwise(whole)


def output_name(name: Column) -> Column:
    """The Markdown file's name for a file's name."""
    base = F.regexp_replace(name, r"\.[^.]+\z", "")
    base = F.regexp_replace(base, r'[<>:"/\\|?*\x00-\x1f]', "_")
    base = left_units(F.regexp_replace(base, r"[ .]+\z", ""), limits.NAME_CHARS)
    base = F.when(base == "", "document").otherwise(base)
    return F.concat(F.when(F.rlike(base, F.lit(r"(?i)\A(con|prn|aux|nul|com[1-9]|lpt[1-9])\z")), "_").otherwise(""), base, F.lit(".md"))


def detect_format(name: Column, mime: Column | None = None) -> Column:
    """The format's id by extension, or by MIME type for a name without a dot; null where neither is known."""

    def lookup(table: dict[str, str], key: Column) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)

    by_extension = lookup(limits.BY_EXTENSION, F.lower(F.substring_index(name, ".", -1)))
    if mime is None:
        return by_extension
    return F.coalesce(by_extension, F.when(~F.contains(name, F.lit(".")), lookup(limits.BY_MIME, F.coalesce(mime, F.lit("")))))


def usable_text(text: Column) -> Column:
    """Whether a page's own text will do: three letters or digits at least, half of what is visible, nothing undecodable."""
    visible = F.regexp_replace(text, SPACE, "")
    letters = F.regexp_count(visible, F.lit(r"[\p{L}\p{N}]"))
    units = F.length(visible) + F.regexp_count(visible, F.lit(r"[\x{10000}-\x{10FFFF}]"))  # UTF-16 units
    return (letters >= 3) & (letters / F.greatest(units, F.lit(1)) >= 0.5) & ~F.contains(visible, F.lit("\ufffd"))


def unsafe_path(path: Column) -> Column:
    """Whether a name may not be taken from an archive."""
    return (path == "") | F.rlike(path, F.lit(r"(?i)\\|[\x00-\x1f]|\A/|\A[a-z]:|(\A|/)\.\.(/|\z)"))


def has_entities(source: Column) -> Column:
    """Whether XML declares a document type or entities."""
    return F.rlike(source, F.lit(r"(?i)<!" + SPACE + r"*(?:DOCTYPE|ENTITY)\b"))


def decode_utf8(content: Column) -> Column:
    """The text of UTF-8 bytes without a byte order mark (and one more U+FEFF after it); null where they are malformed."""
    return F.regexp_replace(F.try_validate_utf8(content.cast("string")), "\\A\ufeff{1,2}", "")


def file_signature(content: Column) -> Column:
    """zip, ole, jpeg, png or null by the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(F.startswith(head, F.lit("504B")), "zip").when(F.startswith(head, F.lit("D0CF11E0")), "ole").when(F.startswith(head, F.lit("FFD8")), "jpeg").when(head == "89504E470D0A1A0A", "png")


def memory_estimate(size: Column, fmt: Column) -> Column:
    """Bytes to set aside for a file: a floor by format and eight times its size."""
    floor = F.when(fmt.isin("pdf", "image", "zip"), 320).when(fmt.isin("xlsx", "xls", "docx", "epub", "pptx"), 96).otherwise(20)
    return (floor * limits.MIB + 8 * size).cast("long")


def render_scale(width: Column, height: Column) -> Column:
    """The scale at which a page is rendered; null where the page is not of an allowed size."""
    ok = (width > 0) & (height > 0) & (F.greatest(width, height) <= limits.PDF_SIDE) & ~F.isnan(width) & ~F.isnan(height)
    return F.when(ok, F.least(F.lit(2.0), F.lit(float(limits.RENDER_SIDE)) / F.greatest(width, height), F.sqrt(F.lit(float(limits.RENDER_PIXELS)) / (width * height))))


def bounded_size(width: Column, height: Column) -> Column:
    """struct(width, height, scale) of an image brought within the limits for recognition."""
    scale = F.least(F.lit(1.0), F.lit(float(limits.RENDER_SIDE)) / F.greatest(width, height), F.sqrt(F.lit(float(limits.RENDER_PIXELS)) / (width * height)))
    side = lambda x: F.greatest(F.lit(1).cast("long"), F.floor(x * scale))
    return F.struct(side(width).alias("width"), side(height).alias("height"), scale.alias("scale"))


def image_ok(width: Column, height: Column) -> Column:
    """ok, INVALID_IMAGE or IMAGE_LIMIT for declared dimensions."""
    bad = width.isNull() | height.isNull() | (width < 1) | (height < 1)
    large = (F.greatest(width, height) > limits.IMAGE_SIDE) | (width.cast("long") * height.cast("long") > limits.IMAGE_PIXELS)
    return F.when(bad, "INVALID_IMAGE").when(large, "IMAGE_LIMIT").otherwise("ok")


def error_rate(expected: Column, actual: Column) -> Column:
    """Levenshtein distance by length of what is expected, white space collapsed."""
    norm = lambda c: F.btrim(F.regexp_replace(c, SPACE + "+", " "))
    return levenshtein(norm(expected), norm(actual)) / F.length(norm(expected))


def ordered_concat(order: Column, section: Column, separator: str) -> Column:
    """The sections of a group in order, joined (an aggregate)."""
    parts = F.array_sort(F.collect_list(F.struct(order.alias("o"), section.alias("s"))))
    return F.array_join(F.transform(parts, lambda x: x["s"]), separator)


def distinct_in_order(items: Column) -> Column:
    """The distinct items of an array, as first seen."""
    return F.array_distinct(items)


def register(spark: SparkSession) -> None:
    """Temporary SQL functions with the names of this module's columns; they are SQL expressions and are put into the plan."""
    cell = "coalesce(x, '')"
    for a, b in ESCAPES:
        quote = lambda s: s.replace("\\", "\\\\")
        cell = f"replace({cell}, '{quote(a)}', '{quote(b)}')"
    cell = f"regexp_replace({cell}, '\\r\\n|\\r|\\n', '<br>')"
    fence = "repeat('`', aggregate(regexp_extract_all(x, '(`+)', 1), 3, (m, r) -> greatest(m, length(r) + 1)))"
    spaces = SPACE.replace("\\", "\\\\")
    width = "array_max(transform(x, r -> size(r)))"
    places = f"if({width} > 0, sequence(0, {width} - 1), cast(array() as array<int>))"
    line = lambda cells: f"concat('| ', array_join({cells}, ' | '), ' |')"
    body = f"transform(x, r -> {line(f'transform({places}, i -> {cell.replace("coalesce(x,", "coalesce(get(r, i),")})')})"
    rule = line(f"transform({places}, i -> '---')")
    rows = f"concat(slice({body}, 1, 1), array({rule}), slice({body}, 2, greatest(size(x) - 1, 0)))"
    stem = "regexp_replace(x, '\\\\.[^.]+\\\\z', '')"
    stem = f"""regexp_replace({stem}, '[<>:"/\\\\\\\\|?*\\\\x00-\\\\x1f]', '_')"""
    stem = f"left(regexp_replace({stem}, '[ .]+\\\\z', ''), {limits.NAME_CHARS})"
    stem = f"if({stem} = '', 'document', {stem})"
    known = lambda table: "map(" + ", ".join(f"'{k}', '{v}'" for k, v in table.items()) + ")"
    for sql in (
        f"md_table(x ARRAY<ARRAY<STRING>>) RETURNS STRING RETURN if(size(x) = 0, '{EMPTY_TABLE[:-1]}\\n', concat(array_join({rows}, '\\n'), '\\n'))",
        f"md_output_name(x STRING) RETURNS STRING RETURN concat(if(rlike({stem}, '(?i)\\\\A(con|prn|aux|nul|com[1-9]|lpt[1-9])\\\\z'), '_', ''), {stem}, '.md')",
        f"md_detect_format(x STRING, mime STRING) RETURNS STRING RETURN coalesce(try_element_at({known(limits.BY_EXTENSION)}, lower(substring_index(x, '.', -1))), if(contains(x, '.'), NULL, try_element_at({known(limits.BY_MIME)}, coalesce(mime, ''))))",
        f"md_cell(x STRING) RETURNS STRING RETURN {cell}",
        f"md_fence(x STRING, lang STRING) RETURNS STRING RETURN concat({fence}, lang, '\\n', x, '\\n', {fence}, '\\n')",
        f"usable_text(x STRING) RETURNS BOOLEAN RETURN regexp_count(x, '[\\\\p{{L}}\\\\p{{N}}]') >= 3 AND regexp_count(x, '[\\\\p{{L}}\\\\p{{N}}]') / greatest(length(regexp_replace(x, '{spaces}', '')) + regexp_count(x, '[\\\\x{{10000}}-\\\\x{{10FFFF}}]'), 1) >= 0.5 AND NOT contains(x, '\ufffd')",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {sql}")
