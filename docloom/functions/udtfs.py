"""Table functions for SQL: rows of a CSV text, entries of an archive, links of a page."""

from __future__ import annotations

import zlib

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from docloom.functions.limits import ConversionError
from docloom.kernels.archive import Archive
from docloom.kernels.base import Context
from docloom.kernels.html import _Builder, safe_link
from docloom.kernels.text import parse_csv


@udtf(returnType="row_no int, fields array<string>, error string")
class CsvRows:
    """csv_rows(text): a row for each record, or one with the error's code."""

    def eval(self, text: str):
        try:
            for n, fields in enumerate(parse_csv(text or "")):
                yield n, fields, None
        except ConversionError as error:
            yield None, None, error.code


@udtf(returnType="entry_no int, name string, bytes bigint, crc32 bigint, content binary, error string")
class ZipEntries:
    """zip_entries(content): the files of an archive, checked and inflated, or the error that ended it."""

    def eval(self, content: bytes):
        try:
            archive = Archive(bytes(content or b""), Context())
            for n, entry in enumerate(archive.files()):
                data = archive.read(entry.name)
                yield n, entry.name, len(data), zlib.crc32(data), data, None
        except ConversionError as error:
            yield None, None, None, None, None, error.code


@udtf(returnType="link_no int, href string, safe string, text string")
class HtmlLinks:
    """html_links(html): links in order, with what would be kept of them."""

    def eval(self, html: str):
        builder = _Builder()
        try:
            builder.feed(html or "")
            builder.close()
        except ConversionError:
            return
        for n, a in enumerate(x for x in builder.root.walk() if x.name == "a" and "href" in x.attributes):
            yield n, a.attributes["href"], safe_link(a.attributes["href"]), a.text().strip()


def register(spark: SparkSession) -> None:
    for name, f in (("csv_rows", CsvRows), ("zip_entries", ZipEntries), ("html_links", HtmlLinks)):
        spark.udtf.register(name, f)
