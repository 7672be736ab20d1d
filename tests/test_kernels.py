"""Converters against expected documents and codes."""

from __future__ import annotations

import struct
import time
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.functions import limits
from docloom.functions.edits import distance
from docloom.functions.limits import ConversionError, Options, detect_format, error_info
from docloom.kernels import archive, base, html, image, jpeg, layout, numfmt, pdf, presentation, router, text, workbook, xmltree
from docloom.kernels.base import Context, decode_text, fenced
from docloom.kernels.layout import Token, layout_text, usable_text
from tests import fixtures as fx


def convert(name, data, **options):
    return router.convert(name, data.encode() if isinstance(data, str) else data, **options)


def code(f, *args, **kwargs):
    with pytest.raises(ConversionError) as e:
        f(*args, **kwargs)
    return e.value.code


def test_routing():
    assert len(limits.FORMATS) == 13
    for f in limits.FORMATS:
        if f.extensions:
            assert detect_format(f"FILE.{f.extensions[0].upper()}") == f.id
    assert detect_format("photo.jpg", override="exif") == "exif"
    assert detect_format("book.xlsx", "application/zip") == "xlsx"
    assert detect_format("document", "text/csv") == "csv"
    assert detect_format("csv") == "csv"
    assert detect_format("export.txt", override="json") == "json"
    for name in ("file.ppt", "file.mp3", "macro.xlsm", "a.b", ""):
        assert code(detect_format, name) == "UNSUPPORTED_FORMAT"
    assert code(detect_format, "x.csv", None, "missing") == "UNSUPPORTED_FORMAT"


def test_csv():
    assert text.parse_csv('k,l\r\n"x,y","""z"" said"\r\n"up\ndown",') == [["k", "l"], ["x,y", '"z" said'], ["up\ndown", ""]]
    assert convert("t.csv", "Mast,Sail\nmain,3\n").markdown == "| Mast | Sail |\n| --- | --- |\n| main | 3 |\n"
    out = convert("t.csv", 'سفينة,وصف\nشراع,"p|q <b> *r*"').markdown
    assert "شراع" in out and "p\\|q &lt;b&gt; \\*r\\*" in out
    assert convert("e.csv", "").markdown == "_Empty CSV file._\n"
    assert len(convert("r.csv", "a,b\n1").warnings) == 1
    for bad in ('a,"unclosed', 'a,"x"extra', 'ab"cd', '"a""'):
        assert code(text.parse_csv, bad) == "INVALID_CSV"
    assert code(text.parse_csv, ",".join("x" * 1001)) == "CSV_LIMIT"
    assert len(text.parse_csv("x\n" * 50_000)) == 50_000 and code(text.parse_csv, "x\n" * 50_001) == "CSV_LIMIT"
    assert text.parse_csv("\r\r\n\n") == [[""], [""], [""]] and text.parse_csv('""') == [[""]] and text.parse_csv("a\n,") == [["a"], ["", ""]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text(max_size=8), min_size=1, max_size=4), min_size=1, max_size=5))
def test_csv_round_trip(rows):
    source = "\n".join(",".join('"' + f.replace('"', '""') + '"' for f in row) for row in rows)
    assert text.parse_csv(source) == rows


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="`a\n", max_size=30))
def test_fence_cannot_be_broken(source):
    block = fenced(source)
    fence = block.split("\n")[0]
    assert len(fence) >= 3 and fence not in source and block == f"{fence}\n{source}\n{fence}\n"


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=30))
def test_cell_has_no_raw_pipe_or_line_end(value):
    out = base.cell(value)
    assert "\n" not in out and "\r" not in out and not [i for i, c in enumerate(out) if c == "|" and out[i - 1] != "\\"]


def test_json():
    assert convert("d.json", '{"ok":true}').markdown == '```json\n{\n  "ok": true\n}\n```\n'
    for bad in ("{", "", "NaN", "[1,]", '{"a":1}x', "01", "'a'", "[Infinity]", '"\t"'):
        assert code(convert, "b.json", bad) == "INVALID_JSON"
    body = lambda s: convert("x.json", s).markdown[8:-5]
    assert body('{"b":1,"10":2,"2":3,"b":4}') == '{\n  "2": 3,\n  "10": 2,\n  "b": 4\n}'
    numbers = {"1.0": "1", "1e21": "1e+21", "123456789012345680000": "123456789012345680000", "1e400": "null", "-0": "0", "0.1": "0.1", "1e-7": "1e-7", "0.000001": "0.000001", "5e-324": "5e-324", "1.5e300": "1.5e+300", "100": "100", "-12.50": "-12.5"}
    assert all(body(a) == b for a, b in numbers.items())
    assert body('"\\ud800 é\\u2028\\u001f/\\/"') == '"\\ud800 é\u2028\\u001f//"' and body("[]") == "[]" and body("{}") == "{}"


def test_xml_source_and_text():
    source = "<root><item>مرحبا</item></root>"
    out = convert("d.xml", source)
    assert out.markdown == f"```xml\n{source}\n```\n" and "not validated" in out.warnings[0]
    assert decode_text(b"\xff\xfeA\0") == "A" and decode_text(b"\xfe\xff\0A") == "A" and decode_text(b"\xef\xbb\xbfA") == "A"
    assert code(decode_text, b"\xff") == "INVALID_ENCODING" and code(decode_text, b"\xff\xfe\0\xd8") == "INVALID_ENCODING"
    assert fenced("```\nhello") == "````\n```\nhello\n````\n"
    assert code(convert, "large.xml", "x" * limits.MAX_OUTPUT_BYTES) == "OUTPUT_TOO_LARGE"


def test_settings():
    assert Options(cache_hours="24").cache_hours == 24 and Options(pdf_force_ocr=1).pdf_force_ocr is False
    for bad in ({"cache_hours": 0}, {"cache_hours": 721}, {"cache_hours": 1.5}, {"model_cache_hours": "abc"}, {"ocr_language": "fr"}, {"ocr_rotation": 45}):
        with pytest.raises(ValueError):
            Options(**bad)
    assert error_info(ConversionError("A", "b" * 2000)) == ("A", "b" * 1000) and error_info(KeyError())[0] == "CONVERSION_FAILED"


def test_html():
    out = html.html_to_markdown('<h1>Fauna</h1><p><b>wolf</b> and <i>lynx</i>, <a href="http://zoo.test/map">a map</a></p><ul><li>fur</li><li>paw</li></ul><table><tr><th>kind</th><th>legs</th></tr><tr><td>newt</td><td>4</td></tr></table>').markdown
    assert out == "# Fauna\n\n**wolf** and *lynx*, [a map](http://zoo.test/map)\n\n-   fur\n-   paw\n\n| kind | legs |\n| --- | --- |\n| newt | 4 |\n"
    bad = html.html_to_markdown('<script>steal()</script><a href="java&#115;cript:steal()" onfocus="steal()">Press</a><img src="http://spy.test/dot.gif" onload="steal()" alt="Chart"><iframe src="http://spy.test">inside</iframe>')
    assert bad.markdown == "Press[Image: Chart]\n" and "alt text" in bad.warnings[0]
    head = html.html_to_markdown("<html><head><title>Hidden title</title></head><body><pre>```\nhello</pre></body></html>").markdown
    assert "Hidden title" not in head and head.startswith("````")
    assert code(html.html_to_markdown, "<div>" * 130 + "x" + "</div>" * 130) == "HTML_LIMIT"
    assert code(html.html_to_markdown, "<b></b>" * 100_001) == "HTML_LIMIT"
    rules = {
        "<p>a <del>b</del> <s>c</s></p>": "a ~~b~~ ~~c~~\n",
        "<p>x<br>y</p><hr><p>z": "x  \ny\n\n* * *\n\nz\n",
        "<ol start=3><li>a</li><li>b</li></ol>": "3.  a\n4.  b\n",
        "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>": "-   a\n    -   b\n-   c\n",
        "<blockquote><p>q</p></blockquote>": "> q\n",
        "<p><code>a`b</code></p>": "``a`b``\n",
        '<a href="/p (1)" title="T">x</a>': '[x](/p%281%29 "T")\n',
        "<p>1. a</p><p># b</p><p>- c</p><p>*d* _e_ [f]</p>": "1\\. a\n\n\\# b\n\n\\- c\n\n\\*d\\* \\_e\\_ \\[f\\]\n",
        "<p>a<b> b </b>c</p>": "a **b** c\n",
        "<p></p><div> </div>x": "x\n",
        "<p>one<p>two<li>three": "one\n\ntwo\n\n-   three\n",
        "<td colspan=2>": "\n",
        "<table></table>": "_Empty CSV file._\n",
    }
    for source, want in rules.items():
        assert html.html_to_markdown(source).markdown == want, source
    assert html.html_to_markdown("<table><tr><td colspan=2>a</td></tr></table>").warnings == [html.MERGED]
    nested = html.html_to_markdown("<table><tr><td>a<table><tr><td>in</td></tr></table></td><td>b</td></tr></table>").markdown
    assert nested == "| ain | b |\n| --- | --- |\n"
    for link, want in {"http://a b/": "http://ab/", "javascript:x": "", "mailto:a@b.c": "mailto:a@b.c", "/x[1]": "/x%5b1%5d", "data:x": "", "HTTP://x": "HTTP://x", "a:b": "", "#f": "#f"}.items():
        assert html.safe_link(link) == want, link


def test_xml_tree():
    assert code(xmltree.parse_xml, '<!DOCTYPE root SYSTEM "file:///secret"><root/>') == "UNSAFE_XML"
    assert code(xmltree.parse_xml, "<! \n entity a><root/>") == "UNSAFE_XML"
    for bad in ("<root><item></root>", "", "text", "<a/><b/>", "<a>" * 130 + "</a>" * 130, "<a>" + "<b/>" * 100_000 + "</a>"):
        assert code(xmltree.parse_xml, bad) == "INVALID_XML"
    root = xmltree.parse_xml('<?xml version="1.0" encoding="utf-16"?><r xmlns:p="u" xmlns="v"><p:a p:k="1" k="2">é<b>x</b></p:a></r>')
    a = root.first("a")
    assert (a.namespace, a.get("k"), a.get("k", "u"), a.text(), root.namespace) == ("u", "2", "1", "éx", "v")


def test_archive():
    entries = archive.inspect(fx.zip_files({"a.json": "{}", "b/c.csv": "x"}))
    assert [e.name for e in entries] == ["a.json", "b/c.csv"]
    for path in ("../x", "/x", "C:/x", "a/../x", "a\\x", "", "a\x00b"):
        assert code(archive.safe_path, path) == "UNSAFE_ARCHIVE"
    assert archive.safe_path("a..b/c") == "a..b/c"
    good = fx.zip_files({"a.json": "{}"})
    for bad in (b"", good[:-1], good + b"x", b"x" + good, fx.zip_files({f"{i}.csv": "x" for i in range(2001)}), fx.zip_files({"x.xml": "x" * 1_000_000}), fx.zip_files({"../evil.json": "{}"})):
        assert code(archive.inspect, bad) == "UNSAFE_ARCHIVE"
    end = good.rfind(b"PK\5\6")
    for at, value in ((end + 4, 1), (end + 10, 0xFFFF), (end + 12, 1)):
        assert code(archive.inspect, good[:at] + struct.pack("<H", value) + good[at + 2 :]) == "UNSAFE_ARCHIVE"
    central = good.rfind(b"PK\1\2")
    assert code(archive.inspect, good[: central + 8] + b"\1" + good[central + 9 :]) == "UNSAFE_ARCHIVE"  # encrypted
    context = Context()
    opened = archive.Archive(fx.zip_files({"a.json": "{}", "b.json": "{}"}), context)
    assert opened.read("a.json") + opened.read("b.json") == b"{}{}" and context.budget.bytes == 4
    context.budget.bytes = limits.ARCHIVE_EXPANDED_BYTES - 1
    assert code(opened.read, "a.json") == "UNSAFE_ARCHIVE"
    assert code(opened.read, "c.json") == "MISSING_ARCHIVE_ENTRY"
    stored = bytearray(fx.zip_files({"a.json": "{}"}, zipfile.ZIP_STORED))
    stored[36] = 0x5B
    assert code(archive.Archive(bytes(stored), Context()).read, "a.json") == "INVALID_ARCHIVE"


def test_zip():
    out = convert("m.zip", fx.zip_files({"good.json": '{"ok":true}', "bad.json": "{", "other.pdf": "x", "page.html": "<h1>Hello</h1>", "n.txt": "x"}))
    assert "## good.json" in out.markdown and "\n---\n\n## page.html\n\n# Hello" in out.markdown
    assert any("bad.json: Invalid JSON" in w for w in out.warnings) and any(w.startswith("other.pdf: ") for w in out.warnings) and "Skipped unsupported file: n.txt" in out.warnings
    nested = convert("m.zip", fx.zip_files({"report.docx": fx.docx(), "book.epub": fx.epub(), "sheet.xlsx": fx.xlsx()})).markdown
    assert all(x in nested for x in ("Harbour log", "Northern lights", "Catch"))
    assert convert("e.zip", fx.zip_files({"a.txt": "x"})).markdown == "_No convertible files in this archive._\n"
    deep = fx.zip_files({"data.json": "{}"})
    for _ in range(2):
        deep = fx.zip_files({"nested.zip": deep})
    assert "data.json" in convert("d.zip", deep).markdown
    assert code(convert, "d.zip", fx.zip_files({"nested.zip": deep})) == "ARCHIVE_DEPTH"
    assert code(convert, "t.zip", fx.zip_files({"inner.zip": fx.zip_files({"../evil.json": "{}"})})) == "UNSAFE_ARCHIVE"
    many = fx.zip_files({f"{i}.zip": fx.zip_files({f"{k}.txt": "x" for k in range(700)}) for i in range(3)})
    assert code(convert, "many.zip", many) == "UNSAFE_ARCHIVE"


def test_pptx():
    out = convert("deck.pptx", fx.pptx())
    for want in ("## Slide 1\n\n### Opening plate", "  - Indented remark", "| Brig | 12 |", "Inner كلمة", "### Speaker notes\n\nSpeak slowly here.", "## Slide 2\n\n### Closing"):
        assert want in out.markdown, want
    assert "Printed by the club" not in out.markdown and "123" not in out.markdown
    assert out.warnings == [presentation.SCOPE, "Slide 1: Unsupported presentation content (chart) is omitted; embedded images are not recognized."]
    sections = '<p:extLst><p14:sectionLst xmlns:p14="urn:p14"><p14:section><p14:sldIdLst><p14:sldId id="256"/><p14:sldId id="9"/></p14:sldIdLst></p14:section></p14:sectionLst></p:extLst>'
    assert convert("d.pptx", fx.pptx(sections)).markdown.count("## Slide") == 2
    assert code(convert, "d.pptx", b"\xd0\xcf\x11\xe0") == "INVALID_PPTX" and code(convert, "d.pptx", fx.zip_files({"a": "b"})) == "INVALID_PPTX"
    for target in ("http://x/y", "/abs", "a?b", "a#b", "a\\b", "../../../x", "%", "%2e%2e/%2e%2e/%2e%2e/x", "", None):
        assert code(presentation.part_name, "ppt/slides/s.xml", target) in ("INVALID_PPTX", "UNSAFE_ARCHIVE")
    assert presentation.part_name("ppt/slides/s.xml", "../a%20b/./c.xml") == "ppt/a b/c.xml"


def test_epub():
    out = convert("b.epub", fx.epub())
    assert out.markdown == "# Pocket atlas\n\n## Chapter 1\n\n# Northern lights\n\nA\n\n## Chapter 2\n\n# Southern seas\n\nB\n" and out.warnings == ["Skipped non-HTML spine item pic."]
    turned = convert("b.epub", fx.epub(reverse=True)).markdown
    assert turned.index("Southern seas") < turned.index("Northern lights")
    assert code(convert, "b.epub", fx.epub(extra={"META-INF/encryption.xml": "<encryption/>"})) == "ENCRYPTED_EPUB"
    assert code(convert, "b.epub", fx.zip_files({"mimetype": "application/epub+zip"})) == "MISSING_ARCHIVE_ENTRY"
    fonts = '<encryption xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><EncryptedData xmlns="http://www.w3.org/2001/04/xmlenc#"><EncryptionMethod Algorithm="http://www.idpf.org/2008/embedding"/><CipherData><CipherReference URI="pub/fonts/font.{}"/></CipherData></EncryptedData></encryption>'
    assert any("font" in w for w in convert("b.epub", fx.epub(extra={"META-INF/encryption.xml": fonts.format("otf")})).warnings)
    assert code(convert, "b.epub", fx.epub(extra={"META-INF/encryption.xml": fonts.format("xhtml")})) == "ENCRYPTED_EPUB"
    opf = '<package xmlns="http://www.idpf.org/2007/opf"><metadata/><manifest><item id="{}" href="{}" media-type="text/html"/></manifest><spine><itemref idref="a"/></spine></package>'
    for key, href, want in (("b", "x", "INVALID_EPUB"), ("__proto__", "x", "INVALID_EPUB"), ("a", "http://x", "INVALID_EPUB"), ("a", "../../x", "INVALID_EPUB"), ("a", "no.html", "MISSING_ARCHIVE_ENTRY")):
        assert code(convert, "b.epub", fx.epub(extra={"pub/atlas.opf": opf.format(key, href)})) == want


def test_docx():
    out = convert("r.docx", fx.docx())
    assert out.markdown == "# Harbour log\n\n**Tides rose early.**\n\nسفن في الميناء\n\n| Vessel | Crew |\n| --- | --- |\n| Brig | 12 |\n"
    run = lambda t, p="": f"<w:r><w:rPr>{p}</w:rPr><w:t>{t}</w:t></w:r>"
    item = lambda t, level=0, n=1: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{n}"/></w:numPr></w:pPr>{run(t)}</w:p>'
    body = f"<w:p>{run('it', '<w:i/>')}{run('off', '<w:b w:val=%s/>' % chr(34).join(['', '0', '']))}{run('gone', '<w:strike/>')}</w:p>{item('one')}{item('in', 1)}{item('two')}{item('first', 0, 2)}"
    body += f'<w:p><w:hyperlink r:id="h">{run("link")}</w:hyperlink><w:r><w:br/></w:r>{run("&lt;b&gt;")}</w:p>'
    numbering = f'<w:numbering xmlns:w="{fx.W}"><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num></w:numbering>'
    links = fx.relations([("h", "hyperlink", "https://example.org/")])
    got = convert("r.docx", fx.docx(body, {"word/numbering.xml": numbering, "word/_rels/document.xml.rels": links})).markdown
    assert got == "*it*off~~gone~~\n\n-   one\n    -   in\n-   two\n\n1.  first\n\n[link](https://example.org/)  \n<b>\n"
    assert code(convert, "b.docx", fx.zip_files({"a.txt": "x"})) == "INVALID_DOCX" and code(convert, "b.docx", fx.zip_files({"word/document.xml": "<a/>"})) == "INVALID_DOCX"
    assert code(convert, "b.docx", fx.zip_files({"word/document.xml": "<a><b></a>"})) == "INVALID_XML"


def test_xlsx():
    out = convert("b.xlsx", fx.xlsx())
    assert "## Catch\n\n| Vessel | Crew |\n| --- | --- |\n| Brig | 12 |\n| زورق | 24 |\n| Sum of boats | 36 |\n" in out.markdown
    assert "## Ports\n\n| Harbour |  |\n| --- | --- |\n| Bergen | TRUE |\n" in out.markdown and "## Empty\n\n_Empty worksheet._\n" in out.markdown
    assert out.warnings == ["Formulas use cached values; formulas are not recalculated."]
    styles = f'<styleSheet xmlns="{fx.S}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="10"/><xf numFmtId="164"/></cellXfs></styleSheet>'
    rows = '<row r="1"><c r="A1" s="1"><v>0.256</v></c><c r="B1" s="2"><v>45292</v></c><c r="C1" t="e"><v>#REF!</v></c></row>'
    merged = convert("b.xlsx", fx.xlsx(rows, '<mergeCells><mergeCell ref="A1:B1"/></mergeCells>', styles))
    assert "| 25.60% | 2024-01-01 | #REF! |" in merged.markdown and merged.warnings == ["Merged cells retain their top-left value; other cells remain blank."]
    assert code(convert, "b.xlsx", "a,b\n1,2") == "INVALID_SPREADSHEET" and code(convert, "b.xlsx", fx.zip_files({"a": "b"})) == "INVALID_SPREADSHEET"
    huge = workbook.Sheet("Huge", area=(0, 0, 1048575, 16383))
    assert code(workbook.workbook_to_markdown, [huge]) == "SPREADSHEET_LIMIT" and code(workbook.workbook_to_markdown, [workbook.Sheet("x")] * 101) == "SPREADSHEET_LIMIT"
    assert workbook.workbook_to_markdown([]).markdown == "_Empty workbook._\n"


@pytest.mark.parametrize("biff8", [True, False])
def test_xls(biff8):
    out = convert("b.xls", fx.xls(biff8))
    coffee = "زورق" if biff8 else "Cutter"
    assert out.markdown == f"## Catch\n\n| Vessel | Crew |\n| --- | --- |\n| Brig | 12 |\n| {coffee} | 24 |\n| Sum of boats | 36 |\n\n## Ports\n\n| Bergen |  |\n| --- | --- |\n| 5 | 12.34 |\n| #N/A |  |\n"
    assert code(convert, "b.xls", "a,b") == "INVALID_SPREADSHEET" and code(convert, "b.xls", b"\xd0\xcf\x11\xe0" + bytes(600)) == "INVALID_SPREADSHEET"
    data = bytearray(fx.xls(biff8))
    for at in range(512, len(data), 997):  # whatever is broken, it ends with a code
        broken = bytes(data[:at]) + b"\xff\xff\xff" + bytes(data[at + 3 :])
        try:
            convert("b.xls", broken)
        except ConversionError as e:
            assert e.code in ("INVALID_SPREADSHEET", "SPREADSHEET_LIMIT")


def test_number_formats():
    cases = [(1234.5, "General", "1234.5"), (0.1 + 0.2, "General", "0.3"), (1e15, "General", "1E+15"), (123456789012.0, "General", "1.23457E+11"), (1234.5, "#,##0.00", "1,234.50"), (-5, "0;(0)", "(5)"), (0.256, "0%", "26%"), (0, "0;-0;zero", "zero"), (3, '0 "kg"', "3 kg"), (45292.75, "m/d/yy h:mm", "1/1/24 18:00"), (45292.75, "h:mm AM/PM", "6:00 PM"), (1.5, "[h]:mm", "36:00"), (0.5, "mm:ss", "00:00"), (45292, "d-mmm-yy", "1-Jan-24"), (45292, "dddd, mmmm d", "Monday, January 1"), (12345, "0.00E+00", "1.23E+04"), (2.5, "0", "3"), (-1.5, "0.0", "-1.5"), (59, "yyyy-mm-dd", "1900-02-28"), (7, "@", "7")]
    for x, fmt, want in cases:
        assert numfmt.shown(x, fmt) == want, (x, fmt, numfmt.shown(x, fmt))


def test_exif_and_images():
    out = convert("camera.jpg", fx.jpeg(), fmt="exif").markdown
    for want in ("# Image metadata", "| 0th | Make | Pinhole Works |", "| Exif | DateTimeOriginal | 2026:01:02 03:04:05 |", "| GPS | GPSLatitude | \\[\\[24,1\\],\\[42,1\\],\\[0,1\\]\\] |"):
        assert want in out, want
    assert convert("p.jpg", fx.jpeg(False), fmt="exif").markdown == "_No EXIF metadata found._\n"
    for bad in (b"not jpeg", b"\xff\xd8", fx.png(3, 3)):
        assert code(convert, "b.jpg", bad, fmt="exif") == "INVALID_JPEG"
    broken = fx.jpeg().replace(struct.pack(">HHII", 271, 2, 14, 62), struct.pack(">HHII", 271, 2, 99999, 62))
    assert code(convert, "b.jpg", broken, fmt="exif") == "INVALID_JPEG"
    assert image.image_dimensions(fx.png(1200, 240)) == (1200, 240) == image.image_dimensions(fx.jpeg(True, (1200, 240)))
    assert code(image.image_dimensions, b"\x89PNG") == "INVALID_IMAGE" and code(image.image_dimensions, fx.png(0, 5)) == "INVALID_IMAGE"
    assert code(image.image_dimensions, fx.png(100_000, 5)) == "IMAGE_LIMIT" and code(image.image_dimensions, fx.png(8000, 8000)) == "IMAGE_LIMIT"
    assert image.is_blank(np.full((300, 200, 3), 250, np.uint8)) and not image.is_blank(np.pad(np.zeros((50, 50, 3)), ((0, 100), (0, 100), (0, 0)), constant_values=255))
    assert image.logical_arabic("ضايرلا يف مكب ابحرم") == "مرحبا بكم في الرياض" and image.logical_arabic("abc 12") == "abc 12" and image.logical_arabic("12 ةعاس") == "ساعة 12"
    assert code(convert, "a.png", fx.png(5, 5)) == "MODEL_UNAVAILABLE"


def test_png_pixels():
    g = np.random.default_rng(1)
    for channels in (1, 2, 3, 4):
        pixels = g.integers(0, 256, (9, 7, channels), np.uint8)
        got = image.decode_png(fx.drawn_png(pixels, (0, 1, 2, 3, 4)))
        alpha = pixels[..., -1:] / 255 if channels in (2, 4) else 1.0
        color = np.repeat(pixels[..., :1], 3, 2) if channels < 3 else pixels[..., :3]
        assert np.allclose(got, color * alpha + 255 * (1 - alpha))
    assert image.decode_png(fx.png(5, 5)) is None
    assert code(image.decode_png, fx.drawn_png(pixels)[:60]) == "INVALID_IMAGE"
    assert image.normalized(np.zeros((30, 20, 3)), 90).shape == (20, 30, 3) and image.normalized(np.zeros((4800, 100, 3))).shape == (2400, 50, 3)
    assert image.bounded_size(1200, 240) == (1200, 240, 1.0)
    blank = convert("a.png", fx.drawn_png(np.full((20, 20, 3), 200, np.uint8)))
    assert blank.markdown == "_No text recognized._\n" and blank.warnings == ["Blank image/page: no visible text to recognize."]
    assert code(convert, "a.png", fx.drawn_png(g.integers(0, 256, (20, 20, 3), np.uint8))) == "MODEL_UNAVAILABLE"


class Engine:
    def __init__(self, *answers):
        self.answers, self.seen = list(answers), []

    def recognize(self, data, options):
        self.seen.append(data)
        found = self.answers.pop(0)
        if isinstance(found, Exception):
            raise found
        return found


def test_engine_sees_turned_and_bounded_pixels():
    drawn = np.full((40, 60, 4), 255, np.uint8)
    drawn[:10, :10] = (0, 0, 0, 255)
    drawn[30:, 50:, 3] = 0  # clear, so white
    engine = Engine(image.Recognized("x", 0.9))
    convert("a.png", fx.drawn_png(drawn, (0, 1, 2, 3, 4)), context=Context(Options(ocr_rotation=90), engine))
    seen = image.decode_png(engine.seen[0])
    assert seen.shape == (60, 40, 3) and not seen[:10, 30:].any() and (seen[:10, :30] == 255).all() and (seen[10:] == 255).all()
    wide = np.zeros((4, 3000, 3), np.uint8)
    wide[:, ::2] = 255
    engine = Engine(image.Recognized("y", 0.9))
    assert convert("b.png", fx.drawn_png(wide), context=Context(recognizer=engine)).warnings[0].startswith("Image was downscaled") and image.image_dimensions(engine.seen[0]) == (limits.RENDER_SIDE, 3)


def test_jpeg_pixels():
    g = np.random.default_rng(5)
    smooth = np.kron(g.integers(0, 256, (5, 7, 3)), np.ones((8, 8, 1))).astype(np.uint8)[:37, :51]
    for pixels, options, most in ((smooth[..., :1], {}, 2), (smooth, {}, 4), (smooth, {"restart": 3}, 4), (np.full((20, 33, 3), (200, 30, 90), np.uint8), {"sampling": 2, "restart": 1}, 4), (g.integers(0, 256, (16, 24, 1)).astype(np.uint8), {}, 3)):
        found = jpeg.decode_jpeg(fx.drawn_jpeg(pixels, **options))
        assert found.shape == (*pixels.shape[:2], 3) and np.abs(found - pixels.astype(float)).max() <= most, options
    whole = fx.drawn_jpeg(smooth)
    assert jpeg.decode_jpeg(whole.replace(b"\xff\xc0", b"\xff\xc2")) is None
    assert code(jpeg.decode_jpeg, whole[: len(whole) // 2]) == "INVALID_IMAGE" and code(jpeg.decode_jpeg, b"\xff\xd8\xff\xd9") == "INVALID_IMAGE"
    marked = np.full((16, 32, 1), 255, np.uint8)
    marked[:8, :8] = 0  # at the top left, as stored
    corners = {1: (0, 0), 2: (0, 1), 3: (1, 1), 4: (1, 0), 5: (0, 0), 6: (0, 1), 7: (1, 1), 8: (1, 0)}
    for orientation, (bottom, right) in corners.items():
        engine = Engine(image.Recognized("x", 0.9))
        convert("a.jpg", fx.drawn_jpeg(marked, orientation=orientation), context=Context(recognizer=engine))
        seen = image.decode_png(engine.seen[0])[..., 0]
        assert seen.shape == ((16, 32) if orientation < 5 else (32, 16))
        part = seen[-8:] if bottom else seen[:8]
        assert (part[:, -8:] if right else part[:, :8]).max() < 9 and (seen < 128).sum() == 64, orientation
    assert convert("b.jpg", fx.drawn_jpeg(np.full((24, 24, 3), 77, np.uint8))).warnings == ["Blank image/page: no visible text to recognize."]


def test_session_makes_its_engine_once():
    made = []

    def factory():
        made.append(1)
        return Engine(*[image.Recognized("x", 0.9)] * 3)

    session = image.Session("test", factory)
    for _ in range(3):
        assert convert("a.png", fx.png(5, 5), context=Context(recognizer=session)).markdown == "x\n"
    assert made == [1]


def test_models_have_a_time_of_their_own(monkeypatch):
    clock = [0.0]
    monkeypatch.setattr(image.time, "monotonic", lambda: clock[0])

    class Slow(Engine):
        def prepare(self):
            clock[0] += 50

    context = Context(recognizer=Slow(image.Recognized("x", 0.9)), deadline=60.0)
    assert convert("a.png", fx.png(5, 5), context=context).markdown == "x\n" and context.deadline == 110
    monkeypatch.setattr(limits, "MODEL_SECONDS", 40)
    assert code(convert, "a.png", fx.png(5, 5), context=Context(recognizer=Slow(), deadline=500.0)) == "MODEL_TIMEOUT"


def test_slow_files_end_by_themselves():
    late = Context(deadline=time.monotonic() - 1)
    for name, data in (("a.html", "<p>x</p>"), ("a.csv", "a,b\nc,d"), ("a.json", "[1]"), ("a.docx", fx.docx()), ("a.epub", fx.epub()), ("a.pptx", fx.pptx())):
        assert code(convert, name, data, context=late) == "TIMEOUT"


def test_recognition():
    run = lambda engine, data=fx.png(5, 5), **o: convert("a.png", data, context=Context(Options(**o), engine))
    assert run(Engine(image.Recognized(" a|b\nc ", 0.95))).markdown == "a\\|b\nc\n"
    low = run(Engine(image.Recognized("x", 0.5)), fx.png(3000, 1000))
    assert len(low.warnings) == 2 and "engine score 0.50" in low.warnings[1]
    none = run(Engine(image.Recognized("")))
    assert none.markdown == "_No text recognized._\n" and len(none.warnings) == 1
    assert run(Engine(image.Recognized("ابحرم")), ocr_language="ar").markdown == "مرحبا\n"


def test_usable_text_and_layout():
    for bad in ("", "  ", "12", "□???", "Hello �", "ab............"):
        assert not usable_text(bad)
    for good in ("مرحبا", "Hello", "ABC 123"):
        assert usable_text(good)
    token = lambda t, x, y, w=50, **k: Token(t, x, y, w, 12, **k)
    assert layout_text([token("مرحبا", 100, 0, 40, rtl=True), token("بكم", 40, 0, 40, rtl=True)])[0] == "مرحبا بكم"
    assert layout_text([token("b", 65, 100), token("a", 10, 101), token("c", 115.5, 100), token(" ", 0, 0)])[0] == "a bc"
    assert layout_text([token("a", 0, 100), token("b", 0, 85), token("c", 0, 50)])[0] == "a\nb\n\nc"
    four = [token(t, x, y) for t, x, y in (("Left first", 40, 700), ("Right first", 340, 700), ("Left second", 40, 680), ("Right second", 340, 680))]
    got, warnings = layout_text(four, 600)
    assert got == "Left first\nLeft second\n\nRight first\nRight second" and len(warnings) == 1
    assert layout_text([*four, token("across", 100, 600, 400)], 600)[0].startswith("Left first Right first")
    assert layout_text([Token("v", 0, 0, 1, 1, False, True)])[1] == ["Rotated or vertical text may have imperfect reading order."]


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_text(packed):
    page = fx.lines((40, 700, "Hello World"), (40, 680, "Second \\050line\\051 \\101"))
    out = convert("a.pdf", fx.pdf([page, fx.lines((40, 700, "Page two caf\\351"))], packed=packed))
    assert out.markdown == "## Page 1\n\nHello World\nSecond (line) A\n\n## Page 2\n\nPage two café\n" and out.warnings == [pdf.SCOPE]
    columns = fx.lines((40, 700, "Left first"), (340, 700, "Right first"), (40, 680, "Left second"), (340, 680, "Right second"))
    assert "Left first\nLeft second\n\nRight first\nRight second" in convert("a.pdf", fx.pdf([columns], packed=packed)).markdown
    spaced = "BT /F 12 Tf 40 700 Td 14 TL [(Wi) 20 (de) -400 (gap)] TJ T* (next) ' 0 -20 Td (*a|b*) Tj ET"
    assert "Wide gap\n" in convert("a.pdf", fx.pdf([spaced], packed=packed)).markdown


def test_pdf_edges():
    assert code(convert, "a.pdf", b"nothing") == "INVALID_PDF" and code(convert, "a.pdf", b"%PDF-1.4\n%%EOF") == "INVALID_PDF"
    assert code(convert, "a.pdf", fx.pdf([fx.lines((1, 1, "x"))], encrypt=True)) == "PDF_PASSWORD"
    assert code(convert, "a.pdf", fx.pdf([""] * 101)) == "PDF_LIMIT"
    assert code(convert, "a.pdf", fx.pdf([fx.lines((1, 1, "Hello there"))], size=(20_000, 10))) == "PDF_LIMIT"
    assert code(convert, "a.pdf", fx.pdf([None], image=(5000, 5000))) == "PDF_LIMIT"
    blank = convert("a.pdf", fx.pdf([""]))
    assert blank.markdown == "## Page 1\n\n_No text recognized on this page._\n" and "Page 1: Blank image/page: no visible text to recognize." in blank.warnings
    assert code(convert, "a.pdf", fx.pdf([None])) == "PDF_UNREADABLE"
    whole = fx.pdf([fx.lines((40, 700, "Hello World"))])
    assert "Hello World" in convert("a.pdf", whole.replace(b"startxref\n", b"startxref\n9")).markdown  # found by a scan
    mixed = fx.pdf([fx.lines((40, 700, "Native one")), None, fx.lines((40, 700, "Native three"))])
    part = convert("a.pdf", mixed)
    assert part.warnings[0] == "Partial result: 1 page(s) had conversion failures." and "_Page conversion failed; see warnings._" in part.markdown and "Native three" in part.markdown
    engine = Engine(image.Recognized("Scanned text", 0.9))
    assert "## Page 2\n\nScanned text\n" in convert("a.pdf", mixed, context=Context(recognizer=engine)).markdown and engine.seen == [fx.jpeg(False)]
    forced = Engine(*[image.Recognized(f"seen {k}") for k in range(3)])
    assert "seen 0" in convert("a.pdf", mixed, context=Context(Options(pdf_force_ocr=True), forced)).markdown
    late = Context()
    late.deadline = time.monotonic() - 1
    assert code(convert, "a.pdf", mixed, context=late) == "TIMEOUT"
    assert pdf.render_scale(600, 800) == 2 and pdf.render_scale(2400, 2400) == pytest.approx(2000 / 2400)
    for w, h in ((0, 5), (14401, 5), (float("nan"), 5)):
        assert code(pdf.render_scale, w, h) == "PDF_LIMIT"
    data = bytearray(mixed)
    for at in range(0, len(data), 61):
        try:
            convert("a.pdf", bytes(data[:at]) + b"<<[(" + bytes(data[at + 4 :]))
        except ConversionError as e:
            assert e.code in ("INVALID_PDF", "PDF_UNREADABLE", "PDF_LIMIT", "PDF_PASSWORD")


def _table_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abé\U0001f600 ", max_size=80), st.text("abé\U0001f600 ", max_size=80))
def test_edit_distance_is_that_of_the_whole_table(a, b):
    assert distance(a, b) == distance(b, a) == _table_distance(a, b)


def test_edit_distance_of_long_texts():
    """Texts for whose 4 * 10^10 pairs of letters a table would take an hour."""
    text = "".join(map(str, range(40_000)))[:200_000]
    assert distance(text, text) == 0 and distance(text + " fi", text + " fo") == 1 and distance("x" + text, text + "y") <= 2
    assert distance("a" * 20_000, "b" * 20_001) == 20_001
