"""Small documents of binary formats made from names, so that queries can convert what they know the contents of."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from html import escape

OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SLIDE = "http://schemas.openxmlformats.org/presentationml/2006/main"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006/main"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"

#: (title, names) of a document's parts.
Parts = list[tuple[str, list[str]]]


def _zip(files: dict[str, str]) -> bytes:
    """What zipfile would write, record by record: for small files most of its time goes into its bookkeeping."""
    bodies, directory, at = [], [], 0
    for name, text in files.items():
        data, title = text.encode(), name.encode("ascii")
        deflate = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
        packed = deflate.compress(data) + deflate.flush()
        shared = struct.pack("<HHHHLLLHH", 0, zipfile.ZIP_DEFLATED, 0, 33, zlib.crc32(data), len(packed), len(data), len(title), 0)  # of 1980-01-01
        bodies += [b"PK\3\4\x14\0", shared, title, packed]
        directory += [b"PK\1\2\x14\3\x14\0", shared, struct.pack("<HHHLL", 0, 0, 0, 0o600 << 16, at), title]
        at += 30 + len(title) + len(packed)
    size = sum(map(len, directory))
    return b"".join([*bodies, *directory, struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, len(files), len(files), size, at, 0)])


def _relations(targets: list[tuple[str, str]]) -> str:
    return f'<Relationships xmlns="{RELS}">' + "".join(f'<Relationship Id="r{k}" Type="{OFFICE}/{kind}" Target="{target}"/>' for k, (kind, target) in enumerate(targets)) + "</Relationships>"


def docx(parts: Parts) -> bytes:
    """A heading and a table of numbered names for each part."""
    text = lambda t: f"<w:p><w:r><w:t>{escape(t)}</w:t></w:r></w:p>"
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{text(c)}</w:tc>" for c in cells) + "</w:tr>"
    body = "".join(
        f'<w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>{escape(title)}</w:t></w:r></w:p><w:tbl>{row("No", "Name")}{"".join(row(str(k), n) for k, n in enumerate(names, 1))}</w:tbl>' for title, names in parts
    )
    return _zip({"word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>', "word/styles.xml": f'<w:styles xmlns:w="{WORD}"><w:style w:styleId="H"><w:name w:val="heading 1"/></w:style></w:styles>'})


def xlsx(parts: Parts) -> bytes:
    """A sheet of numbered names for each part."""
    files = {"xl/workbook.xml": f'<workbook xmlns="{SHEET}" xmlns:r="{OFFICE}"><sheets>' + "".join(f'<sheet name="{escape(t)}" sheetId="{k + 1}" r:id="r{k}"/>' for k, (t, _) in enumerate(parts)) + "</sheets></workbook>"}
    files["xl/_rels/workbook.xml.rels"] = _relations([("worksheet", f"worksheets/s{k}.xml") for k in range(len(parts))])
    for k, (_, names) in enumerate(parts):
        rows = [("No", "Name"), *((i, n) for i, n in enumerate(names, 1))]
        cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, int) else f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        files[f"xl/worksheets/s{k}.xml"] = f'<worksheet xmlns="{SHEET}"><sheetData>' + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>"
    return _zip(files)


def pptx(parts: Parts) -> bytes:
    """A slide with a title and a list for each part, stored in reverse."""
    n = len(parts)
    files = {"ppt/presentation.xml": f'<p:presentation xmlns:p="{SLIDE}" xmlns:r="{OFFICE}"><p:sldIdLst>' + "".join(f'<p:sldId id="{256 + k}" r:id="r{n - 1 - k}"/>' for k in range(n)) + "</p:sldIdLst></p:presentation>"}
    files["ppt/_rels/presentation.xml.rels"] = _relations([("slide", f"slides/s{n - 1 - k}.xml") for k in range(n)])
    for k, (title, names) in enumerate(parts):
        run = lambda t, p="": f"<a:p>{p}<a:r><a:t>{escape(t)}</a:t></a:r></a:p>"
        bullet = '<a:pPr><a:buChar char="-"/></a:pPr>'
        files[f"ppt/slides/s{k}.xml"] = f'<p:sld xmlns:p="{SLIDE}" xmlns:a="{DRAWING}"><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody>{run(title)}</p:txBody></p:sp><p:sp><p:txBody>{"".join(run(x, bullet) for x in names)}</p:txBody></p:sp></p:spTree></p:cSld></p:sld>'
    return _zip(files)


def epub(parts: Parts) -> bytes:
    """A chapter with a heading and paragraphs for each part."""
    files = {"META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="b/p.opf"/></rootfiles></container>'}
    items = "".join(f'<item id="c{k}" href="t/c{k}.xhtml" media-type="application/xhtml+xml"/>' for k in reversed(range(len(parts))))
    spine = "".join(f'<itemref idref="c{k}"/>' for k in range(len(parts)))
    files["b/p.opf"] = f'<package xmlns="http://www.idpf.org/2007/opf"><metadata><title xmlns="http://purl.org/dc/elements/1.1/">Names</title></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>'
    for k, (title, names) in enumerate(parts):
        files[f"b/t/c{k}.xhtml"] = f"<html><head><title>x</title></head><body><h1>{escape(title)}</h1>{''.join(f'<p>{escape(n)}</p>' for n in names)}</body></html>"
    return _zip(files)


def pdf(parts: Parts) -> bytes:
    """A page with the title and names as lines for each part."""
    quoted = lambda t: t.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)")
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for title, names in parts:
        text = "BT /F 12 Tf 14 TL 40 760 Td " + " ".join(f"({quoted(t)}) Tj T*" for t in [title, *names]) + " ET"
        data = zlib.compress(text.encode("cp1252", "replace"))
        kids.append(b"%d 0 R" % (len(objects) + 1))
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (len(objects) + 2))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(data), data))
    objects[1] = b"<< /Type /Pages /Count %d /MediaBox [0 0 600 800] /Resources << /Font << /F 3 0 R >> >> /Kids [%s] >>" % (len(kids), b" ".join(kids))
    out, offsets = b"%PDF-1.4\n", []
    for k, body in enumerate(objects, 1):
        offsets.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    table = b"".join(b"%010d 00000 n \n" % o for o in offsets)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))


def jpeg(make: str) -> bytes:
    """A picture of one pixel whose metadata names its maker."""
    value = make.encode("ascii", "replace") + b"\0"
    value = value.ljust(5, b"\0")
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<HHHII", 1, 271, 2, len(value), 26) + bytes(4) + value
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 1, 1, 1) + b"\1\x11\0\xff\xda\0\2\xff\xd9"


def zipped(files: dict[str, str | bytes], method: int = zipfile.ZIP_DEFLATED) -> bytes:
    """An archive of any files."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name), data, method)
    return out.getvalue()


def patched(data: bytes, sign: bytes, offset: int, value: int) -> bytes:
    """data with two bytes changed at an offset from the last place of a signature."""
    at = data.rfind(sign) + offset
    return data[:at] + struct.pack("<H", value) + data[at + 2 :]


def compound(name: str, stream: bytes) -> bytes:
    """A compound file of 512-byte sectors with one stream: header, allocation table, directory, stream."""
    free, end, table = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD
    stream = stream.ljust(max(4096, -(-len(stream) // 512) * 512), b"\0")
    sectors = len(stream) // 512
    chain = [table, end, *range(3, sectors + 2), end]
    tables = -(-len(chain) // 128)
    if tables > 1:
        raise ValueError("a small sample only")

    def entry(text: str, kind: int, start: int, size: int, child: int = free) -> bytes:
        utf16 = text.encode("utf-16-le")
        return utf16.ljust(64, b"\0") + struct.pack("<HBB3I16x4x16xIII", len(utf16) + 2, kind, 1, free, free, child, start, size, 0)

    header = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH6x10I", 0x3E, 3, 0xFFFE, 9, 6, 0, 1, 1, 0, 4096, end, 0, end, 0, 0)
    directory = entry("Root Entry", 5, end, 0, 1) + entry(name, 2, 2, len(stream)) + bytes(256)
    return header.ljust(512, b"\xff") + struct.pack("<128I", *chain, *[free] * (128 - len(chain))) + directory + stream


def xls(parts: Parts) -> bytes:
    """A legacy workbook (BIFF8) with a sheet of numbered names for each part."""
    record = lambda kind, data=b"": struct.pack("<HH", kind, len(data)) + data
    begin = lambda kind: record(0x809, struct.pack("<HHHHII", 0x600, kind, 0, 0, 0, 0))
    text = lambda t: struct.pack("<HB", len(t), 1) + t.encode("utf-16-le")
    cell = lambda r, c, v: record(0x203, struct.pack("<HHHd", r, c, 0, v)) if isinstance(v, int) else record(0x204, struct.pack("<HHH", r, c, 0) + text(v))
    bodies = []
    for _, names in parts:
        rows = [("No", "Name"), *enumerate(names, 1)]
        bodies.append(begin(0x10) + b"".join(cell(r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)) + record(0x0A))
    name = lambda t: struct.pack("<BB", len(t), 1) + t.encode("utf-16-le")
    head = begin(0x05) + record(0x42, struct.pack("<H", 1200)) + record(0xE0, bytes(20))
    at = len(head) + sum(len(record(0x85, bytes(6) + name(t))) for t, _ in parts) + len(record(0x0A))
    for (t, _), body in zip(parts, bodies, strict=True):
        head += record(0x85, struct.pack("<IBB", at, 0, 0) + name(t))
        at += len(body)
    return compound("Workbook", head + record(0x0A) + b"".join(bodies))


#: Cell styles of styled_xlsx: general, a day, two decimals, a share in percent, thousands.
STYLES = (0, 14, 2, 10, 3)


def styled_xlsx(rows: list[list[tuple[float | str, int]]], formula: bool = False, merged: bool = False) -> bytes:
    """A sheet of (value, index in STYLES); formula: the last cell is a formula with this value; merged: the first two cells of the first row are."""
    cells = []
    for r, row in enumerate(rows, 1):
        line = ""
        for c, (value, style) in enumerate(row):
            last = formula and r == len(rows) and c == len(row) - 1
            body = ("<f>1+1</f>" if last else "") + f"<v>{escape(str(value))}</v>"
            line += f'<c r="{chr(65 + c)}{r}" s="{style}"' + (' t="str">' if isinstance(value, str) else ">") + body + "</c>"
        cells.append(f'<row r="{r}">{line}</row>')
    return _zip({
        "xl/workbook.xml": f'<workbook xmlns="{SHEET}" xmlns:r="{OFFICE}"><sheets><sheet name="Data" sheetId="1" r:id="r0"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _relations([("worksheet", "worksheets/s.xml")]),
        "xl/styles.xml": f'<styleSheet xmlns="{SHEET}"><cellXfs>' + "".join(f'<xf numFmtId="{k}"/>' for k in STYLES) + "</cellXfs></styleSheet>",
        "xl/worksheets/s.xml": f'<worksheet xmlns="{SHEET}"><sheetData>{"".join(cells)}</sheetData>{"<mergeCells><mergeCell ref=" + chr(34) + "A1:B1" + chr(34) + "/></mergeCells>" if merged else ""}</worksheet>',
    })


def noted_pptx(title: str, names: list[str], notes: str) -> bytes:
    """A slide with a title, a table of names, a chart and speaker notes."""
    run = lambda t: f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>"
    shape = lambda t, kind: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody>{run(t)}</p:txBody></p:sp>'
    frame = lambda inner: f"<p:graphicFrame><a:graphic><a:graphicData>{inner}</a:graphicData></a:graphic></p:graphicFrame>"
    grid = "".join(f"<a:tr><a:tc><a:txBody>{run(a)}</a:txBody></a:tc><a:tc><a:txBody>{run(b)}</a:txBody></a:tc></a:tr>" for a, b in [("No", "Name"), *((str(k), n) for k, n in enumerate(names, 1))])
    slide = lambda inner: f'<p:sld xmlns:p="{SLIDE}" xmlns:a="{DRAWING}"><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>'
    return _zip({
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{SLIDE}" xmlns:r="{OFFICE}"><p:sldIdLst><p:sldId id="256" r:id="r0"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": _relations([("slide", "slides/only.xml")]),
        "ppt/slides/only.xml": slide(shape(title, "title") + frame(f"<a:tbl>{grid}</a:tbl>") + frame('<c:chart xmlns:c="urn:c"/>')),
        "ppt/slides/_rels/only.xml.rels": _relations([("notesSlide", "../notes/n.xml")]),
        "ppt/notes/n.xml": slide(shape(notes, "body") + shape("7", "sldNum")),
    })


def picture(values: list[int], width: int, height: int) -> bytes:
    """A grey PNG whose columns take the values in turn."""
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    row = b"\0" + bytes(values[c % len(values)] for c in range(width))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(row * height)) + chunk(b"IEND", b"")
