"""XLSX and XLS to Markdown: every sheet's shown values as a table."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

from docloom.functions import limits
from docloom.functions.limits import ConversionError
from docloom.kernels.archive import Archive, relative_path
from docloom.kernels.base import Context, Result, decode_text, heading, table, unique
from docloom.kernels.numfmt import BUILT_IN, shown
from docloom.kernels.xmltree import Element, parse_xml

ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


def invalid(message: str) -> ConversionError:
    return ConversionError("INVALID_SPREADSHEET", message)


@dataclass
class Sheet:
    """Shown values by (row, column), both from 0, and the range (first row, first column, last row, last column) if there is one."""

    name: str
    cells: dict[tuple[int, int], str] = field(default_factory=dict)
    area: tuple[int, int, int, int] | None = None
    merged: bool = False
    formulas: bool = False


def workbook_to_markdown(sheets: list[Sheet]) -> Result:
    if len(sheets) > limits.SHEETS:
        raise ConversionError("SPREADSHEET_LIMIT", "Workbook exceeds 100 worksheets.")
    parts, warnings, total = [], [], 0
    for sheet in sheets:
        parts.append(f"## {heading(sheet.name)}\n")
        if sheet.area is None:
            parts.append("_Empty worksheet._\n")
            continue
        top, left, bottom, right = sheet.area
        width, height = right - left + 1, bottom - top + 1
        total += width * height
        if width > limits.SHEET_COLUMNS or height > limits.SHEET_ROWS or total > limits.SHEET_CELLS:
            raise ConversionError("SPREADSHEET_LIMIT", "Workbook exceeds the 500,000-cell, 50,000-row or 1,000-column limit.")
        if sheet.merged:
            warnings.append("Merged cells retain their top-left value; other cells remain blank.")
        if sheet.formulas:
            warnings.append("Formulas use cached values; formulas are not recalculated.")
        used = sorted({r for r, _ in sheet.cells if top <= r <= bottom})
        parts.append(table([[sheet.cells.get((r, c), "") for c in range(left, right + 1)] for r in used]))
    return Result("\n".join(parts) or "_Empty workbook._\n", unique(warnings))


_REFERENCE = re.compile(r"\$?([A-Za-z]{1,3})\$?(\d{1,7})")


def _place(ref: str) -> tuple[int, int]:
    m = _REFERENCE.fullmatch(ref)
    if not m:
        raise invalid(f"Cannot read workbook: bad cell reference {ref!r}")
    column = 0
    for c in m[1].upper():
        column = column * 26 + ord(c) - 64
    return int(m[2]) - 1, column - 1


def _area(sheet: Sheet, declared: tuple[int, int, int, int] | None = None) -> None:
    if sheet.cells:
        rows, columns = [r for r, _ in sheet.cells], [c for _, c in sheet.cells]
        own = (min(rows), min(columns), max(rows), max(columns))
        sheet.area = own if declared is None else (min(own[0], declared[0]), min(own[1], declared[1]), max(own[2], declared[2]), max(own[3], declared[3]))
    elif declared is not None and declared != (0, 0, 0, 0):
        sheet.area = declared


#: Parts up to this size are kept from the check of the whole archive until they are parsed; larger ones are inflated again.
KEPT_PART = 1 << 20


class _Xlsx:
    def __init__(self, archive: Archive, context: Context, kept: dict[str, bytes]):
        self.archive, self.context, self.kept = archive, context, kept
        self.workbook = self.part("xl/workbook.xml")
        properties = self.workbook.first("workbookPr")
        self.epoch_1904 = properties is not None and properties.get("date1904") in ("1", "true")
        self.relations = {r.get("Id"): r for r in self.optional("xl/_rels/workbook.xml.rels", "Relationship")}
        self.strings = [self._string(s) for s in self.optional("xl/sharedStrings.xml", "si")]
        self.formats = self._formats()

    def part(self, name: str) -> Element:
        if name in self.kept:
            return parse_xml(decode_text(self.kept[name]))
        used = self.archive.budget.bytes
        self.archive.budget.bytes = 0  # read and counted before
        try:
            return parse_xml(decode_text(self.archive.read(name)))
        finally:
            self.archive.budget.bytes = used

    def optional(self, name: str, element: str) -> list[Element]:
        return list(self.part(name).find_all(element)) if self.archive.has(name) else []

    @staticmethod
    def _string(si: Element) -> str:
        return "".join(t.text() for e in si.elements() if e.name in ("t", "r") for t in ([e] if e.name == "t" else [x for x in e.elements() if x.name == "t"]))

    def _formats(self) -> list[str]:
        if not self.archive.has("xl/styles.xml"):
            return []
        root = self.part("xl/styles.xml")
        own = {int(f.get("numFmtId")): f.get("formatCode") or "General" for f in root.find_all("numFmt") if (f.get("numFmtId") or "").isdigit()}
        cells = root.first("cellXfs")
        ids = [int(x.get("numFmtId") or 0) for x in cells.elements() if x.name == "xf"] if cells is not None else []
        return [own.get(i, BUILT_IN.get(i, "General")) for i in ids]

    def value(self, c: Element) -> str | None:
        kind = c.get("t") or "n"
        v = c.child("v")
        if kind == "inlineStr":
            inline = c.child("is")
            return self._string(inline) if inline is not None else None
        if v is None:
            return None
        text = v.text()
        if kind == "s":
            i = int(text)
            return self.strings[i] if 0 <= i < len(self.strings) else None
        if kind == "b":
            return "TRUE" if text.strip() in ("1", "true") else "FALSE"
        if kind in ("str", "e", "d"):
            return text
        style = int(c.get("s") or 0)
        return shown(float(text), self.formats[style] if style < len(self.formats) else "General", self.epoch_1904)

    def sheet(self, e: Element) -> Sheet:
        sheet = Sheet(e.get("name") or "")
        key = next((v for (ns, n), v in e.attributes.items() if n == "id" and ns), None)
        rel = self.relations.get(key)
        target = rel.get("Target") if rel is not None else None
        if not target:
            return sheet
        path = target.lstrip("/") if target.startswith("/") else relative_path("xl/workbook.xml", target, invalid("Cannot read workbook: bad sheet path"))
        if not self.archive.has(path) or "worksheet" not in (rel.get("Type") or ""):
            return sheet
        root = self.part(path)
        row = -1
        for r in root.find_all("row"):
            self.context.check()
            row = int(r.get("r")) - 1 if r.get("r") else row + 1
            column = -1
            for c in r.elements():
                if c.name != "c":
                    continue
                at, column = _place(c.get("r")) if c.get("r") else (row, column + 1)
                sheet.formulas |= c.child("f") is not None
                value = self.value(c)
                if value is not None:
                    sheet.cells[at, column] = value
        sheet.merged = next(root.find_all("mergeCell"), None) is not None
        dimension = root.first("dimension")
        declared = None
        if dimension is not None and ":" in (dimension.get("ref") or ""):
            a, b = dimension.get("ref").split(":")
            declared = (*_place(a), *_place(b))
        _area(sheet, declared)
        return sheet


def convert_xlsx(data: bytes, context: Context) -> Result:
    if data[:2] != b"PK":
        raise invalid("The file signature does not match this Excel format.")
    archive = Archive(data, context)
    if not archive.has("xl/workbook.xml"):
        raise invalid("The archive does not contain an XLSX workbook.")
    kept = {}
    for entry in archive.files():
        part = archive.read(entry.name)
        if len(part) <= KEPT_PART and entry.name.endswith((".xml", ".rels")):
            kept[entry.name] = part
    try:
        book = _Xlsx(archive, context, kept)
        listed = book.workbook.first("sheets")
        elements = [e for e in listed.elements() if e.name == "sheet"] if listed is not None else []
        if len(elements) > limits.SHEETS:
            raise ConversionError("SPREADSHEET_LIMIT", "Workbook exceeds 100 worksheets.")
        return workbook_to_markdown([book.sheet(e) for e in elements])
    except (ValueError, TypeError, IndexError) as error:
        raise invalid(f"Cannot read workbook: {error}") from None


# --- the older binary format: a compound file with a stream of records --------------------------------------------------


class CompoundFile:
    """Streams of an OLE2 compound file by name."""

    def __init__(self, data: bytes):
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if not 7 <= shift <= 16 or not 2 <= mini_shift <= shift:
            raise ValueError("bad sector size")
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        directory, self.cutoff, mini_fat, _, difat, n_difat = struct.unpack_from("<I4xIIIII", data, 48)
        fat_sectors = [s for s in struct.unpack_from("<109I", data, 76) if s < 0xFFFFFFFA]
        seen: set[int] = set()
        while difat < 0xFFFFFFFA and difat not in seen and n_difat:
            seen.add(difat)
            *more, difat = struct.unpack(f"<{self.size // 4}I", self._sector(difat))
            fat_sectors += [s for s in more if s < 0xFFFFFFFA]
        fat = b"".join(self._sector(s) for s in fat_sectors)
        self.fat = struct.unpack(f"<{len(fat) // 4}I", fat)
        entries = self._chain(directory)
        self.entries = {}
        for at in range(0, len(entries) - 127, 128):
            length = struct.unpack_from("<H", entries, at + 64)[0]
            kind = entries[at + 66]
            start, size = struct.unpack_from("<II", entries, at + 116)
            if kind in (2, 5):
                self.entries[entries[at : at + max(0, length - 2)].decode("utf-16-le", "replace").lower() if kind == 2 else ""] = (start, size)
        mini = self._chain(mini_fat) if mini_fat < 0xFFFFFFFA else b""
        self.mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini[: len(mini) // 4 * 4])
        self.mini = self._chain(self.entries[""][0]) if "" in self.entries and self.entries[""][0] < 0xFFFFFFFA else b""

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        if at + 1 > len(self.data):
            raise ValueError("a sector lies beyond the file")
        return self.data[at : at + self.size].ljust(self.size, b"\0")

    def _chain(self, n: int) -> bytes:
        out, seen = [], set()
        while n < 0xFFFFFFFA:
            if n in seen or n >= len(self.fat):
                raise ValueError("a broken sector chain")
            seen.add(n)
            out.append(self._sector(n))
            n = self.fat[n]
        return b"".join(out)

    def stream(self, name: str) -> bytes | None:
        if name.lower() not in self.entries:
            return None
        start, size = self.entries[name.lower()]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, n, seen = [], start, set()
        while n < 0xFFFFFFFA:
            if n in seen or n >= len(self.mini_fat):
                raise ValueError("a broken sector chain")
            seen.add(n)
            out.append(self.mini[n * self.mini_size : (n + 1) * self.mini_size])
            n = self.mini_fat[n]
        return b"".join(out)[:size]


def _rk(value: int) -> float:
    number = float(value >> 2 if value < 1 << 31 else (value >> 2) - (1 << 30)) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return number / 100 if value & 1 else number


class _Records:
    """Records (type, data) of a stream from a place on; texts that go on in CONTINUE records are read with `text`."""

    def __init__(self, stream: bytes, at: int = 0):
        self.stream, self.at = stream, at

    def __iter__(self):
        while self.at + 4 <= len(self.stream):
            kind, size = struct.unpack_from("<HH", self.stream, self.at)
            data = self.stream[self.at + 4 : self.at + 4 + size]
            self.at += 4 + size
            yield kind, data

    def continued(self) -> list[bytes]:
        out = []
        while self.at + 4 <= len(self.stream) and struct.unpack_from("<H", self.stream, self.at)[0] == 0x3C:
            size = struct.unpack_from("<H", self.stream, self.at + 2)[0]
            out.append(self.stream[self.at + 4 : self.at + 4 + size])
            self.at += 4 + size
        return out


def _shared_strings(parts: list[bytes]) -> list[str]:
    """The strings of an SST record and its continuations; where a string's characters are cut, the next part starts with a new width flag."""
    part, at = 0, 8
    count = struct.unpack_from("<I", parts[0], 4)[0]
    out: list[str] = []

    def take(n: int) -> bytes:
        nonlocal part, at
        got = b""
        while len(got) < n:
            if at >= len(parts[part]):
                part, at = part + 1, 0
            piece = parts[part][at : at + n - len(got)]
            at += len(piece)
            got += piece
        return got

    for _ in range(count):
        length, flags = struct.unpack("<HB", take(3))
        runs = struct.unpack("<H", take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", take(4))[0] if flags & 4 else 0
        wide, text = flags & 1, ""
        while len(text) < length:
            if at >= len(parts[part]):
                part, at = part + 1, 1
                wide = parts[part][0] & 1
            here = min(length - len(text), (len(parts[part]) - at) // (2 if wide else 1))
            raw = parts[part][at : at + here * (2 if wide else 1)]
            at += len(raw)
            text += raw.decode("utf-16-le", "surrogatepass") if wide else raw.decode("latin-1")
            if not here and at < len(parts[part]):
                raise ValueError("a broken shared string")
        take(4 * runs + extra)
        out.append(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))
    return out


class _Xls:
    def __init__(self, stream: bytes, context: Context):
        self.stream, self.context = stream, context
        self.biff8 = True
        self.codepage = "cp1252"
        self.strings: list[str] = []
        self.formats: dict[int, str] = {}
        self.styles: list[int] = []
        self.epoch_1904 = False
        self.sheets: list[tuple[str, int]] = []
        records = _Records(stream)
        for kind, data in records:
            if kind == 0x809:
                self.biff8 = struct.unpack_from("<H", data)[0] >= 0x600
            elif kind == 0x2F:
                raise invalid("Cannot read workbook: File is password-protected")
            elif kind == 0x42:
                page = struct.unpack_from("<H", data)[0]
                self.codepage = {1200: "cp1252", 10000: "mac_roman", 32768: "mac_roman", 32769: "cp1252"}.get(page, f"cp{page}")
            elif kind == 0x22:
                self.epoch_1904 = data[:2] == b"\1\0"
            elif kind == 0x85:
                self.sheets.append((self._text(data, 6, 1), struct.unpack_from("<I", data)[0]) if data[5] == 0 else (self._text(data, 6, 1), -1))
            elif kind == 0x41E:
                self.formats[struct.unpack_from("<H", data)[0]] = self._text(data, 2, 2 if self.biff8 else 1)
            elif kind == 0xE0:
                self.styles.append(struct.unpack_from("<H", data, 2)[0])
            elif kind == 0xFC:
                self.strings = _shared_strings([data, *records.continued()])
            elif kind == 0x0A:
                break

    def _text(self, data: bytes, at: int, width: int) -> str:
        length = int.from_bytes(data[at : at + width], "little")
        at += width
        if not self.biff8:
            return data[at : at + length].decode(self.codepage, "replace")
        wide = data[at] & 1
        raw = data[at + 1 : at + 1 + length * (2 if wide else 1)]
        return raw.decode("utf-16-le", "replace") if wide else raw.decode("latin-1")

    def shown(self, x: float, style: int) -> str:
        fmt = self.styles[style] if style < len(self.styles) else 0
        return shown(x, self.formats.get(fmt, BUILT_IN.get(fmt, "General")), self.epoch_1904)

    def sheet(self, name: str, at: int) -> Sheet:
        sheet = Sheet(name)
        if at < 0:
            return sheet
        waiting = None  # the cell of a formula whose text follows
        depth = 0
        for n, (kind, data) in enumerate(_Records(self.stream, at)):
            if n % 1000 == 0:
                self.context.check()
            if kind == 0x809:
                depth += 1
            elif kind == 0x0A:
                depth -= 1
                if depth <= 0:
                    break
            if depth != 1 or len(data) < 6 and kind != 0x207:
                continue
            if kind in (0xFD, 0x204, 0x203, 0x27E, 0x06, 0x205, 0xD6):
                r, c, style = struct.unpack_from("<HHH", data)
                if kind == 0xFD:
                    i = struct.unpack_from("<I", data, 6)[0]
                    if i < len(self.strings):
                        sheet.cells[r, c] = self.strings[i]
                elif kind in (0x204, 0xD6):
                    sheet.cells[r, c] = self._text(data, 6, 2)
                elif kind == 0x203:
                    sheet.cells[r, c] = self.shown(struct.unpack_from("<d", data, 6)[0], style)
                elif kind == 0x27E:
                    sheet.cells[r, c] = self.shown(_rk(struct.unpack_from("<I", data, 6)[0]), style)
                elif kind == 0x205:
                    sheet.cells[r, c] = ERRORS.get(data[6], "#N/A") if data[7] else "TRUE" if data[6] else "FALSE"
                else:
                    sheet.formulas = True
                    if data[12:14] == b"\xff\xff":
                        if data[6] == 0:
                            waiting = (r, c)
                        elif data[6] in (1, 2):
                            sheet.cells[r, c] = ("TRUE" if data[8] else "FALSE") if data[6] == 1 else ERRORS.get(data[8], "#N/A")
                    else:
                        sheet.cells[r, c] = self.shown(struct.unpack_from("<d", data, 6)[0], style)
            elif kind == 0x207 and waiting:
                sheet.cells[waiting] = self._text(data, 0, 2)
                waiting = None
            elif kind == 0xBD:
                r, first = struct.unpack_from("<HH", data)
                for k in range((len(data) - 6) // 6):
                    style, value = struct.unpack_from("<HI", data, 4 + 6 * k)
                    sheet.cells[r, first + k] = self.shown(_rk(value), style)
            elif kind == 0xE5:
                sheet.merged = struct.unpack_from("<H", data)[0] > 0
        _area(sheet)
        return sheet


def convert_xls(data: bytes, context: Context) -> Result:
    if data[:4] != b"\xd0\xcf\x11\xe0":
        raise invalid("The file signature does not match this Excel format.")
    try:
        file = CompoundFile(data)
        stream = file.stream("Workbook") or file.stream("Book")
        if stream is None:
            raise ValueError("Cannot find Workbook stream in file")
        book = _Xls(stream, context)
        return workbook_to_markdown([book.sheet(name, at) for name, at in book.sheets])
    except (ValueError, LookupError, struct.error) as error:
        raise invalid(f"Cannot read workbook: {error}") from None
