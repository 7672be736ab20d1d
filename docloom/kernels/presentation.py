"""PPTX to Markdown: slides in presentation order, their shapes' text, tables and speaker notes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

from docloom.functions import limits
from docloom.functions.limits import ConversionError
from docloom.kernels.archive import Archive, percent_decoded, relative_path
from docloom.kernels.base import JS_SPACE, Context, Result, Sections, body_text, decode_text, table, unique
from docloom.kernels.xmltree import Element, parse_xml

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
# --- fixed values: element names, messages and warnings --------------------------------------------------------------------
OMITTED = ("chart", "relIds", "oleObj", "pic", "videoFile", "audioFile", "cxnSp")
NOT_NOTES = ("sldImg", "sldNum", "dt", "hdr", "ftr")
TITLES = ("title", "ctrTitle")
SPANS = ("rowSpan", "gridSpan", "hMerge", "vMerge")
BULLETS = ("buChar", "buAutoNum")
DEEPEST_LEVEL = 8
SCOPE = "Slide text follows shape order. Master/layout text, inherited bullet styles, charts, SmartArt, animations and visual positioning may be omitted."
UNSAFE_PART, UNSAFE_DECODED, BAD_ENCODING, OUTSIDE = "Unsafe or external presentation part.", "Unsafe presentation part.", "Invalid presentation relationship encoding.", "Relationship leaves the archive."
# --- end of fixed values ----------------------------------------------------------------------------------------------
_NO_PART = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:|/|.*[\\?#]|\Z", re.S)


def invalid(message: str) -> ConversionError:
    return ConversionError("INVALID_PPTX", message)


def part_name(source: str, target: str | None) -> str:
    """The part that a relationship of the part source leads to; a target is checked as written and as decoded."""
    written = target or ""
    try:
        decoded = percent_decoded(written)
    except ValueError:
        decoded = None
    for spelling, message in ((written, UNSAFE_PART), (decoded, UNSAFE_DECODED)):
        if spelling is None:
            raise invalid(BAD_ENCODING)
        if _NO_PART.match(spelling):
            raise invalid(message)
    return relative_path(source, decoded, invalid(OUTSIDE))


class Deck:
    """The parts of a presentation and how they refer to each other."""

    MAIN = "ppt/presentation.xml"

    def __init__(self, archive: Archive):
        self.archive = archive

    def part(self, name: str) -> Element:
        if self.archive.has(name):
            return parse_xml(decode_text(self.archive.read(name)))
        raise invalid(f"Missing presentation part: {name}.")

    def links(self, source: str) -> dict[str, Element]:
        """Relationships of a part by their identifiers, which are its own."""
        name = re.sub(r"([^/]*)\Z", r"_rels/\1.rels", source, count=1)
        listed = list(self.part(name).find_all("Relationship")) if self.archive.has(name) else []
        by_id = {e.get("Id"): e for e in listed if e.get("Id")}
        if len(by_id) < len(listed):
            raise invalid("Duplicate or missing relationship identifier.")
        return by_id

    def target(self, source: str, link: Element | None, kind: str) -> str | None:
        """The part of a kind that a link leads to; None for one of another kind or outside."""
        inside = link is not None and link.get("TargetMode") != "External" and (link.get("Type") or "").endswith(f"/{kind}")
        return part_name(source, link.get("Target")) if inside else None

    def slides(self) -> Iterator[tuple[str, Element, Element | None]]:
        """(name, slide, notes) in the order of the presentation's list.

        Sections repeat slide numbers in a namespace of their own: only the list that is the root's child counts.
        """
        root = self.part(self.MAIN)
        own = lambda e, name: [c for c in e.elements() if (c.name, c.namespace) == (name, root.namespace)]
        numbers = [slide for listed in own(root, "sldIdLst")[:1] for slide in own(listed, "sldId")]
        links = self.links(self.MAIN)
        if not numbers:
            raise invalid("Presentation contains no slides.")
        if len(numbers) > limits.SLIDES:
            raise ConversionError("PPTX_LIMIT", "Presentations are limited to 200 slides.")
        for place, number in enumerate(numbers, 1):
            name = self.target(self.MAIN, links.get(number.get("id", REL) or ""), "slide")
            if name is None:
                raise invalid(f"Missing internal relationship for slide {place}.")
            slide = self.part(name)
            notes = next(filter(None, (self.target(name, link, "notesSlide") for link in self.links(name).values())), None)
            yield name, slide, self.part(notes) if notes else None


class Blocks:
    """Markdown blocks of a slide's or its notes' shapes, collected by one handler for each kind of element."""

    def __init__(self, warnings: list[str], notes: bool = False):
        self.found: list[str] = []
        self.warnings, self.notes = warnings, notes
        self.handlers = {"sp": self.shape, "tbl": self.grid} | dict.fromkeys(OMITTED, self.omitted)

    def of(self, root: Element) -> str:
        root.visit(self.handlers)
        return "\n\n".join(self.found)

    def shape(self, e: Element) -> None:
        place = e.first("ph")
        kind = None if place is None else place.any_get("type")
        if self.notes and kind in NOT_NOTES:
            return
        text = "\n\n".join(bullet + body_text(line) for bullet, line in paragraphs(e))
        if text:
            self.found.append(text if self.notes or kind not in TITLES else f"### {text}")

    def grid(self, e: Element) -> None:
        rows = [[cell for cell in row.elements() if cell.name == "tc"] for row in e.elements() if row.name == "tr"]
        if len(rows) > limits.SLIDE_TABLE_ROWS or max(map(len, rows), default=0) > limits.SLIDE_TABLE_COLUMNS:
            raise ConversionError("PPTX_LIMIT", "Presentation table exceeds 1,000 rows or 100 columns.")
        if any(name in SPANS for cell in e.find_all("tc") for _, name in cell.attributes):
            self.warnings.append("Merged table cells are flattened.")
        if rows:
            self.found.append(table([["\n".join(line for _, line in paragraphs(cell)) for cell in row] for row in rows]))

    def omitted(self, e: Element) -> None:
        self.warnings.append(f"Unsupported presentation content ({e.name}) is omitted; embedded images are not recognized.")


def paragraphs(e: Element) -> Iterator[tuple[str, str]]:
    """(bullet, text) of each paragraph that has text."""
    for paragraph in e.find_all("p"):
        runs: list[str] = []
        paragraph.visit({"t": lambda t, keep=runs.append: keep(t.text()), "br": partial(lambda keep, _: keep("\n"), runs.append)})
        line = "".join(runs)
        if line.strip(JS_SPACE):
            yield _bullet(paragraph.child("pPr")), line


def _bullet(properties: Element | None) -> str:
    if properties is None or not any(e.name in BULLETS for e in properties.elements()):
        return ""
    try:
        level = int(float(properties.any_get("lvl") or 0))
    except (ValueError, OverflowError):
        level = 0
    return "  " * sorted((0, level, DEEPEST_LEVEL))[1] + "- "


def convert_pptx(data: bytes, context: Context) -> Result:
    if data.startswith(b"\xd0\xcf\x11\xe0"):
        raise invalid("Encrypted Office documents and legacy PPT are unsupported.")
    sections, warnings = Sections("Presentation output exceeds 10 MiB."), [SCOPE]
    for place, (_, slide, notes) in enumerate(Deck(Archive(data, context)).slides(), 1):
        context.check()
        own: list[str] = []
        body = Blocks(own).of(slide)
        said = "" if notes is None else Blocks(own, notes=True).of(notes)
        if said:
            body += f"\n\n### Speaker notes\n\n{said}"
        if not body.strip(JS_SPACE):
            own.append("No supported text was found.")
        sections.add(f"## Slide {place}\n\n{body or '_No supported text._'}\n")
        warnings += [f"Slide {place}: {w}" for w in unique(own)]
    return Result("\n".join(sections.parts), warnings)
