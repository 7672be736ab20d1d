"""DOCX to Markdown, by way of simple HTML."""

from __future__ import annotations

import re
from html import escape

from docloom.functions.limits import ConversionError
from docloom.kernels.archive import Archive
from docloom.kernels.base import Context, Result, decode_text, unique
from docloom.kernels.html import html_to_markdown
from docloom.kernels.xmltree import Element, parse_xml

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_OFF = ("0", "false", "none", "off")


def _on(properties: Element | None, name: str) -> bool:
    e = properties.child(name) if properties is not None else None
    return e is not None and (e.any_get("val") or "true").lower() not in _OFF


class _Writer:
    def __init__(self, archive: Archive):
        self.archive, self.check = archive, archive.context.check
        self.warnings: list[str] = []
        self.styles = {s.any_get("styleId"): ((s.child("name").any_get("val") if s.child("name") is not None else "") or "") for s in self._part("word/styles.xml", "style")}
        self.links = {r.get("Id"): r for r in self._part("word/_rels/document.xml.rels", "Relationship")}
        self.ordered = self._numbering()
        self.notes: list[tuple[str, str]] = []

    def _part(self, name: str, element: str) -> list[Element]:
        return list(parse_xml(decode_text(self.archive.read(name))).find_all(element)) if self.archive.has(name) else []

    def _numbering(self) -> dict[tuple[str, str], bool]:
        """Whether a list's level is numbered, by (number id, level)."""
        if not self.archive.has("word/numbering.xml"):
            return {}
        root = parse_xml(decode_text(self.archive.read("word/numbering.xml")))
        formats = {}
        for abstract in root.find_all("abstractNum"):
            for level in abstract.find_all("lvl"):
                fmt = level.child("numFmt")
                formats[abstract.any_get("abstractNumId"), level.any_get("ilvl")] = fmt is not None and fmt.any_get("val") != "bullet"
        out = {}
        for number in root.find_all("num"):
            of = number.child("abstractNumId")
            for (abstract, level), numbered in formats.items():
                if of is not None and of.any_get("val") == abstract:
                    out[number.any_get("numId"), level] = numbered
        return out

    def run(self, run: Element) -> str:
        out = []
        for e in run.elements():
            if e.name == "t":
                out.append(escape(e.text()))
            elif e.name == "tab":
                out.append("\t")
            elif e.name in ("br", "cr"):
                if (e.any_get("type") or "textWrapping") == "textWrapping":
                    out.append("<br />")
            elif e.name == "noBreakHyphen":
                out.append("‑")
            elif e.name in ("drawing", "pict"):
                for image in e.find_all("blip"):
                    about = e.first("docPr")
                    alt = (about.any_get("descr") or about.any_get("title") or "") if about is not None else ""
                    out.append(f'<img alt="{escape(alt)}" />')
                    del image
            elif e.name in ("footnoteReference", "endnoteReference"):
                self.notes.append((e.name[:-9], e.any_get("id") or ""))
                out.append(f"<sup>[{len(self.notes)}]</sup>")
        text = "".join(out)
        if not text:
            return ""
        properties = run.child("rPr")
        if _on(properties, "strike"):
            text = f"<s>{text}</s>"
        if _on(properties, "i"):
            text = f"<em>{text}</em>"
        if _on(properties, "b"):
            text = f"<strong>{text}</strong>"
        return text

    def inline(self, parent: Element) -> str:
        out = []
        for e in parent.elements():
            if e.name == "r":
                out.append(self.run(e))
            elif e.name == "hyperlink":
                rel = self.links.get(e.get("id", REL) or "")
                target = rel.get("Target") if rel is not None else f"#{e.any_get('anchor')}" if e.any_get("anchor") else None
                text = self.inline(e)
                out.append(f'<a href="{escape(target)}">{text}</a>' if target and text else text)
            elif e.name in ("ins", "smartTag", "fldSimple"):
                out.append(self.inline(e))
            elif e.name == "sdt" and e.child("sdtContent") is not None:
                out.append(self.inline(e.child("sdtContent")))
        # Neighbouring runs of one kind are one.
        text = "".join(out)
        for tag in ("strong", "em", "s"):
            text = text.replace(f"</{tag}><{tag}>", "")
        return text

    def blocks(self, parent: Element) -> str:
        out: list[str] = []
        lists: list[str] = []  # the kinds of the lists that are open

        def close(to: int) -> None:
            while len(lists) > to:
                out.append(f"</li></{lists.pop()}>")

        for e in parent.elements():
            self.check()
            if e.name == "p":
                properties = e.child("pPr")
                text = self.inline(e)
                style = properties.child("pStyle") if properties is not None else None
                key = (style.any_get("val") or "") if style is not None else ""
                name = self.styles.get(key, "")
                if key and key not in self.styles:
                    self.warnings.append(f"Unrecognised paragraph style: '{key}' (Style ID: {key})")
                level = re.fullmatch(r"heading ?([1-6])", name or key, re.I)
                number = properties.child("numPr") if properties is not None else None
                if number is not None and not level and number.child("numId") is not None and number.child("numId").any_get("val") != "0":
                    if not text:
                        continue
                    depth = number.child("ilvl").any_get("val") if number.child("ilvl") is not None else "0"
                    kind = "ol" if self.ordered.get((number.child("numId").any_get("val"), depth)) else "ul"
                    want = min(int(depth) if depth.isdigit() else 0, 8) + 1
                    close(want)
                    if len(lists) == want and lists[-1] != kind:
                        close(want - 1)
                    if len(lists) == want:
                        out.append("</li><li>")
                    while len(lists) < want:
                        lists.append(kind)
                        out.append(f"<{kind}><li>")
                    out.append(text)
                    continue
                close(0)
                if text:
                    tag = f"h{level[1]}" if level else "p"
                    out.append(f"<{tag}>{text}</{tag}>")
            elif e.name == "tbl":
                close(0)
                out.append("<table>")
                for row in e.elements():
                    if row.name == "tr":
                        out.append("<tr>")
                        for c in row.elements():
                            if c.name == "tc":
                                properties = c.child("tcPr")
                                span = properties.child("gridSpan") if properties is not None else None
                                merge = properties.child("vMerge") if properties is not None else None
                                if merge is not None and (merge.any_get("val") or "continue") == "continue":
                                    continue
                                wide = f' colspan="{escape(span.any_get("val") or "1")}"' if span is not None else ' rowspan="2"' if merge is not None else ""
                                out.append(f"<td{wide}>{self.blocks(c)}</td>")
                        out.append("</tr>")
                out.append("</table>")
            elif e.name in ("sdt", "ins") and (inner := e.child("sdtContent") or e) is not e:
                close(0)
                out.append(self.blocks(inner))
        close(0)
        return "".join(out)

    def note_list(self) -> str:
        items = []
        for kind, key in self.notes:
            part = f"word/{kind}s.xml"
            found = next((n for n in self._part(part, kind) if n.any_get("id") == key), None)
            items.append(f"<li>{self.blocks(found) if found is not None else ''}</li>")
        return f"<ol>{''.join(items)}</ol>" if items else ""


def convert_docx(data: bytes, context: Context) -> Result:
    archive = Archive(data, context)
    if not archive.has("word/document.xml"):
        raise ConversionError("INVALID_DOCX", "The archive does not contain a Word document.")
    for entry in archive.files():
        if re.search(r"\.(xml|rels)\Z", entry.name, re.I):
            parse_xml(decode_text(archive.read(entry.name)))
    # Parts were read once, under the budget; reading them again is not counted twice.
    used = archive.budget.bytes
    archive.budget.bytes = 0
    try:
        root = parse_xml(decode_text(archive.read("word/document.xml")))
        body = root.child("body")
        if body is None:
            raise ConversionError("INVALID_DOCX", "Cannot read Word document: the document has no body.")
        writer = _Writer(archive)
        result = html_to_markdown(writer.blocks(body) + writer.note_list(), context.check)
        return Result(result.markdown, unique(result.warnings + writer.warnings))
    finally:
        archive.budget.bytes = used
