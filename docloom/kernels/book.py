"""EPUB to Markdown: chapters in spine order."""

from __future__ import annotations

import re
from collections.abc import Iterator

from docloom.functions import limits
from docloom.functions.limits import ConversionError
from docloom.kernels.archive import Archive, percent_decoded, relative_path, safe_path
from docloom.kernels.base import Context, Result, Sections, decode_text, heading, unique
from docloom.kernels.html import html_to_markdown
from docloom.kernels.xmltree import Element, parse_xml

# --- fixed values: places, messages, identifiers that are refused, and font obfuscation, which leaves the text readable ------
CONTAINER, ENCRYPTION = "META-INF/container.xml", "META-INF/encryption.xml"
FONT_ALGORITHMS = ("http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC")
FONT_FILE = re.compile(r"\.(otf|ttf|woff2?)\Z", re.I)
CHAPTER_TYPES = ("application/xhtml+xml", "text/html")
REFUSED_IDS = ("__proto__", "constructor", "prototype")
FONTS_OMITTED = "Obfuscated font assets are omitted; chapter text is unaffected."
# --- end of fixed values ----------------------------------------------------------------------------------------------
_ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:|/|.*\\", re.S)


def invalid(message: str) -> ConversionError:
    return ConversionError("INVALID_EPUB", message)


def resolve_chapter(package: str, href: str) -> str:
    if _ABSOLUTE.match(href):
        raise invalid("External EPUB chapter URLs are unsupported.")
    return relative_path(package, percent_decoded(re.match("[^#?]*", href)[0]), invalid("Chapter path leaves the archive."))


def _only_fonts(record: Element) -> bool:
    """Whether an encryption record is about a font that is merely obfuscated."""
    value = lambda name, attribute: next((e.get(attribute) for e in record.find_all(name)), None) or ""
    return value("EncryptionMethod", "Algorithm") in FONT_ALGORITHMS and bool(FONT_FILE.search(value("CipherReference", "URI")))


class Book:
    """The package of an EPUB: its title, and what its spine lists."""

    def __init__(self, archive: Archive):
        self.archive, self.check = archive, archive.context.check
        root_file = self._xml(CONTAINER).first("rootfile")
        self.name = safe_path(None if root_file is None else root_file.get("full-path"))
        self.root = self._xml(self.name)

    def _xml(self, name: str) -> Element:
        return parse_xml(decode_text(self.archive.read(name)))

    @staticmethod
    def warnings(archive: Archive) -> list[str]:
        """Refuses content that is encrypted; a file that lists nothing counts as such."""
        if not archive.has(ENCRYPTION):
            return []
        fonts = [_only_fonts(e) for e in parse_xml(decode_text(archive.read(ENCRYPTION))).find_all("EncryptedData")]
        if fonts and all(fonts):
            return [FONTS_OMITTED]
        raise ConversionError("ENCRYPTED_EPUB", "Encrypted EPUB content is unsupported.")

    @property
    def title(self) -> str:
        found = self.root.first("title")
        return "E-book" if found is None else found.text() or "E-book"

    def spine(self) -> Iterator[tuple[str | None, Element | None]]:
        """(identifier, manifest item) in reading order."""
        items = {e.get("id"): e for e in self.root.find_all("item")}
        if not items.keys().isdisjoint(REFUSED_IDS):
            raise ValueError("Invalid manifest identifier.")
        spine = self.root.first("spine")
        if spine is None or self.root.first("manifest") is None:
            raise ValueError("The package has no manifest or spine.")
        order = [e.get("idref") for e in spine.elements() if e.name == "itemref"]
        if not order or len(order) > limits.EPUB_SPINE:
            raise ValueError("EPUB must contain between 1 and 500 spine entries.")
        return ((key, items.get(key)) for key in order)

    def chapter(self, item: Element) -> Result | None:
        """An item's Markdown; None for one that is no page."""
        if item.get("media-type") not in CHAPTER_TYPES:
            return None
        return html_to_markdown(decode_text(self.archive.read(resolve_chapter(self.name, item.get("href") or ""))), self.check)


def convert_epub(data: bytes, context: Context) -> Result:
    archive = Archive(data, context)
    warnings, sections = Book.warnings(archive), Sections("EPUB output exceeds 10 MiB.")
    try:
        book = Book(archive)
        listed = book.spine()
        sections.parts.append(f"# {heading(book.title)}\n")
        for number, (key, item) in enumerate(listed, 1):
            context.check()
            if item is None:
                raise ValueError(f"Missing spine item: {key}")
            chapter = book.chapter(item)
            if chapter is None:
                warnings.append(f"Skipped non-HTML spine item {key}.")
            else:
                sections.add(f"## Chapter {number}\n\n{chapter.markdown}", chapter.markdown)
                warnings += chapter.warnings
    except ValueError as error:
        raise invalid(f"Cannot read EPUB: {error}") from None
    return Result("\n".join(sections.parts), unique(warnings))
