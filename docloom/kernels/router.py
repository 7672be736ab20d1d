"""One file to Markdown: routing, archives within archives, and the checks on every result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from docloom.functions import limits
from docloom.functions.limits import ConversionError, detect_format, error_info
from docloom.kernels.archive import Archive
from docloom.kernels.base import Context, Result, Sections, heading, utf8_size
from docloom.kernels.book import convert_epub
from docloom.kernels.html import convert_html
from docloom.kernels.image import convert_exif, convert_image
from docloom.kernels.pdf import convert_pdf
from docloom.kernels.presentation import convert_pptx
from docloom.kernels.text import convert_csv, convert_json, convert_xml
from docloom.kernels.word import convert_docx
from docloom.kernels.workbook import convert_xls, convert_xlsx

Kernel = Callable[[bytes, Context], Result]

#: Failures of an entry that end the whole archive (fixed values); others become warnings.
FATAL = {"UNSAFE_ARCHIVE", "ARCHIVE_DEPTH", "OUTPUT_TOO_LARGE", "PDF_LIMIT", "IMAGE_LIMIT", "PPTX_LIMIT", "MODEL_TIMEOUT", "TIMEOUT"}


def _entry(archive: Archive, name: str, context: Context) -> tuple[str | None, list[str]]:
    """(section, warnings) of an archive's entry; only what is FATAL ends the archive, all else that fails is a warning."""
    try:
        fmt = detect_format(name)
    except ConversionError:
        return None, [f"Skipped unsupported file: {name}"]
    try:
        inner = convert(name, archive.read(name), context, fmt)
    except Exception as error:  # also a defect of a kernel: the other entries go on
        code, message = error_info(error)
        if code in FATAL:
            raise
        return None, [f"{name}: {message}"]
    return f"## {heading(name)}\n\n{inner.markdown}", [f"{name}: {w}" for w in inner.warnings]


def convert_zip(data: bytes, context: Context) -> Result:
    if context.depth == limits.ARCHIVE_DEPTH:
        raise ConversionError("ARCHIVE_DEPTH", "ZIP nesting exceeds three levels.")
    archive, below = Archive(data, context), replace(context, depth=context.depth + 1)
    out, warnings = Sections("Combined archive output exceeds 10 MiB."), []
    for section, notes in (_entry(archive, e.name, below) for e in archive.files()):
        if section is not None:
            out.add(section)
        warnings += notes
    return Result("\n---\n\n".join(out.parts) or "_No convertible files in this archive._\n", warnings)


KERNELS: dict[str, Kernel] = {
    "html": convert_html, "xlsx": convert_xlsx, "xls": convert_xls, "csv": convert_csv, "json": convert_json, "xml": convert_xml, "docx": convert_docx,
    "epub": convert_epub, "zip": convert_zip, "pdf": convert_pdf, "pptx": convert_pptx, "image": convert_image, "exif": convert_exif,
}


def register_converter(fmt: str, kernel: Kernel) -> None:
    """Use another kernel for a format, in this process; ship it to workers as `kernels` of convert()."""
    KERNELS[fmt] = kernel


def convert(name: str, data: bytes, context: Context | None = None, fmt: str = "auto", mime: str | None = None, kernels: dict[str, Kernel] | None = None) -> Result:
    """Markdown and warnings of a file; raises ConversionError."""
    context = context or Context()
    kind = detect_format(name, mime, fmt)
    context.report(f"converting {kind}")
    result = (KERNELS | (kernels or {}))[kind](data, context)
    if not isinstance(result.markdown, str):
        raise ConversionError("INVALID_RESULT", "Converter did not return Markdown.")
    if utf8_size(result.markdown) > limits.MAX_OUTPUT_BYTES:
        raise ConversionError("OUTPUT_TOO_LARGE", "Converted Markdown exceeds the 10 MB output limit.")
    return result
