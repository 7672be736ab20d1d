"""Fixed values of the conversion contract: limits, formats, error codes and messages that results must equal."""

from __future__ import annotations

from dataclasses import dataclass

MIB = 1024 * 1024

# --- fixed values: limits ---------------------------------------------------------------------------------------------
MAX_FILES = 25
MAX_FILE_BYTES = 20 * MIB
MAX_BATCH_BYTES = 100 * MIB
MAX_OUTPUT_BYTES = 10 * MIB
WORKERS = 8
TIMEOUT_SECONDS, MODEL_SECONDS = 120, 60
CACHE_BYTES = 100 * MIB
ABANDONED_MS = 86_400_000
MODEL_BYTES = 64 * MIB

ARCHIVE_ENTRIES = 2000
ARCHIVE_ENTRY_BYTES = 20 * MIB
ARCHIVE_EXPANDED_BYTES = 64 * MIB
ARCHIVE_RATIO = 500
ARCHIVE_DEPTH = 3

CSV_COLUMNS, CSV_ROWS = 1000, 50_000
SHEETS, SHEET_CELLS, SHEET_ROWS, SHEET_COLUMNS = 100, 500_000, 50_000, 1000
TREE_NODES, TREE_DEPTH = 100_000, 128
EPUB_SPINE = 500
SLIDES, SLIDE_TABLE_ROWS, SLIDE_TABLE_COLUMNS = 200, 1000, 100
PDF_PAGES, PDF_ITEMS, PDF_SIDE = 100, 100_000, 14_400
EXIF_TAGS, EXIF_CHARS, EXIF_ITEMS = 1000, 2000, 64
IMAGE_PIXELS, IMAGE_SIDE, RENDER_PIXELS, RENDER_SIDE = 16_000_000, 8192, 4_000_000, 2400
ERROR_CHARS, NAME_CHARS, DIRECTORY_CHARS = 1000, 100, 255
SAVE_ATTEMPTS = 1000
# --- end of fixed values ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Format:
    id: str
    label: str
    extensions: tuple[str, ...]
    mimes: tuple[str, ...]


# --- fixed values: formats, in the order in which they are tried --------------------------------------------------------
FORMATS = (
    Format("html", "HTML", ("html", "htm"), ("text/html",)),
    Format("xlsx", "Excel (XLSX)", ("xlsx",), ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",)),
    Format("xls", "Excel (legacy XLS)", ("xls",), ("application/vnd.ms-excel",)),
    Format("csv", "CSV", ("csv",), ("text/csv",)),
    Format("json", "JSON", ("json",), ("application/json",)),
    Format("xml", "XML", ("xml",), ("application/xml", "text/xml")),
    Format("docx", "Word (DOCX)", ("docx",), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",)),
    Format("epub", "EPUB", ("epub",), ("application/epub+zip",)),
    Format("zip", "ZIP archive", ("zip",), ("application/zip", "application/x-zip-compressed")),
    Format("pdf", "PDF (text / scanned)", ("pdf",), ("application/pdf",)),
    Format("pptx", "PowerPoint (PPTX)", ("pptx",), ("application/vnd.openxmlformats-officedocument.presentationml.presentation",)),
    Format("image", "Image OCR (JPG / PNG)", ("jpg", "jpeg", "png"), ("image/jpeg", "image/png")),
    Format("exif", "JPEG EXIF metadata", (), ()),
)
# --- end of fixed values ----------------------------------------------------------------------------------------------

BY_EXTENSION = {e: f.id for f in reversed(FORMATS) for e in f.extensions}
BY_MIME = {m: f.id for f in reversed(FORMATS) for m in f.mimes}


class ConversionError(Exception):
    """A failure with a code that callers may rely on."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.message = code, message


def left_units(text: str, n: int) -> str:
    """The first n UTF-16 units of a text; a character that is cut in two leaves U+FFFD."""
    return text if 2 * len(text) <= n else text.encode("utf-16-le", "surrogatepass")[: 2 * n].decode("utf-16-le", "replace")


def error_info(error: BaseException) -> tuple[str, str]:
    """(code, message of at most 1000 characters) of any exception."""
    code = getattr(error, "code", None)
    return code if isinstance(code, str) else "CONVERSION_FAILED", left_units(str(error) or "An unexpected error occurred.", ERROR_CHARS)


def detect_format(name: str, mime: str | None = None, override: str = "auto") -> str:
    """The format's id: an explicit one, else by the extension, else, for a name without a dot, by the MIME type."""
    if override != "auto":
        if override not in {f.id for f in FORMATS}:
            raise ConversionError("UNSUPPORTED_FORMAT", "Choose a supported file type.")
        return override
    found = BY_EXTENSION.get(name.rpartition(".")[2].lower())
    if found is None and "." not in name:
        found = BY_MIME.get(mime or "")
    if found is None:
        raise ConversionError("UNSUPPORTED_FORMAT", f"Unsupported file: {name}. Legacy PPT, audio/video and PNG metadata are unsupported.")
    return found


@dataclass(frozen=True)
class Options:
    """Settings, frozen into every job when it is staged."""

    cache_hours: int = 24
    model_cache_hours: int = 24
    ocr_language: str = "en"
    ocr_rotation: int = 0
    pdf_force_ocr: bool = False
    download_directory: str = ""

    def __post_init__(self) -> None:
        for field, message in (("cache_hours", "Cache duration must be a whole number from 1 to 720 hours."), ("model_cache_hours", "Model cache duration must be a whole number from 1 to 720 hours.")):
            value = getattr(self, field)
            try:
                hours = float(value)
            except (TypeError, ValueError):
                raise ValueError(message) from None
            if not hours.is_integer() or not 1 <= hours <= 720:
                raise ValueError(message)
            object.__setattr__(self, field, int(hours))
        if self.ocr_language not in ("en", "ar"):
            raise ValueError("Select English or Arabic OCR.")
        if self.ocr_rotation not in (0, 90, 180, 270):
            raise ValueError("Select a supported image rotation.")
        object.__setattr__(self, "pdf_force_ocr", self.pdf_force_ocr is True)
        object.__setattr__(self, "download_directory", str(self.download_directory or "")[:DIRECTORY_CHARS])
