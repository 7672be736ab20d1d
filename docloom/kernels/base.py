"""What converters share: results, context, text decoding and Markdown scalars."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from docloom.functions.limits import MAX_OUTPUT_BYTES, TIMEOUT_SECONDS, ConversionError, Options
from docloom.functions.markdown import EMPTY_TABLE, ESCAPES

JS_SPACE = "\t\n\x0b\x0c\r \xa0                　﻿"
_ESCAPE = str.maketrans(dict(ESCAPES))
_LINE_END = re.compile("\r\n|\r|\n")


@dataclass
class Result:
    markdown: str
    warnings: list[str] = field(default_factory=list)


@dataclass
class Budget:
    """What all archives within one root file have used up together."""

    bytes: int = 0
    entries: int = 0


@dataclass
class Context:
    options: Options = field(default_factory=Options)
    recognizer: object | None = None
    budget: Budget = field(default_factory=Budget)
    depth: int = 0
    deadline: float = field(default_factory=lambda: time.monotonic() + TIMEOUT_SECONDS)
    report: Callable[[str], None] = lambda stage: None  # told what a file has come to

    def check(self) -> None:
        """Called in loops: a file that takes too long ends with its own error, since a task cannot be stopped for one row."""
        if time.monotonic() > self.deadline:
            raise ConversionError("TIMEOUT", "Conversion exceeded the time limit.")


Check = Callable[[], None]


def unchecked() -> None:
    """In place of Context.check where nothing limits the time."""


def decode_text(data: bytes) -> str:
    kind = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}.get(data[:2], "utf-8")
    try:
        text = data.decode(kind)
    except UnicodeDecodeError:
        raise ConversionError("INVALID_ENCODING", "Save text as UTF-8 or BOM-marked UTF-16, then try again.") from None
    return text.removeprefix("﻿").removeprefix("﻿")


def cell(value: object) -> str:
    return "" if value is None else _LINE_END.sub("<br>", str(value).translate(_ESCAPE))


def heading(value: object) -> str:
    return cell(value).replace("<br>", " ")


def body_text(value: object) -> str:
    return cell(value).replace("<br>", "\n")


def fenced(text: str, language: str = "") -> str:
    fence = "`" * max([3, *(len(run) + 1 for run in re.findall("`+", text))])
    return f"{fence}{language}\n{text}\n{fence}\n"


def table(rows: list[list[object]]) -> str:
    if not rows:
        return EMPTY_TABLE
    width = max(map(len, rows))
    lines = ["| " + " | ".join([cell(x) for x in row] + [""] * (width - len(row))) + " |" for row in rows]
    lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
    return "\n".join(lines) + "\n"


def utf8_size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


class Sections:
    """Sections of a document, joined in order; their bytes may not exceed the output limit."""

    def __init__(self, message: str):
        self.parts: list[str] = []
        self.used, self.message = 0, message

    def add(self, section: str, counted: str | None = None) -> None:
        self.used += utf8_size(section if counted is None else counted)
        if self.used > MAX_OUTPUT_BYTES:
            raise ConversionError("OUTPUT_TOO_LARGE", self.message)
        self.parts.append(section)


def unique(items: list[str]) -> list[str]:
    return list(dict.fromkeys(items))
