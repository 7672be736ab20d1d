"""Reading order of positioned text."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from docloom.kernels.base import JS_SPACE


@dataclass(frozen=True)
class Token:
    text: str
    x: float
    y: float
    width: float
    height: float
    rtl: bool = False
    turned: bool = False


def usable_text(text: str) -> bool:
    """Three letters or digits at least, half of what is visible (in UTF-16 units), and nothing undecodable."""
    visible = re.sub(f"[{JS_SPACE}]", "", text)
    letters = sum(unicodedata.category(c)[0] in "LN" for c in visible)
    units = len(visible) + sum(c > "￿" for c in visible)
    return letters >= 3 and letters >= 0.5 * max(1, units) and "�" not in visible


def _mostly_rtl(tokens: list[Token]) -> bool:
    return 2 * sum(t.rtl for t in tokens) > len(tokens)


def _lines(tokens: list[Token]) -> list[list[Token]]:
    """Tokens by line, from the top. A token joins the first line whose founder it is level with."""
    lines: list[list[Token]] = []
    for token in sorted(tokens, key=lambda t: (-t.y, t.x)):
        for line in lines:
            if abs(line[0].y - token.y) <= 0.35 * min(line[0].height, token.height):
                line.append(token)
                break
        else:
            lines.append([token])
    return sorted(lines, key=lambda line: -line[0].y)


def _line_text(line: list[Token]) -> str:
    rtl = _mostly_rtl(line)
    ordered = sorted(line, key=lambda t: -t.x if rtl else t.x)
    out = [ordered[0].text]
    for prior, token in zip(ordered, ordered[1:], strict=False):
        gap = prior.x - token.x - token.width if rtl else token.x - prior.x - prior.width
        apart = gap > 0.15 * token.height and prior.text[-1] not in JS_SPACE and token.text[0] not in JS_SPACE
        out.append((" " if apart else "") + token.text)
    return "".join(out)


def _column(tokens: list[Token]) -> str:
    lines = _lines(tokens)
    out = []
    for k, line in enumerate(lines):
        above = lines[k - 1][0] if k else None
        wide = above is not None and above.y - line[0].y > 1.7 * max(above.height, line[0].height)
        out.append(("\n" if wide else "") + _line_text(line))
    return "\n".join(out)


def layout_text(tokens: list[Token], page_width: float = 600.0) -> tuple[str, list[str]]:
    """(text, warnings) of a page; two columns if a clear gutter parts all tokens, the right one first if most are right to left."""
    warnings = []
    if any(t.turned for t in tokens):
        warnings.append("Rotated or vertical text may have imperfect reading order.")
    tokens = [t for t in tokens if t.text.strip(JS_SPACE)]
    middle, gutter = page_width / 2, 0.035 * page_width
    left = [t for t in tokens if t.x + t.width < middle - gutter]
    right = [t for t in tokens if t.x > middle + gutter]
    if min(len(left), len(right)) >= 2 and len(left) + len(right) == len(tokens):
        warnings.append("Two-column reading order was inferred from a clear central gutter.")
        columns = [right, left] if _mostly_rtl(tokens) else [left, right]
    else:
        columns = [tokens]
    return "\n\n".join(_column(c) for c in columns), warnings
