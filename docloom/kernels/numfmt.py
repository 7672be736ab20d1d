"""Spreadsheet numbers as their cells show them."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache, wraps
from typing import Any

#: Number formats that files refer to by number only (fixed values of the file formats).
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "m/d/yy", 15: "d-mmm-yy",
    16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)",
    39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
_TOKEN = re.compile(r'"([^"]*)"|\\(.)|_(.)|\*(.)|\[(h+|m+|s+)\]|\[[^\]]*\]|(AM/PM|A/P)|(y+|m+|d+|h+|s+)|(\.0+)|(.)', re.I | re.S)
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()


def general(x: float) -> str:
    """At most eleven characters of digits, as plain as possible."""
    if x == int(x) and abs(x) < 1e11:
        return str(int(x))
    if x == 0 or 1e-5 <= abs(x) < 1e11:
        digits = max(0, 10 - len(str(int(abs(x)))))
        text = f"{x:.{digits}f}"
        return text.rstrip("0").rstrip(".") if "." in text else text
    mantissa, exponent = f"{x:.5E}".split("E")
    return f"{mantissa.rstrip('0').rstrip('.')}E{exponent[0]}{exponent[1:].zfill(2)}"


#: Formats whose analysis is kept, and their greatest length: a workbook has few, and its cells share them.
KEPT, KEPT_CHARS = 1024, 256


def _kept(analyse: Callable[[str], Any]) -> Callable[[str], Any]:
    cached = lru_cache(KEPT)(analyse)
    return wraps(analyse)(lambda fmt: cached(fmt) if len(fmt) <= KEPT_CHARS else analyse(fmt))


@_kept
def is_date(fmt: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", fmt, flags=re.I | re.S)
    return bool(re.search("[ymdhs]", bare, re.I)) and not re.match("general", bare, re.I)


@_kept
def _tokens(fmt: str) -> tuple[list[tuple], list[str]]:
    """A date format's tokens, and the unit that each has or an empty string."""
    tokens = [m.groups() for m in _TOKEN.finditer(fmt)]
    return tokens, [(t[6] or t[4] or "").lower()[:1] for t in tokens]


def _date(x: float, fmt: str, epoch_1904: bool) -> str:
    seconds = round(x * 86400 * 1000) / 1000
    moment = datetime(1904, 1, 1) + timedelta(seconds=seconds) if epoch_1904 else datetime(1899, 12, 30 if x >= 60 else 31) + timedelta(seconds=seconds)
    if ".0" not in fmt:
        moment += timedelta(microseconds=500_000) if moment.microsecond >= 500_000 else timedelta()
    tokens, units = _tokens(fmt)
    twelve = any(t[5] for t in tokens)
    out = []
    for i, (quoted, escaped, gap, _fill, elapsed, half, unit, fraction, other) in enumerate(tokens):
        if quoted is not None or escaped is not None:
            out.append(quoted if quoted is not None else escaped)
        elif gap is not None:
            out.append(" ")
        elif elapsed:
            whole = int(seconds // {"h": 3600, "m": 60, "s": 1}[elapsed[0].lower()])
            out.append(str(whole).zfill(len(elapsed)))
        elif half:
            out.append(("PM" if moment.hour >= 12 else "AM")[: 1 if len(half) == 3 else 2])
        elif unit:
            k, n = unit[0].lower(), len(unit)
            before = next((u for u in reversed(units[:i]) if u), "")
            after = next((u for u in units[i + 1 :] if u), "")
            if k == "m" and n <= 2 and (before == "h" or after == "s"):
                out.append(str(moment.minute).zfill(n))
            elif k == "y":
                out.append(f"{moment.year % 100:02d}" if n <= 2 else str(moment.year))
            elif k == "m":
                name = MONTHS[moment.month - 1]
                out.append(str(moment.month).zfill(n) if n <= 2 else name[:3] if n == 3 else name[:1] if n == 5 else name)
            elif k == "d":
                name = DAYS[moment.weekday()]
                out.append(str(moment.day).zfill(n) if n <= 2 else name[:3] if n == 3 else name)
            elif k == "h":
                out.append(str((moment.hour % 12 or 12) if twelve else moment.hour).zfill(min(n, 2)))
            else:
                out.append(str(moment.second).zfill(min(n, 2)))
        elif fraction:
            out.append(f"{moment.microsecond / 1e6:.{len(fraction) - 1}f}"[1:])
        elif other is not None:
            out.append(other)
    return "".join(out)


_LITERAL = re.compile(r'"([^"]*)"|\\(.)|_(.)|\*.|\[[^\]]*\]', re.S)
_MASK = re.compile(r"[#0?][#0?,]*(?:\.[#0?]*)?(?:E[+\-][#0?]+)?|\.[#0?]+", re.I)
_SECTION = re.compile(r';(?=(?:[^"]*"[^"]*")*[^"]*$)')


@_kept
def _body(fmt: str) -> tuple[str, list[str], re.Match | None]:
    """A number format with its literals replaced, these, and the place of its digits."""
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(m[1] if m[1] is not None else m[2] if m[2] is not None else " " if m[3] else "")
        return chr(0xE000 + len(held) - 1)

    body = _LITERAL.sub(hold, fmt)
    return body, held, _MASK.search(body)


def _number(x: float, fmt: str) -> str:
    body, held, m = _body(fmt)
    if m:
        mask = m[0]
        percent = body.count("%")
        value = abs(x) * 100**percent
        whole, _, rest = mask.partition(".")
        rest, _, power = re.split("(?i)(e)", rest)[0], "", ""
        exponent = re.search(r"E([+\-])([#0?]+)", mask, re.I)
        scale = len(whole) - len(whole.rstrip(","))
        if exponent is None and not rest and whole.endswith(","):
            value /= 1000**scale
        places = len(rest)
        if exponent:
            mantissa, power = f"{value:.{places}E}".split("E")
            text = f"{mantissa}E{exponent[1] if power[0] == '+' and exponent[1] == '+' else '-' if power[0] == '-' else ''}{power[1:].lstrip('0').zfill(len(exponent[2]))}"
        else:
            fixed = str(Decimal(repr(value)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) if value < 1e15 else f"{value:.{places}f}"
            left, _, right = fixed.partition(".")
            least = whole.count("0")
            left = left.lstrip("0").zfill(least) if left.strip("0") or least else ""
            if "," in whole.rstrip(","):
                left = f"{int(left or 0):,}" if left else left
            keep = len(rest.rstrip("#"))
            while len(right) > keep and right.endswith("0"):
                right = right[:-1]
            text = left + ("." + right if right or (rest == "" and "." in mask) else "")
        body = body[: m.start()] + text + body[m.end() :]
    for i, text in enumerate(held):
        body = body.replace(chr(0xE000 + i), text)
    return body


@_kept
def _sections(fmt: str) -> list[str]:
    return _SECTION.split(fmt)


def shown(x: float, fmt: str = "General", epoch_1904: bool = False) -> str:
    """A number in a format; what the format cannot be read for is shown in General."""
    if is_date(fmt):
        try:
            return _date(x, fmt.split(";")[0], epoch_1904)
        except (OverflowError, ValueError):
            return general(x)
    parts = _sections(fmt)
    if len(parts) > 2 and x == 0:
        part, sign = parts[2], ""
    elif len(parts) > 1 and x < 0:
        part, sign = parts[1], ""
    else:
        part, sign = parts[0], "-" if x < 0 else ""
    if "general" in part.lower():
        return re.sub("(?i)general", general(x if len(parts) == 1 or x >= 0 else abs(x)), part)
    if part.strip() == "@" or "/" in part and "?" in part:
        return general(x)
    return sign + _number(x, part)
