"""CSV, JSON and XML source."""

from __future__ import annotations

import json
import re

from docloom.functions.limits import CSV_COLUMNS, CSV_ROWS, ConversionError
from docloom.kernels.base import Check, Context, Result, decode_text, fenced, table, unchecked

_FIELD = re.compile(r'(?:"([^"]*(?:""[^"]*)*)"|([^",\r\n]*))(,|\r\n|\r|\n|\Z)')


def parse_csv(source: str, check: Check = unchecked) -> list[list[str]]:
    """Rows of comma-separated fields; a quote may only open a whole field, and only a comma or line end may follow its end."""
    rows: list[list[str]] = []
    row: list[str] = []
    at, size = 0, len(source)
    while at < size or row:
        m = _FIELD.match(source, at)
        if m is None:
            open_quote = source[at] == '"' and not re.compile(r'"[^"]*(?:""[^"]*)*"').match(source, at)
            raise ConversionError("INVALID_CSV", "CSV has an unclosed quoted field." if open_quote else "CSV has an unexpected quote or text after a closing quote.")
        if len(row) >= CSV_COLUMNS:
            raise ConversionError("CSV_LIMIT", "CSV exceeds the 1,000-column limit.")
        quoted, plain, end = m.groups()
        row.append(plain if quoted is None else quoted.replace('""', '"'))
        at = m.end()
        if end != ",":
            rows.append(row)
            row = []
            check()
            if len(rows) > CSV_ROWS:
                raise ConversionError("CSV_LIMIT", "CSV exceeds the 50,000-row limit.")
    return rows


def convert_csv(data: bytes, context: Context) -> Result:
    rows = parse_csv(decode_text(data), context.check)
    ragged = len({len(r) for r in rows}) > 1
    return Result(table(rows), ["Rows have different widths; missing cells are left blank."] if ragged else [])


_INDEX = re.compile(r"0|[1-9]\d{0,9}")
_LONE = re.compile("[\ud800-\udfff]")


def _number(x: float) -> str:
    """A double as ECMAScript prints it: the shortest digits, in plain notation from 1e-6 to below 1e21."""
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    if x == 0:
        return "0"
    sign = "-" if x < 0 else ""
    mantissa, _, exponent = f"{abs(x)!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    part = part if part != "0" or exponent else ""
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + part) - len((whole + part).lstrip("0")))
    digits = digits.rstrip("0")
    if len(digits) <= point <= 21:
        return sign + digits + "0" * (point - len(digits))
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'+' if point > 0 else '-'}{abs(point - 1)}"


def _string(s: str) -> str:
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(s, ensure_ascii=False))


def _keys(value: dict) -> list[str]:
    """Keys that are array indices first, by number, then the others as they came."""
    index = sorted((k for k in value if _INDEX.fullmatch(k) and int(k) < 2**32 - 1), key=int)
    first = set(index)
    return index + [k for k in value if k not in first]


def pretty(value: object, indent: str = "", check: Check = unchecked) -> str:
    check()
    inner = indent + "  "
    if isinstance(value, dict):
        items = [f"{inner}{_string(k)}: {pretty(value[k], inner, check)}" for k in _keys(value)]
        return "{\n" + ",\n".join(items) + f"\n{indent}}}" if items else "{}"
    if isinstance(value, list):
        return "[\n" + ",\n".join(inner + pretty(x, inner, check) for x in value) + f"\n{indent}]" if value else "[]"
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, float):
        return _number(value)
    return {None: "null", True: "true", False: "false"}[value]


def _no_constant(name: str) -> None:
    raise ValueError(f"Unexpected token {name}")


def convert_json(data: bytes, context: Context) -> Result:
    text = decode_text(data)
    try:
        value = json.loads(text, parse_int=float, parse_float=float, parse_constant=_no_constant)
        return Result(fenced(pretty(value, check=context.check), "json"))
    except (ValueError, RecursionError) as error:
        raise ConversionError("INVALID_JSON", f"Invalid JSON: {error}") from None


def convert_xml(data: bytes, context: Context) -> Result:
    return Result(fenced(decode_text(data), "xml"), ["XML is preserved as source; syntax is not validated."])
