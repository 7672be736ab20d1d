"""Pixels of baseline JPEGs: Huffman-coded, eight bits, one scan or several, grey or in colour."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from docloom.functions.limits import ConversionError
from docloom.kernels.base import Check, unchecked


def _zigzag() -> np.ndarray:
    """Places (row * 8 + column) of a block's coefficients in the order in which they are stored: diagonals, turning at each."""
    places = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in places])


ZIGZAG = _zigzag()
#: Rows: the cosine of each frequency at the eight places of a row.
COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
BASELINE = (0xC0, 0xC1)
CHECK_EVERY = 512


class Broken(ValueError):
    """The data does not follow the format."""


@dataclass
class _Part:
    """A component: its sampling, tables, and coefficients by row and column of blocks."""

    key: int
    across: int
    down: int
    quant: int
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))
    dc: list | None = None
    ac: list | None = None


class _Bits:
    """Bits of a stretch of coded data, from which stuffed zeros were taken."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.value = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def _fill(self) -> None:
        part = self.data[self.at : self.at + 8]
        self.at += 8
        if self.at > len(self.data) + 64:
            raise Broken("the picture's data ends early")
        self.value = (self.value & ((1 << self.held) - 1)) << 64 | int.from_bytes(part.ljust(8, b"\0"), "big")
        self.held += 64

    def symbol(self, table: list[tuple[int, int]]) -> int:
        if self.held < 32:
            self._fill()
        size, symbol = table[self.value >> (self.held - 16) & 0xFFFF]
        if not size:
            raise Broken("an unknown code")
        self.held -= size
        return symbol

    def number(self, size: int) -> int:
        """A number of so many bits, of which the lower half stands for negative ones."""
        if not size:
            return 0
        if self.held < 32:
            self._fill()
        self.held -= size
        value = self.value >> self.held & ((1 << size) - 1)
        return value if value >> (size - 1) else value - (1 << size) + 1


def _huffman(body: bytes) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """By class and number: (length, symbol) for each 16 bits that may come."""
    found, at = {}, 0
    while at + 17 <= len(body):
        counts, place, code, table = body[at + 1 : at + 17], at + 17, 0, [(0, 0)] * 65536
        for size, count in enumerate(counts, 1):
            for _ in range(count):
                first = code << (16 - size)
                if first >= 65536 or place >= len(body):
                    raise Broken("a bad code table")
                table[first : first + (1 << (16 - size))] = [(size, body[place])] * (1 << (16 - size))
                code, place = code + 1, place + 1
            code <<= 1
        found[divmod(body[at], 16)] = table
        at = place
    return found


def _block(bits: _Bits, part: _Part, before: int, out: np.ndarray) -> int:
    """Read a block's coefficients into out; the first one, which is stored as a difference, is returned."""
    first = before + bits.number(bits.symbol(part.dc))
    out[0] = first
    k = 1
    while k < 64:
        run, size = divmod(bits.symbol(part.ac), 16)
        if not size:
            if run != 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise Broken("a block has too many coefficients")
        out[ZIGZAG[k]] = bits.number(size)
        k += 1
    return first


def _scan(parts: list[_Part], stretches: list[bytes], restart: int, columns: int, rows: int, most: tuple[int, int], sizes: dict[int, tuple[int, int]], check: Check) -> None:
    """Read one scan: units of all its parts in turn, or the blocks of a sole part; a new stretch of data begins after `restart` units."""
    alone = len(parts) == 1
    if alone:
        across, down = sizes[parts[0].key]
    else:
        across, down = columns, rows
    bits, last = None, {}
    for n in range(across * down):
        if n % CHECK_EVERY == 0:
            check()
        if bits is None or restart and n % restart == 0:
            if not stretches:
                raise Broken("the picture's data ends early")
            bits, last = _Bits(stretches.pop(0)), {p.key: 0 for p in parts}
        y, x = divmod(n, across)
        for p in parts:
            for v in range(1 if alone else p.down):
                for h in range(1 if alone else p.across):
                    place = (y, x) if alone else (y * p.down + v, x * p.across + h)
                    last[p.key] = _block(bits, p, last[p.key], p.blocks[place])


def _stretches(data: bytes, at: int) -> tuple[list[bytes], int]:
    """(the coded data from here on, cut at restart marks, and where the next segment begins)."""
    out, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*out, data[start:]], len(data)
        mark = data[at + 1]
        if mark == 0 or mark == 0xFF:
            at += 2 if mark == 0 else 1
        elif 0xD0 <= mark <= 0xD7:
            out.append(data[start:at])
            start = at = at + 2
        else:
            return [*out, data[start:at]], at


def _pixels(part: _Part, quant: np.ndarray, most: tuple[int, int]) -> np.ndarray:
    """A part's values at the whole picture's resolution."""
    down, across, _ = part.blocks.shape
    spectrum = (part.blocks * quant).reshape(down, across, 8, 8).astype(np.float32)
    values = np.einsum("ui,abuv,vj->abij", COSINES.astype(np.float32), spectrum, COSINES.astype(np.float32), optimize=True)
    plane = values.transpose(0, 2, 1, 3).reshape(down * 8, across * 8) + 128
    return np.repeat(np.repeat(plane, most[1] // part.down, axis=0), most[0] // part.across, axis=1)


def decode_jpeg(data: bytes, check: Check = unchecked) -> np.ndarray | None:
    """Pixels (height, width, 3), unturned; None for kinds that are not read here (progressive, arithmetic, 12 bits, four colours)."""
    try:
        return _decode(data, check)
    except (Broken, struct.error, IndexError, KeyError) as error:
        raise ConversionError("INVALID_IMAGE", f"Cannot decode image: {error}") from None


def _decode(data: bytes, check: Check) -> np.ndarray | None:
    quant: dict[int, np.ndarray] = {}
    codes: dict[tuple[int, int], list[tuple[int, int]]] = {}
    parts: list[_Part] = []
    restart = width = height = 0
    transform, at = True, 2
    most, columns, rows, sizes = (1, 1), 0, 0, {}
    while at + 4 <= len(data):
        if data[at] != 0xFF or data[at + 1] == 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if mark == 0xD9:
            break
        if mark == 1 or 0xD0 <= mark <= 0xD8:
            at += 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xDB:
            while body:
                wide, key = divmod(body[0], 16)
                table = np.zeros(64, np.int32)
                table[ZIGZAG] = np.frombuffer(body[1 : 1 + 64 * (wide + 1)], ">u2" if wide else np.uint8)
                quant[key], body = table, body[1 + 64 * (wide + 1) :]
        elif mark == 0xC4:
            codes |= _huffman(body)
        elif mark == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif mark == 0xEE and body[:5] == b"Adobe":
            transform = body[11] != 0
        elif 0xC0 <= mark <= 0xCF and mark != 0xC8:
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if mark not in BASELINE or depth != 8 or n not in (1, 3) or not width or not height:
                return None
            parts = [_Part(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            if n == 1:
                parts[0].across = parts[0].down = 1
            most = (max(p.across for p in parts), max(p.down for p in parts))
            if any(not p.across or not p.down or most[0] % p.across or most[1] % p.down for p in parts):
                return None
            columns, rows = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
            for p in parts:
                p.blocks = np.zeros((rows * p.down, columns * p.across, 64), np.int32)
                sizes[p.key] = (-(-(-(-width * p.across // most[0])) // 8), -(-(-(-height * p.down // most[1])) // 8))
        elif mark == 0xDA:
            by_key, chosen = {p.key: p for p in parts}, []
            for k in range(body[0]):
                p = by_key[body[1 + 2 * k]]
                dc, ac = divmod(body[2 + 2 * k], 16)
                p.dc, p.ac = codes[0, dc], codes[1, ac]
                chosen.append(p)
            stretches, at = _stretches(data, at)
            _scan(chosen, stretches, restart, columns, rows, most, sizes, check)
    if not parts or parts[0].dc is None:
        raise Broken("there is no picture")
    planes = [_pixels(p, quant[p.quant], most)[:height, :width] for p in parts]
    if len(planes) == 1:
        out = np.stack(planes * 3, -1)
    elif transform:
        y, blue, red = planes[0], planes[1] - 128, planes[2] - 128
        out = np.stack([y + 1.402 * red, y - 0.344136 * blue - 0.714136 * red, y + 1.772 * blue], -1)
    else:
        out = np.stack(planes, -1)
    return np.clip(out, 0, 255)


def turned(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels as an EXIF orientation (1 to 8) says that they are to be seen."""
    if orientation in (5, 6, 7, 8):
        pixels = pixels.transpose(1, 0, 2)
    if orientation in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    if orientation in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return pixels
