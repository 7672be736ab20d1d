"""Images: declared dimensions, EXIF metadata, and recognition by a pluggable engine."""

from __future__ import annotations

import json
import re
import struct
import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import ClassVar, Protocol

import numpy as np
import regex

from docloom.functions import limits
from docloom.functions.limits import ConversionError, Options
from docloom.kernels.base import Context, Result, body_text, table
from docloom.kernels.jpeg import decode_jpeg, turned

# --- fixed values: EXIF tag names -----------------------------------------------------------------------------------------
IMAGE_TAGS = {
    256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression", 262: "PhotometricInterpretation", 270: "ImageDescription", 271: "Make", 272: "Model",
    273: "StripOffsets", 274: "Orientation", 277: "SamplesPerPixel", 278: "RowsPerStrip", 279: "StripByteCounts", 282: "XResolution", 283: "YResolution", 284: "PlanarConfiguration",
    296: "ResolutionUnit", 301: "TransferFunction", 305: "Software", 306: "DateTime", 315: "Artist", 316: "HostComputer", 318: "WhitePoint", 319: "PrimaryChromaticities",
    513: "JPEGInterchangeFormat", 514: "JPEGInterchangeFormatLength", 529: "YCbCrCoefficients", 530: "YCbCrSubSampling", 531: "YCbCrPositioning", 532: "ReferenceBlackWhite",
    18246: "Rating", 33432: "Copyright", 34665: "ExifTag", 34853: "GPSTag", 40091: "XPTitle", 40092: "XPComment", 40093: "XPAuthor", 40094: "XPKeywords", 40095: "XPSubject",
}
EXIF_TAGS = {
    33434: "ExposureTime", 33437: "FNumber", 34850: "ExposureProgram", 34852: "SpectralSensitivity", 34855: "ISOSpeedRatings", 34856: "OECF", 34864: "SensitivityType",
    34866: "RecommendedExposureIndex", 36864: "ExifVersion", 36867: "DateTimeOriginal", 36868: "DateTimeDigitized", 36880: "OffsetTime", 36881: "OffsetTimeOriginal",
    36882: "OffsetTimeDigitized", 37121: "ComponentsConfiguration", 37122: "CompressedBitsPerPixel", 37377: "ShutterSpeedValue", 37378: "ApertureValue", 37379: "BrightnessValue",
    37380: "ExposureBiasValue", 37381: "MaxApertureValue", 37382: "SubjectDistance", 37383: "MeteringMode", 37384: "LightSource", 37385: "Flash", 37386: "FocalLength",
    37396: "SubjectArea", 37500: "MakerNote", 37510: "UserComment", 37520: "SubSecTime", 37521: "SubSecTimeOriginal", 37522: "SubSecTimeDigitized", 40960: "FlashpixVersion",
    40961: "ColorSpace", 40962: "PixelXDimension", 40963: "PixelYDimension", 40964: "RelatedSoundFile", 40965: "InteroperabilityTag", 41486: "FocalPlaneXResolution",
    41487: "FocalPlaneYResolution", 41488: "FocalPlaneResolutionUnit", 41492: "SubjectLocation", 41493: "ExposureIndex", 41495: "SensingMethod", 41728: "FileSource",
    41729: "SceneType", 41730: "CFAPattern", 41985: "CustomRendered", 41986: "ExposureMode", 41987: "WhiteBalance", 41988: "DigitalZoomRatio", 41989: "FocalLengthIn35mmFilm",
    41990: "SceneCaptureType", 41991: "GainControl", 41992: "Contrast", 41993: "Saturation", 41994: "Sharpness", 41996: "SubjectDistanceRange", 42016: "ImageUniqueID",
    42032: "CameraOwnerName", 42033: "BodySerialNumber", 42034: "LensSpecification", 42035: "LensMake", 42036: "LensModel", 42037: "LensSerialNumber", 42240: "Gamma",
}
GPS_TAGS = dict(enumerate("GPSVersionID GPSLatitudeRef GPSLatitude GPSLongitudeRef GPSLongitude GPSAltitudeRef GPSAltitude GPSTimeStamp GPSSatellites GPSStatus GPSMeasureMode GPSDOP GPSSpeedRef GPSSpeed GPSTrackRef GPSTrack GPSImgDirectionRef GPSImgDirection GPSMapDatum GPSDestLatitudeRef GPSDestLatitude GPSDestLongitudeRef GPSDestLongitude GPSDestBearingRef GPSDestBearing GPSDestDistanceRef GPSDestDistance GPSProcessingMethod GPSAreaInformation GPSDateStamp GPSDifferential GPSHPositioningError".split()))
INTEROP_TAGS = {1: "InteroperabilityIndex"}
# --- end of fixed values ----------------------------------------------------------------------------------------------
GROUPS = {"0th": IMAGE_TAGS, "Exif": EXIF_TAGS, "GPS": GPS_TAGS, "Interop": INTEROP_TAGS, "1st": IMAGE_TAGS}
#: Frames of a JPEG that state the picture's size.
_FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
_KINDS = {1: "B", 2: "", 3: "H", 4: "I", 5: "II", 6: "b", 7: "", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}


def check_dimensions(width: int, height: int) -> tuple[int, int]:
    if width < 1 or height < 1:
        raise ConversionError("INVALID_IMAGE", "Invalid image dimensions.")
    if max(width, height) > limits.IMAGE_SIDE or width * height > limits.IMAGE_PIXELS:
        raise ConversionError("IMAGE_LIMIT", "Image exceeds 8,192 pixels per side or 16 million decoded pixels. Resize it and retry.")
    return width, height


def _segments(data: bytes):
    """(marker, body) of a JPEG's segments up to its picture."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            return
        marker, at = data[at], at + 1
        if marker in (0xD9, 0xDA):
            return
        if marker == 1 or 0xD0 <= marker <= 0xD7:
            continue
        if at + 2 > len(data):
            return
        size = struct.unpack_from(">H", data, at)[0]
        if size < 2 or at + size > len(data):
            return
        yield marker, data[at + 2 : at + size]
        at += size


def image_dimensions(data: bytes) -> tuple[int, int]:
    """The size that a PNG or JPEG declares, checked before anything is decoded."""
    if len(data) >= 24 and data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
        return check_dimensions(*struct.unpack_from(">II", data, 16))
    if data[:2] == b"\xff\xd8":
        for marker, body in _segments(data):
            if marker in _FRAMES and len(body) >= 6:
                height, width = struct.unpack_from(">HH", body, 1)
                return check_dimensions(width, height)
    raise ConversionError("INVALID_IMAGE", "Cannot read this JPG or PNG image. It may be corrupt or use an unsupported format.")


def decode_png(data: bytes) -> np.ndarray | None:
    """Pixels (height, width, 3) on a white ground; None for kinds that are not read here (interlaced ones, depths other than 8 and 16 bits)."""
    width, height = image_dimensions(data)
    depth, kind, _, _, interlaced = struct.unpack_from(">5B", data, 24)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if channels is None or depth not in (8, 16) or interlaced:
        return None
    at, body, palette, clear = 8, [], b"", b""
    while at + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if name == b"IDAT":
            body.append(part)
        elif name == b"PLTE":
            palette = part
        elif name == b"tRNS" and kind == 3:
            clear = part
        at += 12 + size
    step = channels * depth // 8
    row_size = width * step
    try:
        raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(body), height * (row_size + 1)), np.uint8).reshape(height, row_size + 1)
    except (zlib.error, ValueError) as error:
        raise ConversionError("INVALID_IMAGE", f"Cannot decode image: {error}") from None
    above = np.zeros(row_size, np.uint8)
    out = np.empty((height, row_size), np.uint8)
    for y in range(height):
        how, row = raw[y, 0], raw[y, 1:]
        if how == 1:
            row = np.add.accumulate(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif how == 2:
            row = row + above
        elif how in (3, 4):
            row = _unfilter(row, above, step, how == 4)
        out[y] = above = row
    pixels = out.reshape(height, width, channels, depth // 8)[..., 0].astype(float)
    if kind == 3:
        colors = np.frombuffer(palette.ljust(768, b"\0")[:768], np.uint8).reshape(256, 3).astype(float)
        alpha = np.frombuffer(clear.ljust(256, b"\xff")[:256], np.uint8).astype(float) / 255
        index = pixels[..., 0].astype(int)
        return colors[index] * alpha[index][..., None] + 255 * (1 - alpha[index][..., None])
    alpha = pixels[..., -1:] / 255 if kind in (4, 6) else np.ones((height, width, 1))
    color = np.repeat(pixels[..., :1], 3, axis=2) if kind in (0, 4) else pixels[..., :3]
    return color * alpha + 255 * (1 - alpha)


def _unfilter(row: np.ndarray, above: np.ndarray, step: int, paeth: bool) -> np.ndarray:
    """A row stored as differences to the mean, or to the nearest, of its neighbours on the left and above."""
    got, up = row.tolist(), above.tolist()
    for i in range(len(got)):
        a, b = (got[i - step] if i >= step else 0), up[i]
        if paeth:
            c = up[i - step] if i >= step else 0
            guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
        else:
            guess = (a + b) // 2
        got[i] = (got[i] + guess) & 255
    return np.array(got, np.uint8)


def bounded_size(width: int, height: int) -> tuple[int, int, float]:
    """(width, height, scale) within the limits for recognition."""
    scale = min(1.0, limits.RENDER_SIDE / max(width, height), (limits.RENDER_PIXELS / (width * height)) ** 0.5)
    return max(1, int(width * scale)), max(1, int(height * scale)), scale


def normalized(pixels: np.ndarray, rotation: int = 0) -> np.ndarray:
    """Pixels brought within the limits and turned clockwise."""
    height, width = pixels.shape[:2]
    w, h, scale = bounded_size(width, height)
    if scale < 1:
        pixels = pixels[(np.arange(h) * height // h)[:, None], (np.arange(w) * width // w)[None, :]]
    return np.rot90(pixels, -(rotation // 90) % 4)


def encode_png(pixels: np.ndarray) -> bytes:
    """Pixels (height, width, 3) as a PNG without filters."""
    body = np.clip(np.rint(pixels), 0, 255).astype(np.uint8)
    height, width = body.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), body.reshape(height, -1)], axis=1)
    parts = [(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)), (b"IDAT", zlib.compress(rows.tobytes(), 1)), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data)) for name, data in parts)


def is_blank(pixels: np.ndarray) -> bool:
    """Whether an image (height, width, channels) is of one brightness, looked at through 128 by 128 mean tiles."""
    grey = pixels[..., :3].astype(float).mean(-1)
    for axis in (0, 1):
        edges = np.linspace(0, grey.shape[axis], min(128, grey.shape[axis]) + 1).astype(int)
        grey = np.add.reduceat(grey, edges[:-1], axis=axis) / np.diff(edges).reshape((-1, 1) if axis == 0 else (1, -1))
    return bool(grey.max() - grey.min() < 4)


def logical_arabic(text: str) -> str:
    """Lines with Arabic script from the order in which they are seen to the one in which they are read; numbers and Latin runs stay."""

    def turn(line: str) -> str:
        if not regex.search(r"\p{Script=Arabic}", line):
            return line
        seen = "".join(reversed(regex.findall(r"\X", line)))
        return re.sub("[A-Za-z0-9٠-٩][A-Za-z0-9٠-٩ .,:%+/@_-]*", lambda m: m[0][::-1], seen)

    return "\n".join(map(turn, text.split("\n")))


@dataclass
class Recognized:
    text: str
    confidence: float | None = None
    warnings: list[str] = field(default_factory=list)


class Recognizer(Protocol):
    """An engine for recognition: an encoded image in, text and confidence out. None is part of this package.

    Pictures come as PNGs with alpha on white, within the pixel limits, upright by their metadata and turned as options.ocr_rotation says. Those of a kind
    that is not decoded here (progressive JPEGs and interlaced PNGs above all) come as they are stored, and the engine turns and bounds them.
    """

    def recognize(self, image: bytes, options: Options) -> Recognized: ...


class Session:
    """A recognizer that a process makes when it first needs one, and keeps; only the factory travels to workers."""

    _made: ClassVar[dict[str, Recognizer]] = {}

    def __init__(self, name: str, factory: Callable[[], Recognizer]):
        self.name, self.factory = name, factory

    def prepare(self) -> None:
        if self.name not in self._made:
            self._made[self.name] = self.factory()

    def recognize(self, image: bytes, options: Options) -> Recognized:
        self.prepare()
        return self._made[self.name].recognize(image, options)


def recognize(image: bytes, context: Context) -> Recognized:
    if context.recognizer is None:
        raise ConversionError("MODEL_UNAVAILABLE", "OCR models are not available offline. Provide a recognizer and retry.")
    if hasattr(context.recognizer, "prepare"):
        context.report("preparing models")
        began = time.monotonic()
        context.recognizer.prepare()
        took = time.monotonic() - began
        if took > limits.MODEL_SECONDS:
            raise ConversionError("MODEL_TIMEOUT", "OCR model preparation exceeded the time limit. Try again.")
        context.deadline += took  # what models take is not the file's time
    context.report("recognizing")
    found = context.recognizer.recognize(image, context.options)
    text = (found.text or "").strip()
    if context.options.ocr_language == "ar":
        text = logical_arabic(text)
    warnings = list(found.warnings)
    if not text and not warnings:
        warnings.append("No text was recognized. The image may be unreadable, rotated, or in a different language. Check language/rotation in Settings and retry.")
    if text and found.confidence is not None and found.confidence < 0.8:
        warnings.append(f"Low-confidence OCR (engine score {found.confidence:.2f}). This score is not a measured accuracy percentage; review the text.")
    return Recognized(text, found.confidence, warnings)


def _upright(data: bytes, context: Context) -> np.ndarray | None:
    """A JPEG's pixels, turned as its metadata says; None for what is not decoded here, which is then the engine's to judge."""
    try:
        pixels = decode_jpeg(data, context.check)
    except ConversionError as error:
        if error.code != "INVALID_IMAGE":
            raise
        pixels = None
    if pixels is None:
        return None
    try:
        orientation = read_exif(data).get("0th", {}).get(274, 1)
    except (ValueError, struct.error):
        orientation = 1  # what is wrong with its metadata does not hide a picture
    return turned(pixels, orientation if isinstance(orientation, int) else 1)


def convert_image(data: bytes, context: Context) -> Result:
    width, height = image_dimensions(data)
    warnings = ["Image was downscaled to the OCR pixel limit; small text may be missed."] if bounded_size(width, height)[2] < 1 else []
    pixels = decode_png(data) if data[:4] == b"\x89PNG" else _upright(data, context)
    if pixels is None:
        found = recognize(data, context)
    else:
        shown = normalized(pixels, context.options.ocr_rotation)
        if is_blank(shown):
            found = Recognized("", None, ["Blank image/page: no visible text to recognize."])  # without an engine
        else:
            found = recognize(encode_png(shown), context)
    return Result(f"{body_text(found.text)}\n" if found.text else "_No text recognized._\n", warnings + found.warnings)


class _Tiff:
    def __init__(self, data: bytes):
        self.data = data
        if data[:2] not in (b"II", b"MM"):
            raise ValueError("bad byte order in metadata")
        self.order = "<" if data[:2] == b"II" else ">"

    def unpack(self, kind: str, at: int) -> tuple:
        return struct.unpack_from(self.order + kind, self.data, at)

    def directory(self, at: int) -> tuple[dict[int, object], int]:
        """(values by tag, place of the next directory)."""
        found: dict[int, object] = {}
        count = self.unpack("H", at)[0]
        for k in range(count):
            place = at + 2 + 12 * k
            tag, kind, n = self.unpack("HHI", place)
            if kind not in _KINDS:
                continue
            code = _KINDS[kind]
            size = struct.calcsize("=" + code) * n if code else n
            start = place + 8 if size <= 4 else self.unpack("I", place + 8)[0]
            if start + size > len(self.data):
                raise ValueError("metadata points beyond its end")
            if not code:
                found[tag] = self.data[start : start + size].decode("latin-1")
            else:
                numbers = self.unpack(code * n, start)
                values = [list(numbers[i : i + 2]) for i in range(0, len(numbers), 2)] if len(code) == 2 else list(numbers)
                found[tag] = values[0] if n == 1 else values
        end = at + 2 + 12 * count
        return found, self.unpack("I", end)[0] if end + 4 <= len(self.data) else 0


def read_exif(data: bytes) -> dict[str, dict[int, object]]:
    """Values by group and tag; empty without metadata."""
    body = next((b[6:] for marker, b in _segments(data) if marker == 0xE1 and b[:6] == b"Exif\0\0"), None)
    if body is None:
        return {}
    tiff = _Tiff(body)
    out: dict[str, dict[int, object]] = {}
    out["0th"], after = tiff.directory(tiff.unpack("I", 4)[0])
    for group, owner, pointer in (("Exif", "0th", 34665), ("GPS", "0th", 34853), ("Interop", "Exif", 40965)):
        if isinstance(out.get(owner, {}).get(pointer), int):
            out[group], _ = tiff.directory(out[owner][pointer])
    if after:
        out["1st"], _ = tiff.directory(after)
    return out


def _value(value: object) -> str:
    if isinstance(value, str):
        return limits.left_units(value.rstrip("\0"), limits.EXIF_CHARS)
    if isinstance(value, list):
        return json.dumps(value[: limits.EXIF_ITEMS], separators=(",", ":")) + ("…" if len(value) > limits.EXIF_ITEMS else "")
    return str(value)


def convert_exif(data: bytes, context: Context) -> Result:
    if len(data) < 4 or data[:2] != b"\xff\xd8":
        raise ConversionError("INVALID_JPEG", "Expected a JPEG image.")
    try:
        found = read_exif(data)
    except (ValueError, struct.error) as error:
        raise ConversionError("INVALID_JPEG", f"Cannot read JPEG metadata: {error}") from None
    rows = [["Group", "Tag", "Value"]]
    for group, names in GROUPS.items():
        for tag, value in sorted(found.get(group, {}).items()):
            rows.append([group, names.get(tag, f"Tag {tag}"), _value(value)])
    if len(rows) > limits.EXIF_TAGS + 1:
        raise ConversionError("EXIF_LIMIT", "JPEG contains too many metadata tags.")
    return Result(f"# Image metadata\n\n{table(rows)}" if len(rows) > 1 else "_No EXIF metadata found._\n")
