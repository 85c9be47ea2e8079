"""Dimensions of image files from their headers, by ranged reads of a few KB: one walker for each container."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from struct import error as StructError
from struct import unpack

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import naming as N
from ..operators import catalog
from ..policy import DEFAULT, RAW, Policy
from .images import bmp_info, opened

#: Bytes of the first read and of the ones that follow; steps (markers, chunks, boxes, directories) that a walk may take.
FIRST, NEXT, STEPS = 2048, 512, 4096

Size = tuple[int, int]


class HeaderError(ValueError):
    """The header is cut short or contradicts itself."""


class Ranged:
    """Reads of a file at any place, counted; what was read last is kept."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int) -> None:
        self.read_at, self.size, self.read = read_at, size, 0
        self.base, self.held = 0, b""

    def at(self, offset: int, n: int) -> bytes:
        if offset < 0 or offset + n > self.size:
            raise HeaderError("beyond the end")
        if not self.base <= offset or offset + n > self.base + len(self.held):
            want = min(max(n, NEXT if self.read else FIRST), self.size - offset)
            self.base, self.held = offset, self.read_at(offset, want)
            self.read += len(self.held)
        got = self.held[offset - self.base : offset - self.base + n]
        if len(got) < n:
            raise HeaderError("short read")
        return got

    def numbers(self, layout: str, offset: int, n: int) -> tuple:
        return unpack(layout, self.at(offset, n))


def _png(f: Ranged) -> Size:
    length, kind, width, height = f.numbers(">I4sII", 8, 16)
    if kind != b"IHDR" or length != 13:
        raise HeaderError("no IHDR")
    return width, height


def _gif(f: Ranged) -> Size:
    return f.numbers("<HH", 6, 4)


def _bmp(f: Ranged) -> Size:
    if f.numbers("<I", 14, 4)[0] == 12:
        return f.numbers("<HH", 18, 4)
    width, height = f.numbers("<ii", 18, 8)
    return abs(width), abs(height)


def _jpeg(f: Ranged) -> Size:
    """Segments are stepped over until the one that begins a frame."""
    at = 2
    for _ in range(STEPS):
        lead, marker = f.at(at, 2)
        if lead != 0xFF:
            raise HeaderError("no marker")
        if marker == 0xFF:  # filling
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:  # markers that stand alone
            at += 2
        elif marker in (0xD9, 0xDA):
            raise HeaderError("no frame")
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = f.numbers(">HH", at + 5, 4)
            return width, height
        else:
            length = f.numbers(">H", at + 2, 2)[0]
            if length < 2:
                raise HeaderError("length of a segment")
            at += 2 + length
    raise HeaderError("too many segments")


def _webp(f: Ranged) -> Size:
    kind = f.at(12, 4)
    if kind == b"VP8X":
        flags_and_sides = f.at(20, 10)
        return 1 + int.from_bytes(flags_and_sides[4:7], "little"), 1 + int.from_bytes(flags_and_sides[7:10], "little")
    if kind == b"VP8L":
        mark, bits = f.numbers("<BI", 20, 5)
        if mark != 0x2F:
            raise HeaderError("no lossless mark")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 ":
        tag, code, width, height = f.numbers("<3s3sHH", 20, 10)
        if tag[0] & 1 or code != b"\x9d\x01\x2a":
            raise HeaderError("no key frame")
        return width & 0x3FFF, height & 0x3FFF
    raise HeaderError("unknown chunk")


#: Tags of width, height and further directories; bytes of a value of each type.
_WIDTH, _HEIGHT, _SUB = 256, 257, 330
_VALUE_BYTES = {1: 1, 3: 2, 4: 4, 13: 4, 16: 8, 18: 8}


def _directories(f: Ranged) -> Iterator[Size]:
    """The sides in each directory of a TIFF, in file order, those of further directories included; 64-bit ones, too."""
    order = "<" if f.at(0, 2) == b"II" else ">"
    wide = f.numbers(order + "H", 2, 2)[0] == 43
    word, entry, count = ("Q", 20, 8) if wide else ("I", 12, 2)
    width = 8 if wide else 4
    queue, seen = [f.numbers(order + word, 8 if wide else 4, width)[0]], set()
    while queue and len(seen) < STEPS:
        at = queue.pop(0)
        if not at or at in seen:
            continue
        seen.add(at)
        n = f.numbers(order + ("Q" if wide else "H"), at, count)[0]
        if n > STEPS:
            raise HeaderError("too many entries")
        sides: dict[int, int] = {}
        for k in range(n):
            tag, kind, values = f.numbers(order + "HH" + word, at + count + k * entry, 4 + width)
            size, where = _VALUE_BYTES.get(kind, 0), at + count + k * entry + 4 + width
            if tag in (_WIDTH, _HEIGHT, _SUB) and size:
                place = where if size * values <= width else f.numbers(order + word, where, width)[0]
                read = [int.from_bytes(f.at(place + i * size, size), "little" if order == "<" else "big") for i in range(min(values, 64))]
                if tag == _SUB:
                    queue += read
                elif read:
                    sides[tag] = read[0]
        if _WIDTH in sides and _HEIGHT in sides:
            yield sides[_WIDTH], sides[_HEIGHT]
        queue += f.numbers(order + word, at + count + n * entry, width)


def _tiff(f: Ranged) -> Size:
    return next(_directories(f))


def _raw(f: Ranged) -> Size:
    """Camera files are TIFFs whose first directory is often a small preview: the largest directory counts."""
    return max(_directories(f), key=lambda s: s[0] * s[1])


def _boxes(f: Ranged, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the boxes between two places; nothing of their content is read."""
    for _ in range(STEPS):
        if at + 8 > end:
            return
        size, kind = f.numbers(">I4s", at, 8)
        head = 8
        if size == 1:
            size, head = f.numbers(">Q", at + 8, 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise HeaderError("size of a box")
        yield kind, at + head, at + size
        at += size


def _inside(f: Ranged, begin: int, end: int, kind: bytes) -> tuple[int, int]:
    for found, a, b in _boxes(f, begin, end):
        if found == kind:
            return a, b
    raise HeaderError(f"no {kind!r} box")


def _isobmff(f: Ranged) -> Size:
    """The ``ispe`` property of the primary item: where that is named, through the item's property list."""
    begin, end = _inside(f, 0, f.size, b"meta")
    parts = {kind: (a, b) for kind, a, b in _boxes(f, begin + 4, end)}  # after version and flags
    if b"iprp" not in parts:
        raise HeaderError("no properties")
    properties = {kind: (a, b) for kind, a, b in _boxes(f, *parts[b"iprp"])}
    sizes: dict[int, Size] = {}
    for number, (kind, a, _) in enumerate(_boxes(f, *properties.get(b"ipco", (0, 0))), 1):
        if kind == b"ispe":
            sizes[number] = f.numbers(">II", a + 4, 8)
    if not sizes:
        raise HeaderError("no ispe")
    if b"pitm" in parts and b"ipma" in properties:
        at, _ = parts[b"pitm"]
        primary = f.numbers(">I", at + 4, 4)[0] if f.at(at, 1)[0] else f.numbers(">H", at + 4, 2)[0]
        at, _ = properties[b"ipma"]
        version, long = f.at(at, 1)[0], f.at(at + 3, 1)[0] & 1
        items, at = f.numbers(">I", at + 4, 4)[0], at + 8
        for _ in range(min(items, STEPS)):
            item, at = (f.numbers(">I", at, 4)[0], at + 4) if version else (f.numbers(">H", at, 2)[0], at + 2)
            n, at = f.at(at, 1)[0], at + 1
            for k in range(n):
                number = f.numbers(">H", at + 2 * k, 2)[0] & 0x7FFF if long else f.at(at + k, 1)[0] & 0x7F
                if item == primary and number in sizes:
                    return sizes[number]
            at += n * (2 if long else 1)
    return max(sizes.values(), key=lambda s: s[0] * s[1])


#: JPEG XL's aspect ratios, and the bits and first value of its four widths of a side.
_RATIOS = ((1, 1), (12, 10), (4, 3), (3, 2), (16, 9), (5, 4), (2, 1))
_SIDE_BITS = (9, 13, 18, 30)


def _jxl(f: Ranged) -> Size:
    at = 0
    if f.at(0, 2) != b"\xff\x0a":
        for kind, a, _ in _boxes(f, 0, f.size):
            if kind in (b"jxlc", b"jxlp"):
                at = a + (4 if kind == b"jxlp" else 0)
                break
        if f.at(at, 2) != b"\xff\x0a":
            raise HeaderError("no codestream")
    raw = f.at(at + 2, min(10, f.size - at - 2))
    bits, left = int.from_bytes(raw, "little"), 8 * len(raw)

    def take(n: int) -> int:
        nonlocal bits, left
        value, bits, left = bits & ((1 << n) - 1), bits >> n, left - n
        if left < 0:
            raise HeaderError("cut short")
        return value

    small = take(1)
    side = lambda: 8 * (1 + take(5)) if small else 1 + take(_SIDE_BITS[take(2)])
    height, ratio = side(), take(3)
    if not ratio:
        return side(), height
    across, down = _RATIOS[ratio - 1]
    return height * across // down, height


def guess_format(head: bytes) -> str | None:
    """The container that the first bytes tell, whatever the file is called."""
    if head[:2] == b"\xff\xd8":
        return "jpeg"
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        return "png"
    if head[:6] in (b"GIF87a", b"GIF89a"):
        return "gif"
    if head[:2] == b"BM":
        return "bmp"
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return "webp"
    if head[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        return "tiff"
    if head[:2] == b"\xff\x0a" or head[4:8] == b"JXL ":
        return "jxl"
    if head[4:8] == b"ftyp":
        return "heif"
    return None


WALKERS: dict[str, Callable[[Ranged], Size]] = {"jpeg": _jpeg, "png": _png, "gif": _gif, "bmp": _bmp, "webp": _webp, "tiff": _tiff, "jxl": _jxl, "heif": _isobmff}
HEAD_BYTES = 64


def walk(read_at: Callable[[int, int], bytes], size: int, raw: bool = False) -> tuple[str | None, int | None, int | None, int, bytes, str | None]:
    """(format, width, height, bytes read, first bytes, error) of a file."""
    f = Ranged(read_at, size)
    head = f.at(0, min(size, HEAD_BYTES)) if size else b""
    kind = guess_format(head)
    if kind is None:
        return None, None, None, f.read, head, "UNSUPPORTED_FORMAT"
    try:
        width, height = (_raw if raw and kind == "tiff" else WALKERS[kind])(f)
        if not (0 < width < 1 << 31 and 0 < height < 1 << 31):
            raise HeaderError("sides")
        return kind, width, height, f.read, head, None
    except (HeaderError, StructError, StopIteration, ValueError, IndexError):
        return kind, None, None, f.read, head, "DECODE_ERROR"


def probe_headers(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, format, width, height, bytes_read, head (first bytes), error of each file of ``files`` (path); columns to ``keep`` go along.

    Paths are local ones or URIs that Arrow's file systems know.  The format is what the bytes say, not the name; of
    camera files (by name) the largest directory counts.  Sides are those of the file, before any rotation.  A header
    that is cut short or broken is DECODE_ERROR, bytes of no known format UNSUPPORTED_FORMAT, a file that cannot be
    opened IO_ERROR.  A task reads a few KB of each of its files, wherever in the file they lie.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                try:
                    with opened(path) as f:
                        read_at = lambda at, n: f.read_at(n, at)  # noqa: B023, E731
                        rows.append((path, *walk(read_at, f.size(), path.rpartition(".")[2].lower() in RAW)))
                except (OSError, pa.ArrowInvalid, AttributeError, TypeError):
                    rows.append((path, None, None, None, 0, None, "IO_ERROR"))
            told = [pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], type=t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*told, *(batch.column(c) for c in keep)], names=[*names, *keep])

    names = ["path", "format", "width", "height", "bytes_read", "head", "error"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
    kept = [f"{c} {files.schema[c].dataType.simpleString()}" for c in keep]
    return files.select("path", *keep).mapInArrow(run, ", ".join(["path string, format string, width int, height int, bytes_read long, head binary, error string", *kept]))


def probe_files(files: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Probe rows (``catalog.probe_images``) of listed files (path, name, size): dimensions come from the headers.

    Formats that the system decoder reads (by name, or HEIF and AVIF by their brand) take the header's sides as the
    decoder's; bitmaps also have to pass ``bmp_info``.
    """
    ext = N.extension(F.col("name"))
    told = probe_headers(files, ("name", "size"))
    facts = bmp_info(told.withColumnRenamed("error", "failed").withColumn("header", F.col("head")))
    heif = N.sniff_heif(F.col("head"))
    system = catalog.format_family(ext, heif)["system_decoded"] | (F.col("format") == "heif")
    side = lambda c: F.when((ext != "bmp") | F.col("bmp").isNotNull(), F.col(c))
    rows = facts.select(
        "path", ext.alias("ext"), "size", heif.alias("heif"), *[F.when(~F.coalesce(system, F.lit(False)), side(c)).alias(c) for c in ("width", "height")], *[F.when(system, F.col(c)).alias(f"source_{c}") for c in ("width", "height")]
    )
    return catalog.probe_images(rows, policy)
