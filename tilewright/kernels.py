"""NumPy helpers for binary pixels: small functions of bytes and arrays, used inside Arrow tasks."""

from __future__ import annotations

import struct
import zlib

import numpy as np

BMP_HEADER = 54
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Pixels of a file that is decoded whole.
MAX_PIXELS = 100_000_000


class FormatError(ValueError):
    """A file that cannot be read; ``code`` says why."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def bmp_header(head: bytes, max_side: int = 200_000) -> dict:
    """Width, height, bits, bottom_up, data offset and stride of an uncompressed 24- or 32-bit BMP."""
    if len(head) < BMP_HEADER or head[:2] != b"BM":
        raise FormatError("DECODE_ERROR", "not a BMP header")
    offset, dib, width, height, _, bits, compression = struct.unpack_from("<IIiiHHI", head, 10)
    if dib < 40:
        raise FormatError("DECODE_ERROR", "header too short")
    bottom_up, width, height = height > 0, abs(width), abs(height)
    if not (0 < width <= max_side and 0 < height <= max_side):
        raise FormatError("DECODE_ERROR", "dimensions out of range")
    if compression:
        raise FormatError("UNSUPPORTED_FORMAT", "compressed")
    if bits not in (24, 32):
        raise FormatError("UNSUPPORTED_FORMAT", f"{bits} bits a pixel")
    return {"width": width, "height": height, "bits": bits, "bottom_up": bottom_up, "offset": offset, "stride": (width * bits // 8 + 3) // 4 * 4}


def bmp_rows(raw: bytes, info: dict, rows: int, reverse: bool) -> np.ndarray:
    """RGBA pixels of ``rows`` stored rows, from bytes that begin with the first of them."""
    size = info["bits"] // 8
    need = info["stride"] * rows
    if len(raw) < need:
        raise FormatError("DECODE_ERROR", "pixels missing")
    lines = np.frombuffer(raw, dtype=np.uint8, count=need).reshape(rows, info["stride"])[:, : info["width"] * size].reshape(rows, info["width"], size)
    out = np.full((rows, info["width"], 4), 255, dtype=np.uint8)
    out[..., :3] = lines[..., 2::-1]
    if size == 4:
        out[..., 3] = lines[..., 3]
    return out[::-1] if reverse else out


def decode_bmp(content: bytes) -> np.ndarray:
    info = bmp_header(content[:BMP_HEADER])
    return bmp_rows(content[info["offset"] :], info, info["height"], info["bottom_up"])


def encode_bmp(pixels: np.ndarray, alpha: bool = True) -> bytes:
    """Top-down uncompressed BMP of RGBA pixels, 24 bits without alpha."""
    height, width, _ = pixels.shape
    size = 4 if alpha else 3
    stride = (width * size + 3) // 4 * 4
    lines = np.zeros((height, stride), dtype=np.uint8)
    body = lines[:, : width * size].reshape(height, width, size)
    body[..., :3] = pixels[..., 2::-1]
    if alpha:
        body[..., 3] = pixels[..., 3]
    data = lines.tobytes()
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", BMP_HEADER + len(data), 0, 0, BMP_HEADER, 40, width, -height, 1, size * 8, 0, len(data), 2835, 2835, 0, 0) + data


def encode_png(pixels: np.ndarray) -> bytes:
    """RGBA pixels as a PNG without filtering."""
    height, width, _ = pixels.shape
    lines = np.zeros((height, 1 + width * 4), dtype=np.uint8)
    lines[:, 1:] = pixels.reshape(height, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


#: Frequencies of an 8 x 8 block in order of their diagonals, alternately up and down.
_ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
#: Luma and colour differences of RGB.
_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])


def jpeg_steps(quality: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantisation steps of luma and colour (8 x 8) for a quality from 1 to 100: the finer, the lower the frequency."""
    u, v = np.mgrid[0:8, 0:8]
    scale = 50 / quality if quality < 50 else 2 - quality / 50
    steps = lambda base, slope: np.clip(np.round((base + slope * (u + v) ** 1.25) * scale), 1, 255).astype(int)
    return steps(10, 4.5), steps(14, 7.5)


def _code_lengths(counts: np.ndarray, limit: int = 16) -> dict[int, int]:
    """Lengths of the best prefix codes of at most ``limit`` bits, by merging packages of the cheapest; one code of the
    longest length stays unused, as no code may be all ones."""
    coins = sorted([(int(n), (s,)) for s, n in enumerate(counts) if n] + [(0, (-1,))])
    if len(coins) == 2:
        return {coins[1][1][0]: 1}
    level: list[tuple[int, tuple[int, ...]]] = []
    for _ in range(limit):
        level = sorted(coins + [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2])])
    used: dict[int, int] = {}
    for _, symbols in level[: 2 * len(coins) - 2]:
        for symbol in symbols:
            used[symbol] = used.get(symbol, 0) + 1
    used.pop(-1)
    return used


def _jpeg_table(counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A table's description, and code and length of each symbol."""
    lengths = _code_lengths(counts)
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, sizes, code, size = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64), 0, 0
    for symbol in order:
        code <<= lengths[symbol] - size
        size = lengths[symbol]
        codes[symbol], sizes[symbol] = code, size
        code += 1
    return bytes(sum(lengths[s] == n for s in order) for n in range(1, 17)) + bytes(order), codes, sizes


def _jpeg_symbols(blocks: np.ndarray) -> tuple[np.ndarray, ...]:
    """(block, place, symbol, bits, number of bits) of a component's blocks (n x 64, in zigzag order); place 0 is the mean,
    coded as the difference to the block before."""
    n = len(blocks)
    values = blocks.copy()
    values[1:, 0] -= blocks[:-1, 0]
    b, k = np.nonzero(values[:, 1:])
    k = k + 1
    before = np.zeros(len(b), dtype=np.int64)
    before[1:] = np.where(b[1:] == b[:-1], k[:-1], 0)
    gap = k - before - 1
    long = gap >> 4  # sixteen zeros each have a symbol of their own
    zeros_b, zeros_k = np.repeat(b, long), np.repeat(k, long)
    last = np.zeros(n, dtype=np.int64)
    np.maximum.at(last, b, k)
    open_ = np.flatnonzero(last < 63)
    value = np.concatenate([values[:, 0], values[b, k]])
    size = np.frexp(np.abs(value).astype(float))[1]
    bits = np.where(value < 0, value + (1 << size) - 1, value)
    none = lambda m: np.zeros(m, dtype=np.int64)
    block = np.concatenate([np.arange(n), b, zeros_b, open_])
    place = np.concatenate([none(n), 2 * k + 1, 2 * zeros_k, none(len(open_)) + 128])
    symbol = np.concatenate([none(n), (gap & 15) << 4, none(len(zeros_b)) + 0xF0, none(len(open_))])
    symbol[: len(value)] |= size
    more = none(len(zeros_b) + len(open_))
    return block, place, symbol, np.concatenate([bits, more]), np.concatenate([size, more])


def encode_jpeg(pixels: np.ndarray, quality: int = 85, background: int = 255) -> bytes:
    """Baseline JPEG of RGBA pixels laid on a grey background: block cosine transform, quantisation, and prefix codes made
    for the image's own symbols."""
    height, width, _ = pixels.shape
    if not 1 <= quality <= 100 or not (0 < width < 65536 and 0 < height < 65536):
        raise FormatError("ENCODE_ERROR", "quality or sides")
    alpha = pixels[..., 3:].astype(float) / 255
    rgb = pixels[..., :3] * alpha + background * (1 - alpha)
    rgb = np.pad(rgb, ((0, -height % 8), (0, -width % 8), (0, 0)), mode="edge")
    planes = np.einsum("kc,yxc->kyx", _YCC, rgb)
    planes[0] -= 128
    steps = jpeg_steps(quality)
    down, across = rgb.shape[0] // 8, rgb.shape[1] // 8
    parts = []
    for c in range(3):
        blocks = planes[c].reshape(down, 8, across, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        levels = np.round(_COSINES @ blocks @ _COSINES.T / steps[min(c, 1)]).astype(np.int64)
        parts.append((c, *_jpeg_symbols(levels.reshape(-1, 64)[:, _ZIGZAG])))
    component = np.concatenate([np.full(len(p[1]), p[0]) for p in parts])
    block, place, symbol, bits, size = (np.concatenate([p[k] for p in parts]) for k in range(1, 6))
    order = np.lexsort((place, component, block))
    component, place, symbol, bits, size = (x[order] for x in (component, place, symbol, bits, size))
    kind = 2 * (component > 0) + (place > 0)  # luma means, luma rest, colour means, colour rest
    tables = [_jpeg_table(np.bincount(symbol[kind == k], minlength=256)) for k in range(4)]
    code, code_size = (np.stack([t[i] for t in tables])[kind, symbol] for i in (1, 2))
    value, total = code << size | bits, code_size + size
    within = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
    stream = np.repeat(value, total) >> (np.repeat(total, total) - 1 - within) & 1
    stream = np.append(stream, np.ones(-len(stream) % 8, dtype=np.int64))
    data = np.packbits(stream.astype(np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, 2 + len(body)) + body
    frame = struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([c + 1, 0x11, min(c, 1)]) for c in range(3))
    scan = b"\x03" + b"".join(bytes([c + 1, 0x11 * min(c, 1)]) for c in range(3)) + b"\x00\x3f\x00"
    head = segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    quant = b"".join(segment(0xDB, bytes([i]) + bytes(s.ravel()[_ZIGZAG].tolist())) for i, s in enumerate(steps))
    huffman = b"".join(segment(0xC4, bytes([(k % 2) << 4 | k // 2]) + t[0]) for k, t in enumerate(tables))
    return b"\xff\xd8" + head + quant + segment(0xC0, frame) + huffman + segment(0xDA, scan) + data + b"\xff\xd9"


def encode_gif(pixels: np.ndarray) -> bytes:
    """A GIF of at most 256 colours, without alpha.  Codes stay at their first width: the table is cleared before it
    would need a wider one, so the file is larger than it could be, and exact."""
    height, width, _ = pixels.shape
    colours, which = np.unique(pixels[..., :3].reshape(-1, 3), axis=0, return_inverse=True)
    if len(colours) > 256:
        raise FormatError("ENCODE_ERROR", "more than 256 colours")
    bits = max(2, int(len(colours) - 1).bit_length())
    clear, room = 1 << bits, (1 << bits) - 2
    blocks = [which.ravel()[a : a + room] for a in range(0, width * height, room)]
    codes = np.concatenate([np.concatenate([[clear], b]) for b in blocks] + [[clear + 1]]).astype(np.uint16)
    raw = np.packbits((codes[:, None] >> np.arange(bits + 1)) & 1, bitorder="little").tobytes()
    palette = np.zeros((1 << bits, 3), dtype=np.uint8)
    palette[: len(colours)] = colours
    data = b"".join(bytes([len(raw[a : a + 255])]) + raw[a : a + 255] for a in range(0, len(raw), 255))
    screen = struct.pack("<6sHHBBB", b"GIF89a", width, height, 0x80 | bits - 1 | (bits - 1) << 4, 0, 0)
    return screen + palette.tobytes() + struct.pack("<BHHHHBB", 0x2C, 0, 0, width, height, 0, bits) + data + b"\0;"


def _png_chunks(content: bytes) -> dict[bytes, bytes]:
    """Bodies of the chunks by kind, those of a kind joined; a chunk that is cut short ends the list."""
    at, found = 8, {}
    while at + 12 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        if at + 12 + size > len(content):
            break
        found.setdefault(kind, []).append(content[at + 8 : at + 8 + size])
        at += 12 + size
    return {kind: b"".join(bodies) for kind, bodies in found.items()}


def decode_png(content: bytes, max_pixels: int = MAX_PIXELS) -> np.ndarray:
    """8-bit RGB or RGBA PNG without interlacing, any filters.  Broken files, and those of no or too many
    pixels, are reported; no more is inflated than the header announces."""
    if content[:8] != PNG_SIGNATURE:
        raise FormatError("DECODE_ERROR", "not a PNG")
    chunks = _png_chunks(content)
    if len(chunks.get(b"IHDR", b"")) != 13:
        raise FormatError("DECODE_ERROR", "no header")
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    if not width or not height:
        raise FormatError("DECODE_ERROR", "no pixels")
    if width * height > max_pixels:
        raise FormatError("IMAGE_TOO_LARGE", f"{width}x{height}")
    if depth != 8 or kind not in (2, 6) or interlaced:
        raise FormatError("UNSUPPORTED_FORMAT", "only plain 8-bit RGB and RGBA")
    n = 3 if kind == 2 else 4
    size = height * (1 + width * n)
    try:
        raw = zlib.decompressobj().decompress(chunks.get(b"IDAT", b""), size)
    except zlib.error as e:
        raise FormatError("DECODE_ERROR", str(e)) from e
    if len(raw) != size:
        raise FormatError("DECODE_ERROR", "pixels missing")
    lines = np.frombuffer(raw, dtype=np.uint8).reshape(height, 1 + width * n)
    if lines[:, 0].max() > 4:
        raise FormatError("DECODE_ERROR", "unknown filter")
    pixels = np.full((height, width, 4), 255, dtype=np.uint8)
    pixels[..., :n] = _unfilter(lines[:, 0], lines[:, 1:].reshape(height, width, n))
    return pixels


def _unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undo PNG's line filters.  Without the two that mix neighbours, line by line; with them along diagonals,
    whose pixels depend on earlier diagonals only."""
    height, width, n = lines.shape
    if kinds.max() < 3:
        out, above = np.empty_like(lines), np.zeros((width, n), dtype=np.uint8)
        for y, kind in enumerate(kinds.tolist()):
            line = lines[y]
            above = out[y] = np.cumsum(line, axis=0, dtype=np.uint8) if kind == 1 else line + above if kind == 2 else line
        return out
    out = np.zeros(((height + 1) * (width + 1), n), dtype=np.int16)  # with a row above and a column at the left
    flat = lines.reshape(-1, n)
    for t in range(width + height - 1):
        y0, y1 = max(0, t - width + 1), min(height, t + 1)
        count = y1 - y0
        at = (y0 + 1) * (width + 1) + t - y0 + 1  # one row down and one column left is ``width`` further
        pick = lambda a: out[a : a + (count - 1) * width + 1 : width]  # noqa: B023, E731
        left, up, corner = pick(at - 1), pick(at - width - 1), pick(at - width - 2)
        base = left + up - corner
        a, b, c = np.abs(base - left), np.abs(base - up), np.abs(base - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        kind = kinds[y0:y1, None]
        guess = np.choose(kind, [np.zeros_like(left), left, up, (left + up) >> 1, paeth])
        source = flat[y0 * width + t - y0 :: width - 1][:count] if width > 1 else flat[t : t + 1]
        pick(at)[:] = (source + guess) & 255
    return out.reshape(height + 1, width + 1, n)[1:, 1:].astype(np.uint8)


def decode(content: bytes) -> np.ndarray:
    """RGBA pixels of a BMP or PNG file; other formats are reported, not decoded."""
    if content[:2] == b"BM":
        return decode_bmp(content)
    if content[:8] == PNG_SIGNATURE:
        return decode_png(content)
    raise FormatError("UNSUPPORTED_FORMAT" if content else "DECODE_ERROR", "no decoder for these bytes")


def known_format(content: bytes) -> bool:
    """Whether the bytes begin like a format that is decoded here or by Spark's image source (or are none)."""
    return not content or content.startswith((b"BM", PNG_SIGNATURE[:4], b"\xff\xd8", b"GIF8"))


def halve(pixels: np.ndarray, has_alpha: bool) -> np.ndarray:
    """2x2 means over the pixels that exist, in whole numbers, with premultiplied alpha."""
    height, width, _ = pixels.shape
    wide = np.zeros(((height + 1) // 2 * 2, (width + 1) // 2 * 2, 4), dtype=np.int64)
    wide[:height, :width] = pixels
    count = np.zeros(wide.shape[:2], dtype=np.int64)
    count[:height, :width] = 1
    if has_alpha:
        wide[..., :3] = wide[..., :3] * wide[..., 3:] // 255
    fold = lambda v: v[0::2, 0::2] + v[1::2, 0::2] + v[0::2, 1::2] + v[1::2, 1::2]
    n = fold(count)[..., None]
    mean = (fold(wide) + n // 2) // n
    if has_alpha:
        alpha = mean[..., 3:]
        mean[..., :3] = np.where(alpha == 0, 0, np.minimum(mean[..., :3] * 255 // np.maximum(alpha, 1), 255))
    else:
        mean[..., 3] = 255
    return mean.astype(np.uint8)


def fit(width: int, height: int, most: int) -> tuple[int, int]:
    if width <= most and height <= most:
        return width, height
    return (most, max(height * most // width, 1)) if width >= height else (max(width * most // height, 1), most)


def resize_area(pixels: np.ndarray, most: int) -> np.ndarray:
    """Averaging reduction into a box: a pixel counts for the cell that holds its centre."""
    height, width, _ = pixels.shape
    tw, th = fit(width, height, most)
    xs, ys = (2 * np.arange(width) + 1) * tw // (2 * width), (2 * np.arange(height) + 1) * th // (2 * height)
    rows = np.add.reduceat(pixels.astype(np.int64), np.searchsorted(ys, np.arange(th)), axis=0)
    sums = np.add.reduceat(rows, np.searchsorted(xs, np.arange(tw)), axis=1)
    n = np.outer(np.bincount(ys, minlength=th), np.bincount(xs, minlength=tw))[..., None]
    return ((sums + n // 2) // n).astype(np.uint8)


def resize_nearest(pixels: np.ndarray, most: int) -> np.ndarray:
    height, width, _ = pixels.shape
    tw, th = fit(width, height, most)
    return pixels[np.arange(th) * height // th][:, np.arange(tw) * width // tw]


def oriented(pixels: np.ndarray, orientation: int) -> np.ndarray:
    if orientation in (5, 6, 7, 8):
        pixels = pixels.transpose(1, 0, 2)
    if orientation in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    if orientation in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return np.ascontiguousarray(pixels)


def _jpeg_segments(content: bytes) -> list[tuple[int, bytes]]:
    """Markers and bodies before the first scan."""
    at, found = 2, []
    while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        size = struct.unpack_from(">H", content, at + 2)[0]
        if size < 2:
            break
        found.append((content[at + 1], content[at + 4 : at + 2 + size]))
        at += 2 + size
    return found


def _tiff_entry(tiff: bytes, tag: int) -> bytes | int | None:
    """Value of a tag in the first directory: a short as a number, bytes as they are; None where it is absent or broken."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    try:
        first = struct.unpack_from(order + "I", tiff, 4)[0]
        for k in range(struct.unpack_from(order + "H", tiff, first)[0]):
            found, kind, count, value = struct.unpack_from(order + "HHI4s", tiff, first + 2 + 12 * k)
            if found == tag:
                if kind == 3:
                    return struct.unpack_from(order + "H", value)[0]
                at = struct.unpack_from(order + "I", value)[0]
                return tiff[at : at + count] if count > 4 else value[:count]
    except (struct.error, TypeError):
        pass
    return None


def _tiff_of(content: bytes) -> bytes:
    """The TIFF structure that a JPEG, PNG or TIFF file holds its facts in; empty where there is none."""
    if content[:2] == b"\xff\xd8":
        return next((body[6:] for marker, body in _jpeg_segments(content) if marker == 0xE1 and body[:6] == b"Exif\0\0"), b"")
    if content[:8] == PNG_SIGNATURE:
        return _png_chunks(content).get(b"eXIf", b"")
    return content if content[:4] in (b"II*\0", b"MM\0*") else b""


def exif_orientation(content: bytes) -> int:
    """Orientation 1 to 8 of a JPEG, PNG or TIFF file; 1 where there is none or it is broken."""
    value = _tiff_entry(_tiff_of(content), 0x0112)
    return value if isinstance(value, int) and 1 <= value <= 8 else 1


def icc_profile(content: bytes) -> bytes | None:
    """The colour profile of a JPEG, PNG or TIFF file."""
    if content[:2] == b"\xff\xd8":
        parts = sorted((body[12], body[14:]) for marker, body in _jpeg_segments(content) if marker == 0xE2 and body[:12] == b"ICC_PROFILE\0" and len(body) > 14)
        return b"".join(p for _, p in parts) or None
    if content[:8] == PNG_SIGNATURE:
        _, _, body = _png_chunks(content).get(b"iCCP", b"").partition(b"\0")
        try:
            return zlib.decompressobj().decompress(body[1:], 1 << 24) or None
        except zlib.error:
            return None
    value = _tiff_entry(_tiff_of(content), 34675)
    return value if isinstance(value, bytes) else None


#: XYZ (D50) to linear sRGB.
XYZ_TO_SRGB = np.array([[3.1338561, -1.6168667, -0.4906146], [-0.9787684, 1.9161415, 0.0334540], [0.0719453, -0.2289914, 1.4052427]])


def _curve(body: bytes, values: np.ndarray) -> np.ndarray:
    """Apply an ICC tone curve (curv or para) to values from 0 to 1."""
    kind = body[:4]
    if kind == b"curv":
        n = struct.unpack_from(">I", body, 8)[0]
        if n == 0:
            return values
        table = np.frombuffer(body, dtype=">u2", count=n, offset=12).astype(float)
        return values ** (table[0] / 256) if n == 1 else np.interp(values, np.linspace(0, 1, n), table / 65535)
    if kind == b"para":
        form = struct.unpack_from(">H", body, 8)[0]
        count = (1, 3, 4, 5, 7)[form]
        g, a, b, c, d, e, f = ([x / 65536 for x in struct.unpack_from(f">{count}i", body, 12)] + [0.0] * 7)[:7]
        if form == 0:
            return values**g
        power = np.maximum(a * values + b, 0) ** g
        if form == 1:
            return np.where(values >= -b / a, power, 0)
        if form == 2:
            return np.where(values >= -b / a, power + c, c)
        return np.where(values >= d, power + (e if form == 4 else 0), c * values + (f if form == 4 else 0))
    raise FormatError("UNSUPPORTED_FORMAT", "tone curve")


def icc_to_srgb(pixels: np.ndarray, profile: bytes | None) -> tuple[np.ndarray, bool]:
    """Pixels in sRGB and whether they were converted.  RGB matrix profiles only; without a profile, or with
    any other, pixels stay as they are.  Alpha is never touched."""
    try:
        if not profile or profile[36:40] != b"acsp" or profile[16:20] != b"RGB ":
            return pixels, False
        tags = {}
        for k in range(struct.unpack_from(">I", profile, 128)[0]):
            name, offset, size = struct.unpack_from(">4sII", profile, 132 + 12 * k)
            tags[name] = profile[offset : offset + size]
        matrix = np.array([[x / 65536 for x in struct.unpack_from(">3i", tags[c + b"XYZ"], 8)] for c in (b"r", b"g", b"b")]).T
        linear = np.stack([_curve(tags[c + b"TRC"], pixels[..., i] / 255.0) for i, c in enumerate((b"r", b"g", b"b"))], axis=-1)
    except (KeyError, struct.error, FormatError, IndexError, ValueError):
        return pixels, False
    rgb = np.clip(linear @ (XYZ_TO_SRGB @ matrix).T, 0, 1)
    encoded = np.where(rgb <= 0.0031308, 12.92 * rgb, 1.055 * rgb ** (1 / 2.4) - 0.055)
    out = pixels.copy()
    out[..., :3] = np.round(encoded * 255).astype(np.uint8)
    return out, True
