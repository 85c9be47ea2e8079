"""Names, paths, formats and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import policy as P

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def base_name(path: Column) -> Column:
    """After the last slash of either kind."""
    return F.regexp_extract(path, r"(?s)([^/\\]*)$", 1)


def parent_dir(path: Column) -> Column:
    """Before the last slash of either kind; empty without one."""
    return F.regexp_extract(path, r"(?s)^(.*)[/\\][^/\\]*$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension; a name that only starts with a dot has none."""
    return ascii_lower(F.regexp_extract(base_name(path), r"(?s)^.+\.([^.]*)$", 1))


def is_supported(name: Column) -> Column:
    return F.coalesce(extension(name).isin(*P.SUPPORTED), F.lit(False))


def natural_key(name: Column) -> Column:
    """A string whose byte order is the natural order: digit runs by value, then by fewer leading zeros;
    other characters without ASCII case.  Ties go by length, then by the name itself."""
    runs = F.regexp_extract_all(ascii_lower(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def key(run: Column) -> Column:
        value = F.regexp_replace(run, "^0+(?=[0-9])", "")
        number = F.concat(F.lit("0"), F.lpad(F.char_length(value).cast("string"), 6, "0"), value, F.lpad(F.char_length(run).cast("string"), 6, "0"))
        return F.when(run.rlike("^[0-9]"), number).otherwise(run)

    return F.array_join(F.transform(runs, key), "")


def thumb_size(px: Column) -> Column:
    return F.when(px.isin(*P.THUMB_SIZES), px).otherwise(F.lit(P.DEFAULT_THUMB)).cast("int")


def little_endian(value: Column, n: int) -> Column:
    """The low ``n`` bytes of a non-negative integer, lowest first, as hexadecimal digits."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * n, "0")
    return F.concat(*[F.substring(digits, 2 * (n - i) - 1, 2) for i in range(n)])


def cache_key(path: Column, size: Column, modified_ms: Column, px: Column) -> Column:
    """Thumbnail key: the first 32 hexadecimal digits of a SHA-256 over path, size, time and edge."""
    colon = F.lit("3A")
    raw = F.concat(F.hex(F.encode(path, "UTF-8")), colon, little_endian(size, 8), colon, little_endian(modified_ms, 16), colon, little_endian(px, 4))
    return F.substring(F.sha2(F.unhex(raw), 256), 1, 32)


def pyramid_key(path: Column, size: Column, modified_ns: Column, tile_size: Column, version: Column) -> Column:
    raw = F.concat(F.hex(F.encode(path, "UTF-8")), F.lit("00"), little_endian(size, 8), little_endian(modified_ns, 16), little_endian(tile_size, 4), little_endian(version, 4))
    return F.sha2(F.unhex(raw), 256)


def decode_cache_key(path: Column, modified_ns: Column) -> Column:
    return F.struct(path.alias("path"), modified_ns.cast("long").alias("modified_ns"))


def sniff_heif(header: Column) -> Column:
    """Whether the first bytes are an ISO-BMFF header with a HEIF or AVIF brand."""
    head = F.substring(header, 1, 32)
    n = F.octet_length(head)
    text = F.hex(head)
    brands = [b.encode().hex().upper() for b in P.HEIF_BRANDS]
    at = lambda byte: F.substring(text, 2 * byte + 1, 8)
    compatible = F.lit(False)
    for byte in range(16, 29, 4):
        compatible = compatible | ((n >= byte + 4) & at(byte).isin(brands))
    return F.coalesce((n >= 12) & (at(4) == b"ftyp".hex().upper()) & (at(8).isin(brands) | compatible), F.lit(False))


def format_size(size: Column, units: tuple[str, ...] = ("KB", "MB", "GB", "TB")) -> Column:
    """Bytes for people: B, then ``units`` with one decimal from 10 on, else two; the last unit has no upper end."""
    out = None
    for step, name in reversed(list(enumerate(units))):
        scaled = size / F.lit(float(1024 ** (step + 1)))
        text = F.concat(F.when(scaled >= 10, F.format_string("%.1f", scaled)).otherwise(F.format_string("%.2f", scaled)), F.lit(f" {name}"))
        out = F.when(size >= 1024 ** (step + 1), text) if out is None else out.when(size >= 1024 ** (step + 1), text)
    return F.when(size.isNull(), F.lit("-")).otherwise(out.otherwise(F.concat(size.cast("string"), F.lit(" B"))))


def parse_tile_url(url: Column) -> Column:
    """STRUCT<kind, session, z, tx, ty>: kind is tile, preview or not_found.  The query and the host go."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    number = lambda i, kind: F.get(parts, F.lit(i)).try_cast(kind)
    digits = F.forall(F.slice(parts, 2, 10), lambda p: p.rlike(r"^\+?[0-9]+$"))
    session, z, tx, ty = number(1, "long"), number(2, "int"), number(3, "int"), number(4, "int")
    tile = (F.get(parts, F.lit(0)) == "tile") & (F.size(parts) == 5) & digits & session.isNotNull() & z.isNotNull() & tx.isNotNull() & ty.isNotNull()
    preview = (F.get(parts, F.lit(0)) == "preview") & (F.size(parts) == 2) & digits & session.isNotNull()
    kind = F.when(tile, F.lit("tile")).when(preview, F.lit("preview")).otherwise(F.lit("not_found"))
    return F.struct(
        kind.alias("kind"), F.when(tile | preview, session).alias("session"), F.when(tile, z).alias("z"), F.when(tile, tx).alias("tx"), F.when(tile, ty).alias("ty")
    )


def parse_dimensions(text: Column) -> Column:
    """STRUCT<width, height> of a probe's output: its ``pixelWidth: n`` lines, or the first ``NxM`` token."""
    prop = lambda name: F.regexp_extract(text, rf"(?m)^\s*{name}:\s*([0-9]+)\s*$", 1).try_cast("int")
    tokens = F.filter(F.split(text, r"[\s,]+"), lambda t: t.rlike("^[0-9]{1,9}x[0-9]{1,9}$"))
    first = F.split(F.get(tokens, F.lit(0)), "x")
    width = F.coalesce(prop("pixelWidth"), F.get(first, F.lit(0)).try_cast("int"))
    height = F.coalesce(prop("pixelHeight"), F.get(first, F.lit(1)).try_cast("int"))
    return F.when(width.isNotNull() & height.isNotNull(), F.struct(width.alias("width"), height.alias("height")))


def retry_delay(attempt: Column) -> Column:
    """Milliseconds before an attempt is repeated: doubling from 150, 2000 at most; null from the sixth on."""
    return F.when(attempt < 6, F.least(F.lit(2000), F.lit(150) * F.pow(F.lit(2), attempt - 1)).cast("int"))


def error_code(stage: Column, message: Column) -> Column:
    """Code of a failure; a system decoder's IMAGE_TOO_LARGE prefix takes precedence."""
    known = {"read": "IO_ERROR", "decode": "DECODE_ERROR", "encode": "ENCODE_ERROR", "format": "UNSUPPORTED_FORMAT", "size": "IMAGE_TOO_LARGE"}
    code = F.when(message.isNull(), F.lit(None).cast("string"))
    code = code.when((stage == "system") & message.startswith("IMAGE_TOO_LARGE:"), F.lit("IMAGE_TOO_LARGE")).when(stage == "system", F.lit("SYSTEM_DECODE_ERROR"))
    for name, value in known.items():
        code = code.when(stage == name, F.lit(value))
    return code.otherwise(F.lit("IO_ERROR"))
