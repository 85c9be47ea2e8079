"""Header walkers on small files of each kind, and the files that decoders open."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright import kernels as K
from tilewright.operators import tiles
from tilewright.sources import headers, images


def told(data, raw=False):
    return headers.walk(lambda at, n: data[at : at + n], len(data), raw)


def box(kind, *body):
    content = b"".join(body)
    return struct.pack(">I4s", 8 + len(content), kind) + content


def tiff(order, sizes, wide=False, sub=()):
    """Directories chained in file order; ``sub``: further ones that the first points to."""
    word, entry, kind = ("Q", 20, 16) if wide else ("I", 12, 4)
    n = lambda layout, *v: struct.pack(order + layout, *v)
    head = (b"II" if order == "<" else b"MM") + (n("HHHQ", 43, 8, 0, 16) if wide else n("HI", 42, 8))
    places, at = [], len(head)
    for k in range(len(sizes) + len(sub)):
        places.append(at)
        at += (8 if wide else 2) + entry * (3 if k == 0 and sub else 2) + (8 if wide else 4)
    out = head
    for k, (w, h) in enumerate([*sizes, *sub]):
        fields = [n("HH" + word + word, 256, kind, 1, w), n("HH" + word + word, 257, kind, 1, h)]
        if k == 0 and sub:
            fields.append(n("HH" + word + word, 330, kind, 1, places[len(sizes)]))
        following = places[k + 1] if k + 1 < len(sizes) else 0
        out += n("Q" if wide else "H", len(fields)) + b"".join(fields) + n(word, following)
    return out


def heif(primary, owned, wide=False, before=b""):
    ispe = lambda w, h: box(b"ispe", b"\0" * 4, struct.pack(">II", w, h))
    flags = b"\1\0\0\1" if wide else b"\0\0\0\0"
    item = struct.Struct(">IBH" if wide else ">HBB")
    ipma = box(b"ipma", flags, struct.pack(">I", len(owned)), *(item.pack(i, 1, p) for i, p in owned))
    pitm = box(b"pitm", b"\1\0\0\0", struct.pack(">I", primary)) if wide else box(b"pitm", b"\0" * 4, struct.pack(">H", primary))
    return box(b"ftyp", b"avif\0\0\0\0") + before + box(b"meta", b"\0" * 4, pitm, box(b"iprp", box(b"ipco", ispe(9, 9), box(b"irot", b"\1"), ispe(7000, 5000)), ipma))


def jxl(width, height, ratio=0):
    """Sides as 18-bit numbers."""
    bits = 0 | 2 << 1 | height - 1 << 3 | ratio << 21
    return b"\xff\x0a" + (bits if ratio else bits | 2 << 24 | width - 1 << 26).to_bytes(8, "little")


def jpeg(*segments, frame=0xC0):
    return b"\xff\xd8" + b"".join(struct.pack(">BBH", 255, m, 2 + n) + b"\x5a" * n for m, n in segments) + struct.pack(">BBHBHHB", 255, frame, 17, 8, 300, 400, 3) + b"\0" * 9


GOOD = {
    "jpeg": (jpeg((0xE0, 14), (0xC4, 40), (0xCC, 3)), 400, 300),
    "progressive": (jpeg((0xE1, 65000), (0xE2, 65000), (0xE2, 9), frame=0xC2), 400, 300),
    "png": (K.encode_png(np.zeros((5, 9, 4), np.uint8)), 9, 5),
    "gif": (K.encode_gif(np.zeros((4, 3, 4), np.uint8)), 3, 4),
    "bmp": (K.encode_bmp(np.zeros((6, 2, 4), np.uint8)), 2, 6),
    "os2": (b"BM" + b"\0" * 12 + struct.pack("<IHHHH", 12, 11, 12, 1, 24), 11, 12),
    "vp8": (b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\x10\0\0\x9d\x01\x2a" + struct.pack("<HH", 0x4000 | 31, 17), 31, 17),
    "vp8l": (b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + struct.pack("<I", 16383 | 4 << 14), 16384, 5),
    "vp8x": (b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (99999).to_bytes(3, "little") + (0).to_bytes(3, "little"), 100000, 1),
    "tiff": (tiff("<", [(640, 480), (9000, 9000)]), 640, 480),
    "big tiff": (tiff(">", [(70000, 3)], wide=True), 70000, 3),
    "avif": (heif(2, [(1, 1), (2, 3)]), 7000, 5000),
    "avif of small item": (heif(1, [(2, 3), (1, 1)]), 9, 9),
    "avif behind its data": (heif(70000, [(1, 1), (70000, 3)], True, box(b"mdat", b"\0" * 300_000)), 7000, 5000),
    "avif without owner": (heif(5, []), 7000, 5000),
    "jxl": (jxl(14392, 10484), 14392, 10484),
    "jxl ratio": (jxl(0, 900, 5), 1600, 900),
    "jxl in boxes": (box(b"JXL ", b"\r\n\x87\n") + box(b"ftyp", b"jxl \0\0\0\0jxl ") + box(b"jxlp", b"\0\0\0\0", jxl(5, 6)), 5, 6),
}


@pytest.mark.parametrize("name", GOOD)
def test_walkers(name):
    data, width, height = GOOD[name]
    kind, *sides, read, head, error = told(data)
    assert sides == [width, height] and error is None and read <= 8192 and head == data[: len(head)]


def test_cut_and_broken_headers_are_told():
    """Whatever is cut or changed: an answer or a code, never a crash, and never more than the file is read."""
    rng = random.Random(2)
    for data, width, height in GOOD.values():
        data = data[:3000] + data[-300:] if len(data) > 10_000 else data
        for n in range(min(len(data), 400)):
            _, w, h, read, _, error = told(data[:n])
            assert (error is None) == (w is not None) == (h is not None) and (error is not None or (w, h) == (width, height))
        for _ in range(200):
            broken = bytearray(data)
            for _ in range(rng.randint(1, 6)):
                broken[rng.randrange(min(len(broken), 200))] = rng.randrange(256)
            _, w, h, _, _, error = told(bytes(broken))
            assert (error is None) == (w is not None)


def test_camera_files_take_the_largest_directory():
    data = tiff("<", [(160, 120), (1620, 1080)], sub=[(6000, 4000)])
    assert told(data)[1:3] == (160, 120) and told(data, raw=True)[1:3] == (6000, 4000)
    loop = bytearray(tiff("<", [(5, 6)]))
    loop[-4:] = struct.pack("<I", 8)  # the directory is followed by itself
    assert told(bytes(loop), raw=True)[1:3] == (5, 6)


NAMES = ["a.png", "b c.png", "#1.png", "100%.png", "%41.png", "why?.png", 'q"q.png', "{x}.png", "a+b.png", "ü漢.png", "[1].png", "~^|`;.png"]


def test_decoding_files_of_any_name(spark, tmp_path):
    rng = np.random.default_rng(3)
    want = {}
    for k, name in enumerate(NAMES):
        pixels = rng.integers(0, 256, size=(k + 1, 3, 4)).astype(np.uint8)
        (tmp_path / name).write_bytes(K.encode_png(pixels))
        want[f"{tmp_path}/{name}"] = (3, k + 1, pixels.tobytes(), None)
    (tmp_path / "cut #.png").write_bytes(K.encode_png(pixels)[:40])
    (tmp_path / "no % image.png").write_bytes(b"none")
    want |= {f"{tmp_path}/cut #.png": (None, None, None, "DECODE_ERROR"), f"{tmp_path}/no % image.png": (None, None, None, "UNSUPPORTED_FORMAT")}
    found = images.decode_images(spark, [str(tmp_path)])
    assert {r["path"]: (r["width"], r["height"], bytes(r["data"]) if r["data"] else None, r["error"]) for r in found.collect()} == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_gif_through_the_decoder(spark, tmp_path):
    rng = np.random.default_rng(4)
    want = {}
    for k, colours in enumerate((1, 2, 3, 4, 5, 100, 256)):
        palette = np.unique(rng.integers(0, 256, size=(colours, 3)), axis=0).astype(np.uint8)
        pixels = np.full((20 + k, 33, 4), 255, dtype=np.uint8)
        pixels[..., :3] = palette[rng.integers(0, len(palette), size=pixels.shape[:2])]
        (tmp_path / f"{k}.gif").write_bytes(K.encode_gif(pixels))
        want[f"{tmp_path}/{k}.gif"] = pixels.tobytes()
    assert {r["path"]: bytes(r["data"]) for r in images.decode_images(spark, [str(tmp_path)]).collect()} == want


def test_probe_headers_of_files(spark, tmp_path):
    (tmp_path / "a #.jpg").write_bytes(GOOD["progressive"][0])
    (tmp_path / "b.NEF").write_bytes(tiff(">", [(160, 120)], sub=[(6000, 4000)]))
    (tmp_path / "c.png").write_bytes(b"")
    paths = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in ("a #.jpg", "b.NEF", "c.png", "gone.png")] + [(None,)], "path string")
    rows = {(r["path"] or "/").rpartition("/")[2]: (r["format"], r["width"], r["height"], r["error"]) for r in headers.probe_headers(paths).collect()}
    assert rows == {"a #.jpg": ("jpeg", 400, 300, None), "b.NEF": ("tiff", 6000, 4000, None), "c.png": (None, None, None, "UNSUPPORTED_FORMAT"), "gone.png": (None, None, None, "IO_ERROR"), "": (None, None, None, "IO_ERROR")}
    files = spark.createDataFrame([(f"{tmp_path}/{n}", n, 100) for n in ("a #.jpg", "b.NEF")], "path string, name string, size long")
    probed = {r["format"]: (r["width"], r["load_mode"], r["raw_preview"]) for r in headers.probe_files(files).collect()}
    assert probed == {"jpg": (400, "normal", False), "nef": (6000, "largeCandidate", True)}
    assert headers.probe_headers(paths.limit(0)).count() == 0
