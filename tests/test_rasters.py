"""Binary pixels: files, pyramids, orientation, colour; and tile form against pixel form."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright import kernels as K
from tilewright.operators import pixels, tiles
from tilewright.sources import images


def gradient(w, h):
    ys, xs = np.mgrid[0:h, 0:w]
    return np.stack([xs % 256, ys % 256, 0 * xs, 0 * xs + 255], axis=-1).astype(np.uint8)


def rows_of(array, image_id=1):
    return [(image_id, x, y, *map(int, array[y, x])) for y in range(array.shape[0]) for x in range(array.shape[1])]


PIXELS = "image_id long, x int, y int, r int, g int, b int, a int"


@pytest.mark.parametrize("w, h, alpha, stride", [(10, 8, False, 32), (10, 8, True, 40), (3, 2, False, 12), (5, 3, False, 16)])
def test_bmp(spark, w, h, alpha, stride):
    block = gradient(w, h)
    content = K.encode_bmp(block, alpha)
    assert (K.decode(content) == block).all()
    info = images.bmp_info(spark.createDataFrame([(1, content[:54])], "image_id long, header binary")).first()
    assert info["error"] is None and info["bmp"]["row_stride"] == stride == K.bmp_header(content)["stride"] and not info["bmp"]["bottom_up"]


def test_bmp_bottom_up():
    block = gradient(7, 5)
    content = K.encode_bmp(block[::-1], False)
    flipped = content[:22] + struct.pack("<i", 5) + content[26:]
    assert (K.decode(flipped) == block).all()


def test_bmp_rejections(spark):
    good = K.encode_bmp(gradient(4, 4))
    put = lambda at, fmt, v: good[:at] + struct.pack(fmt, v) + good[at + struct.calcsize(fmt) :]
    cases = [(b"XX" + good[2:], "DECODE_ERROR"), (put(14, "<I", 12), "DECODE_ERROR"), (put(18, "<i", 200_001), "DECODE_ERROR"), (put(30, "<I", 1), "UNSUPPORTED_FORMAT"), (put(28, "<H", 16), "UNSUPPORTED_FORMAT"), (good[:40], "DECODE_ERROR"), (b"", "DECODE_ERROR")]
    found = images.bmp_info(spark.createDataFrame([(i, c[:54]) for i, (c, _) in enumerate(cases)], "i int, header binary")).orderBy("i").collect()
    assert [r["error"] for r in found] == [code for _, code in cases]
    for content, code in cases:
        with pytest.raises(K.FormatError) as e:
            K.bmp_header(content)
        assert e.value.code == code


def test_cut_bmp_bands(spark, tmp_path):
    block = gradient(37, 29)
    for name, content in (("top", K.encode_bmp(block, False)), ("bottom", None)):
        if content is None:
            raw = K.encode_bmp(block[::-1], True)
            content = raw[:22] + struct.pack("<i", 29) + raw[26:]
        path = tmp_path / f"{name}.bmp"
        path.write_bytes(content)
        head = images.read_ranges(spark.createDataFrame([(str(path), 0, 54)], "path string, start long, length long")).select(F.lit(1).cast("long").alias("image_id"), "path", F.col("data").alias("header"))
        cut = images.cut_bmp(images.bmp_info(head), 8)
        got = {(r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in tiles.to_pixels(cut, 8).collect()}
        assert len(got) == 37 * 29 and all(got[x, y] == tuple(map(int, block[y, x])) for x, y in got)
    assert images.read_ranges(spark.createDataFrame([("/missing", 0, 9)], "path string, start long, length long")).first()["data"] is None


def test_png_filters_and_errors():
    import zlib

    rng = np.random.default_rng(0)
    block = rng.integers(0, 256, size=(6, 5, 4), dtype=np.uint8)
    assert (K.decode(K.encode_png(block)) == block).all()
    flat, lines, above = block.reshape(6, -1).astype(int), [], np.zeros(20, dtype=int)
    for y, kind in enumerate((0, 1, 2, 3, 4, 4)):
        left, corner = np.concatenate([np.zeros(4, int), flat[y][:-4]]), np.concatenate([np.zeros(4, int), above[:-4]])
        base = left + above - corner
        paeth = np.array([min((a, b, c), key=lambda p: abs(v - p)) for a, b, c, v in zip(left, above, corner, base)])
        guess = [0 * left, left, above, (left + above) // 2, paeth][kind]
        lines.append(bytes([kind]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes())
        above = flat[y]
    whole = K.encode_png(block)
    at = whole.index(b"IDAT") - 4
    data = zlib.compress(b"".join(lines))
    assert (K.decode(whole[:at] + struct.pack(">I", len(data)) + b"IDAT" + data + b"\0\0\0\0" + struct.pack(">I", 0) + b"IEND" + b"\0\0\0\0") == block).all()
    for junk, code in ((b"", "DECODE_ERROR"), (b"GIF89a", "UNSUPPORTED_FORMAT"), (whole[:20], "DECODE_ERROR"), (whole[: at + 14], "DECODE_ERROR")):
        with pytest.raises(K.FormatError) as e:
            K.decode(junk)
        assert e.value.code == code


def test_means(spark):
    block = np.zeros((4, 4, 4), dtype=np.uint8)
    block[..., 0], block[..., 1], block[..., 3] = 10 * np.arange(4)[None, :], 10 * np.arange(4)[:, None], 255
    half = K.halve(block, False)
    assert half[0, 0, :3].tolist() == [5, 5, 0] and half[1, 1, :3].tolist() == [25, 25, 0]
    odd = np.zeros((3, 5, 4), dtype=np.uint8)
    odd[..., 0], odd[..., 1] = 10 * np.arange(5)[None, :], 20 * np.arange(3)[:, None]
    assert K.halve(odd, False).shape == (2, 3, 4) and K.halve(odd, False)[1, 2, :3].tolist() == [40, 40, 0]
    alpha = np.array([[[200, 100, 50, 255], [10, 240, 180, 0]], [[10, 240, 180, 0]] * 2], dtype=np.uint8)
    assert K.halve(alpha, True)[0, 0].tolist() == [199, 99, 51, 64]
    got = pixels.box_downsample(spark.createDataFrame(rows_of(alpha), PIXELS), True).first()
    assert (got["r"], got["g"], got["b"], got["a"]) == (199, 99, 51, 64)


def test_pyramid_forms_agree(spark):
    rng = np.random.default_rng(5)
    data = [r for i in range(3) for r in rows_of(rng.integers(0, 256, size=(11 + i, 13 - i, 4), dtype=np.uint8), i)]
    df = spark.createDataFrame(data, PIXELS)
    flat = pixels.build_pyramid(df, 3, True)
    tiled = tiles.to_pixels(tiles.build_pyramid(tiles.from_pixels(df, 4), 3, 4, True), 4)
    for z, level in flat.items():
        assert sorted(map(tuple, level.select("image_id", "x", "y", "r", "g", "b", "a").collect())) == sorted(map(tuple, tiled.where(F.col("z") == z).drop("z").collect()))


@pytest.mark.parametrize("orientation", range(0, 10))
def test_orientation(spark, orientation):
    block = gradient(4, 3)
    turned = K.oriented(block, orientation)
    sizes = spark.createDataFrame([(1, 4, 3, orientation)], "image_id long, width int, height int, orientation int")
    got = {(r["x"], r["y"]): (r["r"], r["g"]) for r in pixels.orient(spark.createDataFrame(rows_of(block), PIXELS), sizes).collect()}
    assert got == {(x, y): (int(turned[y, x, 0]), int(turned[y, x, 1])) for y in range(turned.shape[0]) for x in range(turned.shape[1])}


def exif(value, order="<"):
    tiff = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IHHHIHHI", 8, 1, 0x0112, 3, 1, value, 0, 0)
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"


def test_exif_orientation():
    assert [K.exif_orientation(exif(v, o)) for v, o in ((6, "<"), (3, ">"), (9, "<"))] == [6, 3, 1]
    assert [K.exif_orientation(x) for x in (b"", b"\xff\xd8", b"BM", exif(6)[:20])] == [1, 1, 1, 1]


def profile(gamma, primaries):
    tags = {b"rXYZ": primaries[0], b"gXYZ": primaries[1], b"bXYZ": primaries[2]}
    blobs = {k: b"XYZ \0\0\0\0" + struct.pack(">3i", *[round(v * 65536) for v in xyz]) for k, xyz in tags.items()}
    blobs |= {k: b"curv\0\0\0\0" + struct.pack(">IH", 1, round(gamma * 256)) for k in (b"rTRC", b"gTRC", b"bTRC")}
    table, data, at = b"", b"", 132 + 12 * len(blobs)
    for k, blob in blobs.items():
        table += struct.pack(">4sII", k, at + len(data), len(blob))
        data += blob + b"\0" * (-len(blob) % 4)
    head = bytearray(128)
    head[16:20], head[36:40] = b"RGB ", b"acsp"
    return bytes(head) + struct.pack(">I", len(blobs)) + table + data


#: D50 primaries of Display P3.
P3 = ((0.51512, 0.24120, -0.00105), (0.29198, 0.69225, 0.04189), (0.15710, 0.06657, 0.78407))


def test_colour(spark):
    block = np.array([[[200, 50, 50, 77], [255, 255, 255, 255]]], dtype=np.uint8)
    out, done = K.icc_to_srgb(block, profile(2.2, P3))
    assert done and out[0, 0, 0] > 200 and out[0, 0, 3] == 77 and (out[0, 1] >= 254).all()
    for bad in (None, b"junk", profile(2.2, P3)[:150]):
        same, done = K.icc_to_srgb(block, bad)
        assert not done and (same == block).all()
    rasters = spark.createDataFrame([(1, 0, 0, 0, 2, 1, bytearray(block.tobytes()), None)], tiles.TILE + ", icc binary")
    assert not tiles.to_srgb(rasters).first()["converted"]


def test_thumbnails(spark):
    files = [(1, bytearray(K.encode_png(gradient(400, 300)))), (2, bytearray(K.encode_bmp(gradient(200, 100)))), (3, bytearray(b"garbage")), (4, None), (5, bytearray(K.encode_png(gradient(20, 10))))]
    rows = {r["image_id"]: r for r in tiles.thumbnails(spark.createDataFrame(files, "image_id long, content binary"), 160).collect()}
    assert (rows[1]["width"], rows[1]["height"]) == (160, 120) and (rows[2]["width"], rows[2]["height"]) == (160, 80) and rows[5]["width"] == 20
    assert (rows[3]["error"], rows[4]["error"]) == ("UNSUPPORTED_FORMAT", "DECODE_ERROR")
    assert K.decode(bytes(rows[1]["content"])).shape == (120, 160, 4)


def test_regions(spark):
    df = spark.createDataFrame(rows_of(gradient(8, 8)), PIXELS)
    rect = "rect_id int, image_id long, rx int, ry int, rw int, rh int, tw int, th int, width int, height int"
    rects = spark.createDataFrame([(1, 1, 1, 1, 2, 2, 2, 2, 8, 8), (2, 1, 10, 10, 2, 2, 2, 1, 8, 8), (3, 1, 0, 0, 4, 1, 2, 1, 8, 8), (4, 1, 0, 0, 1, 1, 0, 1, 8, 8)], rect)
    got = {}
    for r in pixels.read_region(df, rects).orderBy("y", "x").collect():
        got.setdefault(r["rect_id"], []).append((r["r"], r["g"], r["b"], r["a"]))
    assert got == {1: [(1, 1, 0, 255), (2, 1, 0, 255), (1, 2, 0, 255), (2, 2, 0, 255)], 2: [(0, 0, 0, 0)] * 2, 3: [(0, 0, 0, 255), (2, 0, 0, 255)]}


def exif_png(orientation: int) -> bytes:
    """A PNG with an EXIF chunk after its header."""
    whole = K.encode_png(gradient(5, 4))
    tiff = b"MM\0*" + struct.pack(">IHHHIHHI", 8, 1, 0x0112, 3, 1, orientation, 0, 0)
    return whole[:33] + struct.pack(">I", len(tiff)) + b"eXIf" + tiff + b"\0\0\0\0" + whole[33:]


def written_by_jvm(spark, pixels: np.ndarray, kind: str) -> bytes:
    jvm = spark._jvm
    height, width, _ = pixels.shape
    image = jvm.java.awt.image.BufferedImage(width, height, 1)
    for y in range(height):
        for x in range(width):
            image.setRGB(x, y, int(pixels[y, x, 0]) << 16 | int(pixels[y, x, 1]) << 8 | int(pixels[y, x, 2]))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, kind, out)
    return bytes(out.toByteArray())


def test_decode_images_and_orientation(spark, tmp_path):
    smooth = np.full((8, 16, 4), 255, dtype=np.uint8)
    smooth[:, 8:, :3] = 0
    jpeg, gif = written_by_jvm(spark, smooth, "jpg"), written_by_jvm(spark, smooth, "gif")
    app1 = exif(6)[8:-2]
    files = {
        "a.png": K.encode_png(gradient(5, 4)), "b.bmp": K.encode_bmp(gradient(3, 2)), "c.gif": b"GIF89a", "d.jpg": exif(8), "e.jpg": jpeg, "f.gif": gif, "g.jpg": jpeg[:2] + app1 + jpeg[2:],
        "h.png": exif_png(3), "i.heic": b"\0\0\0\x18ftypheic", "j.png": K.encode_png(gradient(5, 4))[:40], "k k.png": K.PNG_SIGNATURE,
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in images.decode_images(spark, [str(tmp_path)]).collect()}
    assert set(rows) == set(files)
    assert (rows["a.png"]["width"], rows["a.png"]["height"]) == (5, 4) and bytes(rows["b.bmp"]["data"]) == gradient(3, 2).tobytes()
    assert {n: r["error"] for n, r in rows.items() if r["error"]} == {n: "DECODE_ERROR" for n in ("c.gif", "d.jpg", "j.png", "k k.png")} | {"i.heic": "UNSUPPORTED_FORMAT"}
    assert bytes(rows["f.gif"]["data"]) == smooth.tobytes()
    block = np.frombuffer(bytes(rows["e.jpg"]["data"]), dtype=np.uint8).reshape(8, 16, 4)
    assert np.abs(block.astype(int) - smooth).max() < 40 and (rows["g.jpg"]["width"], rows["g.jpg"]["height"], rows["g.jpg"]["orientation"]) == (8, 16, 6)
    assert bytes(rows["h.png"]["data"]) == gradient(5, 4)[::-1, ::-1].tobytes()
    turned = {r["path"].rsplit("/", 1)[1]: r["orientation"] for r in images.exif_orientation(images.read_files(spark, [str(tmp_path)])).collect()}
    assert {n: o for n, o in turned.items() if o != 1} == {"d.jpg": 8, "g.jpg": 6, "h.png": 3}
    small = {r["path"].rsplit("/", 1)[1]: r for r in tiles.raster_thumbnails(images.decode_images(spark, [str(tmp_path)]), 8).collect()}
    assert (small["g.jpg"]["width"], small["g.jpg"]["height"], small["c.gif"]["error"]) == (4, 8, "DECODE_ERROR")


def test_profiles_in_files():
    profile = b"p" * 300
    jpeg = b"\xff\xd8" + b"".join(b"\xff\xe2" + struct.pack(">H", 16 + len(part)) + b"ICC_PROFILE\0" + bytes([k, 2]) + part for k, part in ((2, profile[200:]), (1, profile[:200]))) + b"\xff\xda\0\2"
    whole = K.encode_png(gradient(5, 4))
    import zlib

    body = b"name\0\0" + zlib.compress(profile)
    png = whole[:33] + struct.pack(">I", len(body)) + b"iCCP" + body + b"\0\0\0\0" + whole[33:]
    tiff = b"II*\0" + struct.pack("<IHHHII", 8, 1, 34675, 7, 300, 26) + b"\0\0\0\0" + profile
    assert K.icc_profile(jpeg) == K.icc_profile(png) == K.icc_profile(tiff) == profile
    assert K.icc_profile(whole) is K.icc_profile(b"") is K.icc_profile(b"\xff\xd8") is K.icc_profile(tiff[:20]) is None


def test_png_of_any_filter_is_fast_and_bounded():
    import time
    import zlib

    rng = np.random.default_rng(3)
    for height, width in ((1, 1), (1, 9), (9, 1), (7, 13)):
        kinds = rng.integers(0, 5, size=height, dtype=np.uint8)
        lines = rng.integers(0, 256, size=(height, width, 3), dtype=np.uint8)
        want = np.zeros((height, width, 3), dtype=int)
        for y in range(height):
            for x in range(width):
                for c in range(3):
                    a, b = (want[y, x - 1, c] if x else 0), (want[y - 1, x, c] if y else 0)
                    d = want[y - 1, x - 1, c] if x and y else 0
                    guess = (0, a, b, (a + b) // 2, min((a, b, d), key=lambda p: abs(a + b - d - p)))[kinds[y]]
                    want[y, x, c] = (int(lines[y, x, c]) + guess) % 256
        assert (K._unfilter(kinds, lines) == want).all()
    began = time.process_time()
    K._unfilter(np.full(1000, 4, dtype=np.uint8), rng.integers(0, 256, size=(1000, 1000, 4), dtype=np.uint8))
    assert time.process_time() - began < 3
    head = lambda w, h: K.PNG_SIGNATURE + struct.pack(">I4sIIBBBBBI", 13, b"IHDR", w, h, 8, 6, 0, 0, 0, 0)
    bomb = zlib.compress(b"\0" * 1_000_000)
    chunk = struct.pack(">I", len(bomb)) + b"IDAT" + bomb + b"\0\0\0\0"
    for content, code in ((head(0, 0), "DECODE_ERROR"), (head(1, 1)[:20], "DECODE_ERROR"), (head(100_000, 100_000), "IMAGE_TOO_LARGE"), (head(3, 2), "DECODE_ERROR")):
        with pytest.raises(K.FormatError) as e:
            K.decode(content)
        assert e.value.code == code
    assert K.decode(head(3, 2) + chunk).shape == (2, 3, 4)


def picture(rng, height, width):
    """Smooth colours with an edge and a little noise, as photographs have."""
    y, x = np.mgrid[0:height, 0:width]
    base = np.stack([127 + 90 * np.sin(x / 17 + k) * np.cos(y / 23 - k) for k in range(3)], axis=-1)
    base[:, width // 2 :] = base[:, width // 2 :] * 0.6 + 40
    out = np.full((height, width, 4), 255, dtype=np.uint8)
    out[..., :3] = np.clip(base + rng.normal(0, 2, base.shape), 0, 255)
    return out


def test_jpeg_through_another_decoder(spark, tmp_path):
    """The JVM reads the files; the higher the quality, the smaller the error and the larger the file."""
    rng = np.random.default_rng(1)
    want, sizes = {}, {}
    for height, width in ((1, 1), (8, 8), (7, 19), (64, 48), (150, 211)):
        pixels = picture(rng, height, width)
        for quality in (1, 30, 50, 75, 95, 100):
            name = f"{height}x{width} q{quality}.jpg"
            content = K.encode_jpeg(pixels, quality)
            (tmp_path / name).write_bytes(content)
            want[name], sizes[name] = (pixels, quality), len(content)
    noise = rng.integers(0, 256, size=(40, 33, 4)).astype(np.uint8)
    (tmp_path / "noise.jpg").write_bytes(K.encode_jpeg(noise, 90, background=0))
    flat = noise[..., :3] * (noise[..., 3:] / 255)
    errors = {}
    for r in images.decode_images(spark, [str(tmp_path)]).collect():
        name = r["path"].rpartition("/")[2]
        got = np.frombuffer(r["data"], dtype=np.uint8).reshape(r["height"], r["width"], 4)[..., :3].astype(float)
        pixels, quality = want.get(name, (np.dstack([flat, flat[..., :1]]), 90))
        assert got.shape[:2] == pixels.shape[:2]
        errors[name] = float(np.sqrt(np.mean((got - pixels[..., :3]) ** 2)))
    assert len(errors) == len(want) + 1
    for name, (_, quality) in want.items():
        assert errors[name] <= {1: 90, 30: 9, 50: 6, 75: 4.5, 95: 2.5, 100: 1.5}[quality], (name, errors[name])
    assert errors["noise.jpg"] < 25
    big = [f"150x211 q{q}.jpg" for q in (1, 30, 50, 75, 95, 100)]
    assert [sizes[n] for n in big] == sorted(sizes[n] for n in big) and sizes[big[3]] < len(K.encode_png(want[big[3]][0])) / 4
    with pytest.raises(K.FormatError):
        K.encode_jpeg(noise, 0)


def test_code_lengths_are_prefix_codes_of_16_bits():
    rng = np.random.default_rng(2)
    for counts in (np.array([5]), np.ones(256, dtype=int), 2 ** np.minimum(np.arange(60), 40), rng.integers(0, 9, size=256)):
        lengths = K._code_lengths(np.pad(counts, (0, 256 - len(counts))))
        assert set(lengths) == set(np.flatnonzero(counts)) and max(lengths.values()) <= 16
        assert sum(2.0**-n for n in lengths.values()) < 1 or len(lengths) == 1


def test_viewport_reads_few_row_groups(spark, tmp_path):
    """Tiles are clustered: a small box lies in a small share of the row groups."""
    import pyarrow.dataset as ds

    tiles_ = spark.range(128 * 96).select(F.lit(7).cast("long").alias("image_id"), F.lit(0).alias("z"), (F.col("id") % 128).cast("int").alias("tx"), F.floor(F.col("id") / 128).cast("int").alias("ty"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.encode(F.lpad(F.col("id").cast("string"), 200, "x"), "UTF-8").alias("data"))
    path = str(tmp_path / "tiles")
    tiles.tiles_sink(tiles_, path, group_bytes=20_000, partitions=6)
    box = (20, 30, 31, 37)
    found = tiles.read_viewport(spark, path, 7, 0, box)
    assert found.count() == 12 * 8 and found.columns == tiles_.columns
    groups = [g.statistics for f in ds.dataset(path).get_fragments() for g in f.row_groups]
    opened = [g for g in groups if g["tx"]["min"] <= box[2] and g["tx"]["max"] >= box[0] and g["ty"]["min"] <= box[3] and g["ty"]["max"] >= box[1]]
    assert len(groups) > 60 and len(opened) <= 0.12 * len(groups)
    assert "PushedFilters: [IsNotNull(image_id)" in found._jdf.queryExecution().executedPlan().toString()


def test_morton_keys_interleave(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (3, 5), (1 << 20, 1)], "x int, y int").select(tiles.morton(F.col("x"), F.col("y")).alias("m")).collect()
    assert [r["m"] for r in rows] == [0, 1, 2, 0b100111, (1 << 40) + 2]
