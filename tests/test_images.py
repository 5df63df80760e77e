"""NumPy job vs SQL forms, kernel properties, decode and resize."""
import numpy as np
from pyspark.sql import functions as F

from editlake import fixtures as fx
from editlake import taxonomy as tx
from editlake.functions import pixels as PX
from editlake.operators import images as IM

SF = "/root/testdata/sf0.001"

# (R, G, B) = (0.5, -0.2, 0.1) -> FIXTURES section 5
ONE_PIXEL = {
    "black_and_white": (0.0435, 0.0435, 0.0435), "sepia_vintage": (0.046545, 0.04089, 0.03132),
    "brighter": (0.725, 0.2, 0.425), "darker": (0.075, -0.45, -0.225),
    "more_colorful": (0.91085, -0.41915, 0.15085), "less_colorful": (0.203275, -0.041725, 0.063275),
    "warmer": (0.56, -0.2, 0.085), "cooler": (0.425, -0.196, 0.115), "inverted": (-0.5, 0.2, -0.1),
    "high_contrast": (0.85, -0.34, 0.17), "low_contrast": (0.25, -0.1, 0.05),
}


def test_one_pixel_goldens():
    x = np.array([0.5, -0.2, 0.1]).reshape(1, 3, 1, 1)
    for name, want in ONE_PIXEL.items():
        np.testing.assert_allclose(IM.EDITS[name](x).reshape(3), want, atol=1e-9)


def test_numpy_job_matches_sql_forms(spark):
    img = fx.images_binary(spark, SF)
    job = IM.synthetic_pairs(IM.synthetic_cross(img), out="float").where(
        F.col("edit_type").isin(*PX.SQL_EDITS))
    arr = fx.images(spark, SF).select("img_id", PX.normalize(F.col("px")).alias("x"))
    sql = None
    for e in PX.SQL_EDITS:
        one = arr.select("img_id", F.lit(e).alias("edit_type"), PX.synthetic_sql(F.col("x"), e, 8).alias("s"))
        sql = one if sql is None else sql.unionByName(one)
    a = {(r.img_id, r.edit_type): np.array(r.after) for r in job.collect()}
    b = {(r.img_id, r.edit_type): np.array(r.s) for r in sql.collect()}
    assert a.keys() == b.keys() and len(a) == 200 * 11
    for k in a:
        np.testing.assert_allclose(a[k], b[k], atol=1e-12)


def test_blur_properties():
    rng = np.random.default_rng(0)
    const = np.full((2, 3, 8, 8), 0.3)
    np.testing.assert_allclose(IM.blur(const), const, atol=1e-12)
    np.testing.assert_allclose(IM.sharpen(const), const, atol=1e-12)
    x = rng.uniform(-1, 1, (1, 3, 9, 9))
    # separable == direct 2-D sum with reflect padding
    r = 7
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * 2.5 ** 2))
    k /= k.sum()
    pad = np.pad(x, ((0, 0), (0, 0), (r, r), (r, r)), mode="reflect")
    direct = np.zeros_like(x)
    for dy in range(2 * r + 1):
        for dx in range(2 * r + 1):
            direct += k[dy] * k[dx] * pad[:, :, dy:dy + 9, dx:dx + 9]
    np.testing.assert_allclose(IM.blur(x), direct, atol=1e-12)


def test_involutions_and_roundtrip():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (4, 3, 8, 8))
    np.testing.assert_array_equal(IM.EDITS["inverted"](IM.EDITS["inverted"](x)), x)
    np.testing.assert_array_equal(x[..., ::-1][..., ::-1], x)
    u8 = np.arange(256, dtype=np.uint8)
    back = IM.denormalize_u8(IM.normalize_u8(u8))
    assert np.all(np.abs(back.astype(int) - u8.astype(int)) <= 1)


def test_flip_sql_twice_is_identity(spark):
    img = fx.images(spark, SF)
    twice = img.select("px", PX.flip(PX.flip(F.col("px"), 8), 8).alias("f")).collect()
    assert all(list(r.px) == list(r.f) for r in twice)


def test_decode_counts_bad_cells(spark):
    good = bytes(range(192))
    rows = [(1, (good, None)), (2, (good[:100], None)), (3, (None, None)), (4, None)]
    df = spark.createDataFrame(rows, "img_id long, c struct<bytes: binary, path: string>")
    out = {r.img_id: r for r in IM.decode_images(df, "c").collect()}
    assert out[1].ok and out[1].height == 8 and not out[2].ok and not out[3].ok and not out[4].ok
    hwc = np.frombuffer(good, np.uint8).reshape(8, 8, 3)
    assert bytes(out[1].px) == hwc.transpose(2, 0, 1).tobytes()


def test_resize_constant_and_identity():
    c = np.full((1, 3, 16, 16), 77, np.uint8)
    assert np.all(IM.resize_chw(c, 8) == 77)
    x = np.random.default_rng(2).integers(0, 256, (1, 3, 8, 8), dtype=np.uint8)
    np.testing.assert_array_equal(IM.resize_chw(x, 8), x)
    m = IM.lanczos_matrix(16, 8)
    np.testing.assert_allclose(m.sum(axis=1), 1.0)


def test_resize_job(spark):
    out = IM.resize_images(fx.images_binary(spark, SF), 4).collect()
    assert len(out) == 200 and all(len(r.px) == 48 and r.res == 4 for r in out)


def test_registered_edits(spark):
    names = IM.register_edits(spark)
    assert len(names) == 14
    arr = fx.images(spark, SF).select("img_id", PX.normalize(F.col("px")).alias("x"))
    r = arr.select("x", F.call_function("edit_inverted", F.col("x"), F.lit(8)).alias("y")).first()
    np.testing.assert_allclose(np.array(r.y), -np.array(r.x))
    arr.limit(3).createOrReplaceTempView("edit_imgs")
    rows = spark.sql("SELECT i.img_id, e.edit_type FROM edit_imgs i, LATERAL synthetic_edits(i.x, 8) e").collect()
    assert len(rows) == 3 * 13 and {r.edit_type for r in rows} == set(tx.SYNTHETIC_TYPES)


def _png(path, rgb):
    """Minimal PNG writer (8-bit RGB, no filtering) for the test."""
    import struct
    import zlib
    h, w, _ = rgb.shape
    raw = b"".join(b"\x00" + rgb[y].tobytes() for y in range(h))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)
    with open(path, "wb") as fh:
        fh.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                 + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_read_image_files(spark, scratch):
    import os

    from editlake.sources import corpus as SC
    rng = np.random.default_rng(5)
    imgs = {f"a{i}.png": rng.integers(0, 256, (8, 8, 3), dtype=np.uint8) for i in range(3)}
    for name, arr in imgs.items():
        _png(os.path.join(scratch, name), arr)
    with open(os.path.join(scratch, "broken.png"), "wb") as fh:
        fh.write(b"\x89PNG\r\n\x1a\nnot really")
    out = {os.path.basename(r.path): r for r in SC.read_image_files(spark, scratch).collect()}
    assert not out["broken.png"].ok
    for name, arr in imgs.items():
        r = out[name]
        assert r.ok and r.height == 8 and r.width == 8
        assert bytes(r.px) == arr.transpose(2, 0, 1).tobytes()
