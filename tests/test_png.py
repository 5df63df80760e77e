"""PNG cells: every colour type, depth and filter, damaged files, batches through Spark."""
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from editlake import fixtures as fx
from editlake.functions import png
from editlake.operators import images as IM
from editlake.sources import corpus as SC

RNG = np.random.default_rng(0)
SIZES = [(1, 1), (7, 5), (5, 7), (16, 16), (16, 16), (1, 9), (9, 1)]


@pytest.mark.parametrize("kinds", [(0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4), (4, 3, 0), (0, 1)])
def test_filters_and_channels(kinds):
    for channels in (1, 2, 3, 4):
        images = [RNG.integers(0, 256, (h, w, channels)).astype(np.uint8) for h, w in SIZES]
        for image, got in zip(images, png.decode([png.encode(i, kinds) for i in images])):
            want = image[:, :, :3] if channels >= 3 else np.repeat(image[:, :, :1], 3, axis=2)
            np.testing.assert_array_equal(got, want)


def undo_by_hand(rows, step):
    """The format's own definition, byte by byte."""
    out = np.zeros((len(rows), rows.shape[1] - 1), np.uint8)
    for y, row in enumerate(rows):
        for i, v in enumerate(row[1:].tolist()):
            a = int(out[y, i - step]) if i >= step else 0
            b = int(out[y - 1, i]) if y else 0
            c = int(out[y - 1, i - step]) if y and i >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[y, i] = (v + [0, a, b, (a + b) // 2, near][row[0]]) & 255
    return out


@pytest.mark.parametrize("step,width", [(1, 5), (2, 6), (3, 9), (4, 8), (6, 12), (8, 16), (3, 3)])
def test_unfilter_equals_definition(step, width):
    rows = RNG.integers(0, 256, (5, 7, 1 + width)).astype(np.uint8)
    rows[:, :, 0] = RNG.integers(0, 5, (5, 7))
    got = png.unfilter(rows, step)
    for one, r in zip(got, rows):
        np.testing.assert_array_equal(one, undo_by_hand(r, step))


def raw_file(w, h, depth, kind, rows, extra=b"", interlace=0):
    return (png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, interlace)) + extra
            + png.chunk(b"IDAT", zlib.compress(rows)) + png.chunk(b"IEND", b""))


def test_depths_and_palettes():
    grey = raw_file(5, 1, 2, 0, bytes([0, 0b00011011, 0b11000000]))
    np.testing.assert_array_equal(png.decode([grey])[0][0, :, 0], [0, 85, 170, 255, 255])
    one = raw_file(3, 1, 1, 0, bytes([0, 0b10100000]))
    np.testing.assert_array_equal(png.decode([one])[0][0, :, 1], [255, 0, 255])
    deep = raw_file(2, 1, 16, 2, bytes([0]) + struct.pack(">6H", 0x1234, 0x5678, 0x9ABC, 0xFF00, 0x00FF, 0x8000))
    np.testing.assert_array_equal(png.decode([deep])[0][0], [[0x12, 0x56, 0x9A], [0xFF, 0x00, 0x80]])
    palette = png.chunk(b"PLTE", bytes([1, 2, 3, 40, 50, 60]))
    four = raw_file(3, 1, 4, 3, bytes([0, 0x01, 0x10]), palette + png.chunk(b"tRNS", b"\0"))
    np.testing.assert_array_equal(png.decode([four])[0][0], [[1, 2, 3], [40, 50, 60], [40, 50, 60]])
    out_of_range = raw_file(1, 1, 8, 3, bytes([0, 2]), palette)
    assert isinstance(png.decode([out_of_range])[0], ValueError)


def test_damaged_files_say_why():
    good = png.encode(RNG.integers(0, 256, (8, 8, 3)).astype(np.uint8))
    cases = {"cut short": good[:-20], "checksum": good[:60] + bytes([good[60] ^ 1]) + good[61:], "not a PNG": b"GIF89a",
             "interlaced": raw_file(1, 1, 8, 0, b"\0\0", interlace=1), "row filter": raw_file(1, 1, 8, 0, b"\7\0"),
             "too large": png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 1 << 20, 1 << 20, 8, 2, 0, 0, 0)),
             "header is damaged": raw_file(1, 1, 3, 2, b"\0\0"), "without a header or palette": raw_file(1, 1, 8, 3, b"\0\0")}
    cases["data is damaged"] = (png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0))
                                + png.chunk(b"IDAT", b"nonsense") + png.chunk(b"IEND", b""))
    cases["cut short "] = raw_file(2, 2, 8, 0, b"\0\0")
    for (why, _), got in zip(cases.items(), png.decode(list(cases.values()))):
        assert isinstance(got, ValueError) and why.strip() in str(got), why
    for cut in range(0, len(good), 7):  # never anything but an error
        assert isinstance(png.decode([good[:cut]])[0], ValueError)


def test_cells_through_spark(spark, tmp_path):
    img = fx.images_binary(spark, "/root/testdata/sf0.001").withColumnRenamed("res", "height").withColumn("width", F.col("height"))
    cells = IM.png_cells(img, kinds=(4, 3, 2, 1, 0))
    broken = cells.withColumn("image_file", F.when(F.col("img_id") % 7 == 0, F.struct(
        F.expr("substring(image_file.bytes, 1, 50)").alias("bytes"), F.lit(None).cast("string").alias("path")))
        .when(F.col("img_id") % 7 == 1, F.lit(None)).otherwise(F.col("image_file")))
    got = {r.img_id: r for r in IM.decode_images(broken, "image_file", errors=True).collect()}
    for r in img.collect():
        if r.img_id % 7 == 0:
            assert not got[r.img_id].ok and "cut short" in got[r.img_id].error
        elif r.img_id % 7 == 1:
            assert not got[r.img_id].ok and "no bytes" in got[r.img_id].error
        else:
            assert got[r.img_id].ok and bytes(got[r.img_id].px) == bytes(r.px) and got[r.img_id].error is None
    # the files agree with Spark's own reader, and with cells that hold paths
    for r in cells.limit(5).collect():
        (tmp_path / f"{r.img_id}.png").write_bytes(bytes(r.image_file.bytes))
    by_source = {r.path.split("/")[-1]: bytes(r.px) for r in SC.read_image_files(spark, str(tmp_path)).collect()}
    paths = spark.createDataFrame([(int(n.split(".")[0]), (None, str(tmp_path / n))) for n in by_source],
                                  "img_id bigint, image_file struct<bytes:binary,path:string>")
    by_path = {f"{r.img_id}.png": bytes(r.px) for r in IM.decode_images(paths, "image_file").collect()}
    assert len(by_source) == 5 and by_source == by_path


def test_a_given_decoder_gets_every_cell(spark):
    cells = spark.createDataFrame([(1, (b"\xff\xd8\xffjpeg", None)), (2, (b"bad", None))], "img_id int, image_file struct<bytes:binary,path:string>")

    def decoder(data):
        if not data.startswith(b"\xff\xd8\xff"):
            raise ValueError("not a JPEG")
        return 1, 1, np.array([[[1, 2, 3]]], np.uint8)

    got = {r.img_id: r for r in IM.decode_images(cells, "image_file", decoder=decoder, errors=True).collect()}
    assert bytes(got[1].px) == bytes([1, 2, 3]) and got[2].error == "not a JPEG"
