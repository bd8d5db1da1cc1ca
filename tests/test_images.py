"""Image decoding, batches, figures."""

import base64
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.sources import images, sinks


def filtered_png(pixels: np.ndarray, kind: int, colour: int, extra: bytes = b"") -> bytes:
    """A PNG whose rows all have one filter, made by the format's own definition, byte by byte."""
    height, width, step = pixels.shape
    rows, above = b"", [0] * (width * step)
    for row in pixels.reshape(height, -1).tolist():
        out = []
        for i, v in enumerate(row):
            a, b, c = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            p = a + b - c
            nearest = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((v - (0, a, b, (a + b) // 2, nearest)[kind]) % 256)
        rows, above = rows + bytes([kind, *out]), row
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize(("colour", "step"), [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_filters_and_colours(kind, colour, step):
    pixels = np.random.default_rng(kind).integers(0, 256, (7, 5, step), dtype=np.uint8)
    rgb = images.decode_rgb(filtered_png(pixels, kind, colour))
    assert (rgb == (pixels[:, :, :3] if step >= 3 else np.repeat(pixels[:, :, :1], 3, axis=2))).all()


def test_palette_ppm_and_damage():
    palette = bytes(range(30))
    chunk = struct.pack(">I", 30) + b"PLTE" + palette + struct.pack(">I", zlib.crc32(b"PLTE" + palette))
    index = np.arange(10, dtype=np.uint8).reshape(2, 5, 1)
    assert (images.decode_rgb(filtered_png(index, 0, 3, chunk)) == np.frombuffer(palette, np.uint8).reshape(2, 5, 3)).all()
    assert images.decode_rgb(b"P6 2 1 255\n" + bytes(range(6))).tolist() == [[[0, 1, 2], [3, 4, 5]]]
    whole = images.encode_png(np.zeros((3, 3, 3), np.uint8))
    for bad in (b"", b"GIF89a", whole[:20], whole[:50], b"\x89PNG\r\n\x1a\n"):
        with pytest.raises(ValueError):
            images.decode_rgb(bad)


def test_images_of_rows(spark):
    rgb = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    df = spark.createDataFrame([(1, images.encode_png(rgb)), (2, None), (3, b"nothing")], "i long, content binary")
    rows = {r.i: r for r in images.with_rgb(df, "content", lambda x: x[:, :2]).collect()}
    assert (rows[1].height, rows[1].width, bytes(rows[1].rgb)) == (2, 2, rgb[:, :2].tobytes())
    assert rows[2].rgb is None and rows[2].image_error is None and rows[3].image_error == "unknown image format"


def test_batches(spark):
    df = spark.range(0, 50, 5).withColumn("x", F.col("id") * 2).repartition(3)
    rows = sorted((r.batch, [x.id for x in r.rows]) for r in images.record_batches(df, "id", 4).collect())
    assert rows == [(0, [0, 5, 10, 15]), (1, [20, 25, 30, 35]), (2, [40, 45])]
    whole = images.collate(images.record_batches(df, "id", 4, drop_last=True), ["x"]).collect()
    assert sorted((r.batch, r.x) for r in whole) == [(0, [0, 10, 20, 30]), (1, [40, 50, 60, 70])]
    assert images.record_batches(df.filter("id < 0"), "id", 4).count() == 0


def test_figures():
    matrix = sinks.matrix_svg(3, 1, 0, 4)
    assert ">3</text>" in matrix and "false negative" in matrix
    assert base64.b64decode(sinks.svg_url(matrix).split(",")[1]).decode() == matrix
    curve = sinks.curve_svg([(0.0, 0.0), (0.5, 1.0)], "A & B", diagonal=True)
    assert "A &amp; B" in curve and curve.count("polyline") == 2 and "150.0,20.0" in curve


def test_sample_report_file(spark, tmp_path):
    rows = spark.createDataFrame([(2, "/run/i.png", "<b>", None), (1, None, None, None)], "sample_index long, image_path string, headline string, best_qa_per_chain array<struct<question: string, answer: string>>")
    rows = rows.withColumns({"judgement": F.struct(F.lit("Uncertain").alias("label"), F.lit(None).cast("double").alias("confidence")), "relevancy": F.struct(F.lit("true").alias("aligned")), "visual_veracity": F.struct(F.lit(None).cast("boolean").alias("ai_generated"))})
    sinks.write_sample_report(rows, str(tmp_path / "html/r.html"), "Run & more")
    page = (tmp_path / "html/r.html").read_text()
    assert "Run &amp; more" in page and "&lt;b&gt;" in page and page.index("<td>1</td>") < page.index("<td>2</td>")


def test_snapshot():
    from pathlib import Path

    assert sinks.snapshot({"a": Path("/x"), "b": (1, [Path("y")], {"c": (True, None)}), "gone": 1}, frozenset({"gone"})) == {"a": "/x", "b": [1, ["y"], {"c": [True, None]}]}
