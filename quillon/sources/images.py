"""Images of records: decoding to RGB, and numbered batches of records.

PNG (8 bits a sample, not interlaced), sequential JPEG and binary PPM are decoded
in numpy; other formats need a decoder of the caller's own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.ordered import numbered
from quillon.sources.jpeg import decode_jpeg

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by PNG colour type: grey, RGB, palette, grey with alpha, RGB with alpha.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def encode_png(rgb: np.ndarray) -> bytes:
    """A height x width x 3 tensor of bytes as PNG."""
    height, width = rgb.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), rgb.reshape(height, 3 * width)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of samples from filtered scan lines."""
    lines = np.frombuffer(raw, np.uint8)[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.uint8)  # a row of zeros above the first
    for y, line in enumerate(lines):
        kind, row, above = int(line[0]), line[1:].copy(), out[y]
        if kind == 1:  # each sample adds the one a pixel before: a running sum for each sample of the pixel
            for s in range(step):
                row[s::step] = np.cumsum(row[s::step], dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            left, corner = [0] * step, [0] * step
            up, values = above.tolist(), row.tolist()
            for i, v in enumerate(values):
                a, b, c = left[i % step], up[i], corner[i % step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
                values[i] = left[i % step] = (v + guess) & 255
                corner[i % step] = b
            row = np.array(values, np.uint8)
        elif kind:
            raise ValueError("unknown PNG filter")
        out[y + 1] = row
    return out[1:]


def decode_png(data: bytes) -> np.ndarray:
    at, body, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
    if head is None or head[2] != 8 or head[3] not in _SAMPLES or head[6]:
        raise ValueError("only PNG of 8 bits a sample that is not interlaced")
    width, height, step = head[0], head[1], _SAMPLES[head[3]]
    pixels = _unfilter(zlib.decompress(body), height, width * step, step).reshape(height, width, step)
    if head[3] == 3:
        return palette[pixels[:, :, 0]]
    return pixels[:, :, :3].copy() if step >= 3 else np.repeat(pixels[:, :, :1], 3, axis=2)


def decode_ppm(data: bytes) -> np.ndarray:
    fields = data.split(maxsplit=4)
    width, height, most = int(fields[1]), int(fields[2]), int(fields[3])
    if most != 255:
        raise ValueError("only PPM of 8 bits a sample")
    return np.frombuffer(data[len(data) - 3 * width * height :], np.uint8).reshape(height, width, 3).copy()


def decode_rgb(data: bytes) -> np.ndarray:
    """A height x width x 3 tensor of bytes; ValueError for what is not known or damaged."""
    try:
        if data.startswith(_SIGNATURE):
            return decode_png(data)
        if data.startswith(b"\xff\xd8"):
            return decode_jpeg(data)
        if data.startswith(b"P6"):
            return decode_ppm(data)
    except (struct.error, zlib.error, IndexError, TypeError) as e:
        raise ValueError("damaged image") from e
    raise ValueError("unknown image format")


def with_rgb(df: DataFrame, content: str, transform: Callable[[np.ndarray], np.ndarray] | None = None, decode: Callable[[bytes], np.ndarray] = decode_rgb) -> DataFrame:
    """``df`` with height, width, rgb and image_error of the images in ``content``, each through ``transform``; batches stay in order."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = df.columns.index(content)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for value in batch.column(at):
                if not value.is_valid:
                    rows.append((None, None, None, None))
                    continue
                try:
                    rgb = decode(value.as_py())
                    rgb = transform(rgb) if transform else rgb
                    rows.append((*rgb.shape[:2], rgb.tobytes(), None))
                except ValueError as error:
                    rows.append((None, None, None, str(error)))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())
            added = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else ((),) * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "height", "width", "rgb", "image_error"])

    return df.mapInArrow(run, f"{schema}, height int, width int, rgb binary, image_error string")


def record_batches(df: DataFrame, order: str, size: int, drop_last: bool = False) -> DataFrame:
    """(batch, rows): the rows in the order of a number, ``size`` to a batch; the last may be shorter, or is dropped."""
    placed = numbered(df, order, "_place").withColumn("batch", F.floor(F.col("_place") / size).cast("long"))
    batches = placed.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("_place", *df.columns))).alias("rows"))  # at most ``size`` rows
    batches = batches.withColumn("rows", F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in df.columns])))
    return batches.filter(F.size("rows") == size) if drop_last else batches


def collate(batches: DataFrame, columns: list[str]) -> DataFrame:
    """Batches with an array for each column instead of an array of rows."""
    column = lambda c: F.transform("rows", lambda r: r[c]).alias(c)
    return batches.select("batch", *map(column, columns))
