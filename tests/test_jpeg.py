"""Sequential JPEG against pixels computed straight from the coefficients that were written."""

import math
import random
import struct

import numpy as np
import pytest

from quillon.sources import images
from quillon.sources.jpeg import ZIGZAG, decode_jpeg


class Writer:
    """Bits with stuffed bytes; all codes of a table have one length, the symbols are in order."""

    def __init__(self):
        self.bits = ""

    def code(self, symbols, symbol, length):
        self.bits += format(symbols.index(symbol), f"0{length}b")

    def value(self, v):
        size = abs(v).bit_length()
        if size:
            self.bits += format(v if v > 0 else v + (1 << size) - 1, f"0{size}b")

    def done(self):
        self.bits += "1" * (-len(self.bits) % 8)
        return b"".join(bytes([int(self.bits[i : i + 8], 2)]).replace(b"\xff", b"\xff\x00") for i in range(0, len(self.bits), 8))


DC, AC = list(range(12)), [0x00, 0xF0] + [16 * r + s for r in range(16) for s in range(1, 11)]


def block(out, coefficients, before):
    """Zigzag coefficients of a block."""
    out.code(DC, abs(coefficients[0] - before).bit_length(), 4)
    out.value(coefficients[0] - before)
    run, last = 0, max((i for i in range(1, 64) if coefficients[i]), default=0)
    for c in coefficients[1 : last + 1]:
        if c == 0:
            run += 1
            continue
        while run > 15:
            out.code(AC, 0xF0, 8)
            run -= 16
        out.code(AC, 16 * run + abs(c).bit_length(), 8)
        out.value(c)
        run = 0
    if last < 63:
        out.code(AC, 0x00, 8)
    return coefficients[0]


def segment(kind, body):
    return bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body


def encode(width, height, parts, scale, restart=0, apart=False):
    """A file of parts (h, v, blocks[row][column] of zigzag coefficients); ``apart``: a scan for each part."""
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0" + bytes(9)) + segment(0xDB, b"\0" + bytes(scale))
    head += segment(0xC0, struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([i + 1, 16 * h + v, 0]) for i, (h, v, _) in enumerate(parts)))
    head += segment(0xC4, b"\0" + bytes([0, 0, 0, len(DC), *[0] * 12]) + bytes(DC)) + segment(0xC4, b"\x10" + bytes([*[0] * 7, len(AC), *[0] * 8]) + bytes(AC))
    head += segment(0xDD, struct.pack(">H", restart)) if restart else b""
    most_h, most_v = max(p[0] for p in parts), max(p[1] for p in parts)
    high, wide = -(-height // (8 * most_v)), -(-width // (8 * most_h))
    for scan in [[i] for i in range(len(parts))] if apart else [list(range(len(parts)))]:
        head += segment(0xDA, bytes([len(scan)]) + b"".join(bytes([i + 1, 0]) for i in scan) + bytes([0, 63, 0]))
        if len(scan) == 1:
            h, v, _ = parts[scan[0]]
            rows, columns = -(-(-(-height * v // most_v)) // 8), -(-(-(-width * h // most_h)) // 8)
            units = [[(scan[0], r, c)] for r in range(rows) for c in range(columns)]
        else:
            units = [[(i, y * parts[i][1] + r, x * parts[i][0] + c) for i in scan for r in range(parts[i][1]) for c in range(parts[i][0])] for y in range(high) for x in range(wide)]
        for n, at in enumerate(range(0, len(units), restart or len(units))):
            head += bytes([0xFF, 0xD0 + (n - 1) % 8]) if n else b""
            out, before = Writer(), dict.fromkeys(scan, 0)
            for unit in units[at : at + (restart or len(units))]:
                for i, r, c in unit:
                    before[i] = block(out, parts[i][2][r][c], before[i])
            head += out.done()
    return head + b"\xff\xd9"


def plane(blocks, scale):
    """Samples by the formula of the inverse transform, one by one."""
    out = np.zeros((8 * len(blocks), 8 * len(blocks[0])))
    for r, line in enumerate(blocks):
        for c, coefficients in enumerate(line):
            square = {divmod(int(ZIGZAG[k]), 8): coefficients[k] * scale[k] for k in range(64) if coefficients[k]}
            for y in range(8):
                for x in range(8):
                    total = sum((math.sqrt(0.5) if u == 0 else 1) * (math.sqrt(0.5) if v == 0 else 1) * s * math.cos((2 * y + 1) * u * math.pi / 16) * math.cos((2 * x + 1) * v * math.pi / 16) for (u, v), s in square.items())
                    out[8 * r + y, 8 * c + x] = total / 4 + 128
    return np.clip(np.rint(out), 0, 255)


def make(rng, width, height, shape):
    most_h, most_v = max(h for h, _ in shape), max(v for _, v in shape)
    parts = []
    for h, v in shape:
        rows, columns = -(-height // (8 * most_v)) * v, -(-width // (8 * most_h)) * h
        blocks = [[[rng.randint(-60, 60)] + [rng.choice([0, 0, 0, 0, 0, 0, rng.randint(-9, 9)]) if rng.random() < 0.5 else 0 for _ in range(63)] for _ in range(columns)] for _ in range(rows)]
        parts.append((h, v, blocks))
    return parts


def expected(parts, scale, width, height):
    most_h, most_v = max(p[0] for p in parts), max(p[1] for p in parts)
    planes = [plane(b, scale).repeat(most_v // v, axis=0).repeat(most_h // h, axis=1)[:height, :width] for h, v, b in parts]
    if len(planes) == 1:
        return np.stack(planes * 3, axis=2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)), 0, 255)


@pytest.mark.parametrize("shape", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 1)]])
@pytest.mark.parametrize(("restart", "apart"), [(0, False), (2, False), (3, True)])
def test_pixels(shape, restart, apart):
    rng = random.Random(str((shape, restart)))
    scale = [rng.randint(1, 12) for _ in range(64)]
    for width, height in ((16, 16), (37, 21), (5, 3)):
        parts = make(rng, width, height, shape)
        if apart:  # blocks beyond the edge are not written in a scan of one component
            most_h, most_v = max(h for h, _ in shape), max(v for _, v in shape)
            for h, v, blocks in parts:
                rows, columns = -(-(-(-height * v // most_v)) // 8), -(-(-(-width * h // most_h)) // 8)
                for r, line in enumerate(blocks):
                    for c in range(len(line)):
                        line[c] = line[c] if r < rows and c < columns else [0] * 64
        data = encode(width, height, parts, scale, restart, apart)
        got = decode_jpeg(data)
        assert got.shape == (height, width, 3) and np.abs(got.astype(int) - expected(parts, scale, width, height)).max() <= 1


def test_other_and_broken_files_raise():
    rng = random.Random(2)
    data = encode(24, 24, make(rng, 24, 24, [(1, 1)] * 3), [3] * 64)
    for bad in (data[:40], b"\xff\xd8", data.replace(b"\xff\xc0", b"\xff\xc2", 1), data.replace(b"\xff\xdb", b"\xff\xe1", 1), data[:2] + b"no marker" + data[2:]):
        with pytest.raises(ValueError):
            images.decode_rgb(bad)
    assert images.decode_rgb(data).shape == (24, 24, 3)
    for at in range(0, len(data), 7):  # damage gives an image or a ValueError, nothing else
        damaged = data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]
        try:
            images.decode_rgb(damaged)
        except ValueError:
            pass


def test_in_a_table(spark):
    rng = random.Random(3)
    parts = make(rng, 20, 9, [(2, 2), (1, 1), (1, 1)])
    data = encode(20, 9, parts, [2] * 64)
    rows = images.with_rgb(spark.createDataFrame([(1, data), (2, data[:50]), (3, None)], "id long, content binary"), "content").orderBy("id").collect()
    assert (rows[0].height, rows[0].width, rows[0].image_error) == (9, 20, None) and rows[1].image_error and rows[2].rgb is None
    assert np.abs(np.frombuffer(rows[0].rgb, np.uint8).reshape(9, 20, 3).astype(int) - expected(parts, [2] * 64, 20, 9)).max() <= 1
