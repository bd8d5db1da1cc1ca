"""Sequential Huffman-coded JPEG images of 8 bits: one or three components, any sampling, restart markers.

Coefficients of a whole component are gathered first; scaling, inverse transform,
upsampling and colour are array operations over all blocks at once.
"""

from __future__ import annotations

import struct

import numpy as np

#: Row-major place of each coefficient in the order of the file: along the anti-diagonals, turning at each.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_BASIS = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class _Bits:
    """Bits of an entropy-coded segment, without stuffed bytes; ones after its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def peek16(self) -> int:
        while self.n < 16:
            self.held = (self.held << 8) | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at += 1
            self.n += 8
        return (self.held >> (self.n - 16)) & 0xFFFF

    def skip(self, count: int) -> None:
        self.n -= count
        self.held &= (1 << self.n) - 1

    def symbol(self, table: list[int]) -> int:
        code = table[self.peek16()]
        if not code:
            raise ValueError("broken JPEG: unknown code")
        self.skip(code >> 8)
        return code & 0xFF

    def value(self, size: int) -> int:
        """A signed number of ``size`` bits: the lower half of them is negative."""
        if not size:
            return 0
        raw = self.peek16() >> (16 - size)
        self.skip(size)
        return raw if raw >> (size - 1) else raw - (1 << size) + 1


def _table(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits that may follow: length of the code they begin with, and its symbol; 0 if there is none."""
    found, code, at = [0] * 65536, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            first = code << (16 - length)
            found[first : first + (1 << (16 - length))] = [length << 8 | symbols[at]] * (1 << (16 - length))
            code, at = code + 1, at + 1
        code <<= 1
    return found


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded segments between restart markers from ``at``, and where the next other marker stands."""
    found, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*found, data[start:]], len(data)
        kind = data[at + 1]
        if kind == 0 or kind == 0xFF:
            at += 2 if kind == 0 else 1
        elif 0xD0 <= kind <= 0xD7:
            found.append(data[start:at])
            at = start = at + 2
        else:
            return [*found, data[start:at]], at


def _block(bits: _Bits, dc: list[int], ac: list[int], before: int, out: np.ndarray) -> int:
    """One block's coefficients in file order; returns its first."""
    out[0] = first = before + bits.value(bits.symbol(dc))
    k = 1
    while k < 64:
        run, size = divmod(bits.symbol(ac), 16)
        if size == 0:
            if run != 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("broken JPEG: too many coefficients")
        out[k] = bits.value(size)
        k += 1
    return first


def decode_jpeg(data: bytes) -> np.ndarray:
    """Height x width x 3 RGB bytes of a sequential JPEG; other kinds and broken files raise ValueError."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG image")
    tables: dict[int, list[int]] = {}
    scales: dict[int, np.ndarray] = {}
    parts: list[dict] = []
    at, interval, adobe, height, width = 2, 0, None, 0, 0
    try:
        while at < len(data):
            if data[at] != 0xFF:
                raise ValueError("broken JPEG: marker expected")
            kind = data[at + 1]
            if kind == 0xFF:
                at += 1
                continue
            if kind == 0xD9:
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 128 if wide else 64
                    scales[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
                    body = body[1 + n :]
            elif kind == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = _table(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif kind in (0xC0, 0xC1):
                depth, height, width, count = struct.unpack_from(">BHHB", body)
                if depth != 8 or count not in (1, 3) or not height or not width:
                    raise ValueError("JPEG of an unsupported depth, size or number of components")
                parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "scale": body[8 + 3 * i]} for i in range(count)]
                most_h, most_v = max(p["h"] for p in parts), max(p["v"] for p in parts)
                wide, high = -(-width // (8 * most_h)), -(-height // (8 * most_v))
                for p in parts:
                    # blocks that are stored, and those that a scan of this component alone has
                    p["blocks"] = np.zeros((high * p["v"], wide * p["h"], 64), np.int32)
                    p["own"] = -(-(-(-height * p["v"] // most_v)) // 8), -(-(-(-width * p["h"] // most_h)) // 8)
            elif 0xC2 <= kind <= 0xCF and kind != 0xCC and kind != 0xC8:
                raise ValueError("JPEG is not sequential")
            elif kind == 0xDD:
                interval = struct.unpack(">H", body[:2])[0]
            elif kind == 0xEE and body[:5] == b"Adobe":
                adobe = body[11]
            elif kind == 0xDA:
                named = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                scanned = [p for p in parts if p["id"] in named]
                codes = [(p, tables[named[p["id"]] >> 4], tables[16 + (named[p["id"]] & 15)]) for p in scanned]
                if not codes:
                    raise ValueError("broken JPEG: scan of nothing")
                if len(codes) == 1:
                    rows, columns = scanned[0]["own"]
                    units = [[(0, r, c)] for r in range(rows) for c in range(columns)]
                else:
                    units = [[(i, y * p["v"] + r, x * p["h"] + c) for i, p in enumerate(scanned) for r in range(p["v"]) for c in range(p["h"])] for y in range(high) for x in range(wide)]
                pieces, at = _segments(data, at)
                each = interval or len(units)
                for s, piece in enumerate(pieces[: -(-len(units) // each)]):
                    bits, before = _Bits(piece), [0] * len(codes)
                    for unit in units[s * each : (s + 1) * each]:
                        for i, r, c in unit:
                            p, dc, ac = codes[i]
                            before[i] = _block(bits, dc, ac, before[i], p["blocks"][r, c])
    except (IndexError, KeyError, struct.error) as error:
        raise ValueError("broken JPEG") from error
    if not parts:
        raise ValueError("JPEG without an image")
    planes = []
    for p in parts:
        if p["scale"] not in scales:
            raise ValueError("broken JPEG: no quantisation table")
        rows, columns = p["blocks"].shape[:2]
        square = np.zeros((rows, columns, 64))
        square[..., ZIGZAG] = p["blocks"] * scales[p["scale"]]
        samples = np.einsum("ux,rcuv,vy->rxcy", _BASIS, square.reshape(rows, columns, 8, 8), _BASIS).reshape(rows * 8, columns * 8) + 128
        plane = np.clip(np.rint(samples), 0, 255)
        plane = plane.repeat(most_v // p["v"], axis=0).repeat(most_h // p["h"], axis=1)
        planes.append(plane[:height, :width])
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, axis=2).astype(np.uint8)
    if adobe == 0:
        return np.stack(planes, axis=2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    # The luma weights of red and blue
    red, blue = 0.299, 0.114
    r, b = y + 2 * (1 - red) * cr, y + 2 * (1 - blue) * cb
    g = (y - red * r - blue * b) / (1 - red - blue)
    return np.clip(np.rint(np.stack([r, g, b], axis=2)), 0, 255).astype(np.uint8)
