"""Media columns as progressive JPEG, decoded to full-resolution RGB tensors.

``decode`` reads progressive JPEG (Huffman, 8 bits, any sampling factors): every
scan, be it a spectral selection or a successive approximation, accumulates into
coefficient arrays; these are dequantised and inverse-transformed in numpy,
chroma is upsampled, and the result is an RGB tensor. A scan is first decoded
by stride: where all codes that may occur have one total length (code and value
bits), all symbols are looked up at once, and the result counts only if every
symbol was of that kind; a refinement scan whose coefficients are all non-zero
is a run of correction bits. Any other scan goes through the bit-by-bit decoder.

``encode`` stores bytes losslessly in the format's own unit, the quantised
coefficient: 64 bytes are a block's coefficients in zigzag order, 6 blocks a
16 x 16 pixel unit with halved chroma. A byte maps to a coefficient of magnitude
2 to 129, so none is ever zero and the Huffman codes can be chosen so that a
stride exists. Payloads over 1.5 MB take several frames one after the other,
which bounds the memory of a task at a few frames.

Cases: null and empty texts become one padded unit; equal texts have equal media;
a null medium has null digests and no tensor; other than progressive Huffman
JPEG, an empty, truncated or damaged one raises ValueError; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

UNIT = 192
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: Units (16 x 16 pixels, 384 payload bytes) across and down a frame at most.
FRAME_UNITS = 64
_LOW_BAND = 5  # the first spectral selection ends here

# ---- constants of the format -------------------------------------------------


def _zigzag() -> np.ndarray:
    """Place in the 8 x 8 block of the k-th coefficient of the zigzag order."""
    walk = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * y + x for y, x in walk])


ZIGZAG = _zigzag()


def _inverse_dct() -> np.ndarray:
    """64 coefficients in zigzag order to 64 samples, as a matrix."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    return np.einsum("yv,xu->vuyx", one, one).reshape(64, 64)[ZIGZAG]


_IDCT = _inverse_dct()
_ENTROPY_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)

# ---- bytes as coefficients ---------------------------------------------------

_BYTE = np.arange(256)
#: 0..127 to -129..-2, 128..255 to 2..129.
COEFFICIENT = np.where(_BYTE < 128, _BYTE - 129, _BYTE - 126).astype(np.int16)
_TO_BYTE = np.zeros(260, np.uint8)
_TO_BYTE[COEFFICIENT.astype(int) + 130] = _BYTE


def _bit_length(v: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(v).astype(float) + 1)).astype(int)


def _strided_codes(values: np.ndarray, total: int) -> np.ndarray:
    """Code and value bits of each value as one number of ``total`` bits: longer values have shorter codes."""
    size = _bit_length(values)
    extra = np.where(values < 0, values + (1 << size) - 1, values)
    ones = total - size - 1  # the code is so many ones and a zero
    return (((1 << ones) - 1) << (size + 1)) | extra


_AC_BITS, _DC_BITS = 8, 9
_AC_CODE = _strided_codes(np.sign(COEFFICIENT).astype(int) * (np.abs(COEFFICIENT.astype(int)) >> 1), _AC_BITS).astype(np.uint8)
_AC_LOW_BIT = (np.abs(COEFFICIENT) & 1).astype(np.uint8)
_DC_HIGH = (COEFFICIENT >> 1).astype(np.int16)
_DC_LOW_BIT = (COEFFICIENT & 1).astype(np.uint8)
_DC_CODE = _strided_codes(np.arange(-129, 130), _DC_BITS).astype(np.uint16)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _huffman_segment(kind: int, symbols: list[int]) -> bytes:
    """A table with one code for each length from 1 on."""
    return _segment(0xC4, bytes([kind]) + bytes([1] * len(symbols) + [0] * (16 - len(symbols))) + bytes(symbols))


_AC_TABLE = _huffman_segment(0x10, [7, 6, 5, 4, 3, 2, 1, 0])
_DC_TABLE = _huffman_segment(0x00, [8, 7, 6, 5, 4, 3, 2, 1, 0])
_QUANT = b"".join(_segment(0xDB, bytes([t]) + bytes([1] * 64)) for t in (0, 1))


def _packed(bits: np.ndarray) -> bytes:
    """Bits as entropy-coded data: filled up with ones, 0xFF escaped."""
    fill = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(fill, np.uint8)]) if fill else bits).tobytes().replace(b"\xff", b"\xff\x00")


def _scan(components: list[int], first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([len(components)]) + b"".join(bytes([c + 1, 0]) for c in components) + bytes([first, last, high << 4 | low])) + data


def _in_units(y: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Luma values in block raster order, in the order of units (rows x cols) of 2 x 2 blocks."""
    return y.reshape(rows, 2, cols, 2).transpose(0, 2, 1, 3).reshape(-1, 4)


def _encode_frame(payload: bytes) -> bytes:
    units = -(-len(payload) // 384)
    rows = -(-units // FRAME_UNITS)
    cols = -(-units // rows)
    n = rows * cols
    blocks = np.frombuffer(payload.ljust(384 * n, b" "), np.uint8).reshape(-1, 64)
    parts = [blocks[: 4 * n], blocks[4 * n : 5 * n], blocks[5 * n :]]
    frame = bytes([8]) + (16 * rows).to_bytes(2, "big") + (16 * cols).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _QUANT, _segment(0xC2, frame), _DC_TABLE, _AC_TABLE]

    high = [_DC_HIGH[p[:, 0]] for p in parts]
    luma = _in_units(high[0], rows, cols)
    steps = np.empty((n, 6), np.int32)
    steps[:, :4] = np.diff(luma.ravel(), prepend=0).reshape(-1, 4)
    steps[:, 4], steps[:, 5] = np.diff(high[1], prepend=0), np.diff(high[2], prepend=0)
    codes = _DC_CODE[steps.ravel() + 129].astype(">u2")
    out.append(_scan([0, 1, 2], 0, 0, 0, 1, _packed(np.unpackbits(codes.view(np.uint8)).reshape(-1, 16)[:, 16 - _DC_BITS :].ravel())))
    for c, part in enumerate(parts):
        coded = _AC_CODE[part]
        out.append(_scan([c], 1, _LOW_BAND, 0, 1, coded[:, 1 : _LOW_BAND + 1].tobytes()))
        out.append(_scan([c], _LOW_BAND + 1, 63, 0, 1, coded[:, _LOW_BAND + 1 :].tobytes()))
    for c, part in enumerate(parts):
        run = len(part).bit_length() - 1  # one end-of-band run over all blocks
        head = np.array([0, *(len(part) - (1 << run) >> i & 1 for i in reversed(range(run)))], np.uint8)
        out += [_huffman_segment(0x10, [run << 4]), _scan([c], 1, 63, 1, 0, _packed(np.concatenate([head, _AC_LOW_BIT[part[:, 1:]].ravel()])))]
    low = [_DC_LOW_BIT[p[:, 0]] for p in parts]
    out.append(_scan([0, 1, 2], 0, 0, 1, 0, _packed(np.concatenate([_in_units(low[0], rows, cols), low[1][:, None], low[2][:, None]], axis=1).ravel())))
    return b"".join([*out, b"\xff\xd9"])


def encode(payload: bytes) -> bytes:
    """One or more progressive JPEG frames whose coefficients are ``payload``."""
    most = 384 * FRAME_UNITS * FRAME_UNITS
    return b"".join(_encode_frame(payload[i : i + most]) for i in range(0, len(payload), most))


# ---- decoding ----------------------------------------------------------------


@lru_cache(64)
def _codes(table: bytes) -> dict[tuple[int, int], int]:
    """Symbol by (length, code) of a table segment's body (16 counts, then symbols)."""
    out, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out[length, code] = table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(64)
def _stride(table: bytes) -> tuple[int, np.ndarray, np.ndarray] | None:
    """(total bits, value, valid) by what those bits hold, if symbols without a zero run have one total length."""
    found = {(n, c): s for (n, c), s in _codes(table).items() if s >> 4 == 0}
    totals = {n + s for (n, _), s in found.items() if s}
    if len(totals) != 1 or (total := totals.pop()) > 16:
        return None
    value, valid = np.zeros(1 << total, np.int32), np.zeros(1 << total, bool)
    for (n, code), size in found.items():
        if n + size == total:
            extra = np.arange(1 << size)
            at = (code << size) + extra
            value[at] = np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra) if size else 0
            valid[at] = True
    return total, value, valid


class Component:
    def __init__(self, ident: int, h: int, v: int, quant: int):
        self.ident, self.h, self.v, self.quant = ident, h, v, quant


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0

    def read(self, n: int) -> int:
        value = 0
        for bit in self.bits[self.at : self.at + n]:
            value = 2 * value + bit
        self.at += n
        return value

    def symbol(self, codes: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = 2 * code + self.read(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such Huffman code")

    def signed(self, size: int) -> int:
        value = self.read(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


class Frame:
    """Coefficient arrays of one progressive frame, filled scan by scan."""

    def __init__(self, body: bytes):
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        if body[0] != 8 or not self.height or not self.width:
            raise ValueError("only 8-bit frames of known size")
        self.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        self.h_max, self.v_max = max(c.h for c in self.components), max(c.v for c in self.components)
        self.rows, self.cols = -(-self.height // (8 * self.v_max)), -(-self.width // (8 * self.h_max))
        for c in self.components:
            c.blocks = np.zeros((self.rows * c.v, self.cols * c.h, 64), np.int32)
            c.used = (-(-(-(-self.height * c.v // self.v_max)) // 8), -(-(-(-self.width * c.h // self.h_max)) // 8))

    def _order(self, parts: list[Component]) -> list[tuple[Component, np.ndarray]]:
        """The scan's blocks: (component, flat block numbers in scan order)."""
        out = []
        for c in parts:
            number = np.arange(c.blocks.shape[0] * c.blocks.shape[1]).reshape(c.blocks.shape[:2])
            if len(parts) == 1:
                out.append((c, number[: c.used[0], : c.used[1]].ravel()))
            else:
                out.append((c, number.reshape(self.rows, c.v, self.cols, c.h).transpose(0, 2, 1, 3).reshape(-1, c.v * c.h)))
        return out

    def scan(self, parts: list[Component], tables: list[tuple[bytes | None, bytes | None]], first: int, last: int, high: int, low: int, data: bytes, restart: int) -> None:
        order = self._order(parts)
        if not restart and self._strided(order, tables, first, last, high, low, data):
            return
        self._bit_by_bit(order, tables, first, last, high, low, data, restart)

    def _strided(self, order, tables, first, last, high, low, data) -> bool:
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)
        if first == 0:
            widths = [n.shape[1] if n.ndim == 2 else 1 for _, n in order]
            units, width = len(order[0][1]), sum(widths)
            if high:
                if 8 * len(raw) < units * width:
                    return False
                got = np.unpackbits(raw, count=units * width).astype(np.int32).reshape(units, width) << low
            else:
                strides = {t[0] for t in tables}
                if len(strides) != 1 or not (stride := _stride(strides.pop())) or (got := self._lookup(raw, units * width, stride)) is None:
                    return False
                got = got.reshape(units, width)
            at = 0
            for (c, numbers), n in zip(order, widths, strict=True):
                values, flat = got[:, at : at + n], c.blocks.reshape(-1, 64)
                if high:
                    flat[numbers.ravel(), 0] |= values.ravel()
                else:
                    flat[numbers.ravel(), 0] = np.cumsum(values.ravel()) << low
                at += n
            return True
        (c, numbers), table, width = order[0], tables[0][1], last - first + 1
        flat = c.blocks.reshape(-1, 64)
        whole = len(numbers) == len(flat)
        if not high:
            if not (stride := _stride(table)) or (got := self._lookup(raw, len(numbers) * width, stride)) is None or not got.all():
                return False
            got = got.reshape(-1, width) << low if low == 0 else np.sign(got.reshape(-1, width)) * (np.abs(got.reshape(-1, width)) << low)
            if whole:
                flat[:, first : last + 1] = got
            else:
                flat[numbers, first : last + 1] = got
            return True
        now = flat[:, first : last + 1] if whole else flat[numbers, first : last + 1]
        if not now.all():
            return False
        head = _Bits(raw[:8].tobytes())
        run = head.symbol(_codes(table))
        if run & 15 or run >> 4 == 15 or (1 << (run >> 4)) + head.read(run >> 4) != len(numbers) or 8 * len(raw) < head.at + now.size:
            return False
        bits = np.unpackbits(raw, count=head.at + now.size)[head.at :].reshape(now.shape).astype(np.int32) << low
        flat[numbers if not whole else slice(None), first : last + 1] = now + np.sign(now) * (bits & ~np.abs(now))
        return True

    @staticmethod
    def _lookup(raw: np.ndarray, count: int, stride) -> np.ndarray | None:
        total, value, valid = stride
        if 8 * len(raw) < total * count:
            return None
        if total == 8:
            at = raw[:count]
        else:
            bits = np.zeros((count, 16), np.uint8)
            bits[:, 16 - total :] = np.unpackbits(raw, count=total * count).reshape(count, total)
            at = np.packbits(bits.ravel()).view(">u2")
        return value[at] if valid[at].all() else None

    def _bit_by_bit(self, order, tables, first, last, high, low, data, restart) -> None:
        parts = re.split(rb"\xff[\xd0-\xd7]", data) if restart else [data]
        units = len(order[0][1])
        per = restart or units
        for i, part in enumerate(parts):
            bits, last_dc, run = _Bits(part.replace(b"\xff\x00", b"\xff")), [0] * len(order), 0
            for unit in range(i * per, min(units, (i + 1) * per)):
                for k, (c, numbers) in enumerate(order):
                    flat = c.blocks.reshape(-1, 64)
                    for number in np.atleast_1d(numbers[unit]).tolist():
                        block = flat[number]
                        if first:
                            run = (self._refine if high else self._band)(bits, _codes(tables[k][1]), block, first, last, low, run)
                        elif high:
                            block[0] |= bits.read(1) << low
                        else:
                            last_dc[k] += bits.signed(bits.symbol(_codes(tables[k][0])))
                            block[0] = last_dc[k] << low

    @staticmethod
    def _band(bits, codes, block, first, last, low, run) -> int:
        if run:
            return run - 1
        k = first
        while k <= last:
            zeros, size = divmod(bits.symbol(codes), 16)
            if size:
                k += zeros
                value = bits.signed(size)
                block[k] = value * (1 << low)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                return (1 << zeros) + bits.read(zeros) - 1
        return 0

    @staticmethod
    def _refine(bits, codes, block, first, last, low, run) -> int:
        one, k = 1 << low, first

        def correct(k: int) -> None:
            if bits.read(1) and not abs(int(block[k])) & one:
                block[k] += one if block[k] > 0 else -one

        while not run and k <= last:
            zeros, size = divmod(bits.symbol(codes), 16)
            new = 0
            if size:
                new = one if bits.read(1) else -one
            elif zeros < 15:
                run = (1 << zeros) + bits.read(zeros)
                break
            while k <= last:
                if block[k]:
                    correct(k)
                elif zeros:
                    zeros -= 1
                else:
                    block[k] = new
                    k += 1
                    break
                k += 1
        if run:
            for at in range(k, last + 1):
                if block[at]:
                    correct(at)
            run -= 1
        return run

    def rgb(self, quants: dict[int, np.ndarray]) -> np.ndarray:
        """The frame as a tensor of height x width x 3 bytes."""
        planes = []
        for c in self.components:
            down, across = c.blocks.shape[:2]
            samples = (c.blocks.reshape(-1, 64) * quants[c.quant]).astype(np.float64) @ _IDCT + 128.0
            plane = np.clip(np.rint(samples), 0, 255).astype(np.float32).reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * down, 8 * across)
            for axis, (most, mine, size) in enumerate(((self.v_max, c.v, self.height), (self.h_max, c.h, self.width))):
                if most % mine:  # such as 3:2
                    plane = plane.take(np.arange(size) * mine // most, axis=axis)
                elif most > mine:
                    plane = np.repeat(plane, most // mine, axis=axis)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, axis=2)
        if len(planes) != 3:
            raise ValueError("only grey and YCbCr frames")
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        out = np.empty((self.height, self.width, 3), np.uint8)
        for i, channel in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
            out[:, :, i] = np.clip(np.rint(channel), 0, 255)
        return out


def frames(media: bytes) -> Iterator[tuple[Frame, dict[int, np.ndarray], int]]:
    """(frame, quantisation tables, stored payload bytes or 0) of each JPEG in ``media``."""
    complete = _segments(media)
    while True:
        try:
            frame, quants, payload = next(complete)
        except StopIteration:
            return
        except (IndexError, KeyError, AttributeError, TypeError, ZeroDivisionError) as e:  # reads past an end, or what should come first is missing
            raise ValueError("truncated or damaged JPEG") from e
        if frame is None or not all(c.quant in quants for c in frame.components):
            raise ValueError("JPEG without a frame or its quantisation tables")
        yield frame, quants, payload


def _segments(media: bytes) -> Iterator[tuple[Frame | None, dict[int, np.ndarray], int]]:
    if not media:
        raise ValueError("no JPEG")
    at, frame, quants, huffman, restart, payload = 0, None, {}, {}, 0, 0
    ended = False
    while at < len(media):
        marker = media[at + 1]
        if media[at] != 0xFF:
            raise ValueError("no marker where one belongs")
        at += 2
        if marker == 0xD8:
            ended = False
            frame, quants, huffman, restart, payload = None, {}, {}, 0, 0
        elif marker == 0xD9:
            ended = True
            yield frame, quants, payload
        elif marker != 0xFF:
            end = at + int.from_bytes(media[at : at + 2], "big")
            body = media[at + 2 : end]
            at = end
            if marker == 0xC2:
                frame = Frame(body)
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a progressive Huffman JPEG")
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    huffman[body[0]], body = body[1:n], body[n:]
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 1 + 64 * (1 + wide)
                    quants[body[0] & 15], body = np.frombuffer(body[1:n], ">u2" if wide else "u1").astype(np.int32), body[n:]
            elif marker == 0xDD:
                restart = int.from_bytes(body, "big")
            elif marker == 0xFE and body.startswith(b"payload "):
                payload = int(body[8:])
            elif marker == 0xDA:
                ids = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                parts = [c for c in frame.components if c.ident in ids]
                tables = [(huffman.get(ids[c.ident] >> 4), huffman.get(0x10 | ids[c.ident] & 15)) for c in parts]
                first, last, shift = body[-3:]
                stop = _ENTROPY_END.search(media, at)
                data, at = media[at : stop.start() if stop else len(media)], stop.start() if stop else len(media)
                frame.scan(parts, tables, first, last, shift >> 4, shift & 15, data, restart)
        else:
            at -= 1
    if not ended:
        raise ValueError("JPEG without an end")


def stored_payload(frame: Frame, n: int) -> bytes:
    """The bytes that ``encode`` put into the frame's coefficients."""
    return b"".join(_TO_BYTE[c.blocks.reshape(-1) + 130].tobytes() for c in frame.components)[:n]


def decode(media: bytes) -> list[np.ndarray]:
    """The RGB tensors of all frames."""
    return [frame.rgb(quants) for frame, quants, _ in frames(media)]


# ---- columns -----------------------------------------------------------------

#: Rows that a task holds at once.
_ROWS = 256


def _in_slices(batches: Iterator) -> Iterator:
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS):
            yield batch.slice(i, _ROWS)


def store_texts(df: DataFrame) -> DataFrame:
    """``df(doc_id, text)`` as doc_id, n_bytes, media (progressive JPEG of the padded text)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in _in_slices(batches):
            texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]
            media = [encode(t + b" " * (UNIT - len(t) % UNIT if len(t) % UNIT or not t else 0)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def to_tensors(df: DataFrame) -> DataFrame:
    """``df(doc_id, media)`` as doc_id, frame, height, width, rgb: one row for each decoded frame."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in _in_slices(batches):
            for doc, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for i, t in enumerate(decode(media.as_py()) if media.is_valid else []):
                    yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), *(pa.array([v], pa.int32()) for v in (i, *t.shape[:2])), pa.array([t.tobytes()], pa.binary())], names=["doc_id", "frame", "height", "width", "rgb"])

    return df.select("doc_id", "media").mapInArrow(run, "doc_id long, frame int, height int, width int, rgb binary")



def describe(df: DataFrame) -> DataFrame:
    """``df(doc_id, n_bytes, media)`` read back: digests of the payload and of the media, and a feature of the pixels.

    The feature is the number of frames and pixels, the mean of each channel and
    the CRC-32 of all tensors.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in _in_slices(batches):
            rows = []
            for doc, n, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                media = value.as_py()
                if media is None:
                    rows.append((doc, n, *[None] * 6))
                    continue
                payload, count, pixels, sums, crc = [], 0, 0, np.zeros(3), 0
                for frame, quants, size in frames(media):
                    payload.append(stored_payload(frame, size))
                    tensor = frame.rgb(quants)
                    count, pixels, sums = count + 1, pixels + tensor.shape[0] * tensor.shape[1], sums + tensor.reshape(-1, 3).sum(axis=0)
                    crc = zlib.crc32(tensor, crc)
                stored = b"".join(payload)
                mean = ",".join(f"{s / pixels:.3f}" for s in sums)
                rows.append((doc, n, len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"frames={count} pixels={pixels} mean={mean} crc={crc:08x}"))
            names, types = zip(*(c.split() for c in FEATURES.split(", ")), strict=True)
            arrays = [pa.array(c, pa.int64() if t == "long" else pa.string()) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=list(names))

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)
