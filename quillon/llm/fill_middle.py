"""Fill-in-the-middle: cut texts at two seeded unit boundaries by overlapping chunks.

A unit is a line with its line feed (the last may have none). A unit starts at a
place if the place is the text's first or the character before it is a line feed:
a predicate on two adjacent characters, so chunks that overlap by one character
count their unit starts independently. Prefix sums over the chunks give each
chunk's first rank; a cut rank belongs to the chunk whose ranks hold it, and only
that chunk is scanned again for the place.

Texts of up to ``long_bytes`` are cut where they are read: the texts of an Arrow
batch are one buffer, whose chunks are counted in one vectorised pass. Longer ones
are dealt in pieces over all tasks; the pieces send their counts, and the two that
own a cut are scanned again. Only counts and places move between them and the text.

Cases: null and empty texts are plain and have no units; texts that contain a
sentinel stay plain, whole and unmoved; a row without doc_id hashes as an empty
id; rows that repeat a doc_id are cut by the same draws; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize

#: Sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are transformed, and of those in the order suffix, prefix, middle.
RATE, SPM = 100, 50
SEED = 7
#: Bytes of a chunk within a task, of a text that is dealt in pieces, and of such a piece.
CHUNK, LONG_BYTES, PIECE = 4096, 1 << 20, 1 << 18
_LF = 10


def starts_of(data: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Where a unit starts in ``data``; ``before``: the byte in front of it, or none if the text starts here."""
    found = np.empty(len(data), bool)
    found[:1] = before[-1] == _LF if len(before) else True
    np.equal(data[:-1], _LF, out=found[1:])
    return found


def points_of(data: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (data & 0xC0) != 0x80


class Chunks:
    """The chunks of texts that lie one after the other in a buffer; offsets[i] is where text i starts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK):
        self.data, self.offsets = data, offsets
        sizes = np.diff(offsets)
        pieces = -(-sizes // chunk)
        self.first = np.concatenate([[0], np.cumsum(pieces)])  # a text's first chunk
        inside = np.arange(self.first[-1]) - np.repeat(self.first[:-1], pieces)
        self.at = np.concatenate([np.repeat(offsets[:-1], pieces) + inside * chunk, offsets[-1:]])
        starts = np.empty(len(data), bool)
        np.equal(data[:-1], _LF, out=starts[1:])
        starts[offsets[:-1][sizes > 0]] = True
        points = points_of(data)
        total = lambda found: np.concatenate([[0], np.cumsum(np.add.reduceat(found, self.at[:-1], dtype=np.int64))]) if len(self.at) > 1 else np.zeros(1, np.int64)
        self.units, self.points = total(starts), total(points)  # before each chunk
        self.n = np.diff(self.units[self.first])

    def cut(self, text: int, rank: int) -> tuple[int, int]:
        """Byte place in the buffer, and code points of the text before it, of the start of unit ``rank``; the text's end beyond the last."""
        low, high = self.first[text], self.first[text + 1]
        if rank >= self.n[text]:
            return int(self.offsets[text + 1]), int(self.points[high] - self.points[low])
        wanted = self.units[low] + rank
        owner = int(np.searchsorted(self.units, wanted, side="right")) - 1
        a, b = int(self.at[owner]), int(self.at[owner + 1])
        piece = self.data[a:b]
        place = int(np.flatnonzero(starts_of(piece, self.data[max(a - 1, self.offsets[text]) : a]))[wanted - self.units[owner]])
        return a + place, int(self.points[owner] - self.points[low] + np.count_nonzero(points_of(piece[:place])))


def assemble(text: bytes, low: int, high: int, form: str) -> bytes:
    """``text`` with its parts, cut at two bytes, in the order of ``form``."""
    prefix, suffix, middle = PREFIX.encode() + text[:low], SUFFIX.encode() + text[high:], MIDDLE.encode() + text[low:high]
    return prefix + suffix + middle if form == "psm" else suffix + prefix + middle


def draw(seed: int, which: int) -> Column:
    """The ``which``-th 32-bit number of a document's hash."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 8 * which + 1, 8), 16, 10).cast("long")


def form_of(seed: int, rate: int, spm: int) -> Column:
    plain = (F.col("text") == "") | (draw(seed, 2) % 100 >= rate)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains("text", F.lit(sentinel))
    return F.when(plain, "plain").when(draw(seed, 3) % 100 < spm, "spm").otherwise("psm")


def _in_place(df: DataFrame, chunk: int, schema: str) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1)
            size = len(texts)
            if not size:
                continue
            _, offsets, data = texts.cast(pa.large_binary()).buffers()
            offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + size + 1] if texts.offset else np.frombuffer(offsets, np.int64)[: size + 1]
            data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
            chunks = Chunks(data[offsets[0] : offsets[-1]], offsets - offsets[0], chunk)
            data, offsets = chunks.data, chunks.offsets
            rows = []
            for i, (form, h1, h2) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)):
                n, text = int(chunks.n[i]), data[offsets[i] : offsets[i + 1]].tobytes()
                if form == "plain":
                    rows.append((n, None, None, text))
                    continue
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                (a, before), (b, until) = chunks.cut(i, low), chunks.cut(i, high)
                at = int(offsets[i])
                rows.append((n, before, until - before, assemble(text, a - at, b - at, form)))
            n, before, middle, out = zip(*rows, strict=True)
            longs = [pa.array(x, pa.int64()) for x in (n, before, middle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), longs[0], batch.column(2), *longs[1:], pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n_units", "form", "prefix_chars", "middle_chars", "output"])

    return df.select("doc_id", "text", "form", "h1", "h2").mapInArrow(run, schema)


def _by_pieces(df: DataFrame, piece: int, schema: str) -> DataFrame:
    """The same for texts whose pieces go to many tasks."""
    texts = materialize(df.withColumn("row", F.monotonically_increasing_id()), "long-texts")

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                view = memoryview(text.as_buffer())
                for k, at in enumerate(range(0, len(view), piece)):
                    part = bytes(view[max(at - 1, 0) : at + piece])  # overlaps the one before by a byte
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([k], pa.int64()), pa.array([part], pa.binary())], names=["row", "piece", "data"])

    def halves(data: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
        whole = np.frombuffer(data, np.uint8)
        return (whole[1:], whole[:1]) if k else (whole, whole[:0])

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [(int(np.count_nonzero(starts_of(own, before))), int(np.count_nonzero(points_of(own)))) for own, before in map(halves, batch.column(2).to_pylist(), batch.column(1).to_pylist())]
            units, points = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.int64()), pa.array(points, pa.int64())], names=["row", "piece", "units", "points"])

    def rescan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for row, k, data, which, rank in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                own, before = halves(data, k)
                place = int(np.flatnonzero(starts_of(own, before))[rank])
                rows.append((row, which, k * piece + place, int(np.count_nonzero(points_of(own[:place])))))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "which", "place", "inner"])

    def finish(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(len(batch)):
                text, form, low, high = batch.column(1).cast(pa.binary())[i].as_py(), *(batch.column(k)[i].as_py() for k in (2, 6, 7))
                out = text if form == "plain" else assemble(text, low, high, form)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(batch.column(k).slice(i, 1) for k in (3, 2, 4, 5)), pa.array([out], pa.binary()).cast(pa.string())], names=["doc_id", "n_units", "form", "prefix_chars", "middle_chars", "output"])

    pieces = materialize(texts.select("row", "text").mapInArrow(deal, "row long, piece long, data binary").repartition("row", "piece"), "pieces")
    counts = pieces.mapInArrow(count, "row long, piece long, units long, points long")
    earlier = Window.partitionBy("row").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece of one text
    summed = materialize(counts.select("*", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("units", "points"))), "piece-counts")
    totals = summed.groupBy("row").agg(F.sum("units").alias("n"), F.sum("points").alias("all_points"))
    ends = texts.join(totals, "row").select("row", "h1", "h2", "form", "n", "all_points", F.octet_length("text").cast("long").alias("n_bytes"))
    ranks = ends.withColumn("low", F.least(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1))).withColumn("high", F.greatest(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)))
    ranks = materialize(ranks, "ranks")
    wanted = ranks.filter("form != 'plain'").select("row", "n", F.posexplode(F.array("low", "high")).alias("which", "rank")).filter("rank < n")
    owned = summed.join(wanted, "row").filter("units_before <= rank AND rank < units_before + units")
    owners = owned.select("row", "piece", F.col("which").cast("long").alias("which"), (F.col("rank") - F.col("units_before")).alias("rank"), "points_before")
    found = pieces.join(owners, ["row", "piece"]).select("row", "piece", "data", "which", "rank").mapInArrow(rescan, "row long, which long, place long, inner long")
    found = found.join(owners.select("row", "which", "points_before"), ["row", "which"]).select("row", "which", "place", (F.col("inner") + F.col("points_before")).alias("points"))
    at = lambda which, c: F.max(F.when(F.col("which") == which, F.col(c)))
    cuts = found.groupBy("row").agg(*(at(i, c).alias(f"{c}{i}") for i in (0, 1) for c in ("place", "points")))
    # a cut that no piece owns is the text's end
    placed = ranks.join(cuts, "row", "left").select("row", "n", *(F.coalesce(f"{c}{i}", end).alias(f"{c}{i}") for i in (0, 1) for c, end in (("place", "n_bytes"), ("points", "all_points"))))
    moved = F.col("form") != "plain"
    columns = ["doc_id", "text", "form", F.col("n").alias("n_units"), F.when(moved, F.col("points0")).alias("prefix_chars"), F.when(moved, F.col("points1") - F.col("points0")).alias("middle_chars"), "place0", "place1"]
    return texts.join(placed, "row").select(*columns).mapInArrow(finish, schema)


def transform(df: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, chunk: int = CHUNK, long_bytes: int = LONG_BYTES, piece: int = PIECE) -> DataFrame:
    """``df(doc_id, text)`` as doc_id, n_units, form (plain, psm or spm), prefix_chars, middle_chars, output."""
    schema = f"doc_id {dict(df.dtypes)['doc_id']}, n_units long, form string, prefix_chars long, middle_chars long, output string"
    texts = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    drawn = texts.select("*", form_of(seed, rate, spm).alias("form"), draw(seed, 0).alias("h1"), draw(seed, 1).alias("h2"))
    is_long = F.octet_length("text") > long_bytes
    return _in_place(drawn.filter(~is_long), chunk, schema).unionByName(_by_pieces(drawn.filter(is_long), piece, schema))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Sentinels cannot be part of it, so the first of each is the one that was put there."""
    part = lambda after, until: F.substring_index(F.split_part(output, F.lit(after), F.lit(2)), until, 1) if until else F.split_part(output, F.lit(after), F.lit(2))
    psm = F.concat(part(PREFIX, SUFFIX), part(MIDDLE, None), part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), part(MIDDLE, None), part(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(done: DataFrame) -> DataFrame:
    """Digests of the outputs and of the texts rebuilt from them."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def oracle_sql() -> str:
    """The same in DuckDB."""
    draws = ", ".join(f"CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    held = " OR ".join(f"contains(t, '{s}')" for s in (PREFIX, SUFFIX, MIDDLE))
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
units AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS u, {draws} FROM texts),
cuts AS (
  SELECT *, len(u) AS n, CASE WHEN t = '' OR {held} OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi FROM units),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts"""
