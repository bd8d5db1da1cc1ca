"""Periodic runs of words: every lag compared with the whole text at once.

A run is a stretch of words with smallest period q and length of at least
``max(min_words, min_exponent * q)`` that no neighbouring word extends. A text's
words become numbers; for each lag q up to n / min_exponent the array is compared
with itself shifted by q (many lags in one vectorised comparison), and the
stretches of equal places are measured. A stretch of k places at lag q is a run of
k + q words. A run whose smallest period is a divisor of q has the same start and
length at that divisor, so the least period of each (start, length) is kept.

A text costs n^2 / min_exponent comparisons. Texts of up to ``cells`` comparisons
are done where they are read, without a shuffle. Longer ones are cut into ranges
of lags of about ``cells`` comparisons each; the ranges are dealt over all tasks,
and the runs of a text, at most as many as it has words, meet in its row again.

Cases: null, empty and blank texts have no words and no runs; texts of any length
are done whole; rows that repeat a doc_id, and rows without one, are each searched
by themselves; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, WORD, materialize, words

MIN_EXPONENT, MIN_WORDS = 4, 6
#: Comparisons of one range of lags, a tenth of a second.
CELLS = 1 << 26
#: Comparisons that are held at once, a byte each.
_BLOCK = 1 << 18
_WIDTH = 8
RUNS = "array<struct<start:long,length:long,period:long>>"


def word_ids(found: list[bytes]) -> np.ndarray:
    """Equal words as equal numbers."""
    index: dict[bytes, int] = {}
    return np.fromiter((index.setdefault(w, len(index)) for w in found), np.int32, len(found))


def lag_runs(ids: np.ndarray, low: int, high: int, min_exponent: int = MIN_EXPONENT, min_words: int = MIN_WORDS) -> np.ndarray:
    """Rows (start, length, lag) of the maximal stretches with period ``lag``, for the lags from ``low`` to below ``high``."""
    n, found = len(ids), [np.empty((0, 3), np.int64)]
    padded = np.concatenate([ids, np.full(high, -1, ids.dtype)])
    shifted = np.lib.stride_tricks.sliding_window_view(padded, n) if n else None
    each = max(1, _BLOCK // max(n, 1))
    for first in range(low, high, each):
        same = (shifted[first : min(first + each, high)] == ids).ravel()  # a row for each lag; its last place is never equal
        # shorter stretches than any lag here asks for go first: what stays are places that begin ``width`` equal ones
        width, least = 1, max(min_words - min(first + each, high) + 1, (min_exponent - 1) * first)
        while 2 * width <= min(least, _WIDTH):
            same = same[:-width] & same[width:]
            width *= 2
        if not same.any():
            continue
        edges = np.flatnonzero(same[1:] != same[:-1]) + 1
        if same[0]:
            edges = np.concatenate([[0], edges])
        starts, ends = edges[::2], edges[1::2] + width - 1
        lag = first + starts // n
        length = ends - starts + lag
        good = length >= np.maximum(min_words, min_exponent * lag)
        if good.any():
            found.append(np.stack([starts[good] % n, length[good], lag[good]], axis=1))
    return np.concatenate(found)


def smallest_periods(found: np.ndarray) -> np.ndarray:
    """``found`` by start and period, each (start, length) with its least period only."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapse(found: list[bytes], runs: np.ndarray) -> bytes:
    """The words outside of all repetitions (a run's first period stays), joined by one space."""
    depth = np.zeros(len(found) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(depth[:-1]) == 0
    return b" ".join(w for w, k in zip(found, keep.tolist(), strict=True) if k) if len(runs) else b" ".join(found)


def _row(doc_id, found: list[bytes], runs: np.ndarray):
    import pyarrow as pa

    listed = pa.array([[{"start": s, "length": k, "period": p} for s, k, p in runs.tolist()]], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
    return pa.RecordBatch.from_arrays([doc_id, pa.array([len(found)], pa.int64()), listed, pa.array([collapse(found, runs)], pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def _in_place(df: DataFrame, min_exponent: int, min_words: int, schema: str) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            done = []
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                found = (text.as_py() or b"").split()  # of bytes: ASCII white space only
                runs = smallest_periods(lag_runs(word_ids(found), 1, len(found) // min_exponent + 1, min_exponent, min_words)) if len(found) >= min_words else np.empty((0, 3), np.int64)
                done.append(_row(batch.column(0).slice(i, 1), found, runs))
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()

    return df.select("doc_id", "text").mapInArrow(run, schema)


def _by_ranges(df: DataFrame, min_exponent: int, min_words: int, cells: int, schema: str) -> DataFrame:
    """The same for texts whose ranges of lags go to many tasks."""
    texts = materialize(df.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "long-texts")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                ids = word_ids(text.as_py().split())
                end, each = len(ids) // min_exponent + 1, max(1, cells // max(1, len(ids)))
                for low in range(1, end, each):
                    columns = [pa.array([v]) for v in (row, low, min(low + each, end))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([ids.tobytes()], pa.binary())], names=["row", "low", "high", "ids"])

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row, low, high, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                found = lag_runs(np.frombuffer(ids.as_buffer(), np.int32), low, high, min_exponent, min_words)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row, np.int64)), *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(3))], names=["row", "start", "length", "period"])

    def finish(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i, (text, runs) in enumerate(zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True)):
                found = np.array([(r["start"], r["length"], r["period"]) for r in runs or []], np.int64).reshape(-1, 3)
                yield _row(batch.column(0).slice(i, 1), text.as_py().split(), found)

    ranges = texts.select("row", "text").mapInArrow(cut, "row long, low long, high long, ids binary").repartition("row", "low")
    least = ranges.mapInArrow(scan, "row long, start long, length long, period long").groupBy("row", "start", "length").agg(F.min("period").alias("period"))
    listed = least.groupBy("row").agg(F.collect_list(F.struct("start", "period", "length")).alias("runs"))  # of one text
    ordered = F.transform(F.array_sort("runs"), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
    return texts.join(listed, "row", "left").select("doc_id", "text", ordered.alias("runs")).mapInArrow(finish, schema)


def find_runs(df: DataFrame, min_exponent: int = MIN_EXPONENT, min_words: int = MIN_WORDS, cells: int = CELLS) -> DataFrame:
    """``df(doc_id, text)`` as doc_id, n_words, runs (by start, then period) and collapsed, the text without repetitions."""
    schema = f"doc_id {dict(df.dtypes)['doc_id']}, n_words long, runs {RUNS}, collapsed string"
    # b bytes are at most (b + 1) / 2 words
    most = F.pow((F.octet_length(F.coalesce("text", F.lit(""))) + 1) / 2, 2) / min_exponent
    return _in_place(df.filter(most <= cells), min_exponent, min_words, schema).unionByName(_by_ranges(df.filter(most > cells), min_exponent, min_words, cells, schema))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period; of equal ones the first. Null if there is none."""
    none = F.lit(None).cast(RUNS[len("array<") : -1])
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))


def repeat_tails(df: DataFrame) -> DataFrame:
    """``df(doc_id, text)`` with repetitions planted: by CRC-32 of the id, every tenth text repeats a stretch from some word on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))

    def planted(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + F.pmod(i - a, p)).cast("int")))), " ")

    chosen = (h % 10 == 0) & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    # a lambda's variable is computed once, a column at each of its uses
    return df.select("doc_id", F.when(chosen, F.transform(F.array(words(F.col("text"))), planted)[0]).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The strongest run of each document, and digests of all its runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def oracle_sql() -> str:
    """The same in DuckDB: pairs of equal words within a text, islands of each lag. The CRC-32 is folded over the bytes of the id."""
    bit = "CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"
    return f"""
WITH RECURSIVE crc(doc_id, rest, c) AS (
  SELECT DISTINCT doc_id, coalesce(CAST(doc_id AS VARCHAR), ''), CAST(4294967295 AS BIGINT) FROM documents
  UNION ALL
  SELECT doc_id, substr(rest, 2), list_reduce([xor(c, CAST(ascii(rest) AS BIGINT)), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {bit.format(x="x")}) FROM crc WHERE rest <> ''),
hashed AS (
  SELECT doc_id, xor(c, 4294967295) AS h FROM crc WHERE rest = ''),
split AS (
  SELECT doc_id, h, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents JOIN hashed USING (doc_id)),
cut AS (
  SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a,
         CASE WHEN h % 10 = 0 AND len(w) > 0 THEN 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) END AS p FROM split),
placed AS (
  SELECT doc_id, n, i, CASE WHEN a IS NULL OR i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word
  FROM (SELECT doc_id, w, n, a, p, unnest(range(n)) AS i FROM cut)),
equal AS (
  SELECT l.doc_id, r.i - l.i AS q, l.i AS i FROM placed l JOIN placed r ON l.doc_id = r.doc_id AND l.word = r.word AND r.i > l.i AND {MIN_EXPONENT} * (r.i - l.i) <= l.n),
islands AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM equal) GROUP BY doc_id, q, g),
runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM islands WHERE length >= greatest({MIN_WORDS}, {MIN_EXPONENT} * q) GROUP BY doc_id, start, length),
lists AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t,
         min({{'e': -CAST(length AS DOUBLE) / period, 's': start, 'p': period, 'l': length}}) AS best FROM runs GROUP BY doc_id),
dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM placed ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
       sha256(coalesce(lists.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM documents LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)"""
