"""Exact substring deduplication over an enhanced suffix array of shared contexts.

Every byte covered by a ``length``-byte string that also starts earlier (smaller
doc_id, or same document) is removed. Four steps, none of which holds more than
a bounded part of the data in one place:

1. Anchors. Of the k-grams in each ``length``-byte window the one with the least
   hash is the window's anchor (winnowing), so equal windows have equal anchors
   at equal offsets. Neighbouring windows share anchors; an anchor with its run
   of windows is one row, about one for 39 bytes.
2. Equal runs are one leaf of an anchor's suffix array. Rows are sorted by anchor
   and by a hash of all the bytes that the run covers; an anchor with one leaf has
   one interval, the whole run, whose occurrences are the rows, and needs no bytes.
   Each task brings its own equal rows together first, so that an anchor or a run
   that is in very many documents hardly travels.
3. Suffix array. Where one anchor has several different runs, at the ends of
   repeats, one of each fetches its bytes. The suffixes that start windows there
   are sorted, with common-prefix lengths; a stack scan walks the tree of prefix
   intervals, tests whether the characters to the left differ, and yields the
   maximal repeats with all occurrences. Each but the earliest is removed.
   ``repeat_groups`` gives the groups themselves, leaves and intervals alike.
   Anchors with more than ``bucket_limit`` runs are settled window by window
   with an aggregation instead, which is exact as well and has no large group.
4. Spans are merged per document and cut out.

Cases: null and empty texts, and those shorter than ``length``, lose nothing;
rows that repeat a doc_id are one document and must have one text; rows with a
null doc_id lose nothing; very long texts are read in overlapping pieces; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize

LENGTH = 100
GRAM = 24
#: Different runs of one anchor that one task sorts.
BUCKET_LIMIT = 8192
#: Bytes that are hashed at once; a position in them takes 20 bits.
_CHUNK = 1 << 20
_PIECE = _CHUNK // 2
#: Anchors that a task combines before the shuffle.
_COMBINED = 1 << 19
#: Contexts that are sorted together, in whole anchors.
_SORTED_TOGETHER = 4096

_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(_CHUNK + 1, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def anchor_runs(buffer: bytes, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one anchor in the texts buffer[start:end].

    Returns anchor hash, hash of all bytes of the run, number of the text, the
    anchor's place in the buffer, and how far before it the run's first and last
    window start.
    """
    up, down = _power_tables()
    n, width = len(buffer), length - gram + 1
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(buffer, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    valid = np.zeros(n + 1, np.int32)
    long = ends - starts >= length
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(valid))
    if not len(window):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    grams = _mix((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
    least = (grams >> np.uint64(20) << np.uint64(20)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    at = (least[window] & np.uint64(0xFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)]))
    anchor, first, last = at[new], window[new], window[np.append(new[1:], len(window)) - 1]
    run = _mix((prefix[last + length] - prefix[first]) * down[first])
    return grams[anchor], run, np.searchsorted(starts, anchor, side="right") - 1, anchor, anchor - first, anchor - last


def _combine(rows: np.ndarray, length: int) -> np.ndarray:
    """Settles equal runs among rows (anchor, run, doc_id, place) before the shuffle.

    Behind the first of equal runs the others are repeats already; they become
    merged spans (hash of doc_id, start, doc_id, -stop). So an anchor or a run
    that is in very many documents leaves a task once, not once a document.
    """
    key = _mix(rows[:, 0].view(np.uint64) ^ _mix(rows[:, 1].view(np.uint64) + (rows[:, 3].view(np.uint64) & np.uint64(0x3FFF))))
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], key))]
    same = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1]) & ((rows[1:, 3] ^ rows[:-1, 3]) & 0x3FFF == 0)
    # a row that only repeats its document's row is no later occurrence; the next step sees it again
    twice = (rows[1:, 2] == rows[:-1, 2]) & (rows[1:, 3] == rows[:-1, 3])
    later = np.concatenate([[False], same & ~twice])
    # behind a repeated first row, the rest of its run is later all the same; the repeated row itself is dropped
    keep = rows[~np.concatenate([[False], same])]
    gone = rows[later]
    if not len(gone):
        return keep
    position, lo, hi = gone[:, 3] >> 14, gone[:, 3] >> 7 & 127, gone[:, 3] & 127
    start, stop, doc = position - lo, position - hi + length, gone[:, 2]
    order = np.lexsort((start, doc))
    start, stop, doc = start[order], stop[order], doc[order]
    # reach of all spans so far within the document: spans start in order and have bounded lengths, so the maximum is a running one
    edge = np.concatenate([[True], doc[1:] != doc[:-1]])
    number = np.cumsum(edge) - 1
    shift = number * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + shift) - shift
    new = edge | np.concatenate([[True], start[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    spans = np.stack([_mix(doc[first].view(np.uint64)).view(np.int64), start[first], doc[first], -reach[last]], axis=1)
    return np.concatenate([keep, spans])


def anchors(df: DataFrame, length: int = LENGTH, gram: int = GRAM, combine: bool = True) -> DataFrame:
    """``df(doc_id, text)`` as anchor, run, doc_id, place: place is 2^14 * position + 2^7 * before first + before last.

    With ``combine``, equal rows of a task are brought together, and rows with a
    negative place are spans that are settled already; see _combine.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        docs, offsets, parts, size = [], [], [], 0
        held, rows = [], 0

        def settle():
            combined = _combine(np.concatenate(held), length) if combine else np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array(combined[:, i]) for i in range(4)], names=["anchor", "run", "doc_id", "place"])

        def flush():
            ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            anchor, content, text, at, lo, hi = anchor_runs(b"".join(parts), starts, ends, length, gram)
            position = at - starts[text] + np.array(offsets, np.int64)[text]
            held.append(np.stack([anchor.view(np.int64), content.view(np.int64), np.array(docs, np.int64)[text], position << 14 | lo << 7 | hi], axis=1))
            return len(anchor)

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                text = value.as_py()
                for offset in range(0, max(1, len(text) - length + 1), _PIECE):
                    part = text[offset : offset + _PIECE + length - 1]
                    if size + len(part) > _CHUNK:
                        rows += flush()
                        docs, offsets, parts, size = [], [], [], 0
                        if rows >= _COMBINED:
                            yield settle()
                            held, rows = [], 0
                    docs.append(doc)
                    offsets.append(offset)
                    parts.append(part)
                    size += len(part)
        if parts:
            flush()
        if held:
            yield settle()

    whole = df.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    return whole.mapInArrow(run, "anchor long, run long, doc_id long, place long")


def _settle_equal_runs(batches: Iterator, length: int) -> Iterator:
    """From anchors sorted by anchor, run, window offsets, doc_id, place: spans to remove, and runs to compare.

    Runs to compare have an anchor, the first of each different run under an
    anchor that has several; spans have none.
    """
    import pyarrow as pa

    last: np.ndarray | None = None  # the last row seen
    first: np.ndarray | None = None  # the first row of the last run seen
    waits = False  # whether that is the first run of its anchor
    names = ["anchor", "doc_id", "start", "stop", "place"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def spans(rows):
        position, lo, hi = rows[:, 3] >> 14, rows[:, 3] >> 7 & 127, rows[:, 3] & 127
        columns = [pa.nulls(len(rows), pa.int64()), pa.array(rows[:, 2]), pa.array(position - lo), pa.array(position - hi + length), pa.nulls(len(rows), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def candidates(rows):
        none = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 2]), none, none, pa.array(rows[:, 3])], schema=schema)

    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
        settled = rows[:, 3] < 0
        if settled.any():
            done = rows[settled]
            none = pa.nulls(len(done), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(done[:, 2]), pa.array(done[:, 1]), pa.array(-done[:, 3]), none], schema=schema)
            rows = rows[~settled]
        if not len(rows):
            continue
        before = np.concatenate([rows[:1] if last is None else last[None], rows[:-1]])
        new_anchor = rows[:, 0] != before[:, 0]
        new_run = new_anchor | (rows[:, 1] != before[:, 1]) | ((rows[:, 3] ^ before[:, 3]) & 0x3FFF != 0)
        if last is None:
            new_anchor[0] = new_run[0] = True
        # the first row of each row's run, maybe from an earlier batch
        heads = np.concatenate([rows[:1] if first is None else first[None], rows[new_run]])
        head = heads[np.cumsum(new_run)]
        again = ~new_run & ((rows[:, 2] != head[:, 2]) | (rows[:, 3] != head[:, 3]))
        if again.any():
            yield spans(rows[again])
        runs, opens = rows[new_run], new_anchor[new_run]
        if len(runs):
            several = ~opens  # it has a run before it under its anchor
            follows = np.append(~opens[1:], False)
            if not opens[0] and waits:
                yield candidates(first[None])
            take = several | follows
            if take.any():
                yield candidates(runs[take])
            waits = bool(opens[-1]) and not bool(follows[-1])
            first = runs[-1]
        last = rows[-1]


# ---- the enhanced suffix array ----------------------------------------------


def suffix_order(text: np.ndarray, starts: np.ndarray, stops: np.ndarray, bucket: np.ndarray):
    """(order, common): suffixes text[start:stop] sorted within buckets, and each one's common prefix with the one before."""
    width = int((stops - starts).max())
    lengths = stops - starts
    columns = np.arange(width)
    padded = np.where(columns < lengths[:, None], text[np.minimum(starts[:, None] + columns, len(text) - 1)], 0).astype(np.uint8)
    keys = np.concatenate([np.ascontiguousarray(bucket.astype(">u4")).view(np.uint8).reshape(-1, 4), padded, np.full((len(starts), 1), 1, np.uint8)], axis=1)
    order = np.argsort(keys.view(f"S{width + 5}").ravel(), kind="stable")
    sorted_text, sorted_length, sorted_bucket = padded[order], lengths[order], bucket[order]
    differ = sorted_text[1:] != sorted_text[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(sorted_length[1:], sorted_length[:-1]))
    common[sorted_bucket[1:] != sorted_bucket[:-1]] = 0
    return order, np.concatenate([[0], common])


def maximal_repeats(common: np.ndarray, left: np.ndarray, rank: np.ndarray, least: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """(length, from, to, later) of the prefix intervals of at least ``least`` whose left characters differ: the maximal repeats.

    A stack scan over the common-prefix lengths: an interval closes when a
    shorter common prefix follows; sorted suffixes from..to-1 are all occurrences
    of the repeat. ``left`` is the character before each suffix; negative ones
    count as different from all. ``later`` are the occurrences that this repeat
    decides: all but the earliest by ``rank``, less those that a longer repeat
    inside the interval has decided already. So each suffix is decided once.
    """
    stack: list[list] = []  # [length, from, earliest so far, left character, whether they differ, later ones]
    n = len(common)

    def join(node: list, i: int, char: int, diverse: bool) -> None:
        a, b = (node[2], i) if rank[node[2]] <= rank[i] else (i, node[2])
        node[2] = a
        node[5].append(b)
        node[4] = node[4] or diverse or node[3] != char

    for i in range(1, n + 1):
        now = int(common[i]) if i < n else 0
        begin, best, char, diverse = i - 1, i - 1, int(left[i - 1]), bool(left[i - 1] < 0)
        while stack and stack[-1][0] > now:
            join(stack[-1], best, char, diverse)
            length, begin, best, char, diverse, later = stack.pop()
            if diverse:
                yield length, begin, i, later
        if now >= least:
            if stack and stack[-1][0] == now:
                join(stack[-1], best, char, diverse)
            else:
                stack.append([now, begin, best, char, diverse, []])


def repeat_groups_in(contexts: list[bytes], bucket: np.ndarray, doc: np.ndarray, origin: np.ndarray, windows: np.ndarray, length: int = LENGTH):
    """(length, owners, places, later) of the maximal repeats of ``length`` bytes or more in contexts of one bucket.

    ``origin`` is each context's place in its document, ``windows`` how many
    windows start in it. A group lists all its occurrences, as the context each
    is in and its place in that document; ``later`` are those of them, by number
    in the group, that are to be removed at this length.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    text = np.frombuffer(b"".join(contexts), np.uint8)
    owner = np.repeat(np.arange(len(contexts)), windows)
    inner = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
    starts = base[owner] + inner
    # windows whose bytes are alone in their bucket need no sorting
    up, down = _power_tables()
    hashes = np.zeros(len(starts), np.uint64)
    for i in range(0, len(text), _CHUNK // 2):
        here = (starts >= i) & (starts < i + _CHUNK // 2)
        part = text[i : i + _CHUNK // 2 + length]
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=prefix[1:])
        s = starts[here] - i
        hashes[here] = _mix((prefix[s + length] - prefix[s]) * down[s]) ^ _mix(bucket[owner[here]].astype(np.uint64) + np.uint64(1))
    _, group, count = np.unique(hashes, return_inverse=True, return_counts=True)
    near = count[group] > 1
    if not near.any():
        return
    starts, owner, inner = starts[near], owner[near], inner[near]
    stops = base[owner] + sizes[owner]
    order, common = suffix_order(text, starts, stops, bucket[owner])
    starts, owner, inner = starts[order], owner[order], inner[order]
    # the character to the left; what lies before a context is unknown and counts as different
    left = np.where(inner > 0, text[np.maximum(starts - 1, 0)].astype(np.int64), -1)
    cluster = np.cumsum(common < length) - 1
    low, high = np.full(cluster[-1] + 1, 999), np.full(cluster[-1] + 1, -2)
    np.minimum.at(low, cluster, left)
    np.maximum.at(high, cluster, left)
    keep = ((low != high) | (low < 0))[cluster]
    starts, owner, inner, left, common = starts[keep], owner[keep], inner[keep], left[keep], common[keep]
    common = np.where(common < length, 0, common)
    place = origin[owner] + inner
    rank = np.empty(len(owner), np.int64)
    rank[np.lexsort((place, doc[owner]))] = np.arange(len(owner))
    for length_, begin, end, later in maximal_repeats(common, left, rank, length):
        yield length_, owner[begin:end], place[begin:end], np.array(later, np.int64) - begin


def repeat_spans(contexts: list[bytes], bucket: np.ndarray, doc: np.ndarray, origin: np.ndarray, windows: np.ndarray, length: int = LENGTH):
    """(doc, start, stop) of all occurrences of the repeats but the earliest."""
    spans = [np.zeros((0, 3), np.int64)]
    for size, owners, places, later in repeat_groups_in(contexts, bucket, doc, origin, windows, length):
        spans.append(np.stack([doc[owners[later]], places[later], places[later] + size], axis=1))
    return tuple(np.concatenate(spans).T)


def _compare_contexts(batches: Iterator, length: int) -> Iterator:
    """Spans from rows (anchor, doc_id, place, context) sorted by anchor."""
    import pyarrow as pa

    names = ["doc_id", "start", "stop"]

    def settle(rows):
        anchor, doc, place = (np.concatenate([r[i] for r in rows]) for i in range(3))
        contexts = [c for r in rows for c in r[3]]
        # rows of a document that is there twice
        _, once = np.unique(np.stack([anchor, doc, place]), axis=1, return_index=True)
        anchor, doc, place, contexts = anchor[once], doc[once], place[once], [contexts[i] for i in once.tolist()]
        _, bucket = np.unique(anchor, return_inverse=True)
        position, lo, hi = place >> 14, place >> 7 & 127, place & 127
        spans = repeat_spans(contexts, bucket, doc, position - lo, lo - hi + 1, length)
        return pa.RecordBatch.from_arrays([pa.array(s) for s in spans], names=names)

    held: list[tuple] = []
    for batch in batches:
        anchor, doc, place = (batch.column(i).to_numpy() for i in range(3))
        contexts = batch.column(3).to_pylist()
        for begin in range(0, len(anchor), _SORTED_TOGETHER):
            end = min(len(anchor), begin + _SORTED_TOGETHER)
            # up to where the last anchor of the slice begins, all anchors are whole
            whole = begin + int(np.searchsorted(anchor[begin:end], anchor[end - 1]))
            if whole > begin or (held and held[-1][0][-1] != anchor[begin]):
                if whole > begin:
                    held.append((anchor[begin:whole], doc[begin:whole], place[begin:whole], contexts[begin:whole]))
                yield settle(held)
                held = []
            held.append((anchor[whole:end], doc[whole:end], place[whole:end], contexts[whole:end]))
    if held:
        yield settle(held)


def _window_spans(contexts: DataFrame, length: int) -> DataFrame:
    """The same spans for anchors with very many runs, window by window."""
    before, last = F.shiftright("place", 7).bitwiseAND(F.lit(127)), F.col("place").bitwiseAND(F.lit(127))
    step = contexts.select("doc_id", "place", "context", F.explode(F.sequence(F.lit(0).cast("long"), before - last)).alias("_i"))
    start = F.shiftright("place", 14) - before + F.col("_i")
    windows = step.select("doc_id", start.alias("start"), F.sha2(F.substring("context", F.col("_i").cast("int") + 1, F.lit(length)), 256).alias("_window"))
    first = windows.groupBy("_window").agg(F.min(F.struct("doc_id", "start")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    later = windows.join(first, "_window").filter((F.col("doc_id") != F.col("_first.doc_id")) | (F.col("start") != F.col("_first.start")))
    return later.select("doc_id", "start", (F.col("start") + length).alias("stop"))


def duplicate_spans(df: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc_id, start, stop) of bytes to remove; spans overlap."""
    found = anchors(df, length, gram)
    offsets = F.col("place").bitwiseAND(F.lit(0x3FFF))
    found = found.repartition("anchor").sortWithinPartitions("anchor", "run", offsets, "doc_id", "place")
    settled = materialize(found.mapInArrow(lambda b: _settle_equal_runs(b, length), "anchor long, doc_id long, start long, stop long, place long"), "runs")
    spans = settled.filter("anchor IS NULL").select("doc_id", "start", "stop")
    candidates = settled.filter("anchor IS NOT NULL").select("anchor", "doc_id", "place")
    position, before, last = F.shiftright("place", 14), F.shiftright("place", 7).bitwiseAND(F.lit(127)), F.col("place").bitwiseAND(F.lit(127))
    context = F.substring(F.col("text").cast("binary"), (position - before + 1).cast("int"), (before - last + length).cast("int"))
    texts = df.select("doc_id", "text").filter(F.octet_length("text") >= length)
    fetched = materialize(texts.join(candidates, "doc_id").select("anchor", "doc_id", "place", context.alias("context")), "contexts")
    sizes = fetched.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"))
    large = materialize(sizes.filter(F.col("_n") > bucket_limit).select("anchor"), "large")
    sorted_rows = fetched.join(large, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    compared = sorted_rows.mapInArrow(lambda b: _compare_contexts(b, length), "doc_id long, start long, stop long")
    spans = spans.union(compared)
    if not large.isEmpty():
        spans = spans.union(_window_spans(fetched.join(large, "anchor"), length))
    return spans


def _groups_of_contexts(batches: Iterator, length: int) -> Iterator:
    """(anchor, number, length, run, offsets, inner) of the repeats in rows (anchor, run, doc_id, place, context) sorted by anchor."""
    import pyarrow as pa

    names = ["anchor", "number", "length", "run", "offsets", "inner"]

    def settle(rows):
        anchor, run, doc, place, contexts = (list(c) for c in zip(*rows, strict=True))
        place, doc = np.array(place, np.int64), np.array(doc, np.int64)
        position, lo, hi = place >> 14, place >> 7 & 127, place & 127
        origin, out = position - lo, []
        for number, (size, owners, places, _) in enumerate(repeat_groups_in(contexts, np.zeros(len(rows), np.int64), doc, origin, lo - hi + 1, length)):
            out += [(anchor[0], number, size, run[o], int(place[o]) & 0x3FFF, int(p - origin[o])) for o, p in zip(owners.tolist(), places.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((),) * 6)], names=names)

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held and held[-1][0] != row[0]:
                yield settle(held)
                held = []
            held.append(row)
    if held:
        yield settle(held)


def repeat_groups(df: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(group_id, length, doc_id, start): the repeats of ``df(doc_id, text)`` with all their occurrences.

    The groups are those of every anchor's tree: a leaf with several rows (equal
    runs), and the intervals above the leaves. Groups of neighbouring anchors
    whose occurrences are the same but for a common shift are one repeat, and are
    brought together; where a run of a repeat has more occurrences than the rest,
    the repeat is given in pieces. Expanding copies costs a row for each
    occurrence, which removal does not need; doc_ids must be unique.
    """
    rows = materialize(anchors(df, length, gram, combine=False).withColumn("offsets", F.col("place").bitwiseAND(F.lit(0x3FFF))), "anchors")
    leaf = ["anchor", "run", "offsets"]
    leaves = materialize(rows.groupBy(*leaf).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "place")).alias("first")), "leaves")
    before, last = F.shiftright("offsets", 7), F.col("offsets").bitwiseAND(F.lit(127))
    several = leaves.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("anchor")
    wanted = leaves.join(several, "anchor").select("anchor", "run", "first.doc_id", "first.place", (before - last + length).alias("_size"))
    at = F.shiftright("place", 14) - F.shiftright("place", 7).bitwiseAND(F.lit(127)) + 1
    texts = df.select("doc_id", "text").filter(F.octet_length("text") >= length)
    contexts = texts.join(wanted, "doc_id").select("anchor", "run", "doc_id", "place", F.substring(F.col("text").cast("binary"), at.cast("int"), F.col("_size").cast("int")).alias("context"))
    schema = "anchor long, number long, length long, run long, offsets long, inner long"
    found = materialize(contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda b: _groups_of_contexts(b, length), schema), "intervals")
    # a leaf that is an interval of its full length with others is no group of its own
    whole = found.filter((F.col("inner") == 0) & (F.col("length") == before - last + length)).select(*leaf).distinct()
    alone = leaves.filter("n > 1").join(whole, leaf, "left_anti").select(*leaf, F.lit(-1).cast("long").alias("number"), (before - last + length).cast("long").alias("length"), F.lit(0).cast("long").alias("inner"))
    start = F.shiftright("place", 14) - before + F.col("inner")
    member = found.unionByName(alone).join(rows, leaf).select(F.xxhash64("anchor", "number", F.when(F.col("number") < 0, F.struct("run", "offsets")), "length").alias("tile"), "length", "doc_id", start.alias("start"))
    member = materialize(member.distinct(), "tiles")
    firsts = member.groupBy("tile", "length").agg(F.min(F.struct("doc_id", "start")).alias("_f"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    shifted = member.join(firsts, ["tile", "length"]).withColumn("_h", F.xxhash64("doc_id", F.col("start") - F.col("_f.start")))
    tiles = shifted.groupBy("tile", "length").agg(F.first("_f").alias("_f"), F.first("_n").alias("_n"), F.bit_xor("_h").alias("_set"))
    tiles = tiles.select("tile", "length", F.col("_f.doc_id").alias("_doc"), F.col("_f.start").alias("_start"), "_n", "_set")
    same = Window.partitionBy("_doc", "_n", "_set").orderBy("_start", F.desc("length"), "tile")
    reach = F.max(F.col("_start") + F.col("length")).over(same.rowsBetween(Window.unboundedPreceding, -1))
    # the next window of the repeat starts one byte after the last one so far
    numbered = tiles.withColumn("_new", F.when(F.col("_start") + length <= reach + 1, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(same.rowsBetween(Window.unboundedPreceding, 0)))
    islands = numbered.groupBy("_doc", "_n", "_set", "_island").agg(F.min("_start").alias("_a"), F.max(F.col("_start") + F.col("length")).alias("_z"), F.min_by(F.struct("tile", "length"), F.struct("_start", -F.col("length"), "tile")).alias("_head"))
    heads = islands.select(F.col("_head.tile").alias("tile"), F.col("_head.length").alias("length"), (F.col("_z") - F.col("_a")).alias("_whole"))
    return member.join(heads, ["tile", "length"]).select(F.col("tile").alias("group_id"), F.col("_whole").alias("length"), "doc_id", "start")


def remove_duplicates(df: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``df(doc_id, text)`` as doc_id, n_bytes, spans (merged, of bytes), kept (the remaining bytes)."""
    spans = duplicate_spans(df, length, gram, bucket_limit)
    per_doc = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))  # at most one for each byte of the document
    per_doc = materialize(per_doc, "spans")
    joined = df.select("doc_id", "text").join(per_doc, "doc_id", "left").select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            out_n, out_spans, out_kept = [], [], []
            for value, starts, stops in zip(batch.column(1).cast(pa.binary()), batch.column(2), batch.column(3), strict=True):
                text = value.as_py() or b""
                merged = merge(starts.values.to_numpy(), stops.values.to_numpy()) if starts.is_valid else []
                out_n.append(len(text))
                out_spans.append([{"start": a, "stop": b} for a, b in merged])
                edges = [0, *(x for span in merged for x in span), len(text)]
                out_kept.append(b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out_n, pa.int64()), pa.array(out_spans, kind), pa.array(out_kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")


def merge(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Sorted maximal runs of the union of spans."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return list(zip(starts[new].tolist(), reach[np.append(new[1:], len(starts)) - 1].tolist(), strict=True))


def digests(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of ``remove_duplicates``."""
    cut = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return removed.select("doc_id", "n_bytes", cut.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def oracle_sql() -> str:
    """The same removal window by window, for DuckDB."""
    return f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, s, array_slice(b, s + 1, s + {LENGTH}) AS win FROM (SELECT doc_id, b, unnest(range(0, greatest(0, octet_length(b) - {LENGTH - 1}))) AS s FROM d)),
f AS (SELECT win, min({{'d': doc_id, 's': s}}) AS first FROM w GROUP BY win HAVING count(*) > 1),
r AS (SELECT doc_id, s FROM w JOIN f USING (win) WHERE doc_id <> first.d OR s <> first.s),
i AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {LENGTH} THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT doc_id, min(s) AS a, max(s) + {LENGTH} AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM i) GROUP BY doc_id, k),
p AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM g GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(list_sum(z) - list_sum(a), 0) AS BIGINT) AS n_removed, CAST(coalesce(len(a), 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN a IS NULL THEN b ELSE list_reduce(list_transform(range(0, len(a) + 1), lambda k: array_slice(b, CASE WHEN k = 0 THEN 1 ELSE z[k] + 1 END, CASE WHEN k = len(a) THEN octet_length(b) ELSE a[k + 1] END)), lambda x, y: x || y) END) AS kept_sha256
FROM d LEFT JOIN p USING (doc_id)"""
