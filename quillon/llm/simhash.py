"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of 64 bits are eight positional bytes. Two that differ in at most
four bits share at least four of them, hence at least four of the 56 triples of
positions. The index lists every distinct fingerprint under its 56 triples; a
pair that meets there has its shared positional bytes tallied, pairs with fewer
than four are dropped (count filter), the rest is verified bit by bit. Triples
instead of single bytes keep the lists short: 2^24 values for each.

No list is expanded into all its pairs: a list gives the edges of a spanning
forest of its links, found by search from one fingerprint at a time. Lists of
more than ``list_limit`` fingerprints are not searched but exactly rewritten:
two fingerprints are within four bits if and only if some value is within two
bits of both, so their members are linked through these midpoints by an
aggregation, linear in the list. A triple has 2^24 values, so of evenly spread
fingerprints a list would need 10^11 to be that long; smaller tables have such
lists only where fingerprints crowd together.

Cases: null and empty texts have fingerprint zero and link like any other; equal
texts meet in the fingerprint before the index; texts of any length are hashed
in blocks; rows with a null doc_id take their group's id; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import jaccard_dedup
from quillon.llm.common import join_counted, materialize
from quillon.llm.components import components

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
XXH_SEED = 42
LIST_LIMIT = 8192
_BLOCK = 1 << 16
_TRIPLES = list(combinations(range(8), 3))


def _more(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th further hash of shingles from their XXH64."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS, prints: int = 1) -> list[int]:
    """The 64-bit SimHashes of a UTF-8 text, unsigned: the first of XXH64, further ones of hashes of that."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return [0] * prints
    n = max(1, len(words) - shingle_words + 1)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:n].tolist(), ends[-n:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros((prints, 64), np.int64)
    for at in range(0, n, _BLOCK):
        h = np.array([digest(joined[a:b], XXH_SEED) for a, b in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK], strict=True)], "<u8")
        for i in range(prints):
            each = _more(h, i) if i else h
            counts[i] += np.unpackbits(each.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<u8").ravel().tolist()


def fingerprints(df: DataFrame, shingle_words: int = SHINGLE_WORDS, prints: int = 1) -> DataFrame:
    """``df(doc_id, text)`` as doc_id, fp, fp1, fp2, ...: ``prints`` fingerprints as signed longs."""
    names = _names(prints)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.array([fingerprint(t.as_py() or b"", shingle_words, prints) for t in texts], np.uint64).reshape(-1, prints).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(fps[:, i]) for i in range(prints))], names=["doc_id", *names])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def _names(prints: int) -> list[str]:
    return ["fp", *(f"fp{i}" for i in range(1, prints))]


def _linked(a: np.ndarray, b: np.ndarray, max_distance: int) -> np.ndarray:
    """Which fingerprints of ``a`` and ``b`` link: tally of shared positional bytes, then all bits."""
    differ = a ^ b
    shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    enough = shared >= 8 - max_distance
    enough[enough] = np.bitwise_count(differ[enough]) <= max_distance
    return enough


def _forest(fps: np.ndarray, ids: np.ndarray, max_distance: int) -> Iterator[tuple[int, int]]:
    """Edges that connect just what links within one list, without listing its pairs."""
    rest_fp, rest_id = fps, ids
    frontier: list[tuple[int, int]] = []
    while len(rest_fp):
        if not frontier:
            frontier.append((rest_fp[0], rest_id[0]))
            rest_fp, rest_id = rest_fp[1:], rest_id[1:]
        fp, node = frontier.pop()
        near = _linked(rest_fp, np.broadcast_to(fp, rest_fp.shape), max_distance)
        if near.any():
            for other_fp, other in zip(rest_fp[near], rest_id[near], strict=True):
                frontier.append((other_fp, other))
                yield node, other
            rest_fp, rest_id = rest_fp[~near], rest_id[~near]


def _search_lists(batches: Iterator, max_distance: int, list_limit: int) -> Iterator:
    """Edges (u, v) from rows (key, fp, rep) sorted by key; members of long lists as (u, null)."""
    import pyarrow as pa

    held: list[np.ndarray] = []  # the last list seen, still open
    held_key, held_size, long_list = None, 0, False
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("fp", pa.int64())])

    def emit(u, v, fp=None):
        u, v = np.asarray(u, np.int64), None if v is None else np.asarray(v, np.int64)
        none = pa.nulls(len(u), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(u), none if v is None else pa.array(v), none if fp is None else pa.array(fp.view(np.int64))], schema=schema)

    def close():
        fps, ids = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        edges = list(_forest(fps, ids.view(np.int64), max_distance)) if len(fps) > 1 else []
        return emit(*zip(*edges, strict=True)) if edges else None

    for batch in batches:
        key = batch.column(0).to_numpy()
        fps, ids = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.array([], np.int64)
        bounds = [*starts.tolist(), len(key)]
        sizes = np.diff(bounds)
        inner = np.arange(len(sizes))
        pairs = starts[(sizes == 2) & (inner > 0) & (inner < len(sizes) - 1)]
        if len(pairs):
            good = _linked(fps[pairs], fps[pairs + 1], max_distance)
            if good.any():
                yield emit(ids[pairs][good], ids[pairs + 1][good])
        for i in np.flatnonzero((sizes > 2) | (inner == 0) | (inner == len(sizes) - 1)).tolist():
            a, b = bounds[i], bounds[i + 1]
            if held_key is None or key[a] != held_key:
                if held and not long_list and (out := close()) is not None:
                    yield out
                held, held_key, held_size, long_list = [], key[a], 0, False
            held_size += b - a
            held.append((fps[a:b].copy(), ids[a:b].copy()))
            if held_size > list_limit:
                long_list = True
                for f, d in held:
                    yield emit(d, None, f)
                held = []
    if held and not long_list and (out := close()) is not None:
        yield out


def _midpoint_links(members: DataFrame, max_distance: int) -> DataFrame:
    """Links among the fingerprints of long lists, (fp, rep), through values within half the distance of both."""
    half = max_distance // 2
    masks = sorted({sum(1 << b for b in bits) for n in range(half + 1) for bits in combinations(range(64), n)})
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
    near = members.withColumn("mask", F.explode(signed)).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("middle"), "rep")
    least = near.groupBy("middle").agg(F.min("rep").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return near.join(least, "middle").filter("rep != v").select(F.col("rep").alias("u"), "v").distinct()


def _links(nodes: DataFrame, fp: str, max_distance: int, list_limit: int) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) that connect the first ``nodes(node, fp)`` of fingerprints that link, and (fp, rep), those first ones."""
    distinct = materialize(nodes.groupBy(F.col(fp).alias("fp")).agg(F.min("node").alias("rep")), "fingerprints")
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))
    keys = F.array(*[(F.shiftleft(F.lit(c).cast("long"), 24) + F.shiftleft(byte(i), 16) + F.shiftleft(byte(j), 8) + byte(k)) for c, (i, j, k) in enumerate(_TRIPLES)])
    lists = distinct.select(F.explode(keys).alias("key"), "fp", "rep").repartition("key").sortWithinPartitions("key")
    found = materialize(lists.mapInArrow(lambda batches: _search_lists(batches, max_distance, list_limit), "u long, v long, fp long"), "links")
    links = found.filter("v IS NOT NULL").select("u", "v")
    members = found.filter("v IS NULL").select("fp", F.col("u").alias("rep")).distinct()
    if not members.isEmpty():
        links = links.union(_midpoint_links(members, max_distance))
    return links, distinct


def link_components(fps: DataFrame, max_distance: int = MAX_DISTANCE, list_limit: int = LIST_LIMIT, prints: int = 1) -> DataFrame:
    """(fingerprints, component_id, _count) of ``fps(doc_id, fp, ...)``: the least doc_id reachable over links of any of the fingerprints, and their rows."""
    if max_distance not in (2, 4):
        raise ValueError("the index is exact for distances 2 and 4")
    names = _names(prints)
    nodes = materialize(fps.groupBy(*names).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("_count")), "nodes")
    named, edges = nodes.filter("node IS NOT NULL"), None
    for fp in names:
        links, distinct = _links(named, fp, max_distance, list_limit)
        if prints > 1:  # nodes that share this fingerprint, but not all
            same = named.select("node", F.col(fp).alias("fp")).join(distinct, "fp").filter("node != rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
            links = links.union(same)
        edges = links if edges is None else edges.union(links)
    roots = components(edges).withColumnRenamed("node", "_node")
    return nodes.join(roots, nodes.node == roots["_node"], "left").select(*names, F.coalesce("component", "node").alias("component_id"), "_count")


def near_duplicates(df: DataFrame, shingle_words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE, list_limit: int = LIST_LIMIT, prints: int = 1) -> DataFrame:
    """``df(doc_id, text)`` as doc_id, fingerprint (the first, hex), component_id."""
    fps = materialize(fingerprints(df, shingle_words, prints), "simhash")
    named = materialize(link_components(fps, max_distance, list_limit, prints), "components")
    return join_counted(fps, named, _names(prints), "_count").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def candidates(nodes: DataFrame) -> DataFrame:
    """(u, v): what connects those of ``nodes(node, fp)`` whose fingerprints link, from the index; nodes of one fingerprint are paired with its first."""
    links, distinct = _links(nodes, "fp", MAX_DISTANCE, LIST_LIMIT)
    same = nodes.join(distinct, "fp").filter("node != rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
    return links.union(same)


def keep_one(df: DataFrame, shingle_words: int = jaccard_dedup.SHINGLE_WORDS) -> DataFrame:
    """``df``'s rows without all but the least doc_id of each near-duplicate group; rows without doc_id stay.

    The index of fingerprints gives candidates first, and ``jaccard_dedup``
    verifies each on its sets. Fingerprints lose most pairs of similarity 0.8, at
    any number of prints that is worth its cost: links that the index did not
    give are then sought there by MinHash bands.
    """
    return jaccard_dedup.keep_one(df, shingle_words, index=(fingerprint, candidates))
