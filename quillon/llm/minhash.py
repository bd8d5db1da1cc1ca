"""MinHash near-duplicates: one-permutation sketches, banded buckets, star-shaped candidates, links confirmed on full sets.

A set's sketch takes one hash of each shingle: its leading bits choose one of
``BINS`` bins, each bin keeps its least hash. Empty bins are densified optimally:
each looks through the bins in a random order of its own, the same for every set,
and takes the value of the first that is not empty. ``ROWS`` bins make a band, a
band a bucket; a pair of similarity 0.8 shares no bucket with probability
(1 - 0.8^4)^32 = 5e-8.

A bucket of m sets gives m - 1 candidates: the star from its least set to the
others. Candidates are verified on the full sets and the links united. That alone
would lose links between two leaves, so no bucket is left before it is settled:

* A bucket whose sets are all in one component has nothing to lose.
* The sets of the other buckets are bucketed anew by their rarest shingles. Two
  sets that link share one of the ``n - ceil(0.8 n) + 1`` rarest of either (prefix
  filtering, exact), and behind the rarest that they share both have enough left
  to link (positional filtering, exact); sets that only share boilerplate no
  longer meet.
* In these buckets the members of the smallest components are centres of further
  stars, ``GROWTH`` times as many each round, until each bucket is one component or
  has had all of its pairs across components tested. Candidates of sets whose sizes
  rule out a link are dropped, as are pairs tested before.

So the candidates of a group of copies stay linear in its size, and no two sets
are skipped. Equal sets are one set before the first bucket.

Cases: null, empty and blank texts have the empty set and link with nothing; texts
of fewer words than a shingle are one shingle; rows without doc_id are in no
component and stay; rows that repeat a doc_id are one document, which links by any
of its texts; texts of any length are whole; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import join_counted, materialize
from quillon.llm.components import components
from quillon.llm.jaccard_dedup import shingle_set

SHINGLE_WORDS = 4
#: Least similarity of a link, as a fraction.
SIMILARITY = (4, 5)
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Centres of a bucket in the first of the later rounds, and their growth from round to round.
CENTRES, GROWTH, MAX_ROUNDS = 2, 8, 30
#: So many doc_ids are broadcast (about 40 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_SHIFT = _U(64 - BINS.bit_length() + 1)
#: The order in which an empty bin looks for a value.
_ORDER = np.argsort(_mix(np.arange(1, BINS * BINS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)).reshape(BINS, BINS), axis=1)
_BAND_SEEDS = _mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0xD1B54A32D192ED03))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """``BINS`` values of a set that is not empty: least hashes of its bins, empty ones densified."""
    h = np.sort(_mix(shingles))
    bins = (h >> _SHIFT).astype(np.int64)
    first = np.concatenate([[True], bins[1:] != bins[:-1]])
    filled, values = np.zeros(BINS, bool), np.zeros(BINS, np.uint64)
    filled[bins[first]], values[bins[first]] = True, h[first]
    empty = np.flatnonzero(~filled)
    source = _ORDER[empty, filled[_ORDER[empty]].argmax(axis=1)]
    values[empty] = values[source]
    return values


def buckets_of(shingles: np.ndarray) -> np.ndarray:
    """One signed bucket for each band; none of an empty set."""
    if not len(shingles):
        return np.array([], np.int64)
    values, key = sketch(shingles).reshape(BANDS, ROWS), _BAND_SEEDS
    for i in range(ROWS):
        key = _mix(key ^ values[:, i])
        key = key * _U(0x9E3779B97F4A7C15) + _U(i + 1)
    return key.view(np.int64)


def _signatures(df: DataFrame, shingle_words: int) -> DataFrame:
    """doc_id, digest of the set, its size, and the buckets."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            sets = (shingle_set(t.as_py() or b"", shingle_words) for t in batch.column(1).cast(pa.binary()))
            rows = [(xxhash.xxh3_128_digest(s.tobytes()), len(s), buckets_of(s)) for s in sets]
            digests, sizes, buckets = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(buckets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "size", "buckets"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, size long, buckets array<long>")


def _sets(df: DataFrame, nodes: DataFrame, shingle_words: int) -> DataFrame:
    """(node, shingles) of the ``nodes(node)``, from the texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i, t in enumerate(batch.column(1).cast(pa.binary())):
                found = pa.array([shingle_set(t.as_py() or b"", shingle_words).view(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), found], names=["node", "shingles"])

    wanted = nodes.select(F.col("node").alias("doc_id"))
    chosen = df.select("doc_id", "text").join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "doc_id", "left_semi")
    return materialize(chosen.mapInArrow(run, "node long, shingles array<long>").distinct(), "shingle-sets")


def _alike(a: str, b: str):
    """Whether the sizes of two sets allow a link."""
    p, q = SIMILARITY
    return q * F.least(a, b) >= p * F.greatest(a, b)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) of the ``pairs(u, v)`` whose full sets link."""
    p, q = SIMILARITY
    joined = pairs.join(sets.toDF("v", "_b"), "v").join(sets.toDF("u", "_a"), "u")
    shared = F.size(F.array_intersect("_a", "_b"))
    return joined.filter((p + q) * shared >= p * (F.size("_a") + F.size("_b"))).select("u", "v")


def _prefix_members(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, node, size, rank): the rarest shingles of the ``nodes(node)``, those that two of them have, with their rank in the set."""
    p, q = SIMILARITY
    each = sets.join(nodes, "node", "left_semi").select("node", F.size("shingles").cast("long").alias("size"), F.explode("shingles").alias("key"))
    common = materialize(each.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "common-shingles")
    shared = join_counted(each, common.withColumn("_count", F.col("_n")), ["key"], "_n")
    # shingles of one set only are the rarest, but no key; a set's others follow them by their count, then by their hash
    before = Window.partitionBy("node").orderBy("_count", "key")
    ranked = shared.withColumn("_rank", F.row_number().over(before)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy("node")))
    ranked = ranked.withColumn("rank", F.col("_rank") + F.col("size") - F.col("_all"))
    return ranked.filter(F.col("rank") <= F.col("size") - F.ceil(F.lit(p) * F.col("size") / q) + 1).select("key", "node", "size", "rank")


def _in_reach(size: str, rank: str, other_size: str, other_rank: str):
    """Whether two sets can link if this key, at these ranks, is the rarest shingle they share: enough must follow it in both."""
    p, q = SIMILARITY
    least = F.ceil(F.lit(p) * (F.col(size) + F.col(other_size)) / (p + q))
    return (F.col(rank) <= F.col(size) + 1 - least) & (F.col(other_rank) <= F.col(other_size) + 1 - least)


class _Links:
    """Verified links so far, the pairs that were tested, and the components they make."""

    def __init__(self, df: DataFrame, shingle_words: int, links: DataFrame):
        self.df, self.shingle_words = df, shingle_words
        self.sets, self.tested, self.links = None, None, links
        self.component = None

    def test(self, stars: DataFrame) -> None:
        """Verify ``stars(u, v)`` that are new, and unite what links."""
        pairs = stars.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["u", "v"], "left_anti")
        pairs = materialize(pairs, "candidates")
        if self.sets is None:
            nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
            self.sets = _sets(self.df, materialize(nodes, "candidate-nodes"), self.shingle_words)
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        found = materialize(_verified(pairs, self.sets), "links")
        self.links = self.links.union(found)
        if self.component is None or not found.isEmpty():
            self.component = materialize(components(self.links), "node-components")

    def unsettled(self, members: DataFrame) -> DataFrame:
        """``members(key, node, ...)`` with component and _n, how many of the key's have it; of keys that hold several components."""
        placed = members.join(self.component, "node", "left").select(*members.columns, F.coalesce("component", "node").alias("component"))
        counts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("_n"))
        several = counts.groupBy("key").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c")
        return placed.join(counts.join(several, "key", "left_semi"), ["key", "component"]).select(*members.columns, "component", "_n")

    def settle(self, members: DataFrame) -> None:
        """Test further stars until no key of ``members(key, node, size, rank)`` has an untested pair across components that could link by it."""
        centres = CENTRES
        for _ in range(MAX_ROUNDS):
            members = materialize(self.unsettled(members), "unsettled")
            if members.isEmpty():
                return
            first = Window.partitionBy("key").orderBy("_n", "component", "node")
            chosen = materialize(members.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= centres).drop("_rank", "_n"), "centres")
            several = chosen.select("key", F.col("node").alias("u"), F.col("size").alias("_size"), F.col("rank").alias("_rank"), F.col("component").alias("_component"))
            fits = (F.col("component") != F.col("_component")) & _alike("size", "_size") & _in_reach("size", "rank", "_size", "_rank")
            stars = members.join(several, "key").filter(fits).select("u", F.col("node").alias("v"))
            self.test(stars)
            members = members.join(chosen.select("key", "node"), ["key", "node"], "left_anti").select("key", "node", "size", "rank")  # all pairs of a centre are tested
            centres *= GROWTH
        raise RuntimeError(f"buckets did not settle in {MAX_ROUNDS} rounds")


def node_components(df: DataFrame, nodes: DataFrame, several: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(node, component) of sets that link; ``nodes(node, size, buckets)`` are different sets, ``several(u, v)`` links given."""
    members = nodes.select(F.explode("buckets").alias("key"), "node", "size")
    shared = members.groupBy("key").agg(F.min(F.struct("node", "size")).alias("_least"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    members = materialize(join_counted(members, materialize(shared, "buckets"), ["key"], "_n").select("key", "node", "size", "_least"), "members")
    found = _Links(df, shingle_words, several)
    found.test(members.filter("node != _least.node").filter(_alike("size", "_least.size")).select(F.col("_least.node").alias("u"), F.col("node").alias("v")))
    rest = materialize(found.unsettled(members.select("key", "node", "size")).groupBy("node").agg(F.first("size").alias("size")), "rest")
    if not rest.isEmpty():
        found.sets = _sets(df, rest.join(found.sets.select("node").distinct(), "node", "left_anti"), shingle_words).union(found.sets)
        found.settle(_prefix_members(rest, found.sets))
    return found.component


def near_duplicates(df: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``df(doc_id, text)`` as doc_id, n_shingles, component_id (the least doc_id reachable), kept (whether it is the own)."""
    signed = materialize(_signatures(df, shingle_words), "minhash")
    with_id = signed.filter("doc_id IS NOT NULL AND size > 0")
    nodes = materialize(with_id.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("_n"), F.first("size").alias("size"), F.first("buckets").alias("buckets")), "nodes")
    digests = with_id.groupBy("doc_id").agg(F.min("digest").alias("_a"), F.max("digest").alias("_b")).filter("_a != _b").select("doc_id")
    # a document with several texts connects their groups
    several = with_id.join(digests, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(nodes.select("digest", "node"), "digest").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    roots = node_components(df, nodes, materialize(several, "several"), shingle_words)
    named = nodes.join(roots, "node", "left").select("digest", "_n", F.coalesce("component", "node").alias("component_id"))
    linked = join_counted(with_id.select("doc_id", "digest", "size"), materialize(named, "named"), ["digest"], "_n").select("doc_id", "size", "component_id")
    alone = signed.filter("doc_id IS NULL OR size = 0")
    # an empty text of a document that has others is in their component
    empty = alone.filter("doc_id IS NOT NULL").select("doc_id", "size").join(linked.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "doc_id", "left")
    rows = linked.unionByName(empty).unionByName(alone.filter("doc_id IS NULL").select("doc_id", "size", F.lit(None).cast("long").alias("component_id")))
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
