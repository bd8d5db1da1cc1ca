"""Near duplicates by Jaccard similarity of word shingles: MinHash bands for candidates, each link verified.

Texts link if their sets of shingles have a Jaccard similarity of 4/5 and more.
Equal sets meet by a digest before anything else. Candidates share one of
``BANDS`` buckets, each the hash of ``ROWS`` MinHash values: a pair at 0.8 is
missed with probability (1 - 0.8^4)^24 = 3e-6, one at 0.9 with 3e-12. Every
link is verified on the sets themselves.

* Links may be sought by an index of fingerprints first (``simhash.keep_one``):
  its candidates are verified, and pairs of small buckets that these links
  connect already are not looked at again.
* A bucket of up to ``SMALL`` members gives its pairs (a bounded number for each
  member), which are joined with the sets.
* Larger buckets are joined into families by their members. A family's sets go
  to one task, which never lists its pairs: sets are taken by size, looked up in
  an inverted index of their rarest shingles (two sets that are similar enough
  share one of these: prefix filtering, exact), compared only with sets they are
  not yet connected with, and united. So members that link cost about one
  comparison each, and those that do not have hardly a candidate.
* A family of more than ``FAMILY`` shingles is dealt into blocks; each pair of
  blocks goes to a task of its own. That is exact as well, and bounds the memory
  of a task; sets then travel once for each block.

Cases: null, empty and blank texts have the empty set and are equal; texts of
fewer words than a shingle are one shingle; rows without doc_id have no group
and stay; rows that repeat a doc_id are one document, which links by any of its
texts; an empty table gives no rows; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize
from quillon.llm.components import components

SHINGLE_WORDS = 5
#: Least similarity of a link, as a fraction.
SIMILARITY = (4, 5)
BANDS, ROWS = 24, 4
#: Members of a bucket whose pairs are listed; shingles of a family that one task holds (8 bytes each).
SMALL, FAMILY = 12, 2_000_000
#: So many doc_ids are broadcast (about 40 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
XXH_SEED = 42
_BLOCK = 1 << 13


def _mixed(n: int, seed: int) -> np.ndarray:
    """n well mixed 64-bit constants (SplitMix64)."""
    z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_FACTORS, _SHIFTS = _mixed(BANDS * ROWS, 1) | np.uint64(1), _mixed(BANDS * ROWS, 2)


def shingle_set(text: bytes, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct XXH64 hashes of a UTF-8 text's shingles, in order."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.array([], np.uint64)
    n = max(1, len(words) - shingle_words + 1)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], XXH_SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n))


def buckets_of(shingles: np.ndarray) -> list[int]:
    """One signed bucket for each band; none of an empty set."""
    import xxhash

    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _BLOCK):
        block = shingles[at : at + _BLOCK]
        for i in range(BANDS * ROWS):
            least[i] = min(least[i], (block * _FACTORS[i] + _SHIFTS[i]).min())
    hashes = [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(hashes, np.uint64).view(np.int64).tolist()


def _signatures(df: DataFrame, shingle_words: int, fingerprint: Callable | None = None) -> DataFrame:
    """doc_id, digest of the set, its size, the buckets, and the text's fingerprint (null without such a function)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            sets = [shingle_set(t.as_py() or b"", shingle_words) for t in texts]
            if fingerprint is None:
                prints = pa.nulls(len(sets), pa.int64())
            else:
                prints = pa.array(np.array([fingerprint(t.as_py() or b"", shingle_words)[0] for t in texts], np.uint64).view(np.int64))
            columns = [
                batch.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()), pa.array([buckets_of(s) for s in sets], pa.list_(pa.int64())), prints,
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "size", "buckets", "fp"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, size long, buckets array<long>, fp long")


def _sets(df: DataFrame, shingle_words: int) -> DataFrame:
    """doc_id and its set of shingles as an array of longs."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i, t in enumerate(batch.column(1).cast(pa.binary())):
                found = pa.array([shingle_set(t.as_py() or b"", shingle_words).view(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), found], names=["doc_id", "shingles"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def _similar(shared: int, a: int, b: int) -> bool:
    p, q = SIMILARITY
    return (p + q) * shared >= p * (a + b)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) of the ``pairs(u, v)`` whose sets are similar enough."""
    joined = pairs.join(sets.toDF("u", "_a"), "u").join(sets.toDF("v", "_b"), "v")
    p, q = SIMILARITY
    shared = F.size(F.array_intersect("_a", "_b"))
    return joined.filter((p + q) * shared >= p * (F.size("_a") + F.size("_b"))).select("u", "v")


def link_family(nodes: list[int], sets: list[np.ndarray], blocks: list[int]) -> list[tuple[int, int]]:
    """Edges that connect just what links among sorted ``sets``; if blocks differ, only links across them count."""
    p, q = SIMILARITY
    _, rank, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # the rarest first; any order that all sets share is right
    place = np.empty(len(count), np.int64)
    place[np.argsort(count, kind="stable")] = np.arange(len(count))
    ends = np.cumsum([len(s) for s in sets])
    rarest = [np.sort(place[rank[end - len(s) : end]]) for s, end in zip(sets, ends.tolist(), strict=True)]
    across = len(set(blocks)) > 1
    root = np.arange(len(sets))
    members: dict[int, list[int]] = {i: [i] for i in range(len(sets))}
    index: dict[int, list[int]] = {}
    edges = []
    for i in sorted(range(len(sets)), key=lambda i: (len(sets[i]), nodes[i])):
        mine, n = rarest[i], len(sets[i])
        # a smaller set that is similar shares p/q of this one, and one of that many less one of the rarest here
        need = -(-p * n // q)
        lists = [index[t] for t in mine[: n - need + 1].tolist() if t in index]
        found, shared = np.unique(np.concatenate([np.array(x) for x in lists]), return_counts=True) if lists else (np.array([], np.int64),) * 2
        found = found[np.argsort(-shared, kind="stable")]  # the likeliest first
        while len(found):
            j, found = int(found[0]), found[1:]
            if (across and blocks[i] == blocks[j]) or q * len(sets[j]) < p * n:
                continue
            if _similar(len(np.intersect1d(mine, rarest[j], assume_unique=True)), n, len(sets[j])):
                edges.append((nodes[i], nodes[j]))
                a, b = int(root[i]), int(root[j])
                if len(members[a]) < len(members[b]):
                    a, b = b, a
                root[members[b]] = a
                members[a] += members.pop(b)
                found = found[root[found] != a]
        # later sets are no smaller: they share 2p/(p + q) of this one
        for t in mine[: n - -(-2 * p * n // (p + q)) + 1].tolist():
            index.setdefault(t, []).append(i)
    return edges


def _search_families(batches: Iterator) -> Iterator:
    """Edges (u, v) from rows (family, one, other, block, node, shingles) sorted by the first three."""
    import pyarrow as pa

    key, nodes, sets, blocks = None, [], [], []

    def settle():
        edges = link_family(nodes, sets, blocks) if len(nodes) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["u", "v"])

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for row, (family, one, other, block, node) in enumerate(zip(*columns, strict=True)):
            if (family, one, other) != key:
                if nodes:
                    yield settle()
                key, nodes, sets, blocks = (family, one, other), [], [], []
            nodes.append(node)
            blocks.append(block)
            sets.append(batch.column(5)[row].values.to_numpy())
    if nodes:
        yield settle()


def _family_links(members: DataFrame, nodes: DataFrame, sets: DataFrame, family_limit: int) -> DataFrame:
    """Links among the ``members(key, node)`` of large buckets."""
    least = members.groupBy("key").agg(F.min("node").alias("v"))
    families = components(members.join(least, "key").select(F.col("node").alias("u"), "v")).toDF("node", "family")
    sized = families.join(nodes.select("node", "size"), "node")
    counts = sized.groupBy("family").agg(F.sum("size").alias("_all"))
    counts = counts.select("family", F.when(F.col("_all") <= family_limit, 1).otherwise(F.ceil(2 * F.col("_all") / F.lit(family_limit))).cast("int").alias("_blocks"))
    dealt = materialize(families.join(counts, "family").withColumn("block", F.pmod(F.xxhash64("node"), "_blocks").cast("int")), "families")
    to = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = dealt.select("node", "family", "block", to.alias("_to")).select("node", "family", F.least("block", "_to").alias("one"), F.greatest("block", "_to").alias("other"), "block")
    rows = dealt.join(sets.toDF("node", "shingles"), "node").select("family", "one", "other", "block", "node", "shingles")
    together = rows.repartition("family", "one", "other").sortWithinPartitions("family", "one", "other")
    return together.mapInArrow(_search_families, "u long, v long")


def _some(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``df`` semi- or anti-joined with a materialised table of doc_ids, without moving ``df`` if they are few."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def later_documents(df: DataFrame, shingle_words: int = SHINGLE_WORDS, small: int = SMALL, family_limit: int = FAMILY, index: tuple[Callable, Callable] | None = None) -> DataFrame:
    """(doc_id) of all but the least document of each group.

    ``index`` is a fingerprint of a text and a function that gives candidates (u, v) of nodes (node, fp).
    """
    fingerprint, candidates = index or (None, None)
    signed = materialize(_signatures(df.filter("doc_id IS NOT NULL"), shingle_words, fingerprint), "minhash")
    sets_of = signed.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("_n"), F.first("size").alias("size"), F.first("buckets").alias("buckets"), F.min_by("fp", "doc_id").alias("fp"))
    nodes = materialize(sets_of, "nodes")
    copies = materialize(signed.select("doc_id", "digest").join(nodes.filter("_n > 1").select("digest", "node"), "digest").filter("doc_id != node").select("doc_id", "node"), "copies")
    members = nodes.select(F.explode("buckets").alias("key"), "node", "size")
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    members = materialize(members.join(buckets, "key"), "buckets")
    wanted = members.select(F.col("node").alias("doc_id"))
    if candidates:
        near = materialize(candidates(nodes.filter("size > 0").select("node", "fp")).filter("u != v").distinct(), "candidates")
        wanted = wanted.union(near.select("u")).union(near.select("v"))
    wanted = materialize(wanted.distinct(), "wanted")
    sets = materialize(_sets(_some(df, wanted, "left_semi"), shingle_words).distinct(), "shingles")
    grouped = members.filter(F.col("_n") <= small).withColumn("group", F.col("node"))
    if candidates:
        indexed = materialize(_verified(near, sets).distinct(), "indexed")
        found = materialize(components(indexed), "found").toDF("node", "_group")
        grouped = grouped.join(found, "node", "left").withColumn("group", F.coalesce("_group", "node"))
    few = grouped.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "size", "group"))).alias("_m"))  # at most ``small`` members
    p, q = SIMILARITY
    each = few.select("_m", F.posexplode("_m").alias("_i", "_a")).select("_a", F.explode(F.slice("_m", F.col("_i") + 2, F.size("_m"))).alias("_b"))
    alike = (F.col("_a.group") != F.col("_b.group")) & (q * F.least("_a.size", "_b.size") >= p * F.greatest("_a.size", "_b.size"))
    links = _verified(each.filter(alike).select(F.col("_a.node").alias("u"), F.col("_b.node").alias("v")).distinct(), sets)
    links = links.union(_family_links(members.filter(F.col("_n") > small).select("key", "node"), nodes, sets, family_limit))
    if candidates:
        links = links.union(indexed)
    # a document with several texts connects their groups
    several = signed.groupBy("doc_id").agg(F.min("digest").alias("_a"), F.max("digest").alias("_b")).filter("_a != _b").select("doc_id")
    links = links.union(copies.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("node").alias("v")))
    roots = components(links)
    return copies.select("doc_id").union(roots.filter("node != component").select(F.col("node").alias("doc_id"))).distinct()


def keep_one(df: DataFrame, shingle_words: int = SHINGLE_WORDS, small: int = SMALL, family_limit: int = FAMILY, index: tuple[Callable, Callable] | None = None) -> DataFrame:
    """``df``'s rows without all but the least doc_id of each near-duplicate group; rows without doc_id stay."""
    return _some(df, materialize(later_documents(df, shingle_words, small, family_limit, index), "later"), "left_anti")
