"""Shards of near-equal size by best-fit-decreasing packing of indivisible groups.

A group is all documents of one text. Best fit looks only at sizes, and groups
of one size are interchangeable, so the packing needs just the histogram of
group sizes: the driver packs classes (size, count), the executors number the
groups within a class and look their shard up. Sizes of 4096 and more are
rounded up to 12 significant bits, which bounds the histogram at about 100,000
classes for data of any size and the error at 1/2048 of a group.

Each class, largest first, goes to the bin with the tightest remaining capacity
that holds it, found in an AVL tree over (remaining, bin). With a fixed capacity
this opens as few bins as it can; for a fixed number of bins the least capacity
that needs no more is searched for. Groups above an even share get a bin each.

Cases: null text counts as empty (size 8 with the overhead); repeated rows count
each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import join_counted, materialize, with_slot

SHARDS = 24
#: Bytes that a shard spends on each document besides its text.
OVERHEAD = 8


class CapacityTree:
    """AVL tree of (remaining, bin)."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _height(node) -> int:
        return node[3] if node else 0

    def _node(self, key, left, right):
        return (key, left, right, 1 + max(self._height(left), self._height(right)))

    def _balance(self, key, left, right):
        lh, rh = self._height(left), self._height(right)
        if lh > rh + 1:
            if self._height(left[1]) >= self._height(left[2]):
                return self._node(left[0], left[1], self._node(key, left[2], right))
            mid = left[2]
            return self._node(mid[0], self._node(left[0], left[1], mid[1]), self._node(key, mid[2], right))
        if rh > lh + 1:
            if self._height(right[2]) >= self._height(right[1]):
                return self._node(right[0], self._node(key, left, right[1]), right[2])
            mid = right[1]
            return self._node(mid[0], self._node(key, left, mid[1]), self._node(right[0], mid[2], right[2]))
        return self._node(key, left, right)

    def add(self, key) -> None:
        def put(node):
            if not node:
                return (key, None, None, 1)
            return self._balance(node[0], put(node[1]), node[2]) if key < node[0] else self._balance(node[0], node[1], put(node[2]))

        self.root = put(self.root)

    def remove(self, key) -> None:
        def least(node):
            return least(node[1]) if node[1] else node[0]

        def drop(node, key):
            if key < node[0]:
                return self._balance(node[0], drop(node[1], key), node[2])
            if key > node[0]:
                return self._balance(node[0], node[1], drop(node[2], key))
            if not node[1] or not node[2]:
                return node[1] or node[2]
            after = least(node[2])
            return self._balance(after, node[1], drop(node[2], after))

        self.root = drop(self.root, key)

    def tightest(self, size: int):
        """The least key with room for ``size``; None if no bin has."""
        node, found = self.root, None
        while node:
            if node[0][0] >= size:
                node, found = node[1], node[0]
            else:
                node = node[2]
        return found


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int, bins: int | None = None, first: int = 0):
    """[(size, first rank, ranks, bin)] for ``classes`` of (size, count); None if ``bins`` do not suffice.

    Of equal groups those that still fit follow the first into its bin: after
    each, that bin is the tightest that holds the next.
    """
    tree, opened, out = CapacityTree(), 0, []
    for size, count in sorted(classes, reverse=True):
        rank = 0
        while rank < count:
            key = tree.tightest(size)
            if key:
                tree.remove(key)
            elif bins is not None and opened >= bins:
                return None
            else:
                key, opened = (capacity, first + opened), opened + 1
            taken = min(count - rank, key[0] // size)
            out.append((size, rank, taken, key[1]))
            tree.add((key[0] - taken * size, key[1]))
            rank += taken
    return out


def pack_classes(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Best fit into ``shards`` bins of the least capacity found; see best_fit_decreasing."""
    alone, left, total = [], {s: c for s, c in classes}, sum(s * c for s, c in classes)
    for size in sorted(left, reverse=True):
        rank = 0
        while left[size] and len(alone) < shards - 1 and size * (shards - len(alone)) > total:
            alone.append((size, rank, 1, len(alone)))
            left[size], rank, total = left[size] - 1, rank + 1, total - size
        if left[size]:
            break
    taken = {s: sum(1 for a in alone if a[0] == s) for s in left}
    rest, bins = [(s, c) for s, c in left.items() if c], shards - len(alone)
    if not rest:
        return alone
    low = max(-(-total // bins), max(s for s, _ in rest))
    step, tight, found = max(1, low >> 14), low - 1, None
    while found is None:
        high = low if tight < low else tight + step
        found = best_fit_decreasing(rest, high, bins, len(alone))
        if found is None:
            tight, step = high, 2 * step
    for _ in range(12):
        if high - tight <= max(1, low >> 14):
            break
        middle = (tight + high) // 2
        better = best_fit_decreasing(rest, middle, bins, len(alone))
        found, high, tight = (better, middle, tight) if better is not None else (found, high, middle)
    return alone + [(s, r + taken[s], n, b) for s, r, n, b in found]


def shard(df: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """``df(doc_id, text)`` as doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = df.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = materialize(df.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("_group")), "sharding")
    groups = docs.groupBy("_group").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_count"))
    unit = F.pow(F.lit(2), F.greatest(F.lit(0), F.length(F.bin("_bytes")) - 12)).cast("long")
    groups = groups.withColumn("_class", (F.ceil(F.col("_bytes") / unit) * unit).cast("long"))
    groups = materialize(groups, "groups")
    classes = [(r[0], r[1]) for r in groups.groupBy("_class").count().collect()]
    plan = [(s, r, r + n, b) for s, r, n, b in pack_classes(classes, shards)]
    # bounded by the number of classes (about 100,000) and bins, not by the data
    bins = spark.createDataFrame(plan, "_class long, _from long, _to long, shard int")
    ranked = with_slot(groups, "_class", ["_group"], "_rank")
    placed = ranked.join(F.broadcast(bins), "_class").filter("_rank >= _from AND _rank < _to").select("_group", "shard", "_count")
    rows = join_counted(docs, materialize(placed, "placed"), ["_group"], "_count").drop("_group")
    return with_slot(rows, "shard", ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
