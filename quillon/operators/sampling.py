"""Seeded orders and samples. Draws are hashes of seed and id, so reruns on any cluster agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: object, ident: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), ident.cast("string")))
    return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double") / float(1 << 32)


def shuffled(df: DataFrame, seed: object, ident: str) -> DataFrame:
    """Rows with ``shuffle_key``; ordered by it (then id) they are shuffled."""
    return df.withColumn("shuffle_key", uniform(seed, F.col(ident)))


def _numbered(df: DataFrame, strata: list[str], seed: object, ident: str, pieces: int = 64) -> DataFrame:
    """Adds _u, and within the stratum _pos (from 0, by _u) and _n.

    A stratum may hold most rows: it is dealt to ranges of _u that are numbered
    alone and shifted by the sizes of the ranges before.
    """
    drawn = df.withColumn("_u", uniform(seed, F.col(ident))).withColumn("_piece", F.floor(F.col("_u") * pieces))
    sizes = drawn.groupBy(*strata, "_piece").agg(F.count(F.lit(1)).alias("_c"))
    below = Window.partitionBy(*strata).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*[F.col(s).alias(f"_k{i}") for i, s in enumerate(strata)], F.col("_piece").alias("_kp"), F.coalesce(F.sum("_c").over(below), F.lit(0)).alias("_shift"), F.sum("_c").over(Window.partitionBy(*strata)).alias("_n"))
    match = F.col("_piece") == F.col("_kp")
    for i, s in enumerate(strata):
        match = match & F.col(s).eqNullSafe(F.col(f"_k{i}"))
    within = Window.partitionBy(*strata, "_piece").orderBy("_u", ident)
    numbered = drawn.withColumn("_row", F.row_number().over(within) - 1).join(shifts, match)
    return numbered.withColumn("_pos", F.col("_row") + F.col("_shift")).drop("_row", "_shift", "_piece", "_kp", *[f"_k{i}" for i in range(len(strata))])


def stratified_order(df: DataFrame, strata: list[str], seed: object, ident: str) -> DataFrame:
    """Adds ``order_score``: in its order every prefix mirrors the mix of the strata."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))  # one row
    numbered = _numbered(df, strata, seed, ident).join(F.broadcast(total))
    score = (F.col("_pos") + F.col("_u")) * F.col("_total") / F.col("_n")
    return numbered.withColumn("order_score", score).drop("_u", "_pos", "_n", "_total")


def undersample(df: DataFrame, cls: str, seed: object, ident: str) -> DataFrame:
    """As many rows of each class as the smallest has; all rows with fewer than two classes."""
    numbered = _numbered(df, [cls], seed, ident)
    sizes = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_c")).agg(F.min("_c").alias("_least"), F.count(F.lit(1)).alias("_classes"))  # one row
    kept = numbered.join(F.broadcast(sizes)).filter((F.col("_classes") < 2) | (F.col("_pos") < F.col("_least")))
    return kept.withColumnRenamed("_u", "shuffle_key").drop("_pos", "_n", "_least", "_classes")


def balanced_budget(df: DataFrame, cls: str, classes: list[str], seed: object, ident: str, total: int | None = None) -> DataFrame:
    """Equal numbers of the named classes, ``total`` in all where there are enough.

    Raises ValueError if a class has no rows, or for a total that is not positive
    or not divisible by the number of classes.
    """
    if total is not None and total <= 0:
        raise ValueError("the total must be positive")
    if total is not None and total % len(classes):
        raise ValueError(f"{total} rows cannot be shared equally by {len(classes)} classes")
    named = df.filter(F.col(cls).isin(*classes))
    found = {r[0]: r[1] for r in named.groupBy(cls).count().collect()}  # at most one row a class
    if missing := [c for c in classes if not found.get(c)]:
        raise ValueError("no rows of class " + ", ".join(missing))
    each = min(found.values()) if total is None else min(total // len(classes), *found.values())
    kept = _numbered(named, [cls], seed, ident).filter(F.col("_pos") < each)
    return kept.withColumnRenamed("_u", "shuffle_key").drop("_pos", "_n")


def bucket_counts(df: DataFrame, cls: str) -> DataFrame:
    """Size of each class and the least of all."""
    sizes = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("min_count", F.min("n").over(Window.partitionBy()))
