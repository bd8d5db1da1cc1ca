"""Mixing sources to target weights by capped water-filling.

Every source gets its weight's share of all words, but no more than
``max_epochs`` times what it has; what it cannot take is shared again by weight
among the others until nobody is above. Sorted by capacity over weight that is
one prefix sum over the (small) table of sources. A source's target is met with
whole repetitions of all its documents and a seeded sample for the fraction: its
documents in the order of a hash, up to the words still missing.

The sample needs a running sum in that order. A source may hold a third of all
rows, so documents are first summed in 4096 hash buckets; only the one bucket in
which the sum is reached is ordered row by row. What comes of it is one row a
source, the place where its sample ends; with that each document's repetitions
are decided where it is read, so no text is shuffled.

Cases: null or empty texts have size 0 and take 0 words; a null source is a
source of its own, after all others; a source without words has target 0; an
empty table gives no rows; rows that repeat a doc_id and size are drawn alike, as
are those without doc_id; further columns are ignored by ``mix`` and kept by
``repeat_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import WORD, fresh_name, materialize

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 42
#: So many sources' plans (about 200 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources(source, source_size)`` with ``target``; one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", max_epochs * F.col("source_size")).withColumn("_level", F.col("_cap") / F.col("_weight"))
    upward = Window.orderBy("_level", F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    filled = ranked.select(
        "*",
        F.coalesce(F.sum("_cap").over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"),
        F.sum("_weight").over(upward.rowsBetween(0, Window.unboundedFollowing)).alias("_open"),
        F.sum("source_size").over(everyone).alias("_total"),
    ).withColumn("_water", (F.col("_total") - F.col("_below")) / F.col("_open"))
    # the lowest level that is not reached sets the water for it and all above
    water = F.min(F.when(F.col("_water") <= F.col("_level"), F.struct("_level", "_water"))).over(everyone)["_water"]
    target = F.least(F.col("_cap").cast("double"), F.coalesce(water * F.col("_weight"), F.col("_cap").cast("double")))
    return filled.select("source", "source_size", target.alias("target"))


def _ticket(seed: int) -> Column:
    """A document's place in the seeded order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _plan(docs: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """A row for each source of ``docs(doc_id, source, size, ticket)``: its target, whole repetitions and where the fraction ends."""
    docs = docs.withColumn("_bucket", F.substring("ticket", 1, 3))
    buckets = materialize(docs.groupBy("source", "_bucket").agg(F.sum("size").alias("_words")), "mix-buckets")
    targets = water_fill(buckets.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    targets = targets.withColumn("whole", whole.cast("int")).withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = materialize(targets, "mix-targets")
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    summed = buckets.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    summed = summed.alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source")).select("b.*", "missing").filter("_before < missing")
    inside = F.col("_before") + F.col("_words") < F.col("missing")
    full = summed.groupBy("source").agg(F.max(F.when(inside, F.col("_bucket"))).alias("full"))
    edge = summed.filter(~inside).select("source", "_bucket", "_before", "missing")
    rows = docs.alias("d").join(edge.alias("e"), F.expr("d.source <=> e.source AND d._bucket = e._bucket"))  # one bucket a source
    within = Window.partitionBy("source", "_bucket").orderBy("ticket", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("missing") - F.col("_before") - F.coalesce(F.sum("size").over(within), F.lit(0))
    # the document at the edge is taken if that brings the sum nearer
    taken = rows.select("d.*", "missing", "_before").withColumn("_left", left).filter("_left > 0 AND size <= 2 * _left")
    cut = taken.groupBy("source").agg(F.max(F.struct("ticket", "doc_id", "size")).alias("cut"))
    joined = targets.alias("t").join(full.alias("f"), F.expr("t.source <=> f.source"), "left").join(cut.alias("c"), F.expr("t.source <=> c.source"), "left")
    return materialize(joined.select(F.col("t.source").alias("_source"), "source_size", "target", "whole", "full", "cut"), "mix-plan")


def _sized(df: DataFrame, seed: int) -> DataFrame:
    return df.select("doc_id", "source", size_in_words(F.col("text")).alias("size"), _ticket(seed).alias("ticket"))


def _repeats(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows(doc_id, source, size, ticket)`` with the plan's columns and ``repeats``; the plan of a bounded number of sources is broadcast."""
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    more = F.coalesce(F.substring("ticket", 1, 3) <= F.col("full"), F.lit(False)) | F.coalesce(F.struct("ticket", "doc_id", "size") <= F.col("cut"), F.lit(False))
    return rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("repeats", F.col("whole") + F.when(more, 1).otherwise(0))


def mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``df(doc_id, source, text)`` as doc_id, size, source_size, target, taken, repeats."""
    docs = materialize(_sized(df, seed), "mix-sizes")
    rows = _repeats(docs, _plan(docs, weights, max_epochs))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).cast("long").alias("taken"), "repeats")


def repeat_documents(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``df``'s rows as often as the mix takes them, decided where they are read; documents without words stay once."""
    row = fresh_name(df, "row")
    plan = _plan(materialize(_sized(df, seed), "mix-sizes"), weights, max_epochs)
    whole = df.select(F.struct(*df.columns).alias(row), "doc_id", "source", size_in_words(F.col("text")).alias("size"), _ticket(seed).alias("ticket"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("repeats"))
    return _repeats(whole, plan).withColumn("_times", F.explode(F.array_repeat(F.lit(1), times))).select(f"{row}.*")


def oracle_sql() -> str:
    """The same mix for DuckDB; the levels are tried one by one."""
    return f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ticket FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w FROM d GROUP BY source),
levels AS (
  SELECT a.lv, sum(least({MAX_EPOCHS} * s.source_size, a.lv * s.w)) AS filled
  FROM s, (SELECT DISTINCT {MAX_EPOCHS} * source_size / w AS lv FROM s) a GROUP BY a.lv),
top AS (SELECT min(lv) AS lv FROM levels WHERE filled >= (SELECT sum(source_size) FROM s)),
water AS (
  SELECT ((SELECT sum(source_size) FROM s) - coalesce(sum(CASE WHEN {MAX_EPOCHS} * source_size / w < lv THEN {MAX_EPOCHS} * source_size END), 0))
         / sum(CASE WHEN {MAX_EPOCHS} * source_size / w >= lv THEN w END) AS x FROM s, top),
t AS (
  SELECT source, source_size, least(CAST({MAX_EPOCHS} * source_size AS DOUBLE), x * w) AS target,
         CASE WHEN source_size > 0 THEN least({MAX_EPOCHS}, floor(least({MAX_EPOCHS} * source_size, x * w) / source_size)) ELSE 0 END AS whole FROM s, water),
r AS (
  SELECT d.*, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size
         - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ticket, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS missing
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 3) AS target, CAST(size * (whole + e) AS BIGINT) AS taken, CAST(whole + e AS INTEGER) AS repeats
FROM (SELECT *, CASE WHEN missing > 0 AND size <= 2 * missing THEN 1 ELSE 0 END AS e FROM r)"""
