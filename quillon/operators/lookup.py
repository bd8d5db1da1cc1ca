"""Lookups of ground truth: candidate keys, fallback cascades, enrichment, and dedup-evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.ordered import numbered


#: Bits of a key in the filter, and words of 64 bits that are broadcast (about 40 bytes each) at most.
BLOOM_BITS, BLOOM_WORDS = 16, 1 << 20


def _bloom(key: str, words: int) -> tuple[Column, Column]:
    """A key's word of the filter, and its three bits in it."""
    h = F.xxhash64(key)
    bit = lambda by: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}), {by}) & 63 as int))")
    return F.pmod(h, F.lit(words)).alias("_word"), bit(32).bitwiseOR(bit(41)).bitwiseOR(bit(50)).alias("_bits")


def maybe_known(probes: DataFrame, known: DataFrame, key: str, most_words: int = BLOOM_WORDS) -> DataFrame:
    """``probes`` whose ``key`` may be among that of ``known``: all that are, and about one in a hundred of the others.

    A blocked Bloom filter of the known keys is broadcast, so that probes without
    a match are dropped where they are and not shuffled. Its size is checked: for
    more keys than ``most_words`` words hold, the probes come back as they are.
    """
    n = known.agg(F.approx_count_distinct(key)).first()[0]
    words = 1 << max(4, (max(1, n) * BLOOM_BITS // 64).bit_length())
    if words > most_words:
        return probes
    found = known.select(*_bloom(key, words)).groupBy("_word").agg(F.bit_or("_bits").alias("_set"))
    asked = probes.select("*", *_bloom(key, words)).join(F.broadcast(found), "_word")
    return asked.filter(F.col("_bits").bitwiseAND(F.col("_set")) == F.col("_bits")).drop("_word", "_bits", "_set")


def candidate_join(left: DataFrame, right: DataFrame, left_id: str, left_keys: Column, right_keys: Column, right_order: str, value: Column) -> DataFrame:
    """``left`` with ``match``: the right row under the first of the left row's keys that is known.

    Both sides list their spellings, best first. Of right rows under one key the
    last by ``right_order`` counts. ``match`` is null where no key is known.
    Spellings that are unknown go before the shuffle.
    """
    spellings = right.select(F.explode(right_keys).alias("_key"), F.col(right_order).alias("_at"), value.alias("_value"))
    known = spellings.groupBy("_key").agg(F.max_by("_value", "_at").alias("_value"))
    probes = left.select(F.col(left_id).alias("_id"), F.posexplode(left_keys).alias("_pos", "_key"))
    best = maybe_known(probes, spellings, "_key").join(known, "_key").groupBy("_id").agg(F.min_by("_value", "_pos").alias("match"))
    return left.join(best, left[left_id] == best["_id"], "left").drop("_id")


def cascade_join(outputs: DataFrame, records: DataFrame, index_columns: list[tuple[str, str]]) -> DataFrame:
    """``outputs`` with ``match_index`` and ``match_source`` of its source record.

    ``outputs(out_id, path, headline, ...)`` is matched with
    ``records(idx, path, headline)`` by each (column, name) of ``index_columns``,
    where path or headline must agree as well, then by path (first record wins),
    then by headline (first; ``headline*`` if there are several).
    """
    rec = records.select(F.col("idx"), F.col("path").alias("r_path"), F.trim("headline").alias("r_headline"))
    matched, choices = outputs, []
    for i, (column, name) in enumerate(index_columns):
        side = rec.select(F.col("idx").alias(f"_i{i}"), F.col("r_path").alias(f"_p{i}"), F.col("r_headline").alias(f"_h{i}"))
        agrees = (F.trim("headline") == F.col(f"_h{i}")) | ((F.col("path") != "") & (F.col("path") == F.col(f"_p{i}")))
        matched = matched.join(side, matched[column] == side[f"_i{i}"], "left")
        choices.append(F.when(agrees, F.struct(F.col(f"_i{i}").alias("index"), F.lit(name).alias("source"))))
    by_path = rec.filter(F.col("r_path") != "").groupBy(F.col("r_path").alias("_path")).agg(F.min("idx").alias("_path_idx"))
    by_text = rec.filter(F.col("r_headline").isNotNull()).groupBy(F.col("r_headline").alias("_text")).agg(F.min("idx").alias("_text_idx"), F.count(F.lit(1)).alias("_text_n"))
    matched = matched.join(by_path, F.col("path") == F.col("_path"), "left").join(by_text, F.trim("headline") == F.col("_text"), "left")
    choices.append(F.when(F.col("_path_idx").isNotNull(), F.struct(F.col("_path_idx").alias("index"), F.lit("image_path").alias("source"))))
    named = F.when(F.col("_text_n") > 1, "headline*").otherwise("headline")
    choices.append(F.when(F.col("_text_idx").isNotNull(), F.struct(F.col("_text_idx").alias("index"), named.alias("source"))))
    chosen = matched.withColumn("_match", F.coalesce(*choices))
    return chosen.select(*[outputs[c] for c in outputs.columns], F.col("_match.index").alias("match_index"), F.col("_match.source").alias("match_source"))


def source_counts(matched: DataFrame) -> DataFrame:
    """How often each source matched; in order of (-n, match_source)."""
    return matched.filter(F.col("match_source").isNotNull()).groupBy("match_source").agg(F.count(F.lit(1)).alias("n"))


def repair_stats(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count(F.lit(1)).alias("total"), F.count("match_source").alias("matched"), F.count_if(F.col("match_source").isNull()).alias("unmatched"))


def enrich_join(outputs: DataFrame, records: DataFrame, has_details: Column) -> DataFrame:
    """``outputs(index, path)`` with ``details`` of ``records(idx, path, details)`` by index, else by path (last record wins).

    Rows for which ``has_details`` holds keep a null: they have their own.
    """
    by_index = records.select(F.col("idx"), F.col("details").alias("_by_index"))
    by_path = records.groupBy(F.col("path").alias("_path")).agg(F.max_by("details", "idx").alias("_by_path"))
    joined = outputs.join(by_index, outputs["index"] == by_index["idx"], "left").join(by_path, outputs["path"] == by_path["_path"], "left")
    found = F.when(~F.coalesce(has_details, F.lit(False)), F.coalesce("_by_index", "_by_path"))
    return joined.select(*[outputs[c] for c in outputs.columns], found.alias("details"))


def merge_details(existing: Column, details: Column) -> Column:
    """Maps merged: details win, further keys stay."""
    extra = F.map_filter(existing, lambda k, _: ~F.map_contains_key(details, k))
    return F.when(details.isNull(), existing).otherwise(F.map_concat(details, F.coalesce(extra, F.create_map().cast("map<string,string>"))))


def dedup_eval(df: DataFrame, key: str, order: str, evaluate: Callable[[DataFrame], DataFrame], cache: DataFrame | None = None, needed: list[str] | None = None) -> DataFrame:
    """Evaluates an expensive function once for each key, and fans its result out.

    ``evaluate`` maps the representatives (of each key the first row by ``order``,
    of equal ones any) to a frame with ``key`` and result columns; keys in
    ``cache`` (same columns, a row for each key) are not evaluated. A null key is a
    key like any other. ``needed`` names the further columns that ``evaluate``
    uses (all by default); others are not moved. Adds ``cache_hit`` and ``duplicate``.
    """
    rest = [c for c in (df.columns if needed is None else needed) if c not in (key, order)]
    # one aggregation gives a key's first place and its whole row; ties in the order fall to the least row
    first = df.groupBy(key).agg(F.min(order).alias("_first"), F.min_by(F.struct(*rest), order).alias("_row") if rest else F.lit(None).alias("_row"))
    if cache is not None:
        known = cache.withColumn("_known", F.lit(True)).withColumnRenamed(key, "_key")
        met = first.join(known, F.col(key).eqNullSafe(F.col("_key")), "left")
        fresh = met.filter("_known IS NULL")
    else:
        fresh = first
    representatives = fresh.select(*[F.col(c) if c == key else F.col("_first").alias(c) if c == order else F.col(f"_row.{c}").alias(c) for c in [key, order, *rest]])
    results = evaluate(representatives).withColumn("cache_hit", F.lit(False))
    if cache is not None:
        results = results.unionByName(cache.withColumn("cache_hit", F.lit(True)))
    results = results.join(first.select(F.col(key).alias("_key"), "_first"), F.col(key).eqNullSafe(F.col("_key"))).drop(key)
    out = df.join(results, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    return out.withColumn("duplicate", F.col(order) != F.col("_first")).drop("_first")


def batch_metrics(jobs: DataFrame) -> DataFrame:
    """Counters of a batch of ``jobs(key, attempts, duration_ms, failed, cache_hit, duplicate)``."""
    ran = ~F.col("cache_hit") & ~F.col("duplicate")
    executed = F.count_if(ran)
    total = F.coalesce(F.sum(F.when(ran, F.col("duration_ms"))), F.lit(0.0))
    counts = jobs.agg(
        F.count(F.lit(1)).alias("queued"),
        F.count_if(~F.col("duplicate")).alias("unique"),
        executed.alias("unique_executed"),
        F.count_if(F.col("duplicate")).alias("duplicates"),
        F.count_if(F.col("cache_hit")).alias("cache_hits"),
        F.count_if(ran & ~F.col("failed")).alias("unique_success"),
        F.count_if(ran & F.col("failed")).alias("unique_error"),
        F.coalesce(F.sum(F.when(ran, F.greatest(F.lit(0), F.col("attempts") - 1))), F.lit(0)).cast("long").alias("retry_count"),
        F.round(total, 3).alias("duration_ms_total"),
        F.coalesce(F.max(F.when(ran, F.col("duration_ms"))), F.lit(0.0)).alias("duration_ms_max"),
    )
    return counts.withColumn("avg_duration_ms", F.round(F.coalesce(F.try_divide("duration_ms_total", "unique_executed"), F.lit(0.0)), 3))


def remaining(all_rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not yet done."""
    return all_rows.join(done.select(key), key, "left_anti")


def sequential_check(df: DataFrame, order: str, stored: str) -> DataFrame:
    """Rows whose stored index is not their place in an order."""
    return numbered(df, order, "expected").filter(F.col(stored) != F.col("expected"))


def first_and_more(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``order`` with a null ``more``, and a row of nulls that says how many there are besides."""
    shown = df.orderBy(order).limit(n).withColumn("more", F.lit(None).cast("string"))
    total = df.agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > n)
    rest = total.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields], F.concat(F.lit("... and "), (F.col("_n") - n).cast("string"), F.lit(" more")).alias("more"))
    return shown.unionByName(rest)


def by_index(df: DataFrame, column: str = "sample_index") -> DataFrame:
    """Rows in the order of an index; without one they count as 0."""
    return df.orderBy(F.coalesce(F.col(column), F.lit(0)))


def with_fallback_result(questions: DataFrame, batch: DataFrame, key: str, payload: str, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``questions`` with the batch's ``payload`` of their key; those without one, or with an error, are asked singly.

    ``batch`` has the key, the payload and ``error``; ``ask`` maps the keys that
    are left to key and payload.
    """
    good = batch.filter(F.col("error").isNull() & F.col(payload).isNotNull()).select(key, payload).dropDuplicates([key])
    left = questions.select(key).distinct().join(good.select(key), key, "left_anti")
    found = good.withColumn("from_batch", F.lit(True)).unionByName(ask(left).select(key, payload).withColumn("from_batch", F.lit(False)))
    return questions.join(found, key, "left")


def fold_counters(workers: DataFrame, executed: str = "unique_executed", duration: str = "duration_ms_total") -> DataFrame:
    """The numeric counters of all workers added up, and the mean duration of what was executed."""
    numeric = [f.name for f in workers.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")]
    sums = workers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numeric])
    return sums.withColumn("avg_duration_ms", F.round(F.coalesce(F.try_divide(duration, executed), F.lit(0.0)), 3))
