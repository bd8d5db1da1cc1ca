"""Token usage, run counters, and audits of request rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.ordered import scan


def row_total(prompt: Column, completion: Column, total: Column) -> Column:
    """The stated total, or the sum where it is missing or 0."""
    return F.coalesce(F.nullif(total, F.lit(0)), F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0)))


def token_totals(df: DataFrame) -> DataFrame:
    """Grand totals of ``df(prompt, completion, total)``."""
    total = row_total(F.col("prompt"), F.col("completion"), F.col("total"))
    return df.agg(F.sum(F.coalesce("prompt", F.lit(0))).alias("prompt"), F.sum(F.coalesce("completion", F.lit(0))).alias("completion"), F.sum(total).alias("total"))


def usage_rollup(df: DataFrame, *levels: str) -> DataFrame:
    """Totals at each level and over all; ``level`` is how many columns are rolled up."""
    return df.rollup(*levels).agg(F.grouping_id().alias("level"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum("total").alias("total"))


def usage_delta(df: DataFrame, worker: str, order: list[str], counter: str) -> DataFrame:
    """Adds ``delta``: growth of a worker's cumulative counter, never below 0; a missing count before counts as 0 only for a worker's first row."""
    before = scan(df, worker, order, lags={"_before": F.struct(F.col(counter).alias("v"))})
    grown = F.col(counter) - F.when(F.col("_before").isNull(), 0).otherwise(F.col("_before.v"))
    return before.withColumn("delta", F.greatest(F.lit(0), grown)).drop("_before")


def seconds_per_sample(seconds: Column, samples: Column) -> Column:
    return F.try_divide(seconds.cast("double"), samples.cast("double"))


def rate_audit(df: DataFrame, key: str, ts: str, ident: str, seconds: int) -> DataFrame:
    """Adds ``recent``: requests of the key in the last ``seconds`` seconds, this one included; ``ident`` tells rows apart.

    It is the number of requests up to a row's time less those before the span:
    each row asks for both counts where they stand in the key's order, and one
    running sum answers all questions, however many requests a span holds.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    # before, at and after the requests of one moment
    asked = F.array(*[F.struct((micros - back).alias("_at"), F.lit(side).alias("_side")) for back, side in ((seconds * 1_000_000, 0), (0, 1), (0, 2))])
    marks = df.select(F.col(key).alias("_key"), F.col(ident).alias("_id"), F.explode(asked).alias("_mark")).select("_key", "_id", "_mark.*")
    counted = scan(marks, "_key", ["_at", "_side", "_id"], sums={"_n": (F.col("_side") == 1).cast("long")})
    spans = counted.filter("_side != 1").groupBy("_id").agg(F.sum(F.when(F.col("_side") == 2, F.col("_n")).otherwise(-F.col("_n"))).alias("recent"))
    return df.join(spans, df[ident] == spans["_id"]).drop("_id")


def spacing_audit(df: DataFrame, key: str, ts: str, ident: str) -> DataFrame:
    """Adds ``gap_s``: seconds since the key's last request; null for its first."""
    timed = df.withColumn("_micros", F.unix_micros(F.col(ts).cast("timestamp")))
    gaps = scan(timed, key, ["_micros", ident], lags={"_before": F.col("_micros")})
    return gaps.withColumn("gap_s", (F.col("_micros") - F.col("_before")) / 1e6).drop("_micros", "_before")
