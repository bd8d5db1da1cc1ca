"""Calibration of confidences: bins, expected calibration error, Brier score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.labels import clamp


def records(df: DataFrame, confidence: str = "confidence", truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(conf, correct) of rows with a truth, a prediction and a confidence."""
    known = F.col(confidence).isNotNull() & F.col(truth).isNotNull() & F.col(pred).isNotNull()
    return df.filter(known).select(clamp(F.col(confidence)).alias("conf"), (F.col(pred) == F.col(truth)).cast("int").alias("correct"))


def _binned(recs: DataFrame, bins: int) -> DataFrame:
    at = F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return recs.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("avg_conf"), F.avg("correct").alias("acc"))


def calibration_bins(recs: DataFrame, bins: int = 10) -> DataFrame:
    """One row for each of ``bins`` equal bins, empty ones included; none without records."""
    found = _binned(recs, bins)
    every = recs.select(F.lit(1).alias("_one")).limit(1).select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    joined = every.join(found, "bin", "left")
    return joined.select(
        "bin",
        F.round(F.col("bin") / bins, 3).alias("bin_lower"),
        F.round((F.col("bin") + 1) / bins, 3).alias("bin_upper"),
        F.coalesce("n", F.lit(0)).cast("long").alias("count"),
        F.round("avg_conf", 4).alias("avg_confidence"),
        F.round("acc", 4).alias("accuracy"),
    )


def calibration_summary(recs: DataFrame, bins: int = 10) -> DataFrame:
    """total, brier_score, expected_calibration_error, bin_count; the scores are null without records."""
    at = F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    sums = recs.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.sum("conf").alias("c"), F.sum("correct").alias("k"), F.sum(F.pow(F.col("conf") - F.col("correct"), 2)).alias("b"))
    total = F.sum("n")
    return sums.agg(
        F.coalesce(total, F.lit(0)).cast("long").alias("total"),
        F.round(F.try_divide(F.sum("b"), total), 6).alias("brier_score"),
        F.round(F.try_divide(F.sum(F.abs(F.col("k") - F.col("c"))), total), 6).alias("expected_calibration_error"),
        F.lit(bins).alias("bin_count"),
    )


def logprob_summary(logprobs) -> F.Column:
    """struct(token_count, avg_logprob, geo_mean_prob) of an array; null if it holds no number."""
    known = F.filter(logprobs, lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(known)
    return F.when(F.size(known) > 0, F.struct(F.size(known).alias("token_count"), mean.alias("avg_logprob"), F.exp(mean).alias("geo_mean_prob")))
