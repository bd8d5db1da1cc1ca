"""ROC and precision-recall curves and their areas, for one or many runs.

Rows are first counted by (run, score). Running sums over scores then need each
run's distinct scores in order. Scores are spread over ``ranges`` ranges: sums
per range give each range its start, and within a range a window runs alone, so
that a run with very many scores is not one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.metrics import ratio

RANGES = 64


def score_counts(df: DataFrame, run: str = "run", score: str = "score", truth: str = "truth") -> DataFrame:
    """(run, score, p, n): positives and negatives at each score."""
    return df.groupBy(F.col(run).alias("run"), F.col(score).alias("score")).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.sum(1 - F.col(truth).cast("long")).alias("n"))


def cumulated(counts: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Adds totals (tot_p, tot_n) and tp, fp: the sums over all scores not below this one. Scores are in [0, 1]."""
    spread = counts.withColumn("_range", F.least(F.floor(F.col("score") * ranges), F.lit(ranges - 1)))
    sums = spread.groupBy("run", "_range").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    above = Window.partitionBy("run").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("run")
    starts = sums.select("run", "_range", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(a) for c, a in (("_p", "_above_p"), ("_n", "_above_n"))], F.sum("_p").over(whole).alias("tot_p"), F.sum("_n").over(whole).alias("tot_n"))
    within = Window.partitionBy("run", "_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    running = spread.select("*", F.sum("p").over(within).alias("_tp"), F.sum("n").over(within).alias("_fp"))
    joined = running.join(starts, ["run", "_range"])
    return joined.select("run", "score", "p", "n", "tot_p", "tot_n", (F.col("_tp") + F.col("_above_p")).alias("tp"), (F.col("_fp") + F.col("_above_n")).alias("fp"))


def roc_points(df: DataFrame) -> DataFrame:
    """(run, score, fpr, tpr), with the origin at a null score."""
    points = cumulated(score_counts(df))
    curve = points.select("run", "score", ratio(F.col("fp"), F.col("tot_n")).alias("fpr"), ratio(F.col("tp"), F.col("tot_p")).alias("tpr"))
    origin = df.select("run").distinct().select("run", F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return curve.unionByName(origin)


def pr_points(df: DataFrame) -> DataFrame:
    """(run, score, recall, precision), with recall 0 and precision 1 at a null score."""
    points = cumulated(score_counts(df))
    curve = points.select("run", "score", ratio(F.col("tp"), F.col("tot_p")).alias("recall"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))
    start = df.select("run").distinct().select("run", F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    return curve.unionByName(start)


def areas(df: DataFrame) -> DataFrame:
    """A row for each run: auroc, pr_auc, balanced_accuracy, n, positives, distinct_scores, prevalence."""
    points = cumulated(score_counts(df))
    p, n = F.sum("p"), F.sum("n")
    # a positive beats all negatives below it and half of those at its own score
    wins = F.sum(F.col("p") * ((F.col("tot_n") - F.col("fp")) + F.col("n") / 2.0))
    both = (p > 0) & (n > 0) & (F.count(F.lit(1)) > 1)
    hit_p, hit_n = F.sum(F.when(F.col("score") >= 0.5, F.col("p")).otherwise(0)), F.sum(F.when(F.col("score") < 0.5, F.col("n")).otherwise(0))
    recalls = [F.try_divide(hit_p.cast("double"), p.cast("double")), F.try_divide(hit_n.cast("double"), n.cast("double"))]
    present = sum(F.when(r.isNotNull(), 1).otherwise(0) for r in recalls)
    balanced = sum(F.coalesce(r, F.lit(0.0)) for r in recalls) / present
    return points.groupBy("run").agg(
        F.when(both, F.round(wins / (p * n).cast("double"), 6)).otherwise(0.5).alias("auroc"),
        F.round(ratio(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))), p), 6).alias("pr_auc"),
        F.round(balanced, 6).alias("balanced_accuracy"),
        (p + n).alias("n"),
        p.alias("positives"),
        F.count(F.lit(1)).alias("distinct_scores"),
        F.round(ratio(p, p + n), 6).alias("prevalence"),
    )


#: Bins of a sketch; even, so that a threshold of one half is a bin's edge.
SKETCH_BINS = 1000


def score_sketch(df: DataFrame, bins: int = SKETCH_BINS, run: str = "run", score: str = "score", truth: str = "truth") -> DataFrame:
    """(run, bin, p, n): positives and negatives in each of ``bins`` bins of scores in [0, 1]; rows without score or truth go.

    Sketches merge by adding: those of a run's parts, appended to a table, are
    that of the run, and a run has ``bins`` rows for each part at most.
    """
    known = df.filter(F.col(score).isNotNull() & F.col(truth).isNotNull())
    binned = known.withColumn("bin", F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int"))
    return score_counts(binned, run, "bin", truth).withColumnRenamed("score", "bin")


def merged(sketches: DataFrame) -> DataFrame:
    return sketches.groupBy("run", "bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def sketch_areas(sketches: DataFrame, bins: int = SKETCH_BINS) -> DataFrame:
    """A row for each run of stored sketches: auroc, auroc_error, balanced_accuracy, n, positives; outputs are not read.

    The order of a positive and a negative in one bin is not known; such pairs
    count half, so the true area is at most ``auroc_error``, half their share of
    all pairs, away. The balanced accuracy at one half is exact.
    """
    points = cumulated(merged(sketches).withColumn("score", F.col("bin") / F.lit(bins)).drop("bin"))
    p, n = F.sum("p"), F.sum("n")
    pairs = (p * n).cast("double")
    both = (p > 0) & (n > 0)
    wins = F.sum(F.col("p") * ((F.col("tot_n") - F.col("fp")) + F.col("n") / 2.0))
    hits = F.sum(F.when(F.col("score") >= 0.5, F.col("p")).otherwise(0)) / p.cast("double") + F.sum(F.when(F.col("score") < 0.5, F.col("n")).otherwise(0)) / n.cast("double")
    return points.groupBy("run").agg(
        F.when(both, wins / pairs).otherwise(0.5).alias("auroc"),
        F.when(both, F.sum(F.col("p") * F.col("n")) / 2.0 / pairs).otherwise(0.0).alias("auroc_error"),
        F.when(both, hits / 2).alias("balanced_accuracy"),
        (p + n).alias("n"),
        p.alias("positives"),
    )


def latex_rows(table: DataFrame) -> DataFrame:
    """A table row for each run, as LaTeX."""
    return table.select("run", F.format_string("%s & %.4f & %.4f & %.4f \\\\", F.col("run").cast("string"), "balanced_accuracy", "auroc", "pr_auc").alias("row"))
