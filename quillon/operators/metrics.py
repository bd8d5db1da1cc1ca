"""Confusion matrices and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def cells(truth: str, pred: str) -> list[Column]:
    cell = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(pred) == p))
    return [cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn")]


def derived(df: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall, f1, recalls by class and support to tp, fp, fn, tn."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    values = {"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": p, "recall": r, "f1": ratio(2 * p * r, p + r), "recall_pos": r, "recall_neg": ratio(tn, tn + fp)}
    return df.select("*", *[F.round(v, 4).alias(k) for k, v in values.items()], (tp + fp + fn + tn).alias("support"))


def confusion(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """One row over all rows; a null truth or prediction is in no cell."""
    return derived(df.agg(*cells(truth, pred)))


def confusion_by(df: DataFrame, cls: str, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """A row for each class and one over all, named ``__all__``, in one pass (grouping sets)."""
    both = df.groupingSets([[F.col(cls)], []], F.col(cls)).agg(F.grouping(cls).alias("_all"), *cells(truth, pred))
    named = both.withColumn(cls, F.when(F.col("_all") == 1, "__all__").otherwise(F.col(cls))).drop("_all")
    return derived(named)


def judge_counts(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Totals of scored rows: all, without ground truth, uncertain and its rate."""
    known, unsure = F.col(truth).isNotNull(), F.col(truth).isNotNull() & F.col(pred).isNull()
    counts = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(~known).alias("missing"), F.count_if(unsure).alias("uncertain"), F.count_if(known).alias("_known"))
    return counts.select("total", "missing", "uncertain", F.round(ratio(F.col("uncertain"), F.col("_known")), 4).alias("uncertain_rate"))


def coverage(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """How many rows with a known truth have a prediction."""
    counts = df.agg(F.count(truth).alias("gt_known"), F.count_if(F.col(truth).isNotNull() & F.col(pred).isNotNull()).alias("covered"))
    return counts.withColumn("coverage_rate", F.round(ratio(F.col("covered"), F.col("gt_known")), 4))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(F.coalesce(label, F.lit("")).alias(label)).agg(F.count(F.lit(1)).alias("n"))


def metric_rows(df: DataFrame, category: str, name: str) -> DataFrame:
    """A metrics table as rows of a report: a category, a name, and the values."""
    return df.select(F.lit(category).alias("category"), F.col(name).alias("name") if name in df.columns else F.lit(name).alias("name"), *[c for c in df.columns if c != name])


def union_rows(*tables: DataFrame) -> DataFrame:
    """Tables of different columns one after the other, all columns sorted by name, null where absent."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.select(*sorted(out.columns))
