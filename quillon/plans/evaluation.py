"""The evaluation of a run's outputs against its dataset, as one set of metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import labels, text
from quillon.operators import calibration, lookup, metrics
from quillon.sources import records, sinks


def score_outputs(outputs: DataFrame, truth: DataFrame, root: str) -> DataFrame:
    """Outputs with the ground truth of their image: match, truth, pred, cls, ai_truth, ai_pred and confidences.

    ``truth`` is the typed dataset; outputs without a match have a null truth.
    """
    numbered = outputs.withColumn("_row", F.monotonically_increasing_id()) if "sample_index" not in outputs.columns else outputs.withColumn("_row", F.col("sample_index"))
    value = F.struct("gt_answers", "fake_cls", "image_source")
    joined = lookup.candidate_join(numbered, truth, "_row", text.path_candidates(F.coalesce("image_path", F.lit("")), root), text.path_candidates(F.col("image_path"), root), "dataset_index", value)
    known = F.col("match").isNotNull()
    pred = labels.metric_prediction(F.coalesce(F.col("judgement.label"), F.lit("")))
    return joined.select(
        "_row",
        F.when(known, labels.exact_truth(F.col("match.gt_answers"))).alias("truth"),
        F.when(known, pred).alias("pred"),
        F.when(known, F.coalesce(F.col("judgement.label"), F.lit(""))).alias("label"),
        F.when(known, labels.class_key(F.col("match.fake_cls"))).alias("cls"),
        F.when(known, labels.generated_truth(F.col("match.image_source"))).alias("ai_truth"),
        F.when(known, F.col("visual_veracity.ai_generated").cast("int")).alias("ai_pred"),
        F.col("judgement.confidence").alias("confidence"),
        F.col("judgement.logprob_confidence").alias("logprob_confidence"),
    )


def metric_tables(scored: DataFrame) -> dict[str, DataFrame]:
    """All tables of the report. ``scored`` is read several times: cache it, or write it, if it is costly."""
    known = scored.filter(F.col("truth").isNotNull())
    strict = known.withColumn("pred", labels.penalised(F.col("pred"), F.col("truth")))
    ai = known.select(F.col("ai_truth").alias("truth"), F.col("ai_pred").alias("pred"))
    conf, logprob = calibration.records(known), calibration.records(known, "logprob_confidence")
    return {
        "counts": metrics.judge_counts(scored),
        "label_distribution": metrics.label_distribution(known),
        "judge_by_class": metrics.confusion_by(strict, "cls"),
        "judge_filtered": metrics.confusion(known),
        "ai_detection": metrics.confusion(ai),
        "ai_detection_all": metrics.confusion(ai.withColumn("pred", labels.penalised(F.col("pred"), F.col("truth")))),
        "ai_coverage": metrics.coverage(known, "ai_truth", "ai_pred"),
        "calibration": calibration.calibration_summary(conf),
        "calibration_bins": calibration.calibration_bins(conf),
        "logprob_calibration": calibration.calibration_summary(logprob),
        "logprob_calibration_bins": calibration.calibration_bins(logprob),
    }


def figures(tables: dict[str, DataFrame]) -> dict[str, str]:
    """SVG pictures of the tables: confusion matrices, and the bins of the calibrations."""
    out = {}
    for name in ("judge_filtered", "ai_detection", "ai_detection_all"):
        row = tables[name].first()
        out[name] = sinks.matrix_svg(row.tp, row.fp, row.fn, row.tn)
    for name in ("calibration_bins", "logprob_calibration_bins"):
        points = [(r.avg_confidence, r.accuracy) for r in tables[name].orderBy("bin").collect() if r.accuracy is not None and r.avg_confidence is not None]  # a row for each bin
        out[name] = sinks.curve_svg(points, name.replace("_", " "), diagonal=True)
    return out


def evaluate(spark: SparkSession, outputs_path: str, dataset_json: str, root: str, report: str | None = None, csv: str | None = None, html: str | None = None, figure_dir: str | None = None) -> dict[str, DataFrame]:
    """Scores a JSONL run, writes the reports that are asked for, and returns the tables."""
    truth = sinks.written(records.project_records(records.scan_dataset(spark, dataset_json)), "dataset")
    scored = sinks.written(score_outputs(records.scan_jsonl(spark, outputs_path), truth, root), "scored")
    tables = metric_tables(scored)
    if report:
        sinks.write_json_report(tables, report)
    if html:
        sinks.write_html_report(tables, html, "Evaluation")
    if csv:
        sinks.write_csv(metrics.union_rows(*[metrics.metric_rows(t, name, name) for name, t in tables.items()]), csv)
    if figure_dir:
        for name, svg in figures(tables).items():
            sinks.write_text(spark, f"{figure_dir}/{name}.svg", svg)
    return tables
