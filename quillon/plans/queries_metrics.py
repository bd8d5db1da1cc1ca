"""Metrics, calibration, curves and sampling over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import labels
from quillon.operators import calibration, curves, metrics, sampling, usage
from quillon.plans.registry import query, table
from quillon.sources import sinks


def judged(spark, sf_dir: str) -> DataFrame:
    """Events as judged claims: class, truth, confidence, label and prediction."""
    value = F.col("value")
    label = F.when(value > 60, labels.MISINFORMATION).when(value > 10, labels.NOT_MISINFORMATION).otherwise(labels.UNCERTAIN)
    rows = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", F.col("event_type").alias("cls"), F.col("event_type").isin("error", "click").cast("int").alias("truth"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"), label.alias("label")
    )
    return rows.withColumn("pred", labels.metric_prediction(F.col("label")))


JUDGED = """
WITH judged AS (
  SELECT event_id, ts, user_id, event_type AS cls, CASE WHEN event_type IN ('error', 'click') THEN 1 ELSE 0 END AS truth,
         CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) / 100 AS confidence,
         CASE WHEN value > 60 THEN 'Misinformation' WHEN value > 10 THEN 'Not Misinformation' ELSE 'Uncertain' END AS label,
         CASE WHEN value > 60 THEN 1 WHEN value > 10 THEN 0 END AS pred
  FROM events)"""

def cells_sql(t: str, p: str) -> str:
    cell = lambda a, b, name: f"CAST(count_if({t} = {a} AND {p} = {b}) AS BIGINT) AS {name}"
    return ", ".join([cell(1, 1, "tp"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(0, 0, "tn")])


def derived_sql(source: str, keys: str = "") -> str:
    """Metrics of the cells that ``source`` selects."""
    q = lambda a, b: f"coalesce(({a}) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"
    p, r = q("tp", "(tp + fp)"), q("tp", "(tp + fn)")
    return f"""
SELECT {keys} tp, fp, fn, tn, round({q("tp + tn", "(tp + fp + fn + tn)")}, 4) AS accuracy, round({p}, 4) AS precision, round({r}, 4) AS recall,
       round({q(f"2 * {p} * {r}", f"({p} + {r})")}, 4) AS f1, round({r}, 4) AS recall_pos, round({q("tn", "(tn + fp)")}, 4) AS recall_neg,
       tp + fp + fn + tn AS support
FROM ({source})"""


@query(JUDGED + derived_sql(f"SELECT {cells_sql('truth', 'coalesce(pred, 1 - truth)')} FROM judged"))
def judge_confusion_overall(spark, sf_dir):
    rows = judged(spark, sf_dir).withColumn("pred", labels.penalised(F.col("pred"), F.col("truth")))
    return metrics.confusion(rows)


@query(JUDGED + derived_sql(f"SELECT CASE WHEN grouping(cls) = 1 THEN '__all__' ELSE cls END AS cls, {cells_sql('truth', 'coalesce(pred, 1 - truth)')} FROM judged GROUP BY GROUPING SETS ((cls), ())", "cls,"))
def judge_confusion_by_class(spark, sf_dir):
    rows = judged(spark, sf_dir).withColumn("pred", labels.penalised(F.col("pred"), F.col("truth"))).withColumn("cls", labels.class_key(F.col("cls")))
    return metrics.confusion_by(rows, "cls")


@query(JUDGED + derived_sql(f"SELECT {cells_sql('truth', 'pred')} FROM judged"))
def judge_confusion_filtered(spark, sf_dir):
    """Only rows with a prediction: the view without penalty."""
    return metrics.confusion(judged(spark, sf_dir))


@query(JUDGED + """
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count_if(truth IS NULL) AS BIGINT) AS missing, CAST(count_if(pred IS NULL) AS BIGINT) AS uncertain,
       round(count_if(pred IS NULL) / CAST(count(*) AS DOUBLE), 4) AS uncertain_rate FROM judged""")
def judge_counts(spark, sf_dir):
    return metrics.judge_counts(judged(spark, sf_dir))


@query(JUDGED + " SELECT label, CAST(count(*) AS BIGINT) AS n FROM judged GROUP BY label")
def label_distribution(spark, sf_dir):
    return metrics.label_distribution(judged(spark, sf_dir))


_AI = """
WITH d AS (
  SELECT doc_id, CASE WHEN quality IS NOT NULL THEN quality END AS truth, CASE WHEN n_chars % 3 = 0 THEN NULL WHEN n_chars % 2 = 0 THEN 1 ELSE 0 END AS pred
  FROM documents LEFT JOIN labels USING (doc_id))"""


def _detections(spark, sf_dir):
    """Documents with a label as truth and a partly missing prediction."""
    pred = F.when(F.col("n_chars") % 3 == 0, None).when(F.col("n_chars") % 2 == 0, 1).otherwise(0)
    docs = table(spark, sf_dir, "documents").select("doc_id", pred.alias("pred"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("truth")), "doc_id", "left")


@query(_AI + derived_sql(f"SELECT {cells_sql('truth', 'pred')} FROM d"))
def ai_detection_filtered(spark, sf_dir):
    return metrics.confusion(_detections(spark, sf_dir))


@query(_AI + derived_sql(f"SELECT {cells_sql('truth', 'coalesce(pred, 1 - truth)')} FROM d"))
def ai_detection_all(spark, sf_dir):
    rows = _detections(spark, sf_dir)
    return metrics.confusion(rows.withColumn("pred", labels.penalised(F.col("pred"), F.col("truth"))))


@query(_AI + """
SELECT CAST(count(truth) AS BIGINT) AS gt_known, CAST(count_if(truth IS NOT NULL AND pred IS NOT NULL) AS BIGINT) AS covered,
       round(count_if(truth IS NOT NULL AND pred IS NOT NULL) / CAST(count(truth) AS DOUBLE), 4) AS coverage_rate FROM d""")
def ai_detection_coverage(spark, sf_dir):
    return metrics.coverage(_detections(spark, sf_dir), "truth", "pred")


_RECS = JUDGED + """,
r AS (SELECT greatest(0.0, least(1.0, confidence)) AS conf, CASE WHEN pred = truth THEN 1 ELSE 0 END AS correct FROM judged WHERE pred IS NOT NULL),
b AS (SELECT CAST(least(floor(conf * 10), 9) AS INTEGER) AS bin, conf, correct FROM r)"""


@query(_RECS + """
SELECT CAST(i AS INTEGER) AS bin, round(i / CAST(10 AS DOUBLE), 3) AS bin_lower, round((i + 1) / CAST(10 AS DOUBLE), 3) AS bin_upper, CAST(count(conf) AS BIGINT) AS count,
       round(avg(conf), 4) AS avg_confidence, round(avg(correct), 4) AS accuracy
FROM range(10) t(i) LEFT JOIN b ON b.bin = i GROUP BY i""")
def calibration_bins(spark, sf_dir):
    return calibration.calibration_bins(calibration.records(judged(spark, sf_dir)))


@query(_RECS + """
SELECT CAST(sum(n) AS BIGINT) AS total, round(sum(sq) / sum(n), 6) AS brier_score, round(sum(abs(k - c)) / sum(n), 6) AS expected_calibration_error, 10 AS bin_count
FROM (SELECT bin, count(*) AS n, sum(conf) AS c, sum(correct) AS k, sum((conf - correct) * (conf - correct)) AS sq FROM b GROUP BY bin)""")
def calibration_summary(spark, sf_dir):
    return calibration.calibration_summary(calibration.records(judged(spark, sf_dir)))


@query("""
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS token_count, round(list_avg(list_transform(embedding, lambda x: -abs(CAST(x AS DOUBLE)))), 6) AS avg_logprob,
       round(exp(list_avg(list_transform(embedding, lambda x: -abs(CAST(x AS DOUBLE))))), 6) AS geo_mean_prob FROM embeddings""")
def logprob_reduce(spark, sf_dir):
    logprobs = F.transform("embedding", lambda x: -F.abs(x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", calibration.logprob_summary(logprobs).alias("s"))
    return rows.select("vec_id", "s.token_count", F.round("s.avg_logprob", 6).alias("avg_logprob"), F.round("s.geo_mean_prob", 6).alias("geo_mean_prob"))


def scored(spark, sf_dir, run=None) -> DataFrame:
    rows = judged(spark, sf_dir)
    return rows.select((F.lit("all") if run is None else run).alias("run"), F.round(labels.misinformation_score(F.col("label"), F.col("confidence")), 2).alias("score"), "truth")


def _points_sql(run: str) -> str:
    return JUDGED + f""",
s AS (SELECT {run} AS run, round(CASE label WHEN 'Not Misinformation' THEN 1.0 - confidence WHEN 'Misinformation' THEN confidence ELSE 0.5 END, 2) AS score, truth FROM judged),
g AS (SELECT run, score, CAST(sum(truth) AS BIGINT) AS p, CAST(sum(1 - truth) AS BIGINT) AS n FROM s GROUP BY run, score),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY run) AS tot_p, sum(n) OVER (PARTITION BY run) AS tot_n
      FROM g WINDOW w AS (PARTITION BY run ORDER BY score DESC))"""


_AREAS = """
SELECT run, round(sum(p * (tot_n - fp + n / 2.0)) / CAST(sum(p) * sum(n) AS DOUBLE), 6) AS auroc, round(sum(p * tp / CAST(tp + fp AS DOUBLE)) / sum(p), 6) AS pr_auc,
       round((sum(CASE WHEN score >= 0.5 THEN p ELSE 0 END) / CAST(sum(p) AS DOUBLE) + sum(CASE WHEN score < 0.5 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE)) / 2, 6) AS balanced_accuracy,
       CAST(sum(p) + sum(n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS positives, CAST(count(*) AS BIGINT) AS distinct_scores, round(sum(p) / CAST(sum(p) + sum(n) AS DOUBLE), 6) AS prevalence
FROM c GROUP BY run"""


@query(_points_sql("'all'") + """
SELECT run, score, round(fp / CAST(tot_n AS DOUBLE), 6) AS fpr, round(tp / CAST(tot_p AS DOUBLE), 6) AS tpr FROM c UNION ALL SELECT 'all', NULL, 0.0, 0.0""")
def roc_points(spark, sf_dir):
    return curves.roc_points(scored(spark, sf_dir)).select("run", "score", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(_points_sql("'all'") + """
SELECT run, score, round(tp / CAST(tot_p AS DOUBLE), 6) AS recall, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision FROM c UNION ALL SELECT 'all', NULL, 0.0, 1.0""")
def pr_points(spark, sf_dir):
    return curves.pr_points(scored(spark, sf_dir)).select("run", "score", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query(_points_sql("'all'") + _AREAS)
def auroc_ap(spark, sf_dir):
    return curves.areas(scored(spark, sf_dir))


@query(_points_sql("'run' || CAST(user_id % 3 AS VARCHAR)") + _AREAS)
def curves_by_run(spark, sf_dir):
    return curves.areas(scored(spark, sf_dir, F.concat(F.lit("run"), (F.col("user_id") % 3).cast("string"))))


@query(_points_sql("'run' || CAST(user_id % 3 AS VARCHAR)") + """
, bins AS (SELECT run, least(CAST(floor(score * 1000) AS INTEGER), 999) AS bin, sum(p) AS p, sum(n) AS n FROM c GROUP BY ALL),
sums AS (SELECT *, sum(n) OVER (PARTITION BY run ORDER BY bin) - n AS below FROM bins)
SELECT run, round(sum(p * (below + n / 2.0)) / CAST(sum(p) * sum(n) AS DOUBLE), 6) AS auroc, round(sum(p * n) / 2.0 / CAST(sum(p) * sum(n) AS DOUBLE), 6) AS auroc_error,
       round((sum(CASE WHEN bin >= 500 THEN p ELSE 0 END) / CAST(sum(p) AS DOUBLE) + sum(CASE WHEN bin < 500 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE)) / 2, 6) AS balanced_accuracy,
       CAST(sum(p) + sum(n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS positives FROM sums GROUP BY run""")
def sketch_curves(spark, sf_dir):
    """Areas of runs from sketches that each part of the outputs has appended to one table."""
    rows = scored(spark, sf_dir, F.concat(F.lit("run"), (F.col("user_id") % 3).cast("string")))
    path = f"{sinks.shared_folder(spark)}/sketches-{uuid.uuid4().hex}"
    for part in (0, 1):
        curves.score_sketch(rows.filter(F.pmod(F.xxhash64("score"), F.lit(2)) == part)).write.mode("append").parquet(path)
    found = curves.sketch_areas(spark.read.parquet(path))
    return found.select("run", "n", "positives", *[F.round(c, 6).alias(c) for c in ("auroc", "auroc_error", "balanced_accuracy")])


@query(_points_sql("'run' || CAST(user_id % 3 AS VARCHAR)") + f"""
SELECT run, printf('%s & %.4f & %.4f & %.4f %s', run, balanced_accuracy, auroc, pr_auc, chr(92) || chr(92)) AS row FROM ({_AREAS})""")
def latex_rows(spark, sf_dir):
    return curves.latex_rows(curves_by_run(spark, sf_dir))


_U = "(CAST(('0x' || substr(md5('{seed}:' || CAST({id} AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0)"


def u_sql(seed: str, ident: str) -> str:
    return f"CAST({_U.format(seed=seed, id=ident)} AS DOUBLE)"


_ORDERED = f"""
WITH d AS (SELECT doc_id, lang, {u_sql("7", "doc_id")} AS u FROM documents),
o AS (SELECT doc_id, lang, round((row_number() OVER (PARTITION BY lang ORDER BY u, doc_id) - 1 + u) * (SELECT count(*) FROM d) / count(*) OVER (PARTITION BY lang), 6) AS order_score FROM d)"""


@query(_ORDERED + " SELECT * FROM o")
def stratified_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.stratified_order(docs, ["lang"], 7, "doc_id").withColumn("order_score", F.round("order_score", 6))


@query(_ORDERED + " SELECT lang, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM o ORDER BY order_score, doc_id LIMIT 100) GROUP BY lang")
def stratified_prefix(spark, sf_dir):
    """The class mix of the first 100 documents (the prefix is the feature)."""
    return stratified_order(spark, sf_dir).orderBy("order_score", "doc_id").limit(100).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH d AS (SELECT doc_id, lang, {u_sql("7", "doc_id")} AS shuffle_key FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY shuffle_key, doc_id) AS r FROM d)
SELECT doc_id, lang, round(shuffle_key, 6) AS shuffle_key FROM n WHERE r <= (SELECT min(c) FROM (SELECT count(*) AS c FROM d GROUP BY lang))""")
def balanced_undersample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.undersample(docs, "lang", 7, "doc_id").withColumn("shuffle_key", F.round("shuffle_key", 6))


_CLASSES = ["00", "01", "10", "11"]


@query(f"""
WITH l AS (SELECT doc_id, CAST(quality AS VARCHAR) || CAST(toxic AS VARCHAR) AS cls, {u_sql("7", "doc_id")} AS u FROM labels),
n AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY u, doc_id) AS r FROM l)
SELECT doc_id, cls FROM n WHERE r <= least(20 // 4, (SELECT min(c) FROM (SELECT count(*) AS c FROM l GROUP BY cls)))""")
def balanced_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("cls"))
    return sampling.balanced_budget(rows, "cls", _CLASSES, 7, "doc_id", 20).drop("shuffle_key")


@query("SELECT lang, CAST(n AS BIGINT) AS n, CAST(min(n) OVER () AS BIGINT) AS min_count FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def bucket_counts(spark, sf_dir):
    return sampling.bucket_counts(table(spark, sf_dir, "documents"), "lang")


@query(f"SELECT o_orderkey, round({u_sql('3', 'o_orderkey')}, 6) AS shuffle_key FROM orders ORDER BY {u_sql('3', 'o_orderkey')}, o_orderkey LIMIT 100")
def seeded_shuffle_limit(spark, sf_dir):
    rows = sampling.shuffled(table(spark, sf_dir, "orders").select("o_orderkey"), 3, "o_orderkey")
    return rows.orderBy("shuffle_key", "o_orderkey").limit(100).withColumn("shuffle_key", F.round("shuffle_key", 6))


@query(JUDGED + """
SELECT category, CAST(n AS BIGINT) AS n, name, round(rate, 4) AS rate FROM (
  SELECT 'label' AS category, label AS name, count(*) AS n, NULL AS rate FROM judged GROUP BY label
  UNION ALL SELECT 'class', cls, NULL, avg(truth) FROM judged GROUP BY cls)""")
def metrics_csv_union(spark, sf_dir):
    rows = judged(spark, sf_dir)
    by_label = metrics.metric_rows(metrics.label_distribution(rows), "label", "label")
    by_class = metrics.metric_rows(rows.groupBy("cls").agg(F.round(F.avg("truth"), 4).alias("rate")), "class", "cls")
    return metrics.union_rows(by_label, by_class)


@query(JUDGED + """
SELECT CASE WHEN pred IS NULL THEN 'Uncertain' WHEN pred <> truth THEN 'Incorrect vs GT' ELSE 'Correct: ' || label END AS badge, CAST(count(*) AS BIGINT) AS n
FROM judged GROUP BY 1""")
def correctness_badge(spark, sf_dir):
    rows = judged(spark, sf_dir).withColumn("badge", labels.badge(labels.report_prediction(F.col("label")), F.col("truth")))
    return rows.groupBy("badge").agg(F.count(F.lit(1)).alias("n"))


@query(JUDGED + """
SELECT event_id AS sample_index, CASE WHEN pred IS NULL THEN 'uncertain' ELSE 'incorrect' END AS kind FROM judged WHERE pred IS NULL OR pred <> truth""")
def incorrect_index(spark, sf_dir):
    """Samples a report lists: uncertain ones first of all, else wrong ones."""
    rows = judged(spark, sf_dir).filter(F.col("pred").isNull() | (F.col("pred") != F.col("truth")))
    return rows.select(F.col("event_id").alias("sample_index"), F.when(F.col("pred").isNull(), "uncertain").otherwise("incorrect").alias("kind"))


_USAGE = "WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS prompt, CAST(l_linenumber AS BIGINT) AS completion, CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) + 1 END AS total FROM lineitem)"


def _usage(spark, sf_dir):
    prompt, completion = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", prompt.alias("prompt"), completion.alias("completion"), F.when(completion % 2 == 0, 0).otherwise(prompt + 1).alias("total"))


@query(_USAGE + " SELECT CAST(sum(prompt) AS BIGINT) AS prompt, CAST(sum(completion) AS BIGINT) AS completion, CAST(sum(CASE WHEN total = 0 THEN prompt + completion ELSE total END) AS BIGINT) AS total FROM t")
def token_totals(spark, sf_dir):
    return usage.token_totals(_usage(spark, sf_dir))


@query(_USAGE + """
SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS level, CAST(sum(prompt) AS BIGINT) AS prompt, CAST(sum(completion) AS BIGINT) AS completion, CAST(sum(total) AS BIGINT) AS total
FROM t GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def usage_rollup(spark, sf_dir):
    return usage.usage_rollup(_usage(spark, sf_dir), "l_returnflag", "l_linestatus")


@query(_USAGE + """
SELECT l_orderkey, l_linenumber, prompt, CAST(greatest(0, prompt - coalesce(lag(prompt) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, prompt), 0)) AS BIGINT) AS delta FROM t""")
def usage_delta(spark, sf_dir):
    rows = usage.usage_delta(_usage(spark, sf_dir), "l_orderkey", ["l_linenumber", "prompt"], "prompt")
    return rows.select("l_orderkey", "l_linenumber", "prompt", "delta")


@query("SELECT event_type, round(sum(value) / CAST(count(*) AS DOUBLE), 4) AS seconds_per_sample FROM events GROUP BY event_type")
def seconds_per_sample(spark, sf_dir):
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.select("event_type", F.round(usage.seconds_per_sample(F.col("s"), F.col("n")), 4).alias("seconds_per_sample"))


@query("""
SELECT event_id, user_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent FROM events""")
def rate_window_audit(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return usage.rate_audit(rows, "user_id", "ts", "event_id", 6 * 3600).drop("ts")


@query("""
SELECT event_id, user_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)) / 1000000.0, 6) AS gap_s FROM events""")
def spacing_audit(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return usage.spacing_audit(rows, "user_id", "ts", "event_id").select("event_id", "user_id", F.round("gap_s", 6).alias("gap_s"))
