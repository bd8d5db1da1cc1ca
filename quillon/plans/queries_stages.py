"""Pipeline stages over the driver tables: judges, cascades, and the stream that resumes."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillon.functions import labels, text
from quillon.operators.sampling import uniform
from quillon.plans import claims
from quillon.plans.queries_metrics import u_sql
from quillon.plans.registry import query, table
from quillon.sources.clients import EchoModel
from quillon.sources.config import RunConfig
from quillon.sources.sinks import shared_folder
from quillon.streaming import resume, stateful

_SIGNALS = f"""
WITH s AS (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'partial' END AS al, {u_sql("r", "doc_id")} AS rc,
         CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ai, {u_sql("v", "doc_id")} AS vc FROM documents),
x AS (SELECT *, round(0.7 * CASE al WHEN 'true' THEN -rc WHEN 'false' THEN rc WHEN 'partial' THEN -0.4 * rc ELSE 0 END + 0.3 * CASE WHEN ai THEN 0.5 * vc WHEN NOT ai THEN -0.25 * vc ELSE 0 END, 9) AS sc FROM s)"""


def _signals(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(d % 4 == 0, "true").when(d % 4 == 1, "false").when(d % 4 == 2, "partial").alias("al"),
        uniform("r", d).alias("rc"),
        F.when(d % 3 == 0, True).when(d % 3 == 1, False).alias("ai"),
        uniform("v", d).alias("vc"),
    )


@query(_SIGNALS + """
SELECT doc_id, CASE WHEN sc >= 0.3 THEN 'Misinformation' WHEN sc <= -0.3 THEN 'Not Misinformation' ELSE 'Uncertain' END AS label, round(0.3 + least(0.6, abs(sc)), 2) AS confidence,
  concat_ws('; ', CASE al WHEN 'true' THEN 'Relevancy aligned' WHEN 'false' THEN 'Relevancy misaligned' WHEN 'partial' THEN 'Relevancy partial alignment' END, CASE WHEN ai THEN 'Image likely AI/manipulated' WHEN NOT ai THEN 'Image likely authentic' END) AS factors
FROM x""")
def heuristic_judge(spark, sf_dir):
    rows = _signals(spark, sf_dir).withColumn("j", labels.heuristic_judgement(F.col("al"), F.col("rc"), F.col("ai"), F.col("vc")))
    factors = F.array_join(F.transform("j.key_factors", lambda f: F.regexp_replace(f, r" \(conf.*", "")), "; ")
    return rows.select("doc_id", F.col("j.label").alias("label"), F.col("j.confidence").alias("confidence"), factors.alias("factors"))


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Misinformation' WHEN 1 THEN 'Not Misinformation' ELSE 'Uncertain' END AS label,
       CAST(CASE doc_id % 4 WHEN 0 THEN least(1, n % 150 / 100.0) WHEN 1 THEN n % 100 / 100.0 ELSE 0.5 END AS DOUBLE) AS confidence, CASE WHEN doc_id % 4 < 3 THEN h ELSE 'I cannot tell ' || h END AS rationale,
       CASE doc_id % 4 WHEN 0 THEN 'a,' || h WHEN 1 THEN h ELSE '' END AS factors FROM (SELECT doc_id, length(coalesce(text, '')) AS n, md5(coalesce(text, '')) AS h FROM documents)""")
def judge_normalize(spark, sf_dir):
    """Judgements in several spellings, with confidences and rationales that follow from the whole text."""
    d, whole = F.col("doc_id"), F.coalesce("text", F.lit(""))
    n, h = F.char_length(whole), F.md5(whole)
    raw = (
        F.when(d % 4 == 0, F.concat(F.lit('So: {"label": "misinformation", "confidence": '), (n % 150 / 100).cast("string"), F.lit(', "rationale": "'), h, F.lit('", "key_factors": ["a", "'), h, F.lit('"]}')))
        .when(d % 4 == 1, F.concat(F.lit('{"label": "NOT misinformation", "confidence": "'), (n % 100 / 100).cast("string"), F.lit('", "rationale": "'), h, F.lit('", "key_factors": "'), h, F.lit('"}')))
        .when(d % 4 == 2, F.concat(F.lit('{"label": "?", "confidence": "high", "rationale": "'), h, F.lit('"}')))
        .otherwise(F.concat(F.lit("I cannot tell "), h))
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", claims.judgement(raw).alias("j"))
    return rows.select("doc_id", F.col("j.label").alias("label"), F.col("j.confidence").alias("confidence"), F.col("j.rationale").alias("rationale"), F.array_join("j.key_factors", ",").alias("factors"))


_RAW = {"text": ["Finish[TEXT REFUTES].", "so Finish[TEXT SUPPORTS]", "?"], "image": ["Observation: odd hands Action: x Finish[IMAGE REFUTES]", "Finish[IMAGE SUPPORTS]", "?", "Observation: none"], "cross": ["Finish[MATCH]", "Finish[MISMATCH]", "?", "Finish[MISMATCH]", "Finish[MATCH]"]}


def _stages(spark, sf_dir):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))
    seen = F.md5(F.coalesce("text", F.lit("")))  # what the image stage observes follows from the whole text
    rows = table(spark, sf_dir, "documents").select("doc_id", *[F.replace(pick(v), F.lit("odd hands"), seen).alias(f"raw_{k}") for k, v in _RAW.items()])
    return rows.select("*", *[labels.stage_verdict(F.col(f"raw_{k}"), k).alias(k) for k in _RAW])


_VERDICTS = """
WITH v AS (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'REFUTES' WHEN 1 THEN 'SUPPORTS' ELSE 'INSUFFICIENT' END AS t, CASE doc_id % 3 WHEN 2 THEN 0.5 ELSE 0.8 END AS tc,
         CASE doc_id % 4 WHEN 0 THEN 'REFUTES' ELSE 'SUPPORTS' END AS i, CASE doc_id % 4 WHEN 0 THEN 0.8 ELSE 0.7 END AS ic,
         CASE doc_id % 5 WHEN 0 THEN 'CONSISTENT' WHEN 4 THEN 'CONSISTENT' WHEN 2 THEN 'PARTIAL' ELSE 'MISMATCH' END AS c, CASE doc_id % 5 WHEN 2 THEN 0.5 ELSE 0.8 END AS cc,
         CASE doc_id % 4 WHEN 0 THEN md5(coalesce(text, '')) WHEN 3 THEN 'none' END AS observation FROM documents)"""


@query(_VERDICTS + " SELECT doc_id, t AS text_verdict, i AS image_verdict, c AS cross_verdict, observation FROM v")
def stage_verdict_parse(spark, sf_dir):
    rows = _stages(spark, sf_dir)
    return rows.select("doc_id", F.col("text.verdict").alias("text_verdict"), F.col("image.verdict").alias("image_verdict"), F.col("cross.verdict").alias("cross_verdict"), text.observation(F.col("raw_image")).alias("observation"))


@query(_VERDICTS + """
SELECT doc_id, CASE WHEN t = 'REFUTES' OR i = 'REFUTES' OR c = 'MISMATCH' THEN 'Misinformation' ELSE 'Not Misinformation' END AS label,
  CASE WHEN t = 'REFUTES' THEN 'textual_veracity_distortion' WHEN i = 'REFUTES' THEN 'visual_veracity_distortion' WHEN c = 'MISMATCH' THEN 'mismatch' ELSE 'original' END AS fake_cls,
  round(CAST(CASE WHEN t = 'REFUTES' THEN tc WHEN i = 'REFUTES' THEN ic WHEN c = 'MISMATCH' THEN cc ELSE (tc + ic + cc) / 3.0 END AS DOUBLE), 6) AS confidence FROM v""")
def three_stage_cascade(spark, sf_dir):
    rows = _stages(spark, sf_dir).select("doc_id", labels.cascade(F.col("text"), F.col("image"), F.col("cross")).alias("d"))
    return rows.select("doc_id", F.col("d.label").alias("label"), F.col("d.fake_cls").alias("fake_cls"), F.round("d.confidence", 6).alias("confidence"))


@query("""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'partial' WHEN 1 THEN 'false' END AS aligned, CAST(CASE doc_id % 3 WHEN 2 THEN NULL ELSE n % 100 / 100.0 END AS DOUBLE) AS confidence,
       CASE doc_id % 3 WHEN 1 THEN true END AS ai_generated, CASE doc_id % 3 WHEN 1 THEN h ELSE '' END AS anomalies, CASE doc_id % 3 WHEN 2 THEN 'no idea ' || h ELSE h END AS explanation
FROM (SELECT doc_id, length(coalesce(text, '')) AS n, md5(coalesce(text, '')) AS h FROM documents)""")
def signals_parse(spark, sf_dir):
    """Relevancy and veracity answers brought into their common form; what they say follows from the whole text."""
    d, whole = F.col("doc_id"), F.coalesce("text", F.lit(""))
    n, h = (F.char_length(whole) % 100 / 100).cast("string"), F.md5(whole)
    raw = (
        F.when(d % 3 == 0, F.concat(F.lit('{"aligned": "Partially", "confidence": '), n, F.lit(', "explanation": "'), h, F.lit('"}')))
        .when(d % 3 == 1, F.concat(F.lit('Answer {"aligned": "NO", "confidence": "'), n, F.lit('", "ai_generated": " Likely", "anomalies": "'), h, F.lit('", "explanation": "'), h, F.lit('"}')))
        .otherwise(F.concat(F.lit("no idea "), h))
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", claims.relevancy(raw).alias("r"), claims.veracity(raw).alias("v"))
    return rows.select("doc_id", F.col("r.aligned").alias("aligned"), F.col("r.confidence").alias("confidence"), F.col("v.ai_generated").alias("ai_generated"), F.array_join("v.anomalies", ",").alias("anomalies"), F.col("r.explanation").alias("explanation"))


@query("""
SELECT conv_id, CAST(turn % 2 AS BIGINT) AS chain, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id, turn % 2""")
def question_chains(spark, sf_dir):
    """The first question of each chain; a conversation's even and odd turns are two chains."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    quoted = F.concat(F.lit('q ["turn '), F.lpad(F.col("turn").cast("string"), 3, "0"), F.lit('"] end'))
    raw = turns.groupBy(F.col("conv_id").alias("sample"), (F.col("turn") % 2).alias("chain")).agg(F.min(quoted).alias("raw"))
    asked = claims.questions(raw, 1)
    return asked.select(F.col("sample").alias("conv_id"), "chain", F.regexp_extract("question", r"(\d+)", 1).cast("long").alias("turn"))


@query(None)
def pipeline_offline(spark, sf_dir):
    """The claim pipeline with an offline model over all documents' whole texts as headlines."""
    samples = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_index"), F.lit("none.png").alias("image_path"), F.trim("text").alias("headline"))
    out = claims.run_offline(samples, RunConfig(), EchoModel)
    return out.select("sample_index", "relevancy.aligned", "visual_veracity.ai_generated", "judgement.label", F.col("judgement.confidence").alias("confidence"), F.col("token_usage.total").alias("tokens"))


@query("SELECT event_id, event_type, value FROM events")
def stream_append_resume(spark, sf_dir):
    """Events through a stream that is started twice; the second start finds nothing new."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    keep = lambda df: df.select("event_id", "event_type", "value")
    for _ in range(2):
        resume.process_new(spark, sf_dir, schema, keep, f"{folder}/out", f"{folder}/checkpoint", fmt="parquet", glob="events.parquet")
    return spark.read.schema("event_id long, event_type string, value double").json(f"{folder}/out")


@query("""
WITH e AS (SELECT event_id, user_id, event_type IN ('click', 'view') AS early FROM events),
f AS (SELECT user_id, min(CASE WHEN early THEN event_id END) AS first_early, min(event_id) AS first FROM e GROUP BY user_id)
SELECT event_id, user_id, CAST(user_id * 7 % 101 AS BIGINT) AS score, NOT early AND first_early IS NOT NULL AS cache_hit,
       CASE WHEN early THEN event_id <> first_early ELSE first_early IS NULL AND event_id <> first END AS duplicate FROM e JOIN f USING (user_id)""")
def stream_cache(spark, sf_dir):
    """Events through a stream that keeps a result for each user: some kinds of events in a first start, the others in a second."""
    folder, early = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}", F.col("event_type").isin("click", "view")
    events = table(spark, sf_dir, "events")
    evaluate = lambda user: (user * 7 % 101,)
    for part in (early, ~early):
        events.filter(part).select("event_id", "user_id").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("event_id long, user_id long").parquet(f"{folder}/in")
        kept = stateful.cached_evaluation(stream, "user_id", "event_id", evaluate, StructType([StructField("score", LongType())]))
        stateful.run_to_end(kept, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


@query("""
SELECT 'r' || c_nationkey AS run, CAST(row_number() OVER w - 1 AS BIGINT) AS sample_index, c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 'failed' END AS error, CAST(row_number() OVER w AS BIGINT) AS processed, c_custkey % 10 <> 3 AS emitted
FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)""")
def stream_drain(spark, sf_dir):
    """Results of many runs that come in any order, in two starts, and are taken in by their index."""
    folder, key = f"{shared_folder(spark)}/drain-{uuid.uuid4().hex}", F.col("c_custkey")
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    results = table(spark, sf_dir, "customer").select(F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("run"), place.cast("long").alias("sample_index"), "c_custkey", F.when(key % 10 == 3, "failed").alias("error"))
    for part in (0, 1):
        results.filter(F.pmod(F.xxhash64("c_custkey"), F.lit(2)) == part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(results.schema).parquet(f"{folder}/in")
        stateful.run_to_end(stateful.drained_stream(stream, "run"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")
