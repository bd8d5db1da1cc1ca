"""Lookup joins, question chains, dedup-evaluation and bookkeeping over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import lookup, qa
from quillon.plans.registry import query, table

_ROOT = "/data/root"


def _spelled(spark, sf_dir):
    """Pages as source records with a path that follows from the url, and outputs that spell these paths in several ways."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("img/"), F.md5(F.coalesce("url", F.lit(""))), F.lit(".png")).alias("path"))
    odd = (
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("/"), F.col("path")))
        .when(F.col("page_id") % 5 == 1, F.concat(F.lit(_ROOT + "/"), F.col("path")))
        .when(F.col("page_id") % 5 == 2, F.concat(F.lit("./"), F.col("path")))
        .when(F.col("page_id") % 5 == 3, F.concat(F.lit("gone/"), F.col("path")))
        .otherwise(F.col("path"))
    )
    return pages, pages.select(F.col("page_id").alias("out_id"), odd.alias("out_path"))


_PAGES = """
WITH p AS (SELECT page_id, 'img/' || md5(coalesce(url, '')) || '.png' AS path FROM pages),
g AS (SELECT path, max(page_id) AS match FROM p GROUP BY path),
o AS (SELECT page_id AS out_id, path, CASE page_id % 5 WHEN 0 THEN '/' || path WHEN 1 THEN '/data/root/' || path WHEN 2 THEN './' || path WHEN 3 THEN 'gone/' || path ELSE path END AS out_path FROM p),
m AS (SELECT out_id, out_path, CASE WHEN out_id % 5 <> 3 THEN g.match END AS match FROM o LEFT JOIN g USING (path))"""


def _candidates(spark, sf_dir):
    records, outputs = _spelled(spark, sf_dir)
    return lookup.candidate_join(outputs, records, "out_id", text.path_candidates(F.col("out_path"), _ROOT), text.path_candidates(F.col("path"), _ROOT), "page_id", F.col("page_id"))


@query(_PAGES + " SELECT * FROM m")
def candidate_path_join(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query(_PAGES + " SELECT CAST(count_if(match IS NULL) AS BIGINT) AS missing, CAST(count(*) AS BIGINT) AS total FROM m")
def missing_matches(spark, sf_dir):
    return _candidates(spark, sf_dir).agg(F.count_if(F.col("match").isNull()).alias("missing"), F.count(F.lit(1)).alias("total"))


_CASCADE = """
WITH rec AS (SELECT doc_id AS idx, '/r/' || CAST(doc_id % 700 AS VARCHAR) AS path, trim(text) AS headline FROM documents),
o AS (
  SELECT doc_id AS out_id, CASE WHEN doc_id % 4 = 0 THEN doc_id WHEN doc_id % 4 = 1 THEN doc_id + 1 END AS order_index, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS details_index,
         CASE WHEN doc_id % 7 = 6 THEN '' ELSE '/r/' || CAST((doc_id % 700) + CASE WHEN doc_id % 5 = 0 THEN 100000 ELSE 0 END AS VARCHAR) END AS path,
         CASE WHEN doc_id % 11 = 0 THEN 'nothing like it' ELSE trim(text) END AS headline FROM documents),
bp AS (SELECT path, min(idx) AS i FROM rec GROUP BY path),
bt AS (SELECT trim(headline) AS t, min(idx) AS i, count(*) AS n FROM rec GROUP BY 1),
m AS (
  SELECT o.out_id,
    CASE WHEN trim(o.headline) = trim(a.headline) OR (o.path <> '' AND o.path = a.path) THEN struct_pack(i := a.idx, s := 'order_index')
         WHEN trim(o.headline) = trim(b.headline) OR (o.path <> '' AND o.path = b.path) THEN struct_pack(i := b.idx, s := 'details.dataset_index')
         WHEN bp.i IS NOT NULL THEN struct_pack(i := bp.i, s := 'image_path')
         WHEN bt.i IS NOT NULL THEN struct_pack(i := bt.i, s := CASE WHEN bt.n > 1 THEN 'headline*' ELSE 'headline' END) END AS m
  FROM o LEFT JOIN rec a ON o.order_index = a.idx LEFT JOIN rec b ON o.details_index = b.idx LEFT JOIN bp ON bp.path = o.path LEFT JOIN bt ON bt.t = trim(o.headline)),
r AS (SELECT out_id, m.i AS match_index, m.s AS match_source FROM m)"""


def _repaired(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.trim("text").alias("head"))
    d = F.col("doc_id")
    path = lambda shift: F.concat(F.lit("/r/"), (d % 700 + shift).cast("string"))
    records = docs.select(d.alias("idx"), path(F.lit(0)).alias("path"), F.col("head").alias("headline"))
    outputs = docs.select(
        d.alias("out_id"),
        F.when(d % 4 == 0, d).when(d % 4 == 1, d + 1).alias("order_index"),
        F.when(d % 3 == 0, d).alias("details_index"),
        F.when(d % 7 == 6, "").otherwise(path(F.when(d % 5 == 0, 100000).otherwise(0))).alias("path"),
        F.when(d % 11 == 0, "nothing like it").otherwise(F.col("head")).alias("headline"),
    )
    return lookup.cascade_join(outputs, records, [("order_index", "order_index"), ("details_index", "details.dataset_index")])


@query(_CASCADE + " SELECT * FROM r")
def cascade_repair(spark, sf_dir):
    return _repaired(spark, sf_dir).select("out_id", "match_index", "match_source")


@query(_CASCADE + " SELECT match_source, CAST(count(*) AS BIGINT) AS n FROM r WHERE match_source IS NOT NULL GROUP BY 1")
def repair_source_counts(spark, sf_dir):
    return lookup.source_counts(_repaired(spark, sf_dir))


@query(_CASCADE + " SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(match_source) AS BIGINT) AS matched, CAST(count_if(match_source IS NULL) AS BIGINT) AS unmatched FROM r")
def repair_stats(spark, sf_dir):
    return lookup.repair_stats(_repaired(spark, sf_dir))


@query(_CASCADE + """,
u AS (SELECT out_id, count(*) OVER () AS n FROM r WHERE match_source IS NULL)
SELECT * FROM (SELECT out_id AS line_no, 'no_match' AS reason FROM u ORDER BY out_id LIMIT 20)
UNION ALL SELECT NULL, '... and ' || CAST(max(n) - 20 AS VARCHAR) || ' more' FROM u HAVING max(n) > 20""")
def unmatched_report(spark, sf_dir):
    """The first 20 unmatched rows as a report lists them, and how many more there are."""
    rows = _repaired(spark, sf_dir).filter(F.col("match_source").isNull())
    return lookup.first_and_more(rows, "out_id", 20).select(F.col("out_id").alias("line_no"), F.coalesce("more", F.lit("no_match")).alias("reason"))


@query("""
WITH c AS (SELECT c_custkey AS idx, 'seg/' || c_mktsegment AS path, c_name AS details FROM customer),
bp AS (SELECT path, max_by(details, idx) AS d FROM c GROUP BY path),
o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS "index", 'seg/' || CASE WHEN o_orderkey % 2 = 0 THEN 'BUILDING' ELSE 'NONE' END AS path, o_orderkey % 10 = 0 AS known FROM orders)
SELECT o_orderkey, CASE WHEN NOT known THEN coalesce(c.details, bp.d) END AS details FROM o LEFT JOIN c ON o."index" = c.idx LEFT JOIN bp ON bp.path = o.path""")
def enrich_join(spark, sf_dir):
    records = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.concat(F.lit("seg/"), F.col("c_mktsegment")).alias("path"), F.col("c_name").alias("details"))
    key = F.col("o_orderkey")
    outputs = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(key % 3 != 0, F.col("o_custkey")).alias("index"), F.concat(F.lit("seg/"), F.when(key % 2 == 0, "BUILDING").otherwise("NONE")).alias("path"), (key % 10 == 0).alias("known")
    )
    return lookup.enrich_join(outputs, records, F.col("known")).select("o_orderkey", "details")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi_exists(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(items, "o_orderkey", "left_semi")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def anti_remaining(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return lookup.remaining(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


# ---- conversations as question chains ----------------------------------------

_PAIRS = """
WITH n AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT conv_id, turn, text AS question, CASE WHEN nr = 'assistant' THEN nt END AS answer FROM n WHERE role = 'user')"""


def _pairs(spark, sf_dir):
    return qa.pair_turns(table(spark, sf_dir, "conversations"))


@query(_PAIRS + " SELECT conv_id, turn, md5(question) AS question, md5(answer) AS answer FROM q")
def qa_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@query(_PAIRS + """,
c AS (SELECT *, length(answer) % 10 / 10.0 AS confidence FROM q)
SELECT conv_id, turn, CAST(confidence AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(confidence, 0) DESC, turn) AS r FROM c) WHERE r = 1""")
def qa_best_per_conv(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("confidence", F.length("answer") % 10 / 10.0)
    return qa.best_answer(rows, ["conv_id"], "turn").select("conv_id", "turn", "confidence")


@query("SELECT conv_id, turn, CAST(r AS INTEGER) AS rank FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations) WHERE r <= 3")
def qa_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return qa.top_k(rows, "conv_id", [F.desc("n"), "turn"], 3).select("conv_id", "turn", "rank")


@query("""
SELECT conv_id, turn, CASE WHEN length(a) > 220 THEN left(a, 217) || '...' ELSE a END AS short, CAST(n AS INTEGER) AS context_size FROM (
  SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS a, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS n FROM conversations)""")
def qa_last_n_context(spark, sf_dir):
    rows = qa.last_context(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 5)
    return rows.select("conv_id", "turn", text.shorten(text.collapse_spaces(F.col("text")), 220).alias("short"), F.size("context").alias("context_size"))


@query(_PAIRS + """
, a AS (SELECT conv_id, turn, length(answer) AS answer_chars FROM q WHERE answer IS NOT NULL)
SELECT q.conv_id, q.turn, a.answer_chars FROM q LEFT JOIN a USING (conv_id, turn)""")
def answer_lookup(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    answers = pairs.filter("answer IS NOT NULL").select("conv_id", "turn", F.length("answer").cast("long").alias("answer_chars"))
    return qa.answers_for(pairs.select("conv_id", "turn"), answers, ["conv_id", "turn"])


@query("""
WITH w AS (SELECT conv_id, turn, lower(trim(text)) AS k FROM conversations),
p AS (SELECT DISTINCT conv_id, k FROM w WHERE turn = 0)
SELECT conv_id, turn, md5(k) AS question FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, k ORDER BY turn) AS r FROM w) x WHERE r = 1 AND k <> ''
  AND NOT EXISTS (SELECT 1 FROM p WHERE p.conv_id = x.conv_id AND p.k = x.k)""")
def dedup_questions(spark, sf_dir):
    """Whole turns as questions; those of the first turn count as asked before."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("question"))
    found = qa.dedup_questions(rows, "conv_id", ["turn"], prior=rows.filter("turn = 0"))
    return found.select("conv_id", "turn", F.md5(F.lower(F.trim("question"))).alias("question"))


@query("""
WITH w AS (SELECT conv_id, turn, CAST(i AS BIGINT) AS i, ws[i] AS word FROM (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations), generate_series(1, len(ws)) g(i))
SELECT conv_id, turn, md5(string_agg(word, ' ' ORDER BY i)) AS words FROM (SELECT conv_id, turn, word, min(i) AS i FROM w GROUP BY ALL) GROUP BY conv_id, turn""")
def ordered_distinct(spark, sf_dir):
    distinct = F.array_distinct(F.split("text", " "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.array_join(distinct, " ")).alias("words"))


# ---- dedup-evaluation ---------------------------------------------------------

_JOBS = """
WITH j AS (SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN props END AS key, value FROM events),
f AS (SELECT key, min(event_id) AS first FROM j GROUP BY key),
c AS (SELECT DISTINCT key FROM j WHERE key LIKE '%5}'),
r AS (SELECT j.event_id, j.key, j.value, event_id <> first AS duplicate, c.key IS NOT NULL AS cache_hit, length(coalesce(j.key, '')) % 3 + 1 AS attempts, CAST(length(coalesce(j.key, '')) AS DOUBLE) AS duration_ms, coalesce(j.key, '') LIKE '%7}' AS failed
      FROM j JOIN f ON j.key IS NOT DISTINCT FROM f.key LEFT JOIN c ON c.key = j.key)"""


def _jobs(spark, sf_dir):
    """Events as jobs keyed by their properties, some without a key; keys that end in 5 are in the cache."""
    jobs = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 17 != 0, F.col("props")).alias("key"))
    text = F.coalesce("key", F.lit(""))
    cost = lambda df: df.select("key", (F.length(text) % 3 + 1).alias("attempts"), F.length(text).cast("double").alias("duration_ms"), text.endswith("7}").alias("failed"))
    cache = cost(jobs.filter(F.col("key").endswith("5}")).select("key").distinct())
    return lookup.dedup_eval(jobs, "key", "event_id", cost, cache)


@query(_JOBS + """
SELECT CAST(count(*) AS BIGINT) AS queued, CAST(count_if(NOT duplicate) AS BIGINT) AS "unique", CAST(count_if(NOT duplicate AND NOT cache_hit) AS BIGINT) AS unique_executed,
       CAST(count_if(duplicate) AS BIGINT) AS duplicates, CAST(count_if(cache_hit) AS BIGINT) AS cache_hits, CAST(count_if(NOT duplicate AND NOT cache_hit AND NOT failed) AS BIGINT) AS unique_success,
       CAST(count_if(NOT duplicate AND NOT cache_hit AND failed) AS BIGINT) AS unique_error, CAST(sum(CASE WHEN NOT duplicate AND NOT cache_hit THEN attempts - 1 END) AS BIGINT) AS retry_count,
       round(sum(CASE WHEN NOT duplicate AND NOT cache_hit THEN duration_ms END), 3) AS duration_ms_total, max(CASE WHEN NOT duplicate AND NOT cache_hit THEN duration_ms END) AS duration_ms_max,
       round(avg(CASE WHEN NOT duplicate AND NOT cache_hit THEN duration_ms END), 3) AS avg_duration_ms FROM r""")
def batch_dedup_metrics(spark, sf_dir):
    return lookup.batch_metrics(_jobs(spark, sf_dir))


@query(_JOBS + " SELECT event_id, key, CAST(attempts AS INTEGER) AS attempts, cache_hit, duplicate FROM r")
def batch_fanout(spark, sf_dir):
    return _jobs(spark, sf_dir).select("event_id", "key", "attempts", "cache_hit", "duplicate")


# ---- runs and resumption ------------------------------------------------------


@query("SELECT o_orderkey, printf('run.upto%05d.json', o_orderkey) AS name, '--resume ' || printf('run.upto%05d.json', o_orderkey) AS hint FROM orders")
def checkpoint_names(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.checkpoint_name(F.lit("run"), F.col("o_orderkey")).alias("name"))
    return rows.withColumn("hint", text.resume_hint(F.col("name")))


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 500 = 0 THEN o_orderkey + 1 ELSE row_number() OVER (ORDER BY o_orderkey) - 1 END AS stored, row_number() OVER (ORDER BY o_orderkey) - 1 AS expected FROM orders)
SELECT o_orderkey, CAST(stored AS BIGINT) AS stored, CAST(expected AS BIGINT) AS expected FROM o WHERE stored <> expected""")
def sequential_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    numbered = lookup.numbered(orders, "o_orderkey", "place")
    rows = numbered.select("o_orderkey", F.when(F.col("o_orderkey") % 500 == 0, F.col("o_orderkey") + 1).otherwise(F.col("place")).alias("stored"))
    return lookup.sequential_check(rows, "o_orderkey", "stored")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1000000000 OFFSET 500")
def resume_offset(spark, sf_dir):
    """What is left after the first 500 rows."""
    return table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").offset(500)


@query("""
SELECT stem, count(*) FILTER (WHERE kind = 'jsonl') > 0 AS has_jsonl, count(*) FILTER (WHERE kind = 'html') > 0 AS has_html FROM (
  SELECT regexp_replace(f, '\\..*', '') AS stem, regexp_extract(f, '\\.([a-z]+)$', 1) AS kind FROM (
    SELECT 'run' || CAST(page_id % 50 AS VARCHAR) || CASE WHEN page_id % 3 = 0 THEN '.jsonl' WHEN page_id % 3 = 1 THEN '.metrics.html' ELSE '.metadata.json' END AS f FROM pages)) GROUP BY stem""")
def run_artefacts(spark, sf_dir):
    """Files of runs brought together by the stem of their names."""
    p = F.col("page_id")
    name = F.concat(F.lit("run"), (p % 50).cast("string"), F.when(p % 3 == 0, ".jsonl").when(p % 3 == 1, ".metrics.html").otherwise(".metadata.json"))
    files = table(spark, sf_dir, "pages").select(F.regexp_replace(name, r"\..*", "").alias("stem"), F.regexp_extract(name, r"\.([a-z]+)$", 1).alias("kind"))
    return files.groupBy("stem").agg((F.count_if(F.col("kind") == "jsonl") > 0).alias("has_jsonl"), (F.count_if(F.col("kind") == "html") > 0).alias("has_html"))
