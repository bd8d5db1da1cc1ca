"""Sources, sinks, clients and resumption over the driver tables; files go to the shared folder."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from quillon.functions import labels, text
from quillon.operators import lookup
from quillon.operators.ordered import numbered
from quillon.operators.sampling import uniform
from quillon.plans import claims
from quillon.plans.queries_metrics import u_sql
from quillon.plans.registry import query, table
from quillon.sources import images, records, sinks
from quillon.sources.clients import EchoModel, EchoSearch
from quillon.sources.config import RunConfig
from quillon.streaming import resume


def _folder(spark, name: str) -> str:
    return f"{sinks.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- datasets and JSON lines ---------------------------------------------------


#: Records of one JSON document.
_DOCUMENT = 500


@query(f"""
SELECT CAST((row_number() OVER (ORDER BY page_id) - 1) % {_DOCUMENT} AS BIGINT) AS dataset_index, url AS text, 'p}}{{"' || CAST(page_id AS VARCHAR) AS image_path FROM pages""")
def dataset_scan(spark, sf_dir):
    """Pages as JSON documents of the kind that holds its records under a key, with elements between them that are no records; read by byte ranges."""
    row = F.to_json(F.struct(F.col("url").alias("text"), F.concat(F.lit('p}{"'), F.col("page_id").cast("string")).alias("image_path"), F.struct(F.array(F.lit(1)).alias("b")).alias("a")))
    placed = numbered(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id", "place")
    rows = placed.select(F.floor(F.col("place") / _DOCUMENT).alias("document"), (F.col("place") % _DOCUMENT + 1).alias("line"), F.concat(F.lit(', 7, [{"no": 1}], '), row).alias("value"))
    documents = rows.select("document").distinct()
    frame = lambda line, text: documents.select("document", F.lit(line).cast("long").alias("line"), F.lit(text).alias("value"))
    lines = rows.unionByName(frame(0, '{"name": "pages", "tags": [1], "items": ["stray"')).unionByName(frame(_DOCUMENT + 1, '], "more": {"items": [{}]}}'))
    folder = _folder(spark, "dataset")
    lines.repartition("document").sortWithinPartitions("document", "line").select("document", "value").write.partitionBy("document").text(folder)
    return records.project_records(records.scan_dataset(spark, folder)).select("dataset_index", "text", "image_path")


#: How lines are spelled: some cut off, some JSON but no object, some blank.
_LINES_SQL = """
WITH l AS (SELECT event_id, event_type, CASE WHEN event_id % 7 = 3 THEN 'cut' WHEN event_id % 11 = 5 THEN 'number' WHEN event_id % 13 = 6 THEN 'blank' ELSE 'good' END AS kind FROM events)"""


def _lines(spark, sf_dir, one_file: bool = False):
    e = F.col("event_id")
    whole = F.to_json(F.struct("event_id", "event_type"))
    line = F.when(e % 7 == 3, F.left(whole, F.lit(9))).when(e % 11 == 5, e.cast("string")).when(e % 13 == 6, " ").otherwise(whole)
    folder, events = _folder(spark, "lines"), table(spark, sf_dir, "events")
    (events.orderBy("event_id").coalesce(1) if one_file else events).select(line.alias("value")).write.text(folder)
    return folder


@query(_LINES_SQL + " SELECT event_id, event_type FROM l WHERE kind = 'good'")
def jsonl_lenient(spark, sf_dir):
    return records.scan_jsonl(spark, _lines(spark, sf_dir), "event_id long, event_type string").filter("event_id IS NOT NULL")


@query(_LINES_SQL + " SELECT kind = 'good' AS whole, CAST(count(*) AS BIGINT) AS n FROM l WHERE kind <> 'blank' GROUP BY 1")
def jsonl_ledger(spark, sf_dir):
    rows = records.scan_jsonl(spark, _lines(spark, sf_dir), "event_id long, event_type string", "ledger")
    return rows.groupBy((F.col("_corrupt").isNull() & F.col("event_id").isNotNull()).alias("whole")).agg(F.count(F.lit(1)).alias("n"))


@query(_LINES_SQL + " SELECT CASE kind WHEN 'good' THEN 'object' ELSE 'number' END AS kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM l WHERE kind IN ('good', 'number') GROUP BY 1")
def jsonl_values(spark, sf_dir):
    """Lines that are any JSON, objects or not."""
    v = F.col("value")
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    ident = F.coalesce(F.try_variant_get(v, "$.event_id", "long"), F.try_variant_get(v, "$", "long"))
    rows = records.scan_values(spark, _lines(spark, sf_dir))
    return rows.groupBy(F.when(is_object, "object").otherwise("number").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(ident).alias("ids"))


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS sample_index, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS iteration_index, o_orderkey FROM orders")
def sequential_outputs(spark, sf_dir):
    """Outputs in JSON lines that are checked to be sequential while they are read."""
    path = _folder(spark, "sequence")
    placed = lookup.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "iteration_index")
    sinks.append_jsonl(placed.withColumn("sample_index", F.col("iteration_index") + 1), path)
    return records.check_sequence(records.scan_jsonl(spark, path, "sample_index long, iteration_index long, o_orderkey long"))


@query(_LINES_SQL + " SELECT CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS line_no, 'json_decode_error' AS reason FROM l QUALIFY kind IN ('cut', 'number')")
def corruption_ledger(spark, sf_dir):
    return records.corruption_ledger(spark, _lines(spark, sf_dir, one_file=True))


@query("SELECT o_orderkey AS sample_index, CAST(o_totalprice AS DOUBLE) AS price, o_orderkey % 2 = 0 AS fixed FROM orders")
def rewrite_jsonl(spark, sf_dir):
    """Orders as JSON lines, rewritten from themselves; the old lines stay as a backup."""
    path = _folder(spark, "rewrite")
    sinks.append_jsonl(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_index"), F.col("o_totalprice").cast("double").alias("price")), path)
    schema = "sample_index long, price double"
    sinks.rewrite_jsonl(spark.read.schema(schema).json(path).withColumn("fixed", F.col("sample_index") % 2 == 0), path)
    return spark.read.schema(schema + ", fixed boolean").json(path)


@query("""
SELECT f AS format, CAST(count(*) AS BIGINT) AS rows, CAST(sum(c_custkey) AS BIGINT) AS keys, min(c_name) AS first_name FROM customer, (SELECT unnest(['csv', 'orc', 'parquet', 'json']) AS f) GROUP BY f""")
def table_formats(spark, sf_dir):
    """Customers written and read in each table format."""
    customers, out = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), None
    for fmt in ("csv", "orc", "parquet", "json"):
        path = _folder(spark, fmt)
        customers.write.format(fmt).save(path)
        back = spark.read.format(fmt).schema(customers.schema).load(path)
        one = back.agg(F.lit(fmt).alias("format"), F.count(F.lit(1)).alias("rows"), F.sum("c_custkey").alias("keys"), F.min("c_name").alias("first_name"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT o_orderkey AS sample_index, o_orderkey % 9 AS prompt_tokens, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 5 END AS completion_tokens,
       CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE o_orderkey % 9 + CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 5 END END AS total_tokens FROM orders""")
def tokens_csv(spark, sf_dir):
    k, path = F.col("o_orderkey"), _folder(spark, "tokens")
    usage = F.struct((k % 9).alias("prompt"), F.when(k % 4 != 0, k % 5).alias("completion"), F.when(k % 3 == 0, 100).otherwise(0).cast("long").alias("total"))
    sinks.write_tokens_csv(table(spark, sf_dir, "orders").select(k.alias("sample_index"), F.lit("i.png").alias("image_path"), F.lit("h").alias("headline"), usage.alias("token_usage")), path)
    schema = "sample_index long, image_path string, headline string, prompt_tokens long, completion_tokens long, total_tokens long"
    return spark.read.schema(schema).option("header", "true").csv(path).drop("image_path", "headline")


# ---- images ---------------------------------------------------------------------


@query("""
SELECT doc_id, CAST(greatest(1, (n + 23) // 24) AS INTEGER) AS height, CAST(8 AS INTEGER) AS width, md5(t || repeat(' ', CAST(greatest(1, (n + 23) // 24) * 24 - n AS INTEGER))) AS pixels
FROM (SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents)""")
def image_decode(spark, sf_dir):
    """Whole texts as the pixels of images that are eight wide, decoded to RGB and turned upside down twice."""

    def stored(batches):
        import pyarrow as pa

        for batch in batches:
            pictures = []
            for value in batch.column(1).cast(pa.binary()):
                raw = value.as_py() or b""
                height = max(1, -(-len(raw) // 24))
                pictures.append(images.encode_png(np.frombuffer(raw.ljust(24 * height), np.uint8).reshape(height, 8, 3)[::-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pictures, pa.binary())], names=["doc_id", "content"])

    files = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(stored, "doc_id long, content binary")
    return images.with_rgb(files, "content", lambda rgb: rgb[::-1]).select("doc_id", "height", "width", F.md5("rgb").alias("pixels"))


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 32 AS batch FROM orders)
SELECT CAST(batch AS BIGINT) AS batch, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, CAST(sum(o_custkey) AS BIGINT) AS customers FROM o GROUP BY batch HAVING count(*) = 32""")
def loader_batches(spark, sf_dir):
    """Orders in batches of 32, collated column by column; a last shorter batch is dropped."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    batches = images.collate(images.record_batches(orders, "o_orderkey", 32, drop_last=True), ["o_orderkey", "o_custkey"])
    return batches.select("batch", F.col("o_orderkey")[0].alias("first_key"), F.array_max("o_orderkey").alias("last_key"), F.aggregate("o_custkey", F.lit(0).cast("long"), lambda a, x: a + x).alias("customers"))


@query("""
SELECT source, 'data:text;base64,' || base64(encode(source || chr(10))) AS data_url, true AS found FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) UNION ALL SELECT 'nowhere', NULL, false""")
def image_scan(spark, sf_dir):
    """One small file for each source, scanned with its content, and which records have theirs."""
    folder = _folder(spark, "images")
    sources = table(spark, sf_dir, "documents").filter("source IS NOT NULL").select("source").distinct()
    sources.select("source", F.col("source").alias("value")).repartition("source").write.partitionBy("source").text(folder)
    files = records.scan_images(spark, folder).withColumn("source", F.regexp_extract("path", "source=([^/]+)/", 1))
    files = files.withColumn("data_url", F.regexp_replace("data_url", "^data:[^;]*", "data:text"))
    names = sources.union(spark.createDataFrame([("nowhere",)], "source string"))
    rows = names.withColumn("dataset_index", F.xxhash64("source")).withColumn("image_path", F.concat("source", F.lit(".txt")))
    known = files.select(F.concat(F.lit("/r/"), "source", F.lit(".txt")).alias("path"), "data_url")
    found, _ = records.existing(rows, known, "/r")
    return rows.select("source").join(found.join(known, "path").select("source", "data_url", F.lit(True).alias("found")), "source", "left").select("source", "data_url", F.coalesce("found", F.lit(False)).alias("found"))


@query("""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '../img/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.png' WHEN 1 THEN 'img/' || CAST(doc_id AS VARCHAR) || '.png' ELSE '../../other/x.png' END AS path FROM documents""")
def report_paths(spark, sf_dir):
    """Image paths as seen from the folder of a report."""
    d = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/data/run/img/"), "lang", F.lit("/"), d, F.lit(".png"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/data/run/html/img/"), d, F.lit(".png"))).otherwise("/data/other/x.png")
    return table(spark, sf_dir, "documents").select("doc_id", text.path_from(F.lit("/data/run/html"), path).alias("path"))


_ESCAPE = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"


@query(f"""
SELECT page_id AS sample_index, md5('<tr><td>' || page_id || '</td><td><img width="120" src="../img/p' || page_id || '.png"></td><td>' || {_ESCAPE.format("html")} || '</td><td>Uncertain</td><td>0.5</td><td>' ||
  CASE WHEN page_id % 2 = 0 THEN 'true' ELSE '' END || '</td><td>false</td><td><ul><li>' || {_ESCAPE.format("url")} || ': a&lt;b</li></ul></td></tr>') AS html FROM pages""")
def sample_report(spark, sf_dir):
    """The report's row of each page, its whole HTML as the headline."""
    p = F.col("page_id")
    outputs = table(spark, sf_dir, "pages").select(
        p.alias("sample_index"), F.concat(F.lit("/run/img/p"), p.cast("string"), F.lit(".png")).alias("image_path"), F.col("html").alias("headline"), F.struct(F.lit("Uncertain").alias("label"), F.lit(0.5).alias("confidence")).alias("judgement"),
        F.struct(F.when(p % 2 == 0, "true").alias("aligned")).alias("relevancy"), F.struct(F.lit(False).alias("ai_generated")).alias("visual_veracity"), F.array(F.struct(F.col("url").alias("question"), F.lit("a<b").alias("answer"))).alias("best_qa_per_chain"),
    )
    return sinks.sample_rows(outputs, "/run/html").select("sample_index", F.md5("html").alias("html"))


# ---- lists, details and searches --------------------------------------------------


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS flag FROM events""")
def environment_flags(spark, sf_dir):
    """Switches as environments hold them: unset, true words, and anything else."""
    e = F.col("event_id") % 4
    return table(spark, sf_dir, "events").select("event_id", labels.truthy(F.when(e == 0, " Yes").when(e == 1, "off").when(e == 2, F.col("event_type"))).alias("flag"))


@query("""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'own ' || url ELSE 'two' END AS first_line, CAST(2 AS INTEGER) AS n FROM pages""")
def bullet_lines(spark, sf_dir):
    """Questions out of plain lines with list marks; too short ones are none."""
    raw = F.concat(F.lit("- ok\n"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" * \n• own "), "url")).otherwise("-- two"), F.lit("\r\n  \n- three  -"))
    raw = F.replace(raw, F.lit(" * \n"), F.lit(" \n"))
    found = text.bullet_lines(raw)
    return table(spark, sf_dir, "pages").select("page_id", found[0].alias("first_line"), F.size(found).alias("n"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE 'c' || CAST(o_custkey AS VARCHAR) END AS clerk, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status, 'kept' AS extra FROM orders""")
def merge_details(spark, sf_dir):
    """Details win over what a row has, other keys stay; rows without details are unchanged."""
    old = F.create_map(F.lit("clerk"), F.lit("old"), F.lit("extra"), F.lit("kept"))
    new = F.when(F.col("o_orderkey") % 3 != 0, F.create_map(F.lit("clerk"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.lit("status"), F.col("o_orderstatus")))
    merged = lookup.merge_details(old, new)
    return table(spark, sf_dir, "orders").select("o_orderkey", *[F.try_element_at(merged, F.lit(k)).alias(k) for k in ("clerk", "status", "extra")])


@query("""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'named' WHEN 1 THEN 'host' || CAST(page_id AS VARCHAR) ELSE '' END AS source FROM pages""")
def search_hosts(spark, sf_dir):
    """The source of a search result: its own, else the host that is nested in it."""
    p = F.col("page_id")
    host = F.struct(F.when(p % 3 != 2, F.concat(F.lit("host"), p.cast("string"))).alias("host"))
    raw = F.array(F.struct(F.col("url"), F.when(p % 3 == 0, " named ").alias("source"), host.alias("meta_url")))
    return table(spark, sf_dir, "pages").select("page_id", text.search_rows(raw, {"url", "source", "meta_url"})[0]["source"].alias("source"))


_SEARCH = "(SELECT url, md5('site:example.org ' || url) AS h FROM (SELECT DISTINCT url FROM pages))"


@query(f"""
SELECT page_id, 't' || substr(h, 1, 4) || ': d ' || substr(h, 9, 4) || chr(10) || ': ' || substr(h, 13, 8) AS knowledge FROM pages JOIN {_SEARCH} USING (url)""")
def knowledge_lookup(spark, sf_dir):
    """What a search of one site tells about each url as a headline."""
    samples = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("headline"))
    return claims.with_knowledge(samples, EchoSearch, "example.org").select("page_id", "knowledge")


@query("""
WITH q AS (SELECT page_id, url, md5(url) AS h FROM pages)
SELECT page_id, CASE WHEN length(url) % 3 = 0 THEN 'batch' ELSE substr(h, 1, 8) END AS payload, length(url) % 3 = 0 AS from_batch FROM q""")
def batch_fallback(spark, sf_dir):
    """Results of a batch, and single searches for what it has not or has with an error."""
    asked = table(spark, sf_dir, "pages").select("page_id", "url")
    batch = asked.select("url").distinct().filter("length(url) % 3 <> 1")
    batch = batch.select("url", F.lit("batch").alias("payload"), F.when(F.length("url") % 3 == 2, "timeout").alias("error"))
    from quillon.sources.clients import search_web

    single = lambda left: search_web(left, EchoSearch, "url", "found").select("url", F.right(F.col("found")[0]["url"], F.lit(8)).alias("payload"))
    return lookup.with_fallback_result(asked, batch, "url", "payload", single).select("page_id", "payload", "from_batch")


@query("""
SELECT CAST(sum(event_id % 3) AS BIGINT) AS "unique_executed", round(sum(event_id % 5 * 0.5), 3) AS duration_ms_total, CAST(count(*) AS BIGINT) AS queued,
       round(sum(event_id % 5 * 0.5) / sum(event_id % 3), 3) AS avg_duration_ms FROM events""")
def counters_fold(spark, sf_dir):
    """Counters of many workers as one."""
    e = F.col("event_id")
    workers = table(spark, sf_dir, "events").select(F.lit(1).cast("long").alias("queued"), (e % 3).alias("unique_executed"), (e % 5 * 0.5).alias("duration_ms_total"), F.col("event_type").alias("name"))
    return lookup.fold_counters(workers)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderkey END AS sample_index FROM orders ORDER BY coalesce(CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderkey END, 0), o_orderkey")
def index_order(spark, sf_dir):
    """Outputs in the order of their index; those without come first."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderkey")).alias("sample_index"))
    return lookup.by_index(rows)


@query(f"SELECT event_id, round(greatest(0, value * (1 + 0.25 * (2 * {u_sql('j', 'event_id')} - 1))), 6) AS wait FROM events")
def jittered_interval(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(text.jittered(F.col("value"), 0.25, uniform("j", F.col("event_id"))), 6).alias("wait"))


# ---- the claim pipeline ------------------------------------------------------------


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'no JSON ' || h ELSE h END AS answer, CASE doc_id % 3 WHEN 0 THEN n % 100 / 100.0 END AS confidence,
       CASE doc_id % 3 WHEN 0 THEN 'http://x/' || h || '|one' WHEN 1 THEN 'u' || h || '|' ELSE '' END AS citations FROM (SELECT doc_id, length(coalesce(text, '')) AS n, md5(coalesce(text, '')) AS h FROM documents)""")
def answer_normalize(spark, sf_dir):
    """Answers in several spellings; what they say follows from the whole text."""
    d, whole = F.col("doc_id"), F.coalesce("text", F.lit(""))
    n, h = (F.char_length(whole) % 100 / 100).cast("string"), F.md5(whole)
    raw = (
        F.when(d % 3 == 0, F.concat(F.lit('{"answer": "'), h, F.lit('", "confidence": '), n, F.lit(', "citations": [{"url": "http://x/'), h, F.lit('", "title": "one"}]}')))
        .when(d % 3 == 1, F.concat(F.lit('Well: {"answer": "'), h, F.lit('", "citations": ["u'), h, F.lit('"]}')))
        .otherwise(F.concat(F.lit("no JSON "), h))
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", claims.answer(raw).alias("a"))
    cited = F.array_join(F.transform("a.citations", lambda c: F.concat(c["url"], F.lit("|"), c["title"])), ",")
    return rows.select("doc_id", F.col("a.answer").alias("answer"), F.col("a.confidence").alias("confidence"), cited.alias("citations"))


_DIGEST = "md5('{system}' || chr(10) || {user})"
_NUMBER = "CAST(('0x' || substr({h}, 1, 8)) AS BIGINT)"
_PIPELINE = f"""
WITH h AS (SELECT doc_id, trim(coalesce(text, '')) AS headline FROM documents),
n AS (SELECT doc_id, {_NUMBER.format(h=_DIGEST.format(system=claims._RELEVANCY_PROMPT, user="headline"))} % 3 AS r, {_NUMBER.format(h=_DIGEST.format(system=claims._VERACITY_PROMPT, user="headline"))} % 3 AS v FROM h),
s AS (
  SELECT doc_id, ['true', 'partial', 'false'][r + 1] AS aligned, CAST([0.9, 0.5, 0.8][r + 1] AS DOUBLE) AS rc, [false, NULL, true][v + 1] AS ai, CAST([0.9, 0.5, 0.8][v + 1] AS DOUBLE) AS vc FROM n),
x AS (SELECT *, 0.7 * CASE aligned WHEN 'true' THEN -rc WHEN 'false' THEN rc ELSE -0.4 * rc END + 0.3 * CASE WHEN ai THEN 0.5 * vc WHEN NOT ai THEN -0.25 * vc ELSE 0 END AS score FROM s)"""


def _claims(spark, sf_dir):
    return table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("sample_index"), F.lit("none.png").alias("image_path"), F.trim("text").alias("headline"), F.col("doc_id").alias("dataset_index"), F.col("source").alias("text_source"))


@query(_PIPELINE + """
SELECT doc_id + 1 AS sample_index, aligned, rc AS relevancy, ai AS ai_generated, vc AS veracity, CASE WHEN score >= 0.3 THEN 'Misinformation' WHEN score <= -0.3 THEN 'Not Misinformation' ELSE 'Uncertain' END AS label,
       doc_id AS dataset_index, source AS text_source, doc_id AS iteration_index, 'openai/0 questions' AS run FROM x JOIN documents USING (doc_id)""")
def claim_records(spark, sf_dir):
    """Relevancy and veracity of all documents' whole texts as headlines, each judged by the rules where the model fails, as whole records."""

    class Down(EchoModel):
        def ask(self, system, user, image_url=None):
            if "with label" in system:
                raise RuntimeError("no judge today")
            return super().ask(system, user, image_url)

    out = claims.run_offline(_claims(spark, sf_dir), RunConfig(disable_questions=True), Down)
    run = F.concat("run_params.provider", F.lit("/"), F.size("best_qa_per_chain").cast("string"), F.lit(" questions"))
    return out.select(
        "sample_index", "relevancy.aligned", F.col("relevancy.confidence").alias("relevancy"), "visual_veracity.ai_generated", F.col("visual_veracity.confidence").alias("veracity"), "judgement.label",
        F.col("sample_details.dataset_index").alias("dataset_index"), "sample_details.text_source", "iteration_index", run.alias("run"),
    )


_STAGE_ROWS = "(SELECT page_id, '{\"headline\":\"page ' || page_id || '\",\"relevancy\":{\"aligned\":\"true\"' || CASE WHEN page_id % 2 = 0 THEN ',\"confidence\":0.5' ELSE '' END || ',\"explanation\":\"e\",\"raw\":\"r\"},\"visual_veracity\":{\"ai_generated\":false},\"best_qa_per_chain\":[{\"question\":\"q\",\"answer\":\"a\",\"confidence\":0.25,\"citations_count\":1}]}' AS payload FROM pages)"


@query(f"""
WITH j AS (SELECT page_id, h, {_NUMBER.format(h="h")} AS n FROM (SELECT page_id, {_DIGEST.format(system=claims._JUDGE_PROMPT, user="payload")} AS h FROM {_STAGE_ROWS}))
SELECT page_id AS sample_index, ['Misinformation', 'Not Misinformation', 'Uncertain'][n % 3 + 1] AS label, CAST(n % 101 / 100.0 AS DOUBLE) AS confidence, substr(h, 1, 6) AS rationale, substr(h, 7, 6) AS factor FROM j""")
def model_judge(spark, sf_dir):
    """A model's judgement of what the stages found, from its compact payload."""
    p = F.col("page_id")
    relevancy = F.struct(F.lit("true").alias("aligned"), F.when(p % 2 == 0, 0.5).alias("confidence"), F.lit("e").alias("explanation"), F.lit("r").alias("raw"))
    pair = F.struct(F.lit("q").alias("question"), F.lit("a").alias("answer"), F.lit(0.25).alias("confidence"), F.array(F.struct(F.lit("u").alias("url"), F.lit("t").alias("title"))).alias("citations"))
    stages = table(spark, sf_dir, "pages").select(
        p.alias("sample_index"), F.concat(F.lit("page "), p.cast("string")).alias("headline"), relevancy.alias("relevancy"), F.struct(F.lit(False).alias("ai_generated"), F.lit(None).cast("double").alias("confidence")).alias("visual_veracity"),
        F.array(pair).alias("best_qa"), F.lit(0).cast("long").alias("_prompt"), F.lit(0).cast("long").alias("_completion"),
    )
    judged = claims.judge(stages, EchoModel)
    return judged.select("sample_index", "judgement.label", F.col("judgement.confidence").alias("confidence"), "judgement.rationale", F.col("judgement.key_factors")[0].alias("factor"))


def _grey_jpeg(values: bytes) -> bytes:
    """16 grey squares of 8 x 8 pixels as a sequential JPEG of 32 x 32; each differs from the one before by its first coefficient only."""
    segment = lambda kind, body: bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body
    bits, before = "", 128
    for v in values:
        size = abs(v - before).bit_length()
        low = v - before if v > before else v - before + (1 << size) - 1
        bits += format(size, "04b") + (format(low, f"0{size}b") if size else "") + "0"
        before = v
    bits += "1" * (-len(bits) % 8)
    coded = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    codes = segment(0xC4, bytes([0, 0, 0, 0, 12, *[0] * 12, *range(12)])) + segment(0xC4, bytes([0x10, 1, *[0] * 15, 0]))  # 12 sizes in four bits each; a block's end in one
    frame = segment(0xC0, bytes([8, 0, 32, 0, 32, 1, 1, 0x11, 0]))
    return b"\xff\xd8" + segment(0xDB, bytes([0, *[8] * 64])) + frame + codes + segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + coded + b"\xff\xd9"


@query("""
WITH h AS (SELECT page_id, md5(coalesce(html, '')) AS h FROM pages),
v AS (SELECT page_id, i, CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) AS v FROM h, range(16) t(i))
SELECT page_id, CAST(sum(v) * 64 * 3 AS BIGINT) AS total, CAST(max(CASE WHEN i = 0 THEN v END) AS BIGINT) AS first, CAST(max(CASE WHEN i = 15 THEN v END) AS BIGINT) AS last FROM v GROUP BY page_id""")
def jpeg_decode(spark, sf_dir):
    """Digests of whole pages drawn as JPEG images, decoded to pixels."""
    digests = table(spark, sf_dir, "pages").select("page_id", F.unhex(F.md5(F.coalesce("html", F.lit("")))).alias("digest"))

    def draw(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_grey_jpeg(d.as_py()) for d in batch.column(1)], pa.binary())], names=["page_id", "content"])

    def look(batches):
        import pyarrow as pa

        for batch in batches:
            pixels = [np.frombuffer(b.as_py(), np.uint8) for b in batch.column(1)]
            found = [pa.array([int(f(p)) for p in pixels], pa.int64()) for f in (lambda p: p.sum(dtype=np.int64), lambda p: p[0], lambda p: p[-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=["page_id", "total", "first", "last"])

    drawn = images.with_rgb(digests.mapInArrow(draw, "page_id long, content binary"), "content")
    return drawn.select("page_id", "rgb").mapInArrow(look, "page_id long, total long, first long, last long")


_IMAGES = "SELECT 'i' || page_id % 7 || '.png' AS image_path, min('data:,' || md5(coalesce(html, ''))) AS url FROM pages WHERE page_id % 7 <> 3 GROUP BY 1"


def _images(spark, sf_dir):
    """Images of seven paths, one of them missing, whose content is made of whole pages."""
    path = F.concat(F.lit("i"), (F.col("page_id") % 7).cast("string"), F.lit(".png"))
    pages = table(spark, sf_dir, "pages").filter("page_id % 7 <> 3")
    found = pages.groupBy(path.alias("image_path")).agg(F.min(F.concat(F.lit("data:,"), F.md5(F.coalesce("html", F.lit(""))))).alias("image_url"))
    return sinks.written(found, "images")  # a table that is seen to be small: the join leaves the texts where they are


def _shown(system: str) -> str:
    return _NUMBER.format(h=_DIGEST.format(system=system, user="headline || coalesce(chr(10) || url, '')"))


@query(f"""
WITH s AS (SELECT doc_id + 1 AS sample_index, trim(coalesce(text, '')) AS headline, 'i' || doc_id % 7 || '.png' AS image_path FROM documents),
n AS (SELECT s.*, {_shown(claims._RELEVANCY_PROMPT)} % 3 AS r, {_shown(claims._VERACITY_PROMPT)} % 3 AS v, sample_index = min(sample_index) OVER (PARTITION BY headline, s.image_path) AS first
      FROM s LEFT JOIN ({_IMAGES}) i USING (image_path))
SELECT sample_index, ['true', 'partial', 'false'][r + 1] AS aligned, [false, NULL, true][v + 1] AS ai_generated,
       CAST(CASE WHEN first THEN 2 * len(list_filter(regexp_split_to_array(headline, '\\s+'), lambda w: w <> '')) ELSE 0 END AS BIGINT) AS prompt FROM n""")
def image_signals(spark, sf_dir):
    """Relevancy and veracity of all documents as headlines, each with an image that the model is shown; equal pairs are asked once, and the first pays."""
    path = F.concat(F.lit("i"), (F.col("doc_id") % 7).cast("string"), F.lit(".png"))
    samples = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("sample_index"), path.alias("image_path"), F.coalesce(F.trim("text"), F.lit("")).alias("headline"))
    out = claims.run_offline(samples, RunConfig(disable_questions=True, disable_judge=True), EchoModel, images=_images(spark, sf_dir))
    return out.select("sample_index", "relevancy.aligned", "visual_veracity.ai_generated", "token_usage.prompt")


_BASELINE = {k: v.replace("{knowledge}", "") for k, v in claims._STAGE_PROMPTS.items()}


def _stage_number(kind: str) -> str:
    before, after = _BASELINE[kind].split("{headline}")
    shown = "" if kind == "text" else " || coalesce(chr(10) || url, '')"
    return _NUMBER.format(h=_DIGEST.format(system="You check claims.", user=f"'{before}' || headline || '{after}'{shown}")) + " % 3"


@query(f"""
WITH h AS (SELECT doc_id, trim(coalesce(text, '')) AS headline, url FROM documents LEFT JOIN ({_IMAGES}) ON image_path = 'i' || doc_id % 7 || '.png'),
n AS (SELECT doc_id, {_stage_number("text")} AS t, {_stage_number("image")} AS i, {_stage_number("cross")} AS c FROM h)
SELECT doc_id AS sample_index, CASE WHEN t = 1 OR i = 1 OR c = 1 THEN 'Misinformation' ELSE 'Not Misinformation' END AS label,
       CASE WHEN t = 1 THEN 'textual_veracity_distortion' WHEN i = 1 THEN 'visual_veracity_distortion' WHEN c = 1 THEN 'mismatch' ELSE 'original' END AS fake_cls,
       CASE WHEN t = 1 THEN NULL WHEN i = 1 THEN 'REFUTES' ELSE 'SUPPORTS' END AS image_verdict FROM n""")
def baseline_run(spark, sf_dir):
    """The three-stage baseline over all documents' whole texts as headlines; a stage is asked only about what earlier ones let pass, and those about the image are shown it."""
    path = F.concat(F.lit("i"), (F.col("doc_id") % 7).cast("string"), F.lit(".png"))
    samples = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_index"), path.alias("image_path"), F.coalesce(F.trim("text"), F.lit("")).alias("headline"))
    out = claims.run_baseline(samples, EchoModel, images=_images(spark, sf_dir))
    return out.select("sample_index", "judgement.label", "judgement.fake_cls", F.col("image.verdict").alias("image_verdict"))


@query(None)
def question_rounds(spark, sf_dir):
    """Question chains over all conversations, whole: asked, searched, answered, chosen, with follow-ups between them."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n")
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said.alias("headline")).withColumnRenamed("conv_id", "sample")  # the turns of one conversation
    state = claims.chains(whole, RunConfig(), EchoModel, EchoSearch)
    return state.select(F.col("sample").alias("conv_id"), F.size("asked").alias("asked"), F.size("answered").alias("answered"), F.explode("best").alias("b"), (F.col("_prompt") + F.col("_completion")).alias("tokens")).select(
        "conv_id", "asked", "answered", "tokens", "b.chain", "b.question", "b.answer", "b.confidence"
    )


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND source IS NULL THEN NULL ELSE doc_id % 7 END AS dataset_index, source AS text_source FROM documents WHERE NOT (doc_id % 5 = 0 AND source IS NULL)""")
def details_projection(spark, sf_dir):
    """Details of samples: null where there is nothing to tell."""
    index = F.when((F.col("doc_id") % 5 != 0) | F.col("source").isNotNull(), F.col("doc_id") % 7)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("text_source"), index.alias("i"))
    told = rows.select("doc_id", claims.sample_details(rows.columns, F.col("i")).alias("d")).filter("d IS NOT NULL")
    return told.select("doc_id", "d.dataset_index", "d.text_source")


@query("""
SELECT conv_id, CAST(count(*) FILTER (WHERE turn % 3 <> 1) AS INTEGER) AS pairs, CAST(coalesce(sum(CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS cited FROM conversations GROUP BY conv_id""")
def slim_pairs(spark, sf_dir):
    """The pairs that a record keeps: nulls go, missing citations are an empty list."""
    cited = F.when(F.col("turn") % 3 == 0, F.array(F.struct(F.lit("u").alias("url"), F.lit("t").alias("title"))))
    pair = F.when(F.col("turn") % 3 != 1, F.struct(F.col("text").alias("question"), F.lit("a").alias("answer"), F.lit(0.5).alias("confidence"), cited.alias("citations")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(pair.alias("p"))).alias("pairs"))
    kept = claims.slim_pairs(F.transform("pairs", lambda x: x["p"]))
    return rows.select("conv_id", F.size(kept).alias("pairs"), F.aggregate(kept, F.lit(0).cast("long"), lambda a, q: a + F.size(q["citations"])).alias("cited"))


# ---- resumption ----------------------------------------------------------------------


@query("""
WITH o AS (SELECT o_orderkey % 3 AS part, o_orderkey FROM orders),
n AS (SELECT p.i AS start, count(*) FILTER (WHERE part <= p.i) AS processed_count, count(*) FILTER (WHERE part <= p.i AND part <> 1 AND o_orderkey % 10 < 6) AS written_count FROM o, range(3) p(i) GROUP BY p.i)
SELECT start, 'run' AS run_id, CASE start WHEN 1 THEN 'no_samples_processed' ELSE 'completed' END AS status, processed_count, processed_count AS next_index, written_count, CAST(7 AS BIGINT) AS chunk_size FROM n
UNION ALL SELECT 3, 'run', 'up_to_date', processed_count, processed_count, written_count, 7 FROM n WHERE start = 2""")
def checkpoint_state(spark, sf_dir):
    """A run over all orders that come in three parts, of the second of which no row is kept, and a start with nothing new; its document after each."""
    folder, out = _folder(spark, "state"), None
    source, orders = f"{folder}/in", table(spark, sf_dir, "orders").select("o_orderkey")
    for start in range(4):
        if start < 3:
            orders.filter(F.col("o_orderkey") % 3 == start).write.mode("append").parquet(source)
        keep = lambda df, wanted=start != 1: df.filter((F.col("o_orderkey") % 10 < 6) & F.lit(wanted))
        resume.run(spark, "run", "settings", source, "o_orderkey long", keep, f"{folder}/out", folder, files_per_batch=7 + start, fmt="parquet", glob="*.parquet")
        state = resume.read_state(spark, f"{folder}/run.json").select(F.lit(start).cast("long").alias("start"), "run_id", "status", "processed_count", "next_index", "written_count", "chunk_size")
        state = sinks.written(state, "state")
        out = state if out is None else out.unionByName(state)
    return out


@query("""
WITH s AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS i FROM orders)
SELECT count(*) AS done, count(*) AS next_index, true AS sequential, true AS same_last FROM s WHERE i <= (SELECT count(*) // 2 FROM orders)""")
def resume_point(spark, sf_dir):
    """Where a run that has half of the orders goes on."""
    orders = lookup.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "place")
    samples = orders.select((F.col("place") + 1).alias("sample_index"), F.col("o_orderkey").cast("string").alias("image_path"), F.lit("h").alias("headline"))
    half = samples.agg(F.floor(F.count(F.lit(1)) / 2).alias("_half"))  # one row
    outputs = samples.crossJoin(F.broadcast(half)).filter("sample_index <= _half").drop("_half")
    return resume.resume_point(outputs, samples)


@query("""
SELECT o_orderkey AS sample_index, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS processed, o_orderkey % 10 <> 3 AS emitted FROM orders""")
def ordered_drain(spark, sf_dir):
    """Results in order: a failed one counts and gives no output."""
    results = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_index"), F.when(F.col("o_orderkey") % 10 == 3, "failed").alias("error"))
    return resume.drained(results).drop("error")


@query("""
SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTE WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def stream_join(spark, sf_dir):
    """Clicks with the purchases of the same user within ten minutes, as the streaming join gives them on tables."""
    events = table(spark, sf_dir, "events")
    side = lambda kind, name: events.filter(F.col("event_type") == kind).select("user_id", F.col("ts").alias(f"{name}_ts"), F.col("event_id").alias(f"{name}_id"))
    return resume.joined_streams(side("click", "left"), side("purchase", "right"), "user_id", "left_ts", "right_ts", "10 minutes").select("left_id", "right_id")


@query("""
SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 'Misinformation' ELSE 'Not Misinformation' END AS label FROM events""")
def judged_lines(spark, sf_dir):
    """Labels of outputs that went through JSON lines in the output's own schema."""
    path, e = _folder(spark, "outputs"), F.col("event_id")
    rows = table(spark, sf_dir, "events").select(e.alias("sample_index"), F.struct(F.when(e % 4 < 2, "misinformation").otherwise("NOT misinformation").alias("label"), F.lit(0.5).alias("confidence")).alias("judgement"))
    sinks.append_jsonl(rows, path)
    return records.scan_jsonl(spark, path, mode="strict").select(F.col("sample_index").alias("event_id"), labels.canonical_label(F.col("judgement.label")).alias("label"))
