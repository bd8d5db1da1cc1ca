"""Cross-site boilerplate lines: distinct-site spread by HyperLogLog, exact near the threshold.

Every line hash gets a HyperLogLog sketch of the sites it is found on; sketches
have a fixed size and merge by aggregation, partly before the shuffle, so a line
that a third of all rows hold costs no more than others. Only lines whose
estimate is within ``BAND`` of the threshold get an exact distinct count. A line
on ``min_sites`` sites or more is boilerplate: its first occurrence (least
doc_id, then line number) stays, every other one is removed.

Texts meet the boilerplate lines in the scan: up to ``TABLE_LINES`` of them are
a constant hash table in which each line is looked up, so no text is shuffled.
More of them are joined with the line table instead, and the lines to remove
with the documents, by shuffles.

Built of DataFrame functions only.

Cases: lines are compared without the white space around them, blank lines stay
and are not counted; a null text stays null and has no lines; a null source is
no site; a row with a null doc_id counts for the sites but is never a line's first
place and keeps all its lines; a row of a repeated doc_id keeps a boilerplate line
only where that line's first place is; a document may become empty and stays as
such; an empty table gives no rows; further columns are kept.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, fresh_name, materialize

MIN_SITES = 8
#: Relative error of the sketches; at these counts far smaller in practice.
SKETCH_ERROR = 0.1
#: Estimates from min_sites / BAND to min_sites * BAND are counted exactly.
BAND = 2.0
#: So many boilerplate lines (about 50 bytes each) are looked up in the scan of the texts.
TABLE_LINES = 20_000
_BLANKS = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS))


def line_table(df: DataFrame) -> DataFrame:
    """(doc_id, pos, line, site) of every line with a visible character; ``line`` is a hash."""
    lines = df.select("doc_id", F.col("source").alias("site"), F.posexplode(_lines(F.col("text"))).alias("pos", "_text"))
    bare = lines.select("doc_id", "pos", _bare(F.col("_text")).alias("_bare"), "site").filter("_bare != ''")
    return bare.select("doc_id", "pos", F.xxhash64("_bare").alias("line"), "site")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line) of the lines found on ``min_sites`` sites or more."""
    spread = lines.groupBy("line").agg(F.approx_count_distinct("site", SKETCH_ERROR).alias("_about"), F.count(F.lit(1)).alias("_n"))
    likely = materialize(spread.filter((F.col("_n") >= min_sites) & (F.col("_about") >= min_sites / BAND)), "spread")
    near = likely.filter(F.col("_about") <= min_sites * BAND).select("line")
    # one row for each line and site before the join: a line on very many rows is no hot key there
    sites = lines.groupBy("line", "site").agg(F.lit(1).alias("_one")).join(near, "line", "left_semi")
    exact = sites.groupBy("line").agg(F.count("site").alias("_sites")).filter(F.col("_sites") >= min_sites).select("line")
    return likely.filter(F.col("_about") > min_sites * BAND).select("line").union(exact)


def _first_places(lines: DataFrame, common: DataFrame) -> DataFrame:
    """(line, doc, pos): where each of the ``common`` lines stays."""
    known = lines.filter("doc_id IS NOT NULL").join(common, "line")
    return known.groupBy("line").agg(F.min(F.struct("doc_id", "pos")).alias("_f")).select("line", F.col("_f.doc_id").alias("doc"), F.col("_f.pos").alias("pos"))


def _table(places: DataFrame, slots: int) -> Column:
    """The places as one constant array of ``slots`` lists; a line's hash names its list."""
    lists: list[list[dict]] = [[] for _ in range(slots)]
    for line, doc, pos in places.select("line", "doc", "pos").collect():  # the caller has checked their number
        lists[line % slots].append({"line": line, "doc": doc, "pos": pos})
    return F.from_json(F.lit(json.dumps(lists)), "array<array<struct<line: long, doc: long, pos: int>>>")


def _with_kept(df: DataFrame, kept: str, min_sites: int, table_lines: int) -> DataFrame:
    """``df`` with an array of the lines that stay; null where the text is."""
    lines = materialize(line_table(df), "lines")
    places = materialize(_first_places(lines, materialize(boilerplate(lines, min_sites), "boilerplate")), "places")
    count = places.count()
    if count <= table_lines:
        slots = max(1, 2 * count)
        table = _table(places, slots)

        def goes(line: Column, i: Column) -> Column:
            h = F.xxhash64(_bare(line))
            later = F.exists(F.get(table, F.pmod(h, F.lit(slots)).cast("int")), lambda p: (p["line"] == h) & ((p["doc"] != F.col("doc_id")) | (p["pos"] != i)))
            return F.coalesce(later, F.lit(False))

        return df.withColumn(kept, F.filter(_lines(F.col("text")), lambda line, i: ~goes(line, i)) if count else _lines(F.col("text")))
    doc, drop = fresh_name(df, "doc"), fresh_name(df, "drop")
    later = lines.join(places.withColumnRenamed("pos", "_pos"), "line").filter((F.col("doc_id") != F.col("doc")) | (F.col("pos") != F.col("_pos")))
    per_doc = later.groupBy("doc_id").agg(F.collect_set(F.struct("line", "pos")).alias("drop")).toDF(doc, drop)  # at most a document's lines
    joined = df.join(per_doc, F.col("doc_id") == F.col(doc), "left")
    named = lambda line, i: F.struct(F.xxhash64(_bare(line)).alias("line"), i.alias("pos"))
    stays = F.filter(_lines(F.col("text")), lambda line, i: ~F.array_contains(drop, named(line, i)))
    return joined.withColumn(kept, F.when(F.col(drop).isNull(), _lines(F.col("text"))).otherwise(stays)).select(*df.columns, kept)


def remove_boilerplate(df: DataFrame, min_sites: int = MIN_SITES, table_lines: int = TABLE_LINES) -> DataFrame:
    """``df`` with ``text`` cleaned; if it has n_chars, that follows."""
    kept = fresh_name(df, "kept")
    cleaned = _with_kept(df, kept, min_sites, table_lines)
    text = F.array_join(kept, "\n")
    if "n_chars" in df.columns:
        shorter = F.size(kept) < F.size(_lines(F.col("text")))
        cleaned = cleaned.withColumn("n_chars", F.when(shorter, F.char_length(text).cast(df.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cleaned.withColumn("text", text).select(*df.columns)


def line_report(df: DataFrame, min_sites: int = MIN_SITES, table_lines: int = TABLE_LINES) -> DataFrame:
    """doc_id, text (cleaned), n_lines, n_removed of ``df(doc_id, source, text)``."""
    cleaned = _with_kept(df.select("doc_id", "source", "text"), "kept", min_sites, table_lines)
    lines = _lines(F.coalesce("text", F.lit("")))
    visible = F.size(F.filter(lines, lambda line: _bare(line) != ""))
    removed = F.when(F.col("kept").isNull(), 0).otherwise(F.size(lines) - F.size("kept"))
    return cleaned.select("doc_id", F.array_join("kept", "\n").alias("text"), visible.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))


def oracle_sql() -> str:
    """The same removal with exact counts throughout, for DuckDB."""
    return f"""
WITH l AS (
  SELECT doc_id, source, generate_subscripts(ls, 1) AS pos, unnest(ls) AS raw FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents)),
k AS (SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
b AS (
  SELECT line, min({{'d': doc_id, 'p': pos}}) AS first FROM k WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (
  SELECT k.*, line <> '' AS visible, b.line IS NOT NULL AND (doc_id <> b.first.d OR pos <> b.first.p) AS removed FROM k LEFT JOIN b USING (line)),
a AS (
  SELECT doc_id, CAST(count_if(visible) AS BIGINT) AS n_lines, CAST(count_if(removed) AS BIGINT) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT removed), '') AS kept FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CAST(strlen(coalesce(kept, '')) AS BIGINT) AS kept_bytes, md5(coalesce(kept, '')) AS kept_md5
FROM documents LEFT JOIN a USING (doc_id)"""
