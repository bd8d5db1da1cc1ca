"""Sinks: JSON lines, CSV tables, and small JSON and HTML reports.

Data goes through Spark's writers. Reports are a few rows by construction
(metrics, classes, bins) and are written by the driver.
"""

from __future__ import annotations

import atexit
import html
import json
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share; on one machine a folder of our own if none is set."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(f"file://{own}")
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str = "written") -> DataFrame:
    """``df`` as a table in the shared folder: what was dear to get is not asked for again when an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, name: str = "dealt") -> DataFrame:
    """``df`` as a table in the shared folder, in buckets of ``key``: joins by it leave these rows where they are and move only the other side."""
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _file(spark: SparkSession, path: str):
    """The cluster's file system and a path on it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small document, wherever Spark can write."""
    fs, place = _file(spark, path)
    out = fs.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small document; None if there is none."""
    fs, place = _file(spark, path)
    if not fs.exists(place):
        return None
    # a document that was edited by hand on a local disk no longer fits the checksum beside it
    stream = (fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else fs).open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _file(spark, path)
    return fs.exists(place)


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it is not there."""
    fs, place = _file(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []


def replace_part(df: DataFrame, path: str, name: str) -> None:
    """``df`` as JSON files in the folder ``path`` whose names begin with ``name``, instead of those that do so far.

    They are written aside, in a folder that readers pass over, and moved in by renaming.
    """
    spark, aside = df.sparkSession, f"{path}/_{name}"
    df.write.mode("overwrite").json(aside)
    fs, folder = _file(spark, path)
    at = spark._jvm.org.apache.hadoop.fs.Path
    for old in fs.globStatus(at(folder, f"{name}-*")) or []:
        fs.delete(old.getPath(), False)
    for part in file_names(spark, aside):
        if part.startswith("part-"):
            fs.rename(at(f"{aside}/{part}"), at(folder, f"{name}-{part}"))
    fs.delete(at(aside), True)


def append_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object for each row; fields that are null are left out."""
    df.write.mode("append").option("ignoreNullFields", "true").json(path)


def rewrite_jsonl(df: DataFrame, path: str, dry_run: bool = False) -> str | None:
    """Replaces the JSONL folder ``path`` by ``df``, which may read it; returns the backup's place.

    The new rows are written beside it first, then both are renamed, so a failure
    leaves the old data.
    """
    if dry_run:
        return None
    fresh, backup = f"{path}.new", f"{path}.{int(time.time())}.bak"
    df.write.mode("overwrite").json(fresh)
    jvm = df.sparkSession._jvm
    old, new, kept = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh, backup))
    fs = old.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    if fs.exists(old):
        fs.rename(old, kept)
    fs.rename(new, old)
    return backup


def write_csv(df: DataFrame, path: str) -> None:
    """Columns sorted by name under a header; nulls are blank."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("header", "true").csv(path)


def write_tokens_csv(outputs: DataFrame, path: str) -> None:
    usage = F.col("token_usage")
    zero = lambda c: F.coalesce(usage[c], F.lit(0))
    total = F.coalesce(F.nullif(usage["total"], F.lit(0)), zero("prompt") + zero("completion"))
    rows = outputs.select("sample_index", "image_path", "headline", zero("prompt").alias("prompt_tokens"), zero("completion").alias("completion_tokens"), total.alias("total_tokens"))
    rows.write.mode("overwrite").option("header", "true").csv(path)


def report_dict(tables: dict[str, DataFrame]) -> dict[str, list[dict]]:
    """Metric tables of a few rows each, as plain values."""
    return {name: [row.asDict(recursive=True) for row in df.toLocalIterator()] for name, df in tables.items()}


def write_json_report(tables: dict[str, DataFrame], path: str) -> None:
    if tables:
        write_text(next(iter(tables.values())).sparkSession, path, json.dumps(report_dict(tables), ensure_ascii=False, indent=2, default=str))


def write_html_report(tables: dict[str, DataFrame], path: str, title: str) -> None:
    """A plain page with one table for each metrics table."""
    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, rows in report_dict(tables).items():
        head = list(rows[0]) if rows else []
        body = "".join("<tr>" + "".join(cell("td", r[c]) for c in head) + "</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(cell('th', c) for c in head)}</tr>{body}</table>")
    if tables:
        write_text(next(iter(tables.values())).sparkSession, path, "\n".join(parts))


def write_metadata(path: str, status: str, **fields) -> None:
    """The run's sidecar, rewritten at each change of status."""
    spark = SparkSession.active()
    known = json.loads(read_text(spark, path) or "{}")
    write_text(spark, path, json.dumps(known | fields | {"status": status}, ensure_ascii=False, indent=2, default=str))


def snapshot(values: dict, drop: frozenset[str] = frozenset()) -> dict:
    """Settings as plain JSON values: paths become text, tuples lists, at any depth; keys in ``drop`` go."""

    def plain(value):
        if isinstance(value, dict):
            return {k: plain(v) for k, v in value.items()}
        if isinstance(value, (list, tuple)):
            return [plain(v) for v in value]
        return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)

    return {k: plain(v) for k, v in values.items() if k not in drop}


# ---- figures and the report of single samples ---------------------------------


def _svg(width: int, height: int, parts: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" font-family="sans-serif" font-size="11">{"".join(parts)}</svg>'


def curve_svg(points: list[tuple[float, float]], title: str, diagonal: bool = False) -> str:
    """Points in the unit square as a line, such as a ROC or precision-recall curve, or bins of a calibration."""
    at = lambda x, y: f"{30 + 240 * x:.1f},{20 + 240 * (1 - y):.1f}"
    parts = ['<rect x="30" y="20" width="240" height="240" fill="none" stroke="#888"/>', f'<text x="30" y="14">{html.escape(title)}</text>']
    if diagonal:
        parts.append(f'<polyline points="{at(0, 0)} {at(1, 1)}" stroke="#aaa" fill="none" stroke-dasharray="4"/>')
    parts.append(f'<polyline points="{" ".join(at(x, y) for x, y in points)}" stroke="#246" fill="none"/>')
    return _svg(300, 280, parts)


def matrix_svg(tp: int, fp: int, fn: int, tn: int) -> str:
    """A confusion matrix with cells shaded by their share."""
    most = max(tp, fp, fn, tn, 1)
    cells = [(0, 0, "true positive", tp), (1, 0, "false negative", fn), (0, 1, "false positive", fp), (1, 1, "true negative", tn)]
    parts = []
    for x, y, name, n in cells:
        parts.append(f'<rect x="{100 * x}" y="{60 * y}" width="98" height="58" fill="rgb({255 - 120 * n // most},{255 - 60 * n // most},255)"/>')
        parts.append(f'<text x="{100 * x + 8}" y="{60 * y + 25}">{name}</text><text x="{100 * x + 8}" y="{60 * y + 45}">{n}</text>')
    return _svg(200, 120, parts)


def svg_url(svg: str) -> str:
    """An SVG as the value of an image's source."""
    import base64

    return "data:image/svg+xml;base64," + base64.b64encode(svg.encode()).decode()


def sample_rows(outputs: DataFrame, report_folder: str) -> DataFrame:
    """(sample_index, html): one table row for each output, with the image as seen from the report's folder, signals and judgement."""
    from quillon.functions.text import html_escape, path_from

    shown = lambda c: html_escape(F.coalesce(c.cast("string"), F.lit("")))
    image = F.when(F.col("image_path").startswith("/"), path_from(F.lit(report_folder), F.col("image_path"))).otherwise(F.coalesce("image_path", F.lit("")))
    pairs = F.transform(F.coalesce("best_qa_per_chain", F.array()), lambda q: F.concat(F.lit("<li>"), shown(q["question"]), F.lit(": "), shown(q["answer"]), F.lit("</li>")))
    cells = [
        shown(F.col("sample_index")), F.concat(F.lit('<img width="120" src="'), shown(image), F.lit('">')), shown(F.col("headline")), shown(F.col("judgement.label")), shown(F.col("judgement.confidence")),
        shown(F.col("relevancy.aligned")), shown(F.col("visual_veracity.ai_generated")), F.concat(F.lit("<ul>"), F.array_join(pairs, ""), F.lit("</ul>")),
    ]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    return outputs.select("sample_index", row.alias("html"))


def write_sample_report(outputs: DataFrame, path: str, title: str) -> None:
    """The report of a run, sample by sample; rows come to the driver one by one."""
    folder = path.rsplit("/", 1)[0] if "/" in path else "/"
    names = "sample image headline label confidence aligned generated questions".split()
    rows = [r.html for r in sample_rows(outputs, folder).orderBy(F.coalesce("sample_index", F.lit(0))).toLocalIterator()]
    head = f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{''.join(f'<th>{n}</th>' for n in names)}</tr>"
    write_text(outputs.sparkSession, path, head + "\n".join(rows) + "</table>")
