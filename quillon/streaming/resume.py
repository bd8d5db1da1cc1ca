"""Resumable, append-only processing with Structured Streaming.

A run is a file-source stream into JSON files with one checkpoint folder. Each
start takes what is new (availableNow) in micro-batches of a bounded number of
files. A batch's output bears its number: a batch that is repeated after a failure
replaces what it wrote, so a restart neither loses nor repeats rows. After its
output a batch notes its rows in and out, and both totals, in a manifest of its
own; progress and status follow from the manifests, and old output is not read.
A small JSON document beside them guards identity and settings.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable
from datetime import UTC, datetime
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillon.sources import sinks

#: Statuses that a run goes through.
STATUSES = ("initializing", "resuming", "ready", "running", "completed", "up_to_date", "no_samples", "no_samples_processed")


class Progress(NamedTuple):
    """Rows that one start read and wrote, and those of all starts so far."""

    read: int
    written: int
    all_read: int
    all_written: int


class RunState:
    """The run's JSON document, on the cluster's file system: identity, fingerprint of the settings, progress and status."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.data: dict = json.loads(sinks.read_text(spark, path) or "{}")

    def open(self, run_id: str, fingerprint: str, sink: str, chunk_size: int) -> int:
        """The chunk size to use: that of the first start. Raises ValueError if another run, other settings or another sink wrote the document."""
        for key, value in (("run_id", run_id), ("args_fingerprint", fingerprint), ("jsonl_path", sink)):
            if key in self.data and self.data[key] != value:
                raise ValueError(f"checkpoint {key} {self.data[key]!r} does not match {value!r}")
        status, size = "resuming" if self.data else "initializing", int(self.data.get("chunk_size") or max(1, chunk_size))
        self.save(status, run_id=run_id, args_fingerprint=fingerprint, jsonl_path=sink, chunk_size=size)
        return size

    def reconcile(self, rows: int) -> int:
        """The number of rows done, given how many the sink holds: more than noted count, fewer are only warned of."""
        noted = int(self.data.get("processed_count") or 0)
        if rows < noted:
            warnings.warn(f"the checkpoint notes {noted} rows, the output holds {rows}", stacklevel=2)
        self.data["processed_count"] = max(noted, rows)
        return self.data["processed_count"]

    def save(self, status: str, **fields) -> None:
        if status not in STATUSES:
            raise ValueError(f"unknown status {status!r}")
        now = datetime.now(UTC).isoformat()
        self.data = {"created_at": now} | self.data | fields | {"status": status, "updated_at": now}
        sinks.write_text(self.spark, self.path, json.dumps(self.data, indent=2))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """A run's document as a row of schemas.CHECKPOINT."""
    from quillon.sources.schemas import CHECKPOINT

    return spark.read.schema(CHECKPOINT).option("multiLine", "true").json(path)


def _manifest(checkpoint: str, batch: int) -> str:
    return f"{checkpoint}.batches/{batch:012d}.json"


def totals(spark: SparkSession, checkpoint: str, upto: int | None = None) -> tuple[int, int]:
    """Rows read and written by all batches, or by those up to ``upto``; each manifest has the totals so far, so one is read."""
    if upto is None:
        names = sinks.file_names(spark, f"{checkpoint}.batches")
        upto = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=-1)
    known = json.loads(sinks.read_text(spark, _manifest(checkpoint, upto)) or "{}") if upto >= 0 else {}
    return known.get("all_read", 0), known.get("all_written", 0)


def _observed(seen: Observation, rows: DataFrame) -> int:
    """The number of rows that were seen; counted anew where the optimiser dropped them with what looked at them."""
    try:
        return seen.get["rows"]
    except Py4JJavaError:
        return rows.count()


def process_new(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int = 100, fmt: str = "json", glob: str = "*") -> Progress:
    """Runs ``transform`` over files of the folder ``source`` that no earlier start has seen.

    ``transform`` gets a micro-batch as a table. Its rows become JSON files in the
    folder ``sink``, named after the batch.
    """
    own: dict[int, tuple[int, int]] = {}

    def take(batch: DataFrame, number: int) -> None:
        here = batch.sparkSession
        read, written = Observation(), Observation()
        rows = transform(batch.observe(read, F.count(F.lit(1)).alias("rows"))).observe(written, F.count(F.lit(1)).alias("rows"))
        sinks.replace_part(rows, sink, f"batch-{number:012d}")
        n = (_observed(read, batch), _observed(written, rows))
        before = totals(here, checkpoint, number - 1)
        sinks.write_text(here, _manifest(checkpoint, number), json.dumps({"batch": number, "read": n[0], "written": n[1], "all_read": before[0] + n[0], "all_written": before[1] + n[1]}))
        own[number] = n

    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).load(source)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return Progress(sum(n for n, _ in own.values()), sum(n for _, n in own.values()), *totals(spark, checkpoint))


def sink_rows(spark: SparkSession, sink: str) -> int:
    """How many rows an output folder holds; 0 if it is not there yet."""
    return spark.read.text(sink).count() if sinks.exists(spark, sink) else 0


def run(spark: SparkSession, run_id: str, fingerprint: str, source: str, schema: str, transform, sink: str, folder: str, files_per_batch: int = 100, **options) -> str:
    """One start of a run; returns its status.

    The document notes the samples that were taken in, ``processed_count`` and
    ``next_index``, and apart from them the rows that came out, ``written_count``.
    """
    state, checkpoint = RunState(spark, f"{folder}/{run_id}.json"), f"{folder}/{run_id}.checkpoint"
    size = state.open(run_id, fingerprint, sink, files_per_batch)
    note = lambda status, read, written: state.save(status, processed_count=read, next_index=read, written_count=written)
    before = totals(spark, checkpoint)
    note("ready", *before)
    note("running", *before)
    done = process_new(spark, source, schema, transform, sink, checkpoint, files_per_batch=size, **options)
    status = "completed" if done.written else "no_samples_processed" if done.read else "up_to_date" if done.all_read else "no_samples"
    note(status, done.all_read, done.all_written)
    return status


def resume_point(outputs: DataFrame, samples: DataFrame) -> DataFrame:
    """One row (done, next_index, sequential, same_last) of a run's ``outputs(sample_index, image_path, headline)`` against its samples.

    A run goes on behind its outputs only if these count 1, 2, 3 ... without gap
    and the last one is that sample of the source.
    """
    last = outputs.agg(F.count(F.lit(1)).alias("done"), F.count_distinct("sample_index").alias("_d"), F.min("sample_index").alias("_a"), F.max("sample_index").alias("_b"), F.max_by(F.struct("image_path", "headline"), "sample_index").alias("_last"))
    source = samples.select(F.col("sample_index").alias("_i"), F.struct("image_path", "headline").alias("_source"))
    met = last.join(source, F.col("_b") == F.col("_i"), "left")
    sequential = (F.col("done") == 0) | ((F.col("_a") == 1) & (F.col("_b") == F.col("done")) & (F.col("_d") == F.col("done")))
    return met.select("done", F.col("done").alias("next_index"), sequential.alias("sequential"), ((F.col("done") == 0) | F.coalesce(F.col("_last").eqNullSafe(F.col("_source")) & F.col("_i").isNotNull(), F.lit(False))).alias("same_last"))


def check_resume(outputs: DataFrame, samples: DataFrame) -> int:
    """The number of samples that are done; raises ValueError where the outputs are not those of the samples."""
    point = resume_point(outputs, samples).first()
    if not point.sequential:
        raise ValueError("outputs are not sequential")
    if not point.same_last:
        raise ValueError("the last output is not the sample at its place")
    return point.done


def drained(results: DataFrame, start: int = 0) -> DataFrame:
    """``results(sample_index, error, ...)`` as they are taken in: in order, a failed one counts but gives no output.

    Adds ``processed``, the counter after the row, and ``emitted``.
    """
    from quillon.operators.ordered import numbered

    placed = numbered(results, "sample_index", "_place")
    return placed.withColumn("processed", F.col("_place") + start + 1).withColumn("emitted", F.col("error").isNull()).drop("_place")


def joined_streams(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str, late: str | None = None) -> DataFrame:
    """Rows of two streams (or tables) with one key whose right time is up to ``within`` after the left one; ``late`` bounds the state."""
    if late:
        left, right = left.withWatermark(left_ts, late), right.withWatermark(right_ts, late)
    right = right.withColumnRenamed(key, "_key")
    near = (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"INTERVAL {within}"))
    return left.join(right, (F.col(key) == F.col("_key")) & near).drop("_key")


def windowed_counts(events: DataFrame, ts: str, key: str, window: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts by event-time window and key, on a stream or a table; ``late`` is how late a stream's rows may come."""
    if late:
        events = events.withWatermark(ts, late)
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    counts = events.groupBy(span.alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), key, "n")


def session_counts(events: DataFrame, ts: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of a key: rows at most ``gap`` apart."""
    if late:
        events = events.withWatermark(ts, late)
    sessions = events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return sessions.select(F.col("w.start").alias("session_start"), key, "n")
