"""Streams with state: results kept by key over starts, and results taken in by index."""

import random
import time

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillon.streaming import resume, stateful

RESULT = StructType([StructField("value", StringType()), StructField("cost", LongType())])


@pytest.fixture
def calls(tmp_path):
    """A function to evaluate keys with, which notes each call in a file."""
    log = tmp_path / "calls"
    log.write_text("")

    def evaluate(key, path=str(log)):
        with open(path, "a") as f:
            f.write(f"{key}\n")
        return (str(key).upper(), len(str(key)))

    return evaluate, lambda: sorted(log.read_text().split())


def start(spark, tmp_path, evaluate, ttl_ms=None):
    stream = spark.readStream.schema("n long, key string").json(str(tmp_path / "in"))
    stateful.run_to_end(stateful.cached_evaluation(stream, "key", "n", evaluate, RESULT, ttl_ms), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    return sorted((r.n, r.key, r.value, r.cost, r.cache_hit, r.duplicate) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def add(spark, tmp_path, rows):
    spark.createDataFrame(rows, "n long, key string").coalesce(1).write.mode("append").option("ignoreNullFields", "false").json(str(tmp_path / "in"))


def test_keys_are_evaluated_once_over_starts(spark, tmp_path, calls):
    evaluate, asked = calls
    add(spark, tmp_path, [(2, "a"), (1, "a"), (3, "b"), (4, None)])
    assert start(spark, tmp_path, evaluate) == [(1, "a", "A", 1, False, False), (2, "a", "A", 1, False, True), (3, "b", "B", 1, False, False), (4, None, "NONE", 4, False, False)]
    add(spark, tmp_path, [(5, "a"), (6, "c"), (7, "a"), (8, None)])
    assert start(spark, tmp_path, evaluate)[4:] == [(5, "a", "A", 1, True, False), (6, "c", "C", 1, False, False), (7, "a", "A", 1, True, False), (8, None, "NONE", 4, True, False)]
    assert asked() == ["None", "a", "b", "c"]


def test_results_expire(spark, tmp_path, calls):
    evaluate, asked = calls
    add(spark, tmp_path, [(1, "a")])
    start(spark, tmp_path, evaluate, 1000)
    time.sleep(1.5)
    add(spark, tmp_path, [(2, "a")])
    assert start(spark, tmp_path, evaluate, 1000)[1] == (2, "a", "A", 1, False, False) and asked() == ["a", "a"]


SCHEMA = "run string, sample_index long, error string, payload string"


def drain(spark, tmp_path, rows, wait_ms=None):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    stateful.run_to_end(stateful.drained_stream(stream, "run", wait_ms=wait_ms), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=lambda r: r[:2])


def test_out_of_order_results_come_out_in_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(run, i, "failed" if i % 4 == 1 else None, f"p{i}") for run in "ab" for i in range(12)]
    rng.shuffle(rows)
    seen = 0
    for at in range(0, 24, 8):
        out = drain(spark, tmp_path, rows[at : at + 8])
        came = {(r[0], r[1]) for r in rows[: at + 8]}
        gapless = [(run, i) for run in "ab" for i in range(12) if all((run, k) in came for k in range(i + 1))]
        assert [r[:2] for r in out] == gapless and len(out) >= seen
        seen = len(out)
    batch = [r for run in "ab" for r in resume.drained(spark.createDataFrame([r for r in rows if r[0] == run], SCHEMA)).collect()]
    assert out == sorted(map(tuple, batch), key=lambda r: r[:2]) and len(out) == 24
    assert drain(spark, tmp_path, rows[:3]) == out  # what comes again counts once


def test_a_row_that_never_comes_counts_as_missing(spark, tmp_path):
    assert drain(spark, tmp_path, [("a", 0, None, "x"), ("a", 2, None, "z")], 500) == [("a", 0, None, "x", 1, True)]
    time.sleep(1)
    out = drain(spark, tmp_path, [("b", 0, None, "y")], 500)
    assert out == [("a", 0, None, "x", 1, True), ("a", 1, "missing", None, 2, False), ("a", 2, None, "z", 3, True), ("b", 0, None, "y", 1, True)]


def test_columns_are_checked(spark):
    with pytest.raises(ValueError, match="error"):
        stateful.drained_stream(spark.createDataFrame([], "run string, sample_index long"), "run")
