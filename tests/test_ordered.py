"""Numbering and running values in ranges, interval joins, dedup-evaluation: hot keys, outliers, ties, nulls."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import lookup, ordered, relational, usage


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


class TestRanges:
    def test_outlier_does_not_crowd(self, spark):
        df = spark.range(100_000).select(F.when(F.col("id") == 7, 10**15).otherwise(F.col("id")).alias("x"))
        cuts = ordered.splitters(df, ["x"])
        sizes = [r["count"] for r in df.groupBy(ordered.range_of(df, ["x"], cuts).alias("r")).count().collect()]
        assert len(sizes) >= 60 and max(sizes) < 3 * 100_000 / 64

    def test_numbered(self, spark):
        rng = random.Random(1)
        rows = [(i, rng.choice([None, 0, 1, 5, 10**12]), rng.choice("ab")) for i in range(3000)]
        df = spark.createDataFrame(rows, "i long, x long, s string").repartition(5)
        got = ordered.numbered(df, ["x", "s", "i"], "place", ranges=8).collect()
        expected = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[0]))
        assert [(r.i, r.x, r.s) for r in sorted(got, key=lambda r: r.place)] == expected and sorted(r.place for r in got) == list(range(3000))

    def test_all_equal_and_empty(self, spark):
        df = spark.range(500).select(F.lit(1).alias("x"), "id")
        assert sorted(r.place for r in ordered.numbered(df, "x", "place", ranges=4).collect()) == list(range(500))
        assert ordered.numbered(df.filter("x > 1"), "x", "place").count() == 0

    def test_ranges_of_a_hot_key(self, spark):
        df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), F.xxhash64("id").alias("t"), "id")
        cuts = ordered.splitters(df, ["k", "t", "id"])
        hot = df.filter("k = -1").groupBy(ordered.range_of(df, ["k", "t", "id"], cuts).alias("r")).count().collect()
        assert len(hot) > 30 and max(r["count"] for r in hot) < 3 * 30_000 / 64


@pytest.fixture(scope="module")
def skewed(spark):
    """A key with most rows, keys with few, rows without key, ties in time, null values and times."""
    rng = random.Random(2)
    rows = [(i, None if rng.random() < 0.05 else "hot" if rng.random() < 0.6 else f"k{rng.randint(0, 40)}", None if rng.random() < 0.02 else rng.randint(0, 300), rng.choice([None, 1, 2, 7])) for i in range(2500)]
    return spark.createDataFrame(rows, "i long, k string, t long, v long").repartition(6).cache()


class TestScan:
    @pytest.mark.parametrize("ranges", [1, 3, 50])
    def test_equals_windows(self, skewed, ranges):
        w = Window.partitionBy("k").orderBy("t", "i")
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        expected = skewed.select("i", "k", "t", "v", F.sum("v").over(upto).alias("s"), F.last("v", True).over(upto).alias("l"), F.lag("v").over(w).alias("g"))
        got = ordered.scan(skewed, "k", ["t", "i"], sums={"s": F.col("v")}, lasts={"l": F.col("v")}, lags={"g": F.col("v")}, ranges=ranges)
        assert rows_of(got.select(*expected.columns)) == rows_of(expected)

    def test_empty(self, skewed):
        assert ordered.scan(skewed.filter("i < 0"), "k", ["t", "i"], sums={"s": F.col("v")}).count() == 0

    def test_audits_equal_windows(self, skewed):
        df = skewed.select("i", "k", F.timestamp_seconds("t").alias("ts"), "v")
        w = Window.partitionBy("k").orderBy(F.unix_micros("ts"))
        recent = df.withColumn("recent", F.count(F.lit(1)).over(w.rangeBetween(-30_000_000, 0)))
        assert rows_of(usage.rate_audit(df, "k", "ts", "i", 30).select("i", "k", "ts", "v", "recent")) == rows_of(recent)
        by_id = Window.partitionBy("k").orderBy(F.unix_micros("ts"), "i")
        gaps = df.withColumn("gap_s", (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(by_id)) / 1e6)
        assert rows_of(usage.spacing_audit(df, "k", "ts", "i").select("i", "k", "ts", "v", "gap_s")) == rows_of(gaps)
        deltas = df.withColumn("delta", F.greatest(F.lit(0), F.col("v") - F.lag("v", 1, 0).over(by_id)))
        assert rows_of(usage.usage_delta(df, "k", ["ts", "i"], "v").select("i", "k", "ts", "v", "delta")) == rows_of(deltas)

    def test_as_of_join_with_a_hot_key(self, spark):
        rng = random.Random(3)
        left = [(i, "hot" if i % 3 else f"k{i % 10}", rng.randint(0, 500)) for i in range(1500)]
        right = [("hot" if i % 2 else f"k{i % 10}", rng.randint(0, 500), i) for i in range(400)]
        got = relational.as_of_join(spark.createDataFrame(left, "i long, k string, t long"), spark.createDataFrame(right, "k string, u long, v long"), "k", "t", "u", "v", "i")
        for r in got.collect():
            known = [(u, v) for k, u, v in right if k == r.k and u <= r.t]
            assert r.v == (max(known)[1] if known else None)
        assert got.count() == 1500


class TestIntervals:
    def spans(self, rng, n):
        rows = []
        for i in range(n):
            low = rng.choice([0, rng.randint(-50, 50), rng.randint(-(10**9), 10**9)])
            rows.append((i, low, low + rng.choice([0, 1, 3, 64, 65, 1000, 10**6, 10**9, -5])))
        return [*rows, (n, None, 5), (n + 1, 5, None)]

    def test_overlaps(self, spark):
        rng = random.Random(4)
        a, b = self.spans(rng, 250), self.spans(rng, 250)
        left, right = spark.createDataFrame(a, "i long, a long, b long"), spark.createDataFrame(b, "j long, c long, d long")
        expected = sorted((i, j) for i, x, y in a for j, u, v in b if None not in (x, y, u, v) and x < y and u < v and x < v and u < y)
        for width in (1.0, 64.0, 1e9):
            got = relational.overlap_join(left, right, ("a", "b"), ("c", "d"), width).select("i", "j")
            assert sorted(map(tuple, got.collect())) == expected

    def test_copies_of_a_range_are_few(self, spark):
        spans = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") * 10).alias("a"), (F.col("id") * 10 + F.pow(10.0, F.col("id") % 10).cast("long")).alias("b"))
        sized = spans.withColumn("_l", relational._level(F.col("a"), F.col("b"), 1.0))
        cells = sized.select(F.size(F.sequence(relational._cell(F.col("a"), F.col("_l"), 1.0), relational._cell(F.col("b"), F.col("_l"), 1.0))).alias("n"))
        assert cells.agg(F.max("n")).first()[0] <= 3

    def test_points(self, spark):
        rng = random.Random(5)
        spans, points = self.spans(rng, 200), [(i, rng.choice([None, rng.randint(-60, 60), rng.randint(-(10**9), 10**9)])) for i in range(300)]
        expected = sorted((p, i) for p, x in points if x is not None for i, a, b in spans if a is not None and b is not None and a <= x < b)
        got = relational.range_join(spark.createDataFrame(points, "p long, x long"), spark.createDataFrame(spans, "i long, a long, b long"), F.col("x"), F.col("a"), F.col("b"), 8.0)
        assert sorted((r.p, r.i) for r in got.collect()) == expected
        assert relational.range_join(got.select("p", "x"), got.filter("false").select("i", "a", "b"), F.col("x"), F.col("a"), F.col("b"), 8.0).count() == 0


class TestDedupEval:
    def test_null_keys_ties_and_cache(self, spark):
        jobs = spark.createDataFrame([(1, None, "x"), (2, None, "y"), (3, "a", "z"), (4, "a", "z"), (5, "b", "w"), (5, "b", "w")], "n long, k string, payload string")
        cost = lambda df: df.select("k", F.concat(F.coalesce("k", F.lit("none")), F.col("payload")).alias("result"))
        got = sorted((r.n, r.k, r.payload, r.result, r.cache_hit, r.duplicate) for r in lookup.dedup_eval(jobs.fillna("", ["payload"]), "k", "n", cost).fillna("-", ["k"]).collect())
        assert got == [(1, "-", "x", "nonex", False, False), (2, "-", "y", "nonex", False, True), (3, "a", "z", "az", False, False), (4, "a", "z", "az", False, True)] + [(5, "b", "w", "bw", False, False)] * 2
        cache = spark.createDataFrame([(None, "cached"), ("gone", "old")], "k string, result string")
        got = {(r.n, r.result, r.cache_hit) for r in lookup.dedup_eval(jobs, "k", "n", cost, cache).collect()}
        assert got == {(1, "cached", True), (2, "cached", True), (3, "az", False), (4, "az", False), (5, "bw", False)}

    def test_evaluates_each_key_once(self, spark):
        jobs = spark.createDataFrame([(i, None if i % 3 == 0 else "hot" if i % 3 == 1 else f"k{i}") for i in range(300)], "n long, k string")
        seen = []
        lookup.dedup_eval(jobs, "k", "n", lambda df: seen.append(df.count()) or df.select("k", F.lit(1).alias("r"))).collect()
        assert seen == [102]


class TestBloom:
    def test_keeps_all_known_and_drops_most_others(self, spark):
        known = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("_key"))
        probes = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("_key"), "id")
        kept = [r.id for r in lookup.maybe_known(probes, known, "_key").collect()]
        assert set(range(5000)) <= set(kept) and len(kept) == len(set(kept)) < 5000 + 35_000 * 0.03
        assert lookup.maybe_known(probes, known, "_key", most_words=8).count() == 40_000
        assert lookup.maybe_known(probes, known.filter("false"), "_key").count() == 0

    def test_null_keys_do_not_harm(self, spark):
        rows = spark.createDataFrame([(1, None), (2, "a")], "id long, _key string")
        assert {r.id for r in lookup.maybe_known(rows, rows, "_key").collect()} >= {2}

    def test_same_matches(self, spark):
        left = spark.createDataFrame([(i, [f"x{i}", f"/x{i % 50}", None]) for i in range(300)], "id long, keys array<string>")
        right = spark.createDataFrame([(i, [f"/x{i}", f"x{i * 7}"]) for i in range(60)], "n long, keys array<string>")
        got = {r.id: r.match for r in lookup.candidate_join(left, right, "id", F.col("keys"), F.col("keys"), "n", F.col("n")).collect()}
        known = {}
        for i in range(60):
            for key in (f"/x{i}", f"x{i * 7}"):
                known[key] = max(known.get(key, -1), i)
        assert got == {i: known.get(f"x{i}", known.get(f"/x{i % 50}")) for i in range(300)}
