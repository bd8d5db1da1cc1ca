"""Operators against brute force, and properties of samples."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.operators import curves, lookup, qa, relational, sampling, usage


class TestCurves:
    def test_areas_against_all_pairs(self, spark):
        rng = random.Random(1)
        rows = [(run, round(rng.random() ** (1.5 - t * 0.7), 2), t) for run in ("a", "b") for t in [rng.randint(0, 1) for _ in range(300)]]
        got = {r.run: r for r in curves.areas(spark.createDataFrame(rows, "run string, score double, truth int")).collect()}
        for run in "ab":
            pos, neg = [[s for r, s, t in rows if r == run and t == k] for k in (1, 0)]
            auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
            ap, hit, seen = 0.0, 0, 0
            for s in sorted({s for r, s, _ in rows if r == run}, reverse=True):
                here, new = pos.count(s), pos.count(s) + neg.count(s)
                hit, seen = hit + here, seen + new
                ap += here / len(pos) * hit / seen
            assert got[run].auroc == pytest.approx(auc, abs=1e-6) and got[run].pr_auc == pytest.approx(ap, abs=1e-6)

    def test_one_class_or_one_score(self, spark):
        rows = [("only_pos", 0.2, 1), ("only_pos", 0.7, 1), ("flat", 0.5, 1), ("flat", 0.5, 0), ("only_neg", 0.1, 0)]
        got = {r.run: (r.auroc, r.pr_auc, r.balanced_accuracy) for r in curves.areas(spark.createDataFrame(rows, "run string, score double, truth int")).collect()}
        assert got == {"only_pos": (0.5, 1.0, 0.5), "flat": (0.5, 0.5, 0.5), "only_neg": (0.5, 0.0, 1.0)}


class TestSampling:
    def test_prefixes_mirror_the_mix(self, spark):
        rows = [(i, "a" if i % 10 < 6 else "b" if i % 10 < 9 else None) for i in range(1000)]
        df = sampling.stratified_order(spark.createDataFrame(rows, "i long, c string"), ["c"], 5, "i")
        order = [r.c for r in df.orderBy("order_score", "i").collect()]
        for n in (50, 100, 500):
            mix = Counter(order[:n])
            assert all(abs(mix[c] - share * n) <= 2 for c, share in (("a", 0.6), ("b", 0.3), (None, 0.1)))

    def test_undersample(self, spark):
        df = spark.createDataFrame([(i, "x" if i < 90 else "y") for i in range(100)], "i long, c string")
        assert Counter(r.c for r in sampling.undersample(df, "c", 1, "i").collect()) == {"x": 10, "y": 10}
        assert sampling.undersample(df.filter("c = 'x'"), "c", 1, "i").count() == 90

    def test_budget(self, spark):
        df = spark.createDataFrame([(i, "xyz"[i % 3]) for i in range(30)], "i long, c string")
        assert Counter(r.c for r in sampling.balanced_budget(df, "c", ["x", "y"], 1, "i", 8).collect()) == {"x": 4, "y": 4}
        assert sampling.balanced_budget(df, "c", ["x", "y", "z"], 1, "i").count() == 30
        for classes, total in ((["x", "q"], 4), (["x", "y"], 5), (["x", "y"], 0)):
            with pytest.raises(ValueError):
                sampling.balanced_budget(df, "c", classes, 1, "i", total)

    def test_order_depends_on_the_seed_alone(self, spark):
        df = spark.createDataFrame([(i,) for i in range(50)], "i long")
        order = lambda d, seed: [r.i for r in sampling.shuffled(d, seed, "i").orderBy("shuffle_key", "i").collect()]
        assert order(df, 1) == order(df.repartition(5), 1) != order(df, 2)


class TestLookup:
    def test_last_record_and_first_spelling_win(self, spark):
        left = spark.createDataFrame([(1, ["p", "q"]), (2, ["z"]), (3, ["q", "p"])], "id long, keys array<string>")
        right = spark.createDataFrame([(1, ["p"], "old"), (2, ["p"], "new"), (3, ["q"], "other")], "n long, ks array<string>, v string")
        got = lookup.candidate_join(left, right, "id", F.col("keys"), F.col("ks"), "n", F.col("v"))
        assert {r.id: r.match for r in got.collect()} == {1: "new", 2: None, 3: "other"}

    def test_cascade(self, spark):
        records = spark.createDataFrame([(0, "/a", "h0"), (1, "/b", "h1"), (2, "/b", "h1"), (3, None, "h3 ")], "idx long, path string, headline string")
        outputs = spark.createDataFrame(
            [(1, 0, None, "/a", "x"), (2, 0, 1, "/z", "h1"), (3, None, None, "/b", "?"), (4, None, None, "", "h1"), (5, 9, None, None, " h3"), (6, None, None, None, None)],
            "n long, order_index long, details_index long, path string, headline string",
        )
        got = lookup.cascade_join(outputs, records, [("order_index", "order"), ("details_index", "details")])
        assert {r.n: (r.match_index, r.match_source) for r in got.collect()} == {1: (0, "order"), 2: (1, "details"), 3: (1, "image_path"), 4: (1, "headline*"), 5: (3, "headline"), 6: (None, None)}
        assert tuple(lookup.repair_stats(got).first()) == (6, 5, 1)

    def test_dedup_eval_calls_once_for_each_key(self, spark):
        jobs = spark.createDataFrame([(i, "k%d" % (i % 3)) for i in range(9)], "n long, key string")
        asked = []

        def evaluate(df):
            asked.append(df.count())
            return df.select("key", F.upper("key").alias("value"))

        cache = spark.createDataFrame([("k0", "cached")], "key string, value string")
        rows = lookup.dedup_eval(jobs, "key", "n", evaluate, cache).collect()
        assert asked == [2] and len(rows) == 9
        assert {r.value for r in rows if r.key == "k0"} == {"cached"} and sum(r.duplicate for r in rows) == 6

    def test_details_win(self, spark):
        row = spark.range(1).select(lookup.merge_details(F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("kept")), F.create_map(F.lit("a"), F.lit("new"))).alias("m")).first()
        assert row.m == {"a": "new", "b": "kept"}


class TestChains:
    def test_dedup_and_best(self, spark):
        rows = [("s", 0, " Why? ", 0.2), ("s", 1, "why?", 0.9), ("s", 2, "Who?", 0.9), ("s", 3, "", None), ("s", 4, "When?", None)]
        df = spark.createDataFrame(rows, "g string, n int, question string, confidence double")
        prior = spark.createDataFrame([("s", "WHEN?")], "g string, question string")
        assert sorted(r.n for r in qa.dedup_questions(df, "g", ["n"], prior=prior).collect()) == [0, 2]
        assert qa.best_answer(df, ["g"], "n").first().n == 1


class TestUsage:
    def test_delta_and_total(self, spark):
        df = spark.createDataFrame([("w", 1, 5), ("w", 2, 9), ("w", 3, 2)], "w string, n int, c long")
        assert [r.delta for r in usage.usage_delta(df, "w", ["n"], "c").orderBy("n").collect()] == [5, 4, 0]
        rows = spark.createDataFrame([(3, 2, 0), (None, 4, None), (1, 1, 7)], "prompt long, completion long, total long")
        assert tuple(usage.token_totals(rows).first()) == (4, 7, 16)


class TestRelational:
    def test_as_of(self, spark):
        left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3)], "k string, t long")
        right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 9, "z")], "k string, u long, v string")
        got = relational.as_of_join(left, right, "k", "t", "u", "v")
        assert {(r.k, r.t): r.v for r in got.collect()} == {("a", 5): "y", ("a", 1): None, ("b", 3): None}


class TestSketches:
    def test_areas_lie_within_the_bound(self, spark):
        rng = random.Random(9)
        rows = [(f"r{i % 3}", min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * t, 0.2))), t) for i in range(4000) for t in [rng.random() < 0.4]]
        rows += [("r0", None, True), ("r1", 0.5, None), ("one class", 0.3, True)]
        df = spark.createDataFrame(rows, "run string, score double, truth boolean")
        exact = {r.run: r for r in curves.areas(df.filter("score IS NOT NULL AND truth IS NOT NULL")).collect()}
        for bins in (10, 1000):
            parts = [curves.score_sketch(df.filter(F.pmod(F.xxhash64("score"), F.lit(3)) == i), bins) for i in range(3)]
            found = {r.run: r for r in curves.sketch_areas(parts[0].unionByName(parts[1]).unionByName(parts[2]), bins).collect()}
            for run in ("r0", "r1", "r2"):
                assert abs(found[run].auroc - exact[run].auroc) <= found[run].auroc_error + 1e-6
                assert abs(found[run].balanced_accuracy - exact[run].balanced_accuracy) < 1e-6 and found[run].n == exact[run].n
            assert (found["one class"].auroc, found["one class"].balanced_accuracy) == (0.5, None)
        assert found["r0"].auroc_error < 0.002
