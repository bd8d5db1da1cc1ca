"""Outlier rules, line spread, SimHash, suffix dedup, and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm import common, components, jaccard_dedup, line_spread, mixing, queries, robust_outliers, simhash, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


class TestRobustOutliers:
    def test_base_statistics(self, documents, awkward):
        rng = random.Random(1)
        rows = [(i, "\n".join(rng.choice(["a b c", " ", "# x $y", prose(rng, 12), "same line again here it is now ok"]) for _ in range(rng.randint(0, 12))), "a") for i in range(150)]
        for df in (documents(rows), awkward):
            texts = {(r.doc_id, r.source): r.text or "" for r in df.collect()}
            for r in robust_outliers.statistics(df).collect():
                text = texts[r.doc_id, r.source]
                w = WORD.findall(text)
                windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
                covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
                lines = [x for x in text.split("\n") if WORD.search(x)]
                expected = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
                assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
                assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))

    def test_mcd_against_numpy(self, documents):
        rng = random.Random(2)
        rows = [(i, prose(rng, rng.randint(30, 200)), "a" if i % 3 else "b") for i in range(400)]
        rows += [(1000 + i, " ".join(x + "###" for x in prose(rng, 60).split()), "a") for i in range(40)]
        stats = robust_outliers.statistics(documents(rows))
        got = {r.doc_id: r for r in robust_outliers.judge_statistics(stats).collect()}
        g, floors = robust_outliers.GRAIN, np.diag((np.array(robust_outliers.FLOORS) * robust_outliers.GRAIN) ** 2)
        for source in "ab":
            mine = [r for r in got.values() if r.source == source]
            x = np.array([[round(g * np.log(r.word_chars / r.n_words)), round(g * np.log1p(10 * r.n_symbols / r.n_words)), round(g * r.n_repeat_words / r.n_words), round(g * np.log1p(r.n_dup_lines))] for r in mine])
            fit = x[[not r.base_failed for r in mine]]
            starts = [(np.array([np.sort(c)[(len(c) - 1) // q] for c in fit.T]), np.zeros((4, 4))) for q in (2, 4)] + [(fit.mean(axis=0), np.cov(fit.T, bias=True))]
            distance = lambda rows, mean, cov: np.einsum("ij,jk,ik->i", rows - mean, np.linalg.inv(cov + floors), rows - mean)

            def steps(mean, cov, n, fit=fit, distance=distance):
                for _ in range(n):
                    bins = np.floor(np.log1p(distance(fit, mean, cov)) * robust_outliers.BIN_GRAIN)
                    core = fit[bins <= np.sort(bins)[int(np.ceil(robust_outliers.CORE * len(fit))) - 1]]
                    mean, cov = core.mean(axis=0), np.cov(core.T, bias=True)
                return mean, cov

            tried = [steps(mean, cov, robust_outliers.FIRST_STEPS) for mean, cov in starts]
            mean, cov = min(tried, key=lambda e: np.linalg.det(e[1] + floors))
            mean, cov = steps(mean, cov, robust_outliers.MAX_STEPS - robust_outliers.FIRST_STEPS)
            cov = cov * robust_outliers.CONSISTENCY
            d2 = distance(x, mean, cov)
            assert np.allclose(d2, [r.d2 for r in mine], rtol=1e-6)
        assert not any(got[1000 + i].kept for i in range(40))
        assert np.mean([got[i].kept for i in range(400)]) > 0.97

    def test_awkward(self, awkward, nothing):
        rows = robust_outliers.judge(awkward).collect()
        assert len(rows) == 9 and not any(r.kept for r in rows if r.doc_id in (1, 2, 3, 4))
        assert robust_outliers.judge(nothing).count() == 0
        assert robust_outliers.keep_inliers(awkward).columns == awkward.columns


class TestLineSpread:
    @pytest.mark.parametrize("table_lines", [20_000, 3])
    def test_against_exact_counts(self, documents, table_lines):
        rng = random.Random(3)
        shared = [f"shared line {i}" for i in range(25)]
        rows = [(d, "\n".join([prose(rng, 5)] + rng.sample(shared[: 1 + d % 25], 1 + d % 2 if d % 25 else 1)), f"s{rng.randint(0, d % 12)}") for d in range(400)]
        sites, first = {}, {}
        for d, t, s in sorted(rows):
            for i, line in enumerate(t.split("\n")):
                sites.setdefault(line, set()).add(s)
                first.setdefault(line, (d, i))
        cut = lambda d, t: "\n".join(x for i, x in enumerate(t.split("\n")) if len(sites[x]) < line_spread.MIN_SITES or first[x] == (d, i))
        out = line_spread.remove_boilerplate(documents(rows), table_lines=table_lines)
        assert ("Join" in out._jdf.queryExecution().executedPlan().toString()) == (table_lines == 3)  # no text is shuffled
        got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
        assert got == {d: (cut(d, t), len(cut(d, t))) for d, t, _ in rows}
        assert any(got[d][0] != t for d, t, _ in rows)

    @pytest.mark.parametrize("table_lines", [20_000, 0])
    def test_one_id_with_different_texts(self, documents, table_lines):
        """A line's place is its own: the rows of one doc_id do not lose each other's lines."""
        rows = [(1, "a\nb", "s0")] * 3 + [(1, "b\nx", "s1"), (1, None, "s1"), (1, " \n b", "s2")] + [(10 + i, f"b\nown {i}", f"s{i}") for i in range(14)]
        got = Counter((r.doc_id, r.text) for r in line_spread.remove_boilerplate(documents(rows), table_lines=table_lines).collect())
        assert got == Counter([(1, "a")] * 3 + [(1, "b\nx"), (1, None), (1, " ")] + [(10 + i, f"own {i}") for i in range(14)])
        report = Counter((r.doc_id, r.n_lines, r.n_removed) for r in line_spread.line_report(documents(rows), table_lines=table_lines).collect())
        assert report == Counter([(1, 2, 1)] * 3 + [(1, 2, 0), (1, 0, 0), (1, 1, 1)] + [(10 + i, 2, 1) for i in range(14)])

    def test_awkward(self, documents, awkward, nothing):
        out = line_spread.remove_boilerplate(awkward)
        assert out.columns == awkward.columns
        assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((r.doc_id, r.text) for r in awkward.collect())
        assert line_spread.remove_boilerplate(nothing).count() == 0 and line_spread.line_report(nothing).count() == 0
        copies = documents([(i, "the very same line", f"s{i}") for i in range(20)])
        report = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_spread.line_report(copies).collect()}
        assert report[0] == ("the very same line", 1, 0) and report[7] == ("", 1, 1)

    def test_null_doc_id_is_no_first_place(self, documents):
        rows = [(i, f"the header\nown {i}", f"s{i}") for i in range(20)] + [(None, "the header\nno id", "s3")]
        got = {r.doc_id: r.text for r in line_spread.remove_boilerplate(documents(rows)).collect()}
        assert got == {0: "the header\nown 0", None: "the header\nno id"} | {i: f"own {i}" for i in range(1, 20)}


def simhash_brute(text, k=4):
    w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in WORD.findall(text or "")]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


class TestSimHash:
    def test_fingerprint(self, awkward):
        for text in [r.text for r in awkward.collect()] + ["A B c", "a b c d e f g", "ÀB ß"]:
            assert simhash.fingerprint((text or "").encode()) == [simhash_brute(text)]
            assert simhash.fingerprint((text or "").encode(), prints=3)[0] == simhash_brute(text)

    @pytest.mark.parametrize("list_limit", [8192, 3])
    def test_components_against_all_pairs(self, spark, list_limit):
        rng = random.Random(4)
        fps = []
        for _ in range(30):
            base = rng.getrandbits(64)
            fps += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(rng.choice([1, 2, 12]))]
        fps += [fps[0]] * 5
        rng.shuffle(fps)
        root = list(range(len(fps)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        signed = [f - (1 << 64) if f >> 63 else f for f in fps]
        df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
        named = {r.fp: r.component_id for r in simhash.link_components(df, list_limit=list_limit).collect()}
        assert [named[f] for f in signed] == [find(i) for i in range(len(fps))]

    def test_awkward(self, awkward, nothing):
        rows = simhash.near_duplicates(awkward).collect()
        assert len(rows) == 9 and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
        assert {r.component_id for r in rows if r.doc_id in (4, 6)} == {4}
        assert simhash.near_duplicates(nothing).count() == 0
        kept = simhash.keep_one(awkward)
        assert kept.columns == awkward.columns and {None, 1, 4, 5, 7} == {r.doc_id for r in kept.collect()}
        assert simhash.keep_one(nothing).count() == 0

    def test_several_fingerprints(self, spark, documents):
        rng = random.Random(8)
        rows = []
        for g in range(25):
            w = prose(rng, 250).split()
            rows.append((3 * g, " ".join(w), "a"))
            w[rng.randrange(250)] = "changed"
            rows.append((3 * g + 1, " ".join(w), "a"))
            rows.append((3 * g + 2, prose(rng, 250), "a"))
        docs = documents(rows)
        fps = [simhash.fingerprint(t.encode(), 5, 4) for _, t, _ in rows]
        root = list(range(len(rows)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(len(rows)):
            for j in range(i):
                if any((a ^ b).bit_count() <= 4 for a, b in zip(fps[i], fps[j], strict=True)):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, 5, prints=4).collect()}
        assert got == {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}
        kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
        assert all(3 * g in kept and 3 * g + 2 in kept for g in range(25)) and sum(3 * g + 1 in kept for g in range(25)) <= 2

    def test_pipeline_links_by_the_index(self, spark, documents, monkeypatch):
        """Near-dedup asks the index, whose links are verified; MinHash finds the rest."""
        rng, rows, given = random.Random(9), [], []
        for g in range(12):
            w = prose(rng, 400).split()
            rows.append((2 * g, " ".join(w), "a"))
            for k in rng.sample(range(400), g):
                w[k] = "changed"
            rows.append((2 * g + 1, " ".join(w), "a"))
        seek = simhash._links

        def spy(*args):
            found = seek(*args)
            given.extend(map(tuple, found[0].collect()))
            return found

        monkeypatch.setattr(simhash, "_links", spy)
        kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(rows), "").collect()}
        fps = {d: simhash.fingerprint(t.encode(), corpus_pipeline.SHINGLE_WORDS)[0] for d, t, _ in rows}
        assert given and all((fps[u] ^ fps[v]).bit_count() <= 4 for u, v in given)
        least, _ = groups_by_all_pairs([r[:2] for r in rows])
        assert kept == {d for d, _, _ in rows if least[d] == d} and len(kept) < len(rows)

    def test_hot_keys_are_joined_like_others(self, spark):
        rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(90)], "k string, i long")
        side = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("most"))
        plain = sorted(map(tuple, rows.join(side.drop("n"), "k").collect()))
        for hot_rows in (10, 1000):
            joined = common.join_counted(rows, side, ["k"], "n", hot_rows)
            assert sorted(map(tuple, joined.collect())) == plain and joined.columns == ["k", "i", "most"]
        assert common.join_counted(rows.filter("i < 0"), side.filter("n < 0"), ["k"], "n").count() == 0

    def test_long_chain_is_one_component(self, spark):
        edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
        assert {r.component for r in components.components(edges).collect()} == {0}


def brute_removal(rows, length=100):
    seen, out = set(), {}
    for d, t, _ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = set()
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone.update(range(s, s + length))
            seen.add(b[s : s + length])
        kept = bytes(x for i, x in enumerate(b) if i not in gone)
        out[d] = (len(b), len(gone), sum(1 for i in gone if i - 1 not in gone), hashlib.sha256(kept).hexdigest())
    return out


def groups_by_all_pairs(rows):
    """The least doc_id of each doc_id's group, from the similarity of all pairs of (doc_id, text)."""
    sets = [(d, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()) for d, w in ((d, t.lower().split()) for d, t in rows)]
    root = {d: d for d, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    similar = []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x | y)
            similar.append(len(x & y) / both if both else 1.0)
            if 5 * len(x & y) >= 4 * both:
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {d: find(d) for d in root}, similar


class TestJaccardDedup:
    @pytest.mark.parametrize(("small", "family_limit"), [(12, 2_000_000), (2, 2_000_000), (2, 3_000), (3, 400)])
    def test_groups_against_all_pairs(self, documents, small, family_limit):
        rng = random.Random(9)
        rows, d = [], 0
        for share in (0.005, 0.01, 0.02, 0.03, 0.04, 0.05) * 4 + (0.02,):
            base = prose(rng, 200).split()
            for _ in range(60 if d > 150 else 4):  # the last group is large
                rows.append((d, " ".join(prose(rng, 1) if rng.random() < share else x for x in base), "a"))
                d += 1
            d += 100 if len(rows) == 96 else 0
        expected, similar = groups_by_all_pairs([r[:2] for r in rows])
        assert sum(0.8 <= x < 0.9 for x in similar) > 50 and sum(0.6 < x < 0.8 for x in similar) > 50
        kept = {r.doc_id for r in jaccard_dedup.keep_one(documents(rows), small=small, family_limit=family_limit).collect()}
        assert kept == {d for d, least in expected.items() if d == least}

    def test_one_id_with_several_texts(self, documents):
        """Such a document links by any of its texts, and connects what is linked with them."""
        rng = random.Random(10)
        a, b, c = (prose(rng, 100) for _ in range(3))
        near = " ".join(["changed", *b.split()[1:]])
        rows = [(3, a, "a"), (5, a, "a"), (5, b, "a"), (4, near, "a"), (4, near, "a"), (6, c, "a"), (None, c, "a"), (7, "", "a"), (8, None, "a")]
        assert Counter(r.doc_id for r in simhash.keep_one(documents(rows)).collect()) == Counter([3, 6, None, 7])

    def test_prefix_filter_loses_nothing(self):
        rng = np.random.default_rng(3)
        for _ in range(200):
            base = rng.choice(1000, 40, replace=False)
            sets = [np.sort(np.unique(np.concatenate([rng.choice(base, rng.integers(25, 41), replace=False), rng.choice(1000, rng.integers(0, 6), replace=False)]))) for _ in range(12)]
            edges = jaccard_dedup.link_family(list(range(12)), sets, [0] * 12)
            pairs = {(i, j) for i in range(12) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
            find = lambda links: {frozenset(x) for x in _merge(links)}
            assert all((max(e), min(e)) in pairs for e in edges) and find(edges) == find(pairs)


def _merge(links):
    groups = []
    for a, b in links:
        hit = [g for g in groups if a in g or b in g]
        groups = [g for g in groups if g not in hit] + [set().union({a, b}, *hit)]
    return groups


class TestSuffixDedup:
    @pytest.mark.parametrize("limit", [8192, 2])
    def test_against_brute_force(self, documents, limit):
        rng = random.Random(5)
        passages = [prose(rng, n) for n in (30, 25, 60, 18)]
        rows = []
        for d in range(60):
            parts = [prose(rng, rng.randint(0, 30))]
            for _ in range(rng.randint(0, 3)):
                p = rng.choice(passages)
                a = rng.randint(0, 20)
                parts += [p[a : rng.randint(a + 90, a + 400)], prose(rng, rng.randint(0, 12))]
            rows.append((d, " ".join(parts), "a"))
        rows += [(100, "ab" * 300, "a"), (101, "ab" * 60, "a"), (102, rows[3][1], "a"), (103, "z" * 99, "a"), (104, "z" * 100, "a"), (105, "z" * 150, "a"), (106, None, "a"), (107, "ü" * 200, "a")]
        got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(suffix_dedup.remove_duplicates(documents(rows), bucket_limit=limit)).collect()}
        assert got == brute_removal(rows)

    def test_pieces_of_a_long_text(self, documents, monkeypatch):
        monkeypatch.setattr(suffix_dedup, "_PIECE", 700)
        rng = random.Random(6)
        a, b = prose(rng, 600), prose(rng, 300)
        rows = [(1, a + b + a[100:900], "a"), (2, b[50:700] + a, "a")]
        run = suffix_dedup.anchors(documents(rows))
        assert run.count() > 0
        got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(suffix_dedup.remove_duplicates(documents(rows))).collect()}
        assert got == brute_removal(rows)

    def test_maximal_repeats(self):
        text = np.frombuffer(b"xabcdy" + b"zabcdw" + b"zabcq", np.uint8)
        starts = np.arange(len(text))
        stops = np.array([6] * 6 + [12] * 6 + [17] * 5)
        order, common = suffix_dedup.suffix_order(text, starts, stops, np.zeros(len(text), int))
        left = np.where(np.isin(order, [0, 6, 12]), -1, text[order - 1].astype(int))
        groups = list(suffix_dedup.maximal_repeats(common, left, order, 3))
        assert {(n, tuple(sorted(order[a:b].tolist()))) for n, a, b, _ in groups} == {(4, (1, 7)), (3, (1, 7, 13)), (4, (6, 12))}
        # the longer repeat decides 7, the shorter one around it only what is left
        assert {(n, tuple(order[later].tolist())) for n, _, _, later in groups} == {(4, (7,)), (3, (13,)), (4, (12,))}

    def test_groups_have_all_occurrences(self, documents):
        """Every group's bytes are equal at all its places, these are all there are, and the removal is what the groups say."""
        rng = random.Random(13)
        passages = [prose(rng, n) for n in (40, 60, 25)]
        rows = [(d, " ".join([prose(rng, 12), passages[d % 3], prose(rng, 9), passages[0][40:190] if d % 4 == 0 else "x", prose(rng, 5)]), "a") for d in range(24)]
        rows += [(50, passages[1], "a"), (51, passages[1], "a"), (52, "q" * 140, "a"), (53, None, "a"), (54, "short", "a")]
        text = {d: (t or "").encode() for d, t, _ in rows}
        groups = {}
        for r in suffix_dedup.repeat_groups(documents(rows)).collect():
            groups.setdefault((r.group_id, r.length), set()).add((r.doc_id, r.start))
        gone = {d: set() for d in text}
        for (_, size), places in groups.items():
            strings = {text[d][s : s + size] for d, s in places}
            assert len(strings) == 1 and size >= 100 and len(places) > 1
            (one,) = strings
            assert len(one) == size and places == {(d, s) for d, t in text.items() for s in range(len(t) - size + 1) if t[s : s + size] == one}
            for d, s in sorted(places)[1:]:
                gone[d].update(range(s, s + size))
        expected = brute_removal(rows)
        assert {d: len(g) for d, g in gone.items()} == {d: e[1] for d, e in expected.items()}
        # a whole copied passage is one group, however many anchors it has
        assert any(size >= len(passages[1].encode()) and {d for d, _ in places} == {50, 51} | {d for d in range(24) if d % 3 == 1} for (_, size), places in groups.items())
        assert suffix_dedup.repeat_groups(documents([(1, "nothing twice", "a")])).count() == 0

    def test_awkward(self, awkward, nothing):
        rows = suffix_dedup.digests(suffix_dedup.remove_duplicates(awkward)).collect()
        assert len(rows) == 9 and sum(r.n_removed > 0 for r in rows) == 1
        assert suffix_dedup.remove_duplicates(nothing).count() == 0


def brute_quality(rows):
    """The rows that the quality rules keep, from texts, with numpy; one language, every source large enough to be a group."""
    stats = []
    for _, text, _ in rows:
        text = text or ""
        w = WORD.findall(text)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        n, g = max(1, len(w)), robust_outliers.GRAIN
        vector = [np.log(max(1, sum(map(len, w))) / n), np.log1p(10 * sum(c in "#*$%&|<>" for c in text) / n), len(covered) / n, np.log1p(len(lines) - len(set(lines)))]
        stats.append(([round(g * v) for v in vector], len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    floors = np.diag((np.array(robust_outliers.FLOORS) * robust_outliers.GRAIN) ** 2)
    distance = lambda x, mean, cov: np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov + floors), x - mean)
    kept = []
    for source in {r[2] for r in rows}:
        mine = [i for i, r in enumerate(rows) if r[2] == source]
        x, failed = np.array([stats[i][0] for i in mine], float), np.array([stats[i][1] for i in mine])
        fit = x[~failed]
        assert len(fit) >= robust_outliers.MIN_GROUP

        def steps(mean, cov, n, fit=fit):
            for _ in range(n):
                bins = np.floor(np.log1p(distance(fit, mean, cov)) * robust_outliers.BIN_GRAIN)
                core = fit[bins <= np.sort(bins)[int(np.ceil(robust_outliers.CORE * len(fit))) - 1]]
                mean, cov = core.mean(axis=0), np.cov(core.T, bias=True)
            return mean, cov

        starts = [(np.array([np.sort(c)[(len(c) - 1) // q] for c in fit.T]), np.zeros((4, 4))) for q in (2, 4)] + [(fit.mean(axis=0), np.cov(fit.T, bias=True))]
        tried = [steps(*s, robust_outliers.FIRST_STEPS) for s in starts]
        mean, cov = steps(*min(tried, key=lambda e: np.linalg.det(e[1] + floors)), robust_outliers.MAX_STEPS - robust_outliers.FIRST_STEPS)
        d2 = distance(x, mean, cov * robust_outliers.CONSISTENCY)
        kept += [mine[i] for i in range(len(mine)) if not failed[i] and d2[i] <= robust_outliers.CUT]
    return [rows[i] for i in sorted(kept)]


def brute_lines(rows):
    sites, first = {}, {}
    bare = lambda x: x.strip(" \t\n\x0b\x0c\r")
    for d, t, s in sorted(rows):
        for i, line in enumerate(t.split("\n")):
            if bare(line):
                sites.setdefault(bare(line), set()).add(s)
                first.setdefault(bare(line), (d, i))
    stays = lambda d, i, x: not bare(x) or len(sites[bare(x)]) < line_spread.MIN_SITES or first[bare(x)] == (d, i)
    return [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if stays(d, i, x)), s) for d, t, s in rows]


def brute_mix(rows):
    """The rows as often as the mix takes them."""
    size = lambda t: len(WORD.findall(t))
    sources = sorted({s for _, _, s in rows})
    have = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    target, open_, left = {}, list(sources), float(sum(have.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > mixing.MAX_EPOCHS * have[s]]
        for s in full or open_:
            target[s] = mixing.MAX_EPOCHS * have[s] if full else left * weight[s] / total
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in full] if full else []
    out = []
    for s in sources:
        mine = sorted((hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest(), d, t) for d, t, x in rows if x == s)
        whole = int(min(mixing.MAX_EPOCHS, target[s] // have[s]))
        missing = target[s] - whole * have[s]
        for _, d, t in mine:
            extra = missing > 0 and size(t) <= 2 * missing
            missing -= size(t)
            out += [(d, t, s)] * (whole + extra if size(t) else 1)
    return out


class TestPipeline:
    def rows(self):
        rng = random.Random(7)
        rows = [(d, prose(rng, rng.randint(40, 120)) + "\nAll rights reserved.", f"s{d % 9}") for d in range(630)]
        rows += [(1000 + i, rows[5][1], "s1") for i in range(10)] + [(1100, "too short", "s1"), (1101, None, "s2"), (1102, "", "s2"), (1103, "word " * 200, "s3")]
        rows += [(1200 + i, "\n".join("# $$ | &&" for _ in range(60)) + prose(rng, 30), "s4") for i in range(3)]
        for i in range(20):  # near copies at several similarities
            w = rows[20 + i][1].split("\n")[0].split()
            for k in rng.sample(range(len(w)), 1 + i // 6):
                w[k] = "changed"
            rows.append((1300 + i, " ".join(w), f"s{i % 9}"))
        return rows

    def test_stages_against_brute_force(self, spark, tmp_path):
        """Each stage's rows, from what the one before kept, against a plain version; and the packed ids of whole texts."""
        rows = self.rows()
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        df = spark.read.parquet(f"{tmp_path}/documents.parquet")
        plain = lambda out: sorted((r.doc_id, r.text, r.source) for r in out.collect())

        def near(kept):
            least, _ = groups_by_all_pairs([r[:2] for r in kept])
            return [r for r in kept if least[r[0]] == r[0]]

        for (name, stage), brute in zip(corpus_pipeline.STAGES[:-1], (brute_quality, brute_lines, near, brute_mix), strict=True):
            before, df = rows, common.materialize(stage(spark, df, str(tmp_path)), name)
            rows = sorted(brute(rows))
            assert plain(df) == rows and all(r.n_chars == len(r.text) for r in df.collect()), name
            assert rows != sorted(before, key=repr), name  # every stage did something
        library, pieces = Tokenizer.from_file(queries.vocabulary()), {}
        for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
            pieces.setdefault(r.doc_id, Counter())[r.start, r.length, r.ids_crc32] += 1
        copies = Counter((d, t) for d, t, _ in rows)
        assert set(pieces) == {d for d, _ in copies}
        for (d, t), n in copies.items():
            ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
            assert sum(length * k for (_, length, _), k in pieces[d].items()) == n * len(ids)
            assert all(zlib.crc32(ids[a : a + length].tobytes()) == crc for a, length, crc in pieces[d])

    def test_stages(self, spark, tmp_path):
        rng = random.Random(7)
        rows = [(d, prose(rng, rng.randint(40, 120)) + "\nAll rights reserved.", f"s{d % 10}") for d in range(120)]
        rows += [(500 + i, rows[5][1], "s1") for i in range(10)] + [(600, "too short", "s1"), (601, None, None), (602, "", "s2")]
        docs = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        df = spark.read.parquet(f"{tmp_path}/documents.parquet")
        seen = []
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = common.materialize(stage(spark, df, str(tmp_path)), name)
            assert out.columns == docs.columns
            seen.append({r.doc_id: r for r in out.collect()})
            df = out
        rules, lines, near, mixed = seen
        assert {600, 601, 602}.isdisjoint(rules) and len(rules) >= 120
        assert set(lines) == set(rules) and lines[0].text.endswith("reserved.") and not lines[1].text.endswith("reserved.")
        assert all(r.n_chars == len(r.text) for r in lines.values())
        assert {500 + i for i in range(10)}.isdisjoint(near) and 5 in near
        assert set(mixed) <= set(near)
        packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert {r.doc_id for r in packed} == set(mixed)

    def test_awkward(self, spark, tmp_path, awkward, nothing):
        """Null ids, repeated rows, clashing column names and an empty table go through all stages."""
        columns = awkward.columns
        long = awkward.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" " + " ".join(f"w{i} of" for i in range(40)))))
        for df, rows in ((long, 9), (nothing, 0)):
            for _, stage in corpus_pipeline.STAGES[:-1]:
                df = common.materialize(stage(spark, df, str(tmp_path)), "awkward")
                assert df.columns == columns
            if rows:
                assert None in {r.doc_id for r in df.collect()}
            assert (df.count() > 0) == bool(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() == 0

    def test_registered(self):
        names = queries.queries()
        assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
        assert set(queries.oracle_sql()) <= set(names)
