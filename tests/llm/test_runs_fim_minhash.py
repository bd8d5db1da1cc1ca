"""Periodic runs, fill-in-the-middle and one-permutation MinHash against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quillon.llm import fill_middle, minhash, periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UNIT = re.compile(r"[^\n]*\n|[^\n]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def planted(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def plain_runs(w):
    """(start, length, period) by trying each period at each place."""
    n, found = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            end = i + q
            stretch = w[start:end]
            if end - start >= max(6, 4 * q) and not any(all(stretch[k] == stretch[k + d] for k in range(len(stretch) - d)) for d in range(1, q)):
                found.append((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected_runs(doc_id, text):
    w = planted(doc_id, text)
    runs = plain_runs(w)
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{k},{p}\n" for s, k, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def repetitive(rng):
    """A text of few words with repetitions inside repetitions."""
    parts = []
    for _ in range(rng.randint(0, 6)):
        unit = [rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(1, 5))]
        parts += unit * rng.choice([1, 2, 4, 5, 9]) + unit[: rng.randint(0, len(unit))]
    return rng.choice([" ", "\n", " \t"]).join(parts)


class TestPeriodicRuns:
    @pytest.mark.parametrize("cells", [periodic_runs.CELLS, 60])
    def test_against_plain(self, documents, awkward, cells):
        rng = random.Random(3)
        rows = [(i, repetitive(rng), "a") for i in range(250)]
        for df in (documents(rows), awkward.filter("doc_id <> 5 OR doc_id IS NULL")):
            got = periodic_runs.digests(periodic_runs.find_runs(periodic_runs.repeat_tails(df), cells=cells)).collect()
            assert sorted(map(repr, map(tuple, got))) == sorted(repr(expected_runs(r.doc_id, r.text)) for r in df.collect())

    def test_outputs(self, documents):
        rows = periodic_runs.find_runs(documents([(1, "x " + "a b " * 5 + "y", "s"), (2, "no run here", "s")])).collect()
        got = {r.doc_id: r for r in rows}
        assert [tuple(x) for x in got[1].runs] == [(1, 10, 2)] and got[1].collapsed == "x a b y" and got[1].n_words == 12
        assert got[2].runs == [] and got[2].collapsed == "no run here"

    def test_blocks_of_lags(self, monkeypatch):
        rng = random.Random(4)
        ids = np.array([rng.randint(0, 1) for _ in range(400)], np.int32)
        whole = periodic_runs.smallest_periods(periodic_runs.lag_runs(ids, 1, 101))
        monkeypatch.setattr(periodic_runs, "_BLOCK", 1)
        parts = np.concatenate([periodic_runs.lag_runs(ids, a, min(a + 7, 101)) for a in range(1, 101, 7)])
        assert periodic_runs.smallest_periods(parts).tolist() == whole.tolist() == [list(r) for r in plain_runs(ids.tolist())]

    def test_long_and_empty(self, documents, nothing):
        unit = [f"w{i}" for i in range(700)]
        long = documents([(3, " ".join(unit * 9), "a"), (4, None, "a")])
        got = {r.doc_id: r for r in periodic_runs.find_runs(long, cells=1 << 20).collect()}
        assert [tuple(x) for x in got[3].runs] == [(0, 6300, 700)] and got[3].collapsed == " ".join(unit) and got[4].runs == []
        assert periodic_runs.find_runs(nothing).count() == 0


def expected_cut(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n, digest = len(units), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 50 else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if h4 % 100 < 50 else "psm", len(p), len(m), sha(out), sha(text)


class TestFillMiddle:
    @pytest.mark.parametrize("limits", [{}, {"chunk": 1}, {"chunk": 7}, {"long_bytes": 0, "piece": 5}, {"long_bytes": 40, "piece": 1}, {"long_bytes": 0, "piece": 1 << 20}])
    def test_against_plain(self, documents, awkward, limits):
        rng = random.Random(5)
        rows = [(i, "".join(rng.choice(["\n", "\n\n", "a", "é漢", "\r\n", "<", "<P", "M>", "word word", " "]) for _ in range(rng.randint(0, 30))), "a") for i in range(200)]
        rows += [(500, "has <S> inside\n", "a"), (501, "\n", "a"), (502, "x", "a"), (503, "<P><M>", "a")]
        for df in (documents(rows), awkward):
            got = fill_middle.digests(fill_middle.transform(df, **limits)).collect()
            assert sorted(map(repr, map(tuple, got))) == sorted(repr(expected_cut(r.doc_id, r.text)) for r in df.collect())

    def test_rates(self, documents, nothing):
        df = documents([(i, f"line {i}\nnext\n", "a") for i in range(400)])
        forms = [r.form for r in fill_middle.transform(df, rate=50, spm=100).collect()]
        assert 140 < forms.count("plain") < 260 and "psm" not in forms
        assert fill_middle.transform(nothing).count() == 0


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def expected_components(rows):
    """(doc_id, n_shingles, component_id, kept) by all pairs."""
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if d is not None and e is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((find(d), find(e)))
                root[high] = low
    return sorted(repr((d, len(s), find(d) if d is not None else None, d is None or find(d) == d)) for d, s in sets)


class TestMinHash:
    def test_against_all_pairs(self, documents, awkward):
        rng = random.Random(6)
        rows = []
        for group in range(30):
            base = [f"g{group}w{rng.randint(0, 400)}" for _ in range(rng.choice([4, 7, 12, 40, 150]))]
            for _ in range(rng.randint(1, 12)):
                copy = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                    copy[rng.randrange(len(copy))] = rng.choice(["edit", "Other", base[0]])
                rows.append((len(rows), " ".join(copy).swapcase() if rng.random() < 0.2 else " ".join(copy), "a"))
        for df in (documents(rows), awkward):
            texts = [(r.doc_id, r.text) for r in df.collect()]
            assert sorted(repr(tuple(r)) for r in minhash.near_duplicates(df).collect()) == expected_components(texts)

    def test_families_that_share_boilerplate(self, documents):
        """Buckets full of sets that do not link, and groups that only meet beyond a bucket's least set."""
        rng = random.Random(7)
        shared = [f"c{i}" for i in range(60)]
        rows = []
        for _ in range(120):
            rows.append((len(rows), " ".join(shared + [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(6, 24))]), "a"))
            if rng.random() < 0.4:
                words = rows[-1][1].split()
                words[rng.randrange(len(words))] = "edited"
                rows.append((len(rows) + 1000, " ".join(words), "a"))
        texts = [(d, t) for d, t, _ in rows]
        assert sorted(repr(tuple(r)) for r in minhash.near_duplicates(documents(rows)).collect()) == expected_components(texts)

    def test_one_id_with_several_texts(self, documents, nothing):
        a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
        rows = [(1, a, "s"), (2, b, "s"), (3, a, "s"), (3, b, "s"), (4, c, "s"), (4, "", "s"), (5, c, "s"), (None, a, "s")]
        got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(documents(rows)).collect()}
        assert {d: v[0] for (d, n), v in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, None: None} and got[4, 0] == (4, True) and got[None, 27] == (None, True)
        assert minhash.near_duplicates(nothing).count() == 0

    def test_sketch_collides_as_often_as_sets_are_similar(self):
        rng = np.random.default_rng(8)
        for size in (5, 50, 2000):
            common, equal = size * 4 // 5, []
            for _ in range(150):
                h = rng.integers(0, 1 << 63, size + size // 5, dtype=np.uint64)
                a, b = h[:size], np.concatenate([h[:common], h[size:]])
                equal.append((minhash.sketch(np.unique(a)) == minhash.sketch(np.unique(b))).mean())
            assert abs(np.mean(equal) - common / (size + size // 5)) < 0.04
