"""Quality rules: robust multivariate outliers by the minimum covariance determinant.

Base statistics of a text are turned into a vector: log mean word length, log
symbol density, share of repeated words, log of repeated lines. Per language and
source, concentration steps look for the ``CORE`` share of documents whose
covariance has the least determinant: each step takes mean and covariance of the
core and makes the nearest documents by Mahalanobis distance the next core, until
the determinant rests (``MAX_STEPS`` at most). There are several deterministic
starts (the coordinates' medians, their lower quartiles, all documents' moments);
after two steps the one with the least determinant goes on. Documents beyond the
cut-off distance are rejected, and those that fail the base rules.

Built of DataFrame functions only. Vectors are fixed-point numbers: equal ones of
a group are one counted row, and a step is one aggregation by (group, start,
distance bin) of counts, sums and products, partly before the shuffle; the core
is the bins up to the wanted share. So a group with a third of all rows needs no
sort and no task of its own, and results do not depend on the order of rows.
Sources with fewer than ``MIN_GROUP`` documents are pooled by language, those
pools, if still too small, with each other.

Cases: null or empty texts have no words and fail the base rules; null languages
and sources are groups of their own; equal texts of one group have one verdict;
groups without spread are held apart by floors on the variances; a last pool too
small to estimate keeps its documents; rows without doc_id and rows that repeat
one are judged each for itself; an empty table gives no rows; further columns are
kept by ``keep_inliers`` and ignored by ``judge``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, fresh_name, materialize, words

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW_WORDS = 20, 30, 8
CORE, FIRST_STEPS, ROUND_STEPS, MAX_STEPS, MIN_GROUP = 0.75, 2, 3, 11, 50
#: CORE over the share of chi-squared (6 degrees) below the CORE quantile of chi-squared (4): makes the core's covariance that of all.
CONSISTENCY = 1.485
#: Squared Mahalanobis distance beyond which a document is rejected; the 0.99999 quantile of chi-squared with 4 degrees is 28.5.
CUT = 28.5
#: So many groups' estimates (about 600 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 20_000
DIMENSIONS = ("x0", "x1", "x2", "x3")
#: Least standard deviations: of log mean word length, log symbol density, repeated share, log repeated lines.
FLOORS = (0.05, 0.12, 0.08, 0.5)
#: Vectors are kept in steps of 1/GRAIN, distances in logarithmic bins.
GRAIN, BIN_GRAIN = 1024, 256
STARTS = ("medians", "quartiles", "moments")
_P = range(len(DIMENSIONS))
_PAIRS = [(i, j) for i in _P for j in range(i + 1)]
_MOMENTS = [f"m{i}" for i in _P] + [f"c{i}{j}" for i, j in _PAIRS]
_FACTORS = [f"m{i}" for i in _P] + [f"l{i}{j}" for i, j in _PAIRS]


def base_statistics(text: Column) -> list[tuple[str, Column]]:
    """Columns of one selection, in which later ones name earlier ones; names with _ are intermediate."""
    whole = F.coalesce(text, F.lit(""))
    visible = F.filter(F.split(whole, "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != "")
    # a window's hash is that of its four word pairs
    pairs = F.zip_with("_hashes", F.slice("_hashes", 2, F.size("_hashes")), lambda a, b: F.xxhash64(a, b))
    start = F.sequence(F.lit(1), F.col("n_words").cast("int") - (WINDOW_WORDS - 1))
    window = lambda i: F.xxhash64(*[F.get("_pairs", i + (k - 1)) for k in range(0, WINDOW_WORDS, 2)])
    windows = F.when(F.col("n_words") >= WINDOW_WORDS, F.transform(start, window)).otherwise(F.array().cast("array<bigint>"))
    ordered = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))
    twice = F.filter("_ordered", lambda x, i: (i > 0) & (F.get("_ordered", i - 1)["h"] == x["h"]) | F.coalesce(F.get("_ordered", i + 1)["h"] == x["h"], F.lit(False)))
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, i: F.struct((i + WINDOW_WORDS).alias("end"), (acc["n"] + i + WINDOW_WORDS - F.greatest(i, acc["end"])).alias("n"))
    covered = F.aggregate(places, none, step, lambda acc: acc["n"])
    repeated = F.size("_windows") > F.size(F.array_distinct("_windows"))
    return [
        ("_words", words(text)),
        ("n_words", F.size("_words").cast("long")),
        ("word_chars", F.aggregate("_words", F.lit(0), lambda a, w: a + F.char_length(w)).cast("long")),
        ("n_symbols", F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long")),
        ("_lines", visible),
        ("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")),
        ("_hashes", F.transform("_words", lambda w: F.xxhash64(w))),
        ("_pairs", pairs),
        ("_windows", windows),
        ("_ordered", F.when(repeated, ordered)),
        ("n_repeat_words", F.coalesce(F.when(F.col("_ordered").isNotNull(), covered), F.lit(0)).cast("long")),
        ("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))),
    ]


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def statistics(df: DataFrame, carried: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``df(doc_id, text, lang, source)`` as the carried columns and STATISTICS."""
    named = [column.alias(name) for name, column in base_statistics(F.col("text"))]
    return df.select(*carried, "text").select(*carried, *named).select(*carried, *STATISTICS)


def _vector() -> list[Column]:
    """The transformed statistics in whole steps of 1/GRAIN; doubles, whose sums are then exact."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    parts = [F.log(chars / n), F.log1p(10 * F.col("n_symbols") / n), F.col("n_repeat_words") / n, F.log1p(F.col("n_dup_lines").cast("double"))]
    return [F.round(p * GRAIN).alias(x) for p, x in zip(parts, DIMENSIONS, strict=True)]


def _factored(estimates: DataFrame, keys: tuple[str, ...], consistency: float = 1.0) -> DataFrame:
    """Keys, moments, the lower triangle l_ij of the factor of the floored covariance, and its determinant."""
    factor = []  # one selection, in which later columns name earlier ones
    for i, j in _PAIRS:
        rest = f"{consistency}D * c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        factor.append(f"sqrt(greatest({rest} + {(FLOORS[i] * GRAIN) ** 2}D, 1D)) AS l{i}{j}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    return estimates.selectExpr(*keys, *_MOMENTS, *factor, f"{' * '.join(f'l{i}{i}' for i in _P)} AS det")


class _Small:
    """Joins with tables of a row or a few for each group: broadcast if the groups are few enough, so that a hot group stays dealt over all tasks."""

    def __init__(self, groups: DataFrame):
        self.few = groups.count() <= BROADCAST_GROUPS

    def __call__(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if self.few else table


def _distance(rows: DataFrame) -> DataFrame:
    """Adds the squared Mahalanobis distance ``d2`` to rows that have vectors, means and factors, by forward substitution."""
    solved = [f"({x} - m{i}{''.join(f' - l{i}{k} * _z{k}' for k in range(i))}) / l{i}{i} AS _z{i}" for i, x in enumerate(DIMENSIONS)]
    return rows.selectExpr("*", *solved, f"{' + '.join(f'_z{i} * _z{i}' for i in _P)} AS d2")


def _moments(sums: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Means m_i and covariances c_ij from the sums n, s_i, s_ij."""
    return sums.selectExpr(*keys, *[f"s{i} / n AS m{i}" for i in _P], *[f"s{i}{j} / n - s{i} / n * (s{j} / n) AS c{i}{j}" for i, j in _PAIRS])


def _sums() -> list[Column]:
    """n, s_i and s_ij of counted vectors."""
    return [F.expr(e) for e in ["sum(n) AS n", *[f"sum(n * x{i}) AS s{i}" for i in _P], *[f"sum(n * x{i} * x{j}) AS s{i}{j}" for i, j in _PAIRS]]]


def _step(fit: DataFrame, state: DataFrame, small: _Small) -> DataFrame:
    """A concentration step: the moments and factors of the CORE share nearest to those of ``state``, for each group and start; _was is the determinant before."""
    keys = ("_group", "_start")
    rows = _distance(fit.join(small(state.select(*keys, *_FACTORS, F.col("det").alias("_was"))), "_group"))
    binned = rows.groupBy(*keys, F.floor(F.log1p("d2") * BIN_GRAIN).alias("_bin")).agg(*_sums(), F.max("_was").alias("_was"))
    before = f"coalesce(sum(n) OVER (PARTITION BY {', '.join(keys)} ORDER BY _bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before"
    cumulated = binned.selectExpr("*", before, f"sum(n) OVER (PARTITION BY {', '.join(keys)}) AS _all")
    sums = ["n", *[f"s{i}" for i in _P], *[f"s{i}{j}" for i, j in _PAIRS]]
    core = cumulated.filter(f"_before < ceil({CORE}D * _all)").groupBy(*keys).agg(*[F.expr(f"sum({c}) AS {c}") for c in sums], F.max("_was").alias("_was"))
    return _factored(_moments(core, (*keys, "_was")), (*keys, "_was"))


def _starts(fit: DataFrame) -> DataFrame:
    """The factors that the steps begin with. Quantiles are counted by value, so no group is sorted."""
    long = fit.select("_group", F.posexplode(F.array(*DIMENSIONS)).alias("_k", "_v"), "n").groupBy("_group", "_k", "_v").agg(F.sum("n").alias("n"))
    each = Window.partitionBy("_group", "_k")
    below = F.coalesce(F.sum("n").over(each.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = long.select("*", below.alias("_before"), F.sum("n").over(each).alias("_all"))
    at = lambda share: F.max(F.when(share * F.col("_before") < F.col("_all"), F.col("_v")))
    points = counted.groupBy("_group", "_k").agg(F.array(at(2), at(4)).alias("_q"))
    centres = points.groupBy("_group").pivot("_k", list(_P)).agg(F.first("_q"))
    one = centres.select("_group", F.posexplode(F.arrays_zip(*[F.col(str(i)).alias(f"m{i}") for i in _P])).alias("_start", "_m"))
    quantiles = one.select("_group", "_start", *[F.col("_m")[f"m{i}"].alias(f"m{i}") for i in _P], *[F.lit(0.0).alias(f"c{i}{j}") for i, j in _PAIRS])
    everything = _moments(fit.groupBy("_group").agg(*_sums()).withColumn("_start", F.lit(2)), ("_group", "_start"))
    return _factored(quantiles.unionByName(everything), ("_group", "_start"))


def _groups(stats: DataFrame) -> DataFrame:
    """(_lang, _source, _group) of all languages and sources; _group is null for a last pool too small to estimate."""
    sizes = stats.groupBy("lang", "source").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("_n"))
    small = F.col("_n") < MIN_GROUP
    pools = sizes.groupBy(F.col("lang").alias("_l")).agg(F.sum(F.when(small, F.col("_n")).otherwise(0)).alias("_pool"))
    last = pools.filter(F.col("_pool") < MIN_GROUP).agg(F.coalesce(F.sum("_pool"), F.lit(0)).alias("_last"))
    sizes = sizes.join(pools, F.col("lang").eqNullSafe(F.col("_l"))).crossJoin(F.broadcast(last))  # one row
    name = lambda *cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    group = F.when(~small, name("lang", "source")).when(F.col("_pool") >= MIN_GROUP, name("lang")).when(F.col("_last") >= MIN_GROUP, F.lit("{}"))
    return sizes.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), group.alias("_group"))


def _grouped(rows: DataFrame, groups: DataFrame, small: _Small) -> DataFrame:
    joined = rows.join(small(groups), F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.drop("_lang", "_source")


def _least(state: DataFrame) -> DataFrame:
    """Each group's start with the least determinant."""
    rest = [c for c in state.columns if c != "_group"]
    return state.groupBy("_group").agg(F.min_by(F.struct(*rest), F.struct("det", "_start")).alias("_best")).select("_group", "_best.*")


def estimate(stats: DataFrame) -> tuple[DataFrame, DataFrame, _Small]:
    """From ``statistics``: the groups of languages and sources, and each group's means and factors."""
    groups = materialize(_groups(stats), "groups")
    small = _Small(groups)
    vectors = _grouped(stats.filter("NOT base_failed").select("lang", "source", *_vector()), groups, small)
    fit = materialize(vectors.filter("_group IS NOT NULL").groupBy("_group", *DIMENSIONS).agg(F.count(F.lit(1)).alias("n")), "vectors")
    steps = lambda state, n: reduce(lambda at, _: _step(fit, at, small), range(n), state)
    state, done = materialize(_least(steps(_starts(fit), FIRST_STEPS)), "mcd"), FIRST_STEPS
    while done < MAX_STEPS and not state.filter(F.abs(F.col("det") - F.col("_was")) > 1e-12 * F.col("det")).isEmpty():
        state, done = materialize(steps(state, ROUND_STEPS), "mcd"), done + ROUND_STEPS  # a few steps in one job
    best = state.select("_group", *_MOMENTS)
    return groups, materialize(_factored(best, ("_group",), CONSISTENCY).select("_group", *_FACTORS), "mcd"), small


def _judged(stats: DataFrame, groups: DataFrame, factors: DataFrame, small: _Small) -> DataFrame:
    """``stats`` with the squared distance ``d2`` (null without an estimate) and ``kept``."""
    rows = _distance(_grouped(stats.select("*", *_vector()), groups, small).join(small(factors), "_group", "left"))
    # one comparison: as a conjunct of its own, base_failed would be pushed below the joins and all statistics computed twice
    return rows.withColumn("kept", F.coalesce("d2", F.lit(0.0)) + F.col("base_failed").cast("int") * (CUT + 1) <= CUT)


def judge_statistics(stats: DataFrame) -> DataFrame:
    """``statistics`` with ``kept`` and the squared distance ``d2`` (null without an estimate)."""
    return _judged(stats, *estimate(stats)).select("doc_id", "lang", "source", *STATISTICS, "kept", "d2")


def judge(df: DataFrame) -> DataFrame:
    """doc_id, STATISTICS, kept, d2 of every document in ``df(doc_id, text, lang, source)``."""
    return judge_statistics(materialize(statistics(df), "statistics"))


def keep_inliers(df: DataFrame) -> DataFrame:
    """``df``'s rows without the rejected ones, judged where they are read: no text is shuffled, statistics are computed again instead."""
    estimates = estimate(materialize(statistics(df, ("lang", "source")), "statistics"))
    row = fresh_name(df, "row")
    again = statistics(df.select(F.struct(*df.columns).alias(row), "lang", "source", "text"), (row, "lang", "source"))
    return _judged(again, *estimates).filter("kept").select(f"{row}.*")


def oracle_sql() -> str:
    """The same statistics and concentration steps, unrolled, for DuckDB."""
    p = range(len(DIMENSIONS))
    moments = ", ".join([f"avg(x{i}) AS m{i}" for i in p] + [f"avg(x{i} * x{j}) - avg(x{i}) * avg(x{j}) AS c{i}{j}" for i in p for j in range(i + 1)])

    def factor(source: str) -> str:
        parts = []
        for i in p:
            for j in range(i + 1):
                rest = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
                floor = f" + {(FLOORS[i] * GRAIN) ** 2!r}" if i == j else ""
                parts.append(f"sqrt(greatest(c{i}{j}{floor}{rest}, 1.0)) AS l{i}{j}" if i == j else f"(c{i}{j}{rest}) / l{j}{j} AS l{i}{j}")
        return f"SELECT g, s, {', '.join(f'm{i}' for i in p)}, {', '.join(f'c{i}{j}' for i in p for j in range(i + 1))}, {', '.join(parts)} FROM {source}"

    solved = ", ".join(f"(x{i} - m{i}{''.join(f' - l{i}{k} * z{k}' for k in range(i))}) / l{i}{i} AS z{i}" for i in p)
    d2 = " + ".join(f"z{i} * z{i}" for i in p)
    zero = ", ".join(f"0.0 AS c{i}{j}" for i in p for j in range(i + 1))
    middle = lambda share: ", ".join(f"list_sort(list(x{i}))[(count(*) - 1) // {share} + 1] AS m{i}" for i in p)
    first = f"SELECT g, 0 AS s, {middle(2)}, {zero} FROM fit GROUP BY g UNION ALL SELECT g, 1, {middle(4)}, {zero} FROM fit GROUP BY g UNION ALL SELECT g, 2, {moments} FROM fit GROUP BY g"
    steps = [f"e0 AS ({first}), f0 AS MATERIALIZED ({factor('e0')})"]
    for k in range(1, MAX_STEPS + 1):
        least = f" QUALIFY row_number() OVER (PARTITION BY g ORDER BY {' * '.join(f'l{i}{i}' for i in p)}, s) = 1" if k == FIRST_STEPS else ""
        steps.append(
            f"d{k} AS (SELECT g, s, x0, x1, x2, x3, floor(ln(1 + d2) * {BIN_GRAIN}) AS bin FROM (SELECT *, {solved}, {d2} AS d2 FROM fit JOIN f{k - 1} USING (g))), "
            f"r{k} AS (SELECT *, rank() OVER (PARTITION BY g, s ORDER BY bin) - 1 AS below, count(*) OVER (PARTITION BY g, s) AS n FROM d{k}), "
            f"e{k} AS (SELECT g, s, {moments} FROM r{k} WHERE below < ceil({CORE} * n) GROUP BY g, s), f{k} AS MATERIALIZED ({factor(f'e{k}')}{least})"
        )
    carried = ", ".join([f"m{i}" for i in p] + [f"{CONSISTENCY} * c{i}{j} AS c{i}{j}" for i in p for j in range(i + 1)])
    steps.append(f"best AS (SELECT g, s, {carried} FROM f{MAX_STEPS}), chosen AS ({factor('best')})")
    word = f"[^{SPACE}]"
    return f"""
WITH b AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{word}')) AS ls FROM documents),
win AS (SELECT doc_id, i, list_slice(ws, i + 1, i + {WINDOW_WORDS}) AS w FROM (SELECT doc_id, ws, unnest(range(0, greatest(0, len(ws) - {WINDOW_WORDS - 1}))) AS i FROM b)),
cov AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (
    SELECT doc_id, unnest(range(i, i + {WINDOW_WORDS})) AS q FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
s AS (
  SELECT b.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM b LEFT JOIN cov USING (doc_id)),
t AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         round({GRAIN} * ln(greatest(word_chars, 1) / CAST(greatest(n_words, 1) AS DOUBLE))) AS x0, round({GRAIN} * ln(1 + 10 * n_symbols / CAST(greatest(n_words, 1) AS DOUBLE))) AS x1,
         round({GRAIN} * n_repeat_words / CAST(greatest(n_words, 1) AS DOUBLE)) AS x2, round({GRAIN} * ln(1 + CAST(n_dup_lines AS DOUBLE))) AS x3 FROM s),
z0 AS (SELECT lang, source, count(*) FILTER (NOT base_failed) AS n FROM t GROUP BY lang, source),
z1 AS (SELECT *, sum(CASE WHEN n < {MIN_GROUP} THEN n ELSE 0 END) OVER (PARTITION BY lang) AS pool FROM z0),
z2 AS (SELECT *, sum(CASE WHEN n < {MIN_GROUP} AND pool < {MIN_GROUP} THEN n ELSE 0 END) OVER () AS rest FROM z1),
z AS (
  SELECT lang, source, CASE WHEN n >= {MIN_GROUP} THEN 's' || coalesce('=' || lang, '') || '/' || coalesce('=' || source, '') WHEN pool >= {MIN_GROUP} THEN 'l' || coalesce('=' || lang, '') WHEN rest >= {MIN_GROUP} THEN 'r' END AS g FROM z2),
rows AS MATERIALIZED (SELECT t.*, z.g FROM t LEFT JOIN z ON t.lang IS NOT DISTINCT FROM z.lang AND t.source IS NOT DISTINCT FROM z.source),
fit AS MATERIALIZED (SELECT g, x0, x1, x2, x3 FROM rows WHERE NOT base_failed AND g IS NOT NULL),
{", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d2 <= {CUT}, true) AS kept
FROM (SELECT *, {solved}, {d2} AS d2 FROM rows LEFT JOIN chosen USING (g))"""
