"""Ordered state over rows that no task sees as a whole: numberings, running sums, predecessors, last known values.

Rows are dealt to ranges of about equal size by splitters: order statistics of a
sample, taken as the rows with the least hashes (one pass, the same rows at every
run). Each range is sorted and scanned alone; what a range needs from those before
it is carried over from one summary row for each of them. A key lies in several
ranges only if a splitter has that key, so only the rows of these keys, fewer than
there are ranges, are summarised at all. So a key with a third of all rows is many
tasks, and a million keys with few rows cost nothing extra.

Orders should tell rows apart (end them with an id): rows that are equal in all
columns of the order share a range. Nulls come first, as in Spark's own order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: Ranges, and rows of the sample that their splitters come from (collected; bounded).
RANGES, SAMPLE = 64, 4096


def _position(order: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])


def splitters(df: DataFrame, order: list[str], ranges: int = RANGES, sample: int = SAMPLE) -> list[Row]:
    """Up to ``ranges`` - 1 different positions in ``order`` that cut ``df`` into parts of about equal size."""
    fields = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    names = [f"o{i}" for i in range(len(order))]
    chosen = df.select(*fields).orderBy(F.xxhash64(*names)).limit(sample).orderBy(*names).collect()
    cuts = [chosen[len(chosen) * i // ranges] for i in range(1, ranges) if chosen]
    return [c for i, c in enumerate(cuts) if i == 0 or c != cuts[i - 1]]


def range_of(df: DataFrame, order: list[str], cuts: list[Row]) -> Column:
    """The range of a row: how many of the splitters are not behind it."""
    if not cuts:
        return F.lit(0)
    types = [df.schema[c].dataType for c in order]
    bounds = F.array(*[F.struct(*[F.lit(v).cast(t).alias(f"o{i}") for i, (v, t) in enumerate(zip(cut, types, strict=True))]) for cut in cuts])
    return F.size(F.filter(bounds, lambda b: b <= _position(order)))


def numbered(df: DataFrame, order: str | list[str], place: str, ranges: int = RANGES) -> DataFrame:
    """Adds each row's place from 0 in ``order``.

    Ties are told apart by a hash of all columns, so rows are numbered the same
    way at each run unless they are equal in everything.
    """
    order = [order] if isinstance(order, str) else list(order)
    tied = df.withColumn("_tie", F.xxhash64(*df.columns))
    order = [*order, "_tie"]
    dealt = tied.withColumn("_range", range_of(tied, order, splitters(tied, order, ranges)))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shifts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    rows = dealt.withColumn("_row", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1).join(F.broadcast(shifts), "_range")
    return rows.withColumn(place, (F.col("_row") + F.col("_shift")).cast("long")).drop("_range", "_row", "_shift", "_tie")


def scan(df: DataFrame, key: str, order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, lags: dict[str, Column] | None = None, ranges: int = RANGES) -> DataFrame:
    """``df`` with running values over the rows of its key in ``order``, as windows over the key would give them.

    ``sums``: the sum up to and with the row. ``lasts``: the last value that is not
    null, up to and with the row. ``lags``: the value of the row before, null for
    the key's first. ``key`` and ``order`` name columns; rows without key are a key.
    """
    sums, lasts, lags = sums or {}, lasts or {}, lags or {}
    position = [key, *order]
    cuts = splitters(df, position, ranges)
    dealt = df.withColumn("_range", range_of(df, position, cuts))
    within = Window.partitionBy(key, "_range").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns(
        {f"_s_{n}": F.sum(c).over(upto) for n, c in sums.items()}
        | {f"_l_{n}": F.last(c, ignorenulls=True).over(upto) for n, c in lasts.items()}
        | {f"_g_{n}": F.lag(c).over(within) for n, c in lags.items()}
        | ({"_first": F.row_number().over(within) == 1} if lags else {})
    )
    names = [f"_s_{n}" for n in sums] + [f"_l_{n}" for n in lasts] + [f"_g_{n}" for n in lags] + (["_first"] if lags else []) + ["_range"]
    if not cuts:
        return out.withColumns({n: F.col(f"_{kind}_{n}") for kind, group in (("s", sums), ("l", lasts), ("g", lags)) for n in group}).drop(*names)
    kind = df.schema[key].dataType
    keys = {cut[0] for cut in cuts}
    split = reduce(lambda a, b: a | b, [F.col(key).eqNullSafe(F.lit(k).cast(kind)) for k in keys])
    at = F.struct(*order)
    ends = dealt.filter(split).groupBy(key, "_range").agg(
        *[F.sum(c).alias(f"_cs_{n}") for n, c in sums.items()],
        *[F.max_by(c, F.when(c.isNotNull(), at)).alias(f"_cl_{n}") for n, c in lasts.items()],
        *[F.max_by(F.struct(c.alias("v")), at).alias(f"_cg_{n}") for n, c in lags.items()],
    )  # for each of fewer than ``ranges`` keys a row for each range
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        F.col(key).alias("_scan_key"), F.col("_range").alias("_scan_range"),
        *[F.sum(f"_cs_{n}").over(earlier).alias(f"_cs_{n}") for n in sums],
        *[F.last(f"_cl_{n}", ignorenulls=True).over(earlier).alias(f"_cl_{n}") for n in lasts],
        *[F.last(f"_cg_{n}").over(earlier).alias(f"_cg_{n}") for n in lags],
    )
    met = out.join(F.broadcast(carried), F.col(key).eqNullSafe(F.col("_scan_key")) & (F.col("_range") == F.col("_scan_range")), "left")
    found = {n: F.when(F.col(f"_s_{n}").isNull(), F.col(f"_cs_{n}")).otherwise(F.col(f"_s_{n}") + F.coalesce(F.col(f"_cs_{n}"), F.lit(0))) for n in sums}
    found |= {n: F.coalesce(f"_l_{n}", f"_cl_{n}") for n in lasts}
    found |= {n: F.when(F.col("_first"), F.col(f"_cg_{n}.v")).otherwise(F.col(f"_g_{n}")) for n in lags}
    return met.withColumns(found).drop(*names, "_scan_key", "_scan_range", *[f"_c{k}_{n}" for k, group in (("s", sums), ("l", lasts), ("g", lags)) for n in group])
