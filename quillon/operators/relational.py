"""Time and range joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.ordered import scan


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str, ident: str | None = None) -> DataFrame:
    """``left`` with ``value`` of the last right row of its key that is not later.

    A union and one running last value: no pair is built, and a key with most of
    the rows is many tasks. On equal times right rows come first, and of these
    the greatest value counts. ``ident`` may name a left column that tells rows
    apart; without it rows of one key and moment share a task.
    """
    columns = left.columns
    a = left.select(F.col(key).alias("_k"), F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), (F.col(ident) if ident else F.lit(0)).cast("string").alias("_id"), F.struct(*columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(F.col(key).alias("_k"), F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast("string").alias("_id"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    joined = scan(a.unionByName(b), "_k", ["_t", "_side", "_v", "_id"], lasts={"_known": F.col("_v")}).filter("_side = 1")
    return joined.select("_row.*", F.col("_known").alias(value))


def _level(low: Column, high: Column, width: float) -> Column:
    """How often ``width`` must be doubled to be at least as long as the range."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest((high - low).cast("double") / width, F.lit(1.0)))).cast("int"))


def _cell(at: Column, level: Column | int, width: float) -> Column:
    return F.floor(at.cast("double") / (width * F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)))


def _levels(df: DataFrame, level: str) -> list[int]:
    """The levels that occur: at most one for each doubling of a length."""
    return sorted(r[0] for r in df.select(level).distinct().collect())


def range_join(points: DataFrame, ranges: DataFrame, at: Column, low: Column, high: Column, width: float) -> DataFrame:
    """Pairs with low <= at < high, as an equi-join on cells.

    Cells have several sizes, ``width`` and its doublings. A range uses the size
    that is just as long as itself, so it lies in one or two cells however long it
    is; a point asks in its cell of each size that occurs. Nulls meet nothing.
    """
    sized = ranges.filter(low < high).withColumn("_level", _level(low, high, width))
    cells = sized.withColumn("_cell", F.explode(F.sequence(_cell(low, F.col("_level"), width), _cell(high, F.col("_level"), width))))
    asked = [F.struct(F.lit(k).alias("_level"), _cell(at, k, width).alias("_cell")) for k in _levels(sized, "_level")]
    probes = points.withColumn("_probe", F.explode(F.array(*asked) if asked else F.array().cast("array<struct<_level:int,_cell:bigint>>")))
    probes = probes.withColumns({"_level": F.col("_probe._level"), "_cell": F.col("_probe._cell")}).drop("_probe")
    return probes.join(cells, ["_level", "_cell"]).filter((at >= low) & (at < high)).drop("_level", "_cell")


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: float) -> DataFrame:
    """Pairs of ranges [low, high) that overlap, each once; all columns of both sides, whose names must differ.

    Each range lies in one or two cells of its own size, as in ``range_join``. Of
    two ranges the one of the smaller size asks in the cells of the larger size,
    at most two again, so a range is copied a few times for each size that occurs,
    whatever its length. A pair that meets in two cells counts in the one where
    the overlap begins. Empty ranges and nulls overlap nothing.
    """
    (a, b), (c, d) = left_span, right_span
    one = left.filter(F.col(a) < F.col(b)).withColumn("_own", _level(F.col(a), F.col(b), width))
    two = right.filter(F.col(c) < F.col(d)).withColumn("_own", _level(F.col(c), F.col(d), width))

    def in_cells(df: DataFrame, low: str, high: str, levels: Column) -> DataFrame:
        each = df.withColumn("_level", F.explode(levels))
        return each.withColumn("_cell", F.explode(F.sequence(_cell(F.col(low), F.col("_level"), width), _cell(F.col(high), F.col("_level"), width)))).drop("_own")

    own = F.array(F.col("_own"))
    levels = {"one": _levels(one, "_own"), "two": _levels(two, "_own")}
    above = lambda side, strict: F.filter(F.array(*map(F.lit, levels[side])).cast("array<int>"), lambda k: k > F.col("_own") if strict else k >= F.col("_own"))
    up = in_cells(one, a, b, above("two", False)).join(in_cells(two, c, d, own), ["_level", "_cell"])
    down = in_cells(one, a, b, own).join(in_cells(two, c, d, above("one", True)), ["_level", "_cell"])
    begins = F.greatest(F.col(a).cast("double"), F.col(c).cast("double"))
    meet = (F.col(a) < F.col(d)) & (F.col(c) < F.col(b)) & (_cell(begins, F.col("_level"), width) == F.col("_cell"))
    return up.unionByName(down).filter(meet).drop("_level", "_cell")
