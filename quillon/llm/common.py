"""Shared helpers of the training-data operators.

Everything here keeps rows on the executors: intermediate tables go to the
folder that the cluster names in ``spark.checkpoint.dir`` (which driver and
executors share), never to a machine's own disk.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that separate words, as a character class of regular expressions.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; on one machine (tests) one of our own if none is set."""
    sc = spark.sparkContext
    configured = sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="quillon-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(f"file://{own}")
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage as ``checkpoint()`` does, but keeps the columns
    prunable and compressed; a lost executor costs nothing, as the files are
    not on it. The tables live as long as the checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+")
    return F.filter(parts, lambda w: w != "")


def with_slot(df: DataFrame, key: str, order: list[str], slot: str = "slot", pieces: int = 64) -> DataFrame:
    """Number the rows of each ``key`` from 0 without gaps.

    A key's rows are dealt to ``pieces`` pieces by a hash of the order columns,
    each piece is numbered alone and shifted by the sizes of the pieces before
    it. So a key with most of the rows still spreads over many tasks.
    """
    dealt = df.withColumn("_piece", F.pmod(F.xxhash64(*order), F.lit(pieces)))
    sizes = dealt.groupBy(key, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(key, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(key, "_piece").orderBy(*order)
    return (
        dealt.withColumn("_row", F.row_number().over(within) - 1)
        .join(shifts, [key, "_piece"])
        .withColumn(slot, (F.col("_row") + F.col("_shift")).cast("long"))
        .drop("_piece", "_row", "_shift")
    )


#: A key with so many rows, and at least one in a thousand of all, is hot.
HOT_ROWS, HOT_SHARE = 100_000, 1000


def join_counted(rows: DataFrame, side: DataFrame, keys: list[str], count: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with the columns of ``side``, a materialised table of one row for each key and the ``count`` of its rows.

    Hot keys, a thousand at most, are broadcast, so that their rows stay where
    they are; the rest meet by a shuffle.
    """
    total = side.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) >= max(hot_rows, total // HOT_SHARE)
    hot = side.filter(is_hot).drop(count)
    if hot.isEmpty():
        return rows.join(side.drop(count), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(side.filter(~is_hot).drop(count), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(others)
