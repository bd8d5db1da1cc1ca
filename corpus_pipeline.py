"""The corpus pipeline: five stages, each over all documents that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet to the shared folder and hands the reread table to the next. All but the
last return the columns of ``documents``.

Stages map nulls, empty texts and empty tables as their operators do (see their
modules): documents without words fail the quality rules, so later stages see
none; the line stage may leave an empty text, of which the next stage keeps one.
Rows without doc_id cannot be members of a group and go through all stages; rows
that repeat a doc_id are judged, cleaned and mixed each for itself, and near-dedup
takes them as one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import line_spread, mixing, packing, robust_outliers, simhash
from quillon.llm.common import materialize, table
from quillon.llm.queries import vocabulary

#: Near duplicates share word shingles of this many words.
SHINGLE_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no robust outliers of their language and source."""
    return robust_outliers.keep_inliers(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that many sources share; the first place of such a line keeps it."""
    return line_spread.remove_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every near-duplicate group."""
    return simhash.keep_one(docs, SHINGLE_WORDS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the capped mix of their sources takes them."""
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of context windows."""
    return packing.pack(docs, vocabulary())


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: Tokens and verified shingle sets have no SQL form; every stage is tested against a brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
