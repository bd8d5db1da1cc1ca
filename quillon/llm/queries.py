"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import fill_middle, line_spread, minhash, mixing, packing, periodic_runs, progressive_jpeg, quality_model, robust_outliers, sharding, simhash, suffix_dedup, url_filter
from quillon.llm.common import table


def vocabulary() -> str:
    """The tokeniser file's place on this box; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive_jpeg.describe(progressive_jpeg.store_texts(table(spark, sf_dir, "documents")))


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_outliers.judge(table(spark, sf_dir, "documents")).drop("lang", "source", "d2")


def op3_shard_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_spread.line_report(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.octet_length(text).cast("long").alias("kept_bytes"), F.md5(text).alias("kept_md5"))


def op5_simhash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_mix_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.withColumn("target", F.round("target", 3))


def op7_suffix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_duplicates(table(spark, sf_dir, "documents")))


def op8_pack_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op9_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_model.score(documents, quality_model.fit(documents, table(spark, sf_dir, "labels")))


def op10_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find_runs(periodic_runs.repeat_tails(table(spark, sf_dir, "documents"))))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.transform(table(spark, sf_dir, "documents")))


def op13_minhash_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op2_robust_outliers": robust_outliers.oracle_sql(), "op7_suffix_intervals": suffix_dedup.oracle_sql(), "op4_line_spread": line_spread.oracle_sql(), "op6_mix_water_filling": mixing.oracle_sql(), "op10_url_vocabulary": url_filter.oracle_sql(), "op11_periodic_runs": periodic_runs.oracle_sql(), "op12_fill_middle": fill_middle.oracle_sql()}
