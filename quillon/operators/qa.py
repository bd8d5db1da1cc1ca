"""Question chains: dedup, top-k, context, and the best answer of each chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedup_questions(df: DataFrame, group: str, order: list[str], question: str = "question", prior: DataFrame | None = None) -> DataFrame:
    """The first of each question in a group, compared trimmed and in lower case; empty ones and those in ``prior(group, question)`` go."""
    key = F.lower(F.trim(question))
    keyed = df.withColumn("_key", key).filter(F.col("_key") != "")
    if prior is not None:
        seen = prior.select(F.col(group), F.lower(F.trim(question)).alias("_key")).distinct()
        keyed = keyed.join(seen, [group, "_key"], "left_anti")
    first = Window.partitionBy(group, "_key").orderBy(*order)
    return keyed.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_key")


def top_k(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark limits each task's share of a group before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def best_answer(df: DataFrame, chain: list[str], position: str, confidence: str = "confidence") -> DataFrame:
    """The most confident row of each chain (missing counts as 0), the first on ties."""
    order = [F.coalesce(confidence, F.lit(0.0)).desc(), F.col(position).asc()]
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*chain).orderBy(*order)))
    return ranked.filter("_n = 1").drop("_n")


def pair_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): user turns and the assistant turn that follows at once, else null."""
    after = Window.partitionBy("conv_id").orderBy("turn")
    following = F.struct(F.lead("role").over(after).alias("role"), F.lead("text").over(after).alias("text"))
    paired = turns.withColumn("_next", following).filter("role = 'user'")
    return paired.select("conv_id", "turn", F.col("text").alias("question"), F.when(F.col("_next.role") == "assistant", F.col("_next.text")).alias("answer"))


def last_context(df: DataFrame, group: str, order: str, value: str, n: int) -> DataFrame:
    """Adds ``context``: the values of up to ``n`` rows before this one."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(-n, -1)
    return df.withColumn("context", F.collect_list(value).over(before))


def answers_for(questions: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Questions with their answers, null where there is none."""
    return questions.join(answers, keys, "left")
