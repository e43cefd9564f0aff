"""Update join of retried labels, comparison of two labels, and the joins that evaluation needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast once they have been counted; beyond it Spark shuffles.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint after counting up to ``limit`` rows; a larger side is left to a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def last_of(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): of each key the value of the last row by ``order``; null and empty keys are dropped."""
    rows = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return rows.groupBy(key).agg(F.max_by(F.struct(value), order).alias("__last")).select(key, F.col(f"__last.{value}").alias(value))


def update_join(original: DataFrame, retried: DataFrame, key: str = "session_id", value: str = "labels_agentic", order: str = "seq") -> DataFrame:
    """``original`` with ``value`` taken from ``retried`` wherever the key is there, be it null; ``merged`` marks those rows.

    Every row of ``original`` stays once, repeated keys are all updated, and of repeated keys in
    ``retried`` the last row counts.
    """
    new = last_of(retried, key, value, order).select(F.col(key).alias("__key"), F.col(value).alias("__new"), F.lit(True).alias("merged"))
    rows = original.join(broadcast_if_small(new), F.col(key) == F.col("__key"), "left").withColumn("merged", F.coalesce("merged", F.lit(False)))
    return rows.withColumn(value, F.when(F.col("merged"), F.col("__new")).otherwise(F.col(value))).drop("__key", "__new")


def merge_report(original: DataFrame, retried: DataFrame, key: str = "session_id", value: str = "labels_agentic", order: str = "seq") -> DataFrame:
    """(merged, unchanged, not_found): rows of the update join, and retried keys that ``original`` lacks."""
    counts = update_join(original, retried, key, value, order).agg(F.count_if("merged").alias("merged"), F.count_if(~F.col("merged")).alias("unchanged"))
    lost = last_of(retried, key, value, order).join(original.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("not_found"))
    return counts.crossJoin(F.broadcast(lost))  # one row each


def errored(rows: DataFrame) -> DataFrame:
    """Sessions sent to the first reviewer that have no verdict of it: those to try again."""
    return rows.where(F.col("sent_to_hunter") & F.col("hunter_verdict").isNull())


def label_comparison(rule_level: Column, rule_tactic: Column, agent_level: Column, agent_tactic: Column) -> dict[str, Column]:
    """Flags of agreement: tactics in lower case, not trimmed; null where the second label lacks the part."""
    said = F.lower(F.coalesce(agent_tactic, F.lit("")))
    return {
        "tactics_agree": F.when(said != "", F.lower(F.coalesce(rule_tactic, F.lit(""))) == said),
        "levels_agree": F.when(F.coalesce(agent_level, F.lit(0)) != 0, F.coalesce(rule_level == agent_level, F.lit(False))),
        "rule_level": rule_level, "agent_level": agent_level, "level_difference": F.abs(rule_level - agent_level),
    }
