"""Preference matrices as long edge tables (prompt, i, j, p), off the diagonal only (DM9, DM10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.views import DIMS, mean_of, pairs


def majority(e: DataFrame) -> DataFrame:
    """Share of mutually rated dimensions that i wins, ties 1/2; no such dimension gives 1/2."""
    step = [(F.signum((F.col(f"a.{d}") - F.col(f"b.{d}")).cast("double")) + 1) / 2 for d in DIMS]
    return pairs(e, "k").select("prompt_id", "k", F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), F.coalesce(mean_of(step), F.lit(0.5)).alias("p"))


def average_step(e: DataFrame) -> DataFrame:
    """1, 1/2 or 0 by the average score."""
    return pairs(e, "k").select("prompt_id", "k", F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), ((F.signum(F.col("a.avg") - F.col("b.avg")) + 1) / 2).alias("p"))


def win_counts(outcomes: DataFrame) -> DataFrame:
    """Directed counts (prompt, winner, loser, n)."""
    return outcomes.groupBy("prompt", "winner", "loser").agg(F.count("*").alias("n"))


def both_ways(counts: DataFrame) -> DataFrame:
    """Unordered pairs with the wins of either side: (prompt, a, b, ab, ba), a < b in text order. One shuffle."""
    up = F.col("winner") < F.col("loser")
    g = counts.groupBy("prompt", F.least("winner", "loser").alias("a"), F.greatest("winner", "loser").alias("b"))
    return g.agg(F.sum(F.when(up, F.col("n")).otherwise(0)).alias("ab"), F.sum(F.when(up, 0).otherwise(F.col("n"))).alias("ba"))


def class_matrix(p: DataFrame, classes: DataFrame) -> DataFrame:
    """p(prompt_id, i, j, p, class_i, class_j) averaged by class pair on the whole grid; diagonal and empty cells 1/2."""
    g = p.groupBy("class_i", "class_j").agg(F.avg("p").alias("m"), F.count("*").alias("n"))
    grid = classes.select(F.col("class").alias("class_i")).crossJoin(F.broadcast(classes.select(F.col("class").alias("class_j"))))  # a fixed list of classes
    value = F.when(F.col("class_i") == F.col("class_j"), 0.5).otherwise(F.coalesce("m", F.lit(0.5)))
    return grid.join(F.broadcast(g), ["class_i", "class_j"], "left").select("class_i", "class_j", value.alias("p"), F.coalesce("n", F.lit(0)).alias("n"))
