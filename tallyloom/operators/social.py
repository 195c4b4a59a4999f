"""Social choice on edge tables (prompt_id, k, i, j, p)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scores(p: DataFrame) -> DataFrame:
    """J1, J1b, J2, J3, J3b in one aggregate: every score of every response."""
    total = F.round(F.sum("p"), 9)  # sums of thirds in any order are one number, so ties stay ties
    win, tie = F.sum((F.col("p") > 0.5).cast("int")), F.sum((F.col("p") == 0.5).cast("int"))
    return p.groupBy("prompt_id", "i").agg(
        F.first("k").alias("k"), total.alias("borda"), (total + 0.5).alias("borda_diag"), ((total + 0.5) / F.first("k")).alias("effective"),
        (win + 0.5 * tie).alias("copeland"), win.alias("copeland_strict"), (F.min("p") > 0.5).alias("is_condorcet"),
    )


def rank(df: DataFrame, score: str, name: str) -> DataFrame:
    """0 is best, ties by index."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.desc(score), "i")) - 1)


def winners(p: DataFrame) -> DataFrame:
    """Per prompt the Borda, Copeland, Condorcet and pairwise winners and whether Borda agrees."""
    s = scores(p)
    first = lambda c: F.max_by("i", F.struct(F.col(c), -F.col("i")))  # noqa: E731  first argmax
    w = s.groupBy("prompt_id").agg(F.first("k").alias("k"), first("borda").alias("borda_winner"), first("copeland").alias("copeland_winner"), F.max(F.when(F.col("is_condorcet"), F.col("i"))).alias("condorcet_winner"))
    w = w.withColumn("pairwise_winner", F.coalesce("condorcet_winner", "copeland_winner"))
    return w.withColumns({"agrees": F.col("borda_winner") == F.col("pairwise_winner"), "no_condorcet": F.col("condorcet_winner").isNull()})


def inflation(p: DataFrame) -> DataFrame:
    """Copeland rank less Borda rank."""
    r = rank(rank(scores(p), "borda", "borda_rank"), "copeland", "copeland_rank")
    return r.select("prompt_id", "i", "borda_rank", "copeland_rank", (F.col("copeland_rank") - F.col("borda_rank")).alias("inflation"))
