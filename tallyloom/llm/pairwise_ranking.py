"""One global ranking from pairwise comparisons (problem 5).

Robust absolute-loss ranking: every pair of items that met gives a log-odds margin ln((wins + p) / (losses + 1 - p));
strengths minimise the weighted sum of absolute residuals plus a weak quadratic prior that anchors components which
never met each other. Iteratively reweighted least squares: each round solves a Laplacian system whose edge weights are
divided by the last residual, so edges that contradict the rest lose their say. The one vote that smooths a margin is
split by p, the chance of winning at the strengths of the pass before (1/2 in the first), so that pairs which met once
or twice do not pull strong items towards the middle.

Votes are reduced to one row a pair before anything else (map-side combine, so a hot item or annotator is no problem).
Up to ``dense_items`` items (a documented bound: a matrix of 2000 x 2000 doubles, 32 MB) are solved on the driver; above
it the same systems, to the same stopping rules, by conjugate gradients whose vectors are DataFrames.

Defined cases: votes with a NULL side, a name that is no item, one item on both sides or no recorded outcome are left
out; a vote delivered again (same annotator, time, sides and outcome) counts once, where the annotator is known; items
that never met anyone get strength 0; ties in strength rank by item id; no votes at all give every item strength 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import squash
from tallyloom.session import cut, table

DENSE_ITEMS = 2000
PRIOR = 0.01
PASSES = 12
ROUNDS = 40
EPS = 1e-3


def item_key(c: Column) -> Column:
    """An item's name however it is typed: letters and digits, lower case."""
    return squash(c)


def votes_from(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(chosen, reject, label, annotator_id, created_at) + items(item_id, item_name) -> (winner, loser) of each vote."""
    names = items.select(item_key(F.col("item_name")).alias("key"), F.col("item_id").cast("bigint").alias("item_id")).where("key <> ''").groupBy("key").agg(F.min("item_id").alias("item_id"))
    side = lambda n: names.select(F.col("key").alias(f"{n}_key"), F.col("item_id").alias(n))
    v = pairs.where(F.col("label").isin(0, 1)).withColumns({"c_key": item_key(F.col("chosen")), "r_key": item_key(F.col("reject"))})
    v = v.join(side("c"), "c_key").join(side("r"), "r_key").where("c <> r")
    known = v.where(F.col("annotator_id").isNotNull() & F.col("created_at").isNotNull()).select("annotator_id", "created_at", "c", "r", "label").distinct()
    blank = v.where(F.col("annotator_id").isNull() | F.col("created_at").isNull())
    v = known.select("c", "r", "label").unionByName(blank.select("c", "r", "label"))
    won = F.col("label") == 1
    return v.select(F.when(won, F.col("c")).otherwise(F.col("r")).alias("winner"), F.when(won, F.col("r")).otherwise(F.col("c")).alias("loser"))


def tallies(votes: DataFrame) -> DataFrame:
    """(winner, loser) -> (i, j, n, a) for i < j: comparisons and how many of them i won."""
    i, j = F.least("winner", "loser"), F.greatest("winner", "loser")
    return votes.groupBy(i.alias("i"), j.alias("j")).agg(F.count("*").alias("n"), F.sum((F.col("winner") < F.col("loser")).cast("bigint")).alias("a"))


def solve_dense(items: list[int], edges: list[tuple[int, int, int, int]], prior: float = PRIOR, passes: int = PASSES, rounds: int = ROUNDS, eps: float = EPS) -> np.ndarray:
    """Strengths in the order of items; edges are (i, j, comparisons, won by i)."""
    at, size = {x: k for k, x in enumerate(items)}, len(items)
    if not edges or not size:
        return np.zeros(size)
    p, q = np.array([at[e[0]] for e in edges]), np.array([at[e[1]] for e in edges])
    n, a = np.array([e[2] for e in edges], float), np.array([e[3] for e in edges], float)
    x = np.zeros(size)
    for _ in range(passes):
        chance = 1 / (1 + np.exp(x[q] - x[p]))
        won, lost = a + chance, n - a + 1 - chance
        y, w = np.log(won / lost), np.sqrt(won * lost / (won + lost))
        start, u = x, w * w  # the first round of a pass is plain weighted least squares
        for _ in range(rounds):
            lap, rhs = np.diag(np.full(size, prior)), np.zeros(size)
            np.add.at(lap, (p, p), u), np.add.at(lap, (q, q), u), np.add.at(lap, (p, q), -u), np.add.at(lap, (q, p), -u)
            np.add.at(rhs, p, u * y), np.add.at(rhs, q, -u * y)
            last, x = x, np.linalg.solve(lap, rhs)
            u = w / np.maximum(np.abs(y - (x[p] - x[q])), eps)
            if np.max(np.abs(x - last)) < 1e-6:
                break
        if np.max(np.abs(x - start)) < 1e-3:
            break
    return x


def solve_distributed(items: DataFrame, edges: DataFrame, prior: float = PRIOR, passes: int = PASSES, rounds: int = ROUNDS, eps: float = EPS, steps: int = 10_000, tol: float = 1e-18) -> DataFrame:
    """items(item), edges(i, j, n, a) -> (item, x): the same passes, rounds and stopping rules as solve_dense; each system
    by Jacobi-preconditioned conjugate gradients until its residual is ``tol`` of what it was (or ``steps``)."""

    def moved(new: DataFrame, old: DataFrame) -> float:
        return new.join(old.withColumnRenamed("x", "old"), "item").agg(F.max(F.abs(F.col("x") - F.col("old")))).first()[0] or 0.0

    x = cut(items.select("item", F.lit(0.0).alias("x")))
    for _ in range(passes):
        xi, xj = x.select(F.col("item").alias("i"), F.col("x").alias("xi")), x.select(F.col("item").alias("j"), F.col("x").alias("xj"))
        chance = 1 / (1 + F.exp(F.col("xj") - F.col("xi")))
        won, lost = F.col("a") + chance, F.col("n") - F.col("a") + 1 - chance
        start = x
        fixed = cut(edges.join(xi, "i").join(xj, "j").select("i", "j", F.log(won / lost).alias("y"), F.sqrt(won * lost / (won + lost)).alias("w")))
        for k in range(rounds):
            xi, xj = x.select(F.col("item").alias("i"), F.col("x").alias("xi")), x.select(F.col("item").alias("j"), F.col("x").alias("xj"))
            off = F.greatest(F.abs(F.col("y") - F.col("xi") + F.col("xj")), F.lit(eps))
            e = fixed.join(xi, "i").join(xj, "j").select("i", "j", "y", (F.col("w") * F.col("w") if k == 0 else F.col("w") / off).alias("u"))
            last, x = x, _solve(items, e, x, prior, steps, tol)
            if moved(x, last) < 1e-6:
                break
        if moved(x, start) < 1e-3:
            break
    return x


def _solve(items: DataFrame, e: DataFrame, x: DataFrame, prior: float, steps: int, tol: float) -> DataFrame:
    """One Laplacian system over e(i, j, y, u), started at x."""
    e = cut(e)
    half = e.select(F.col("i").alias("item"), F.col("j").alias("other"), "u", (F.col("u") * F.col("y")).alias("b"))
    both = cut(half.union(e.select(F.col("j"), F.col("i"), F.col("u"), -F.col("u") * F.col("y"))))
    node = both.groupBy("item").agg((F.sum("u") + prior).alias("d"), F.sum("b").alias("b"))

    def times(v: DataFrame, col: str) -> DataFrame:
        s = both.join(v.select(F.col("item").alias("other"), F.col(col).alias("v_other")), "other").groupBy("item").agg(F.sum(F.col("u") * F.col("v_other")).alias("off"))
        return v.join(s, "item", "left").withColumn("av", F.col("d") * F.col(col) - F.coalesce("off", F.lit(0.0))).drop("off")

    base = items.join(node, "item", "left").select("item", F.coalesce("d", F.lit(prior)).alias("d"), F.coalesce("b", F.lit(0.0)).alias("b"))
    s = times(base.join(x, "item"), "x").withColumn("r", F.col("b") - F.col("av"))
    s = cut(s.select("item", "d", "x", "r", (F.col("r") / F.col("d")).alias("p")))
    rz = s.agg(F.sum(F.col("r") * F.col("r") / F.col("d"))).first()[0] or 0.0
    enough = max(rz * tol, 1e-24)
    for _ in range(steps):
        if rz < enough:
            break
        t = cut(times(s, "p"))
        alpha = rz / t.agg(F.sum(F.col("p") * F.col("av"))).first()[0]
        t = t.select("item", "d", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("av")).alias("r"), "p")
        new = t.agg(F.sum(F.col("r") * F.col("r") / F.col("d"))).first()[0]
        s = cut(t.select("item", "d", "x", "r", (F.col("r") / F.col("d") + (new / rz) * F.col("p")).alias("p")))
        rz = new
    return s.select("item", "x")


def rank(items: DataFrame, votes: DataFrame, dense_items: int = DENSE_ITEMS) -> DataFrame:
    """items(item_id), votes(winner, loser) -> (item_id, strength, comparisons, rank) of every item."""
    spark = items.sparkSession
    ids = items.select(F.col("item_id").cast("bigint").alias("item")).where("item is not null").distinct()
    e = cut(tallies(votes))
    if (n := ids.count()) <= dense_items:
        order = sorted(r[0] for r in ids.collect())
        x = solve_dense(order, [tuple(r) for r in e.select("i", "j", "n", "a").orderBy("i", "j").collect()])
        strength = spark.createDataFrame([(k, float(v)) for k, v in zip(order, x)], "item bigint, x double")
    else:
        strength = solve_distributed(ids, e)
    met = e.select(F.explode(F.array("i", "j")).alias("item"), "n").groupBy("item").agg(F.sum("n").alias("n"))
    out = strength.join(met, "item", "left").select(F.col("item").cast("int").alias("item_id"), F.round("x", 6).alias("strength"), F.coalesce("n", F.lit(0)).alias("comparisons"))
    # Ranked inside ranges of strength and offset by the ranges' counts, so that no task sorts all items.
    out = out.withColumn("range", F.floor(-F.col("strength") * 64).cast("int"))
    n_in = out.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a few thousand ranges
    start = n_in.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(F.desc("strength"), "item_id"))
    return out.withColumn("inside", inside).join(start, "range").select("item_id", "strength", "comparisons", (F.col("start") + F.col("inside")).cast("int").alias("rank"))


def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "custom_test_data", "chosen", "reject", "label", "annotator_id", "created_at")
    items = table(spark, sf_dir, "arena_items", "item_id", "item_name")
    return rank(items, votes_from(pairs, items))
