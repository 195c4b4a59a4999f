"""Preference scores and losses as Column expressions (2.7): stable at extremes, and computed once a row before any pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(x: Column | str) -> Column:
    x = col(x)
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softplus(x: Column | str) -> Column:
    x = col(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def clip(x: Column, eps: float) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1 - eps), x))


def logit(x: Column, eps: float) -> Column:
    return F.log(clip(x, eps) / (1 - clip(x, eps)))


def turned(v: Column) -> Column:
    """J(v) = (-v1, v0, -v3, v2, ...): with it the skew score is a dot product."""
    return F.transform(v, lambda x, k: F.when(k % 2 == 0, -F.get(v, k + 1)).otherwise(F.get(v, k - 1)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def skew(v: Column, w: Column) -> Column:
    """H3: sum over blocks of v0 w1 - v1 w0 (H2 is one block)."""
    return dot(turned(v), w)


def gate(v: Column, scale: Column) -> Column:
    """H4, Z3: block weights, the softmax of the even components, one weight for both of a block; scale d/2 or 1."""
    head = F.transform(F.filter(v, lambda x, k: k % 2 == 0), F.exp)
    total = F.aggregate(head, F.lit(0.0), lambda s, x: s + x)
    return F.transform(v, lambda x, k: scale * F.get(head, F.floor(k / 2).cast("int")) / total)


def unit(v: Column) -> Column:
    """The vector at length 1."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))


def candidate_pairs(vectors: DataFrame) -> DataFrame:
    """H6: (prompt_id, i, j, ri, rj, vi, s2, s, sg) of all ordered candidate pairs. One shuffle gathers a prompt's few
    candidates; J(v) and the gates are made once for each of them."""
    v = F.col("v")
    one = vectors.withColumns({"jv": turned(v), "gv": F.zip_with(gate(v, F.size(v) / 2), turned(v), lambda g, x: g * x)})
    g = one.groupBy("prompt_id").agg(F.collect_list(F.struct("idx", "reward", "v", "jv", "gv")).alias("rs"))
    p = g.select("prompt_id", "rs", F.explode("rs").alias("a")).select("prompt_id", "a", F.explode("rs").alias("b")).where("a.idx <> b.idx")
    return p.select("prompt_id", F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), F.col("a.reward").alias("ri"), F.col("b.reward").alias("rj"), F.col("a.v").alias("vi"), dot(F.slice("a.jv", 1, 2), F.slice("b.v", 1, 2)).alias("s2"), dot(F.col("a.jv"), F.col("b.v")).alias("s"), dot(F.col("a.gv"), F.col("b.v")).alias("sg"))


def logistic(x: Column, tau: float = 1.0) -> Column:
    """L1 and its kin: softplus(-x / tau)."""
    return softplus(-x / tau)


def regression(x: Column, tau: float = 1.0, target: float = 10.0) -> Column:
    """L2 and its kin: half the squared distance of x / tau from the target."""
    return 0.5 * F.pow(x / tau - target, F.lit(2))
