"""Preference pairs and groups from rated responses (2.5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.sampling import running
from tallyloom.plans.views import DIMS, pairs

#: The dimensions on which A beats B, B beats C and C beats A.
CYCLE_CONFIGS = {
    "Cyclic_1": ("honesty", "truthfulness", "helpfulness"),
    "Cyclic_2": ("instruction_following", "truthfulness", "helpfulness"),
    "Cyclic_3": ("instruction_following", "honesty", "helpfulness"),
    "Cyclic_4": ("instruction_following", "honesty", "truthfulness"),
}
_SHORT = {n: k for k, n in DIMS.items()}


def dimension_pairs(e: DataFrame, min_margin: int = 2, strict: bool = False) -> DataFrame:
    """Every dimension's ordered pairs whose ratings are both valid and min_margin apart."""
    dims = F.explode(F.array(*(F.struct(F.lit(n).alias("dimension"), F.col(f"a.{d}").alias("si"), F.col(f"b.{d}").alias("sj")) for d, n in DIMS.items())))
    p = pairs(e).select("prompt_id", F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), dims.alias("x")).select("prompt_id", "i", "j", "x.*")
    gap = F.col("si") - F.col("sj")
    return p.where(gap > min_margin if strict else gap >= min_margin).withColumn("margin", F.col("si") - F.col("sj"))


def averaged_pairs(e: DataFrame) -> DataFrame:
    """Pairs by average score, ties in both directions with margin 0."""
    return pairs(e).where("a.avg >= b.avg").select("prompt_id", F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), (F.col("a.avg") - F.col("b.avg")).alias("margin"))


def conflict_free(p: DataFrame) -> DataFrame:
    """Drop (i, j) where (j, i) exists in any dimension; both directions go. One window on the pair, no self-join."""
    w = Window.partitionBy("prompt_id", F.least("i", "j"), F.greatest("i", "j"))
    up = F.col("i") < F.col("j")
    q = p.withColumns({"ups": F.sum(up.cast("int")).over(w), "all": F.count("*").over(w)})
    return q.where((F.col("ups") == 0) | (F.col("ups") == F.col("all"))).drop("ups", "all")


def conflicts(p: DataFrame) -> DataFrame:
    """E5: unordered pairs with both directions."""
    g = p.groupBy("prompt_id", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).agg(F.sum((F.col("i") < F.col("j")).cast("int")).alias("ups"), F.count("*").alias("n"))
    return g.agg(F.count_if((F.col("ups") > 0) & (F.col("ups") < F.col("n"))).alias("conflicts"), F.count("*").alias("pairs"))


def cyclic_triples(e: DataFrame, min_margin: int = 0) -> DataFrame:
    """Every ordered triple with A over B on m1, B over C on m2 and C over A on m3, for each configuration; all three
    ratings of all three are valid. Triples come from the prompt's own array, so nothing is joined; only the pairs with a
    first leg meet a third response, and each carries the configurations that it still fits."""
    gap = lambda x, y, d: F.col(f"{x}.{_SHORT[d]}") - F.col(f"{y}.{_SHORT[d]}") > min_margin
    valid = lambda x, m: [F.col(f"{x}.{_SHORT[d]}").isNotNull() for d in m]
    all_ = lambda cs: reduce(lambda p, q: p & q, cs)
    legs = F.array_compact(F.array(*(F.when(all_([gap("a", "b", m[0]), *valid("a", m), *valid("b", m)]), F.lit(n)) for n, m in CYCLE_CONFIGS.items())))
    t = e.where(F.size("rs") >= 3).select("prompt_id", "rs", F.explode("rs").alias("a")).select("prompt_id", "rs", "a", F.explode("rs").alias("b")).where("a.idx <> b.idx")
    t = t.withColumn("fits", legs).where(F.size("fits") > 0)
    t = t.select("prompt_id", "a", "b", "fits", F.explode("rs").alias("c")).where("c.idx <> a.idx and c.idx <> b.idx")
    closed = F.array_compact(F.array(*(F.when(all_([F.array_contains("fits", n), gap("b", "c", m[1]), gap("c", "a", m[2]), *valid("c", m)]), F.struct(F.lit(n).alias("name"), F.array(*(F.lit(d) for d in m)).alias("dims"), F.array(F.col(f"a.{_SHORT[m[0]]}") - F.col(f"b.{_SHORT[m[0]]}"), F.col(f"b.{_SHORT[m[1]]}") - F.col(f"c.{_SHORT[m[1]]}"), F.col(f"c.{_SHORT[m[2]]}") - F.col(f"a.{_SHORT[m[2]]}")).alias("margins"))) for n, m in CYCLE_CONFIGS.items())))
    return t.select("prompt_id", F.col("a.idx").alias("a"), F.col("b.idx").alias("b"), F.col("c.idx").alias("c"), F.explode(closed).alias("x")).select("prompt_id", "a", "b", "c", F.col("x.name").alias("cycle_config"), "x.dims", "x.margins")


def cyclic_pairs(triples: DataFrame) -> DataFrame:
    """Three rows for each cycle, with the dimension and margin of each leg."""
    legs = F.explode(F.array(*(F.struct(F.col(x).alias("chosen"), F.col(y).alias("rejected"), F.get("dims", F.lit(k)).alias("dimension"), F.get("margins", F.lit(k)).alias("margin")) for k, (x, y) in enumerate(("ab", "bc", "ca")))))
    return triples.select("prompt_id", "cycle_config", legs.alias("p")).select("prompt_id", "cycle_config", "p.chosen", "p.rejected", "p.dimension", "p.margin")


def grouped(p: DataFrame) -> DataFrame:
    """One entry a prompt with its comparisons in a fixed order."""
    return p.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("dimension", "i", "j", "margin"))).alias("comparisons"), F.count("*").alias("num_comparisons"))


def flatten_offsets(sizes: DataFrame, order: str, size: str) -> DataFrame:
    """Running offset of each entry's first response, in the order of a numeric key."""
    return running(sizes, order, size, "offset")
