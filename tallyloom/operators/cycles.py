"""Intransitivity of observed preferences and of complete probability matrices (2.10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conflict_rate(both: DataFrame) -> DataFrame:
    """Per prompt the share of unordered pairs seen both ways, and the truncated count of the dataset rate."""
    g = both.groupBy("prompt").agg(F.count("*").alias("pairs"), F.count_if((F.col("ab") > 0) & (F.col("ba") > 0)).alias("conflicts"))
    g = g.withColumn("directed", F.col("pairs") + F.col("conflicts"))
    return g.withColumn("rate", F.col("conflicts") / F.col("pairs"))


def dataset_conflict_rate(rates: DataFrame) -> DataFrame:
    """N1b, as the quirk has it: an unordered rate is multiplied with directed counts and truncated."""
    return rates.agg((F.sum(F.floor(F.col("rate") * F.col("directed"))) / F.sum("directed")).alias("dataset_rate"))


def directed(both: DataFrame, majority: bool) -> DataFrame:
    """Edges (prompt, x, y): x beats y in the majority, or in any single comparison."""
    up = F.col("ab") > F.col("ba") if majority else F.col("ab") > 0
    down = F.col("ba") > F.col("ab") if majority else F.col("ba") > 0
    legs = F.array(F.when(up, F.struct(F.col("a").alias("x"), F.col("b").alias("y"))), F.when(down, F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    return both.select("prompt", F.explode(F.filter(legs, lambda e: e.isNotNull())).alias("e")).select("prompt", "e.x", "e.y")


def three_cycles(edges: DataFrame) -> DataFrame:
    """3-cycles per prompt, each found once from its smallest node; cycles_raw counts every rotation.

    Wedges z > x, x > y with x the smallest are built on (prompt, x) and closed by (prompt, y, z): two joins on keys."""
    out = edges.where("x < y").select("prompt", F.col("x").alias("s"), F.col("y").alias("m"))
    back = edges.where("y < x").select("prompt", F.col("y").alias("s"), F.col("x").alias("l"))
    wedge = out.join(back, ["prompt", "s"]).where("m <> l")
    close = edges.select("prompt", F.col("x").alias("m"), F.col("y").alias("l"))
    c = wedge.join(close, ["prompt", "m", "l"])
    return c.groupBy("prompt").agg(F.count("*").alias("cycles")).withColumn("cycles_raw", 3 * F.col("cycles"))


def loop_ratio(p: DataFrame) -> DataFrame:
    """N5 on complete matrices: the potential of node i is the mean of its flow over all k nodes, so the least-squares fit
    has a closed form; ratio = 1 - 2 k sum(r^2) / sum(F^2), cut to [0, 1]."""
    node = p.groupBy("prompt_id", "i").agg(F.first("k").alias("k"), (F.sum(F.col("p") - 0.5) / F.first("k")).alias("r"), F.sum((F.col("p") - 0.5) * (F.col("p") - 0.5)).alias("e"))
    g = node.groupBy("prompt_id").agg(F.first("k").alias("k"), (2 * F.first("k") * F.sum(F.col("r") * F.col("r"))).alias("gradient"), F.sum("e").alias("total"))
    ratio = F.when(F.col("total") < 1e-10, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("gradient") / F.col("total"))))
    return g.withColumn("loop_ratio", ratio)


def baseline(p: DataFrame) -> DataFrame:
    """N6 on complete matrices: every edge turned along the potential (nodes level to nine digits lose it), then N5 of the
    result. One aggregate gathers a prompt's nodes; its edges find both potentials there, without a join."""
    node = p.groupBy("prompt_id", "i").agg(F.first("k").alias("k"), F.round(F.sum(F.col("p") - 0.5), 9).alias("r"), F.collect_list(F.struct("j", F.abs(F.col("p") - 0.5).alias("f"))).alias("fs"))
    g = node.groupBy("prompt_id").agg(F.first("k").alias("k"), F.map_from_entries(F.collect_list(F.struct("i", "r"))).alias("rs"), F.collect_list(F.struct("r", "fs")).alias("nodes"))
    zero = F.lit(0.0)
    turned = lambda n: F.aggregate(n["fs"], zero, lambda s, e: s + e["f"] * F.signum(n["r"] - F.try_element_at("rs", e["j"])))
    energy = lambda n: F.aggregate(n["fs"], zero, lambda s, e: s + e["f"] * e["f"] * F.abs(F.signum(n["r"] - F.try_element_at("rs", e["j"]))))
    g = g.withColumns({"q": F.transform("nodes", turned), "e": F.aggregate("nodes", zero, lambda s, n: s + energy(n))})
    grad = 2 / F.col("k") * F.aggregate("q", zero, lambda s, x: s + x * x)
    return g.select("prompt_id", F.when(F.col("e") < 1e-10, 0.0).otherwise(F.greatest(zero, F.least(F.lit(1.0), 1 - grad / F.col("e")))).alias("baseline"))


def adjusted_ratio(p: DataFrame) -> DataFrame:
    """(prompt_id, loop_ratio, baseline, adjusted)."""
    j = loop_ratio(p).select("prompt_id", "loop_ratio").join(baseline(p), "prompt_id")
    rest = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("loop_ratio") - F.col("baseline")) / (1 - F.col("baseline"))))
    return j.withColumn("adjusted", F.when(F.col("baseline") >= 1 - 1e-10, 0.0).otherwise(rest))


def feedback_share(both: DataFrame) -> DataFrame:
    """N12, the corrected variant: items in the order of their majority wins less losses (ties by item), and the share of
    majority edges that point backwards in it. Aggregates and joins on (prompt, item): a prompt's size has no bound."""
    e = directed(both, majority=True)
    net = e.select("prompt", F.explode(F.array(F.struct(F.col("x").alias("item"), F.lit(1).alias("w")), F.struct(F.col("y").alias("item"), F.lit(-1).alias("w")))).alias("z")).groupBy("prompt", F.col("z.item").alias("item")).agg(F.sum("z.w").alias("net"))
    j = e.join(net.select("prompt", F.col("item").alias("x"), F.col("net").alias("nx")), ["prompt", "x"]).join(net.select("prompt", F.col("item").alias("y"), F.col("net").alias("ny")), ["prompt", "y"])
    back = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") > F.col("y")))
    return j.groupBy("prompt").agg((F.count_if(back) / F.count("*")).alias("corrected"))


def rows_of(p: DataFrame) -> DataFrame:
    """(prompt_id, k, m): the matrix of a prompt as an array of rows with 1/2 on the diagonal; prompts are small."""
    row = p.groupBy("prompt_id", "i").agg(F.first("k").alias("k"), F.collect_list(F.struct("j", "p")).alias("xs"))
    full = F.transform(F.array_sort(F.concat("xs", F.array(F.struct(F.col("i").alias("j"), F.lit(0.5).alias("p"))))), lambda x: x["p"])
    g = row.select("prompt_id", "i", "k", full.alias("ps")).groupBy("prompt_id").agg(F.first("k").alias("k"), F.array_sort(F.collect_list(F.struct("i", "ps"))).alias("rows"))
    return g.select("prompt_id", "k", F.transform("rows", lambda r: r["ps"]).alias("m"))


def triples(p: DataFrame, ordered: bool = False) -> DataFrame:
    """(prompt_id, i, j, l, pij, pjl, pil) of i < j < l, or of all ordered triples, from the prompt's matrix: no join."""
    m = rows_of(p).where("k >= 3")
    idx = F.sequence(F.lit(0), F.col("k") - 1)
    t = m.select("prompt_id", "m", "k", F.explode(idx).alias("i")).select("prompt_id", "m", "k", "i", F.explode(idx).alias("j")).where("i <> j" if ordered else "i < j")
    t = t.select("prompt_id", "m", "k", "i", "j", F.explode(idx).alias("l")).where("l <> i and l <> j" if ordered else "j < l")
    return t.select("prompt_id", "i", "j", "l", F.expr("m[i][j]").alias("pij"), F.expr("m[j][l]").alias("pjl"), F.expr("m[i][l]").alias("pil"))


def logit(c, eps: float):
    x = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), c))
    return F.log(x / (1 - x))


def logit_residual(t: DataFrame, eps: float) -> DataFrame:
    """Mean absolute logit(i, j) + logit(j, l) - logit(i, l)."""
    r = F.abs(logit(F.col("pij"), eps) + logit(F.col("pjl"), eps) - logit(F.col("pil"), eps))
    return t.groupBy("prompt_id").agg(F.avg(r).alias("residual"), F.count("*").alias("triples"))


def transitivity_class(p: DataFrame) -> DataFrame:
    """Intransitive if some i > j, j > l but not i > l; else quasi where no response beats all others, else transitive."""
    t = triples(p, ordered=True).where("pij > 0.5 and pjl > 0.5")
    bad = t.groupBy("prompt_id").agg(F.bool_or(F.col("pil") <= 0.5).alias("broken"))
    won = p.groupBy("prompt_id", "i").agg((F.min("p") > 0.5).alias("all_")).groupBy("prompt_id").agg(F.bool_or("all_").alias("condorcet"))
    j = won.join(bad, "prompt_id", "left")
    return j.select("prompt_id", F.when(F.col("broken"), "intransitive").when(~F.col("condorcet"), "quasi").otherwise("transitive").alias("class"))
