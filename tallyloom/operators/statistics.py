"""Rank statistics, tests and grouped summaries (2.12).

Average ranks over a whole column come from the counts of its distinct values: one aggregate, a running sum over ranges of
those counts, and a join back on the value. No window ever holds the rows themselves, so a column of any length ranks in
parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values are cut into so many ranges for the running sum.
RANGES = 256


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, ties, avg_rank) of the distinct values that are not NULL."""
    v = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("ties"))
    edges = v.agg(F.percentile_approx(F.col(value).cast("double"), [k / RANGES for k in range(1, RANGES)], 10_000).alias("edges"))
    r = v.crossJoin(F.broadcast(edges))  # one row
    r = r.withColumn("range", F.coalesce(F.size(F.filter("edges", lambda e: e < F.col(value).cast("double"))), F.lit(0))).drop("edges")
    per = r.groupBy("range").agg(F.sum("ties").alias("s"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    per = per.select("range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("ties").over(Window.partitionBy("range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = r.withColumn("inside", inside).join(F.broadcast(per), "range")
    return r.select(value, "ties", (F.col("start") + F.col("inside") + (F.col("ties") + 1) / 2).alias("avg_rank"))


def ranked(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the average rank of value among all rows."""
    r = value_ranks(df, value).select(F.col(value).alias("_v"), F.col("avg_rank").alias(name), F.col("ties").alias(f"{name}_ties"))
    return df.join(r, F.col(value) == F.col("_v")).drop("_v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks over the rows where both are given."""
    d = df.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return ranked(ranked(d, x, "rx"), y, "ry").agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """T4, T5: U of the rows whose group is true, the rank-biserial 1 - 2U / (n1 n2), and both p-values by the normal law."""
    d = df.select(value, group).where(F.col(value).isNotNull() & F.col(group).isNotNull())
    r = ranked(d, value, "r")
    g = r.agg(F.sum(F.when(F.col(group), F.col("r"))).alias("r1"), F.count_if(F.col(group)).alias("n1"), F.count_if(~F.col(group)).alias("n2"), F.sum(F.col("r_ties") * F.col("r_ties") - 1).cast("double").alias("ties"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    g = g.select("n1", "n2", u.alias("u"), (1 - 2 * u / F.nullif(F.col("n1") * F.col("n2"), F.lit(0))).alias("rank_biserial"), "ties")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    top = F.greatest(F.col("u"), n1 * n2 - F.col("u"))
    return g.withColumns({"p_two_sided": F.least(F.lit(1.0), 2 * normal_tail(mann_whitney_z(top, n1, n2, F.col("ties")))), "p_greater": normal_tail(mann_whitney_z(F.col("u"), n1, n2, F.col("ties")))})


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """H over the groups, with the correction for ties."""
    d = df.select(value, group).where(F.col(value).isNotNull() & F.col(group).isNotNull())
    r = ranked(d, value, "r")
    # Each row carries its tie size t, so the sum of t^2 - 1 over rows is the sum of t^3 - t over values.
    g = r.groupBy(group).agg(F.sum("r").alias("s"), F.count("*").alias("n"), F.sum(F.col("r_ties") * F.col("r_ties") - 1).alias("t"))
    a = g.agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.sum("n").alias("N"), F.sum("t").alias("t"))
    n = F.col("N").cast("double")
    return a.select(F.col("N").alias("n"), ((12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("t") / (n * n * n - n))).alias("h"))


def cohens_d(x: Column, group: Column) -> Column:
    """Difference of means over the root of the mean of the population variances."""
    a, b = F.when(group, x), F.when(~group, x)
    return (F.avg(a) - F.avg(b)) / F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2)


def kendall_tau_b(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Per key; constant vectors give 0. Pairs come from the key's own array."""
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(x, y))).alias("v")).where(F.size("v") >= 2)
    idx = F.sequence(F.lit(0), F.size("v") - 1)
    p = g.select(key, "v", F.explode(idx).alias("i")).select(key, "v", "i", F.explode(idx).alias("j")).where("i < j")
    a, b = F.signum(F.expr(f"v[i].{x} - v[j].{x}").cast("double")), F.signum(F.expr(f"v[i].{y} - v[j].{y}").cast("double"))
    t = p.select(key, a.alias("a"), b.alias("b")).groupBy(key).agg(F.sum(F.col("a") * F.col("b")).alias("s"), F.sum(F.abs("a")).alias("na"), F.sum(F.abs("b")).alias("nb"))
    return t.select(key, F.when((F.col("na") == 0) | (F.col("nb") == 0), 0.0).otherwise(F.col("s") / F.sqrt(F.col("na") * F.col("nb"))).alias("tau"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Sum of (observed - expected)^2 / expected over the whole grid, from the cells that occur."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("o"))
    c = c.withColumns({"ra": F.sum("o").over(Window.partitionBy(a)), "cb": F.sum("o").over(Window.partitionBy(b))})
    return c.agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("cb"))).alias("q")).select("n", (F.col("n") * (F.col("q") - 1)).alias("chi2"))


def normal_tail(z: Column) -> Column:
    """1 - Phi(z) for z >= 0 (and its mirror below), by Abramowitz and Stegun 26.2.17: off by less than 7.5e-8."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * (t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def t_as_normal(rho: Column, n: Column) -> Column:
    """A correlation's t statistic on n - 2 degrees of freedom, turned into a standard normal one (Wallace): within 1e-3 of the
    tail from 10 degrees on."""
    df = n - 2
    t2 = rho * rho * df / (1 - rho * rho)
    return F.signum(rho) * (8 * df + 1) / (8 * df + 3) * F.sqrt(df * F.log1p(t2 / df))


def chi2_tail_even(x: Column, df: int) -> Column:
    """Upper tail of chi-square for an even number of degrees of freedom: a finite sum."""
    term, total = F.lit(1.0), F.lit(1.0)
    for k in range(1, df // 2):
        term = term * (x / 2) / k
        total = total + term
    return F.exp(-x / 2) * total


def mann_whitney_z(u: Column, n1: Column, n2: Column, ties: Column, correction: float = 0.5) -> Column:
    """Standardised U with the correction for ties (the sum of t^3 - t) and for continuity, for the alternative 'greater'."""
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    return (u - n1 * n2 / 2 - correction) / sd
