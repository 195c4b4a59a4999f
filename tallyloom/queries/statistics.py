"""Statistics over the feature table (2.12) and the data checks (V)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import statistics as ST
from tallyloom.plans import views as V
from tallyloom.plans.views import sql
from tallyloom.queries.registry import Registry

REGISTRY = R = Registry()
r6 = lambda c: F.round(c, 6)


def w(base, extra, body):
    return sql(base, "SELECT 1").replace(" SELECT 1", (", " + extra if extra else "") + " " + body)


TAIL = lambda z: f"(CASE WHEN {z} >= 0 THEN 0 ELSE 1 END + sign({z} + 1e-300) * exp(-{z} * {z} / 2) / 2.5066282746310002 * " + T5.replace("T", f"(1 / (1 + 0.2316419 * abs({z})))") + ")"
T5 = "T * (0.31938153 + T * (-0.356563782 + T * (1.781477937 + T * (-1.821255978 + T * 1.330274429))))"


def feat(s, d):
    return V.features(s, d)


def spear(name, x, y):
    q = f"rr AS (SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS a, rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS b FROM feat WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"

    z = "abs(sign(rho) * (8 * (n - 2) + 1) / (8 * (n - 2) + 3) * sqrt((n - 2) * ln(1 + rho * rho / (1 - rho * rho))))"

    @R.add(name, w("feat", q + ", rh AS (SELECT corr(a, b) AS rho, CAST(count(*) AS DOUBLE) AS n FROM rr), rz AS (SELECT *, " + z + " AS z FROM rh)", f"SELECT round(rho, 6) AS rho, CAST(n AS BIGINT) AS n, round(2 * {TAIL('z')}, 6) AS p FROM rz"))
    def run(s, d):
        """With the two-sided p-value of rho's t statistic."""
        c = ST.spearman(feat(s, d), x, y)
        p = 2 * ST.normal_tail(F.abs(ST.t_as_normal(F.col("rho"), F.col("n"))))
        return c.select(r6("rho").alias("rho"), "n", r6(p).alias("p"))


spear("t1_spearman_length_inflation", "length", "inflation_rm")
spear("t1_spearman_reward_borda", "rm_reward", "borda_emp")
spear("z11_correlation_density", "formatting_density", "inflation_rm")


@R.add("t2_pearson", sql("feat", "SELECT round(corr(rm_reward, borda_emp), 6) AS reward_borda, round(corr(word_count, inflation_rm), 6) AS words_inflation FROM feat"))
def t2(s, d):
    return feat(s, d).agg(r6(F.corr("rm_reward", "borda_emp")).alias("reward_borda"), r6(F.corr("word_count", "inflation_rm")).alias("words_inflation"))


KT = "kt AS (SELECT a.prompt, sum(sign(a.borda_emp - b.borda_emp) * sign(a.borda_pm - b.borda_pm)) AS s, sum(abs(sign(a.borda_emp - b.borda_emp))) AS na, sum(abs(sign(a.borda_pm - b.borda_pm))) AS nb FROM fk a JOIN fk b ON a.prompt = b.prompt AND a.feature_id < b.feature_id GROUP BY 1)"
FK = "fk AS (SELECT * FROM feat WHERE prompt IS NOT NULL AND borda_emp IS NOT NULL AND borda_pm IS NOT NULL)"


@R.add("t3_kendall", w("feat", FK + ", " + KT, "SELECT prompt, round(CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE s / sqrt(na * nb) END, 6) AS tau FROM kt"))
def t3(s, d):
    f = feat(s, d).where("prompt is not null and borda_emp is not null and borda_pm is not null")
    return ST.kendall_tau_b(f, "prompt", "borda_emp", "borda_pm").withColumn("tau", r6("tau"))


#: Rankings of a prompt's responses that are held against each other.
METHODS = ("borda_emp", "copeland_emp", "borda_bt", "borda_rm", "borda_pm")
T3S = "fk AS (SELECT prompt, feature_id, " + ", ".join(METHODS) + " FROM feat WHERE prompt IS NOT NULL AND " + " AND ".join(f"{m} IS NOT NULL" for m in METHODS) + "), kt AS (" + " UNION ALL ".join(f"SELECT '{x}' AS method_a, '{y}' AS method_b, a.prompt, sum(sign(a.{x} - b.{x}) * sign(a.{y} - b.{y})) AS s, sum(abs(sign(a.{x} - b.{x}))) AS na, sum(abs(sign(a.{y} - b.{y}))) AS nb FROM fk a JOIN fk b ON a.prompt = b.prompt AND a.feature_id < b.feature_id GROUP BY 3" for x in METHODS for y in METHODS) + ")"


@R.add("t3_kendall_matrix", w("feat", T3S, "SELECT method_a, method_b, round(avg(CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE s / sqrt(na * nb) END), 6) AS tau FROM kt GROUP BY 1, 2"))
def t3m(s, d):
    """Mean over prompts of tau-b between each two of five rankings; pairs are made once from the prompt's array for all 25."""
    f = feat(s, d).where("prompt is not null and " + " and ".join(f"{m} is not null" for m in METHODS))
    g = f.groupBy("prompt").agg(F.array_sort(F.collect_list(F.struct("feature_id", *(F.col(m).cast("double").alias(m) for m in METHODS)))).alias("v")).where(F.size("v") >= 2)
    idx = F.sequence(F.lit(0), F.size("v") - 1)
    p = g.select("prompt", "v", F.explode(idx).alias("i")).select("prompt", "v", "i", F.explode(idx).alias("j")).where("i < j")
    p = p.select("prompt", *(F.signum(F.expr(f"v[i].{m} - v[j].{m}")).alias(m) for m in METHODS))
    t = p.groupBy("prompt").agg(*(F.sum(F.col(x) * F.col(y)).alias(f"{x}-{y}") for x in METHODS for y in METHODS))
    n = lambda m: F.col(f"`{m}-{m}`")
    one = t.agg(*(F.avg(F.when((n(x) == 0) | (n(y) == 0), 0.0).otherwise(F.col(f"`{x}-{y}`") / F.sqrt(n(x) * n(y)))).alias(f"{x}-{y}") for x in METHODS for y in METHODS))
    return one.select(F.explode(F.array(*(F.struct(F.lit(x).alias("method_a"), F.lit(y).alias("method_b"), r6(f"`{x}-{y}`").alias("tau")) for x in METHODS for y in METHODS))).alias("c")).select("c.*")


MW = "mw AS (SELECT is_condorcet_winner AS g, rank() OVER (ORDER BY length) + (count(*) OVER (PARTITION BY length) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY length) AS t FROM feat WHERE length IS NOT NULL AND is_condorcet_winner IS NOT NULL), mu AS (SELECT CAST(count_if(g) AS DOUBLE) AS n1, CAST(count_if(NOT g) AS DOUBLE) AS n2, sum(CASE WHEN g THEN r END) - count_if(g) * (count_if(g) + 1) / 2.0 AS u, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM mw), mz AS (SELECT *, (u - n1 * n2 / 2 - 0.5) / sd AS z, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd AS z2 FROM (SELECT *, sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM mu))"


@R.add("t4_t5_mann_whitney", w("feat", MW, f"SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(u, 4) AS u, round(1 - 2 * u / (n1 * n2), 6) AS rank_biserial, round(least(1.0, 2 * {TAIL('z2')}), 6) AS p_two_sided, round({TAIL('z')}, 6) AS p_greater FROM mz"))
def t4(s, d):
    m = ST.mann_whitney(feat(s, d), "length", "is_condorcet_winner")
    return m.select("n1", "n2", F.round("u", 4).alias("u"), *(r6(c).alias(c) for c in ("rank_biserial", "p_two_sided", "p_greater")))


@R.add("t6_cohens_d", sql("feat", "SELECT round((avg(length) FILTER (is_condorcet_winner) - avg(length) FILTER (NOT is_condorcet_winner)) / sqrt((var_pop(length) FILTER (is_condorcet_winner) + var_pop(length) FILTER (NOT is_condorcet_winner)) / 2), 6) AS d FROM feat"))
def t6(s, d):
    return feat(s, d).agg(r6(ST.cohens_d(F.col("length"), F.col("is_condorcet_winner"))).alias("d"))


KW = "kw AS (SELECT strategy_id AS g, rank() OVER (ORDER BY inflation_rm) + (count(*) OVER (PARTITION BY inflation_rm) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY inflation_rm) AS t FROM feat WHERE strategy_id IS NOT NULL AND inflation_rm IS NOT NULL), kg AS (SELECT g, sum(r) AS s, count(*) AS n, sum(t * t - 1) AS t FROM kw GROUP BY 1), kk AS (SELECT sum(s * s / n) AS q, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(t) AS DOUBLE) AS t FROM kg)"


@R.add("t7_kruskal", w("feat", KW, "SELECT CAST(n AS BIGINT) AS n, round(h, 5) AS h, round(exp(-h / 2) * (1 + h / 2 + h / 2 * h / 2 / 2), 6) AS p FROM (SELECT n, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h FROM kk)"))
def t7(s, d):
    """Seven groups: six degrees of freedom."""
    return ST.kruskal(feat(s, d), "inflation_rm", "strategy_id").select("n", F.round("h", 5).alias("h"), r6(ST.chi2_tail_even(F.col("h"), 6)).alias("p"))


CH = "ch AS (SELECT strategy_id AS a, is_condorcet_winner AS b, count(*) AS o FROM feat WHERE strategy_id IS NOT NULL AND is_condorcet_winner IS NOT NULL GROUP BY 1, 2), c2 AS (SELECT *, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS cb FROM ch)"


@R.add("t8_chi_square", w("feat", CH, "SELECT sum(o) AS n, round(sum(o) * (sum(o * o / (ra * cb)) - 1), 5) AS chi2 FROM c2"))
def t8(s, d):
    return ST.chi_square(feat(s, d), "strategy_id", "is_condorcet_winner").select("n", F.round("chi2", 5).alias("chi2"))


@R.add("t9_uniformity", sql("feat", "SELECT sum(n) AS n, round(sum((n - m) * (n - m) / m), 5) AS chi2, round(max(n) / min(n), 6) AS ratio, round(-sum(n / t * ln(n / t)) / ln(7), 6) AS entropy, count_if(n < 0.02 * t) AS rare FROM (SELECT n, sum(n) OVER () / 7.0 AS m, sum(n) OVER () AS t FROM (SELECT count(*) AS n FROM feat WHERE strategy_id IS NOT NULL GROUP BY strategy_id))"))
def t9(s, d):
    c = feat(s, d).where("strategy_id is not null").groupBy("strategy_id").agg(F.count("*").cast("double").alias("n"))
    t = F.sum("n").over(Window.partitionBy())  # seven rows
    c = c.withColumns({"t": t, "m": t / 7})
    x = F.col("n") / F.col("t")
    return c.agg(F.sum("n").cast("bigint").alias("n"), F.round(F.sum((F.col("n") - F.col("m")) * (F.col("n") - F.col("m")) / F.col("m")), 5).alias("chi2"), r6(F.max("n") / F.min("n")).alias("ratio"), r6(-F.sum(x * F.log(x)) / F.log(F.lit(7.0))).alias("entropy"), F.count_if(F.col("n") < 0.02 * F.col("t")).alias("rare"))


@R.add("t10_ols")
def t10(s, d):
    """Ordinary least squares on standardised features: the normal equations come from one aggregate, the 4 x 4 solve is local."""
    xs, y = ("length", "n_bold", "n_bullet_items", "sentence_count"), "inflation_rm"
    f = feat(s, d).where(" and ".join(f"{c} is not null" for c in (*xs, y))).select(*(F.col(c).cast("double").alias(c) for c in (*xs, y)))
    cols = (*xs, y)
    row = f.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in cols), *(F.covar_pop(a, b).alias(f"c_{a}_{b}") for i, a in enumerate(cols) for b in cols[i:])).first()
    if not row["n"]:
        return s.createDataFrame([], "feature string, beta double, std_error double")
    cov = lambda a, b: row[f"c_{a}_{b}"] if f"c_{a}_{b}" in row.asDict() else row[f"c_{b}_{a}"]
    sd = {c: max(1e-12, cov(c, c)) ** 0.5 for c in xs}
    a = np.array([[cov(p, q) / sd[p] / sd[q] for q in xs] for p in xs])
    b = np.array([cov(p, y) / sd[p] for p in xs])
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    sigma = max(0.0, cov(y, y) - b @ beta) * row["n"] / max(1, row["n"] - len(xs) - 1)
    se = np.sqrt(np.maximum(0, np.diag(np.linalg.pinv(a)) * sigma / row["n"]))
    return s.createDataFrame([(c, float(x), float(e)) for c, x, e in zip(xs, beta, se)], "feature string, beta double, std_error double")


@R.add("t11_quartile_means", sql("feat", "SELECT 1").replace(" SELECT 1", ", qq AS (SELECT quantile_cont(length, 0.25) AS a, quantile_cont(length, 0.5) AS b, quantile_cont(length, 0.75) AS c FROM feat WHERE inflation_rm IS NOT NULL) SELECT CASE WHEN length <= a THEN 1 WHEN length <= b THEN 2 WHEN length <= c THEN 3 ELSE 4 END AS quartile, count(*) AS n, round(avg(inflation_rm), 6) AS mean, round(stddev_pop(inflation_rm), 6) AS std FROM feat, qq WHERE length IS NOT NULL AND inflation_rm IS NOT NULL GROUP BY 1"))
def t11(s, d):
    f = feat(s, d).where("length is not null and inflation_rm is not null").select("length", "inflation_rm")
    q = F.broadcast(f.agg(F.percentile("length", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q")))  # one row
    k = 1 + sum(((F.col("length") > F.col("q")[i]).cast("int") for i in range(3)), F.lit(0))
    return f.crossJoin(q).groupBy(k.alias("quartile")).agg(F.count("*").alias("n"), r6(F.avg("inflation_rm")).alias("mean"), r6(F.stddev_pop("inflation_rm")).alias("std"))


FEATS = ("length", "n_bold", "n_bullet_items", "sentence_count", "formatting_density")


@R.add("t12_winner_means", sql("feat", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}) FILTER (is_condorcet_winner), 6) AS winner, round(avg({c}) FILTER (NOT is_condorcet_winner), 6) AS other FROM feat" for c in FEATS)))
def t12(s, d):
    f = feat(s, d).agg(*(F.struct(F.lit(c).alias("feature"), r6(F.avg(F.when(F.col("is_condorcet_winner"), F.col(c)))).alias("winner"), r6(F.avg(F.when(~F.col("is_condorcet_winner"), F.col(c)))).alias("other")).alias(c) for c in FEATS))
    return f.select(F.explode(F.array(*FEATS)).alias("x")).select("x.*")


T13 = "cl AS (SELECT unnest(range(1, 8)) AS strategy_id), lf AS (SELECT split, strategy_id FROM feat WHERE strategy_id IS NOT NULL AND split IS NOT NULL), sp AS (SELECT DISTINCT split FROM lf UNION ALL SELECT 'all'), ct AS (SELECT coalesce(split, 'all') AS split, strategy_id, count(*) AS n FROM lf GROUP BY GROUPING SETS ((split, strategy_id), (strategy_id)))"


@R.add("t13_class_distribution", w("feat", T13, "SELECT split, strategy_id, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(n) OVER (PARTITION BY split), 6) AS fraction FROM sp CROSS JOIN cl LEFT JOIN ct USING (split, strategy_id)"))
def t13(s, d):
    """Counts and fractions of all seven classes, those that never occur with 0, for each split and overall."""
    f = feat(s, d).where("strategy_id is not null and split is not null").groupBy("split", "strategy_id").agg(F.count("*").alias("n"))
    f = f.unionByName(f.groupBy("strategy_id").agg(F.sum("n").alias("n")).select(F.lit("all").alias("split"), "strategy_id", "n"))
    g = f.groupBy("split").agg(F.map_from_entries(F.collect_list(F.struct("strategy_id", "n"))).alias("ns"), F.sum("n").alias("t"))  # seven entries
    g = g.select("split", "ns", "t", F.explode(F.array(*map(F.lit, range(1, 8)))).alias("strategy_id")).withColumn("n", F.coalesce(F.try_element_at("ns", F.col("strategy_id")), F.lit(0)))
    return g.select("split", "strategy_id", "n", r6(F.col("n") / F.col("t")).alias("fraction"))


@R.add("t14_inflation_by_class", sql("feat", "SELECT strategy_id, count(*) AS n, CAST(sum(CAST(inflation_rm AS DECIMAL(28, 12))) AS DOUBLE) / count(*) AS mean, median(inflation_rm) AS median, round(stddev_pop(inflation_rm), 6) AS std FROM feat WHERE strategy_id IS NOT NULL AND inflation_rm IS NOT NULL GROUP BY 1"))
def t14(s, d):
    """Sums as decimals, so that no order of addition changes a digit."""
    f = feat(s, d).where("strategy_id is not null and inflation_rm is not null")
    total = F.sum(F.col("inflation_rm").cast("decimal(28,12)")).cast("double")
    return f.groupBy("strategy_id").agg(F.count("*").alias("n"), (total / F.count("*")).alias("mean"), F.median("inflation_rm").alias("median"), r6(F.stddev_pop("inflation_rm")).alias("std"))


@R.add("t15_winner_composition", sql("feat", "SELECT strategy_id, is_condorcet_winner AS winner, count(*) AS n FROM feat WHERE strategy_id IS NOT NULL GROUP BY 1, 2"))
def t15(s, d):
    return feat(s, d).where("strategy_id is not null").groupBy("strategy_id", F.col("is_condorcet_winner").alias("winner")).agg(F.count("*").alias("n"))


@R.add("t16_class_features", sql("feat", "SELECT strategy_id, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in FEATS) + " FROM feat WHERE strategy_id IS NOT NULL GROUP BY 1"))
def t16(s, d):
    return feat(s, d).where("strategy_id is not null").groupBy("strategy_id").agg(*(r6(F.avg(c)).alias(c) for c in FEATS))


T17 = "ac AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, feature_id, CAST({c} AS DOUBLE) AS x, inflation_rm AS y FROM feat WHERE {c} > 0 AND inflation_rm IS NOT NULL" for c in FEATS) + ")"


@R.add("t17_top_examples", w("feat", T17, "SELECT feature, feature_id, round(x, 6) AS x FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY x DESC, feature_id) AS r FROM ac) WHERE r <= 3"))
def t17(s, d):
    """Top examples of each feature; a rank under a constant is cut to k rows a task before the shuffle (window group limit)."""
    f = feat(s, d).where("inflation_rm is not null")
    x = f.select("feature_id", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in FEATS))).alias("a")).select("a.feature", "feature_id", "a.x").where("x > 0")
    r = x.withColumn("r", F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("x"), "feature_id")))
    return r.where("r <= 3").select("feature", "feature_id", r6("x").alias("x"))


@R.add("t17_activation_correlation", w("feat", T17 + ", rr AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS b FROM ac)", "SELECT feature, count(*) AS n, round(corr(a, b), 6) AS rho FROM rr GROUP BY 1"))
def t17c(s, d):
    from functools import reduce

    from pyspark.sql import DataFrame

    f = feat(s, d).where("inflation_rm is not null")
    return reduce(DataFrame.unionByName, [ST.spearman(f.where(F.col(c) > 0), c, "inflation_rm").select(F.lit(c).alias("feature"), "n", r6("rho").alias("rho")) for c in FEATS]).where("n > 0")


@R.add("t18_per_prompt_rho", sql("feat", "SELECT 1").replace(" SELECT 1", ", rr AS (SELECT prompt, rank() OVER (PARTITION BY prompt ORDER BY rm_reward) + (count(*) OVER (PARTITION BY prompt, rm_reward) - 1) / 2.0 AS a, rank() OVER (PARTITION BY prompt ORDER BY borda_emp) + (count(*) OVER (PARTITION BY prompt, borda_emp) - 1) / 2.0 AS b FROM feat WHERE prompt IS NOT NULL AND rm_reward IS NOT NULL AND borda_emp IS NOT NULL), pc AS (SELECT prompt, corr(a, b) AS rho FROM rr GROUP BY 1 HAVING count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0) SELECT count(*) AS prompts, round(avg(rho), 6) AS mean, round(median(rho), 6) AS median, round(min(rho), 6) AS lo, round(stddev_pop(rho), 6) AS std FROM pc"))
def t18(s, d):
    f = feat(s, d).where("prompt is not null and rm_reward is not null and borda_emp is not null")
    rk = lambda c: F.rank().over(Window.partitionBy("prompt").orderBy(c)) + (F.count("*").over(Window.partitionBy("prompt", c)) - 1) / 2
    r = f.withColumns({"a": rk("rm_reward"), "b": rk("borda_emp")})
    g = r.groupBy("prompt").agg(F.corr("a", "b").alias("rho"), F.count("*").alias("n"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb")).where("n >= 3 and sa > 0 and sb > 0")
    return g.agg(F.count("*").alias("prompts"), r6(F.avg("rho")).alias("mean"), r6(F.median("rho")).alias("median"), r6(F.min("rho")).alias("lo"), r6(F.stddev_pop("rho")).alias("std"))


@R.add("t19_threshold_shares", sql("feat", "SELECT round(avg(CASE WHEN abs(inflation_rm) > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS over_01, round(avg(CASE WHEN abs(inflation_rm) > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS over_05, round(avg(CASE WHEN abs(inflation_rm) > 1 THEN 1.0 ELSE 0.0 END), 6) AS over_1, round(avg(CASE WHEN has_cycle THEN abs(inflation_rm) END), 6) AS with_cycle FROM feat WHERE inflation_rm IS NOT NULL"))
def t19(s, d):
    x = F.abs("inflation_rm")
    return feat(s, d).where("inflation_rm is not null").agg(*(r6(F.avg((x > t).cast("double"))).alias(n) for t, n in ((0.1, "over_01"), (0.5, "over_05"), (1, "over_1"))), r6(F.avg(F.when(F.col("has_cycle"), x))).alias("with_cycle"))


T19 = "pm AS (SELECT prompt, avg(abs(inflation_rm)) AS x, avg(abs(inflation_pm)) AS y, bool_or(has_cycle) AS c FROM feat WHERE prompt IS NOT NULL AND inflation_rm IS NOT NULL AND inflation_pm IS NOT NULL GROUP BY 1), rr AS (SELECT c, x, rank() OVER (ORDER BY round(x, 9)) + (count(*) OVER (PARTITION BY round(x, 9)) - 1) / 2.0 AS a, rank() OVER (ORDER BY round(y, 9)) + (count(*) OVER (PARTITION BY round(y, 9)) - 1) / 2.0 AS b FROM pm)"


@R.add("t19_prompt_means", w("feat", T19, "SELECT count(*) AS prompts, round(corr(a, b), 6) AS rho, round(avg(x) FILTER (c), 6) AS with_cycle, count_if(c) AS n_with, round(avg(x) FILTER (NOT c), 6) AS without_cycle, count_if(NOT c) AS n_without FROM rr"))
def t19m(s, d):
    """Rank correlation between the per-prompt means of both models, and the scalar's mean with and without a cycle."""
    f = feat(s, d).where("prompt is not null and inflation_rm is not null and inflation_pm is not null")
    m = f.groupBy("prompt").agg(F.avg(F.abs("inflation_rm")).alias("x"), F.avg(F.abs("inflation_pm")).alias("y"), F.bool_or("has_cycle").alias("c"))
    m = m.withColumns({"rx": F.round("x", 9), "ry": F.round("y", 9)})
    q = ST.ranked(ST.ranked(m, "rx", "a"), "ry", "b")
    return q.agg(F.count("*").alias("prompts"), r6(F.corr("a", "b")).alias("rho"), r6(F.avg(F.when(F.col("c"), F.col("x")))).alias("with_cycle"), F.count_if(F.col("c")).alias("n_with"), r6(F.avg(F.when(~F.col("c"), F.col("x")))).alias("without_cycle"), F.count_if(~F.col("c")).alias("n_without"))


@R.add("t20_group_extremes", sql("feat", "SELECT round(avg(hi), 6) AS mean_max, round(avg(lo), 6) AS mean_min FROM (SELECT prompt, max(rm_reward) AS hi, min(rm_reward) AS lo FROM feat WHERE prompt IS NOT NULL GROUP BY 1)"))
def t20(s, d):
    g = feat(s, d).where("prompt is not null").groupBy("prompt").agg(F.max("rm_reward").alias("hi"), F.min("rm_reward").alias("lo"))
    return g.agg(r6(F.avg("hi")).alias("mean_max"), r6(F.avg("lo")).alias("mean_min"))


DEC = ", ".join(f"quantile_cont(length, {k / 10}) AS q{k}" for k in range(1, 10))


@R.add("z5_decile_trend", sql("feat", "SELECT 1").replace(" SELECT 1", f", qq AS (SELECT {DEC} FROM feat WHERE inflation_rm IS NOT NULL) SELECT " + " + ".join(f"(CASE WHEN length > q{k} THEN 1 ELSE 0 END)" for k in range(1, 10)) + " AS decile, count(*) AS n, round(avg(inflation_rm), 6) AS mean FROM feat, qq WHERE length IS NOT NULL AND inflation_rm IS NOT NULL GROUP BY 1"))
def z5(s, d):
    f = feat(s, d).where("length is not null and inflation_rm is not null").select("length", "inflation_rm")
    q = F.broadcast(f.agg(F.percentile("length", F.array(*(F.lit(k / 10) for k in range(1, 10)))).alias("q")))  # one row
    k = sum(((F.col("length") > F.col("q")[i]).cast("int") for i in range(9)), F.lit(0))
    return f.crossJoin(q).groupBy(k.alias("decile")).agg(F.count("*").alias("n"), r6(F.avg("inflation_rm")).alias("mean"))


@R.add("z10_metric_by_ratio", sql("feat", "SELECT coalesce(split, 'none') AS run, count(*) AS n, round(avg(CASE WHEN is_rm_winner = is_condorcet_winner THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM feat GROUP BY 1"))
def z10(s, d):
    same = F.coalesce((F.col("is_rm_winner") == F.col("is_condorcet_winner")).cast("double"), F.lit(0.0))
    return feat(s, d).groupBy(F.coalesce("split", F.lit("none")).alias("run")).agg(F.count("*").alias("n"), r6(F.avg(same)).alias("accuracy"))


# Data checks. Train and eval are the halves of the rows by parity of the id.
V0 = "vv AS (SELECT prompt, least(winner, loser) AS a, greatest(winner, loser) AS b, row_id % 2 AS part, CASE WHEN winner < loser THEN 1 ELSE 0 END AS label FROM outc), vg AS (SELECT prompt, a, b, count_if(part = 0 AND label = 1) AS t1, count_if(part = 0 AND label = 0) AS t0, count_if(part = 1 AND label = 1) AS e1, count_if(part = 1 AND label = 0) AS e0 FROM vv GROUP BY 1, 2, 3)"


def vg(s, d):
    o = V.outcomes(s, d).select("prompt", F.least("winner", "loser").alias("a"), F.greatest("winner", "loser").alias("b"), (F.col("row_id") % 2).alias("part"), (F.col("winner") < F.col("loser")).alias("up"))
    c = lambda p, u: F.count_if((F.col("part") == p) & (F.col("up") == u))
    return o.groupBy("prompt", "a", "b").agg(c(0, True).alias("t1"), c(0, False).alias("t0"), c(1, True).alias("e1"), c(1, False).alias("e0"))


@R.add("v1_cross_split_conflicts", w("outc", V0, "SELECT count_if(t1 + t0 > 0 AND e1 + e0 > 0) AS shared, count_if(t1 + t0 > 0 AND e1 + e0 > 0 AND t1 + e1 > 0 AND t0 + e0 > 0) AS conflicting, round(count_if(t1 + t0 > 0 AND e1 + e0 > 0 AND t1 + e1 > 0 AND t0 + e0 > 0) / nullif(count_if(t1 + t0 > 0 AND e1 + e0 > 0), 0), 6) AS rate FROM vg"))
def v1(s, d):
    both = F.expr("t1 + t0 > 0 and e1 + e0 > 0")
    bad = both & F.expr("t1 + e1 > 0 and t0 + e0 > 0")
    return vg(s, d).agg(F.count_if(both).alias("shared"), F.count_if(bad).alias("conflicting"), r6(F.count_if(bad) / F.nullif(F.count_if(both), F.lit(0))).alias("rate"))


@R.add("v2_majority_accuracy", w("outc", V0, "SELECT round(sum(greatest(t1, t0)) / sum(t1 + t0), 6) AS train, round(sum(CASE WHEN t1 + t0 > 0 AND e1 + e0 > 0 THEN CASE WHEN t1 >= t0 THEN e1 ELSE e0 END END) / sum(CASE WHEN t1 + t0 > 0 AND e1 + e0 > 0 THEN e1 + e0 END), 6) AS eval FROM vg"))
def v2(s, d):
    """Ties of the train majority go to label 1."""
    both = F.expr("t1 + t0 > 0 and e1 + e0 > 0")
    hit = F.when(both, F.expr("case when t1 >= t0 then e1 else e0 end"))
    return vg(s, d).agg(r6(F.sum(F.greatest("t1", "t0")) / F.sum(F.col("t1") + F.col("t0"))).alias("train"), r6(F.sum(hit) / F.sum(F.when(both, F.col("e1") + F.col("e0")))).alias("eval"))


@R.add("v3_dimension_shares", sql("pref", "SELECT dimension, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM pref), 4) AS pct FROM pref GROUP BY 1"))
def v3(s, d):
    g = V.preferences(s, d).groupBy("dimension").agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))  # a row a dimension


@R.add("v4_prefix_conflicts", w("outc", "f1 AS (SELECT * FROM outc ORDER BY row_id LIMIT 1000), g1 AS (SELECT substr(prompt, 1, 100) AS p, least(substr(winner, 1, 100), substr(loser, 1, 100)) AS a, greatest(substr(winner, 1, 100), substr(loser, 1, 100)) AS b, count_if(substr(winner, 1, 100) < substr(loser, 1, 100)) AS u, count(*) AS n FROM f1 WHERE substr(winner, 1, 100) <> substr(loser, 1, 100) GROUP BY 1, 2, 3)", "SELECT count_if(n > 1) AS repeated, count_if(u > 0 AND u < n) AS conflicting FROM g1"))
def v4(s, d):
    """The check looks at the first thousand rows and 100 characters by definition."""
    o = V.outcomes(s, d).orderBy("row_id").limit(1000)
    c = lambda x: F.substring(x, 1, 100)
    o = o.select(c("prompt").alias("p"), c("winner").alias("x"), c("loser").alias("y")).where("x <> y")
    g = o.groupBy("p", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count_if(F.col("x") < F.col("y")).alias("u"), F.count("*").alias("n"))
    return g.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if((F.col("u") > 0) & (F.col("u") < F.col("n"))).alias("conflicting"))


@R.add("v5_longer_chosen", sql("pref", "SELECT round(avg(CASE WHEN length(chosen) > length(rejected) THEN 1.0 ELSE 0.0 END), 6) AS share FROM pref WHERE chosen IS NOT NULL AND rejected IS NOT NULL"))
def v5(s, d):
    return V.preferences(s, d).where("chosen is not null and rejected is not null").agg(r6(F.avg((F.length("chosen") > F.length("rejected")).cast("double"))).alias("share"))


@R.add("v6_margins", sql("pref", "SELECT dimension, count(*) AS n, round(min(margin), 6) AS lo, round(max(margin), 6) AS hi, round(avg(margin), 6) AS mean FROM pref GROUP BY 1"))
def v6(s, d):
    return V.preferences(s, d).groupBy("dimension").agg(F.count("*").alias("n"), r6(F.min("margin")).alias("lo"), r6(F.max("margin")).alias("hi"), r6(F.avg("margin")).alias("mean"))
