"""Matrices, social choice, winners and inflation (2.8, 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import matrix, social
from tallyloom.plans import views as V
from tallyloom.plans.views import sql
from tallyloom.queries.registry import Registry

REGISTRY = R = Registry()
r6 = lambda c: F.round(c, 6)


def p_of(spark, d):
    return matrix.majority(V.rated_entries(spark, d))


SC = """sc AS (SELECT prompt_id, i, any_value(k) AS k, round(sum(p), 9) AS borda, round(sum(p), 9) + 0.5 AS borda_diag, (round(sum(p), 9) + 0.5) / any_value(k) AS effective,
 sum(CASE WHEN p > 0.5 THEN 1 WHEN p = 0.5 THEN 0.5 ELSE 0 END) AS copeland, sum(CASE WHEN p > 0.5 THEN 1 ELSE 0 END) AS copeland_strict, min(p) > 0.5 AS is_condorcet FROM pm GROUP BY 1, 2)"""
RK = SC + """, rk AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY borda DESC, i) - 1 AS borda_rank, row_number() OVER (PARTITION BY prompt_id ORDER BY copeland DESC, i) - 1 AS copeland_rank FROM sc)"""
WN = RK + """, wn AS (SELECT *, coalesce(condorcet_winner, copeland_winner) AS pairwise_winner, borda_winner = coalesce(condorcet_winner, copeland_winner) AS agrees, condorcet_winner IS NULL AS no_condorcet
 FROM (SELECT prompt_id, any_value(k) AS k, max(CASE WHEN borda_rank = 0 THEN i END) AS borda_winner, max(CASE WHEN copeland_rank = 0 THEN i END) AS copeland_winner, max(CASE WHEN is_condorcet THEN i END) AS condorcet_winner FROM rk GROUP BY 1))"""


def q(name, extra, body, base="pm"):
    """Oracle over the matrix relations."""
    return name, sql(base, "SELECT 1").replace(" SELECT 1", (", " + extra if extra else "") + " " + body)


@R.add(*q("i2_majority_matrix", "", "SELECT prompt_id, i, j, round(p, 6) AS p FROM pm"))
def i2(s, d):
    return p_of(s, d).select("prompt_id", "i", "j", r6("p").alias("p"))


@R.add("i3_avg_matrix", sql("pair", "SELECT prompt_id, i, j, (sign(aa - ab) + 1) / 2.0 AS p FROM pair"))
def i3(s, d):
    return matrix.average_step(V.rated_entries(s, d)).select("prompt_id", "i", "j", "p")


@R.add("i1_win_counts", sql("outc", "SELECT prompt, winner, loser, count(*) AS n FROM outc GROUP BY 1, 2, 3"))
def i1(s, d):
    return matrix.win_counts(V.outcomes(s, d))


BW = "bw AS (SELECT prompt, least(winner, loser) AS a, greatest(winner, loser) AS b, sum(CASE WHEN winner < loser THEN 1 ELSE 0 END) AS ab, sum(CASE WHEN winner < loser THEN 0 ELSE 1 END) AS ba FROM outc GROUP BY 1, 2, 3)"


@R.add(*q("i4_empirical_prob", BW, "SELECT row_id, round(CASE WHEN winner < loser THEN ab ELSE ba END / (ab + ba), 6) AS p FROM outc JOIN bw ON outc.prompt = bw.prompt AND least(winner, loser) = a AND greatest(winner, loser) = b", "outc"))
def i4(s, d):
    o = V.outcomes(s, d)
    w = matrix.both_ways(matrix.win_counts(o))
    k = o.withColumns({"a": F.least("winner", "loser"), "b": F.greatest("winner", "loser")}).join(w, ["prompt", "a", "b"])
    return k.select("row_id", r6(F.when(F.col("winner") < F.col("loser"), F.col("ab")).otherwise(F.col("ba")) / (F.col("ab") + F.col("ba"))).alias("p"))


@R.add("i5_winrate_grid", sql("outc", "SELECT 1").replace(" SELECT 1", ", " + BW + """, itm AS (SELECT DISTINCT prompt, x FROM (SELECT prompt, winner AS x FROM outc UNION ALL SELECT prompt, loser FROM outc)), sm AS (SELECT prompt FROM itm GROUP BY 1 HAVING count(*) BETWEEN 3 AND 200)
 SELECT u.prompt, u.x AS i, w.x AS j, round(coalesce(CASE WHEN u.x < w.x THEN ab ELSE ba END / (ab + ba), 0.5), 6) AS p FROM itm u JOIN sm USING (prompt) JOIN itm w ON u.prompt = w.prompt AND u.x <> w.x LEFT JOIN bw ON bw.prompt = u.prompt AND least(u.x, w.x) = a AND greatest(u.x, w.x) = b"""))
def i5(s, d):
    """Win rates on the full grid of each prompt with 3 to 200 responses (C2); pairs that never met get 1/2."""
    w = matrix.both_ways(matrix.win_counts(V.outcomes(s, d)))
    items = w.select("prompt", F.explode(F.array("a", "b")).alias("x")).distinct()
    few = items.groupBy("prompt").agg(F.count("*").alias("n")).where(F.col("n").between(3, 200)).select("prompt")  # C2, counted before anything is gathered
    small = items.join(few, "prompt", "left_semi").groupBy("prompt").agg(F.collect_list("x").alias("xs"))
    grid = small.select("prompt", "xs", F.explode("xs").alias("i")).select("prompt", "i", F.explode("xs").alias("j")).where("i <> j")
    g = grid.withColumns({"a": F.least("i", "j"), "b": F.greatest("i", "j")}).join(w, ["prompt", "a", "b"], "left")
    return g.select("prompt", "i", "j", r6(F.coalesce(F.when(F.col("i") < F.col("j"), F.col("ab")).otherwise(F.col("ba")) / (F.col("ab") + F.col("ba")), F.lit(0.5))).alias("p"))


def score(name, col):
    sel = f"SELECT prompt_id, i, {'round(' + col + ', 6)' if col not in ('copeland_strict', 'is_condorcet') else col} AS {col} FROM sc"

    @R.add(*q(name, SC, sel))
    def run(s, d, col=col):
        c = F.col(col)
        return social.scores(p_of(s, d)).select("prompt_id", "i", (c if col in ("copeland_strict", "is_condorcet") else r6(c)).alias(col))


for _n, _c in (("j1_borda", "borda"), ("j1b_borda_diagonal", "borda_diag"), ("j1b_effective_reward", "effective"), ("j3_copeland_half", "copeland"), ("j3b_copeland_strict", "copeland_strict")):
    score(_n, _c)


@R.add(*q("j2_condorcet_winner", SC, "SELECT prompt_id, i FROM sc WHERE is_condorcet"))
def j2(s, d):
    return social.scores(p_of(s, d)).where("is_condorcet").select("prompt_id", "i")


@R.add(*q("j6_ranks", RK, "SELECT prompt_id, i, borda_rank, copeland_rank FROM rk"))
def j6(s, d):
    return social.inflation(p_of(s, d)).select("prompt_id", "i", "borda_rank", "copeland_rank")


@R.add(*q("j7_winners", WN, "SELECT prompt_id, borda_winner, copeland_winner, condorcet_winner FROM wn"))
def j7(s, d):
    return social.winners(p_of(s, d)).select("prompt_id", "borda_winner", "copeland_winner", "condorcet_winner")


@R.add(*q("j8_pairwise_agreement", WN, "SELECT prompt_id, k, borda_winner, pairwise_winner, agrees, no_condorcet FROM wn"))
def j8(s, d):
    return social.winners(p_of(s, d)).select("prompt_id", "k", "borda_winner", "pairwise_winner", "agrees", "no_condorcet")


@R.add("j9a_inflation_reward", sql("feat", "SELECT feature_id, er - rr AS inflation FROM (SELECT feature_id, row_number() OVER (PARTITION BY prompt ORDER BY borda_emp DESC NULLS LAST, feature_id) AS er, row_number() OVER (PARTITION BY prompt ORDER BY rm_reward DESC NULLS LAST, feature_id) AS rr FROM feat WHERE prompt IS NOT NULL)"))
def j9a(s, d):
    """Effective rank less reward rank: positive where the scalar over-values."""
    return _ranked(s, d).select("feature_id", (F.col("er") - F.col("rr")).alias("inflation"))


@R.add("j9b_inflation_models", sql("feat", "SELECT feature_id, rr - er AS inflation_rm, pr - er AS inflation_pm FROM (SELECT feature_id, row_number() OVER (PARTITION BY prompt ORDER BY borda_emp DESC NULLS LAST, feature_id) AS er, row_number() OVER (PARTITION BY prompt ORDER BY rm_reward DESC NULLS LAST, feature_id) AS rr, row_number() OVER (PARTITION BY prompt ORDER BY borda_pm DESC NULLS LAST, feature_id) AS pr FROM feat WHERE prompt IS NOT NULL)"))
def j9b(s, d):
    """Model rank less empirical rank: negative where the model over-values."""
    return _ranked(s, d).select("feature_id", (F.col("rr") - F.col("er")).alias("inflation_rm"), (F.col("pr") - F.col("er")).alias("inflation_pm"))


def _ranked(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("prompt")
    rk = lambda c: F.row_number().over(w.orderBy(F.col(c).desc_nulls_last(), "feature_id"))
    f = V.features(s, d).where("prompt is not null")
    return f.withColumns({"er": rk("borda_emp"), "rr": rk("rm_reward"), "pr": rk("borda_pm")})


@R.add(*q("j9c_inflation", RK, "SELECT prompt_id, i, borda_rank, copeland_rank, copeland_rank - borda_rank AS inflation FROM rk"))
def j9c(s, d):
    return social.inflation(p_of(s, d))


@R.add("j9d_class_inflation", sql("feat", "SELECT strategy_id, count(*) AS n, round(avg(borda_rm - borda_emp), 6) AS mean, round(stddev_pop(borda_rm - borda_emp), 6) AS std FROM feat WHERE strategy_id IS NOT NULL AND borda_rm IS NOT NULL AND borda_emp IS NOT NULL GROUP BY 1"))
def j9d(s, d):
    x = F.col("borda_rm") - F.col("borda_emp")
    f = V.features(s, d).where("strategy_id is not null and borda_rm is not null and borda_emp is not null")
    return f.groupBy("strategy_id").agg(F.count("*").alias("n"), r6(F.avg(x)).alias("mean"), r6(F.stddev_pop(x)).alias("std"))


@R.add("j10_proxy", sql("resp", "SELECT completion_id, h - least(o, t) AS proxy FROM resp WHERE h IS NOT NULL AND (o IS NOT NULL OR t IS NOT NULL)"))
def j10(s, d):
    r = V.responses(s, d).where("h is not null and (o is not null or t is not null)")
    return r.select("completion_id", (F.col("h") - F.least("o", "t")).alias("proxy"))


@R.add("j10b_proxy_all", sql("resp", "SELECT completion_id, h - least(o, t) AS proxy FROM resp WHERE h IS NOT NULL AND o IS NOT NULL AND t IS NOT NULL"))
def j10b(s, d):
    r = V.responses(s, d).where("h is not null and o is not null and t is not null")
    return r.select("completion_id", (F.col("h") - F.least("o", "t")).alias("proxy"))


@R.add(*q("j11_effective_rewards", SC, "SELECT prompt_id, i, round(borda / (k - 1), 6) AS win_rate, round(effective - borda / (k - 1), 6) AS shift FROM sc"))
def j11(s, d):
    w = F.col("borda") / (F.col("k") - 1)
    return social.scores(p_of(s, d)).select("prompt_id", "i", r6(w).alias("win_rate"), r6(F.col("effective") - w).alias("shift"))


#: The five rankings that a prompt's responses have: by annotations (Borda, Copeland, Bradley-Terry) and by either model.
METHODS = ("borda_emp", "copeland_emp", "borda_bt", "borda_rm", "borda_pm")
J12 = "fv AS (SELECT prompt, " + ", ".join(f"arg_max(feature_id, (coalesce({m}, -1e300), -feature_id)) AS {m}" for m in METHODS) + " FROM feat WHERE prompt IS NOT NULL GROUP BY 1)"


@R.add(*q("j12_winner_agreement", J12, " UNION ALL ".join(f"SELECT '{x}' AS method_a, '{y}' AS method_b, round(avg(CASE WHEN {x} = {y} THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM fv" for x in METHODS for y in METHODS), "feat"))
def j12(s, d):
    """Share of prompts on which two of five methods name one winner; the winners of a prompt sit in one row, so no self-join."""
    f = V.features(s, d).where("prompt is not null")
    w = f.groupBy("prompt").agg(*(F.max_by("feature_id", F.struct(F.coalesce(m, F.lit(-1e300)), -F.col("feature_id"))).alias(m) for m in METHODS))
    one = w.agg(*(F.avg((F.col(x) == F.col(y)).cast("double")).alias(f"{x}-{y}") for x in METHODS for y in METHODS))
    cells = F.array(*(F.struct(F.lit(x).alias("method_a"), F.lit(y).alias("method_b"), r6(f"`{x}-{y}`").alias("agreement")) for x in METHODS for y in METHODS))
    return one.select(F.explode(cells).alias("c")).select("c.*")


FW = "win AS (SELECT prompt, max(CASE WHEN e = 1 THEN feature_id END) AS we, max(CASE WHEN r = 1 THEN feature_id END) AS wr, max(CASE WHEN p = 1 THEN feature_id END) AS wp FROM (SELECT prompt, feature_id, row_number() OVER (PARTITION BY prompt ORDER BY borda_emp DESC NULLS LAST, feature_id) AS e, row_number() OVER (PARTITION BY prompt ORDER BY rm_reward DESC NULLS LAST, feature_id) AS r, row_number() OVER (PARTITION BY prompt ORDER BY borda_pm DESC NULLS LAST, feature_id) AS p FROM feat WHERE prompt IS NOT NULL) GROUP BY 1)"


def _winners(s, d):
    f = V.features(s, d).where("prompt is not null")
    best = lambda c: F.max_by("feature_id", F.struct(F.coalesce(c, F.lit(-1e300)), -F.col("feature_id")))
    return f.groupBy("prompt").agg(best("borda_emp").alias("we"), best("rm_reward").alias("wr"), best("borda_pm").alias("wp"))


@R.add(*q("j13_winner_disagreement", FW, "SELECT count(*) AS prompts, count_if(wr <> we) AS rm_wrong, count_if(wp <> we) AS pm_wrong, count_if(wr <> we AND wp <> we) AS both_wrong, count_if(wr <> we AND wp = we) AS only_rm, count_if(wr = we AND wp <> we) AS only_pm FROM win", "feat"))
def j13(s, d):
    c = lambda e, n: F.count_if(F.expr(e)).alias(n)
    return _winners(s, d).agg(F.count("*").alias("prompts"), c("wr <> we", "rm_wrong"), c("wp <> we", "pm_wrong"), c("wr <> we and wp <> we", "both_wrong"), c("wr <> we and wp = we", "only_rm"), c("wr = we and wp <> we", "only_pm"))


# Names of the patterns between annotations (we), scalar (wr) and pairwise model (wp).
PAT = "CASE WHEN wr = we AND wr = wp THEN 'all_agree' WHEN wr = wp THEN 'bt_pm_agree_borda_diff' WHEN wr = we THEN 'bt_borda_agree_pm_diff' WHEN we = wp THEN 'borda_pm_agree_bt_diff' ELSE 'all_disagree' END"


@R.add(*q("j14_pattern_classes", FW, f"SELECT {PAT} AS pattern, count(*) AS n FROM win GROUP BY 1", "feat"))
def j14(s, d):
    return _winners(s, d).groupBy(F.expr(PAT).alias("pattern")).agg(F.count("*").alias("n"))


@R.add("j15_policy_simulation", sql("feat", "SELECT 1").replace(" SELECT 1", """, b AS (SELECT unnest([0.01, 0.1, 0.5, 1.0, 2.0, 5.0]) AS beta), x AS (SELECT prompt, beta, rm_reward, CAST(length AS DOUBLE) AS len, exp((rm_reward - max(rm_reward) OVER (PARTITION BY prompt, beta)) / beta) AS e FROM feat, b WHERE prompt IS NOT NULL AND rm_reward IS NOT NULL AND length IS NOT NULL),
 y AS (SELECT prompt, beta, len, e / sum(e) OVER (PARTITION BY prompt, beta) AS w FROM x), z AS (SELECT prompt, beta, sum(w * len) - avg(len) AS amplification, -sum(CASE WHEN w > 0 THEN w * ln(w) ELSE 0 END) AS entropy FROM y GROUP BY 1, 2) SELECT CAST(beta AS DOUBLE) AS beta, round(avg(amplification), 5) AS amplification, round(avg(entropy), 5) AS entropy FROM z GROUP BY 1"""))
def j15(s, d):
    """Softmax policies over rewards at several temperatures: how much longer answers get, and the entropy left. Sums only:
    with e = exp((r - max) / beta) and s their sum, the entropy is ln s - sum(e ln e) / s; no prompt is gathered anywhere."""
    f = V.features(s, d).where("prompt is not null and rm_reward is not null and length is not null").select("prompt", "rm_reward", F.col("length").cast("double").alias("len"))
    f = f.join(f.groupBy("prompt").agg(F.max("rm_reward").alias("top")), "prompt")
    f = f.withColumn("beta", F.explode(F.array(*map(F.lit, (0.01, 0.1, 0.5, 1.0, 2.0, 5.0))))).withColumn("z", (F.col("rm_reward") - F.col("top")) / F.col("beta"))
    e, total = F.exp("z"), F.sum(F.exp("z"))
    g = f.groupBy("prompt", "beta").agg((F.sum(e * F.col("len")) / total - F.avg("len")).alias("amp"), (F.log(total) - F.sum(e * F.col("z")) / total).alias("ent"))
    return g.groupBy("beta").agg(F.round(F.avg("amp"), 5).alias("amplification"), F.round(F.avg("ent"), 5).alias("entropy"))


@R.add("j16_quartile_gap", sql("feat", "SELECT 1").replace(" SELECT 1", ", qq AS (SELECT quantile_cont(dim_helpfulness, 0.25) AS lo, quantile_cont(dim_helpfulness, 0.75) AS hi FROM feat WHERE rm_reward IS NOT NULL) SELECT round(avg(CASE WHEN dim_helpfulness >= hi THEN rm_reward END) - avg(CASE WHEN dim_helpfulness <= lo THEN rm_reward END), 6) AS gap, round(ln(avg(CASE WHEN dim_helpfulness >= hi THEN exp(rm_reward) END)) - ln(avg(CASE WHEN dim_helpfulness <= lo THEN exp(rm_reward) END)), 6) AS exp_gap FROM feat, qq"))
def j16(s, d):
    f = V.features(s, d).where("rm_reward is not null and dim_helpfulness is not null").select("rm_reward", "dim_helpfulness")
    q4 = F.broadcast(f.agg(F.percentile("dim_helpfulness", F.array(F.lit(0.25), F.lit(0.75))).alias("q")))  # one row
    j = f.crossJoin(q4)
    hi, lo = F.col("dim_helpfulness") >= F.col("q")[1], F.col("dim_helpfulness") <= F.col("q")[0]
    m = lambda c, x: F.avg(F.when(c, x))
    r = F.col("rm_reward")
    return j.agg(r6(m(hi, r) - m(lo, r)).alias("gap"), r6(F.log(m(hi, F.exp(r))) - F.log(m(lo, F.exp(r)))).alias("exp_gap"))


@R.add(*q("j17_summary", WN, "SELECT count(*) AS n, count_if(agrees) AS n_agree, count_if(NOT no_condorcet) AS n_condorcet, count_if(no_condorcet) AS n_cycles, round(100.0 * count_if(agrees) / count(*), 4) AS pct_agree FROM wn"))
def j17(s, d):
    w = social.winners(p_of(s, d))
    return w.agg(F.count("*").alias("n"), F.count_if("agrees").alias("n_agree"), F.count_if(~F.col("no_condorcet")).alias("n_condorcet"), F.count_if("no_condorcet").alias("n_cycles"), F.round(100.0 * F.count_if("agrees") / F.count("*"), 4).alias("pct_agree"))


@R.add(*q("j18_inflation_hist", RK, "SELECT copeland_rank - borda_rank AS inflation, count(*) AS n FROM rk GROUP BY 1"))
def j18(s, d):
    return social.inflation(p_of(s, d)).groupBy("inflation").agg(F.count("*").alias("n"))


CM = "cl AS (SELECT * FROM (VALUES (1), (2), (3), (4), (5), (6), (7)) t(c)), m AS (SELECT a.strategy_id AS ci, b.strategy_id AS cj, avg(CASE WHEN a.borda_emp > b.borda_emp THEN 1.0 WHEN a.borda_emp = b.borda_emp THEN 0.5 ELSE 0.0 END) AS p, count(*) AS n FROM feat a JOIN feat b ON a.prompt = b.prompt AND a.feature_id <> b.feature_id AND a.strategy_id IS NOT NULL AND b.strategy_id IS NOT NULL AND a.borda_emp IS NOT NULL AND b.borda_emp IS NOT NULL GROUP BY 1, 2)"


@R.add(*q("i7_class_matrix", CM, "SELECT x.c AS class_i, y.c AS class_j, round(CASE WHEN x.c = y.c THEN 0.5 ELSE coalesce(p, 0.5) END, 6) AS p, coalesce(n, 0) AS n FROM cl x CROSS JOIN cl y LEFT JOIN m ON m.ci = x.c AND m.cj = y.c", "feat"))
def i7(s, d):
    f = V.features(s, d).where("strategy_id is not null and borda_emp is not null and prompt is not null").select("prompt", "feature_id", "strategy_id", "borda_emp")
    b = f.toDF("prompt", "other", "class_j", "borda_j")
    p = f.join(b, "prompt").where("feature_id <> other").select(F.col("strategy_id").alias("class_i"), "class_j", ((F.signum(F.col("borda_emp") - F.col("borda_j")) + 1) / 2).alias("p"))
    classes = s.range(1, 8).select(F.col("id").cast("int").alias("class"))
    return matrix.class_matrix(p, classes).withColumn("p", r6("p"))


@R.add(*q("i6_bt_implied", "", "SELECT a.completion_id AS i, b.completion_id AS j, round(a.avg / (a.avg + b.avg), 6) AS p FROM rated a JOIN rated b ON a.prompt_id = b.prompt_id AND a.idx <> b.idx WHERE a.avg + b.avg > 0"))
def i6(s, d):
    """theta_i / (theta_i + theta_j) with the average rating as theta."""
    p = V.pairs(V.rated_entries(s, d)).where("a.avg + b.avg > 0")
    return p.select(F.col("a.completion_id").alias("i"), F.col("b.completion_id").alias("j"), r6(F.col("a.avg") / (F.col("a.avg") + F.col("b.avg"))).alias("p"))
