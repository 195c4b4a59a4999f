"""Scores, losses and ranking tables (2.7)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tallyloom.functions import scoring as S
from tallyloom.plans import views as V
from tallyloom.plans.views import skew_sql, sql
from tallyloom.queries.registry import Registry

REGISTRY = R = Registry()
r6 = lambda c: F.round(c, 6)
SIG = "CASE WHEN {0} >= 0 THEN 1 / (1 + exp(-({0}))) ELSE exp({0}) / (1 + exp({0})) END"
SP = "(greatest({0}, 0) + ln(1 + exp(-abs({0}))))"
sig, sp = SIG.format, SP.format


def vp(s, d):
    return S.candidate_pairs(V.vectors(s, d))


def pairwise(name, expr, q):
    @R.add(name, sql("vp", f"SELECT prompt_id, i, j, round({q}, 6) AS x FROM vp"))
    def run(s, d):
        return vp(s, d).select("prompt_id", "i", "j", r6(expr()).alias("x"))


pairwise("h1_bt_prob", lambda: S.sigmoid((F.col("ri") - F.col("rj")) / 0.5), sig("((ri - rj) / 0.5)"))
pairwise("h2_skew_2d", lambda: F.col("s2"), "s2")
pairwise("h3_skew_score", lambda: F.col("s"), "s")
pairwise("h4_gated_skew", lambda: F.col("sg"), "sg")
pairwise("h6_prob_matrix", lambda: S.sigmoid(F.col("s") / 0.1), sig("(s / 0.1)"))
pairwise("h7_score_table", lambda: F.col("ri") - F.col("rj"), "(ri - rj)")
pairwise("h8_logit_difference", lambda: F.col("vi")[0] - F.col("vi")[1], "(vi[1] - vi[2])")
pairwise("h11_scalar_prob", lambda: S.sigmoid(F.col("ri") - F.col("rj")), sig("(ri - rj)"))
pairwise("z3_gated_unscaled", lambda: F.col("sg") / (F.size("vi") / 2), "(sg / (len(vi) // 2))")

TAUS = (0.5, 1.0, 1.5, 2.0)  # learnable temperatures, given here; block k has the k-th, over and over
W5 = [1 / max(math.log1p(math.exp(-t)), 1e-2) for t in TAUS]


@R.add("h5_tau_weighted_skew", sql("vec", f"SELECT a.prompt_id, a.idx AS i, b.idx AS j, round({skew_sql('a.v', 'b.v', f'{W5!r}[(k - 1) % {len(W5)} + 1]')}, 6) AS x FROM vec a JOIN vec b ON a.prompt_id = b.prompt_id AND a.idx <> b.idx"))
def h5(s, d):
    """Block weights 1 / max(softplus(-tau), 0.01)."""
    w = F.array(*map(F.lit, W5))
    weight = lambda x, k: x * F.get(w, F.pmod(F.floor(k / 2), F.lit(len(W5))).cast("int"))
    v = V.vectors(s, d).withColumn("jv", F.transform(S.turned(F.col("v")), weight))
    g = v.groupBy("prompt_id").agg(F.collect_list(F.struct("idx", "v", "jv")).alias("rs"))
    p = g.select("prompt_id", "rs", F.explode("rs").alias("a")).select("prompt_id", "a", F.explode("rs").alias("b")).where("a.idx <> b.idx")
    return p.select("prompt_id", F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), r6(S.dot(F.col("a.jv"), F.col("b.v"))).alias("x"))


# H6 with 8 components, as preference models are trained with.
@R.add("h6_prob_matrix_8", sql("vec", f"SELECT a.prompt_id, a.idx AS i, b.idx AS j, round({sig('(' + skew_sql('a.v', 'b.v', blocks='4') + ' / 0.1)')}, 6) AS x FROM vec a JOIN vec b ON a.prompt_id = b.prompt_id AND a.idx <> b.idx"))
def h6_8(s, d):
    p = S.candidate_pairs(V.vectors(s, d).withColumn("v", F.slice("v", 1, 8)))
    return p.select("prompt_id", "i", "j", r6(S.sigmoid(F.col("s") / 0.1)).alias("x"))


# A raw score table T that is not skew: s plus the row's reward.
T = "tb AS (SELECT prompt_id, i, j, s + ri AS t FROM vp), tt AS (SELECT a.prompt_id, a.i, a.j, a.t AS tij, b.t AS tji FROM tb a JOIN tb b ON a.prompt_id = b.prompt_id AND a.i = b.j AND a.j = b.i)"


def tt(s, d):
    """T(i, j) and T(j, i) side by side: the transposed score is -s plus the other reward, so no self-join."""
    return vp(s, d).select("prompt_id", "i", "j", (F.col("s") + F.col("ri")).alias("tij"), (-F.col("s") + F.col("rj")).alias("tji"))


def w(base, extra, body):
    return sql(base, "SELECT 1").replace(" SELECT 1", (", " + extra if extra else "") + " " + body)


@R.add("h9_max_logits", w("vp", T, "SELECT prompt_id, i, round(sum(tij - tji) / 4, 6) AS score FROM tt GROUP BY 1, 2"))
def h9(s, d):
    return tt(s, d).groupBy("prompt_id", "i").agg(r6(F.sum(F.col("tij") - F.col("tji")) / 4).alias("score"))


@R.add("h10_max_wins", w("vp", T, "SELECT prompt_id, i, round(sum(CASE WHEN tij > 0 THEN 1 ELSE 0 END) + sum(CASE WHEN tji < 0 THEN 1 ELSE 0 END) / 4.0, 6) AS score FROM tt GROUP BY 1, 2"))
def h10(s, d):
    return tt(s, d).groupBy("prompt_id", "i").agg(r6(F.count_if(F.col("tij") > 0) + F.count_if(F.col("tji") < 0) / 4.0).alias("score"))


@R.add("h12_table_prob", w("vp", T, f"SELECT prompt_id, i, j, round({sig('(tij - tji)')}, 6) AS p FROM tt"))
def h12(s, d):
    return tt(s, d).select("prompt_id", "i", "j", r6(S.sigmoid(F.col("tij") - F.col("tji"))).alias("p"))


@R.add("h13_signed_scores", w("vp", T, "SELECT prompt_id, i, j, round(tij - tji, 6) AS s FROM tt"))
def h13(s, d):
    return tt(s, d).select("prompt_id", "i", "j", r6(F.col("tij") - F.col("tji")).alias("s"))


BW = T + f", pr AS (SELECT prompt_id, i, j, {sig('(tij - tji)')} AS p FROM tt), rw AS (SELECT prompt_id, i, (sum(p) + 0.5) / count(*) AS win, sum(p) AS sc, count(*) AS n FROM pr GROUP BY 1, 2), bw AS (SELECT prompt_id, arg_max(i, (round(sc, 9), -i)) AS best, arg_min(i, (round(sc, 9), i)) AS worst FROM rw GROUP BY 1)"


@R.add("h14_best_worst", w("vp", BW, "SELECT bw.prompt_id, best, worst, round(pr.p, 6) AS prob, round(a.win, 6) AS win_best, round(b.win, 6) AS win_worst FROM bw JOIN pr ON pr.prompt_id = bw.prompt_id AND pr.i = best AND pr.j = worst JOIN rw a ON a.prompt_id = bw.prompt_id AND a.i = best JOIN rw b ON b.prompt_id = bw.prompt_id AND b.i = worst"))
def h14(s, d):
    """Best and worst candidate with their probabilities; the row of probabilities stays with its candidate, so nothing is joined back."""
    p = tt(s, d).select("prompt_id", "i", "j", S.sigmoid(F.col("tij") - F.col("tji")).alias("p"))
    r = p.groupBy("prompt_id", "i").agg(F.sum("p").alias("sc"), F.count("*").alias("n"), F.map_from_entries(F.collect_list(F.struct("j", "p"))).alias("ps"))
    win = (F.col("sc") + 0.5) / F.col("n")
    x = F.struct("i", win.alias("win"), "ps")
    g = r.groupBy("prompt_id").agg(F.max_by(x, F.struct(F.round("sc", 9), -F.col("i"))).alias("b"), F.min_by(x, F.struct(F.round("sc", 9), F.col("i"))).alias("w"))
    return g.where("b.i <> w.i").select("prompt_id", F.col("b.i").alias("best"), F.col("w.i").alias("worst"), r6(F.try_element_at("b.ps", F.col("w.i"))).alias("prob"), r6("b.win").alias("win_best"), r6("w.win").alias("win_worst"))


@R.add("h15_accuracy", sql("vp", "SELECT round(avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END), 6) AS skew_accuracy, round(avg(CASE WHEN ri > rj THEN 1.0 ELSE 0.0 END), 6) AS reward_accuracy FROM vp WHERE i < j"))
def h15(s, d):
    return vp(s, d).where("i < j").agg(r6(F.avg((F.col("s") > 0).cast("double"))).alias("skew_accuracy"), r6(F.avg((F.col("ri") > F.col("rj")).cast("double"))).alias("reward_accuracy"))


@R.add("h16_batch_summary", sql("vp", f"SELECT round(avg({sig('s')}), 6) AS mean_prob, round(avg(CASE WHEN {sig('s')} > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS share_prob, round(avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_result FROM vp WHERE i < j"))
def h16(s, d):
    p = S.sigmoid("s")
    return vp(s, d).where("i < j").agg(r6(F.avg(p)).alias("mean_prob"), r6(F.avg((p > 0.5).cast("double"))).alias("share_prob"), r6(F.avg((F.col("s") > 0).cast("double"))).alias("share_result"))


# Sections of subsets; a section's accuracy is weighted by the counts of its subsets.
SECTIONS = {"helpfulness": "quality", "instruction_following": "quality", "honesty": "trust", "truthfulness": "trust"}
SUBSET = "ss AS (SELECT dimension AS name, count(*) AS n, avg(CASE WHEN score_chosen > score_rejected THEN 1.0 ELSE 0.0 END) AS accuracy FROM pref WHERE score_chosen >= 0 AND score_rejected >= 0 GROUP BY 1), se AS (SELECT " + "CASE name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SECTIONS.items()) + " END AS name, sum(n) AS n, sum(accuracy * n) / sum(n) AS accuracy FROM ss WHERE name IN (" + ", ".join(f"'{k}'" for k in SECTIONS) + ") GROUP BY 1)"


@R.add("h17_subset_accuracy", w("pref", SUBSET, "SELECT 'subset' AS kind, name, n, round(accuracy, 6) AS accuracy FROM ss UNION ALL SELECT 'section', name, n, round(accuracy, 6) FROM se UNION ALL SELECT 'average', 'all', sum(n), round(avg(accuracy), 6) FROM se"))
def h17(s, d):
    """Subsets, sections weighted by example counts, and the plain mean of the sections."""
    p = V.preferences(s, d).where("score_chosen >= 0 and score_rejected >= 0")
    ss = p.groupBy(F.col("dimension").alias("name")).agg(F.count("*").alias("n"), F.avg((F.col("score_chosen") > F.col("score_rejected")).cast("double")).alias("accuracy"))
    section = F.element_at(F.create_map(*(F.lit(x) for kv in SECTIONS.items() for x in kv)), F.col("name"))
    se = ss.where(F.col("name").isin(*SECTIONS)).groupBy(section.alias("name")).agg(F.sum("n").alias("n"), (F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")).alias("accuracy"))
    out = lambda df, k: df.select(F.lit(k).alias("kind"), "name", "n", r6("accuracy").alias("accuracy"))
    mean = se.agg(F.lit("all").alias("name"), F.sum("n").alias("n"), F.avg("accuracy").alias("accuracy"))
    return out(ss, "subset").unionByName(out(se, "section")).unionByName(out(mean, "average"))


X = "(ri - rj)"
TAU3, TAU4 = max(math.log1p(math.exp(0.7)), 1e-2), max(math.log1p(math.exp(-0.7)), 1e-2)
LOSSES = {
    "l1_pairwise": ("x", "log", 0.5), "l2_pairwise_regression": ("x", "reg", 0.5), "l3_learnable_tau": ("x", "log", TAU3), "l4_learnable_tau_regression": ("x", "reg", TAU4),
    "l5_skew_2d": ("s2", "log", 0.1), "l6_skew_2d_regression": ("s2", "reg", 0.1), "l7_skew_2d_learnable": ("s2", "log", TAU3), "l8_skew_2d_learnable_regression": ("s2", "reg", TAU3),
    "l9_skew": ("s", "log", 0.1), "l10_skew_regression": ("s", "reg", 0.1), "l11_skew_learnable": ("s", "log", TAU3), "l12_gated": ("sg", "log", 0.1), "l13_gated_regression": ("sg", "reg", 0.1),
}


def loss(name, on, kind, tau):
    q = f"(({X if on == 'x' else on}) / {tau!r})"
    body = sp(f"(-{q})") if kind == "log" else f"0.5 * ({q} - 10) * ({q} - 10)"

    @R.add(name, sql("vp", f"SELECT round(avg({body}), 5) AS loss, count(*) AS n FROM vp WHERE i < j"))
    def run(s, d):
        x = F.col("ri") - F.col("rj") if on == "x" else F.col(on)
        return vp(s, d).where("i < j").agg(F.round(F.avg(S.logistic(x, tau) if kind == "log" else S.regression(x, tau)), 5).alias("loss"), F.count("*").alias("n"))


for _n, (_o, _k, _t) in LOSSES.items():
    loss(_n, _o, _k, _t)


@R.add("l2_margin_regression", sql("pref", f"SELECT round(avg(0.5 * ((score_chosen - score_rejected) / 0.5 - 5 * {sig('coalesce(margin, 0)')}) * ((score_chosen - score_rejected) / 0.5 - 5 * {sig('coalesce(margin, 0)')})), 5) AS loss FROM pref WHERE score_chosen >= 0 AND score_rejected >= 0"))
def l2m(s, d):
    x = (F.col("score_chosen") - F.col("score_rejected")) / 0.5 - 5 * S.sigmoid(F.coalesce("margin", F.lit(0.0)))
    return V.preferences(s, d).where("score_chosen >= 0 and score_rejected >= 0").agg(F.round(F.avg(0.5 * x * x), 5).alias("loss"))


# Token log-probabilities stand-in: -|component| of a vector; the first two tokens are the prompt and masked.
LP = "lp AS (SELECT prompt_id, idx, [-abs(x) FOR x IN v[3:]] AS lp FROM vec)"


def lp(s, d):
    return V.vectors(s, d).select("prompt_id", "idx", F.transform(F.slice("v", F.lit(3), F.size("v") - 2), lambda x: -F.abs(x)).alias("lp"))


_sum = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


@R.add("l14_l16_sft", w("vec", LP, "SELECT round(-sum(list_sum(lp)) / sum(len(lp)), 6) AS vanilla, round(-avg(list_sum(lp) / len(lp)), 6) AS mean, round(-avg(list_sum(lp)), 6) AS sum FROM lp"))
def l14(s, d):
    """L14 over tokens, L15 of per-row means, L16 of per-row sums."""
    t = _sum(F.col("lp"))
    return lp(s, d).agg(r6(-F.sum(t) / F.sum(F.size("lp"))).alias("vanilla"), r6(-F.avg(t / F.size("lp"))).alias("mean"), r6(-F.avg(t)).alias("sum"))


@R.add("l17_reference_free_dpo", w("vec", LP, f"SELECT round(avg({sp('(-(2.0 * (a.m - b.m) - 0.1))')}), 6) AS loss FROM (SELECT prompt_id, list_sum(lp) / len(lp) AS m FROM lp WHERE idx = 0) a JOIN (SELECT prompt_id, list_sum(lp) / len(lp) AS m FROM lp WHERE idx = 1) b USING (prompt_id)"))
def l17(s, d):
    m = lp(s, d).where("idx < 2").groupBy("prompt_id").agg(*(F.max(F.when(F.col("idx") == k, _sum(F.col("lp")) / F.size("lp"))).alias(n) for k, n in ((0, "c"), (1, "r"))))
    return m.where("c is not null and r is not null").agg(r6(F.avg(S.softplus(-(2.0 * (F.col("c") - F.col("r")) - 0.1)))).alias("loss"))


@R.add("l18_causal_lm", w("vec", LP, "SELECT round(-avg(x), 6) AS loss, count(*) AS tokens FROM (SELECT unnest(lp) AS x FROM lp)"))
def l18(s, d):
    return lp(s, d).select(F.explode("lp").alias("x")).agg(r6(-F.avg("x")).alias("loss"), F.count("*").alias("tokens"))


@R.add("l19_mixed_ema", w("vec", LP, "SELECT prompt_id, round(0.9 * (-s) + 0.1 * m, 6) AS mixed, round(0.1 * list_reduce(list_prepend(0.0, lp), lambda a, x: 0.9 * a + 0.1 * (-x)), 6) AS ema FROM (SELECT prompt_id, lp, list_sum(lp) AS s, -list_sum(lp) / len(lp) AS m FROM lp WHERE idx = 0)"))
def l19(s, d):
    """(1 - c) preference + c language loss, and the 0.9 / 0.1 moving average over the ordered tokens."""
    t = _sum(F.col("lp"))
    ema = F.aggregate("lp", F.lit(0.0), lambda a, x: 0.9 * a - 0.1 * x)
    return lp(s, d).where("idx = 0").select("prompt_id", r6(0.9 * (-t) + 0.1 * (-t / F.size("lp"))).alias("mixed"), r6(0.1 * ema).alias("ema"))


@R.add("z2_unit_skew", sql("vec", f"SELECT a.prompt_id, a.idx AS i, b.idx AS j, round({skew_sql('a.v', 'b.v')} / (sqrt(list_sum([x * x FOR x IN a.v])) * sqrt(list_sum([x * x FOR x IN b.v]))), 6) AS x FROM vec a JOIN vec b ON a.prompt_id = b.prompt_id AND a.idx <> b.idx"))
def z2(s, d):
    p = S.candidate_pairs(V.vectors(s, d).withColumn("v", S.unit(F.col("v"))))
    return p.select("prompt_id", "i", "j", r6("s").alias("x"))


@R.add("z4_sparse_encode", sql("vec", "SELECT prompt_id, idx, list_aggregate([CASE WHEN 2.0 * x / n - 0.1 > 0.2 THEN 1 ELSE 0 END FOR x IN v], 'sum') AS active FROM (SELECT *, sqrt(list_sum([x * x FOR x IN v])) AS n FROM vec)"))
def z4(s, d):
    """Rescale to the data set's norm, subtract the bias, zero below the threshold; here counted."""
    x = F.transform(S.unit(F.col("v")), lambda y: (2.0 * y - 0.1 > 0.2).cast("int"))
    return V.vectors(s, d).select("prompt_id", "idx", F.aggregate(x, F.lit(0), lambda a, y: a + y).alias("active"))
