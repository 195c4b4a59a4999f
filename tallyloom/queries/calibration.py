"""Calibration and probabilistic metrics (2.11). The model's probability is a logistic of the length difference."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import scoring as S
from tallyloom.operators import matrix
from tallyloom.plans import views as V
from tallyloom.plans.views import sql
from tallyloom.queries.registry import Registry
from tallyloom.session import table

REGISTRY = R = Registry()
r6 = lambda c: F.round(c, 6)



def cal(s, d):
    """(row_id, prompt, winner, loser, p_emp, p); see the SQL relation of the same name."""
    o = V.outcomes(s, d).withColumns({"a": F.least("winner", "loser"), "b": F.greatest("winner", "loser")})
    w = matrix.both_ways(matrix.win_counts(o))
    j = o.join(w, ["prompt", "a", "b"])
    z = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), (F.length("winner") - F.length("loser")) / 64.0))
    emp = F.when(F.col("winner") < F.col("loser"), F.col("ab")).otherwise(F.col("ba")) / (F.col("ab") + F.col("ba"))
    return j.select("row_id", "prompt", "winner", "loser", emp.alias("p_emp"), S.sigmoid(z).alias("p"))


CL = "greatest({e}, least(1 - {e}, {x}))"


def one(name, q, **cols):
    @R.add(name, sql("cal", f"SELECT {q} FROM cal"))
    def run(s, d):
        return cal(s, d).agg(*(r6(f()).alias(n) for n, f in cols.items()))


p, e = lambda: F.col("p"), lambda: F.col("p_emp")
k = lambda x, eps: S.clip(x, eps)
one("cp1_brier", "round(avg((p - p_emp) * (p - p_emp)), 6) AS brier", brier=lambda: F.avg((p() - e()) * (p() - e())))
one("cp2a_nll_correct", f"round(avg(-ln({CL.format(e='1e-6', x='CASE WHEN p > 0.5 THEN p ELSE 1 - p END')})), 6) AS nll", nll=lambda: F.avg(-F.log(k(F.when(p() > 0.5, p()).otherwise(1 - p()), 1e-6))))
one("cp2b_nll", f"round(-avg(ln({CL.format(e='1e-7', x='p')})), 6) AS nll", nll=lambda: -F.avg(F.log(k(p(), 1e-7))))
KLF = "{a} * ln({a} / {b}) + (1 - {a}) * ln((1 - {a}) / (1 - {b}))"
for _eps in ("1e-6", "1e-7", "1e-9"):
    _a, _b = CL.format(e=_eps, x="p_emp"), CL.format(e=_eps, x="p")

    def _kl(x, y, eps=float(_eps)):
        a, b = k(x(), eps), k(y(), eps)
        return F.avg(a * F.log(a / b) + (1 - a) * F.log((1 - a) / (1 - b)))

    one(f"cp4_kl_{_eps.replace('1e-', 'eps')}", f"round(avg({KLF.format(a=_a, b=_b)}), 6) AS forward, round(avg({KLF.format(a=_b, b=_a)}), 6) AS reverse", forward=lambda f=_kl: f(e, p), reverse=lambda f=_kl: f(p, e))
one("cp5_entropy", "round(avg(-(p * ln(p) + (1 - p) * ln(1 - p))), 6) AS entropy, round(avg(abs(p - 0.5)), 6) AS confidence", entropy=lambda: F.avg(-(p() * F.log(p()) + (1 - p()) * F.log(1 - p()))), confidence=lambda: F.avg(F.abs(p() - 0.5)))
one("cp6_strong_weak", "round(avg(CASE WHEN p > 0.8 THEN CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END END), 6) AS strong, round(avg(CASE WHEN p > 0.5 AND p <= 0.6 THEN CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END END), 6) AS weak", strong=lambda: F.avg(F.when(p() > 0.8, (p() > 0.5).cast("double"))), weak=lambda: F.avg(F.when((p() > 0.5) & (p() <= 0.6), (p() > 0.5).cast("double"))))
one("cp12_score_stats", "round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS std, round(min(p), 6) AS lo, round(max(p), 6) AS hi", mean=lambda: F.avg(p()), std=lambda: F.stddev_pop(p()), lo=lambda: F.min(p()), hi=lambda: F.max(p()))


def bins(name, bin_sql, bin_col, acc_sql, acc):
    """ECE from ten bins; a row outside every bin counts in the denominator only."""
    @R.add(name, sql("cal", f"SELECT round(sum(abs(acc - conf) * n) / (SELECT count(*) FROM cal), 6) AS ece FROM (SELECT {bin_sql} AS b, avg({acc_sql}) AS acc, avg(p) AS conf, count(*) AS n FROM cal GROUP BY 1) WHERE b BETWEEN 0 AND 9"))
    def run(s, d):
        g = cal(s, d).groupBy(bin_col().alias("b")).agg(F.avg(acc()).alias("acc"), F.avg("p").alias("conf"), F.count("*").alias("n"))
        inside = F.when(F.col("b").between(0, 9), F.abs(F.col("acc") - F.col("conf")) * F.col("n"))
        return g.agg(r6(F.sum(inside) / F.sum("n")).alias("ece"))


bins("cp3a_ece_correct", "ceil(p * 10) - 1", lambda: F.ceil(F.col("p") * 10) - 1, "CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END", lambda: (F.col("p") > 0.5).cast("double"))
bins("cp3b_ece_empirical", "floor(p * 10)", lambda: F.floor(F.col("p") * 10), "p_emp", lambda: F.col("p_emp"))

# Consistency buckets, which overlap.
BUCKETS = {
    "fully_consistent_0": (0.0, 0.01),
    "fully_consistent_1": (0.99, 1.01),
    "highly_consistent": (0.8, 0.99),
    "moderately_consistent": (0.6, 0.8),
    "low_consistency": (0.51, 0.6),
    "fully_inconsistent": (0.49, 0.51),
    "reversed": (0.0, 0.49),
}


@R.add("cp7_bucket_accuracy", sql("cal", """SELECT b.name AS bucket, count(p) AS n, round(coalesce(avg(CASE WHEN p > 0.5 THEN 1.0 WHEN p IS NOT NULL THEN 0.0 END), 0), 6) AS accuracy FROM
 (VALUES ('fully_consistent_0', 0.0, 0.01), ('reversed', 0.0, 0.49), ('fully_inconsistent', 0.49, 0.51), ('low_consistency', 0.51, 0.6), ('moderately_consistent', 0.6, 0.8), ('highly_consistent', 0.8, 0.99), ('fully_consistent_1', 0.99, 1.01)) b(name, lo, hi) LEFT JOIN cal ON p_emp >= lo AND p_emp < hi GROUP BY 1"""))
def p7(s, d):
    """Seven conditional sums in one pass: a row may match two buckets, and an empty bucket counts 0."""
    inside = lambda lo, hi: (F.col("p_emp") >= lo) & (F.col("p_emp") < hi)
    one = cal(s, d).agg(*(F.struct(F.lit(n).alias("bucket"), F.count_if(inside(*x)).alias("n"), r6(F.coalesce(F.avg(F.when(inside(*x), (F.col("p") > 0.5).cast("double"))), F.lit(0.0))).alias("accuracy")).alias(n) for n, x in BUCKETS.items()))
    return one.select(F.explode(F.array(*BUCKETS)).alias("x")).select("x.*")


C3 = "CASE WHEN p_emp > 1 - 1e-4 THEN 'consistent' WHEN p_emp > 0.5 + 1e-4 THEN 'majority' ELSE 'contested' END"


@R.add("cp8_class_accuracy", sql("cal", f"SELECT {C3} AS class, count(*) AS n, round(avg(CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM cal GROUP BY 1"))
def p8(s, d):
    return cal(s, d).groupBy(F.expr(C3).alias("class")).agg(F.count("*").alias("n"), r6(F.avg((F.col("p") > 0.5).cast("double"))).alias("accuracy"))


@R.add("cp9_calibration_curve", sql("cal", "SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(p_emp), 6) AS observed FROM cal GROUP BY 1"))
def p9(s, d):
    return cal(s, d).groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("p")).alias("predicted"), r6(F.avg("p_emp")).alias("observed"))


@R.add("cp9_calibration_filled", sql("cal", "SELECT b.bin, coalesce(n, 0) AS n, round(coalesce(o, (b.bin + 0.5) / 10), 6) AS observed FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p_emp) AS o FROM cal GROUP BY 1) x ON x.bin = b.bin"))
def p9f(s, d):
    g = cal(s, d).groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p_emp").alias("o"))
    return s.range(10).withColumnRenamed("id", "bin").join(F.broadcast(g), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), r6(F.coalesce("o", (F.col("bin") + 0.5) / 10)).alias("observed"))  # ten rows


LEVELS = (0.0, 0.25, 0.5, 0.75, 1.0)


@R.add("cp10_prob_by_level", sql("cal", f"SELECT l AS level, count(*) AS n, round(avg(p), 6) AS mean_prob FROM cal JOIN (SELECT unnest({list(LEVELS)}::DOUBLE[]) AS l) x ON abs(p_emp - l) < 0.01 GROUP BY 1"))
def p10(s, d):
    own = F.coalesce(*(F.when(F.abs(F.col("p_emp") - x) < 0.01, F.lit(x)) for x in LEVELS))
    return cal(s, d).groupBy(own.alias("level")).agg(F.count("*").alias("n"), r6(F.avg("p")).alias("mean_prob")).where("level is not null")


@R.add("cp11_position_bias", sql("cal", "SELECT winner < loser AS first, count(*) AS n, round(avg(CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM cal GROUP BY 1"))
def p11(s, d):
    return cal(s, d).groupBy((F.col("winner") < F.col("loser")).alias("first")).agg(F.count("*").alias("n"), r6(F.avg((F.col("p") > 0.5).cast("double"))).alias("accuracy"))


# Chosen and rejected embeddings: the even and the odd candidates.
EM = "em AS (SELECT idx % 2 = 0 AS chosen, v, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM vec)"
PD = EM + ", pd AS (SELECT dim, avg(x) FILTER (chosen) AS cm, stddev_pop(x) FILTER (chosen) AS cs, avg(x) FILTER (NOT chosen) AS rm, stddev_pop(x) FILTER (NOT chosen) AS rs FROM em GROUP BY 1)"


def w(base, extra, body):
    return sql(base, "SELECT 1").replace(" SELECT 1", ", " + extra + " " + body)


def per_dim(s, d):
    x = V.vectors(s, d).select((F.col("idx") % 2 == 0).alias("chosen"), F.posexplode("v").alias("dim", "x"))
    c, r = F.when(F.col("chosen"), F.col("x")), F.when(~F.col("chosen"), F.col("x"))
    return x.groupBy("dim").agg(F.avg(c).alias("cm"), F.stddev_pop(c).alias("cs"), F.avg(r).alias("rm"), F.stddev_pop(r).alias("rs"))


@R.add("cp13_embedding_stats", w("vec", PD, "SELECT dim, round(cm, 6) AS chosen_mean, round(cs, 6) AS chosen_std, round(rm, 6) AS rejected_mean, round(rs, 6) AS rejected_std FROM pd"))
def p13(s, d):
    return per_dim(s, d).select("dim", *(r6(c).alias(n) for c, n in (("cm", "chosen_mean"), ("cs", "chosen_std"), ("rm", "rejected_mean"), ("rs", "rejected_std"))))


@R.add("cp13_embedding_summary", w("vec", PD + ", nm AS (SELECT idx % 2 = 0 AS chosen, sqrt(list_sum([x * x FOR x IN v])) AS n FROM vec)", "SELECT (SELECT round(avg(n), 6) FROM nm WHERE chosen) AS chosen_norm_mean, (SELECT round(stddev_pop(n), 6) FROM nm WHERE chosen) AS chosen_norm_std, (SELECT round(avg(n), 6) FROM nm WHERE NOT chosen) AS rejected_norm_mean, (SELECT round(stddev_pop(n), 6) FROM nm WHERE NOT chosen) AS rejected_norm_std, round(avg(cs * cs), 6) AS variance_chosen, round(avg(rs * rs), 6) AS variance_rejected, round(sqrt(sum((cm - rm) * (cm - rm))), 6) AS centroid_distance, avg(cs * cs) < 1e-4 OR avg(rs * rs) < 1e-4 AS collapsed FROM pd"))
def p13s(s, d):
    """Norms, mean variance over the components, distance of the centroids, collapse."""
    n = F.sqrt(S.dot(F.col("v"), F.col("v")))
    c, r = F.when(F.col("idx") % 2 == 0, n), F.when(F.col("idx") % 2 == 1, n)
    norms = V.vectors(s, d).agg(*(r6(f(x)).alias(f"{k}_norm_{m}") for k, x in (("chosen", c), ("rejected", r)) for f, m in ((F.avg, "mean"), (F.stddev_pop, "std"))))
    vc, vr = F.avg(F.col("cs") * F.col("cs")), F.avg(F.col("rs") * F.col("rs"))
    g = F.col("cm") - F.col("rm")
    rest = per_dim(s, d).agg(r6(vc).alias("variance_chosen"), r6(vr).alias("variance_rejected"), r6(F.sqrt(F.sum(g * g))).alias("centroid_distance"), ((vc < 1e-4) | (vr < 1e-4)).alias("collapsed"))
    return norms.crossJoin(rest)  # one row each


@R.add("cp14_separability", sql("vp", "SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(max(x) - min(x), 6) AS spread, stddev_pop(x) < 0.1 AS collapsed FROM (SELECT unnest([ri, rj]) AS x FROM vp WHERE i < j)"))
def p14(s, d):
    x = S.candidate_pairs(V.vectors(s, d)).where("i < j").select(F.explode(F.array("ri", "rj")).alias("x"))
    return x.agg(r6(F.avg("x")).alias("mean"), r6(F.stddev_pop("x")).alias("std"), r6(F.max("x") - F.min("x")).alias("spread"), (F.stddev_pop("x") < 0.1).alias("collapsed"))


# Two models of a pair's outcome: A looks at the lengths, B at the numbers of sentences.
ZB = "greatest(-12.0, least(12.0, (len(string_split(winner, '. ')) - len(string_split(loser, '. '))) / 2.0))"
BINS = range(10)


def _metric_sql(p):
    """Nine metrics of one model for a prompt (see model_metrics)."""
    a, b = CL.format(e="1e-6", x="p_emp"), CL.format(e="1e-6", x=p)
    ece = " + ".join(f"abs(coalesce(avg(p_emp) FILTER (floor({p} * 10) = {k}), 0) - coalesce(avg({p}) FILTER (floor({p} * 10) = {k}), 0)) * count(*) FILTER (floor({p} * 10) = {k})" for k in BINS)
    hit = f"CASE WHEN {p} > 0.5 THEN 1.0 ELSE 0.0 END"
    return {
        "accuracy": f"avg({hit})", "kl_div": f"avg({KLF.format(a=a, b=b)})", "nll": f"-avg(ln({b}))", "brier": f"avg(({p} - p_emp) * ({p} - p_emp))", "ece": f"({ece}) / count(*)",
        "avg_confidence": f"avg(abs({p} - 0.5))", "acc_strong_conf": f"avg({hit}) FILTER ({p} > 0.8)", "acc_weak_conf": f"avg({hit}) FILTER ({p} > 0.5 AND {p} <= 0.6)", "entropy": f"avg(-({b} * ln({b}) + (1 - {b}) * ln(1 - {b})))",
    }


NINE = tuple(_metric_sql("p"))
TWO = f"tw AS (SELECT *, CASE WHEN {ZB} >= 0 THEN 1 / (1 + exp(-{ZB})) ELSE exp({ZB}) / (1 + exp({ZB})) END AS pb FROM cal), pp AS (SELECT prompt, " + ", ".join(f"{q} AS {m}_{x}" for x, p_ in (("a", "p"), ("b", "pb")) for m, q in _metric_sql(p_).items()) + " FROM tw GROUP BY 1)"


def model_metrics(s, d):
    """One row a prompt: accuracy, KL, NLL, Brier score, calibration error, confidence, accuracy at strong and weak confidence
    and entropy of both models; NULL where a prompt has no such pair."""
    z = (F.size(F.split("winner", r"\. ")) - F.size(F.split("loser", r"\. "))) / 2.0
    c = cal(s, d).withColumn("pb", S.sigmoid(F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z))))

    def nine(x, n):
        a, b = S.clip(F.col("p_emp"), 1e-6), S.clip(F.col(x), 1e-6)
        p_, hit = F.col(x), (F.col(x) > 0.5).cast("double")
        bin_ = lambda k: F.floor(p_ * 10) == k
        mean = lambda v, k: F.coalesce(F.avg(F.when(bin_(k), v)), F.lit(0.0))
        ece = sum((F.abs(mean(F.col("p_emp"), k) - mean(p_, k)) * F.count_if(bin_(k)) for k in BINS), F.lit(0.0)) / F.count("*")
        out = (F.avg(hit), F.avg(a * F.log(a / b) + (1 - a) * F.log((1 - a) / (1 - b))), -F.avg(F.log(b)), F.avg((p_ - F.col("p_emp")) * (p_ - F.col("p_emp"))), ece, F.avg(F.abs(p_ - 0.5)), F.avg(F.when(p_ > 0.8, hit)), F.avg(F.when((p_ > 0.5) & (p_ <= 0.6), hit)), F.avg(-(b * F.log(b) + (1 - b) * F.log(1 - b))))
        return [v.alias(f"{m}_{n}") for m, v in zip(NINE, out)]

    return c.groupBy("prompt").agg(*nine("p", "a"), *nine("pb", "b"))


@R.add("cp15_metric_rollup", w("cal", TWO, " UNION ALL ".join(f"SELECT '{x}' AS model, '{m}' AS metric, count({m}_{x}) AS n, round(avg({m}_{x}), 5) AS mean, round(stddev_pop({m}_{x}), 5) AS std, round(min({m}_{x}), 5) AS lo, round(max({m}_{x}), 5) AS hi FROM pp" for x in "ab" for m in NINE)))
def p15(s, d):
    """Mean, deviation and range over prompts of each metric of either model, skipping prompts without it."""
    r5 = lambda c: F.round(c, 5)
    names = [(x, m) for x in "ab" for m in NINE]
    one = model_metrics(s, d).agg(*(F.struct(F.lit(x).alias("model"), F.lit(m).alias("metric"), F.count(f"{m}_{x}").alias("n"), r5(F.avg(f"{m}_{x}")).alias("mean"), r5(F.stddev_pop(f"{m}_{x}")).alias("std"), r5(F.min(f"{m}_{x}")).alias("lo"), r5(F.max(f"{m}_{x}")).alias("hi")).alias(f"{x}{m}") for x, m in names))
    return one.select(F.explode(F.array(*(f"{x}{m}" for x, m in names))).alias("x")).select("x.*")


@R.add("cp15_flow_rollup")
def p15f(s, d):
    """The other three metrics of the roll-up: loop, curl and harmonic share of each model's predicted flow on the observed
    pairs, by prompt (at most 200 responses, as the decomposition is defined)."""
    import numpy as np

    from tallyloom.operators import kernels as K
    from tallyloom.queries.cycles import count_rows

    b = matrix.both_ways(matrix.win_counts(V.outcomes(s, d)))

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for q_, xs, es in zip(batch["prompt_id"], batch["xs"], batch["es"]):
                at, seen = {x: k for k, x in enumerate(xs)}, np.zeros((len(xs), len(xs)), bool)
                for e_ in es:
                    seen[at[e_["a"]], at[e_["b"]]] = seen[at[e_["b"]], at[e_["a"]]] = True
                for name, score in (("a", np.array([len(x) / 64.0 for x in xs])), ("b", np.array([len(x.split(". ")) / 2.0 for x in xs]))):
                    z = np.clip(score[:, None] - score[None, :], -12, 12)
                    t, g, c, h = K.hodge((1 / (1 + np.exp(-z)) - 0.5) * seen, seen)
                    out.append((q_, name, *(min(1.0, max(0.0, v / t)) if t > 1e-10 else 0.0 for v in (t - g, c, h))))
            yield pd.DataFrame(out, columns=["prompt_id", "model", "loop_ratio", "curl_ratio", "harmonic_ratio"])

    one = count_rows(b).mapInPandas(run, "prompt_id bigint, model string, loop_ratio double, curl_ratio double, harmonic_ratio double")
    return one.groupBy("model").agg(*(g(c).alias(f"{n}_{c}") for c in ("loop_ratio", "curl_ratio", "harmonic_ratio") for g, n in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.min, "min"), (F.max, "max"))))


# Model B against A: where less is better the gap is turned; verdicts by accuracy and calibration.
GAPS = {"accuracy": 1, "kl_div": -1, "nll": -1, "brier": -1, "ece": -1, "entropy": 1}
VERDICT = "CASE WHEN accuracy > 0.05 AND kl_div > 0 THEN 'strong' WHEN accuracy > 0 THEN 'moderate' WHEN accuracy > -0.01 THEN 'comparable' ELSE 'worse' END"
BAND = "CASE WHEN accuracy > 0.05 THEN 'significant' WHEN accuracy > 0.02 THEN 'moderate' WHEN accuracy > 0 THEN 'slight' ELSE 'comparable or worse' END"


@R.add("cp16_model_gap", w("cal", TWO + ", gp AS (SELECT " + ", ".join(f"{g} * (avg({m}_b) - avg({m}_a)) AS {m}" for m, g in GAPS.items()) + " FROM pp)", "SELECT " + ", ".join(f"round({m}, 5) AS {m}_gap" for m in GAPS) + ", " + " + ".join(f"CAST({m} > 1e-12 AS INT)" for m in GAPS) + f" AS wins, {VERDICT} AS verdict, {BAND} AS band FROM gp"))
def p16(s, d):
    """Gaps of six metrics (positive: B is better), how many B wins, and the two verdicts; the seventh, the loop share, is the
    difference of the means in cp15_flow_rollup."""
    g = model_metrics(s, d).agg(*((x * (F.avg(f"{m}_b") - F.avg(f"{m}_a"))).alias(m) for m, x in GAPS.items()))
    wins = sum(((F.col(m) > 1e-12).cast("int") for m in GAPS), F.lit(0))
    return g.select(*(F.round(m, 5).alias(f"{m}_gap") for m in GAPS), wins.alias("wins"), F.expr(VERDICT).alias("verdict"), F.expr(BAND).alias("band"))


@R.add("cp17_top_gaps", w("cal", TWO, "SELECT prompt, round(accuracy_b - accuracy_a, 6) AS gap, round(accuracy_a, 6) AS accuracy_a, round(accuracy_b, 6) AS accuracy_b FROM pp ORDER BY round(accuracy_b - accuracy_a, 6) DESC, prompt LIMIT 5"))
def p17(s, d):
    m = model_metrics(s, d).select("prompt", r6(F.col("accuracy_b") - F.col("accuracy_a")).alias("gap"), r6("accuracy_a").alias("accuracy_a"), r6("accuracy_b").alias("accuracy_b"))
    return m.orderBy(F.desc("gap"), "prompt").limit(5)


LR17 = "nd AS (SELECT prompt_id, i, any_value(k) AS k, sum(p - 0.5) / any_value(k) AS r, sum((p - 0.5) * (p - 0.5)) AS e FROM pm GROUP BY 1, 2), ra AS (SELECT prompt_id, CASE WHEN sum(e) < 1e-10 THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - 2 * any_value(k) * sum(r * r) / sum(e))) END AS loop_ratio FROM nd GROUP BY 1)"


@R.add("cp17_top_intransitive", w("pm", LR17, "SELECT prompt_id, round(loop_ratio, 6) AS loop_ratio FROM ra ORDER BY round(loop_ratio, 6) DESC, prompt_id LIMIT 5"))
def p17i(s, d):
    """The five prompts whose preferences are least transitive."""
    from tallyloom.operators import cycles as C

    r = C.loop_ratio(matrix.majority(V.rated_entries(s, d))).select("prompt_id", r6("loop_ratio").alias("loop_ratio"))
    return r.orderBy(F.desc("loop_ratio"), "prompt_id").limit(5)
