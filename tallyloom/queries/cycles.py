"""Intransitivity and the kernels (2.9 J4, J5; 2.10)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallyloom.operators import cycles as C
from tallyloom.operators import kernels as K
from tallyloom.operators import matrix, social
from tallyloom.plans import views as V
from tallyloom.queries.registry import Registry
from tallyloom.queries.social import BW, p_of, q

REGISTRY = R = Registry()
r6 = lambda c: F.round(c, 6)


def both(s, d):
    return matrix.both_ways(matrix.win_counts(V.outcomes(s, d)))


CR = BW + ", cr AS (SELECT prompt, count(*) AS pairs, count_if(ab > 0 AND ba > 0) AS conflicts, count(*) + count_if(ab > 0 AND ba > 0) AS directed FROM bw GROUP BY 1)"


@R.add(*q("n1_conflict_rate", CR, "SELECT prompt, pairs, conflicts, round(conflicts / pairs, 6) AS rate FROM cr", "outc"))
def n1(s, d):
    return C.conflict_rate(both(s, d)).select("prompt", "pairs", "conflicts", r6("rate").alias("rate"))


@R.add(*q("n1b_dataset_conflict_rate", CR, "SELECT round(sum(floor(conflicts / pairs * directed)) / sum(directed), 6) AS dataset_rate FROM cr", "outc"))
def n1b(s, d):
    return C.dataset_conflict_rate(C.conflict_rate(both(s, d))).select(r6("dataset_rate").alias("dataset_rate"))


def _cyc(cond_up, cond_down):
    e = f"ed AS (SELECT prompt, a AS x, b AS y FROM bw WHERE {cond_up} UNION ALL SELECT prompt, b, a FROM bw WHERE {cond_down})"
    return BW + ", " + e + ", cy AS (SELECT e.prompt, count(*) AS cycles FROM ed e JOIN ed f ON f.prompt = e.prompt AND f.x = e.y JOIN ed g ON g.prompt = e.prompt AND g.x = f.y AND g.y = e.x WHERE e.x < e.y AND e.x < f.y GROUP BY 1)"


@R.add(*q("n2_majority_cycles", _cyc("ab > ba", "ba > ab"), "SELECT prompt, cycles, 3 * cycles AS cycles_raw FROM cy", "outc"))
def n2(s, d):
    return C.three_cycles(C.directed(both(s, d), majority=True))


@R.add(*q("n3_instance_cycles", _cyc("ab > 0", "ba > 0"), "SELECT prompt, cycles, 3 * cycles AS cycles_raw FROM cy", "outc"))
def n3(s, d):
    return C.three_cycles(C.directed(both(s, d), majority=False))


@R.add(*q("n4_has_cycle", _cyc("ab > 0", "ba > 0"), "SELECT c.prompt, y.prompt IS NOT NULL AS has_cycle FROM (SELECT DISTINCT prompt FROM bw) c LEFT JOIN cy y ON y.prompt = c.prompt", "outc"))
def n4(s, d):
    b = both(s, d)
    c = C.three_cycles(C.directed(b, majority=False)).select("prompt", F.lit(True).alias("c"))
    return b.select("prompt").distinct().join(c, "prompt", "left").select("prompt", F.coalesce("c", F.lit(False)).alias("has_cycle"))


LR = "nd AS (SELECT prompt_id, i, any_value(k) AS k, sum(p - 0.5) / any_value(k) AS r, sum((p - 0.5) * (p - 0.5)) AS e FROM pm GROUP BY 1, 2), lr AS (SELECT prompt_id, any_value(k) AS k, 2 * any_value(k) * sum(r * r) AS gradient, sum(e) AS total FROM nd GROUP BY 1), ra AS (SELECT *, CASE WHEN total < 1e-10 THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - gradient / total)) END AS loop_ratio FROM lr)"


@R.add(*q("n5_loop_ratio", LR, "SELECT prompt_id, round(gradient, 6) AS gradient, round(total, 6) AS total, round(loop_ratio, 6) AS loop_ratio FROM ra"))
def n5(s, d):
    return C.loop_ratio(p_of(s, d)).select("prompt_id", r6("gradient").alias("gradient"), r6("total").alias("total"), r6("loop_ratio").alias("loop_ratio"))


BL = LR + """, po AS (SELECT prompt_id, i, round(sum(p - 0.5), 9) AS r FROM pm GROUP BY 1, 2),
 ed AS (SELECT pm.prompt_id, pm.k, pm.i, abs(pm.p - 0.5) AS f, sign(u.r - v.r) AS d FROM pm JOIN po u ON u.prompt_id = pm.prompt_id AND u.i = pm.i JOIN po v ON v.prompt_id = pm.prompt_id AND v.i = pm.j),
 qn AS (SELECT prompt_id, any_value(k) AS k, i, sum(f * d) AS q, sum(f * f * abs(d)) AS e FROM ed GROUP BY 1, 3),
 bl AS (SELECT prompt_id, CASE WHEN sum(e) < 1e-10 THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - 2.0 / any_value(k) * sum(q * q) / sum(e))) END AS baseline FROM qn GROUP BY 1),
 aj AS (SELECT ra.prompt_id, loop_ratio, baseline, CASE WHEN baseline >= 1 - 1e-10 THEN 0.0 ELSE greatest(0.0, least(1.0, (loop_ratio - baseline) / (1 - baseline))) END AS adjusted FROM ra JOIN bl USING (prompt_id))"""


@R.add(*q("n6_n7_adjusted_ratio", BL, "SELECT prompt_id, round(loop_ratio, 6) AS loop_ratio, round(baseline, 6) AS baseline, round(adjusted, 6) AS adjusted FROM aj"))
def n7(s, d):
    """Transitive baseline and the ratio adjusted by it."""
    return C.adjusted_ratio(p_of(s, d)).select("prompt_id", *(r6(c).alias(c) for c in ("loop_ratio", "baseline", "adjusted")))


def sizes(b):
    """(prompt, items): distinct responses of each prompt."""
    return b.select("prompt", F.explode(F.array("a", "b")).alias("x")).groupBy("prompt").agg(F.countDistinct("x").alias("items"))


def count_rows(b, least=3, largest=200):
    """(prompt_id, xs, es): items in text order and edges of each prompt with 3 to ``largest`` responses (C2, as the method is
    defined). Sizes are counted first, so no larger prompt's edges are ever gathered."""
    g = b.join(sizes(b).where(F.col("items").between(least, largest)).select("prompt"), "prompt", "left_semi")
    g = g.groupBy("prompt").agg(F.collect_list(F.struct("a", "b", "ab", "ba")).alias("es"))
    g = g.withColumn("xs", F.array_sort(F.array_distinct(F.flatten(F.transform("es", lambda e: F.array(e["a"], e["b"]))))))
    return g.select(F.xxhash64("prompt").alias("prompt_id"), "xs", "es")


@R.add("n8_hodge_counts")
def n8(s, d):
    """Hodge parts of the observed win counts; NULL for prompts with fewer than 3 or more than 200 responses, whose
    number of responses is given all the same."""

    def f(w):
        n = w + w.T
        flow = np.divide(w - w.T, n, out=np.zeros_like(w), where=n > 0) / 2
        t, g, c, h = K.hodge(flow, n > 0)
        return [(t, g, c, h, 0.0 if t < 1e-10 else min(1.0, max(0.0, 1 - g / t)), K.loop_ratio_v1(flow, n > 0))]

    b = both(s, d)
    out = K.per_graph(count_rows(b), f, "prompt_id bigint, total double, gradient double, curl double, harmonic double, loop_ratio double, loop_ratio_v1 double")
    return sizes(b).select(F.xxhash64("prompt").alias("prompt_id"), "items", (F.col("items") > 200).alias("over_200")).join(out, "prompt_id", "left")


@R.add(*q("n9_hodge_probabilities", LR, "SELECT prompt_id, round(total, 6) AS total, round(gradient, 6) AS gradient, round(total - gradient, 6) AS curl, 0.0::DOUBLE AS harmonic FROM ra WHERE k >= 3"))
def n9(s, d):
    """N9, N10 on complete matrices: triangles span every cycle there, so all that is no gradient is curl (the kernel of N8 is
    held against this in the tests)."""
    r = C.loop_ratio(p_of(s, d)).where("k >= 3")
    return r.select("prompt_id", r6("total").alias("total"), r6("gradient").alias("gradient"), r6(F.col("total") - F.col("gradient")).alias("curl"), F.lit(0.0).alias("harmonic"))


SZ = BW + ", it AS (SELECT prompt, count(*) AS items FROM (SELECT prompt, a AS x FROM bw UNION SELECT prompt, b FROM bw) GROUP BY 1)"


@R.add(*q("n11_spectral_gap", SZ, "SELECT prompt, items, CASE WHEN items BETWEEN 3 AND 200 THEN 0.0::DOUBLE END AS spectral_gap FROM it", "outc"))
def n11(s, d):
    """Eigenvalues of a real skew matrix come in conjugate pairs of one modulus: the gap between the two largest moduli is 0
    (a quirk kept as it is), and not computed below 3 or above 200 responses."""
    return sizes(both(s, d)).select("prompt", "items", F.when(F.col("items").between(3, 200), F.lit(0.0)).alias("spectral_gap"))


@R.add("n11_distinct_gap")
def n11_distinct(s, d):
    """The gap between the two largest distinct moduli of the majority graph's skew matrix: what the name promises."""

    def f(w):
        a = (w > w.T).astype(float)
        m = np.sort(np.abs(np.linalg.eigvals((a - a.T) / 2)))[::-1]
        return [(float(m[0] - m[2]) if len(m) > 2 else None,)]

    return K.per_graph(count_rows(both(s, d)), f, "prompt_id bigint, gap double")


FB = SZ + """, ed AS (SELECT prompt, a AS x, b AS y FROM bw WHERE ab > ba UNION ALL SELECT prompt, b, a FROM bw WHERE ba > ab),
 nt AS (SELECT prompt, item, sum(w) AS net FROM (SELECT prompt, x AS item, 1 AS w FROM ed UNION ALL SELECT prompt, y, -1 FROM ed) GROUP BY 1, 2),
 fb AS (SELECT e.prompt, avg(CASE WHEN u.net < v.net OR (u.net = v.net AND x > y) THEN 1.0 ELSE 0.0 END) AS corrected FROM ed e JOIN nt u ON u.prompt = e.prompt AND u.item = x JOIN nt v ON v.prompt = e.prompt AND v.item = y GROUP BY 1)"""


@R.add(*q("n12_feedback_arcs", FB, "SELECT it.prompt, items, CASE WHEN items >= 3 THEN 0.0::DOUBLE END AS faithful, CASE WHEN items >= 3 THEN round(coalesce(corrected, 0), 6) END AS corrected FROM it LEFT JOIN fb ON fb.prompt = it.prompt", "outc"))
def n12(s, d):
    """The faithful score (edges are erased before they are counted, so it is always 0) beside the corrected one, for
    prompts of 3 and more responses without any upper limit."""
    b = both(s, d)
    j = sizes(b).join(C.feedback_share(b), "prompt", "left")
    return j.select("prompt", "items", F.when(F.col("items") >= 3, F.lit(0.0)).alias("faithful"), F.when(F.col("items") >= 3, r6(F.coalesce("corrected", F.lit(0.0)))).alias("corrected"))


LG = "lg AS (SELECT *, ln(greatest({e}, least(1 - {e}, p)) / (1 - greatest({e}, least(1 - {e}, p)))) AS l FROM pm WHERE k >= 3)"


@R.add(*q("n13_logit_residual", LG.format(e=0.01), "SELECT a.prompt_id, round(avg(abs(a.l + b.l - c.l)), 5) AS residual, count(*) AS triples FROM lg a JOIN lg b ON b.prompt_id = a.prompt_id AND b.i = a.j AND b.j > b.i JOIN lg c ON c.prompt_id = a.prompt_id AND c.i = a.i AND c.j = b.j WHERE a.i < a.j GROUP BY 1"))
def n13(s, d):
    return C.logit_residual(C.triples(p_of(s, d)), 0.01).withColumn("residual", F.round("residual", 5))


@R.add(*q("n13b_logit_residual_all", LG.format(e=1e-6), "SELECT a.prompt_id, round(avg(abs(a.l + b.l - c.l)), 5) AS residual, count(*) AS triples FROM lg a JOIN lg b ON b.prompt_id = a.prompt_id AND b.i = a.j JOIN lg c ON c.prompt_id = a.prompt_id AND c.i = a.i AND c.j = b.j GROUP BY 1"))
def n13b(s, d):
    return C.logit_residual(C.triples(p_of(s, d), ordered=True), 1e-6).withColumn("residual", F.round("residual", 5))


N15 = """br AS (SELECT DISTINCT a.prompt_id FROM pm a JOIN pm b ON b.prompt_id = a.prompt_id AND b.i = a.j AND b.j <> a.i JOIN pm c ON c.prompt_id = a.prompt_id AND c.i = a.i AND c.j = b.j WHERE a.p > 0.5 AND b.p > 0.5 AND c.p <= 0.5),
 cw AS (SELECT DISTINCT prompt_id FROM (SELECT prompt_id, i FROM pm GROUP BY 1, 2 HAVING min(p) > 0.5))"""


@R.add(*q("n15_transitivity_class", N15, "SELECT prompt_id, CASE WHEN prompt_id IN (SELECT prompt_id FROM br) THEN 'intransitive' WHEN prompt_id NOT IN (SELECT prompt_id FROM cw) THEN 'quasi' ELSE 'transitive' END AS class FROM (SELECT DISTINCT prompt_id FROM pm)"))
def n15(s, d):
    return C.transitivity_class(p_of(s, d))


@R.add(*q("n16_offdiagonal_std", "", "SELECT prompt_id, round(stddev_pop(p), 6) AS std FROM pm WHERE i < j GROUP BY 1"))
def n16(s, d):
    return p_of(s, d).where("i < j").groupBy("prompt_id").agg(r6(F.stddev_pop("p")).alias("std"))


@R.add(*q("n18_p_histogram", "", "SELECT CASE WHEN p >= 1 THEN 8 ELSE CAST(floor(p * 8) AS INT) END AS bin, count(*) AS n, count_if(p = 0.5) AS ties FROM pm GROUP BY 1"))
def n18(s, d):
    return p_of(s, d).groupBy(F.when(F.col("p") >= 1, 8).otherwise(F.floor(F.col("p") * 8).cast("int")).alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("p") == 0.5).alias("ties"))


@R.add(*q("n19_rollup", LR, "SELECT count(*) AS prompts, round(avg(loop_ratio), 6) AS mean, round(stddev_pop(loop_ratio), 6) AS std, " + ", ".join(f"round(quantile_cont(loop_ratio, {x / 100}), 6) AS p{x}" for x in (25, 50, 75, 90, 95, 99)) + " FROM ra"))
def n19(s, d):
    x = F.col("loop_ratio")
    return C.loop_ratio(p_of(s, d)).agg(F.count("*").alias("prompts"), r6(F.avg(x)).alias("mean"), r6(F.stddev_pop(x)).alias("std"), *(r6(F.percentile(x, F.lit(k / 100))).alias(f"p{k}") for k in (25, 50, 75, 90, 95, 99)))


N20 = BL + ", " + BW.replace("FROM outc", f"FROM ({V.CTE['outc'][1]})") + ", cf AS (SELECT count_if(ab > 0 AND ba > 0) / count(*) AS rate FROM bw), me AS (SELECT avg(adjusted) AS adj, (SELECT rate FROM cf) AS rate FROM aj JOIN (SELECT DISTINCT prompt_id, k FROM pm) USING (prompt_id) WHERE k >= 3)"


@R.add(*q("n20_recommendation", N20, "SELECT round(adj, 6) AS adjusted_loop_ratio, round(rate, 6) AS conflict_rate, CASE WHEN adj > 0.15 OR adj IS NULL AND rate > 0.2 THEN 'HIGH' WHEN adj > 0.05 OR adj IS NULL AND rate > 0.1 THEN 'MODERATE' ELSE 'LOW' END AS intransitivity FROM me"))
def n20(s, d):
    """From the mean adjusted loop ratio of prompts with 3 and more responses; without one, from the share of conflicting pairs."""
    p = p_of(s, d)
    adj = C.adjusted_ratio(p.where("k >= 3")).agg(F.avg("adjusted").alias("adj"))
    rate = both(s, d).agg((F.count_if((F.col("ab") > 0) & (F.col("ba") > 0)) / F.count("*")).alias("rate"))
    x, y = F.col("adj"), F.col("rate")
    level = F.when((x > 0.15) | (x.isNull() & (y > 0.2)), "HIGH").when((x > 0.05) | (x.isNull() & (y > 0.1)), "MODERATE").otherwise("LOW")
    return adj.crossJoin(rate).select(r6("adj").alias("adjusted_loop_ratio"), r6("rate").alias("conflict_rate"), level.alias("intransitivity"))  # one row each


@R.add("j4_maximal_lottery")
def j4(s, d):
    return K.per_matrix(C.rows_of(p_of(s, d)), lambda m: [(i, float(x)) for i, x in enumerate(K.maximal_lottery(m))], "prompt_id bigint, i int, weight double")


@R.add("j5_bt_strengths")
def j5(s, d):
    """J5 (sum 1) and J5b (sum k, floor 1e-6) side by side, iterated for all prompts of a batch at once."""
    f = lambda m: np.stack([K.bt_mle(m), K.bt_mle(np.clip(m, 1e-6, 1 - 1e-6), 1000, 1e-8, 1e-6, m.shape[1])], axis=2)
    return K.per_stack(C.rows_of(p_of(s, d)), f, "prompt_id bigint, i int, theta double, theta_scaled double")


@R.add("n14_bt_distortion")
def n14(s, d):
    """The three unequal definitions: whole matrix with its zero diagonal, upper triangle, off the diagonal; and P18."""

    def f(m):
        t = K.bt_mle(m)
        x = np.abs(t[:, None] / (t[:, None] + t[None, :]) - m)
        off = ~np.eye(len(m), dtype=bool)
        logit = lambda z: np.log(np.clip(z, 0.01, 0.99) / (1 - np.clip(z, 0.01, 0.99)))
        r = np.log(t) - np.log(t).mean()
        e = logit(m).sum(axis=1) / len(m)
        return [(float(x.mean()), float(x[np.triu_indices(len(m), 1)].mean()), float(x[off].mean()), float(np.linalg.norm(r - e)))]

    return K.per_matrix(C.rows_of(p_of(s, d)), f, "prompt_id bigint, whole double, upper double, off_diagonal double, reward_distance double")


@R.add("n17_lottery_entropy")
def n17(s, d):
    """Entropy and support size (> 0.01) of the maximal lottery."""

    def f(m):
        x = K.maximal_lottery(m)
        y = x[x > 0]
        return [(float(-(y * np.log(y)).sum()), int((x > 0.01).sum()))]

    return K.per_matrix(C.rows_of(p_of(s, d)), f, "prompt_id bigint, entropy double, support int")


@R.add("j11_nash_rewards")
def j11_nash(s, d):
    """J11 with the opponent drawn from the maximal lottery, itself included, and its distance from the plain win rate."""

    def f(m):
        x, n = K.maximal_lottery(m), len(m)
        return [(i, float(m[i] @ x), float((m[i].sum() - 0.5) / (n - 1) - m[i] @ x)) for i in range(n)]

    return K.per_matrix(C.rows_of(p_of(s, d)), f, "prompt_id bigint, i int, nash_win_rate double, total_inflation double")


@R.add("j12_nash_agreement")
def j12_nash(s, d):
    """J12 with the lottery's winner among the five methods: shares of prompts on which two methods name one winner."""
    names = ("emp_borda", "emp_copeland", "nash", "average", "pairwise")
    e = V.rated_entries(s, d)
    p = matrix.majority(e)
    best = F.element_at(F.array_sort(F.transform("rs", lambda r: F.struct((-r["avg"]).alias("a"), r["idx"].alias("i")))), 1)["i"]
    nash = K.per_matrix(C.rows_of(p), lambda m: [(int(np.argmax(np.round(K.maximal_lottery(m), 9))),)], "prompt_id bigint, nash int")
    w = social.winners(p).select("prompt_id", F.col("borda_winner").alias("emp_borda"), F.col("copeland_winner").alias("emp_copeland"), F.col("pairwise_winner").alias("pairwise"))
    j = w.join(nash, "prompt_id").join(e.select("prompt_id", best.alias("average")), "prompt_id")
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("method_a"), F.lit(b).alias("method_b"), (F.col(a) == F.col(b)).cast("double").alias("eq")) for a in names for b in names)))
    return j.select(cells.alias("c")).groupBy("c.method_a", "c.method_b").agg(r6(F.avg("c.eq")).alias("agreement"))
