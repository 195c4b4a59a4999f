"""Scans, projections, filters, joins and pair builders (2.1 to 2.5)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import pair_builders as B
from tallyloom.operators import sampling as SA
from tallyloom.plans import views as V
from tallyloom.plans.views import DIMS, sql
from tallyloom.queries.registry import Registry
from tallyloom.session import table

REGISTRY = R = Registry()
r6 = lambda c: F.round(c, 6)

RP = "rp AS (SELECT a.prompt_id, a.idx AS i, b.idx AS j, a.h AS ha, a.o AS oa, a.f AS fa, a.t AS ta, a.avg AS aa, b.h AS hb, b.o AS ob, b.f AS fb, b.t AS tb, b.avg AS ab FROM resp a JOIN resp b ON a.prompt_id = b.prompt_id AND a.idx <> b.idx)"
DP = RP + ", dp AS (" + " UNION ALL ".join(f"SELECT prompt_id, i, j, '{n}' AS dimension, {d}a AS si, {d}b AS sj, {d}a - {d}b AS margin FROM rp" for d, n in DIMS.items()) + ")"


def w(base, extra, body):
    return sql(base, "SELECT 1").replace(" SELECT 1", (", " + extra if extra else "") + " " + body)


@R.add("a4_preference_tuples", sql("pref", "SELECT pref_id, prompt, chosen, rejected FROM pref"))
def a4(s, d):
    return V.preferences(s, d).select("pref_id", "prompt", "chosen", "rejected")


@R.add("a9_score_shards", "WITH z AS (SELECT vec_id % 4 AS shard, vec_id // 4 AS lidx, embedding FROM embeddings), l AS (SELECT max(c) AS shard_len FROM (SELECT count(*) AS c FROM z GROUP BY shard)) SELECT shard, lidx, shard * shard_len + lidx AS id, round(CAST(embedding[1] AS DOUBLE), 6) AS score FROM z, l")
def a9(s, d):
    """A shard's scores stand at its number times the shard length (that of the longest)."""
    e = table(s, d, "embeddings", "vec_id", "embedding").select((F.col("vec_id") % 4).alias("shard"), F.floor(F.col("vec_id") / 4).alias("lidx"), r6(F.col("embedding")[0].cast("double")).alias("score"))
    long = e.groupBy("shard").agg(F.count("*").alias("c")).agg(F.max("c").alias("shard_len"))
    return e.crossJoin(F.broadcast(long)).select("shard", "lidx", (F.col("shard") * F.col("shard_len") + F.col("lidx")).alias("id"), "score")  # one row


@R.add("a10_shard_concat", "SELECT 0 AS part, pref_id AS id FROM preferences UNION ALL SELECT 1 AS part, feature_id AS id FROM features_labeled")
def a10(s, d):
    a = table(s, d, "preferences", F.col("pref_id").alias("id")).select(F.lit(0).alias("part"), "id")
    return a.unionByName(table(s, d, "features_labeled", F.col("feature_id").alias("id")).select(F.lit(1).alias("part"), "id"))


@R.add("a12_batch_lines", "SELECT count(*) AS lines, count_if(response IS NULL) AS failed, count_if(error IS NOT NULL) AS errors, count_if(response IS NOT NULL AND (NOT json_valid(c) OR json_extract_string(CASE WHEN json_valid(c) THEN c END, '$.strategy_id') IS NULL)) AS unparsed FROM (SELECT *, response.body.choices[1].message.content AS c FROM label_batches)")
def a12(s, d):
    b = table(s, d, "label_batches", "error", "response").withColumn("c", F.try_element_at("response.body.choices", F.lit(1))["message"]["content"])
    sid = F.get_json_object("c", "$.strategy_id")
    return b.agg(F.count("*").alias("lines"), F.count_if(F.col("response").isNull()).alias("failed"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.col("response").isNotNull() & sid.isNull()).alias("unparsed"))


@R.add("a14_subset_counts", "SELECT dimension AS subset, count(*) AS n FROM preferences GROUP BY 1")
def a14(s, d):
    return table(s, d, "preferences", "dimension").groupBy(F.col("dimension").alias("subset")).agg(F.count("*").alias("n"))


@R.add("b2_layouts", sql("pref", "SELECT pref_id, coalesce(prompt, '') || coalesce(chosen, '') AS text_chosen, coalesce(margin, 0) AS margin FROM pref"))
def b2(s, d):
    return V.preferences(s, d).select("pref_id", F.concat(F.coalesce("prompt", F.lit("")), F.coalesce("chosen", F.lit(""))).alias("text_chosen"), F.coalesce("margin", F.lit(0.0)).alias("margin"))


@R.add("b3_conversation_concat", "SELECT pref_id, len(list_concat(prompt, chosen)) AS turns, list_concat(prompt, chosen)[-1].role AS last_role FROM preferences")
def b3(s, d):
    t = F.concat("prompt", "chosen")
    return table(s, d, "preferences", "pref_id", "prompt", "chosen").select("pref_id", F.size(t).alias("turns"), F.try_element_at(t, F.lit(-1))["role"].alias("last_role"))


@R.add("b4_ratings", sql("resp", "SELECT completion_id, h, o, f, t FROM resp"))
def b4(s, d):
    return V.responses(s, d).select("completion_id", "h", "o", "f", "t")


@R.add("b5_mean_ratings", sql("resp", "SELECT completion_id, round(avg, 6) AS avg FROM resp"))
def b5(s, d):
    return V.responses(s, d).select("completion_id", r6("avg").alias("avg"))


MSG = r"(Human|Assistant):\s*"


@R.add("b6_transcripts", "SELECT doc_id, len(regexp_extract_all(text, '\\n\\n(Human|Assistant):\\s*')) AS messages, trim(string_split_regex(text, '\\n\\n(?:Human|Assistant):\\s*')[-1], chr(10) || ' ' || chr(9)) AS last_message FROM documents WHERE doc_kind = 'transcript'")
def b6(s, d):
    t = table(s, d, "documents", "doc_id", "text", "doc_kind").where("doc_kind = 'transcript'")
    return t.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"\n\n(Human|Assistant):\s*"), F.lit(1))).alias("messages"), F.btrim(F.element_at(F.split("text", r"\n\n(?:Human|Assistant):\s*"), -1), F.lit("\n \t")).alias("last_message"))


@R.add("b7_transcript_split", "SELECT doc_id, len(m) - 1 AS prompt_messages, m[-1] AS last_role, m[-1] = 'Assistant' AS usable FROM (SELECT doc_id, regexp_extract_all(text, '\\n\\n(Human|Assistant):', 1) AS m FROM documents WHERE doc_kind = 'transcript') WHERE len(m) > 0")
def b7(s, d):
    t = table(s, d, "documents", "doc_id", "text", "doc_kind").where("doc_kind = 'transcript'")
    m = t.select("doc_id", F.regexp_extract_all("text", F.lit(r"\n\n(Human|Assistant):"), F.lit(1)).alias("m")).where(F.size("m") > 0)
    return m.select("doc_id", (F.size("m") - 1).alias("prompt_messages"), F.element_at("m", -1).alias("last_role"), (F.element_at("m", -1) == "Assistant").alias("usable"))


@R.add("b9_binarised_margin", sql("pref", "SELECT pref_id, coalesce(score_chosen - score_rejected, 0) AS margin FROM pref"))
def b9(s, d):
    return V.preferences(s, d).select("pref_id", F.coalesce(F.col("score_chosen") - F.col("score_rejected"), F.lit(0.0)).alias("margin"))


@R.add("b10_first_assistant", "SELECT pref_id, [x FOR x IN chosen IF x.role = 'assistant'][1].content AS first_answer, length([x FOR x IN chosen IF x.role = 'assistant'][1].content) AS chars FROM preferences")
def b10(s, d):
    a = F.try_element_at(F.filter("chosen", lambda m: m["role"] == "assistant"), F.lit(1))["content"]
    return table(s, d, "preferences", "pref_id", "chosen").select("pref_id", a.alias("first_answer"), F.length(a).alias("chars"))


@R.add("b12_template_fallback", "SELECT pref_id, list_aggregate([x.content FOR x IN list_concat(prompt, chosen)], 'string_agg', ' ') || '</s>' AS text FROM preferences WHERE len(list_concat(prompt, chosen)) > 0")
def b12(s, d):
    p = table(s, d, "preferences", "pref_id", "prompt", "chosen").where(F.size(F.concat("prompt", "chosen")) > 0)
    return p.select("pref_id", F.concat(F.array_join(F.transform(F.concat("prompt", "chosen"), lambda m: m["content"]), " "), F.lit("</s>")).alias("text"))


@R.add("b13_truncate_pad", "SELECT row_id, list_aggregate(list_concat(list_resize([]::VARCHAR[], greatest(0, 16 - len(w)), '<pad>'), w), 'string_agg', ' ') AS tokens FROM (SELECT row_id, list_concat(string_split(instruction, ' ')[1:15], ['</s>']) AS w FROM custom_test_data WHERE instruction IS NOT NULL)")
def b13(s, d):
    """At most 15 tokens, the last one forced to the end mark, left-padded to 16."""
    t = table(s, d, "custom_test_data", "row_id", "instruction").where("instruction is not null")
    ids = F.concat(F.slice(F.split("instruction", " "), 1, 15), F.array(F.lit("</s>")))
    return t.select("row_id", F.array_join(F.concat(F.array_repeat(F.lit("<pad>"), F.greatest(F.lit(0), 16 - F.size(ids))), ids), " ").alias("tokens"))


@R.add("b14_response_length", sql("pref", "SELECT pref_id, length(prompt || chosen) - length(prompt) AS response_chars FROM pref"))
def b14(s, d):
    return V.preferences(s, d).select("pref_id", (F.length(F.concat("prompt", "chosen")) - F.length("prompt")).alias("response_chars"))


NAMES = ("genuinely_helpful", "sycophantic", "superficially_polished", "assertive_confabulation", "hedging_overcautious", "evasive_deflective", "concise_substantive")
GROUPS = ("substance", "surface", "surface", "surface", "neither", "neither", "substance")
DIMTABLE = "st AS (SELECT * FROM (VALUES " + ", ".join(f"({k + 1}, '{n}', '{g}')" for k, (n, g) in enumerate(zip(NAMES, GROUPS))) + ") t(id, name, grp))"
LB = DIMTABLE + ", lb AS (SELECT line_id, TRY_CAST(replace(custom_id, 'idx_', '') AS BIGINT) AS feature_id, CASE WHEN json_valid(c) THEN c END AS c FROM (SELECT *, response.body.choices[1].message.content AS c FROM label_batches)), lx AS (SELECT line_id, feature_id, coalesce(a.id, b.id) AS strategy_id FROM lb LEFT JOIN st a ON a.id = TRY_CAST(json_extract_string(c, '$.strategy_id') AS INT) LEFT JOIN st b ON b.name = json_extract_string(c, '$.strategy_name') WHERE coalesce(a.id, b.id) IS NOT NULL)"


def strategies(s):
    return s.createDataFrame(list(zip(range(1, 8), NAMES, GROUPS)), "id int, name string, grp string")


def labels(s, d):
    """Id by path, recovered from the name where it is no valid id."""
    b = table(s, d, "label_batches", "line_id", "custom_id", "response").withColumn("c", F.try_element_at("response.body.choices", F.lit(1))["message"]["content"])
    st = F.create_map(*(x for k, n in enumerate(NAMES) for x in (F.lit(n), F.lit(k + 1))))
    i = F.get_json_object("c", "$.strategy_id").try_cast("int")
    sid = F.coalesce(F.when(i.between(1, 7), i), F.try_element_at(st, F.get_json_object("c", "$.strategy_name")))
    return b.select("line_id", F.regexp_replace("custom_id", "idx_", "").try_cast("bigint").alias("feature_id"), sid.alias("strategy_id")).where("strategy_id is not null")


@R.add("b15_batch_labels", f"WITH {LB} SELECT line_id, feature_id, strategy_id, name AS strategy_name, grp AS substance_or_surface FROM lx JOIN st ON st.id = strategy_id")
def b15(s, d):
    return labels(s, d).join(F.broadcast(strategies(s)), F.col("strategy_id") == F.col("id")).select("line_id", "feature_id", "strategy_id", F.col("name").alias("strategy_name"), F.col("grp").alias("substance_or_surface"))


B16 = "rk AS (SELECT prompt, feature_id, row_number() OVER (PARTITION BY prompt ORDER BY rm_reward DESC NULLS LAST, feature_id) AS r, row_number() OVER (PARTITION BY prompt ORDER BY borda_pm DESC NULLS LAST, feature_id) AS p, is_condorcet_winner AS c FROM feat WHERE prompt IS NOT NULL)"


@R.add("b16_prompt_class", w("feat", B16, "SELECT prompt, CASE WHEN max(CASE WHEN r = 1 THEN feature_id END) = max(CASE WHEN p = 1 THEN feature_id END) THEN 'agreement' WHEN NOT coalesce(bool_or(c), false) THEN 'cycle' ELSE 'bt_inflated' END AS class FROM rk GROUP BY 1"))
def b16(s, d):
    """Agreement where the scalar and the pairwise model name one winner; else a cycle where no response beats all others."""
    f = V.features(s, d).where("prompt is not null")
    best = lambda c: F.max_by("feature_id", F.struct(F.coalesce(c, F.lit(-1e300)), -F.col("feature_id")))
    cls = F.when(best("rm_reward") == best("borda_pm"), "agreement").when(~F.coalesce(F.bool_or("is_condorcet_winner"), F.lit(False)), "cycle").otherwise("bt_inflated")
    return f.groupBy("prompt").agg(cls.alias("class"))


@R.add("b17_substance_group", f"WITH {DIMTABLE}, feat AS ({V.CTE['feat'][1]}) SELECT grp, count(*) AS n FROM feat JOIN st ON st.id = strategy_id GROUP BY 1")
def b17(s, d):
    return V.features(s, d).join(F.broadcast(strategies(s)), F.col("strategy_id") == F.col("id")).groupBy("grp").agg(F.count("*").alias("n"))


@R.add("c1_first_rows", "SELECT row_id, instruction FROM custom_test_data ORDER BY row_id LIMIT 500")
def c1(s, d):
    return table(s, d, "custom_test_data", "row_id", "instruction").orderBy("row_id").limit(500)


@R.add("c2_sizes", sql("outc", "SELECT prompt, count(DISTINCT x) AS responses FROM (SELECT prompt, winner AS x FROM outc UNION ALL SELECT prompt, loser FROM outc) GROUP BY 1 HAVING count(DISTINCT x) BETWEEN 3 AND 200"))
def c2(s, d):
    o = V.outcomes(s, d).select("prompt", F.explode(F.array("winner", "loser")).alias("x"))
    return o.groupBy("prompt").agg(F.countDistinct("x").alias("responses")).where("responses between 3 and 200")


@R.add("c4_four_rated", sql("resp", "SELECT prompt_id FROM resp GROUP BY 1 HAVING count(*) = 4 AND count(avg) = 4"))
def c4(s, d):
    return V.entries(s, d).where((F.size("rs") == 4) & F.forall("rs", lambda r: r["avg"].isNotNull())).select("prompt_id")


@R.add("c5_complete_prompts", sql("resp", "SELECT prompt_id, count(*) AS k FROM resp GROUP BY 1 HAVING bool_and(avg IS NOT NULL)"))
def c5(s, d):
    return V.entries(s, d).where((F.size("rs") > 0) & F.forall("rs", lambda r: r["avg"].isNotNull())).select("prompt_id", F.size("rs").alias("k"))


@R.add("c6_two_rated", sql("rated", "SELECT DISTINCT prompt_id, k FROM rated"))
def c6(s, d):
    return V.rated_entries(s, d).select("prompt_id", "k")


@R.add("c8_strict_margin", w("resp", DP, "SELECT prompt_id, i, j, dimension FROM dp WHERE margin > 2"))
def c8(s, d):
    return B.dimension_pairs(V.entries(s, d), 2, strict=True).select("prompt_id", "i", "j", "dimension")


@R.add("c9_labelled", sql("feat", "SELECT feature_id, strategy_id FROM feat WHERE strategy_id IS NOT NULL"))
def c9(s, d):
    return V.features(s, d).where("strategy_id is not null").select("feature_id", "strategy_id")


@R.add("c11_active_features", sql("feat", "SELECT name, n FROM (SELECT 'n_bold' AS name, count_if(n_bold > 0) AS n FROM feat UNION ALL SELECT 'n_bullet_items', count_if(n_bullet_items > 0) FROM feat UNION ALL SELECT 'n_numbered_items', count_if(n_numbered_items > 0) FROM feat UNION ALL SELECT 'n_code_blocks', count_if(n_code_blocks > 0) FROM feat) WHERE n >= 50"))
def c11(s, d):
    cols = ("n_bold", "n_bullet_items", "n_numbered_items", "n_code_blocks")
    one = V.features(s, d).agg(*(F.count_if(F.col(c) > 0).alias(c) for c in cols))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in cols))).alias("x")).select("x.*").where("n >= 50")


@R.add("d1_split_join", sql("feat pref", "SELECT pref_id, split FROM pref JOIN (SELECT prompt, min(split) AS split FROM feat WHERE split IS NOT NULL GROUP BY 1) f USING (prompt)"))
def d1(s, d):
    f = V.features(s, d).where("split is not null").groupBy("prompt").agg(F.min("split").alias("split"))
    return V.preferences(s, d).select("pref_id", "prompt").join(f, "prompt").select("pref_id", "split")


@R.add("d1_unmatched", sql("feat pref", "SELECT count(*) AS unmatched FROM pref WHERE prompt NOT IN (SELECT prompt FROM feat WHERE prompt IS NOT NULL) OR prompt IS NULL"))
def d1u(s, d):
    return V.preferences(s, d).select("prompt").join(V.features(s, d).select("prompt"), "prompt", "left_anti").agg(F.count("*").alias("unmatched"))


@R.add("d2_prompt_membership", sql("entries", "SELECT row_id FROM custom_test_data WHERE instruction IN (SELECT instruction FROM entries)"))
def d2(s, d):
    return table(s, d, "custom_test_data", "row_id", "instruction").join(V.entries(s, d).select("instruction"), "instruction", "left_semi").select("row_id")


@R.add("d4_composite_key", sql("feat", "SELECT count(*) AS joined, count_if(a.word_count = b.length) AS consistent FROM feat a JOIN feat b ON a.prompt = b.prompt AND a.response_idx = b.response_idx"))
def d4(s, d):
    f = V.features(s, d)
    a, b = f.select("prompt", "response_idx", "word_count"), f.select("prompt", "response_idx", "length")
    return a.join(b, ["prompt", "response_idx"]).agg(F.count("*").alias("joined"), F.count_if(F.col("word_count") == F.col("length")).alias("consistent"))


@R.add("d5_label_merge", f"WITH {LB}, feat AS ({V.CTE['feat'][1]}), one AS (SELECT feature_id, min(strategy_id) AS label FROM lx GROUP BY 1) SELECT f.feature_id, label FROM feat f LEFT JOIN one USING (feature_id)")
def d5(s, d):
    one = labels(s, d).groupBy("feature_id").agg(F.min("strategy_id").alias("label"))
    return V.features(s, d).select("feature_id").join(one, "feature_id", "left")


N = lambda c: f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g')"


@R.add("d6_prefix_join", sql("feat", f"SELECT f.feature_id, e.row_id FROM feat f JOIN (SELECT substr({N('instruction')}, 1, 200) AS k, max(row_id) AS row_id FROM custom_test_data WHERE instruction IS NOT NULL GROUP BY 1) e ON substr({N('f.prompt')}, 1, 200) = e.k"))
def d6(s, d):
    """Equality of the first 200 characters of the prompt, however it was typed; the last writer of a prefix wins (the operator's own rule)."""
    e = table(s, d, "custom_test_data", "row_id", "instruction").where("instruction is not null").groupBy(F.substring(X.normal(F.col("instruction")), 1, 200).alias("k")).agg(F.max("row_id").alias("row_id"))
    return V.features(s, d).select("feature_id", F.substring(X.normal(F.col("prompt")), 1, 200).alias("k")).join(e, "k").select("feature_id", "row_id")


@R.add("d8_text_match", sql("resp", "SELECT f.row_id, coalesce(x.c, p.c) AS completion_id, x.c IS NOT NULL AS exact FROM custom_test_data f LEFT JOIN (SELECT response AS r, min(completion_id) AS c FROM resp GROUP BY 1) x ON x.r = f.chosen LEFT JOIN (SELECT substr(response, 1, 200) AS r, min(completion_id) AS c FROM resp GROUP BY 1) p ON p.r = substr(f.chosen, 1, 200) WHERE coalesce(x.c, p.c) IS NOT NULL"))
def d8(s, d):
    """Exact text, else the first match of the 200-character prefix (the operator's own rule)."""
    r = V.responses(s, d).where("response is not null")
    x = r.groupBy(F.col("response").alias("rx")).agg(F.min("completion_id").alias("cx"))
    p = r.groupBy(F.substring("response", 1, 200).alias("rp")).agg(F.min("completion_id").alias("cp"))
    f = table(s, d, "custom_test_data", "row_id", "chosen")
    j = f.join(x, F.col("rx") == F.col("chosen"), "left").join(p, F.col("rp") == F.substring("chosen", 1, 200), "left")
    return j.select("row_id", F.coalesce("cx", "cp").alias("completion_id"), F.col("cx").isNotNull().alias("exact")).where("completion_id is not null")


@R.add("d9_ordered_pairs", w("resp", RP, "SELECT prompt_id, i, j FROM rp"))
def d9(s, d):
    return V.pairs(V.entries(s, d)).select("prompt_id", F.col("a.idx").alias("i"), F.col("b.idx").alias("j"))


@R.add("d11_common_prompts", sql("pref feat", f"SELECT {N('prompt')} AS prompt FROM pref INTERSECT SELECT {N('prompt')} FROM feat INTERSECT SELECT {N('instruction')} FROM custom_test_data"))
def d11(s, d):
    """Prompts, however they were typed, that three result sets share."""
    one = lambda df, c: df.select(X.normal(F.col(c)).alias("prompt"))
    return one(V.preferences(s, d), "prompt").intersect(one(V.features(s, d), "prompt")).intersect(one(table(s, d, "custom_test_data", "instruction"), "instruction"))


@R.add("d12_model_vs_model", sql("resp", "SELECT a.model AS model_a, b.model AS model_b, count(*) AS n, round(avg(a.avg - b.avg), 6) AS gap FROM resp a JOIN resp b ON a.prompt_id = b.prompt_id AND a.model < b.model WHERE a.avg IS NOT NULL AND b.avg IS NOT NULL GROUP BY 1, 2"))
def d12(s, d):
    p = V.pairs(V.rated_entries(s, d)).where("a.model < b.model")
    return p.groupBy(F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b")).agg(F.count("*").alias("n"), r6(F.avg(F.col("a.avg") - F.col("b.avg"))).alias("gap"))


@R.add("d13_unanswered", "SELECT DISTINCT feature_id FROM features_labeled WHERE 'idx_' || feature_id NOT IN (SELECT custom_id FROM label_batches WHERE response IS NOT NULL AND custom_id IS NOT NULL)")
def d13(s, d):
    done = table(s, d, "label_batches", "custom_id", "response").where("response is not null").select("custom_id")
    f = table(s, d, "features_labeled", "feature_id").distinct().withColumn("custom_id", F.concat(F.lit("idx_"), F.col("feature_id").cast("string")))
    return f.join(done, "custom_id", "left_anti").select("feature_id")


@R.add("d15_split_overlap", sql("feat", "SELECT count(DISTINCT prompt) AS shared FROM feat WHERE split = 'seen' AND prompt IN (SELECT prompt FROM feat WHERE split = 'unseen')"))
def d15(s, d):
    f = V.features(s, d).where("prompt is not null")
    both = f.groupBy("prompt").agg(F.bool_or(F.col("split") == "seen").alias("a"), F.bool_or(F.col("split") == "unseen").alias("b"))
    return both.agg(F.count_if(F.col("a") & F.col("b")).alias("shared"))


@R.add("d16_worker_merge", sql("feat pref", f"SELECT e.feature_id, p.pref_id FROM feat e JOIN pref p ON {N('p.prompt')} = {N('e.prompt')}"))
def d16(s, d):
    """Two workers' outputs merged by prompt, however it was typed; what only one has is skipped."""
    e = V.features(s, d).select("feature_id", X.normal(F.col("prompt")).alias("k"))
    return e.join(V.preferences(s, d).select("pref_id", X.normal(F.col("prompt")).alias("k")), "k").select("feature_id", "pref_id")


@R.add("e1_dimension_pairs", w("resp", DP, "SELECT prompt_id, i, j, dimension, si, sj, margin FROM dp WHERE margin >= 2"))
def e1(s, d):
    return B.dimension_pairs(V.entries(s, d))


@R.add("e2_averaged_pairs", w("resp", RP, "SELECT prompt_id, i, j, round(aa - ab, 6) AS margin FROM rp WHERE aa >= ab"))
def e2(s, d):
    return B.averaged_pairs(V.entries(s, d)).withColumn("margin", r6("margin"))


D2 = DP + ", d2 AS (SELECT * FROM dp WHERE margin >= 2)"


@R.add("e3_conflict_free_pairs", w("resp", D2, "SELECT prompt_id, i, j, dimension, margin FROM d2 x WHERE NOT EXISTS (SELECT 1 FROM d2 y WHERE y.prompt_id = x.prompt_id AND y.i = x.j AND y.j = x.i)"))
def e3(s, d):
    return B.conflict_free(B.dimension_pairs(V.entries(s, d))).select("prompt_id", "i", "j", "dimension", "margin")


@R.add("e4_split_conflicts", sql("outc", "SELECT row_id FROM outc x WHERE NOT EXISTS (SELECT 1 FROM outc y WHERE y.prompt = x.prompt AND y.winner = x.loser AND y.loser = x.winner)"))
def e4(s, d):
    """Conflict removal by text inside a prompt; the pairs with both directions come from one aggregate."""
    from tallyloom.operators import matrix

    o = V.outcomes(s, d).withColumns({"a": F.least("winner", "loser"), "b": F.greatest("winner", "loser")})
    bad = matrix.both_ways(matrix.win_counts(o)).where("ab > 0 and ba > 0").select("prompt", "a", "b")
    return o.join(bad, ["prompt", "a", "b"], "left_anti").select("row_id")


@R.add("e5_conflict_check", w("resp", D2, "SELECT count_if(u > 0 AND u < n) AS conflicts, count(*) AS pairs FROM (SELECT prompt_id, least(i, j) AS lo, greatest(i, j) AS hi, count_if(i < j) AS u, count(*) AS n FROM d2 GROUP BY 1, 2, 3)"))
def e5(s, d):
    return B.conflicts(B.dimension_pairs(V.entries(s, d)))


def _text(x):
    return F.array_join(F.transform("comparisons", lambda c: F.concat_ws(":", c["dimension"], c["i"], c["j"], x(c))), ",")


@R.add("e6_grouped_entries", w("resp", DP, "SELECT prompt_id, count(*) AS num_comparisons, string_agg(dimension || ':' || i || ':' || j || ':' || margin, ',' ORDER BY dimension, i, j) AS comparisons FROM dp WHERE margin > 0 GROUP BY 1"))
def e6(s, d):
    g = B.grouped(B.dimension_pairs(V.entries(s, d), 0, strict=True))
    return g.select("prompt_id", "num_comparisons", _text(lambda c: c["margin"].cast("string")).alias("comparisons"))


@R.add("e7_binary_grouped", sql("pref", "SELECT prompt, count(*) AS num_comparisons, count(DISTINCT x) AS num_responses FROM (SELECT prompt, pref_id, unnest([chosen, rejected]) AS x FROM pref WHERE prompt IS NOT NULL AND chosen IS NOT NULL AND rejected IS NOT NULL) GROUP BY 1").replace("count(*) AS num_comparisons", "count(DISTINCT pref_id) AS num_comparisons"))
def e7(s, d):
    p = V.preferences(s, d).where("prompt is not null and chosen is not null and rejected is not null")
    x = p.select("prompt", "pref_id", F.explode(F.array("chosen", "rejected")).alias("x"))
    return x.groupBy("prompt").agg(F.countDistinct("pref_id").alias("num_comparisons"), F.countDistinct("x").alias("num_responses"))


# The configurations again, from their definition and not from the operator.
CY = {"Cyclic_1": ("o", "t", "h"), "Cyclic_2": ("f", "t", "h"), "Cyclic_3": ("f", "o", "h"), "Cyclic_4": ("f", "o", "t")}
_ok = lambda m: " AND ".join(f"{x}.{d} IS NOT NULL" for x in "abc" for d in m)
CYC = "ct AS (" + " UNION ALL ".join(f"SELECT a.prompt_id, a.idx AS a, b.idx AS b, c.idx AS c, '{n}' AS cycle_config, ['{DIMS[x]}', '{DIMS[y]}', '{DIMS[z]}'] AS dims, [a.{x} - b.{x}, b.{y} - c.{y}, c.{z} - a.{z}] AS margins FROM resp a JOIN resp b ON a.prompt_id = b.prompt_id AND a.idx <> b.idx JOIN resp c ON c.prompt_id = a.prompt_id AND c.idx <> a.idx AND c.idx <> b.idx WHERE a.{x} > b.{x} AND b.{y} > c.{y} AND c.{z} > a.{z} AND {_ok((x, y, z))}" for n, (x, y, z) in CY.items()) + ")"


@R.add("e8_cyclic_triples", w("resp", CYC, "SELECT prompt_id, a, b, c, cycle_config FROM ct"))
def e8(s, d):
    return B.cyclic_triples(V.entries(s, d)).select("prompt_id", "a", "b", "c", "cycle_config")


@R.add("e9_cyclic_pairs", w("resp", CYC, " UNION ALL ".join(f"SELECT prompt_id, cycle_config, {x} AS chosen, {y} AS rejected, dims[{k}] AS dimension, margins[{k}] AS margin FROM ct" for k, (x, y) in enumerate(("ab", "bc", "ca"), 1))))
def e9(s, d):
    return B.cyclic_pairs(B.cyclic_triples(V.entries(s, d)))


@R.add("e10_efficiency", w("resp", DP, "SELECT n AS responses, c AS comparisons, round(2.0 * c / n, 6) AS speedup FROM (SELECT count(*) AS n FROM resp), (SELECT count(*) AS c FROM dp WHERE margin > 0)"))
def e10(s, d):
    e = V.entries(s, d)
    one = e.agg(F.sum(F.greatest(F.size("rs"), F.lit(0))).alias("responses"))
    c = B.dimension_pairs(e, 0, strict=True).agg(F.count("*").alias("comparisons"))
    return one.crossJoin(c).select("responses", "comparisons", r6(2.0 * F.col("comparisons") / F.col("responses")).alias("speedup"))  # one row each


@R.add("e11_global_offsets", sql("resp", 'SELECT prompt_id, n, coalesce(sum(n) OVER (ORDER BY prompt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM (SELECT prompt_id, count(*) AS n FROM resp GROUP BY 1)'))
def e11(s, d):
    e = V.entries(s, d).where(F.size("rs") > 0).select("prompt_id", F.size("rs").alias("n"))
    return B.flatten_offsets(e, "prompt_id", "n")


HK = "(({k} * 2654435761 + {s}) % 4294967296)"


@R.add("e12_capped_comparisons", w("resp", DP, "SELECT prompt_id, i, j, dimension FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY ((i * 64 + j) * 2654435761 + 7) % 4294967296, dimension) AS r FROM dp WHERE margin > 0) WHERE r <= 5"))
def e12(s, d):
    """A sampling operator: at most five comparisons an entry, in hash order."""
    p = B.dimension_pairs(V.entries(s, d), 0, strict=True)
    h = ((F.col("i") * 64 + F.col("j")).cast("bigint") * 2654435761 + 7) % 4294967296
    return p.withColumn("r", F.row_number().over(Window.partitionBy("prompt_id").orderBy(h, "dimension"))).where("r <= 5").select("prompt_id", "i", "j", "dimension")


BATCH, BYTES = 50, 12_000
K7 = f"""z AS (SELECT feature_id, octet_length(encode(response_text)) AS b, row_number() OVER (ORDER BY feature_id) - 1 AS pos FROM feat WHERE response_text IS NOT NULL),
 y AS (SELECT *, pos // {BATCH} AS batch, pos % {BATCH} AS seq FROM z),
 f AS (SELECT batch, seq, feature_id, b AS held, 0 AS file_no FROM y WHERE seq = 0 UNION ALL SELECT y.batch, y.seq, y.feature_id, CASE WHEN f.held + y.b > {BYTES} THEN y.b ELSE f.held + y.b END, CASE WHEN f.held + y.b > {BYTES} THEN f.file_no + 1 ELSE f.file_no END FROM f JOIN y ON y.batch = f.batch AND y.seq = f.seq + 1)"""


@R.add("k7_request_files", w("feat", K7, "SELECT feature_id, batch, file_no FROM f").replace("WITH ", "WITH RECURSIVE ", 1))
def k7(s, d):
    """Files of requests capped by count and by size: batches of BATCH requests in the order of ids; inside one a new file
    begins where the next request would pass BYTES (one longer than that has a file of its own). A batch is one small array."""
    f = V.features(s, d).where("response_text is not null").select("feature_id", F.octet_length("response_text").alias("b"))
    g = SA.running(f, "feature_id", None, "pos").groupBy(F.floor(F.col("pos") / BATCH).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("feature_id", "b"))).alias("xs"))
    start = F.struct(F.lit(0).alias("held"), F.lit(0).alias("file_no"), F.array().cast("array<int>").alias("files"))

    def step(acc, x):
        new = (acc["held"] + x["b"] > BYTES) & (acc["held"] > 0)
        no = acc["file_no"] + new.cast("int")
        return F.struct(F.when(new, x["b"]).otherwise(acc["held"] + x["b"]).alias("held"), no.alias("file_no"), F.array_append(acc["files"], no).alias("files"))

    g = g.withColumn("files", F.aggregate("xs", start, step)["files"])
    return g.select("batch", F.explode(F.arrays_zip("xs", "files")).alias("z")).select(F.col("z.xs.feature_id").alias("feature_id"), "batch", F.col("z.files").alias("file_no"))
