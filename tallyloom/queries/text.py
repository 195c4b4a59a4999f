"""Text and scalar functions (2.13)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import scoring as S
from tallyloom.functions import text as X
from tallyloom.plans import views as V
from tallyloom.plans.views import sql
from tallyloom.queries.registry import Registry
from tallyloom.session import table

REGISTRY = R = Registry()
r6 = lambda c: F.round(c, 6)
LINES = "len([x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{}')])"
Q = {
    "word_count": "len([x FOR x IN string_split_regex(text, '\\s+') IF x <> ''])",
    "char_count": "length(text)",
    "sentence_count": "greatest(1, len([x FOR x IN string_split_regex(text, '[.!?](?:\\s|$)') IF regexp_replace(x, '\\s', '', 'g') <> '']))",
    "n_bold": "len(regexp_extract_all(text, '\\*\\*[^*]+\\*\\*'))",
    "n_bullets": LINES.format(r"^\s*[-*]\s"), "n_numbered": LINES.format(r"^\s*\d+\.\s"), "n_headers": LINES.format(r"^#{1,6}\s"), "n_tables": LINES.format(r"^\s*\|.+\|.+\|"),
    "n_code_blocks": "len(regexp_extract_all(text, '```')) // 2",
    "n_emojis": "len(regexp_extract_all(text, '[\\p{So}\\x{1F600}-\\x{1FAFF}]'))",
}
FN = {"word_count": X.word_count, "char_count": F.char_length, "sentence_count": X.sentence_count, "n_bold": X.n_bold, "n_bullets": X.n_bullets, "n_numbered": X.n_numbered, "n_headers": X.n_headers, "n_tables": X.n_tables, "n_code_blocks": X.n_code_blocks, "n_emojis": X.n_emojis}


def docs(s, d, *c):
    return table(s, d, "documents", "doc_id", "text", *c)


def measure(name, feature):
    @R.add(name, f"SELECT doc_id, {Q[feature]} AS {feature} FROM documents")
    def run(s, d):
        return docs(s, d).select("doc_id", FN[feature](F.col("text")).alias(feature))


for _k, _f in (("x1", "word_count"), ("x2", "char_count"), ("x3", "sentence_count"), ("x5", "n_bold"), ("x6a", "n_bullets"), ("x6b", "n_numbered"), ("x6c", "n_headers"), ("x6d", "n_tables"), ("x7", "n_code_blocks"), ("x8", "n_emojis")):
    measure(f"{_k}_{_f}", _f)


@R.add("x4_words_per_sentence", f"SELECT doc_id, floor({Q['word_count']} * 100.0 / {Q['sentence_count']} + 0.5) / 100 AS words_per_sentence FROM documents")
def x4(s, d):
    t = F.col("text")
    return docs(s, d).select("doc_id", (F.floor(X.word_count(t) * 100.0 / X.sentence_count(t) + 0.5) / 100).alias("words_per_sentence"))


@R.add("x9_formatting_density", f"SELECT doc_id, round(({' + '.join(Q[k] for k in ('n_bold', 'n_bullets', 'n_numbered', 'n_headers', 'n_code_blocks'))}) / greatest(1, {Q['word_count']}), 6) AS density FROM documents")
def x9(s, d):
    return docs(s, d).select("doc_id", r6(X.formatting_density(F.col("text"))).alias("density"))


@R.add("x10_length_check", sql("feat", f"SELECT feature_id, word_count AS stored, {Q['word_count'].replace('text', 'response_text')} AS counted FROM feat WHERE response_text IS NOT NULL"))
def x10(s, d):
    return V.features(s, d).where("response_text is not null").select("feature_id", F.col("word_count").alias("stored"), X.word_count(F.col("response_text")).alias("counted"))


@R.add("x11_scalar_functions", sql("feat", "SELECT feature_id, round(ln(greatest(0.01, least(0.99, borda_emp / 3)) / (1 - greatest(0.01, least(0.99, borda_emp / 3)))), 6) AS safe_logit, round(CASE WHEN rm_reward >= 0 THEN 1 / (1 + exp(-rm_reward)) ELSE exp(rm_reward) / (1 + exp(rm_reward)) END, 6) AS sigmoid, round(greatest(0.05, least(0.95, borda_emp / 3)), 6) AS clipped, round(exp(rm_reward - max(rm_reward) OVER w) / sum(exp(rm_reward - mx)) OVER w, 6) AS softmax FROM (SELECT *, max(rm_reward) OVER (PARTITION BY prompt) AS mx FROM feat WHERE borda_emp IS NOT NULL AND rm_reward IS NOT NULL) WINDOW w AS (PARTITION BY prompt)"))
def x11(s, d):
    """Softmax over a prompt's rewards, shifted by their maximum."""
    f = V.features(s, d).where("borda_emp is not null and rm_reward is not null")
    w = Window.partitionBy("prompt")
    e = F.exp(F.col("rm_reward") - F.max("rm_reward").over(w))
    x = F.col("borda_emp") / 3
    return f.withColumn("e", e).select("feature_id", r6(S.logit(x, 0.01)).alias("safe_logit"), r6(S.sigmoid("rm_reward")).alias("sigmoid"), r6(S.clip(x, 0.05)).alias("clipped"), r6(F.col("e") / F.sum("e").over(w)).alias("softmax"))


@R.add("x12_prefixes", "SELECT row_id, substr(instruction, 1, 100) AS p100, substr(instruction, 1, 200) AS p200 FROM custom_test_data")
def x12(s, d):
    return table(s, d, "custom_test_data", "row_id", "instruction").select("row_id", F.substring("instruction", 1, 100).alias("p100"), F.substring("instruction", 1, 200).alias("p200"))


@R.add("x13_prefix_groups", "SELECT substr(instruction, 1, 100) AS prefix, count(*) AS n FROM custom_test_data WHERE instruction IS NOT NULL GROUP BY 1")
def x13(s, d):
    return table(s, d, "custom_test_data", "instruction").where("instruction is not null").groupBy(F.substring("instruction", 1, 100).alias("prefix")).agg(F.count("*").alias("n"))


WL = "wl AS (SELECT {} AS n FROM documents)".format(Q["word_count"])


@R.add("x14_length_stats", f"WITH {WL} SELECT count(*) AS docs, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95, " + ", ".join(f"round(avg(CASE WHEN n > {k} THEN 1.0 ELSE 0.0 END), 6) AS over_{k}" for k in (512, 1024, 2048, 4096)) + " FROM wl")
def x14(s, d):
    n = F.col("n")
    return docs(s, d).select(X.word_count(F.col("text")).alias("n")).agg(F.count("*").alias("docs"), r6(F.avg(n)).alias("mean"), r6(F.percentile(n, F.lit(0.5))).alias("median"), r6(F.percentile(n, F.lit(0.95))).alias("p95"), *(r6(F.avg((n > k).cast("double"))).alias(f"over_{k}") for k in (512, 1024, 2048, 4096)))


@R.add("x15_turn_distribution", "SELECT turns, count(*) AS n FROM (SELECT len(regexp_extract_all(text, '\\n\\nHuman:')) AS turns FROM documents WHERE doc_kind = 'transcript') GROUP BY 1")
def x15(s, d):
    t = docs(s, d, "doc_kind").where("doc_kind = 'transcript'").select(F.regexp_count("text", F.lit(r"\n\nHuman:")).alias("turns"))
    return t.groupBy("turns").agg(F.count("*").alias("n"))


@R.add("x16_last_token", "SELECT doc_id, string_split(text, ' ')[-1] AS last_token FROM documents")
def x16(s, d):
    return docs(s, d).select("doc_id", F.element_at(F.split("text", " "), -1).alias("last_token"))


@R.add("x17_json_paths", "SELECT line_id, json_valid(c) AS valid, json_extract_string(CASE WHEN json_valid(c) THEN c END, '$.strategy_name') AS strategy_name FROM (SELECT line_id, response.body.choices[1].message.content AS c FROM label_batches WHERE response IS NOT NULL) WHERE json_extract_string(CASE WHEN json_valid(c) THEN c END, '$.strategy_name') IS NOT NULL")
def x17(s, d):
    b = table(s, d, "label_batches", "line_id", "response").where("response is not null").select("line_id", F.try_element_at("response.body.choices", F.lit(1))["message"]["content"].alias("c"))
    return b.select("line_id", F.lit(True).alias("valid"), F.get_json_object("c", "$.strategy_name").alias("strategy_name")).where("strategy_name is not null")


@R.add("z6_turns_by_split", "SELECT doc_id, len(string_split(text, 'Human:')) - 1 AS turns FROM documents WHERE doc_kind = 'transcript'")
def z6(s, d):
    t = docs(s, d, "doc_kind").where("doc_kind = 'transcript'")
    return t.select("doc_id", (F.size(F.split("text", "Human:")) - 1).alias("turns"))


@R.add("z9_block_rewrite", "SELECT doc_id, regexp_replace(text, '\\[Was[^\\]]*\\]', '[footer]', 'g') AS text FROM documents WHERE contains(text, '[Was')")
def z9(s, d):
    return docs(s, d).where(F.contains("text", F.lit("[Was"))).select("doc_id", F.regexp_replace("text", r"\[Was[^\]]*\]", "[footer]").alias("text"))
