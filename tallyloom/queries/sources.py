"""Readers, sinks and merges that are queries of their own (2.1, 2.2, 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import matching
from tallyloom.plans import views as V
from tallyloom.plans.views import sql
from tallyloom.queries.registry import Registry
from tallyloom.session import scratch, table
from tallyloom.sources import readers, sinks

REGISTRY = R = Registry()


@R.add("a3_jsonl_round_trip", "SELECT row_id, instruction, chosen, reject, label FROM custom_test_data")
def a3(s, d):
    """Written as JSON lines and read again under the declared schema."""
    at = scratch(s)
    sinks.write_jsonl(table(s, d, "custom_test_data", "row_id", "instruction", "chosen", "reject", "label"), at)
    schema = readers.CUSTOM.add("row_id", "long")
    return s.read.schema(schema).json(at).select("row_id", "instruction", "chosen", "reject", "label")


@R.add("a11_parquet", "SELECT doc_id, lang, source, n_chars FROM documents WHERE n_chars > 1000")
def a11(s, d):
    """Filter and columns reach the scan."""
    return readers.read_any(s, f"{d}/documents.parquet").where("n_chars > 1000").select("doc_id", "lang", "source", "n_chars")


@R.add("k1_split_sink", sql("feat", "SELECT split, count(*) AS n FROM feat WHERE split IS NOT NULL GROUP BY 1"))
def k1(s, d):
    """One folder a split; the count of one reads only its own folder."""
    at = scratch(s)
    sinks.write_splits(V.features(s, d).where("split is not null").select("feature_id", "split"), at)
    return s.read.schema("feature_id bigint, split string").parquet(at).groupBy("split").agg(F.count("*").alias("n"))


@R.add("b8_transcript_pairs", "SELECT doc_id, len(m) AS messages, trim(p[-1], chr(10) || ' ' || chr(9) || chr(13)) AS response, 0 AS margin FROM (SELECT doc_id, regexp_extract_all(text, '\\n\\n(Human|Assistant):', 1) AS m, string_split_regex(text, '\\n\\n(?:Human|Assistant):\\s*') AS p FROM documents WHERE doc_kind = 'transcript') WHERE m[-1] = 'Assistant'")
def b8(s, d):
    t = readers.transcripts(table(s, d, "documents", "doc_id", "text", "doc_kind").where("doc_kind = 'transcript'"), "text").where("usable")
    return t.select("doc_id", F.size("messages").alias("messages"), "response", F.lit(0).alias("margin"))


@R.add("d3_positional_merge", sql("feat", "SELECT count(*) AS rows, count_if(a.prompt = b.prompt) AS aligned FROM (SELECT prompt, row_number() OVER (PARTITION BY prompt ORDER BY response_idx, feature_id) AS r, response_idx FROM feat WHERE prompt IS NOT NULL) a JOIN (SELECT prompt, row_number() OVER (PARTITION BY prompt ORDER BY feature_id) AS r FROM feat WHERE prompt IS NOT NULL) b ON a.prompt = b.prompt AND a.r = b.r"))
def d3(s, d):
    """Two result lists of a prompt merged by ordinal, and the check that they line up."""
    from pyspark.sql import Window

    f = V.features(s, d).where("prompt is not null").select("prompt", "feature_id", "response_idx")
    w = Window.partitionBy("prompt")
    a = f.select("prompt", F.row_number().over(w.orderBy("response_idx", "feature_id")).alias("r"))
    b = f.select(F.col("prompt").alias("p"), F.row_number().over(w.orderBy("feature_id")).alias("q"))
    return a.join(b, (F.col("prompt") == F.col("p")) & (F.col("r") == F.col("q"))).agg(F.count("*").alias("rows"), F.count_if(F.col("prompt") == F.col("p")).alias("aligned"))


@R.add("d7_greedy_match")
def d7(s, d):
    """A prompt's responses in two deliveries matched one to one; only full permutations count."""
    p = V.preferences(s, d).where("prompt is not null and chosen is not null and rejected is not null").select("prompt", "chosen", "rejected")
    few = p.select("prompt", F.explode(F.array("chosen", "rejected")).alias("x")).groupBy("prompt").agg(F.countDistinct("x").alias("n")).where("n <= 100")
    p = p.join(few, "prompt", "left_semi")  # C3: the operator is defined up to 100 responses
    a = p.groupBy("prompt").agg(F.array_sort(F.collect_set("chosen")).alias("left"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("chosen", "rejected"))))).alias("right"))
    return matching.match_arrays(a, "prompt")
