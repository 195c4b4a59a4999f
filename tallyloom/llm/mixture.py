"""Mixing sources to target weights (problem 7).

Hierarchical budgeting: the listed sources are the leaves of a tree domain > language > source (a source's domain and
language are those of most of its tokens). The budget flows from the root by weight; a child that cannot take its part
even when each of its documents is used max_repeats times takes what it can, and the shortage goes to its siblings by
weight, and only what they cannot take goes up to the ancestor's other children. Each leaf then takes whole epochs of its
documents and, of the last epoch, the token-prefix in a seeded hash order.

Only sums reach the driver: one row for each listed source, kind and language. Prefixes come from sums per hash range
and a window inside a range, so a source with a third of all rows is never sorted in one task.

Defined cases: documents of other sources or without a source are left out; NULL texts have 0 tokens, and documents without
tokens are used in whole epochs only; a source falls short when the tree gives it less than its part; a listed source
without documents has capacity 0; source names are compared in lower case with separators unified; empty tables give
sources that all fall short of nothing (budget 0).
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import source_name
from tallyloom.llm.tokens import counted
from tallyloom.session import cut, table

RANGES = 1024


def spread(amount: float, weights: dict[str, float], caps: dict[str, float]) -> dict[str, float]:
    """Share amount by weight; what exceeds a cap goes to the others by weight."""
    got = dict.fromkeys(weights, 0.0)
    open_ = {k for k in weights if caps[k] > 0}
    while amount > 1e-9 and open_:
        total = sum(weights[k] for k in open_)
        part = {k: amount * (weights[k] / total if total else 1 / len(open_)) for k in open_}
        full = {k for k in open_ if got[k] + part[k] >= caps[k]}
        if not full:
            for k in open_:
                got[k] += part[k]
            break
        for k in full:
            amount -= caps[k] - got[k]
            got[k] = caps[k]
        open_ -= full
    return got


def budget(leaves: dict[tuple[str, str, str], tuple[float, float]], amount: float) -> dict[tuple[str, str, str], float]:
    """(domain, language, source) -> (weight, capacity); the amount each leaf gets."""

    def down(paths: list[tuple[str, str, str]], depth: int, amount: float) -> dict[tuple[str, str, str], float]:
        if depth == 3:
            return {paths[0]: amount}
        kids: dict[str, list] = defaultdict(list)
        for p in paths:
            kids[p[depth]].append(p)
        got = spread(amount, {k: sum(leaves[p][0] for p in v) for k, v in kids.items()}, {k: sum(leaves[p][1] for p in v) for k, v in kids.items()})
        return {p: x for k, v in kids.items() for p, x in down(v, depth + 1, got[k]).items()}

    return down(sorted(leaves), 0, amount) if leaves else {}


def allocate(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """docs(doc_id, source, lang, kind, n_tok) of listed sources -> one row a source with its budget; see the columns."""
    spark = docs.sparkSession
    want = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.collect()}
    sums = docs.groupBy("source", "kind", "lang").agg(F.sum("n_tok").alias("n")).collect()
    tokens: dict[str, int] = defaultdict(int)
    home: dict[str, tuple[int, str, str]] = {}
    for r in sorted(sums, key=lambda r: (r["source"], str(r["kind"]), str(r["lang"]))):
        tokens[r["source"]] += r["n"]
        if r["source"] not in home or r["n"] > home[r["source"]][0]:
            home[r["source"]] = (r["n"], r["kind"] or "", r["lang"] or "")
    total = sum(tokens[s] for s in want)
    leaves = {(home.get(s, (0, "", ""))[1], home.get(s, (0, "", ""))[2], s): (w, float(tokens[s] * m)) for s, (w, m) in want.items()}
    got = {p[2]: x for p, x in budget(leaves, float(total)).items()}
    # Redistribution only adds, so a leaf that the tree gives less than its part is one that cannot take it.
    falls_short = {s: got[s] < w * total - 1e-6 for s, (w, _) in want.items()}
    rows = []
    for (kind, lang, s), (w, cap) in sorted(leaves.items(), key=lambda x: x[0][2]):
        rows.append((s, kind, lang, w, want[s][1], tokens[s], int(cap), w * total, got[s], falls_short[s]))
    return spark.createDataFrame(rows, "source string, domain string, lang string, target_share double, max_repeats int, tokens bigint, capacity bigint, target_tokens double, budget double, short boolean")


def select(docs: DataFrame, allocation: DataFrame, seed: int = 42, ranges: int = RANGES) -> DataFrame:
    """Every document of the mixture with how often it is used: (doc_id, source, n_tok, repeats)."""
    a = allocation.select("source", F.col("tokens").alias("all_tokens"), "budget").where("all_tokens > 0")
    a = a.withColumn("epochs", F.floor(F.col("budget") / F.col("all_tokens") + F.lit(1e-12)).cast("int")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("all_tokens"))
    d = docs.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("range", F.pmod(F.shiftright("h", 20), F.lit(ranges)).cast("int"))
    sums = d.groupBy("source", "range").agg(F.sum("n_tok").alias("s"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    inside = F.sum("n_tok").over(Window.partitionBy("source", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("inside", inside).join(sums, ["source", "range"]).join(F.broadcast(a), "source")
    # Of the last epoch only documents with tokens: one without would be used once more than it may be.
    repeats = F.col("epochs") + ((F.col("n_tok") > 0) & (F.col("start") + F.col("inside") <= F.col("rest"))).cast("int")
    return d.select("doc_id", "source", "n_tok", repeats.alias("repeats")).where("repeats > 0")


def report(chosen: DataFrame, allocation: DataFrame) -> DataFrame:
    """The shares really reached."""
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tok") * F.col("repeats")).alias("used_tokens"), F.sum("repeats").cast("bigint").alias("used_documents"), F.max("repeats").alias("most_repeats"))
    out = allocation.join(F.broadcast(used), "source", "left").na.fill(0, ["used_tokens", "used_documents", "most_repeats"])
    whole = Window.partitionBy()  # a row a source
    return out.withColumn("actual_share", F.col("used_tokens") / F.nullif(F.sum("used_tokens").over(whole), F.lit(0)))


def project(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets").select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "doc_kind").withColumn("source", source_name(F.col("source")))
    listed = docs.join(F.broadcast(targets.select("source")), "source", "left_semi")  # mix_targets is fixed at 12 rows
    d = cut(counted(listed.select("doc_id", "source", F.lower(F.trim("lang")).alias("lang"), F.col("doc_kind").alias("kind"), "text")))
    return d, allocate(d, targets)
