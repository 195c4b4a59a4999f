"""Base relations: the data model of the analytics over the project's tables, in Spark and as SQL for the oracle.

Redelivered rows (same id, other ingestion time) are reduced to the first delivery by one aggregate on the id, whose hash
partitioning later group-bys on the same id reuse. Ratings are int or NULL: "N/A", absent dimensions and -1 are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import table

DIMS = {"h": "helpfulness", "o": "honesty", "f": "instruction_following", "t": "truthfulness"}


def first_delivery(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row for each key: the one with the earliest time. An aggregate a column, so that those nobody asks for are
    neither read nor shuffled; all take the same row, for they see the rows in one order."""
    when = F.coalesce(F.col(at), F.lit("9999-12-31").cast("timestamp"))
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(*(F.min_by(c, when).alias(c) for c in cols)).select(*df.columns)


def rating(c: Column, dim: str) -> Column:
    """Rating of a dimension as int; what is no valid rating is NULL."""
    v = F.try_element_at(c["annotations"], F.lit(dim))["Rating"].try_cast("int")
    return F.when(v >= 0, v)


def mean_of(values: list[Column]) -> Column:
    """Mean of the values that are not NULL; NULL if none is."""
    n = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(v, F.lit(0)) for v in values), F.lit(0)) / n)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, instruction, source_dataset, rs): each prompt with its responses in completion order."""
    e = first_delivery(table(spark, sf_dir, "annotated_completions", "entry_id", "instruction", "completions", "source_dataset", "ingested_at"), "entry_id", "ingested_at")

    def one(c: Column, i: Column) -> Column:
        dims = {k: rating(c, d) for k, d in DIMS.items()}
        return F.struct(i.cast("int").alias("idx"), c["completion_id"].alias("completion_id"), c["model"].alias("model"), c["response"].alias("response"), *(v.alias(k) for k, v in dims.items()), mean_of(list(dims.values())).alias("avg"))

    return e.select(F.col("entry_id").alias("prompt_id"), "instruction", "source_dataset", F.transform("completions", one).alias("rs"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each response of each prompt."""
    return entries(spark, sf_dir).select("prompt_id", "source_dataset", F.explode("rs").alias("r")).select("prompt_id", "source_dataset", "r.*")


def rated_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with at least two responses that have a rating (C6); rs keeps only those, renumbered from 0."""
    e = entries(spark, sf_dir).withColumn("rs", F.filter("rs", lambda r: r["avg"].isNotNull()))
    e = e.withColumn("rs", F.transform("rs", lambda r, i: r.withField("idx", i.cast("int"))))
    return e.where(F.size("rs") >= 2).withColumn("k", F.size("rs"))


def pairs(e: DataFrame, *keep: str) -> DataFrame:
    """Ordered pairs i <> j inside each prompt, from the prompt's own array: no join and no shuffle."""
    a = e.select("prompt_id", "rs", *keep, F.explode("rs").alias("a"))
    return a.select("prompt_id", "a", *keep, F.explode("rs").alias("b")).where(F.col("a.idx") != F.col("b.idx"))


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pref_id, prompt, chosen, rejected, dimension, scores, margin, source_dataset): texts of the first messages (A4, B1); no first rejected message leaves NULL."""
    p = first_delivery(table(spark, sf_dir, "preferences"), "pref_id", "ingested_at")
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))["content"]
    return p.select("pref_id", first("prompt").alias("prompt"), first("chosen").alias("chosen"), first("rejected").alias("rejected"), "dimension", "score_chosen", "score_rejected", "margin", "source_dataset", "created_at")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt, winner, loser) texts of the decided rows of custom_test_data (DM4, DM8)."""
    c = table(spark, sf_dir, "custom_test_data", "row_id", "instruction", "chosen", "reject", "label").where("label in (0, 1) and instruction is not null and chosen is not null and reject is not null and chosen <> reject")
    w = F.col("label") == 1
    return c.select("row_id", F.col("instruction").alias("prompt"), F.when(w, F.col("chosen")).otherwise(F.col("reject")).alias("winner"), F.when(w, F.col("reject")).otherwise(F.col("chosen")).alias("loser"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """features_labeled, one row a feature_id; split in lower case without blanks; -1 scores are NULL."""
    f = first_delivery(table(spark, sf_dir, "features_labeled"), "feature_id", "extracted_at")
    dims = {f"dim_{d}": F.when(F.col(f"dim_{d}") >= 0, F.col(f"dim_{d}")) for d in DIMS.values()}
    return f.withColumns({**dims, "split": F.lower(F.trim("split"))})


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, idx, v, reward): embeddings as preference vectors of candidates, four neighbours in id to a prompt (the
    table's ten labels are too few to be prompts); all components, whatever their number; reward is the first (DM11 to DM13)."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return e.select(F.floor(F.col("vec_id") / 4).alias("prompt_id"), (F.col("vec_id") % 4).cast("int").alias("idx"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.col("embedding")[0].cast("double").alias("reward"))


_R = {k: f"CASE WHEN TRY_CAST(c.annotations['{d}'].Rating AS INT) >= 0 THEN TRY_CAST(c.annotations['{d}'].Rating AS INT) END" for k, d in DIMS.items()}
_AVG = "list_avg([x FOR x IN [h, o, f, t] IF x IS NOT NULL])"

def skew_sql(v: str, w: str, weight: str = "1.0", blocks: str = "") -> str:
    """Sum over blocks k = 1 .. d/2 of weight * (v0 w1 - v1 w0)."""
    return f"list_sum([{weight} * ({v}[2 * k - 1] * {w}[2 * k] - {v}[2 * k] * {w}[2 * k - 1]) FOR k IN range(1, {blocks or f'len({v}) // 2'} + 1)])"


#: Common table expressions by name, each with the names it needs.
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "entries": ((), "SELECT * FROM annotated_completions QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY ingested_at NULLS LAST) = 1"),
    "resp0": (("entries",), "SELECT entry_id, source_dataset, unnest(completions) AS c, generate_subscripts(completions, 1) - 1 AS idx FROM entries"),
    "resp1": (("resp0",), f"SELECT entry_id AS prompt_id, source_dataset, CAST(idx AS INT) AS idx, c.completion_id AS completion_id, c.model AS model, c.response AS response, {', '.join(f'{v} AS {k}' for k, v in _R.items())} FROM resp0"),
    "resp": (("resp1",), f"SELECT *, {_AVG} AS avg FROM resp1"),
    "rated0": (("resp",), "SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY idx) - 1 AS INT) AS idx), count(*) OVER (PARTITION BY prompt_id) AS k FROM resp WHERE avg IS NOT NULL"),
    "rated": (("rated0",), "SELECT * FROM rated0 WHERE k >= 2"),
    "pair": (("rated",), "SELECT a.prompt_id, a.k, a.idx AS i, b.idx AS j, a.h AS ha, a.o AS oa, a.f AS fa, a.t AS ta, a.avg AS aa, b.h AS hb, b.o AS ob, b.f AS fb, b.t AS tb, b.avg AS ab FROM rated a JOIN rated b ON a.prompt_id = b.prompt_id AND a.idx <> b.idx"),
    "pm": (("pair",), "SELECT prompt_id, k, i, j, coalesce(list_avg([x FOR x IN [(sign(ha - hb) + 1) / 2.0, (sign(oa - ob) + 1) / 2.0, (sign(fa - fb) + 1) / 2.0, (sign(ta - tb) + 1) / 2.0] IF x IS NOT NULL]), 0.5) AS p FROM pair"),
    "pref": ((), "SELECT pref_id, prompt[1].content AS prompt, chosen[1].content AS chosen, rejected[1].content AS rejected, dimension, score_chosen, score_rejected, margin, source_dataset, created_at FROM (SELECT * FROM preferences QUALIFY row_number() OVER (PARTITION BY pref_id ORDER BY ingested_at NULLS LAST) = 1)"),
    "outc": ((), "SELECT row_id, instruction AS prompt, CASE WHEN label = 1 THEN chosen ELSE reject END AS winner, CASE WHEN label = 1 THEN reject ELSE chosen END AS loser FROM custom_test_data WHERE label IN (0, 1) AND instruction IS NOT NULL AND chosen IS NOT NULL AND reject IS NOT NULL AND chosen <> reject"),
    "feat": ((), "SELECT * REPLACE (lower(trim(split)) AS split, " + ", ".join(f"CASE WHEN dim_{d} >= 0 THEN dim_{d} END AS dim_{d}" for d in DIMS.values()) + ") FROM (SELECT * FROM features_labeled QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY extracted_at NULLS LAST) = 1)"),
    "vec": ((), "SELECT vec_id // 4 AS prompt_id, CAST(vec_id % 4 AS INT) AS idx, CAST(embedding AS DOUBLE[]) AS v, CAST(embedding[1] AS DOUBLE) AS reward FROM embeddings"),
    "vp": (("vec",), f"SELECT a.prompt_id, a.idx AS i, b.idx AS j, a.reward AS ri, b.reward AS rj, a.v AS vi, a.v[1] * b.v[2] - a.v[2] * b.v[1] AS s2, {skew_sql('a.v', 'b.v')} AS s, {skew_sql('a.v', 'b.v', 'exp(a.v[2 * k - 1])')} * (len(a.v) // 2) / list_sum([exp(a.v[2 * k - 1]) FOR k IN range(1, len(a.v) // 2 + 1)]) AS sg FROM vec a JOIN vec b ON a.prompt_id = b.prompt_id AND a.idx <> b.idx"),
    "cal": (("outc",), "SELECT row_id, o.prompt, winner, loser, CASE WHEN winner < loser THEN ab ELSE ba END / (ab + ba) AS p_emp, CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END AS p FROM (SELECT *, greatest(-12.0, least(12.0, (length(winner) - length(loser)) / 64.0)) AS z FROM outc) o JOIN (SELECT prompt, least(winner, loser) AS a, greatest(winner, loser) AS b, sum(CASE WHEN winner < loser THEN 1 ELSE 0 END) AS ab, sum(CASE WHEN winner < loser THEN 0 ELSE 1 END) AS ba FROM outc GROUP BY 1, 2, 3) w ON o.prompt = w.prompt AND least(winner, loser) = a AND greatest(winner, loser) = b"),
}


def sql(names: str, body: str) -> str:
    """body under the WITH clause of the named relations and all that they need."""
    order: list[str] = []

    def need(n: str) -> None:
        for m in CTE[n][0]:
            need(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    return "WITH " + ", ".join(f"{n} AS ({CTE[n][1]})" for n in order) + " " + body
