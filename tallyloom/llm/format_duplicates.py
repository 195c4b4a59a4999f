"""Records that differ only in formatting, collapsed into one with its number of copies (problem 3).

Canonical form. Invisible characters, white space, letter case, punctuation and markup are dropped: only letters and
digits remain. A text that is a list of named fields (a JSON object, ``key=value; ...`` or one ``key: value`` a line,
at least two fields, no name twice) becomes the sorted list of its (name, value) pairs, each squashed in the same way,
so the order of the fields does not count while a value under another name does.

Hot keys. Copies may make up a third of all rows, so keys are counted exactly with map-side partial counts; keys over
``hot_rows`` (at most MOST_HOT of them) take a salted two-level aggregation and a broadcast of their minimum
identifiers, the rest one shuffle in which a group holds at most ``hot_rows`` identifiers.

Defined cases: NULL texts and texts with fewer than ``min_chars`` letters and digits are left out; an empty table gives
an empty result; exact copies count; an identifier given twice with one text counts once; texts of any length are used
whole; columns other than those named are never read, so clashing names do no harm.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import NOT_WORD, digest, squash
from tallyloom.session import cut, table

#: A group of copies with more rows than this is hot.
HOT_ROWS = 10_000
#: At most so many keys are hot, whatever the data's size: beyond MOST_HOT * HOT_ROWS rows the limit rises with them.
MOST_HOT = 100_000
#: Ways in which the rows of a hot key are spread.
SALTS = 64

#: A value may hold line breaks.
_FIELD = r"(?s)^[^\p{L}\p{N}]*([\p{L}\p{N}][\p{L}\p{N} _-]{0,40}?)[\"'*_ \t]*[=:](.*)$"


def _pairs(parts: Column) -> Column:
    """name, separator, value of each part, squashed; a part that is no field gives NULL."""
    field = lambda p: F.concat_ws("\u0001", squash(F.regexp_extract(p, _FIELD, 1)), squash(F.regexp_extract(p, _FIELD, 2)))
    return F.transform(parts, lambda p: F.when(p.rlike(_FIELD), field(p)))


def canonical(text: Column) -> Column:
    """The canonical form as a string; see the module's text."""
    t = F.regexp_replace(text, r"\p{Cf}", "")
    filled = lambda a: F.filter(a, lambda x: F.regexp_replace(x, NOT_WORD, "") != "")
    as_json = F.regexp_extract(t, r"^[^\p{L}\p{N}{]*(\{[\s\S]*\})[^\p{L}\p{N}}]*$", 1)
    parsed = F.from_json(F.when(as_json != "", as_json), "map<string,string>")
    from_map = F.transform(F.map_entries(parsed), lambda e: F.concat_ws("\u0001", squash(e["key"]), squash(F.coalesce(e["value"], F.lit("")))))
    by_line, by_mark = _pairs(filled(F.split(t, r"[\r\n]+"))), _pairs(filled(F.split(t, r"\s*;\s*")))
    names = lambda a: F.transform(a, lambda p: F.substring_index(p, "\u0001", 1))
    good = lambda a: a.isNotNull() & (F.size(a) >= 2) & ~F.exists(a, lambda p: p.isNull()) & (F.size(F.array_distinct(names(a))) == F.size(a))
    joined = lambda a: F.array_join(F.array_sort(a), "\u0002")
    # Only texts that can be field lists at all pay for the parsing.
    return (
        F.when(t.contains("{") & good(from_map), joined(from_map))
        .when(t.contains("=") & t.contains(";") & good(by_mark), joined(by_mark))
        .when(t.rlike(r"[\r\n]") & t.rlike(r"[:=]") & good(by_line), joined(by_line))
        .otherwise(squash(t))
    )


def keyed(df: DataFrame, id_col: str, text_col: str, min_chars: int = 30) -> DataFrame:
    """(id, key) of the texts long enough to be compared."""
    text = F.col(text_col)
    k = df.select(F.col(id_col).cast("bigint").alias("id"), canonical(text).alias("c")).where(F.col("id").isNotNull() & F.col("c").isNotNull())
    return k.where(F.length(F.regexp_replace("c", NOT_WORD, "")) >= min_chars).select("id", digest(F.col("c")).alias("key"))


def collapse(members: DataFrame, hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """(record_table, id, key) -> (record_table, id, first_id, copies) of every member of a group of two or more.

    members must be a table that is cheap to read again (see cut)."""
    g = ["record_table", "key"]
    hot = members.groupBy(*g).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select(*g)
    hot = cut(hot)  # its written size decides between a broadcast and a shuffle
    flagged = members.join(hot, g, "left_semi")
    salted = flagged.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    # An identifier may come twice, and both times with one salt: so distinct counts add up.
    once = salted.dropDuplicates(["record_table", "key", "id"])
    level1 = once.groupBy(*g, "salt").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    level2 = level1.groupBy(*g).agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies")).where("copies > 1")
    of_hot = once.join(level2, g).select("record_table", "id", "first_id", "copies")
    rest = members.join(hot, g, "left_anti").groupBy(*g).agg(F.collect_set("id").alias("ids")).where(F.size("ids") > 1)
    of_rest = rest.select("record_table", F.explode("ids").alias("id"), F.array_min("ids").alias("first_id"), F.size("ids").cast("bigint").alias("copies"))
    return of_hot.unionByName(of_rest)


def project_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the three tables of this project."""
    c = table(spark, sf_dir, "custom_test_data", "row_id", "chosen")
    a = table(spark, sf_dir, "annotated_completions", "completions").select(F.explode("completions").alias("c")).select("c.completion_id", "c.response")
    b = table(spark, sf_dir, "label_batches", "line_id", "response")
    b = b.select("line_id", F.explode("response.body.choices").alias("c")).select("line_id", F.col("c.message.content").alias("content"))
    parts = (("custom_test_data", c, "row_id", "chosen"), ("annotated_completions", a, "completion_id", "response"), ("label_batches", b, "line_id", "content"))
    return reduce(DataFrame.unionByName, [keyed(df, i, t).select(F.lit(n).alias("record_table"), "id", "key") for n, df, i, t in parts])


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(cut(project_members(spark, sf_dir)))
