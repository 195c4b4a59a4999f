"""Filling fixed-capacity containers with items of varying length (problem 6).

Exact-complement hashing. The items are reduced to a histogram of lengths (at most ``capacity`` rows, whatever the data's
size); on it, lengths that alone, in pairs or in triples sum exactly to the capacity are found through a hash index of
sums and consumed as often as the availability counts allow; what is left is placed best-fit by decreasing length, again
by counts: a pattern is repeated until one of its lengths runs out. So a plan has at most about two patterns for each
length. Items then take their place by rank among those of equal length, with ranks that are counted per salt and offset,
so no length, however common, is ranked in one task.

An item over the capacity is split into full containers and one remainder that is packed with the rest; no other item is
split. Defined cases: items with 0 tokens or NULL need no room and get container NULL; repeated ids are packed as
separate items; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.tokens import counted
from tallyloom.session import cut, table

CAPACITY = 2048
SALTS = 128


def plan(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Lengths with their counts -> (length -> times in a container, number of such containers)."""
    left = {k: n for k, n in hist.items() if 0 < k <= capacity and n > 0}
    out: list[tuple[dict[int, int], int]] = []

    def take(lengths: list[int]) -> None:
        need = Counter(lengths)
        m = min(left.get(k, 0) // n for k, n in need.items())
        if m:
            out.append((dict(need), m))
            for k, n in need.items():
                left[k] -= m * n
                if not left[k]:
                    del left[k]

    if capacity in left:
        take([capacity])
    for a in sorted(left, reverse=True):
        if a in left and capacity - a <= a and (capacity - a) in left:
            take([a, capacity - a])
    for a in sorted(left, reverse=True):
        if a not in left:
            continue
        gap = capacity - a
        for b in sorted((x for x in left if gap / 2 <= x <= min(a, gap - 1)), reverse=True):
            if a not in left:
                break
            if b in left and (gap - b) in left:
                take([a, b, gap - b])
    while left:
        room, lengths, free = capacity, [], dict(left)
        while fit := max((x for x in free if x <= room), default=0):
            k = min(free[fit], room // fit)
            lengths += [fit] * k
            room -= fit * k
            del free[fit]
        take(lengths)
    return out


def intervals(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first container, items of this length a container)."""
    used, base, rows = Counter(), 0, []
    for need, m in patterns:
        for k, n in need.items():
            rows.append((k, used[k], used[k] + m * n, base, n))
            used[k] += m * n
        base += m
    return rows


def pack(items: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """items(doc_id, n_tok) -> (doc_id, piece, length, container_id), one row for each piece of each item."""
    spark = items.sparkSession
    n = F.coalesce("n_tok", F.lit(0)).cast("bigint")
    whole = F.when(n > capacity, F.floor((n - 1) / capacity)).otherwise(F.lit(0)).cast("int")
    pieces = items.select("doc_id", n.alias("n"), whole.alias("full")).select("doc_id", "n", "full", F.explode(F.sequence(F.lit(0), F.col("full"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.when(F.col("piece") < F.col("full"), F.lit(capacity)).otherwise(F.col("n") - F.col("full") * capacity).cast("int").alias("length"))
    pieces = cut(pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")))
    per_salt = pieces.where("length > 0").groupBy("length", "salt").agg(F.count("*").alias("k"))
    hist = {r["length"]: r["n"] for r in per_salt.groupBy("length").agg(F.sum("k").alias("n")).collect()}  # at most capacity rows
    rows = intervals(plan(hist, capacity))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_salt.select("length", "salt", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))  # at most capacity * salts rows
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = pieces.where("length > 0").withColumn("own", own).join(F.broadcast(starts), ["length", "salt"]).select("doc_id", "piece", "length", (F.col("start") + F.col("own")).alias("rank"))
    where = F.broadcast(spark.createDataFrame(rows, "length int, lo bigint, hi bigint, base bigint, per bigint"))
    placed = ranked.join(where, "length").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    placed = placed.select("doc_id", "piece", "length", (F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("per"))).cast("bigint").alias("container_id"))
    return placed.unionByName(pieces.where("length = 0").select("doc_id", "piece", "length", F.lit(None).cast("bigint").alias("container_id")))


def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(counted(table(spark, sf_dir, "documents", "doc_id", "text")))
