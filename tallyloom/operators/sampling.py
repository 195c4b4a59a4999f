"""Splits, samples and generators (2.6). Randomness is an integer hash any engine computes alike: (key * 2654435761 + seed)
mod 2^32; ties by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash values are cut into so many ranges, which are sorted apart and offset by their counts.
RANGES = 1024


def hash32(key: Column, seed: int = 7) -> Column:
    """Keys are first reduced modulo 2^31, so that the product stays inside 64 bits."""
    return F.pmod(F.pmod(key.cast("bigint"), F.lit(2147483648)) * F.lit(2654435761) + F.lit(seed), F.lit(4294967296))


def unit(key: Column, seed: int = 7) -> Column:
    return hash32(key, seed) / F.lit(4294967296.0)


def shuffled_position(df: DataFrame, key: str, seed: int = 7, ties: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """df with pos, its 0-based place in hash order (within each value of ``by``; ties by the key or another column): a
    rank from range counts, never one sorted task."""
    d = df.withColumn("h", hash32(F.col(key), seed)).withColumn("range", F.floor(F.col("h") / (4294967296 // RANGES)))
    n = d.groupBy(*by, "range").agg(F.count("*").alias("n"))
    before = (Window.partitionBy(*by) if by else Window).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
    n = n.select(*by, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(*by, "range").orderBy("h", ties or key)) - 1
    return d.withColumn("inside", inside).join(n if by else F.broadcast(n), [*by, "range"]).withColumn("pos", F.col("start") + F.col("inside")).drop("h", "range", "start", "inside")


def text_key(c: Column) -> Column:
    """32 bits of a text's MD5: a key any engine computes alike."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("bigint")


def running(df: DataFrame, order: str, size: str | None, name: str) -> DataFrame:
    """df with the sum of size (or the count) over all rows before, in the order of a numeric key. The key's span is cut at
    RANGES approximate quantiles, ranges are summed apart, and only their sums are run over without a partition."""
    key = F.col(order).cast("double")
    edges = df.agg(F.percentile_approx(key, [k / RANGES for k in range(1, RANGES)], 10 * RANGES).alias("edges"))  # one row
    d = df.crossJoin(F.broadcast(edges)).withColumn("range", F.coalesce(F.size(F.filter("edges", lambda e: e < key)), F.lit(0))).drop("edges")
    what = F.sum(size) if size else F.count("*")
    starts = d.groupBy("range").agg(what.alias("s"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    starts = starts.select("range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    inside = F.coalesce(what.over(Window.partitionBy("range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("inside", inside).join(F.broadcast(starts), "range").withColumn(name, F.col("start") + F.col("inside")).drop("range", "start", "inside")


def split_by_position(df: DataFrame, total: int, shares: tuple[tuple[str, float], ...]) -> DataFrame:
    """integer cut-offs on pos, the remainder to the last split."""
    out, at = None, 0
    for name, share in shares[:-1]:
        at += int(total * share)
        out = F.when(F.col("pos") < at, name) if out is None else out.when(F.col("pos") < at, name)
    return df.withColumn("split", out.otherwise(shares[-1][0]))
