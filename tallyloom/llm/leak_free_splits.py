"""Splits that keep related records together (problem 1).

Records are related when their normalised instruction agrees or they share a thread; a group is all that chains of such
relations link. Every record gets a key (its instruction, or its thread where it has no instruction); each thread with
two or more keys links them to its smallest one. On this graph, whose nodes are keys and not records, components come
from a frontier breadth-first search: many seeds (local minima of a hash, so every component has one) expand at once
over the hash-partitioned adjacency, an edge between two labels is a collision, and the collisions form a small graph
that is merged by union-find in one task when its size is proven small, else by the same search again.

Defined cases: a NULL or empty instruction and a NULL thread relate nothing; repeated rows change nothing; empty tables
give empty results; keys are 128-bit digests of the whole normalised text; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import digest, squash
from tallyloom.session import cut, table

#: Collision graphs up to so many edges (at 32 bytes, 32 MB) are merged in one task; larger ones go through the search again.
SMALL_EDGES = 500_000
#: Places that the list of one node is spread over.
SALTS = 8
#: Share of each split.
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b, ha, hb): of each component's labels the one with the least hash."""
    parent: dict[tuple[int, bytes], tuple[int, bytes]] = {}

    def root(x: tuple[int, bytes]) -> tuple[int, bytes]:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for b in batches:
        for s, t, hs, ht in zip(map(bytes, b["a"]), map(bytes, b["b"]), b["ha"], b["hb"]):
            r, q = root((hs, s)), root((ht, t))
            if r != q:
                parent[max(r, q)] = min(r, q)
    nodes = list(parent)
    yield pd.DataFrame({"v": pd.Series([x[1] for x in nodes], dtype=object), "comp": pd.Series([root(x)[1] for x in nodes], dtype=object)})


def _hash(c: Column) -> Column:
    return F.xxhash64(c)


def components(edges: DataFrame, small_edges: int = SMALL_EDGES, depth: int = 0) -> DataFrame:
    """(a, b) binary -> (v, comp) for every node that has an edge; comp is the component's node with the least hash, whatever
    the way it was found (a node is a seed if it is below its neighbours, so that one always is; merging keeps the least)."""
    e = edges.where(F.col("a") != F.col("b"))
    both = cut(e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if depth and both.count() <= 2 * small_edges:
        once = both.where(F.col("a") < F.col("b")).withColumns({"ha": _hash(F.col("a")), "hb": _hash(F.col("b"))})
        return cut(once.coalesce(1).mapInPandas(_union_find, "v binary, comp binary"))
    return _search(both, small_edges, depth)


def _search(edges: DataFrame, small_edges: int, depth: int) -> DataFrame:
    """Adjacency lists lie hash-partitioned by node and salt for all rounds (a hub's list on SALTS places); a round moves the
    frontier to them, and never an edge. Lost parts are read again from the written table."""
    parts = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    adj = edges.withColumn("salt", F.pmod(_hash(F.col("b")), F.lit(SALTS)).cast("int")).repartition(parts, "a", "salt").persist(StorageLevel.DISK_ONLY)
    every = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
    h = lambda c: F.struct(_hash(c).alias("h"), c.alias("v"))
    lowest = adj.groupBy("a").agg(F.min(h(F.col("b"))).alias("m"))
    seeds = lowest.where(h(F.col("a")) < F.col("m")).select(F.col("a").alias("v"), F.col("a").alias("label"))
    found = [frontier := cut(seeds)]
    while True:
        ask = frontier.select(F.col("v").alias("a"), "label", every).repartition(parts, "a", "salt")
        reached = ask.join(adj, ["a", "salt"]).groupBy(F.col("b").alias("v")).agg(F.min("label").alias("label"))
        seen = reduce(DataFrame.union, found).select("v")
        frontier = cut(reached.join(seen, "v", "left_anti"))
        if frontier.isEmpty():
            break
        found.append(frontier)
    labels = reduce(DataFrame.union, found)
    # Each colliding pair once, with the labels of both ends.
    left = edges.where(F.col("a") < F.col("b")).join(labels.select(F.col("v").alias("a"), F.col("label").alias("la")), "a")
    pairs = left.join(labels.select(F.col("v").alias("b"), F.col("label").alias("lb")), "b").where(F.col("la") != F.col("lb"))
    clash = cut(pairs.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    adj.unpersist()
    if clash.isEmpty():
        return labels.select("v", F.col("label").alias("comp"))
    merged = components(clash, small_edges, depth + 1).select(F.col("v").alias("label"), "comp")
    return cut(labels.join(merged, "label", "left").select("v", F.coalesce("comp", "label").alias("comp")))


def record_key(instruction: Column, thread: Column) -> Column:
    text = squash(instruction)
    return F.coalesce(F.when(text != "", digest(F.concat(F.lit("i:"), text))), digest(F.concat(F.lit("t:"), thread.cast("string"))))


def key_links(records: DataFrame) -> DataFrame:
    """(k, thread) of all records -> edges (a, b) between keys of one thread, through its smallest key."""
    pairs = records.where(F.col("thread").isNotNull() & F.col("k").isNotNull()).select("thread", "k").distinct()
    least = pairs.groupBy("thread").agg(F.min("k").alias("a"), F.max("k").alias("z")).where(F.col("a") != F.col("z")).select("thread", "a")
    return pairs.join(least, "thread").where(F.col("a") != F.col("k")).select("a", F.col("k").alias("b")).distinct()


def project_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_table, record_id, k, thread, shipped) of both tables; a record with neither instruction nor thread is alone."""
    c = table(spark, sf_dir, "custom_test_data", "row_id", "instruction", "thread_id")
    f = table(spark, sf_dir, "features_labeled", "feature_id", "prompt", "thread_id", "split")
    alone = lambda n, i: digest(F.concat(F.lit(f"r:{n}:"), F.col(i).cast("string")))
    c = c.select(F.lit("custom_test_data").alias("record_table"), F.col("row_id").alias("record_id"), F.coalesce(record_key(F.col("instruction"), F.col("thread_id")), alone("c", "row_id")).alias("k"), F.col("thread_id").alias("thread"), F.lit(None).cast("string").alias("shipped"))
    f = f.select(F.lit("features_labeled").alias("record_table"), F.col("feature_id").alias("record_id"), F.coalesce(record_key(F.col("prompt"), F.col("thread_id")), alone("f", "feature_id")).alias("k"), F.col("thread_id").alias("thread"), squash(F.col("split")).alias("shipped"))
    return c.unionByName(f)


def separated(records: DataFrame, comps: DataFrame) -> DataFrame:
    """Records with a shipped split whose group holds more than one of them: (record_table, record_id)."""
    shipped = records.where(F.col("shipped").isNotNull() & (F.col("shipped") != ""))
    by_key = shipped.groupBy("k").agg(F.min("shipped").alias("lo"), F.max("shipped").alias("hi"))
    by_key = by_key.join(comps.select(F.col("v").alias("k"), "comp"), "k", "left").withColumn("comp", F.coalesce("comp", "k"))
    mixed = by_key.groupBy("comp").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(F.col("lo") != F.col("hi")).select("comp")
    keys = by_key.join(mixed, "comp", "left_semi").select("k")
    return shipped.join(keys, "k", "left_semi").select("record_table", "record_id").distinct()


def assign(records: DataFrame, comps: DataFrame, shares: dict[str, float] | None = None, seed: int = 42, buckets: int = 4096) -> DataFrame:
    """Every record with its component and split.

    Components are laid out in hash order and cut where the running number of records passes each share. Only sums of
    ``buckets`` hash ranges and components over 1/1000 of all records (fewer than 1000) reach the driver; those large
    components go first, each to the split that lacks most."""
    shares = shares or SHARES
    names = list(shares)
    r = records.join(comps.select(F.col("v").alias("k"), "comp"), "k", "left").withColumn("comp", F.coalesce("comp", "k"))
    sizes = cut(r.groupBy("comp").agg(F.count("*").alias("n")).withColumn("bucket", F.pmod(F.xxhash64("comp", F.lit(seed)), F.lit(buckets)).cast("int")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = {bytes(x["comp"]): x["n"] for x in sizes.where(F.col("n") > max(1, total) / 1000).select("comp", "n").collect()}
    rest = {x["bucket"]: x["n"] for x in sizes.where(F.col("n") <= max(1, total) / 1000).groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    room = {s: total * shares[s] for s in names}
    of_large = []
    for comp, n in sorted(large.items(), key=lambda x: (-x[1], x[0])):
        to = max(names, key=lambda s: room[s])
        room[to] -= n
        of_large.append((bytearray(comp), to))
    left = sum(max(0.0, room[s]) for s in names) or 1.0
    ends, run = [], 0.0
    for s in names:
        run += max(0.0, room[s]) / left * sum(rest.values())
        ends.append(run)
    of_bucket, at = [], 0.0
    for b in range(buckets):
        mid = at + rest.get(b, 0) / 2
        of_bucket.append((b, names[next((i for i, x in enumerate(ends) if mid <= x), len(names) - 1)]))
        at += rest.get(b, 0)
    spark = records.sparkSession
    big = F.broadcast(spark.createDataFrame(of_large, "comp binary, big_split string"))
    small = F.broadcast(spark.createDataFrame(of_bucket, "bucket int, small_split string"))
    split = sizes.join(big, "comp", "left").join(small, "bucket").select("comp", F.coalesce("big_split", "small_split").alias("new_split"))
    return r.join(split, "comp").select("record_table", "record_id", F.hex("comp").alias("component"), "new_split")


def project(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = project_records(spark, sf_dir)
    return records, components(key_links(records))


__all__ = ["components", "key_links", "separated", "assign", "project", "project_records"]
