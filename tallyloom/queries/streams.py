"""Structured Streaming queries and their batch twins (7.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.queries.registry import Registry
from tallyloom.streaming import events as E

REGISTRY = R = Registry()
stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
#: Where the watermark stands at the end: what ends later is not given out yet.
CLOSED = "(SELECT max(ts) - INTERVAL 1 day FROM events)"
TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@R.add("st1_tumbling_counts", f"SELECT {TS.format('time_bucket(INTERVAL 1 hour, ts)')} AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour <= {CLOSED} GROUP BY 1, 2")
def st1(s, d):
    t = E.run(E.tumbling(E.stream(s, d)))
    return t.select(stamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@R.add("st2_sliding_counts", f"SELECT {TS.format('time_bucket(INTERVAL 2 hour, ts) - k * INTERVAL 2 hour')} AS start, event_type, count(*) AS n FROM events, (SELECT unnest(range(0, 3)) AS k) WHERE time_bucket(INTERVAL 2 hour, ts) - k * INTERVAL 2 hour + INTERVAL 6 hour <= {CLOSED} GROUP BY 1, 2")
def st2(s, d):
    return E.run(E.sliding(E.stream(s, d))).select(stamp("start").alias("start"), "event_type", "n")


@R.add("st3_user_sessions", f"SELECT user_id, {TS.format('min(ts)')} AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sess FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 minute THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, sess HAVING max(ts) + INTERVAL 30 minute <= {CLOSED}")
def st3(s, d):
    return E.run(E.sessions(E.stream(s, d))).select("user_id", stamp("start").alias("start"), "n")


LAG = "SELECT user_id, event_id, event_type AS t, value AS v, lag(event_type) OVER w AS t0, lag(value) OVER w AS v0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
SP = f"sp AS (SELECT user_id, CASE WHEN v > v0 THEN t ELSE t0 END AS winner, CASE WHEN v > v0 THEN t0 ELSE t END AS loser, abs(v - v0) AS margin, event_id FROM ({LAG}) WHERE t <> t0)"


@R.add("st4_preference_pairs", f"WITH {SP} SELECT user_id, winner, loser, round(margin, 6) AS margin, event_id FROM sp")
def st4(s, d):
    return E.run(E.preference_pairs(E.stream(s, d))).withColumn("margin", F.round("margin", 6))


@R.add("st5_stream_conflicts", f"WITH {SP}, g AS (SELECT user_id, least(winner, loser) AS a, greatest(winner, loser) AS b, count_if(winner < loser) AS u, count(*) AS n FROM sp GROUP BY 1, 2, 3) SELECT count(*) AS pairs, count_if(u > 0 AND u < n) AS conflicts FROM g")
def st5(s, d):
    p = E.run(E.preference_pairs(E.stream(s, d)))
    g = p.groupBy("user_id", F.least("winner", "loser").alias("a"), F.greatest("winner", "loser").alias("b")).agg(F.count_if(F.col("winner") < F.col("loser")).alias("u"), F.count("*").alias("n"))
    return g.agg(F.count("*").alias("pairs"), F.count_if((F.col("u") > 0) & (F.col("u") < F.col("n"))).alias("conflicts"))
