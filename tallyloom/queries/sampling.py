"""Splits, sampling and generators (2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import sampling as SA
from tallyloom.plans import views as V
from tallyloom.plans.views import sql
from tallyloom.queries.registry import Registry
from tallyloom.session import table

REGISTRY = R = Registry()
r6 = lambda c: F.round(c, 6)
H = lambda k, s=7: f"((({k}) % 2147483648) * 2654435761 + {s}) % 4294967296"


def w(base, extra, body):
    return sql(base, "SELECT 1").replace(" SELECT 1", (", " + extra if extra else "") + " " + body)


MD = lambda c: f"('0x' || substr(md5({c}), 1, 8))::BIGINT"


def prompt_split(name, a, b, seed):
    ps = f"up AS (SELECT DISTINCT instruction FROM entries WHERE instruction IS NOT NULL), ps AS (SELECT instruction, row_number() OVER (ORDER BY {H(MD('instruction'), seed)}, instruction) - 1 AS pos, count(*) OVER () AS n FROM up)"

    @R.add(name, w("entries", ps, f"SELECT entry_id, CASE WHEN pos < floor(n * {a}) THEN 'train' WHEN pos < floor(n * {a}) + floor(n * {b}) THEN 'validation' ELSE 'test' END AS split FROM entries JOIN ps USING (instruction)"))
    def run(s, d):
        """Unique prompts in hash order (by their text, so ties are told apart); every entry follows its prompt."""
        e = V.entries(s, d).where("instruction is not null").select(F.col("prompt_id").alias("entry_id"), "instruction")
        u = e.select("instruction").distinct().withColumn("key", SA.text_key(F.col("instruction")))
        u = SA.split_by_position(SA.shuffled_position(u, "key", seed, "instruction"), u.count(), (("train", a), ("validation", b), ("test", 0)))
        return e.join(u, "instruction").select("entry_id", "split")


prompt_split("f1_split_80_10_10", 0.8, 0.1, 7)
prompt_split("f2_split_90_5_5", 0.9, 0.05, 11)


def ordinal_split(name, share, cap):
    limit = f" AND pos < floor(n * {share}) + {cap}" if cap else ""

    @R.add(name, w("pref", "ps AS (SELECT pref_id, row_number() OVER (ORDER BY pref_id) - 1 AS pos, count(*) OVER () AS n FROM pref)", f"SELECT pref_id, pos < floor(n * {share}) AS train FROM ps WHERE true{limit}"))
    def run(s, d):
        """Positions by rank of the id."""
        p = V.preferences(s, d).select("pref_id")
        n = p.count()
        z = SA.running(p, "pref_id", None, "pos")
        return (z.where(F.col("pos") < int(n * share) + cap) if cap else z).select("pref_id", (F.col("pos") < int(n * share)).alias("train"))


ordinal_split("f3_prefix_split", 0.9, 20)
ordinal_split("z12_grouped_prefix_split", 0.9, 0)


@R.add("f4_row_shuffle_split", f"SELECT row_id, CASE WHEN pos < floor(n * 0.8) THEN 'train' WHEN pos < floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split FROM (SELECT row_id, row_number() OVER (ORDER BY {H('row_id', 13)}, row_id) - 1 AS pos, count(*) OVER () AS n FROM custom_test_data)")
def f4(s, d):
    c = table(s, d, "custom_test_data", "row_id")
    return SA.split_by_position(SA.shuffled_position(c, "row_id", 13), c.count(), (("train", 0.8), ("validation", 0.1), ("test", 0))).select("row_id", "split")


def sample(name, n, seed):
    @R.add(name, f"SELECT row_id FROM custom_test_data ORDER BY {H('row_id', seed)}, row_id LIMIT {n}")
    def run(s, d):
        return table(s, d, "custom_test_data", "row_id").orderBy(SA.hash32(F.col("row_id"), seed), "row_id").limit(n)


sample("f5_sample_sorted", 200, 17)
sample("f6_fixed_test_sample", 500, 19)


@R.add("f7_shard_slice", "SELECT row_id, instruction FROM custom_test_data WHERE row_id BETWEEN 1000 AND 1999")
def f7(s, d):
    """A shard is a slice of ids: the filter reaches the scan."""
    return table(s, d, "custom_test_data", "row_id", "instruction").where("row_id between 1000 and 1999")


F8 = f"gp AS (SELECT g, row_number() OVER (ORDER BY {H('g', 23)}, g) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT row_id // 4 AS g FROM custom_test_data)), al AS (SELECT g, pos, false AS padding FROM gp UNION ALL SELECT g, n + pos, true FROM gp WHERE pos < (4 - n % 4) % 4)"


def grouped_shuffle(name, pad):
    keep = "true" if pad else "pos < (SELECT count(*) // 4 * 4 FROM gp)"

    @R.add(name, f"WITH {F8} SELECT row_id, g AS group_id, CAST(pos % 4 AS INT) AS replica, padding FROM al JOIN custom_test_data ON row_id // 4 = g WHERE {keep}" + ("" if pad else " AND NOT padding"))
    def run(s, d):
        """Groups in hash order, dealt to four replicas; the first groups again, or the last ones not, until all replicas have as many."""
        c = table(s, d, "custom_test_data", "row_id").withColumn("group_id", F.floor(F.col("row_id") / 4))
        g = SA.shuffled_position(c.select("group_id").distinct(), "group_id", 23)
        n = g.count()
        if pad:
            more = g.where(F.col("pos") < (4 - n % 4) % 4)
            g = g.select("group_id", "pos", F.lit(False).alias("padding")).unionByName(more.select("group_id", (F.col("pos") + n).alias("pos"), F.lit(True).alias("padding")))
        else:
            g = g.where(F.col("pos") < n // 4 * 4).select("group_id", "pos", F.lit(False).alias("padding"))
        return c.join(g, "group_id").select("row_id", "group_id", (F.col("pos") % 4).cast("int").alias("replica"), "padding")


grouped_shuffle("f8_group_shuffle", True)
grouped_shuffle("f8_group_shuffle_dropped", False)

# Share of the rows that each dimension is to have afterwards; the first is more than it has, so it is repeated.
TARGET = {"honesty": 0.5, "helpfulness": 0.1, "truthfulness": 0.1}
F9 = "tg AS (SELECT d AS dimension, floor((SELECT count(*) FROM pref) * x) AS target FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in TARGET.items()) + f") t(d, x)), rk AS (SELECT pref_id, dimension, target, row_number() OVER (PARTITION BY dimension ORDER BY {H('pref_id', 29)}, pref_id) - 1 AS r, count(*) OVER (PARTITION BY dimension) AS n FROM pref JOIN tg USING (dimension))"


@R.add("f9_dimension_resample", w("pref", F9, "SELECT pref_id, dimension, CAST(c AS INT) AS copy FROM (SELECT pref_id, dimension, r, n, target, unnest(range(0, CAST(ceil(target / n) AS BIGINT))) AS c FROM rk) WHERE r + c * n < target"))
def f9(s, d):
    """Target counts by dimension: the first in hash order, in rounds over all of them where a dimension is short."""
    p = V.preferences(s, d).select("pref_id", "dimension")
    total = p.count()
    goal = F.element_at(F.create_map(*(F.lit(x) for k, v in TARGET.items() for x in (k, int(total * v)))), F.col("dimension"))
    p = p.where(F.col("dimension").isin(*TARGET))
    n = F.broadcast(p.groupBy("dimension").agg(F.count("*").alias("n")))  # a row a dimension
    z = SA.shuffled_position(p, "pref_id", 29, by=("dimension",)).join(n, "dimension").withColumn("target", goal)
    z = z.where(F.col("pos") < F.col("target")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.floor((F.col("target") - 1 - F.col("pos")) / F.col("n")).cast("int"))))
    return z.select("pref_id", "dimension", "copy")


@R.add("f10_cycle_oversample", sql("feat", "SELECT feature_id, c AS copy FROM feat, (SELECT unnest(range(0, 3)) AS c) WHERE c = 0 OR has_cycle"))
def f10(s, d):
    f = V.features(s, d).select("feature_id", F.explode(F.when(F.col("has_cycle"), F.sequence(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return f


FL = f"({H('pref_id', 31)}) < 0.2 * 4294967296"


@R.add("f11_label_flip", sql("pref", f"SELECT pref_id, CASE WHEN {FL} THEN rejected ELSE chosen END AS chosen, CASE WHEN {FL} THEN chosen ELSE rejected END AS rejected, CASE WHEN {FL} THEN -margin ELSE margin END AS margin, {FL} AS is_poisoned FROM pref"))
def f11(s, d):
    f = SA.hash32(F.col("pref_id"), 31) < 0.2 * 4294967296
    pick = lambda a, b: F.when(f, a).otherwise(b)
    return V.preferences(s, d).select("pref_id", pick(F.col("rejected"), F.col("chosen")).alias("chosen"), pick(F.col("chosen"), F.col("rejected")).alias("rejected"), pick(-F.col("margin"), F.col("margin")).alias("margin"), f.alias("is_poisoned"))


GEN = f"gen AS (SELECT k, 1 + ({H('k', 37)}) % 100 AS i, 1 + (({H('k', 37)}) % 100 + 1 + ({H('k', 41)}) % 99) % 100 AS j FROM (SELECT unnest(range(0, 1000)) AS k))"


def gen(s, n=1000):
    k = s.range(n).withColumnRenamed("id", "k")
    a, b = SA.hash32(F.col("k"), 37), SA.hash32(F.col("k"), 41)
    return k.select("k", (1 + a % 100).alias("i"), (1 + (a % 100 + 1 + b % 99) % 100).alias("j"))


@R.add("f12_transitive_pairs", f"WITH {GEN} SELECT k, greatest(i, j) AS chosen, least(i, j) AS rejected FROM gen")
def f12(s, d):
    return gen(s).select("k", F.greatest("i", "j").alias("chosen"), F.least("i", "j").alias("rejected"))


POISON = 97


@R.add("f13_local_cycles", f"WITH {GEN} SELECT k, greatest(i, j) AS chosen, least(i, j) AS rejected, NULL::BIGINT AS cycle_id FROM gen WHERE k < 1000 - 3 * {POISON} UNION ALL SELECT 1000 - 3 * {POISON} + 3 * c + leg, 1 + c % 97 + leg, CASE WHEN leg = 2 THEN 1 + c % 97 ELSE 2 + c % 97 + leg END, 1 + c % 97 FROM (SELECT unnest(range(0, {POISON})) AS c) CROSS JOIN (SELECT unnest(range(0, 3)) AS leg)")
def f13(s, d):
    """i > i+1 > i+2 > i: three rows a cycle, in place of the last clean rows."""
    clean = gen(s).where(F.col("k") < 1000 - 3 * POISON).select("k", F.greatest("i", "j").alias("chosen"), F.least("i", "j").alias("rejected"), F.lit(None).cast("bigint").alias("cycle_id"))
    c = s.range(POISON).withColumnRenamed("id", "c").select("c", (1 + F.col("c") % 97).alias("i"), F.explode(F.array(*map(F.lit, range(3)))).alias("leg"))
    bad = c.select((1000 - 3 * POISON + 3 * F.col("c") + F.col("leg")).alias("k"), (F.col("i") + F.col("leg")).alias("chosen"), F.when(F.col("leg") == 2, F.col("i")).otherwise(F.col("i") + 1 + F.col("leg")).alias("rejected"), F.col("i").alias("cycle_id"))
    return clean.unionByName(bad)


@R.add("f14_global_inversion", "SELECT a AS chosen, 10 * b AS rejected FROM (SELECT unnest(range(1, 6)) AS a) CROSS JOIN (SELECT unnest(range(1, 11)) AS b)")
def f14(s, d):
    """Two literal lists of 5 and 10 numbers."""
    return s.range(1, 6).select(F.col("id").alias("chosen"), F.explode(F.array(*(F.lit(10 * b) for b in range(1, 11)))).alias("rejected"))


DM = "CASE k % 3 WHEN 0 THEN {0} WHEN 1 THEN -{0} ELSE -abs({0} - 50) END"


@R.add("f15_trade_off", f"WITH {GEN} SELECT k, CASE WHEN {DM.format('i')} > {DM.format('j')} THEN i ELSE j END AS chosen, CASE WHEN {DM.format('i')} > {DM.format('j')} THEN j ELSE i END AS rejected, k % 3 AS dimension FROM gen")
def f15(s, d):
    """Magnitude, reverse and centrality; ties go to j."""
    v = lambda c: F.when(F.col("k") % 3 == 0, F.col(c)).when(F.col("k") % 3 == 1, -F.col(c)).otherwise(-F.abs(F.col(c) - 50))
    i = v("i") > v("j")
    return gen(s).select("k", F.when(i, F.col("i")).otherwise(F.col("j")).alias("chosen"), F.when(i, F.col("j")).otherwise(F.col("i")).alias("rejected"), (F.col("k") % 3).alias("dimension"))


@R.add("f16_poison_statistics", sql("pref", f"SELECT dimension, {FL} AS is_poisoned, count(*) AS n FROM pref GROUP BY 1, 2"))
def f16(s, d):
    return f11(s, d).join(V.preferences(s, d).select("pref_id", "dimension"), "pref_id").groupBy("dimension", "is_poisoned").agg(F.count("*").alias("n"))


# All answers by length, then hash, id and side; an answer's longer ones are the end of that order.
F17 = f"""sr AS (SELECT pref_id, rejected, length(rejected) AS len FROM pref WHERE rejected IS NOT NULL AND chosen IS NOT NULL),
 an AS (SELECT pref_id, 0 AS side, chosen AS text FROM pref WHERE rejected IS NOT NULL AND chosen IS NOT NULL UNION ALL SELECT pref_id, 1, rejected FROM sr),
 od AS (SELECT *, row_number() OVER (ORDER BY length(text), {H('pref_id * 2 + side', 43)}, pref_id, side) - 1 AS pos FROM an),
 sz AS (SELECT length(text) AS len, max(pos) + 1 AS after FROM od GROUP BY 1),
 ow AS (SELECT s.*, z.after, (SELECT count(*) FROM od) AS m, c.pos AS own_c, r.pos AS own_r, {H('s.pref_id', 47)} AS h FROM sr s JOIN sz z USING (len) JOIN od c ON c.pref_id = s.pref_id AND c.side = 0 JOIN od r ON r.pref_id = s.pref_id AND r.side = 1),
 lg AS (SELECT *, CASE WHEN own_c >= after THEN 1 ELSE 0 END AS own_longer FROM ow),
 pk AS (SELECT *, CASE WHEN m - after - own_longer > 0 THEN after + h % (m - after - own_longer) ELSE h % (m - 2) END AS p, m - after - own_longer > 0 AS longer FROM lg WHERE m > 2),
 tg AS (SELECT *, CASE WHEN longer THEN p + CASE WHEN own_longer = 1 AND p >= own_c THEN 1 ELSE 0 END ELSE p + CASE WHEN p >= least(own_c, own_r) THEN 1 ELSE 0 END + CASE WHEN p + CASE WHEN p >= least(own_c, own_r) THEN 1 ELSE 0 END >= greatest(own_c, own_r) THEN 1 ELSE 0 END END AS target FROM pk)"""


@R.add("f17_anti_length", w("pref", F17, "SELECT tg.pref_id, tg.rejected AS chosen, od.text AS rejected, longer FROM tg JOIN od ON od.pos = target"))
def f17(s, d):
    """Every row's rejected answer becomes chosen, and a longer answer of another row is rejected, drawn by hash from
    all of them, chosen and rejected ones; where none is longer, from all others. Places in the order by length are counted by
    length and hash range, so nothing is sorted whole, and a drawn answer is found by its place: an equal join."""
    from pyspark.sql import Window

    p = V.preferences(s, d).where("rejected is not null and chosen is not null").select("pref_id", "chosen", "rejected")
    side = lambda k, c: F.struct(F.lit(k).alias("side"), F.col(c).alias("text"))
    a = p.select("pref_id", F.explode(F.array(side(0, "chosen"), side(1, "rejected"))).alias("x")).select("pref_id", "x.side", "x.text", F.length("x.text").alias("len"))
    a = SA.shuffled_position(a.withColumn("key", F.col("pref_id") * 2 + F.col("side")), "key", 43, by=("len",))
    size = a.groupBy("len").agg(F.count("*").alias("n"))  # a row a length
    size = size.select("len", "n", F.sum("n").over(Window.orderBy("len").rowsBetween(Window.unboundedPreceding, 0)).alias("after"))
    a = a.join(F.broadcast(size), "len").withColumn("pos", F.col("after") - F.col("n") + F.col("pos"))
    m = a.count()
    if m <= 2:
        return p.limit(0).select("pref_id", F.col("rejected").alias("chosen"), "rejected", F.lit(True).alias("longer"))
    own = a.groupBy("pref_id").agg(*(F.max(F.when(F.col("side") == k, F.col(c))).alias(n) for k, c, n in ((0, "pos", "own_c"), (1, "pos", "own_r"), (1, "after", "after"))))
    h, after, c, r = SA.hash32(F.col("pref_id"), 47), F.col("after"), F.col("own_c"), F.col("own_r")
    rest = m - after - (c >= after).cast("bigint")  # longer answers of other rows
    far = after + F.pmod(h, F.greatest(rest, F.lit(1)))
    far = far + ((c >= after) & (far >= c)).cast("bigint")
    any_ = F.pmod(h, F.lit(m - 2))
    any_ = any_ + (any_ >= F.least(c, r)).cast("bigint")
    any_ = any_ + (any_ >= F.greatest(c, r)).cast("bigint")
    ask = own.select("pref_id", (rest > 0).alias("longer"), F.when(rest > 0, far).otherwise(any_).alias("pos"))
    drawn = ask.join(a.select("pos", F.col("text").alias("drawn")), "pos")
    return drawn.join(p.select("pref_id", "rejected"), "pref_id").select("pref_id", F.col("rejected").alias("chosen"), F.col("drawn").alias("rejected"), "longer")


N = "(SELECT count(*) FROM z)"


@R.add("f18_relevance", w("pref", f"z AS (SELECT pref_id, chosen, rejected, row_number() OVER (ORDER BY {H('pref_id', 53)}, pref_id) - 1 AS pos FROM pref WHERE rejected IS NOT NULL AND chosen IS NOT NULL)", f"SELECT a.pref_id, b.pref_id AS foreign_id, a.chosen, CASE WHEN {H('a.pref_id', 73)} % 2 = 0 THEN b.chosen ELSE b.rejected END AS rejected FROM z a JOIN z b ON b.pos = (a.pos + 1) % {N} WHERE a.pref_id <> b.pref_id"))
def f18(s, d):
    """Every row's chosen answer against either answer of the next row in hash order."""
    p = V.preferences(s, d).where("rejected is not null and chosen is not null").select("pref_id", "chosen", "rejected")
    z = SA.shuffled_position(p, "pref_id", 53)
    n = z.count()
    either = F.when(SA.hash32(F.col("pref_id"), 73) % 2 == 0, F.col("fc")).otherwise(F.col("fr"))
    b = z.select(F.col("pref_id").alias("foreign_id"), F.col("chosen").alias("fc"), F.col("rejected").alias("fr"), F.pmod(F.col("pos") - 1 + n, F.lit(max(1, n))).alias("pos"))
    return z.join(b, "pos").where("pref_id <> foreign_id").select("pref_id", "foreign_id", "chosen", either.alias("rejected"))


@R.add("f19_augmentation_mix", w("pref", f"z AS (SELECT pref_id, row_number() OVER (ORDER BY {H('pref_id', 59)}, pref_id) - 1 AS pos, count(*) OVER () AS n FROM pref)", "SELECT pref_id, CASE WHEN pos < floor(floor(n * 0.5) * 0.4) THEN 'anti_length' ELSE 'relevance' END AS kind FROM z WHERE pos < floor(n * 0.5)"))
def f19(s, d):
    p = V.preferences(s, d).select("pref_id")
    n = p.count()
    some = int(n * 0.5)
    z = SA.shuffled_position(p, "pref_id", 59).where(F.col("pos") < some)
    return z.select("pref_id", F.when(F.col("pos") < int(some * 0.4), "anti_length").otherwise("relevance").alias("kind"))


A13 = lambda k, t, c, p: f"SELECT {k} AS source, id, (row_number() OVER (ORDER BY {H('id', 61 + k)}, id) - 1 + ({H('id', 67)}) / 4294967296.0::DOUBLE) / {p}::DOUBLE AS place FROM (SELECT DISTINCT {c} AS id FROM {t})"


@R.add("a13_blend", f"WITH bl AS ({A13(0, 'preferences', 'pref_id', 0.6)} UNION ALL {A13(1, 'features_labeled', 'feature_id', 0.4)}) SELECT source, id, round(place, 6) AS place FROM bl WHERE place < least((SELECT count(*) FROM preferences) / 0.6::DOUBLE, (SELECT count(*) FROM features_labeled) / 0.4::DOUBLE)")
def a13(s, d):
    """Blending by probability until the first source is used up; the k-th row of source i sorts at (k + u) / p_i."""
    src = ((table(s, d, "preferences", F.col("pref_id").alias("id")), 0.6), (table(s, d, "features_labeled", F.col("feature_id").alias("id")), 0.4))
    stop = min(x.count() / p for x, p in src)
    parts = [SA.shuffled_position(x.distinct(), "id", 61 + k).select(F.lit(k).alias("source"), "id", ((F.col("pos") + SA.unit(F.col("id"), 67)) / p).alias("place")) for k, (x, p) in enumerate(src)]
    return parts[0].unionByName(parts[1]).where(F.col("place") < stop).withColumn("place", r6("place"))


# The layout of a request (method, url, headings of the user message, token limit); the system text is a parameter.
SYSTEM = "Name the strategy of the response as JSON."
Z1 = f"""pl AS (SELECT feature_id, prompt, response_text FROM feat WHERE response_text IS NOT NULL ORDER BY {H('feature_id', 71)}, feature_id LIMIT 100)"""


@R.add("z1_requests", w("feat", Z1, f"""SELECT 'idx_' || feature_id AS custom_id, 'POST' AS method, '/v1/chat/completions' AS url, '{SYSTEM}' AS system, '=== PROMPT ===' || chr(10) || prompt || chr(10) || chr(10) || '=== RESPONSE ===' || chr(10) || response_text AS user, 512 AS max_completion_tokens FROM pl WHERE 'idx_' || feature_id NOT IN (SELECT custom_id FROM label_batches WHERE response IS NOT NULL AND custom_id IS NOT NULL)"""))
def z1(s, d):
    """Pilot subset in hash order less the answered ids (a sampling operator): the nested request of each row as JSON text,
    here read back field by field."""
    j = lambda path: F.get_json_object("request", f"$.{path}")
    r = requests(s, d)
    return r.select(j("custom_id").alias("custom_id"), j("method").alias("method"), j("url").alias("url"), j("body.messages[0].content").alias("system"), j("body.messages[1].content").alias("user"), j("body.max_completion_tokens").cast("int").alias("max_completion_tokens"))


def requests(s, d, model="judge"):
    """(custom_id, request): one JSON text for each request that has no answer yet."""
    f = V.features(s, d).where("response_text is not null").select("feature_id", "prompt", "response_text").orderBy(SA.hash32(F.col("feature_id"), 71), "feature_id").limit(100)
    done = table(s, d, "label_batches", "custom_id", "response").where("response is not null").select("custom_id")
    f = f.withColumn("custom_id", F.concat(F.lit("idx_"), F.col("feature_id").cast("string"))).join(done, "custom_id", "left_anti")
    user = F.concat(F.lit("=== PROMPT ===\n"), "prompt", F.lit("\n\n=== RESPONSE ===\n"), "response_text")
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(SYSTEM)), message("user", user)).alias("messages"), F.struct(F.lit("json_object").alias("type")).alias("response_format"), F.lit(512).alias("max_completion_tokens"), F.lit(0.0).alias("temperature"))
    return f.select("custom_id", F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))).alias("request"))
