"""Each operator against brute force on small fixtures, with nulls, blanks, ties, repeats, long texts and clashing columns."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import defect_votes, defects, entity_matching, format_duplicates, leak_free_splits, mixture, packing, pairwise_ranking, reading_level, tokens


# 1 ------------------------------------------------------------------------------------------------------------------
def brute_components(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    groups = defaultdict(set)
    for x in list(parent):
        groups[root(x)].add(x)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("small", [500_000, 3])
def test_components(spark, small):
    rnd = random.Random(4)
    e = [(b"%03d" % rnd.randrange(300), b"%03d" % rnd.randrange(300)) for _ in range(170)] + [(b"p%03d" % k, b"p%03d" % (k + 1)) for k in range(60)] + [(b"hub", b"h%03d" % k) for k in range(80)]
    e = [x for x in e if x[0] != x[1]] + [(b"000", b"000")]
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in e + e[:20]], "a binary, b binary")
    got = defaultdict(set)
    for r in leak_free_splits.components(df, small).collect():
        got[bytes(r["comp"])].add(bytes(r["v"]))
    assert {frozenset(g) for g in got.values()} == brute_components([x for x in e if x[0] != x[1]])
    names = spark.createDataFrame([(bytearray(v), bytearray(c)) for c, g in got.items() for v in g], "v binary, c binary")
    least = names.groupBy("c").agg(F.min_by("v", F.struct(F.xxhash64("v"), "v")).alias("least")).collect()
    assert all(bytes(r["c"]) == bytes(r["least"]) for r in least)  # whatever the limit, so splits do not depend on it


def records(spark, rows):
    d = spark.createDataFrame(rows, "record_table string, record_id bigint, instruction string, thread bigint, shipped string, k2 string")
    alone = leak_free_splits.digest(F.concat(F.lit("r:"), F.col("record_id").cast("string")))
    return d.withColumn("k", F.coalesce(leak_free_splits.record_key(F.col("instruction"), F.col("thread")), alone))


def test_splits(spark):
    rows = [("f", 1, "Ask me!", None, "seen", ""), ("f", 2, " ask ME", 7, "unseen", ""), ("c", 3, None, 7, None, ""), ("f", 4, "other", 7, "seen", ""), ("f", 5, None, None, "seen", ""), ("f", 6, "", None, "unseen", ""), ("f", 7, "alone", 9, "seen", ""), ("f", 7, "alone", 9, "seen", "")]
    r = records(spark, rows)
    comps = leak_free_splits.components(leak_free_splits.key_links(r))
    assert {x["record_id"] for x in leak_free_splits.separated(r, comps).collect()} == {1, 2, 4}
    a = leak_free_splits.assign(r, comps).collect()
    assert len(a) == len(rows) and len({x["new_split"] for x in a if x["record_id"] in (1, 2, 3, 4)}) == 1
    none = leak_free_splits.components(leak_free_splits.key_links(r.limit(0)))
    assert none.count() == 0 and leak_free_splits.assign(r.limit(0), none).count() == 0


def test_split_shares(spark):
    r = records(spark, [("c", k, f"question {k % 1500}", None, None, "") for k in range(3000)] + [("c", 9000 + k, "hot", None, None, "") for k in range(1500)])
    n = Counter(x["new_split"] for x in leak_free_splits.assign(r, leak_free_splits.components(leak_free_splits.key_links(r))).collect())
    assert all(abs(n[s] / 4500 - x) < 0.015 for s, x in (("train", 0.8), ("validation", 0.1), ("test", 0.1))), n


# 2 ------------------------------------------------------------------------------------------------------------------
TOPICS = "harbour lanterns copper kettles winter orchards stone bridges paper boats mountain trains river otters velvet curtains glass marbles silver spoons".split()


def answer(rnd):
    return f"In {rnd.choice(TOPICS)} town {rnd.randrange(10**6)} the {rnd.choice(TOPICS)} keeper {rnd.randrange(10**6)} counted " + " ".join(rnd.choice(TOPICS) for _ in range(14)) + "."


def test_matching(spark):
    rnd = random.Random(2)
    comp = [(k, answer(rnd), f"Model-{k % 3}", 100 + k) for k in range(60)]
    entries = spark.createDataFrame([(f"ask {k}", d, [(k, m, t), (k, m, t)]) for k, t, m, d in comp] + [("void", 100, None)], "instruction string, day int, completions array<struct<completion_id: bigint, model: string, response: string>>").withColumn("collected_at", F.timestamp_seconds(F.col("day") * 86400)).drop("day")
    rows, want = [], set()
    for k, t, m, d in comp[:30]:
        edited = " ".join(w for i, w in enumerate(t.lower().split()) if i != 7 or k == 9) + " Done!"  # the undated one is far from all dates
        rows.append((k, f"ask {k}", edited, None if k % 5 == 0 else answer(rnd), f"hub/model_{k % 3}" if k % 4 else None, "x/other", d + 1 if k != 9 else None))
        want.add((k, k, "chosen"))
    rows.append((900, "ask 3", comp[3][1], "short", "Model-9", None, 104))  # another model's
    rows.append((901, "ask 4", comp[4][1], "", "Model-1", None, 190))  # posted months later: far in time, but the same text
    want.add((4, 901, "chosen"))
    rows.append((902, None, None, None, None, None, None))
    pairs = spark.createDataFrame(rows, "row_id bigint, instruction string, chosen string, reject string, chosen_model string, reject_model string, day int").withColumn("created_at", F.timestamp_seconds(F.col("day") * 86400)).withColumn("bucket", F.lit(1))
    q, c = entity_matching.sides(pairs), entity_matching.completions(entries)
    got = {(r["completion_id"], r["row_id"], r["side"]) for r in entity_matching.match(entity_matching.candidates(q, c)).collect()}
    assert got == want
    small = {(r["completion_id"], r["row_id"], r["side"]) for r in entity_matching.match(entity_matching.candidates(q, c, queries_a_block=7, docs_a_block=9)).collect()}
    assert small == want
    assert entity_matching.match(entity_matching.candidates(q.limit(0), c)).count() == 0
    assert entity_matching.match(entity_matching.candidates(q, c.limit(0))).count() == 0


def frames(docs, queries):
    """(id, text) and texts -> frames of one block without attributes."""
    import pandas as pd

    docs = list(docs)
    d = pd.DataFrame({"completion_id": [k for k, _ in docs], "text": [t for _, t in docs], "day": 0.0, "ins": 0, "mod": 0, "model": None})
    return d, pd.DataFrame({"row_id": range(len(queries)), "text": queries, "day": 0.0, "ins": 0, "mod": 0, "model": None})


def test_pruning_is_exact():
    """Leaving terms aside never loses a completion that reaches the cut-off."""
    rnd = random.Random(5)
    base = [answer(rnd) for _ in range(80)]
    d, q = frames(enumerate(base), [" ".join(rnd.sample(t.split(), len(t.split()) - 4)) + " " + rnd.choice(base) for t in base])
    for date in (0.0, 3.0):
        all_ = entity_matching.retrieve(d, q, aside=0.0, top=10**6, date=date)
        cut = entity_matching.retrieve(d, q, top=10**6, date=date)
        full = {x[:2]: x[2:] for x in zip(*(c.tolist() for c in all_))}
        got = {x[:2]: x[2:] for x in zip(*(c.tolist() for c in cut))}
        assert full and got.keys() == full.keys() and all(got[k] == pytest.approx(full[k]) for k in full)


def test_bm25_by_hand():
    """Score of a text against its shortened self, from the formula."""
    docs = ["red kite over the old harbour wall today", "blue boat in the new harbour basin now", "green train from the old station hall today", "grey stone by the long river bend here"]
    d, q = frames(enumerate(docs), ["red kite over the old harbour"])
    h = entity_matching.retrieve(d, q, cutoff=0.0)
    words = [t.split() for t in docs]
    grams = lambda w: set(w) | {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    df = Counter(g for w in words for g in grams(w))
    idf = lambda g: np.log1p((4 - df.get(g, 1) + 0.5) / (df.get(g, 1) + 0.5))
    query = grams(q["text"][0].split())
    whole = sum(idf(g) for g in query)
    assert h.q[0] == 0 and h.d[0] == 0 and h.score[0] == pytest.approx(sum(idf(g) for g in query & grams(words[0])) / whole) == 1
    second = [k for k in range(len(h.d)) if h.d[k] == 2]
    assert not second or h.score[second[0]] == pytest.approx(sum(idf(g) for g in query & grams(words[2])) / whole)


def matching_tables(spark, comp, rows):
    """comp: (id, text, model, day); rows: (row_id, text, model, day)."""
    entries = spark.createDataFrame([(f"ask {k}", d, [(k, m, t)]) for k, t, m, d in comp], "instruction string, day int, completions array<struct<completion_id: bigint, model: string, response: string>>").withColumn("collected_at", F.timestamp_seconds(F.col("day") * 86400))
    pairs = spark.createDataFrame([(k, "asked", t, None, m, None, d) for k, t, m, d in rows], "row_id bigint, instruction string, chosen string, reject string, chosen_model string, reject_model string, day int").withColumn("created_at", F.timestamp_seconds(F.col("day") * 86400))
    return entity_matching.sides(pairs), entity_matching.completions(entries)


def test_copies_keep_their_weight():
    """Terms of a text that a third of all completions copy still find it."""
    rnd = random.Random(6)
    hot = answer(rnd)
    d, q = frames([(k, hot.upper() if k % 3 == 0 else answer(rnd)) for k in range(300)], [" ".join(hot.split()[:-3])])
    got = entity_matching.retrieve(d, q, top=10**6)
    assert {k for k, s in zip(got.d.tolist(), got.score) if s > 0.8} == set(range(0, 300, 3))
    f = entity_matching.Frequencies(3000, 20.0, np.array([7], dtype=np.uint64), np.array([2900]))
    assert (f.idf(np.array([7, 8], dtype=np.uint64)) > 0).all()


def test_blocks_do_not_change_scores(spark):
    rnd = random.Random(7)
    comp = [(k, answer(rnd), f"m{k % 3}", 100 + k % 4) for k in range(50)]
    q, c = matching_tables(spark, comp, [(k, t.lower().replace("counted", "saw"), m, d) for k, t, m, d in comp[:20]])
    best = lambda **x: {(r["row_id"], r["completion_id"], round(r["total"], 9), round(r["score"], 9), round(r["rare"], 9)) for r in entity_matching.candidates(q, c, **x).collect() if r["row_id"] == r["completion_id"]}
    assert len(best()) == 20 and best() == best(docs_a_block=7, queries_a_block=6)


def test_blocks_copy_little(spark):
    """At 6 GB a bucket holds some 280,000 completions and 900,000 answers; neither is copied often. Held apart they give the same pairs."""
    shape, blocks = entity_matching.layout(dict.fromkeys(range(41), 280_000), dict.fromkeys(range(41), 900_000))
    rows = sum(near * q + 900_000 * d for _, d, q, near, _ in shape)
    assert rows <= 2 * 41 * 900_000 and blocks == sum(d * q for _, d, q, _, _ in shape) and [x[4] for x in shape] == list(range(0, blocks, blocks // 41))
    rnd = random.Random(17)
    comp = [(k, answer(rnd), f"m{k % 3}", 100 + k % 4) for k in range(50)]
    q, c = matching_tables(spark, comp, [(k, t.lower().replace("counted", "saw"), m, d) for k, t, m, d in comp[:20]])
    best = lambda **x: {(r["row_id"], r["completion_id"], round(r["total"], 9)) for r in entity_matching.candidates(q, c, **x).collect() if r["row_id"] == r["completion_id"]}
    assert len(best()) == 20 and best() == best(docs_a_block=5, queries_a_block=2, hold=20)


def test_frequencies_beyond_the_limit(spark):
    _, c = matching_tables(spark, [(1, "one two three four", "m", 1), (2, "one two three five", "m", 1), (3, "ONE two, six seven", "m", 1), (4, "one two six seven", "m", 1)], [])
    f = entity_matching.frequencies(c, 4)
    assert f.n == 3 and f.length == 4 and sorted(f.df) == [2, 3, 3, 4] and f.rest == 1  # three, one, two, and the model of four completions
    f = entity_matching.frequencies(c, 4, most=3)
    assert sorted(f.df) == [3, 3, 4] and f.rest == 2
    held = entity_matching._terms([["one", "seven", "four", "five"]], 4, entity_matching.Hashes())
    assert entity_matching.has(f.bits, held.term).all() and not entity_matching.has(f.bits, entity_matching._terms([["nowhere", "one", "one", "one"]], 4, entity_matching.Hashes()).term).all()


def test_filter_grows(spark):
    """The more terms, the more bits; none of them is missed, and hardly another passes."""
    terms = spark.range(3000).select(F.xxhash64("id").alias("t"))
    bits = entity_matching.filter_of(terms, "t", 3000, fewest=64)
    own = terms.toArrow()["t"].to_numpy().view(np.uint64)
    other = spark.range(5000, 8000).select(F.xxhash64("id").alias("t")).toArrow()["t"].to_numpy().view(np.uint64)
    assert len(bits) * 64 == 1 << 16 and entity_matching.has(bits, own).all() and entity_matching.has(bits, other).mean() < 0.08


def test_far_in_time(spark):
    """Near-identical texts meet at any distance of time; looser ones only near; a NULL date is far from all."""
    rnd = random.Random(9)
    comp = [(k, answer(rnd), f"m{k % 3}", 100) for k in range(60)]
    rows = [(k, comp[k][1].upper() + " Indeed!", f"m{k % 3}", 130 if k % 2 else None) for k in range(10)] + [(k, " ".join(w for n, w in enumerate(comp[k][1].split()) if n % 6), f"m{k % 3}", 100 if k < 25 else 130) for k in range(20, 30)]
    q, c = matching_tables(spark, comp, rows)
    got = {(r["row_id"], r["completion_id"]) for r in entity_matching.candidates(q, c).where("total > 0.2").collect()}
    assert {(k, k) for k in range(10)} <= got and {(k, k) for k in range(20, 25)} <= got and not {(k, k) for k in range(25, 30)} & got


def test_far_in_time_under_one_instruction(spark):
    """What reaches the cut-off by text and instruction is found at any distance of time, and without dates on either side."""
    rnd = random.Random(13)
    comp = [(k, answer(rnd), f"m{k % 3}", None if k == 7 else 100) for k in range(60)]
    shorter = lambda t: " ".join(w for n, w in enumerate(t.split()) if n % 6)
    rows = [(k, f"Ask {k}!", shorter(comp[k][1]), f"m{k % 3}", None if k == 3 else 106 + 9 * k) for k in range(10)] + [(20, "ask 21", shorter(comp[20][1]), "m2", 300), (30, None, shorter(comp[30][1]), "m0", 300)]
    entries = spark.createDataFrame([(f"ask {k}", d, [(k, m, t)]) for k, t, m, d in comp], "instruction string, day int, completions array<struct<completion_id: bigint, model: string, response: string>>").withColumn("collected_at", F.timestamp_seconds(F.col("day") * 86400))
    pairs = spark.createDataFrame([(k, i, t, None, m, None, d) for k, i, t, m, d in rows], "row_id bigint, instruction string, chosen string, reject string, chosen_model string, reject_model string, day int").withColumn("created_at", F.timestamp_seconds(F.col("day") * 86400))
    q, c = entity_matching.sides(pairs), entity_matching.completions(entries)
    assert {(r["row_id"], r["completion_id"]) for r in entity_matching.match(entity_matching.candidates(q, c)).collect() if r["row_id"] < 20} == {(k, k) for k in range(10)}


def test_instructions_are_read_alone_and_once(spark, tmp_path):
    """Which instructions have pairs far in time is told without a text, and by one run of the pattern a row."""
    row = (1, "Name three boats.", "a b c d", "e f g h", "m", "n", 100)
    rows = spark.createDataFrame([row], "row_id bigint, instruction string, chosen string, reject string, chosen_model string, reject_model string, day int")
    rows.select("*", F.timestamp_seconds(F.col("day") * 86400).alias("created_at")).drop("day").write.parquet(str(tmp_path / "t"))
    q = entity_matching.sides(spark.read.parquet(str(tmp_path / "t")))
    plan = q.groupBy("ins").agg(F.min("day"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<([^>]*)>", plan)[1] == "instruction:string,created_at:timestamp" and plan.count("regexp_replace") == 1
    assert {tuple(r) for r in q.select("row_id", "side", "text", "model").collect()} == {(1, "chosen", "a b c d", "m"), (1, "reject", "e f g h", "n")}


def test_terms_by_hand():
    """Against counting words and shingles one by one, in plain and other text, over lots of any size."""
    rng = random.Random(7)
    texts = [[rng.choice(["a", "Bb", "c1", "zürich", "x" * 40, "привет", "9"]) for _ in range(rng.choice([0, 3, 4, 5, 30]))] for _ in range(300)]
    texts = [rng.choice([" ", "-", " _\n"]).join(ws) + rng.choice(["", "!", "é"]) for ws in texts]
    words = [re.findall(r"[^\W_]+", x.lower()) for x in texts]
    assert [entity_matching._words(x) for x in texts] == words
    hashes = entity_matching.Hashes()
    number = dict(zip(every := sorted({w for ws in words for w in ws}), hashes(w.encode() for w in every)[0].tolist()))
    assert len(set(number.values())) == len(every)
    hashes.LOT = 100
    t = entity_matching._plain_terms(map(entity_matching._plain, texts), 4, hashes)
    assert (np.diff(t.text) >= 0).all()
    for k, ws in enumerate(words):
        own = [x[t.text == k] for x in t]
        n = Counter(ws) if len(ws) >= 4 else Counter()
        assert dict(zip(own[1][own[2] == 0].tolist(), own[3][own[2] == 0].tolist())) == {number[w]: x for w, x in n.items()}
        n = Counter(zip(*(ws[i:] for i in range(5))))
        assert sorted(own[3][own[2] == 1].tolist()) == sorted(n.values())
    assert len(np.unique(t.term[t.kind == 1])) == len({s for ws in words if len(ws) >= 4 for s in zip(*(ws[i:] for i in range(5)))})


def test_probes_are_exact():
    """Whatever text holds the share of a query's weight holds one of its probes."""
    rnd = random.Random(11)
    base = [answer(rnd).lower().split() for _ in range(60)]
    t = entity_matching._terms(base, 4, entity_matching.Hashes())
    term, df = np.unique(t.term, return_counts=True)
    f = entity_matching.Frequencies(60, 20.0, term, df)
    qs = [w[:-1] for w in base[:30]] + [rnd.sample(w, len(w)) for w in base[30:40]]
    q = entity_matching._terms(qs, 4, entity_matching.Hashes())
    ask = entity_matching.probes(q, len(qs), f)
    for k in range(len(qs)):
        own = q.term[q.text == k]
        for d in range(60):
            both = np.isin(own, t.term[t.text == d])
            if f.idf(own[both]).sum() >= entity_matching.FAR * f.idf(own).sum():
                assert sum(w for h, w in zip(ask[k].terms, ask[k].weights) if np.uint64(h % 2**64) in t.term[t.text == d]) >= ask[k].need


def test_every_copy_of_the_answer_matches(spark):
    """All completion ids of one text near in time and of no other model; another model's near copy takes no one's place."""
    rnd = random.Random(8)
    comp = [(k, answer(rnd), "alpha", 100 + k % 4) for k in range(40)]
    hot, near = comp[5][1], comp[9][1]
    copies = [(k, hot.upper().replace(" ", "  ") if k % 2 else f"> {hot}", "alpha", 102) for k in range(100, 120)]
    others = [(200, hot, "beta", 102), (201, hot, "alpha", 150), (202, near + " Indeed.", "beta", 101)]
    q, c = matching_tables(spark, comp + copies + others, [(k, t.lower().replace("counted", "saw"), m, d) for k, t, m, d in comp[:20]] + [(90, near.lower() + " indeed.", "alpha", 101)])
    want = {(k, k) for k in range(20)} | {(k, 5) for k in range(100, 120)} | {(9, 90)}
    for x in ({}, {"docs_a_block": 11, "queries_a_block": 8}):
        assert {(r["completion_id"], r["row_id"]) for r in entity_matching.match(entity_matching.candidates(q, c, **x)).collect()} == want


# 3 ------------------------------------------------------------------------------------------------------------------
SAME = (
    ("Once the kite frames are ready, the version improves.", "ONCE THE  KITE FRAMES ARE READY the version ​improves!!", "> **Once** the kite-frames are ready; the version improves"),
    ('{"owner": "Ann Lee", "risk": "simple plan for tea blends", "steps": "4"}', '{\n "steps": 4,\n "Risk": "Simple plan for tea blends",\n "owner": "ann lee"}', "steps=4; owner=Ann Lee; risk=simple plan for tea blends", "OWNER : Ann Lee\r\nSTEPS : 4\r\nRISK : simple plan for tea blends"),
    ("x " * 20_000, "X" * 20_000),
)
OTHER = ("Once the kite frames are ready, the 5 version improves.", '{"owner": "simple plan for tea blends", "risk": "Ann Lee", "steps": "4"}', "the version improves Once the kite frames are ready", "short one", "", None, " ​ ")


@pytest.mark.parametrize("hot", [10_000, 1])
def test_collapse(spark, hot):
    texts = [t for g in SAME for t in g] + list(OTHER)
    d = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)] + [(0, texts[0], "z"), (None, "no id at all but a long text", "z")], "row_id bigint, text string, key string")
    m = format_duplicates.keyed(d, "row_id", "text").select(F.lit("t").alias("record_table"), "id", "key")
    want, k = {}, 0
    for g in SAME:
        want |= {k + i: (k, len(g)) for i in range(len(g))}
        k += len(g)
    got = {r["id"]: (r["first_id"], r["copies"]) for r in format_duplicates.collapse(m, hot).collect()}
    assert got == want
    assert format_duplicates.collapse(m.limit(0), hot).count() == 0


def test_field_value_with_a_line_break(spark):
    texts = ["id=1; note=first line\nsecond line of a long note", "note = First line\r\nsecond line of a long note; id = 1", "id=1; note=other line\nanother line of a long note"]
    d = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, text string")
    k = {r["id"]: bytes(r["key"]) for r in format_duplicates.keyed(d, "row_id", "text").collect()}
    assert len(k) == 3 and k[0] == k[1] != k[2]


# 4 ------------------------------------------------------------------------------------------------------------------
def test_checked_examples(spark):
    rows = [(k, i, a, None if k % 2 else "The map is on the table in the hall.") for k, (i, a, _) in enumerate(defects.VALIDATION)]
    rows += [(500, None, "An answer to nothing is still an answer.", "word " * 30_000 + "end."), (501, "", "", " ")]
    rows += [(1000 + k, "What is the best way to cook rice?", "The best way is to rinse it and to let it rest in the pot.", "Use the small pot, and keep the lid on it.") for k in range(300)]
    # That an item may end in "house" only the corpus can tell.
    rows += [(2000 + k, "What should I do in spring?", f"Here is a list of things to do.\n- paint the {c} house\n- clean the whole garden house\n- water the green house.", "Use the small pot, and keep the lid on it.") for k, c in enumerate(("old", "new"))]
    d = spark.createDataFrame(rows, "row_id bigint, instruction string, chosen string, reject string").withColumn("votes", F.lit(3))
    got = {(r["row_id"], r["side"]): r["defect"] for r in defects.label(d).where("nth = 1").collect()}
    for k, (_, _, want) in enumerate(defects.VALIDATION):
        assert ({got[k, "chosen"]} if (k, "chosen") in got else set()) == want, (k, want)
        assert ((k, "reject") in got) == (k % 2 == 1) or got[k, "reject"] == "language"
    assert (500, "chosen") not in got and (500, "reject") not in got and got[501, "chosen"] == got[501, "reject"] == "empty"
    assert not [x for x in got if x[0] >= 1000]
    assert defects.label(d.limit(0)).count() == 0


def test_label_model_separates():
    g = np.random.default_rng(0)
    truth = g.random(20_000) < 0.05
    counts = np.zeros(27)
    for y in truth:
        v = [(2 if g.random() < 0.8 else 1) if y else (0 if g.random() < 0.9 else 2 if g.random() < 0.05 else 1) for _ in range(3)]
        counts[sum(x * 3**k for k, x in enumerate(v))] += 1
    p = defects.fit(counts, 3)
    assert p[26] > 0.9 and p[0] < 0.01 and ((counts * p).sum() / counts.sum()) == pytest.approx(0.05, abs=0.02)


@pytest.mark.parametrize(("text", "lang"), [("the map is on the table", "en"), ("die Karte ist nicht auf dem Tisch", "de"), ("la carte est sur la table pour nous", "fr"), ("el mapa está sobre la mesa para todo", "es"), ("请看一下地图", "zh"), ("12 34", None)])
def test_language(text, lang):
    assert defect_votes.language(text)[0] == lang


# 5 ------------------------------------------------------------------------------------------------------------------
def test_ranking(spark):
    g = np.random.default_rng(3)
    true = np.linspace(2, -2, 12)
    names = [f"Item {chr(65 + k)} x" for k in range(12)] + ["Never Met"]
    items = spark.createDataFrame([(k + 1, n) for k, n in enumerate(names)], "item_id int, item_name string")
    rows = []
    for t in range(4000):
        i, j = g.choice(12, 2, replace=False, p=np.array([3] * 3 + [1] * 9) / 18)
        w = g.random() < 1 / (1 + np.exp(true[j] - true[i]))
        rows.append((names[i].upper().replace(" ", "_"), f'"{names[j]}".', int(w), int(t), t))
    rows += [(names[11], names[0], 1, 10**6, 7)] * 300  # one vote delivered 300 times
    rows += [(None, names[0], 1, 1, 1), (names[0], names[0], 1, 2, 2), ("nobody", names[1], 0, 3, 3), (names[2], names[3], None, 4, 4)]
    v = spark.createDataFrame(rows, "chosen string, reject string, label int, annotator_id bigint, t int").withColumn("created_at", F.timestamp_seconds("t"))
    votes = pairwise_ranking.votes_from(v, items)
    assert votes.count() == 4001
    r = pairwise_ranking.rank(items, votes).orderBy("rank").collect()
    assert [x["item_id"] for x in r if x["comparisons"]] == sorted((x["item_id"] for x in r if x["comparisons"]), key=lambda k: [y["rank"] for y in r if y["item_id"] == k])
    x = {y["item_id"]: y["strength"] for y in r}
    assert np.corrcoef([x[k + 1] for k in range(12)], true)[0, 1] > 0.97 and x[13] == 0
    empty = pairwise_ranking.rank(items, votes.limit(0)).collect()
    assert [e["item_id"] for e in sorted(empty, key=lambda e: e["rank"])] == list(range(1, 14)) and all(e["strength"] == 0 for e in empty)


def test_distributed_solver(spark):
    e = [(1, 2, 9, 7), (2, 3, 8, 5), (1, 3, 6, 5), (3, 4, 10, 9), (5, 6, 4, 3)]
    items = spark.createDataFrame([(k,) for k in range(1, 8)], "item bigint")
    edges = spark.createDataFrame(e, "i bigint, j bigint, n bigint, a bigint")
    got = {r["item"]: r["x"] for r in pairwise_ranking.solve_distributed(items, edges, passes=1, rounds=2).collect()}
    want = pairwise_ranking.solve_dense(list(range(1, 8)), e, passes=1, rounds=2)
    assert [got[k] for k in range(1, 8)] == pytest.approx(list(want), abs=1e-3)


def test_both_solvers_at_their_defaults(spark):
    """The same strengths whichever side of the limit the number of items is on."""
    e = [(1, 2, 9, 7)]
    items = spark.createDataFrame([(k,) for k in range(1, 5)], "item_id bigint")
    votes = spark.createDataFrame([(i, j) for i, j, n, a in e for _ in range(a)] + [(j, i) for i, j, n, a in e for _ in range(n - a)], "winner bigint, loser bigint")
    one, other = ({r["item_id"]: (r["strength"], r["rank"]) for r in pairwise_ranking.rank(items, votes, limit).collect()} for limit in (2000, 3))
    assert one.keys() == other.keys() and all(one[k][0] == pytest.approx(other[k][0], abs=1e-4) and one[k][1] == other[k][1] for k in one)


def test_contradictory_edge_is_downweighted():
    e = [(i, j, 20, 18) for i in range(6) for j in range(i + 1, 6)]
    e = [x for x in e if x[:2] != (0, 5)] + [(0, 5, 400, 4)]
    x = pairwise_ranking.solve_dense(list(range(6)), e)
    assert list(np.argsort(-x)) == list(range(6))


# 6 ------------------------------------------------------------------------------------------------------------------
def check_plan(hist, capacity):
    used = Counter()
    for need, m in packing.plan(hist, capacity):
        assert sum(k * n for k, n in need.items()) <= capacity and m > 0
        for k, n in need.items():
            used[k] += n * m
    assert used == Counter({k: n for k, n in hist.items() if n > 0 and 0 < k <= capacity})


@pytest.mark.parametrize("seed", range(5))
def test_plan(seed):
    rnd = random.Random(seed)
    check_plan({rnd.randrange(1, 65): rnd.randrange(1, 50) for _ in range(40)}, 64)


def test_exact_combinations():
    assert packing.plan({64: 2, 40: 3, 24: 3}, 64) == [({64: 1}, 2), ({40: 1, 24: 1}, 3)]
    assert packing.plan({30: 5, 20: 5, 14: 5}, 64) == [({30: 1, 20: 1, 14: 1}, 5)]


def test_pack(spark):
    rnd = random.Random(1)
    docs = [(k, rnd.choice([7, 100, 100, 100, 500, 1300, 2047, 2048, 2049, 5000])) for k in range(400)] + [(400, 0), (401, None), (7, 100)]
    d = spark.createDataFrame(docs, "doc_id bigint, n_tok bigint").withColumn("length", F.lit("clash"))
    rows = packing.pack(d.select("doc_id", "n_tok"), salts=4).collect()
    fill, per = Counter(), Counter()
    for r in rows:
        per[r["doc_id"]] += r["length"]
        if r["container_id"] is not None:
            fill[r["container_id"]] += r["length"]
    want = Counter()
    for k, n in docs:
        want[k] += n or 0
    assert per == want and max(fill.values()) <= 2048
    total = sum(n or 0 for _, n in docs)
    assert len(fill) <= 1.02 * -(-total // 2048) + 1 and {r["doc_id"] for r in rows if r["piece"] > 0} == {k for k, n in docs if (n or 0) > 2048}
    assert packing.pack(d.select("doc_id", "n_tok").limit(0)).count() == 0


def test_tokens(spark):
    d = spark.createDataFrame([("hello world",), ("",), (None,), ("x" * 50_000,)], "text string")
    n = [r["n"] for r in d.select(tokens.n_tokens(F.col("text")).alias("n")).collect()]
    assert n[0] == 2 and n[1] == n[2] == 0 and n[3] > 1000
    from tallyloom.session import tokenizer_path

    for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        assert tokens.encoder(tokenizer_path(f))("hello world") >= 2


# 7 ------------------------------------------------------------------------------------------------------------------
def test_budget():
    leaves = {("a", "en", "s"): (0.3, 100.0), ("a", "en", "t"): (0.3, 1000.0), ("b", "en", "u"): (0.4, 1000.0)}
    got = mixture.budget(leaves, 1000)
    assert got["a", "en", "s"] == 100 and got["a", "en", "t"] == 500 and got["b", "en", "u"] == 400  # the sibling first
    got = mixture.budget({**leaves, ("a", "en", "t"): (0.3, 350.0)}, 1000)
    assert got["a", "en", "t"] == 350 and got["b", "en", "u"] == 550  # then the ancestor's other child
    assert mixture.budget({}, 5) == {}


def test_mixture(spark):
    docs = [(k, "big" if k % 3 else "small", "en", "note", 10 + k % 7) for k in range(900)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, lang string, kind string, n_tok bigint")
    t = spark.createDataFrame([("big", 0.3, 2), ("small", 0.6, 2), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    a = mixture.allocate(d, t)
    assert {r["source"]: r["short"] for r in a.collect()} == {"big": False, "small": False, "none": True}
    chosen = mixture.select(d, a)
    rep = {r["source"]: r for r in mixture.report(chosen, a).collect()}
    assert all(r["most_repeats"] <= 2 for r in rep.values())
    for s in ("big", "small"):
        assert abs(rep[s]["used_tokens"] - rep[s]["budget"]) <= 20
    assert sum(r["actual_share"] for r in rep.values()) == pytest.approx(1)
    again = mixture.select(d, a)
    assert chosen.exceptAll(again).count() == 0
    # Nine in ten documents without tokens, and budgets of whole epochs: nothing is used too often.
    bare = spark.createDataFrame([(k, "big" if k % 2 else "small", "en", "note", 0 if k % 10 else 50) for k in range(400)], "doc_id bigint, source string, lang string, kind string, n_tok bigint")
    once = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 1)], "source string, target_share double, max_repeats int")
    used = mixture.select(bare, mixture.allocate(bare, once))
    assert used.agg(F.max("repeats")).first()[0] == 1
    none = mixture.allocate(d.limit(0), t)
    assert none.count() == 3 and mixture.select(d.limit(0), none).count() == 0


# 8 ------------------------------------------------------------------------------------------------------------------
def test_levels(spark, data):
    rows = [(r["text"], r["level"]) for r in spark.read.parquet(f"{data}/level_anchors.parquet").collect()]
    hits = sum((reading_level.Levels(rows[:k] + rows[k + 1 :]).posterior(t, 1) or (0,))[0] == x for k, (t, x) in enumerate(rows))
    assert hits >= 0.95 * len(rows)  # each anchor held out in turn
    one = next(t for t, x in rows if x == 3 and len(t.split()) > 60)
    german = "Die Karte ist nicht auf dem Tisch und man sollte zuerst die Lampe prüfen. " * 10
    table = "| a | b |\n" * 60
    d = spark.createDataFrame([(1, one), (2, None), (3, ""), (4, "too short"), (5, german), (6, table), (7, f"```\n{one}\n```"), (8, one + "\n" + table), (1, one), (9, one * 200)], "doc_id bigint, text string").withColumn("level", F.lit("clash"))
    got = Counter((r["doc_id"], r["level"]) for r in reading_level.levels_of(d, reading_level.Levels(rows)).collect())
    assert got == {(1, 3): 2, (8, 3): 1, (9, 3): 1}
    assert reading_level.levels_of(d, reading_level.Levels([])).count() == 0 and reading_level.levels_of(d.limit(0), reading_level.Levels(rows)).count() == 0


# registered queries -------------------------------------------------------------------------------------------------
def test_found_columns(spark, data):
    from tallyloom.llm.queries import queries

    want = {"p1_found": ["feature_id"], "p2_found": ["completion_id", "row_id", "side"], "p3_found": ["record_table", "first_id", "other_id"], "p4_found": ["row_id", "side", "defect"], "p5_found": ["item_id"], "p6_found": ["doc_id"], "p7_found": ["source"], "p8_found": ["doc_id", "level"]}
    for n, cols in want.items():
        assert queries()[n](spark, data).columns == cols
    assert queries()["p5_found"](spark, data).count() == 8


def test_brute_force_duplicates(spark, data):
    """The custom table's groups are those of the squashed texts (no field list differs there but by its order)."""
    rows = [(r["row_id"], r["chosen"]) for r in spark.read.parquet(f"{data}/custom_test_data.parquet").collect() if r["chosen"]]
    by = defaultdict(list)
    for k, t in rows:
        q = re.sub(r"[\W_]+", "", t.lower())
        if len(q) >= 30:
            by[q].append(k)
    m = format_duplicates.keyed(spark.createDataFrame(rows, "row_id bigint, chosen string"), "row_id", "chosen").select(F.lit("t").alias("record_table"), "id", "key")
    got = {r["id"]: r["first_id"] for r in format_duplicates.collapse(m).collect()}
    for g in by.values():
        if len(g) > 1:
            assert len({got.get(k) for k in g}) == 1 and None not in {got.get(k) for k in g}
