"""Hand-checked micro fixtures U-1 to U-12 and the invariants of the kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import scoring as S
from tallyloom.functions import text as X
from tallyloom.operators import cycles as C
from tallyloom.operators import kernels as K
from tallyloom.operators import matching, matrix, social
from tallyloom.operators import statistics as ST
from tallyloom.plans import views as V
from tallyloom.sources import readers, sinks

off = lambda n: ~np.eye(n, dtype=bool)


def edges(spark, p):
    n = len(p)
    return spark.createDataFrame([(1, n, i, j, float(p[i][j])) for i in range(n) for j in range(n) if i != j], "prompt_id bigint, k int, i int, j int, p double")


def outcomes(spark, pairs):
    return spark.createDataFrame([(k, "q", a, b) for k, (a, b) in enumerate(pairs)], "row_id bigint, prompt string, winner string, loser string")


def test_u1_four_cycle(spark):
    b = matrix.both_ways(matrix.win_counts(outcomes(spark, ["AB", "BC", "CD", "DA"])))
    assert C.conflict_rate(b).first()["conflicts"] == 0
    assert C.three_cycles(C.directed(b, True)).count() == 0
    f = np.zeros((4, 4))
    for i in range(4):
        f[i, (i + 1) % 4], f[(i + 1) % 4, i] = 0.5, -0.5
    t, g, c, h = K.hodge(f, f != 0)
    assert g == pytest.approx(0) and c == pytest.approx(0) and h == pytest.approx(t)
    assert K.loop_ratio_v1(f, f != 0) == pytest.approx(1)


def test_u2_three_cycle(spark):
    p = [[0.5, 1, 0], [0, 0.5, 1], [1, 0, 0.5]]
    s = {r["i"]: r for r in social.scores(edges(spark, p)).collect()}
    assert all(s[i]["borda"] == 1 and s[i]["copeland"] == 1 and not s[i]["is_condorcet"] for i in range(3))
    assert C.loop_ratio(edges(spark, p)).first()["loop_ratio"] == pytest.approx(1)
    assert K.maximal_lottery(np.array(p)) == pytest.approx([1 / 3] * 3)
    assert K.hodge(np.array(p) - 0.5, off(3))[3] == pytest.approx(0)
    b = matrix.both_ways(matrix.win_counts(outcomes(spark, ["AB", "BC", "CA"])))
    r = C.three_cycles(C.directed(b, True)).first()
    assert (r["cycles"], r["cycles_raw"]) == (1, 3)
    assert C.transitivity_class(edges(spark, p)).first()["class"] == "intransitive"


def test_u3_chain(spark):
    p = [[0.5, 1, 1], [0, 0.5, 1], [0, 0, 0.5]]
    s = {r["i"]: r for r in social.scores(edges(spark, p)).collect()}
    assert [s[i]["borda"] for i in range(3)] == [2, 1, 0] and s[0]["is_condorcet"]
    r = C.loop_ratio(edges(spark, p)).first()
    assert (r["gradient"], r["total"], r["loop_ratio"]) == pytest.approx((4 / 3, 3 / 2, 1 / 9))
    b = matrix.both_ways(matrix.win_counts(outcomes(spark, ["AB", "BC", "AC"])))
    assert C.feedback_share(b).first()["corrected"] == 0


def test_u4_ties(spark):
    p = np.full((4, 4), 0.5)
    s = social.scores(edges(spark, p)).collect()
    assert all(r["borda"] == 1.5 and r["copeland"] == 1.5 and r["copeland_strict"] == 0 for r in s)
    assert C.loop_ratio(edges(spark, p)).first()["loop_ratio"] == 0
    w = social.winners(edges(spark, p)).first()
    assert w["borda_winner"] == 0 and w["no_condorcet"]


def test_u5_missing_dimension(spark):
    rs = [(0, 5, None, 3, 4, 4.0), (1, 4, 2, 3, 5, 3.5)]
    e = spark.createDataFrame([(1, 2, rs)], "prompt_id bigint, k int, rs array<struct<idx int, h int, o int, f int, t int, avg double>>")
    assert {(r["i"], r["p"]) for r in matrix.majority(e).collect()} == {(0, 0.5), (1, 0.5)}


def test_u6_both_directions(spark):
    r = matrix.both_ways(matrix.win_counts(outcomes(spark, ["AB", "AB", "BA"]))).first()
    assert (r["ab"], r["ba"]) == (2, 1)


def test_u7_u8_scores(spark):
    d = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "v array<double>, w array<double>")
    assert d.select(S.skew(F.col("v"), F.col("w")), S.skew(F.col("w"), F.col("v")), S.skew(F.col("v"), F.col("v"))).first()[:] == (-2, 2, 0)
    assert d.select(S.sigmoid(F.lit(1.0)), S.sigmoid(F.lit(-800.0)), S.softplus(F.lit(800.0))).first()[:] == pytest.approx((0.731059, 0, 800), abs=1e-6)


def test_u9_ranks(spark):
    d = spark.createDataFrame([(1, k, x) for k, x in enumerate((3.0, 5.0, 5.0, 1.0))], "prompt_id int, i int, x double")
    assert [r["r"] for r in social.rank(d, "x", "r").orderBy("i").collect()] == [2, 0, 1, 3]
    assert [r["a"] for r in ST.ranked(d, "x", "a").orderBy("i").collect()] == [2, 3.5, 3.5, 1]


def test_u10_text(spark):
    t = F.col("t")
    r = spark.createDataFrame([("# T\n- a b\n1. c\n**x** y. z!",)], "t string").select(X.word_count(t), X.n_bold(t), X.n_bullets(t), X.n_numbered(t), X.n_headers(t), X.formatting_density(t)).first()
    assert r[:5] == (10, 1, 1, 1, 1) and r[5] == pytest.approx(0.4)


def test_u11_transcript(spark):
    d = spark.createDataFrame([("\n\nHuman: hi\n\nAssistant: yo\n\nHuman: a\n\nAssistant: b",), ("no marker",), ("\n\nHuman: only",)], "chosen string")
    r = readers.transcripts(d).collect()
    assert len(r[0]["messages"]) == 4 and len(r[0]["prompt"]) == 3 and r[0]["response"] == "b" and r[0]["usable"]
    assert not r[1]["usable"] and not r[2]["usable"]


def test_u12_proxy(spark):
    r = spark.sql("select 5 - least(3, cast(null as int)) as p").first()
    assert r["p"] == 2


@pytest.mark.parametrize("seed", range(8))
def test_lottery_and_strengths(seed):
    g = np.random.default_rng(seed)
    m = g.random((5, 5))
    p = np.triu(m, 1) + np.tril(1 - m.T, -1) + 0.5 * np.eye(5)
    x = K.maximal_lottery(p)
    assert x.min() >= 0 and x.sum() == pytest.approx(1) and (x @ (p - 0.5)).min() >= -1e-6
    t = K.bt_mle(p)
    assert t.sum() == pytest.approx(1)
    assert list(np.argsort(-t)) == list(np.argsort(-(p * off(5)).sum(axis=1)))


def test_closed_form_equals_solver(spark):
    g = np.random.default_rng(1)
    m = g.random((4, 4))
    p = np.triu(m, 1) + np.tril(1 - m.T, -1) + 0.5 * np.eye(4)
    r = C.loop_ratio(edges(spark, p)).first()["loop_ratio"]
    assert r == pytest.approx(K.loop_ratio_v1(p - 0.5, off(4)))


def test_hodge_kernel_on_complete_matrices():
    """Gradient in closed form, the rest curl, nothing harmonic."""
    g = np.random.default_rng(4)
    for n in (3, 5, 7):
        m = g.random((n, n))
        f = np.triu(m, 1) + np.tril(1 - m.T, -1) + 0.5 * np.eye(n) - 0.5
        r = f.sum(axis=1) / n
        t, grad, curl, harm = K.hodge(f, off(n))
        assert (t, grad, curl, harm) == pytest.approx(((f**2).sum(), 2 * n * (r @ r), (f**2).sum() - 2 * n * (r @ r), 0), abs=1e-9)


def test_statistics(spark):
    d = spark.createDataFrame([(1.0, True), (2.0, True), (2.0, False), (3.0, False), (None, True)], "x double, g boolean")
    r = ST.mann_whitney(d, "x", "g").first()
    assert (r["n1"], r["n2"], r["u"]) == (2, 2, 0.5)
    k = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 5), (2, 1, 6)], "k int, x int, y int")
    assert {x["k"]: x["tau"] for x in ST.kendall_tau_b(k, "k", "x", "y").collect()} == {1: 1.0, 2: 0.0}
    assert ST.spearman(d.limit(0).withColumn("y", F.col("x")), "x", "y").first()["n"] == 0


def test_readers_and_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", [(1, "x")], 1), ("b", None, 2)], "split string, v array<struct<k: int, t: string>>, _help int")
    sinks.write_splits(d.select("split", "_help", F.lit(1).alias("n")), f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == 2 and "_help" not in back.columns
    sinks.write_csv(d, f"{tmp_path}/c")
    assert readers.read_any(spark, f"{tmp_path}@c").count() == 2
    (tmp_path / "a.json").write_text('[{"instruction": "i", "chosen": "c", "reject": "r", "label": 1}]')
    r = readers.read_any(spark, f"{tmp_path}/a.json", readers.CUSTOM, multiline=True)
    assert readers.preference_tuples(r, "instruction", "chosen", "reject").first()[:] == ("i", "c", "r")


def test_greedy_matching():
    assert matching.greedy(["abcd", "wxyz"], ["wxyz", "abcd"]) == [1, 0]
    assert matching.greedy(["abcd", "abcd"], ["abcd", "zzzz"]) is None


def test_first_delivery(spark):
    d = spark.createDataFrame([(1, "late", "2024-01-02"), (1, "first", "2024-01-01"), (2, "x", None)], "id int, v string, at string").withColumn("at", F.to_timestamp("at"))
    assert {(r["id"], r["v"]) for r in V.first_delivery(d, "id", "at").collect()} == {(1, "first"), (2, "x")}


def test_x6_tells_marks_apart(spark):
    """Bullets are - and *, numbers end in a full stop, tables have three bars and may be indented."""
    t = F.col("t")
    text = "\n".join(["- a b", "  * c d", "• no", "+ no", "1. one", "  22. two", "3) no", "| a | b |", "   | c | d |", "| no |", "# H", "####### no", " # no"])
    r = spark.createDataFrame([(text,)], "t string").select(X.n_bullets(t), X.n_numbered(t), X.n_tables(t), X.n_headers(t)).first()
    assert r[:] == (2, 2, 2, 1)


def test_cycles_of_every_rotation(spark):
    """A beats B on honesty, B beats C on truthfulness, C beats A on helpfulness: one triple, from whichever member it starts;
    and seven responses are no reason to leave a prompt out."""
    from tallyloom.operators import pair_builders as B

    rs = [(0, 1, 3, None, 2, 2.0), (1, 2, 2, None, 3, 2.0), (2, 3, 1, None, 1, 2.0)]  # (idx, h, o, f, t, avg)
    e = spark.createDataFrame([(1, rs), (2, rs + [(k, 1, 1, 1, 1, 1.0) for k in range(3, 7)])], "prompt_id bigint, rs array<struct<idx int, h int, o int, f int, t int, avg double>>")
    got = {tuple(r) for r in B.cyclic_triples(e).where("prompt_id = 1").select("a", "b", "c", "cycle_config").collect()}
    want = {(a, b, c, "Cyclic_1") for a in rs for b in rs for c in rs if len({a[0], b[0], c[0]}) == 3 and a[2] > b[2] and b[4] > c[4] and c[1] > a[1]}
    assert got == {(a[0], b[0], c[0], n) for a, b, c, n in want} and len(got) == 1
    assert B.cyclic_triples(e).where("prompt_id = 2").count() > 0
    assert B.cyclic_pairs(B.cyclic_triples(e).where("prompt_id = 1")).count() == 3


@pytest.mark.parametrize("n", [4, 7, 9])
def test_lottery_has_most_entropy(n):
    """On a regular cyclic tournament the optimum is uniform; with doubled options the mass is shared between the doubles."""
    ring = np.full((n, n), 0.5)
    for i in range(n):
        for k in range(1, (n - 1) // 2 + 1):
            ring[i, (i + k) % n], ring[(i + k) % n, i] = 1, 0
    assert K.maximal_lottery(ring) == pytest.approx([1 / n] * n, abs=1e-6)
    three = np.array([[0.5, 1, 0], [0, 0.5, 1], [1, 0, 0.5]])
    at = [0, 0, 1, 2]
    assert K.maximal_lottery(three[np.ix_(at, at)]) == pytest.approx([1 / 6, 1 / 6, 1 / 3, 1 / 3], abs=1e-5)


def test_feedback_share_has_no_limit(spark):
    b = spark.createDataFrame([("q", f"i{i:03}", f"i{j:03}", 1, 0) for i in range(300) for j in (i + 1, i + 2) if j < 300] + [("r", "a", "b", 2, 1), ("r", "b", "c", 1, 0), ("r", "a", "c", 0, 1)], "prompt string, a string, b string, ab bigint, ba bigint")
    got = {r["prompt"]: r["corrected"] for r in C.feedback_share(b).collect()}
    assert got["q"] == 0 and got["r"] == pytest.approx(1 / 3)


def test_p_values(spark):
    """Against tables: the normal tail at 1.96, chi-square with 6 degrees at 12.592."""
    r = spark.range(1).select(ST.normal_tail(F.lit(1.959964)), ST.normal_tail(F.lit(-1.0)), ST.chi2_tail_even(F.lit(12.5916), 6)).first()
    assert r[:] == pytest.approx((0.025, 0.841345, 0.05), abs=1e-5)


def test_running_positions(spark):
    from tallyloom.operators import sampling as SA

    d = spark.createDataFrame([(k * k, 1 + k % 3) for k in range(500)], "x bigint, n bigint")
    got = {r["x"]: r["at"] for r in SA.running(d, "x", "n", "at").collect()}
    run = 0
    for k in range(500):
        assert got[k * k] == run
        run += 1 + k % 3


def test_stream_in_two_batches(spark, tmp_path):
    """Windows come once they are closed; a row later than the watermark is dropped; what is open stays open."""
    from tallyloom.streaming import events as E

    def add(name, rows):
        spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double, t string").withColumn("ts", F.to_timestamp("t")).drop("t").coalesce(1).write.parquet(f"{tmp_path}/in/{name}.parquet")

    add("events1", [(1, 1, "a", 1.0, "2024-01-01 00:10:00"), (2, 1, "b", 2.0, "2024-01-01 00:20:00"), (3, 1, "a", 1.0, "2024-01-03 00:00:00")])
    first = E.run(E.tumbling(E.stream(spark, f"{tmp_path}/in")), f"file://{tmp_path}/out").collect()
    assert {(r["event_type"], r["n"]) for r in first} == {("a", 1), ("b", 1)}
    add("events2", [(4, 1, "a", 9.0, "2024-01-01 00:30:00"), (5, 1, "a", 1.0, "2024-01-03 00:30:00"), (6, 2, "c", 1.0, "2024-01-06 00:00:00")])
    both = E.run(E.tumbling(E.stream(spark, f"{tmp_path}/in")), f"file://{tmp_path}/out").collect()
    assert sorted((str(r["start"])[:10], r["event_type"], r["n"]) for r in both) == [("2024-01-01", "a", 1), ("2024-01-01", "b", 1), ("2024-01-03", "a", 2)]


def test_shared_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    from tallyloom import session

    conf = SimpleNamespace(get=lambda *a: None)
    with pytest.raises(RuntimeError):
        session.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf)))


def test_report_and_embeddings(spark, tmp_path):
    sinks.write_report(spark.createDataFrame([(1, [0.5])], "n int, xs array<double>"), f"{tmp_path}/r", "Rates")
    assert "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part*"))).split() == ["Rates", "=====", "n:", "1", "xs:", "[0.5]"]
    spark.createDataFrame([([1.0, 2.0],), (None,)], "embedding array<double>").write.parquet(f"{tmp_path}/e.parquet")
    d, n = readers.embeddings(spark, f"{tmp_path}/e.parquet")
    assert n == 2 and d.count() == 1
