"""Broken prompt and response pairs (problem 4).

Noisy labelling functions (defect_votes) vote on each answer for each of five defects; a label model, fitted by
expectation-maximization without labels, turns every pattern of votes into a posterior; an answer keeps each defect whose
posterior passes the defect's cut-off, and the cut-offs are those with the best F1 on a small set of checked examples.
The single defect of an answer is the first that it keeps, in the order empty, refusal, copy, truncated, language.

One pass over the texts in Arrow batches gives the packed votes; texts are not shuffled. The only vote that needs the
corpus (is a list's or field's last word one that ends such items elsewhere?) joins the few open-ended answers with
counts of words. The label model sees the counts of vote patterns only: at most 3^3 or 3^4 for each defect.

Defined cases: a NULL, blank or filler answer is empty; a NULL instruction has no language and no copy; a one-word answer
is no defect; texts are read whole; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.defect_votes import DEFECTS, FUNCTIONS, votes
from tallyloom.session import cut, table

#: Position of each defect's first vote in the packed number, whose digits to base 3 are the votes plus one.
OFFSET = {d: sum(len(FUNCTIONS[x]) for x in DEFECTS[:k]) for k, d in enumerate(DEFECTS)}
LAST_WORD = OFFSET["truncated"] + FUNCTIONS["truncated"].index("last_word")
#: An item's last word must end so many earlier items to count as complete.
SEEN = 2

#: Checked examples: instruction, answer, defects.
VALIDATION = (
    ("Name the capital of Norway.", "", {"empty"}),
    ("Name the capital of Norway.", "N/A", {"empty"}),
    ("Name the capital of Norway.", "...", {"empty"}),
    ("Name the capital of Norway.", "Oslo", set()),
    ("Name the capital of Norway.", "42", set()),
    ("How do I mend a bicycle tube at home?", "I'm sorry, but I can't help with that.", {"refusal"}),
    ("How do I mend a bicycle tube at home?", "I must decline to answer this question. Is there anything else?", {"refusal"}),
    ("How do I mend a bicycle tube at home?", "As a language model I am not able to give advice on that.", {"refusal"}),
    ("Wie flicke ich einen Schlauch und was brauche ich für die Arbeit?", "Dabei kann ich leider nicht helfen.", {"refusal"}),
    ("How do I mend a bicycle tube at home?", "I can't praise patches enough. Roughen the rubber, add glue and press the patch on.", set()),
    ("How do I mend a bicycle tube at home?", "I'm sorry to hear that your tube burst; this should put it right. Take the wheel off and use a patch.", set()),
    ("How do I mend a bicycle tube at home?", "I'm not able to see the tube, of course, but here is what you need. Use a patch and the glue in the kit.", set()),
    ("How do I mend a bicycle tube at home?", "How do I mend a bicycle tube at home?", {"copy"}),
    ("How do I mend a bicycle tube at home?", "How do I mend a bicycle tube at home? How do I mend a bicycle tube at home?", {"copy"}),
    ("How do I mend a bicycle tube at home?", "Question: how do I mend a bicycle tube at home", {"copy"}),
    ("How do I mend a bicycle tube at home?", "How do I mend a bicycle tube at home? First take the wheel off, then find the hole, and last put a patch on the tube.", set()),
    ("Describe the garden in spring.", "In spring the garden is full of birds. The first flowers open when the", {"truncated"}),
    ("Describe the garden in spring.", "In spring the garden is full of birds. The first flowers open, and the…", {"truncated"}),
    ("Describe the garden in spring.", "In spring the garden is full of birds. The first flowers open when the sun is warm. Good luck", set()),
    ("Describe the garden in spring.", "Here is a list of things to do.\n- plant the early beans\n- water the", {"truncated"}),
    ("Describe the garden in spring.", "Here is a list of things to do.\n- plant the early beans\n- water the green house", set()),
    ("Give me the record as JSON.", '{"name": "spring", "birds": "many"}', set()),
    ("Give me the record as JSON.", '{"name": "spring", "birds": "ma', {"truncated"}),
    ("Write the loop that prints the numbers.", "Here is the loop.\n```\nfor x in y:\n    print(x)\n```", set()),
    ("Write the loop that prints the numbers.", "Here is the loop.\n```\nfor x in y:\n    print(", {"truncated"}),
    ("What should I know about the weather before I travel?", "Man sollte zuerst die Karte prüfen, denn das Wetter ist nicht immer gut und es gibt oft Regen.", {"language"}),
    ("Bitte erkläre in Ruhe, was man für die Reise braucht und was nicht.", "You can take the map with you, and it is good to have warm clothes for the evening.", {"language"}),
    ("Bitte erkläre in Ruhe, was man für die Reise braucht und was nicht.", "Man sollte zuerst die Karte prüfen, denn es gibt oft Regen.", set()),
    ("Translate this line into French: The soup is on the table.", "La soupe est sur la table, mais il faut aussi du pain pour nous.", set()),
    ("Translate this line into French: The soup is on the table.", "The soup is on the table and you can have it with bread.", {"language"}),
    ("Merci de dire ceci : la maison est rouge mais pas toujours.", "La casa es roja, pero no siempre, y hay que mirar todo lo demás.", {"language"}),
)


def digit(packed: Column, at: int) -> Column:
    """The vote at a position: -1, 0 or 1."""
    return F.pmod(F.floor(packed / F.lit(3**at)), F.lit(3)).cast("int") - 1


def pattern(packed: Column, defect: str) -> Column:
    """The number of a defect's votes among all of its 3^m patterns."""
    return F.pmod(F.floor(packed / F.lit(3 ** OFFSET[defect])), F.lit(3 ** len(FUNCTIONS[defect]))).cast("int")


def pack(v: dict[str, list[int]]) -> int:
    return sum((x + 1) * 3 ** (OFFSET[d] + k) for d in DEFECTS for k, x in enumerate(v[d]))


def _cast(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, ins, c, r in zip(b["row_id"], b["instruction"], b["chosen"], b["reject"]):
            for side, a in (("chosen", c), ("reject", r)):
                v, word, ends = votes(ins, a)
                rows.append((i, side, pack(v), word or None, ends or None))
        yield pd.DataFrame(rows, columns=["row_id", "side", "votes", "word", "ends"])


def cast_votes(pairs: DataFrame) -> DataFrame:
    """(row_id, instruction, chosen, reject) -> (row_id, side, votes)."""
    raw = cut(pairs.select("row_id", "instruction", "chosen", "reject").mapInPandas(_cast, "row_id bigint, side string, votes bigint, word string, ends array<string>"))
    ends = raw.where("ends is not null").select(F.explode("ends").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN)
    asked = raw.where("word is not null").join(ends, "word", "left")
    vote = F.when(F.col("n").isNotNull(), F.lit(-1)).otherwise(F.lit(1))
    told = asked.select("row_id", "side", (F.col("votes") + vote * F.lit(3**LAST_WORD)).alias("votes"))  # its digit was 1: no vote
    return raw.where("word is null").select("row_id", "side", "votes").unionByName(told)


def fit(counts: np.ndarray, m: int, rounds: int = 200, alpha: float = 1.0) -> np.ndarray:
    """Counts of the 3^m patterns -> posterior of the defect for each, by expectation-maximization.

    Votes are independent given the class; each function has its own table of votes for either class."""
    size = 3**m
    v = np.array([[p // 3**k % 3 for k in range(m)] for p in range(size)])
    s = (v - 1).sum(axis=1)
    post = np.where(s > 0, 0.95, np.where(s == 0, 0.3 * (v.max(axis=1) == 2), 0.02))
    if not counts.sum():
        return post
    for _ in range(rounds):
        last = post
        prior = ((counts * post).sum() + alpha) / (counts.sum() + 2 * alpha)
        ll = np.zeros((2, size))
        for c, w in ((0, counts * (1 - post)), (1, counts * post)):
            for k in range(m):
                t = np.array([w[v[:, k] == x].sum() for x in range(3)]) + alpha * np.array([(1.0, 0.2, 0.05), (0.05, 0.2, 1.0)][c])
                ll[c] += np.log(t / t.sum())[v[:, k]]
        post = 1 / (1 + np.exp(np.clip(np.log(1 - prior) - np.log(prior) + ll[0] - ll[1], -700, 700)))
        # A pattern without a positive vote is no defect whatever the rest says, one without a negative is one.
        post = np.where(v.max(axis=1) < 2, np.minimum(post, 0.05), post)
        if np.abs(post - last).max() < 1e-9:
            break
    return post


def validated_cutoffs(posteriors: dict[str, np.ndarray]) -> dict[str, float]:
    """The cut-off with the best F1 on the checked examples; among equals the one nearest to 1/2."""
    cast = [(votes(i, a), want) for i, a, want in VALIDATION]
    out = {}
    for d in DEFECTS:
        p = [(posteriors[d][sum((x + 1) * 3**k for k, x in enumerate(v[d]))], d in want) for (v, _, _), want in cast]

        def f1(c: float) -> float:
            hit = sum(x >= c and y for x, y in p)
            return 2 * hit / max(1, sum(x >= c for x, _ in p) + sum(y for _, y in p))

        out[d] = max((k / 20 for k in range(2, 20)), key=lambda c: (round(f1(c), 9), -abs(c - 0.5)))
    return out


def posteriors(cast: DataFrame) -> dict[str, np.ndarray]:
    """The label model of each defect, from the counts of its patterns (at most 3^4 of them)."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), pattern(F.col("votes"), d).alias("p")) for d in DEFECTS)))
    rows = cast.groupBy("votes").agg(F.count("*").alias("n")).select(each.alias("x"), "n").groupBy("x.defect", "x.p").agg(F.sum("n").alias("n")).collect()
    counts = {d: np.zeros(3 ** len(FUNCTIONS[d])) for d in DEFECTS}
    for r in rows:
        counts[r["defect"]][r["p"]] = r["n"]
    return {d: fit(c, len(FUNCTIONS[d])) for d, c in counts.items()}


def label(pairs: DataFrame) -> DataFrame:
    """(row_id, side, defect, posterior, nth): every defect an answer keeps; nth counts them in the order of DEFECTS."""
    cast = cut(cast_votes(pairs))
    model = posteriors(cast)
    cutoffs = validated_cutoffs(model)
    look = lambda d: F.element_at(F.array(*(F.lit(float(x)) for x in model[d])), pattern(F.col("votes"), d) + 1)
    each = F.filter(F.array(*(F.struct(F.lit(d).alias("defect"), F.round(look(d), 6).alias("posterior"), F.lit(cutoffs[d]).alias("cutoff")) for d in DEFECTS)), lambda x: x["posterior"] >= x["cutoff"])
    return cast.select("row_id", "side", F.posexplode(each).alias("at", "x")).select("row_id", "side", "x.defect", "x.posterior", (F.col("at") + 1).alias("nth"))


def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(table(spark, sf_dir, "custom_test_data", "row_id", "instruction", "chosen", "reject"))
