"""Reading level of each English document (problem 8).

One smoothed unigram language model for each level, trained on the labelled anchor passages (a bounded sample: at most
``max_anchors`` of them, all of the 60 here); a document gets the level with the highest posterior. Only prose counts:
code blocks, table rows and bracketed footers are dropped, role names and list marks with them. A word that no anchor
holds says nothing about the level and is skipped.

The models, one row of log probabilities for each word of the anchors, are bounded by the anchors and go to the workers;
documents are scored where they are read, without a shuffle.

Defined cases: NULL and empty texts, texts with fewer than ``min_words`` words of prose or not in English give no row;
a tie goes to the lower level; repeated rows give repeated rows; without anchors the result is empty.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.languages import FUNCTION_WORDS
from tallyloom.session import table

MAX_ANCHORS = 10_000
MIN_WORDS = 40
SMOOTHING = 0.1

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_DROP = re.compile(r"^\s*\|.*$|^\s*\[[^\]\n]*\]\s*$|^\s*(?:Human|Assistant|User|System)\s*:", re.M | re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_OF = {lang: frozenset(w.split()) for lang, w in FUNCTION_WORDS.items()}


def prose(text: str) -> list[str]:
    """Words of the prose, in lower case."""
    return _WORD.findall(_DROP.sub(" ", _FENCE.sub(" ", text)).lower())


def is_english(words: Counter, total: int, known: int) -> bool:
    """English function words, or words of the anchors, outweigh those of every other language."""
    hits = {lang: sum(words[w] for w in own if w in words) for lang, own in _OF.items()}
    return max(hits["en"], known) > 0.15 * total and hits["en"] + known > max(v for k, v in hits.items() if k != "en")


class Levels:
    """The unigram models."""

    def __init__(self, rows: list[tuple[str, int]], smoothing: float = SMOOTHING):
        self.levels = sorted({level for _, level in rows})
        self.at: dict[str, int] = {}
        counts = [Counter(w for text, level in rows if level == x for w in prose(text or "")) for x in self.levels]
        for w in sorted(set().union(*counts)) if counts else []:
            self.at[w] = len(self.at)
        m = np.full((len(self.at), len(self.levels)), smoothing)
        for j, c in enumerate(counts):
            for w, n in c.items():
                m[self.at[w], j] += n
        self.log = np.log(m / m.sum(axis=0)) if len(self.at) else m

    def posterior(self, text: str | None, min_words: int = MIN_WORDS) -> tuple[int, float] | None:
        """(level, its posterior), or None where a document has no level."""
        words = prose(text or "")
        if len(words) < min_words or not self.at:
            return None
        c = Counter(words)
        seen = [(self.at[w], n) for w, n in c.items() if w in self.at]
        if not seen or not is_english(c, len(words), sum(n for _, n in seen)):
            return None
        i, n = np.array(seen).T
        s = n @ self.log[i]
        p = np.exp(s - s.max())
        k = int(np.argmax(s))
        return self.levels[k], float(p[k] / p.sum())


def levels_of(docs: DataFrame, model: Levels, min_words: int = MIN_WORDS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, level, posterior)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            out = [(d, *r) for d, t in zip(b["doc_id"], b["text"]) if (r := m.posterior(t, min_words))]
            yield pd.DataFrame(out, columns=["doc_id", "level", "posterior"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(score, "doc_id bigint, level int, posterior double")


def project(spark: SparkSession, sf_dir: str, max_anchors: int = MAX_ANCHORS) -> DataFrame:
    a = table(spark, sf_dir, "level_anchors", "anchor_id", "text", "level").where("level is not null and text is not null")
    rows = a.orderBy("anchor_id").limit(max_anchors).collect()
    return levels_of(table(spark, sf_dir, "documents", "doc_id", "text"), Levels([(r["text"], r["level"]) for r in rows]))
