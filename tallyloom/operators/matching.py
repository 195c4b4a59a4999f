"""Greedy one-to-one matching of a prompt's few texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def overlap(a: str, b: str) -> float:
    """Share of positions at which two texts hold the same character."""
    return sum(x == y for x, y in zip(a, b)) / max(1, len(a), len(b))


def greedy(left: list[str], right: list[str], least: float = 0.8) -> list[int] | None:
    """For each left text the first unused right one with the same 100 first characters, else with enough overlap; None
    unless all find one."""
    used, out = set(), []
    for a in left:
        hit = next((k for k, b in enumerate(right) if k not in used and a[:100] == b[:100]), None)
        if hit is None:
            hit = next((k for k, b in enumerate(right) if k not in used and overlap(a, b) > least), None)
        if hit is None:
            return None
        used.add(hit)
        out.append(hit)
    return out


def match_arrays(df: DataFrame, key: str) -> DataFrame:
    """df(key, left array, right array) -> (key, permutation) of the prompts that match in full."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, ",".join(map(str, p))) for k, x, y in zip(b[key], b["left"], b["right"]) if (p := greedy(list(x), list(y))) is not None]
            yield pd.DataFrame(rows, columns=[key, "permutation"])

    return df.select(key, "left", "right").mapInPandas(run, f"{key} string, permutation string")
