"""Small linear-algebra kernels, one prompt at a time in Arrow batches: only what SQL cannot iterate.

Each takes the array form of a prompt's matrix (cycles.rows_of), so a prompt is one row and nothing is regrouped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

def bt_mle(w: np.ndarray, rounds: int = 500, tol: float = 1e-10, floor: float = 1e-10, total: float = 1.0) -> np.ndarray:
    """Bradley-Terry strengths by minorise-maximise; w[..., i, j] = weight with which i beat j. Takes one matrix or
    a stack of them; a matrix of the stack stops where it would alone."""
    w = np.asarray(w, float)
    if w.ndim == 2:
        return bt_mle(w[None], rounds, tol, floor, total)[0]
    n = w.shape[1]
    off = ~np.eye(n, dtype=bool)
    theta, pair, wins = np.full(w.shape[:2], total / n), (w + w.swapaxes(1, 2)) * off, (w * off).sum(axis=2)
    open_ = np.arange(len(w))
    for _ in range(rounds):
        t = theta[open_]
        new = np.maximum(wins[open_] / np.maximum((pair[open_] / (t[:, :, None] + t[:, None, :])).sum(axis=2), 1e-300), floor)
        new *= total / new.sum(axis=1, keepdims=True)
        done = np.abs(new - t).max(axis=1) < tol
        theta[open_] = new
        open_ = open_[~done]
        if not len(open_):
            break
    return theta


def maximal_lottery(p: np.ndarray, slack: float = 1e-9, rounds: int = 200) -> np.ndarray:
    """Of all optimal mixed strategies of the skew game p - 1/2 (each column's payoff at least -slack; the value of such
    a game is 0) the one with the most entropy, for any number of responses. A Condorcet winner is the whole answer;
    else a primal-dual interior-point method on min sum x ln x, started outside the constraints."""
    m, n = p - 0.5, len(p)
    for i in range(n):
        if (np.delete(m[i], i) > 0).all():
            return np.eye(n)[i]
    a = m.T
    x, s, lam, nu = np.full(n, 1 / n), np.ones(n), np.ones(n), 0.0
    for _ in range(rounds):
        mu = float(s @ lam) / n
        grad = np.log(x) + 1 - a.T @ lam + nu
        miss, total = a @ x + slack - s, x.sum() - 1
        if mu < 1e-13 and np.abs(miss).max() < 1e-11 and np.abs(grad).max() < 1e-8:
            break
        # Newton on the conditions with centring 0.1; s and lam are eliminated.
        d = lam / s
        h = np.diag(1 / x) + (a.T * d) @ a
        rhs = -grad + a.T @ (0.1 * mu / s - lam - d * miss)
        k = np.block([[h, np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
        try:
            step = np.linalg.solve(k, np.append(rhs, -total))
        except np.linalg.LinAlgError:
            break
        dx, dnu = step[:n], step[n]
        ds = a @ dx + miss
        dlam = 0.1 * mu / s - lam - d * ds
        reach = lambda v, dv: min([1.0, *(-0.99 * v[dv < 0] / dv[dv < 0])])
        t = min(reach(x, dx), reach(s, ds), reach(lam, dlam))
        x, s, lam, nu = x + t * dx, s + t * ds, lam + t * dlam, nu + t * dnu
    x = np.where(x < 1e-8, 0, x)
    return x / x.sum()


def hodge(flow: np.ndarray, seen: np.ndarray) -> tuple[float, float, float, float]:
    """Energies (total, gradient on observed edges, curl, harmonic) of a skew flow on a graph."""
    n = len(flow)
    edges = [(i, j) for i in range(n) for j in range(i + 1, n) if seen[i, j]]
    y = np.array([flow[i, j] for i, j in edges])
    if not edges:
        return 0.0, 0.0, 0.0, 0.0
    b = np.zeros((len(edges), n))
    at = {e: k for k, e in enumerate(edges)}
    for k, (i, j) in enumerate(edges):
        b[k, i], b[k, j] = 1, -1
    grad = b @ np.linalg.lstsq(b, y, rcond=None)[0]
    rest = y - grad
    tri = [(i, j, l) for i, j, l in combinations(range(n), 3) if (i, j) in at and (j, l) in at and (i, l) in at]
    curl = np.zeros(len(edges))
    if tri:
        c = np.zeros((len(edges), len(tri)))
        for k, (i, j, l) in enumerate(tri):
            c[at[i, j], k], c[at[j, l], k], c[at[i, l], k] = 1, 1, -1
        curl = c @ np.linalg.lstsq(c, rest, rcond=None)[0]
    return 2 * float(y @ y), 2 * float(grad @ grad), 2 * float(curl @ curl), 2 * float((rest - curl) @ (rest - curl))


def loop_ratio_v1(flow: np.ndarray, seen: np.ndarray) -> float:
    """N5 on sparse graphs: potential from observed edges, gradient energy over every pair."""
    n = len(flow)
    lap = np.diag(seen.sum(axis=1).astype(float)) - seen
    r = np.linalg.lstsq(lap, (flow * seen).sum(axis=1), rcond=None)[0]
    total = float((flow[seen] ** 2).sum())
    grad = float(((r[:, None] - r[None, :])[~np.eye(n, dtype=bool)] ** 2).sum())
    return 0.0 if total < 1e-10 else float(np.clip(1 - grad / total, 0, 1))


def per_stack(rows: DataFrame, f: Callable[[np.ndarray], np.ndarray], schema: str) -> DataFrame:
    """Apply f to stacks of equally large matrices: (prompts, n, n) -> (prompts, n, values), a row for each response."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            by: dict[int, list] = {}
            for q, m in zip(b["prompt_id"], b["m"]):
                by.setdefault(len(m), []).append((q, np.vstack(m)))
            parts = []
            for n, xs in by.items():
                v = f(np.stack([m for _, m in xs]).astype(float)).reshape(len(xs) * n, -1)
                d = pd.DataFrame(v, columns=names[2:])
                d.insert(0, names[1], np.tile(np.arange(n), len(xs)))
                d.insert(0, names[0], np.repeat([q for q, _ in xs], n))
                parts.append(d)
            yield pd.concat(parts) if parts else pd.DataFrame(columns=names)

    return rows.select("prompt_id", "m").mapInPandas(run, schema)


def per_matrix(rows: DataFrame, f: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Apply f to each prompt's matrix; schema starts with prompt_id."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(q, *r) for q, m in zip(b["prompt_id"], b["m"]) for r in f(np.vstack(m).astype(float))]
            yield pd.DataFrame(out, columns=names)

    return rows.select("prompt_id", "m").mapInPandas(run, schema)


def per_graph(rows: DataFrame, f: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """rows(prompt_id, xs, es): apply f to the win counts of each prompt's items xs, built from its edges es(a, b, ab, ba)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for q, xs, es in zip(batch["prompt_id"], batch["xs"], batch["es"]):
                at, w = {x: k for k, x in enumerate(xs)}, np.zeros((len(xs), len(xs)))
                for e in es:
                    i, j = at[e["a"]], at[e["b"]]
                    w[i, j], w[j, i] = e["ab"], e["ba"]
                out += [(q, *r) for r in f(w)]
            yield pd.DataFrame(out, columns=names)

    return rows.select("prompt_id", "xs", "es").mapInPandas(run, schema)
