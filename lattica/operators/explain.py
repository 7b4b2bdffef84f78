"""Shapley values and interactions of predictions, by coalitions of columns. A column outside a coalition is masked, as if
it weren't in the table; for the kernel predictor, distances are sums over columns, so all coalitions of a batch are
scored together from per-column distances."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .predictor import bandwidth, chunk, once

#: Columns up to which every coalition is evaluated; beyond it, permutations are sampled.
EXACT = 10


def shapley_from_values(values: dict[frozenset, np.ndarray], d: int) -> np.ndarray:
    """Exact Shapley values (rows x columns) from the values of all coalitions."""
    out = np.zeros((len(next(iter(values.values()))), d))
    for i in range(d):
        rest = [j for j in range(d) if j != i]
        for k in range(d):
            w = math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)
            for s in itertools.combinations(rest, k):
                out[:, i] += w * (values[frozenset((*s, i))] - values[frozenset(s)])
    return out


def interactions_from_values(values: dict[frozenset, np.ndarray], d: int) -> dict[tuple[int, int], np.ndarray]:
    """Shapley interaction index of pairs."""
    out = {}
    for i, j in itertools.combinations(range(d), 2):
        rest = [k for k in range(d) if k not in (i, j)]
        total = 0.0
        for n in range(d - 1):
            w = math.factorial(n) * math.factorial(d - n - 2) / math.factorial(d - 1)
            for s in itertools.combinations(rest, n):
                s = frozenset(s)
                total = total + w * (values[s | {i, j}] - values[s | {i}] - values[s | {j}] + values[s])
        out[i, j] = total
    return out


class KernelExplainer:
    """Explains kernel regression (or the probability of one class) from a broadcast context: all rows, or max_context of them.
    Context rows of equal features travel as one with their number and mean, and equal query rows are explained once."""

    def __init__(self, context: DataFrame, features: list[str], y: str, max_context: int | None = None, seed: int = 0, n_permutations: int = 32):
        rows = context.select(*(F.col(c).cast("double").alias(c) for c in features), F.col(y).cast("double").alias("__y")).na.drop()
        if max_context is not None:
            rows = rows.orderBy(F.xxhash64(*features, F.lit(seed))).limit(max_context)
        rows = rows.groupBy(*features).agg(F.avg("__y").alias("__y"), F.count("*").alias("__n")).orderBy(F.xxhash64(*features, F.lit(seed))).toArrow().to_pandas()
        self.features, self.seed, self.n_permutations = list(features), seed, n_permutations
        x, self.n = rows[features].to_numpy(float), rows["__n"].to_numpy(float)
        self.mean = self.n @ x / max(self.n.sum(), 1)
        self.std = np.maximum(np.sqrt(self.n @ (x - self.mean) ** 2 / max(self.n.sum(), 1)), 1e-9)
        self.x, self.y = (x - self.mean) / self.std, rows["__y"].to_numpy(float)

    def _values(self, q: np.ndarray, coalitions: set[frozenset]) -> dict[frozenset, np.ndarray]:
        z = (q - self.mean) / self.std
        each = [(z[:, j][:, None] - self.x[:, j][None]) ** 2 for j in range(z.shape[1])]
        out, count = {}, self.n.sum()
        for s in coalitions:
            if not s:
                out[s] = np.full(len(q), self.n @ self.y / count)
                continue
            dist = sum(each[j] for j in s)
            h = bandwidth(count, len(s))
            w = np.exp(-(dist - dist.min(axis=1, keepdims=True)) / (2 * h * h * len(s))) * self.n
            out[s] = w @ self.y / w.sum(axis=1)
        return out

    def _explain(self, q: np.ndarray) -> np.ndarray:
        d = q.shape[1]
        if d <= EXACT:
            return shapley_from_values(self._values(q, {frozenset(s) for k in range(d + 1) for s in itertools.combinations(range(d), k)}), d)
        rng, out = random.Random(self.seed), np.zeros(q.shape)
        for _ in range(self.n_permutations):
            p = rng.sample(range(d), d)
            chain = [frozenset(p[:k]) for k in range(d + 1)]
            v = self._values(q, set(chain))
            for k in range(d):
                out[:, p[k]] += (v[chain[k + 1]] - v[chain[k]]) / self.n_permutations
        return out

    def shapley(self, query: DataFrame, key: str) -> DataFrame:
        """key, feature, phi: one row a column of every query row. Sums to the prediction less the mean."""
        features, explain, step = self.features, self._explain, min(256, chunk(len(self.x)))

        def run(batches):
            for pdf in batches:
                for at in range(0, len(pdf), step):
                    part = pdf.iloc[at : at + step]
                    yield part.assign(__phi=list(explain(part[features].to_numpy(float))))

        got = once(query.select(key, *features), {c: F.col(c).cast("double") for c in features}, run, "__phi array<double>")
        each = F.array(*(F.struct(F.lit(c).alias("feature"), F.nanvl(F.element_at("__phi", i + 1), F.lit(None)).alias("phi")) for i, c in enumerate(features)))
        return got.select(key, F.explode(each).alias("s")).select(key, "s.feature", "s.phi")

    def interactions(self, query: DataFrame, key: str) -> DataFrame:
        """key, a, b, phi of every pair of columns."""
        features, values, step = self.features, self._values, min(256, chunk(len(self.x)))
        d = len(features)
        if d > EXACT:
            raise ValueError(f"interactions need at most {EXACT} columns")

        def run(batches):
            for pdf in batches:
                for at in range(0, len(pdf), step):
                    part = pdf.iloc[at : at + step]
                    v = values(part[features].to_numpy(float), {frozenset(s) for k in range(d + 1) for s in itertools.combinations(range(d), k)})
                    phi = list(interactions_from_values(v, d).values())
                    yield part.assign(__phi=list(np.stack(phi, axis=1)) if phi else [[] for _ in range(len(part))])

        got = once(query.select(key, *features), {c: F.col(c).cast("double") for c in features}, run, "__phi array<double>")
        pairs = itertools.combinations(features, 2)
        each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.nanvl(F.element_at("__phi", i + 1), F.lit(None)).alias("phi")) for i, (a, b) in enumerate(pairs)]
        kind = "array<struct<a:string,b:string,phi:double>>"
        return got.select(key, F.explode((F.array(*each)).cast(kind)).alias("s")).select(key, "s.a", "s.b", "s.phi")


def importance(phi: DataFrame) -> DataFrame:
    """Mean |phi| of each column, largest first: what a summary plot shows."""
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance")).orderBy(F.desc("importance"), "feature")


def additive_shapley(df: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """Shapley values of a weighted sum: weight * (value - mean), in one aggregate and a projection."""
    means = df.agg(*(F.avg(c).alias(c) for c in weights)).first().asDict()
    each = F.array(*(F.struct(F.lit(c).alias("feature"), (w * (F.col(c) - means[c])).cast("double").alias("phi")) for c, w in weights.items()))
    return df.select(key, F.explode(each).alias("s")).select(key, "s.feature", "s.phi")
