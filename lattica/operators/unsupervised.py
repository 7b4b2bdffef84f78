"""Density, imputation and generation by the chain rule, each column predicted from others by the context kernel.

The fitted rows (all of them, or max_context chosen by a hash if that is given) travel to the executors as one array, equal rows as one with
their number; scoring, imputing and generating are then single passes over the rows, all columns and sweeps inside a batch, so no lineage
grows. Equal rows are scored and, where nothing is drawn at random, imputed once; rows of a batch with equal given values share their weights.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .ensemble import permutations
from .predictor import bandwidth, chunk, knots, once
from .preprocess import by_missing_rate, is_categorical

FLOOR = 1e-10
#: Columns with fewer observed rows are imputed by their mean or mode, and drawn from what was seen.
FEW = 5
COUNT = "__count"
#: Numbers of context rows that a worker keeps sorted for conditionals it meets again: 32 MB.
KEPT = 4_000_000


class Conditionals:
    """Conditional distributions of columns given others, from the context rows, each of which stands for counts equal ones.
    Everything here is NumPy over one batch."""

    def __init__(self, context: np.ndarray, categorical: list[bool], counts: np.ndarray | None = None):
        self.raw, self.categorical = context, categorical
        self.counts = np.ones(len(context)) if counts is None else np.asarray(counts, float)
        self.seen = np.isfinite(context)
        self.mean = np.array([np.average(c[k], weights=n[k]) if k.any() else 0.0 for c, k, n in self._columns()])
        self.std = np.array([max(np.sqrt(np.average((c[k] - m) ** 2, weights=n[k])), 1e-6) if k.any() else 1.0 for (c, k, n), m in zip(self._columns(), self.mean, strict=True)])
        self.warm = np.array([(self._mode if kind else self._median)(c[k], n[k]) for (c, k, n), kind in zip(self._columns(), categorical, strict=True)])
        self.filled = np.where(self.seen, context, self.warm)
        self.z = (self.filled - self.mean) / self.std
        self._known: dict = {}  # the last conditionals' context rows, of KEPT numbers at most and one at least

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def _columns(self):
        return ((c, k, self.counts) for c, k in zip(self.raw.T, self.seen.T, strict=True))

    @staticmethod
    def _mode(c: np.ndarray, n: np.ndarray) -> float:
        if not len(c):
            return 0.0
        v, at = np.unique(c, return_inverse=True)
        return float(v[np.bincount(at, n).argmax()])

    @staticmethod
    def _median(c: np.ndarray, n: np.ndarray) -> float:
        if not len(c):
            return 0.0
        order = np.argsort(c, kind="stable")
        c, end = c[order], np.cumsum(n[order])
        return float((c[np.searchsorted(end, (end[-1] - 1) // 2, "right")] + c[np.searchsorted(end, end[-1] // 2, "right")]) / 2)

    def _context(self, given: list[int], target: int) -> tuple:
        """Context rows that have the target, by its value: (values, counts, different given values, which of them each row has)."""
        key = (*given, target)
        if key not in self._known:
            ok = np.flatnonzero(self.seen[:, target])
            ok = ok[np.argsort(self.raw[ok, target], kind="stable")]
            b, at = np.unique(self.z[np.ix_(ok, given)], axis=0, return_inverse=True) if given and len(ok) else (np.zeros((1, 0)), np.zeros(len(ok), int))
            if sum(sum(v.size for v in k) for k in self._known.values()) + 3 * len(ok) + b.size > KEPT:
                self._known.clear()
            self._known[key] = self.raw[ok, target], self.counts[ok], b, at.reshape(-1)
        return self._known[key]

    def _asked(self, rows: np.ndarray, given: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Different given values of rows, standardised, and which of them each row has."""
        if not given or not len(rows):
            return np.zeros((1, 0)), np.zeros(len(rows), int)
        a = (np.where(np.isfinite(rows[:, given]), rows[:, given], self.warm[given]) - self.mean[given]) / self.std[given]
        a, at = np.unique(a, axis=0, return_inverse=True)
        return a, at.reshape(-1)

    def _weights(self, a: np.ndarray, given: list[int], target: int) -> np.ndarray:
        """Kernel weights, of a single copy, of given values a against context rows that have the target; those of all copies add up to 1."""
        _, n, b, at = self._context(given, target)
        total = n.sum()
        if not given or not len(n):
            return np.full((len(a), len(n)), 1.0 / max(1, total))
        dist = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0.0)
        dist -= dist.min(axis=1, keepdims=True)
        h = bandwidth(total, len(given))
        w = np.exp(-dist / (2 * h * h * len(given)))
        return (w / (w @ np.bincount(at, n))[:, None])[:, at]

    def _mass(self, a: np.ndarray, given: list[int], target: int) -> tuple[np.ndarray, np.ndarray]:
        """(different values of the target, the weight of each for each of the given values a)."""
        y, n, _, _ = self._context(given, target)
        first = np.flatnonzero(np.append(True, y[1:] != y[:-1])) if len(y) else np.zeros(0, int)
        return y[first], np.add.reduceat(self._weights(a, given, target) * n, first, axis=1) if len(y) else np.zeros((len(a), 0))

    def _pieces(self, f, rows: np.ndarray, given: list[int], *each: np.ndarray) -> np.ndarray:
        """f of the rows, the given values and each row's place among them, over so many given values and rows at once that their weights stay small."""
        if not len(rows):
            return np.zeros(0)
        a, at = self._asked(rows, given)
        order, step = np.argsort(at, kind="stable"), chunk(len(self.raw))
        out = None
        for i in range(0, len(a), step):
            own = order[np.searchsorted(at[order], i) : np.searchsorted(at[order], i + step)]
            got = f(a[i : i + step], at[own] - i, rows[own], *(e[own] for e in each))
            out = np.zeros(len(rows), got.dtype) if out is None else out
            out[own] = got
        return out

    def log_prob(self, rows: np.ndarray, given: list[int], target: int) -> np.ndarray:
        """log p(target | given) of each row; 0 where the target is missing."""
        return self._pieces(lambda a, at, r: self._log_prob(a, at, r[:, target], given, target), rows, given)

    def _log_prob(self, a: np.ndarray, at: np.ndarray, x: np.ndarray, given: list[int], target: int) -> np.ndarray:
        y, mass = self._mass(a, given, target)
        out, s = np.zeros(len(x)), self.std[target] * max(self._context(given, target)[1].sum(), 2) ** -0.2
        step = chunk(len(y))
        for i in range(0, len(x), step):
            v = x[i : i + step, None]
            if self.categorical[target]:
                p = (mass[at[i : i + step]] * (y[None] == v)).sum(axis=1)
            else:
                p = (mass[at[i : i + step]] * np.exp(-((v - y[None]) ** 2) / (2 * s * s))).sum(axis=1) / (s * np.sqrt(2 * np.pi))
            out[i : i + step] = p
        return np.where(np.isfinite(x), np.log(np.maximum(out, FLOOR)), 0.0)

    def draw(self, rows: np.ndarray, given: list[int], target: int, temperature: float, u: np.ndarray) -> np.ndarray:
        """Draws of the target: tempered class probabilities, or a tempered quantile."""
        return self._pieces(lambda a, at, r, v: self._draw(a, at, given, target, temperature, v), rows, given, u)

    def _draw(self, a: np.ndarray, at: np.ndarray, given: list[int], target: int, temperature: float, u: np.ndarray) -> np.ndarray:
        y, n, _, _ = self._context(given, target)
        if not len(y):
            return np.full(len(at), self.warm[target])
        if n.sum() < FEW:
            few = np.repeat(y, n.astype(int))
            return few[(u * len(few)).astype(int).clip(0, len(few) - 1)]
        if self.categorical[target]:
            classes, p = self._mass(a, given, target)
            if temperature <= 1e-8:
                return classes[p.argmax(axis=1)][at]
            p = p ** (1 / temperature)
            p /= p.sum(axis=1, keepdims=True)
            return classes[np.minimum((np.cumsum(p, axis=1)[at] <= u[:, None]).sum(axis=1), len(classes) - 1)]
        level = np.clip(0.5 + (u - 0.5) * temperature, 1e-6, 1 - 1e-6)
        out = np.zeros(len(at))
        own, begin = np.argsort(at, kind="stable"), np.searchsorted(np.sort(at), np.arange(len(a) + 1))
        for i, w in enumerate(self._weights(a, given, target)):
            rows = own[begin[i] : begin[i + 1]]
            if len(rows):
                out[rows] = np.interp(level[rows], *knots(y, n, w, 0.0, 1.0))
        return out

    def expected(self, rows: np.ndarray, given: list[int], target: int) -> np.ndarray:
        return self.draw(rows, given, target, 0.0, np.full(len(rows), 0.5))


class Unsupervised:
    """fit, then score_samples, impute or generate."""

    def __init__(self, max_context: int | None = None, max_categories: int = 10, seed: int = 0):
        self.max_context, self.max_categories, self.seed = max_context, max_categories, seed

    def fit(self, df: DataFrame, columns: list[str]) -> Unsupervised:
        clean = df.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns))
        self.columns = list(columns)
        self.categorical = is_categorical(clean, columns, self.max_categories)
        self.order = [columns.index(c) for c in by_missing_rate(clean, columns)]
        by = F.xxhash64(*columns, F.lit(self.seed))
        rows = clean if self.max_context is None else clean.orderBy(by).limit(self.max_context)
        rows = rows.groupBy(*columns).agg(F.count("*").alias(COUNT)).orderBy(by).toArrow().to_pandas()
        self.model = Conditionals(rows[columns].to_numpy(float).reshape(-1, len(columns)), [self.categorical[c] for c in columns], rows[COUNT].to_numpy())
        return self

    def _matrix(self, pdf: pd.DataFrame) -> np.ndarray:
        return pdf[self.columns].to_numpy(float)

    def score_samples(self, df: DataFrame, n_permutations: int = 4) -> DataFrame:
        """df with `density`: exp of the mean over permutations of the sum of log conditionals. Low values are outliers."""
        perms = permutations(len(self.columns), len(self.columns), "latin", self.seed)[:n_permutations] if n_permutations > 1 else [list(range(len(self.columns)))]
        model, matrix = self.model, self._matrix

        def run(batches):
            for pdf in batches:
                x, memo, total = matrix(pdf), {}, np.zeros(len(pdf))
                for p in perms:
                    for k, target in enumerate(p):
                        key = (frozenset(p[:k]), target)  # conditionals are shared by permutations with the same predecessors
                        if key not in memo:
                            memo[key] = model.log_prob(x, sorted(p[:k]), target)
                        total += memo[key]
                yield pdf.assign(density=np.exp(total / len(perms)))

        return once(df, {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in self.columns}, run, "density double")

    def impute(self, df: DataFrame, temperature: float = 0.0, n_iterations: int = 2) -> DataFrame:
        """Missing cells filled: a warm start of medians and modes, then sweeps over columns by missing rate."""
        model, matrix, columns, order, seed = self.model, self._matrix, self.columns, self.order, self.seed

        def run(batches):
            for pdf in batches:
                x = matrix(pdf)
                lost = ~np.isfinite(x)
                x = np.where(lost, model.warm, x)
                rng = np.random.default_rng([seed, len(pdf)])
                for _ in range(n_iterations):
                    for t in order:
                        rows = np.flatnonzero(lost[:, t])
                        if len(rows) and model.counts[model.seen[:, t]].sum() >= FEW:
                            given = [j for j in range(len(columns)) if j != t]
                            x[rows, t] = model.draw(x[rows], given, t, temperature, rng.random(len(rows)) if temperature > 0 else np.full(len(rows), 0.5))
                        elif len(rows):
                            x[rows, t] = model.mean[t]
                yield pdf.assign(**dict(zip(columns, x.T, strict=True)))

        wide = df.withColumns({c: F.col(c).cast("double") for c in columns})
        if temperature > 0:
            return wide.mapInPandas(run, _schema(wide))
        filled = [f"__filled{i}" for i in range(len(columns))]
        renamed = lambda batches: (pdf[columns].assign(**dict(zip(filled, own[columns].to_numpy(float).T, strict=True))) for pdf, own in ((pdf, next(run([pdf]))) for pdf in batches))
        got = once(wide, {c: F.nanvl(F.col(c), F.lit(None)) for c in columns}, renamed, ", ".join(f"{c} double" for c in filled))
        return got.select(*(F.col(filled[columns.index(c)]).alias(c) if c in columns else F.col(f"`{c}`") for c in wide.columns))

    def generate(self, spark: SparkSession, n: int, temperature: float = 1.0) -> DataFrame:
        """n new rows, column after column."""
        model, columns, seed = self.model, self.columns, self.seed

        def run(batches):
            for pdf in batches:
                ids = pdf["row_id"].to_numpy()
                u = np.stack([np.random.default_rng([seed, int(i)]).random(len(columns)) for i in ids]) if len(ids) else np.zeros((0, len(columns)))
                x = np.full((len(ids), len(columns)), np.nan)
                for t in range(len(columns)):
                    x[:, t] = model.draw(x, list(range(t)), t, temperature, u[:, t])
                yield pd.DataFrame({"row_id": ids} | dict(zip(columns, x.T, strict=True)))

        return spark.range(n).withColumnRenamed("id", "row_id").mapInPandas(run, "row_id long, " + ", ".join(f"`{c}` double" for c in columns))


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {k}" for c, k in df.dtypes)
