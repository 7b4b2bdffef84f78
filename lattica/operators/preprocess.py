"""Fit/transform stages. Fitting gathers every statistic of every column in one aggregate (or two); the result is a small
driver-side table that transforms embed as literals, so transforming is one projection without joins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from ..functions.arrays import count_below, hard_clip, normal_ppf, soft_clip, zscore

#: Categories of a column beyond which a join replaces the literal map.
LITERAL_CATEGORIES = 10_000


def _one(df: DataFrame, **aggs: Column) -> dict:
    """Results of many aggregates, by name, in one job."""
    return df.agg(*(c.alias(k) for k, c in aggs.items())).first().asDict() if aggs else {}


#: Columns up to which each has aggregates of its own; those of more columns would outgrow one generated method.
WIDE = 16


def _each(df: DataFrame, columns: list[str], **aggs: Callable[[Column, Column], Column]) -> dict[str, dict]:
    """Aggregates by column, in one job: functions of the column and its place. Beyond WIDE numeric columns, rows are turned to
    (place, value) pairs and added up by place, which gives the same with one small aggregate; tasks send one row a column."""
    kinds = dict(df.dtypes)
    if len(columns) <= WIDE or not all(kinds[c] in ("tinyint", "smallint", "int", "float", "double") for c in columns):
        got = _one(df, **{f"{k}{i}": f(F.col(c), F.lit(i)) for i, c in enumerate(columns) for k, f in aggs.items()})
        return {c: {k: got[f"{k}{i}"] for k in aggs} for i, c in enumerate(columns)}
    pairs = df.select(F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("__i", "__x"))
    found = pairs.groupBy("__i").agg(*(f(F.col("__x"), F.col("__i")).alias(k) for k, f in aggs.items())).collect()
    rows = {r["__i"]: r for r in found}
    return {c: {k: rows[i][k] if i in rows else None for k in aggs} for i, c in enumerate(columns)}


def _at(values: list, place: Column) -> Column:
    """The value of a column's place, from a constant array."""
    return F.element_at(F.lit([float("nan") if v is None else float(v) for v in values]).cast("array<double>"), place + 1)


def kinds(df: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """(categorical, numeric, dropped) columns: text and booleans, numbers, and dates with everything else."""
    cat = [f.name for f in df.schema if isinstance(f.dataType, (StringType, BooleanType))]
    num = [f.name for f in df.schema if isinstance(f.dataType, NumericType)]
    return cat, num, [c for c in df.columns if c not in cat and c not in num]


@dataclass
class ToNumeric:
    """Sorted ordinal codes for categories (missing and unknown: -1), mean imputation for numbers, dates dropped.

    Output columns are the categorical ones, then the numeric ones.
    """

    keep: tuple[str, ...] = ()
    categories: dict[str, list] = field(default_factory=dict)
    means: dict[str, float | None] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame) -> ToNumeric:
        cat, num, self.dropped = kinds(df.drop(*self.keep))
        got = _one(df, **{f"c{i}": F.array_sort(F.collect_set(F.col(c).cast("string"))) for i, c in enumerate(cat)}, **{f"n{i}": F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))) for i, c in enumerate(num)})
        self.categories = {c: got[f"c{i}"] for i, c in enumerate(cat)}
        self.means = {c: got[f"n{i}"] for i, c in enumerate(num)}
        return self

    def code(self, c: str) -> Column:
        known = self.categories[c]
        place = F.array_position(F.lit(known).cast("array<string>"), F.col(c).cast("string")) if known else F.lit(0)
        return F.coalesce(place - 1, F.lit(-1)).cast("double")

    def transform(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        for c, known in self.categories.items():
            if len(known) > LITERAL_CATEGORIES:  # a dictionary of that size is joined, not searched row by row
                codes = spark.createDataFrame([(v, float(i)) for i, v in enumerate(known)], "__v string, __code double")
                df = df.join(F.broadcast(codes) if len(known) < 1_000_000 else codes, F.col(c).cast("string") == F.col("__v"), "left").withColumn(c, F.coalesce("__code", F.lit(-1.0))).drop("__v", "__code")
        codes = [(F.col(c) if len(k) > LITERAL_CATEGORIES else self.code(c)).alias(c) for c, k in self.categories.items()]
        nums = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(m)).alias(c) for c, m in self.means.items()]
        return df.select(*self.keep, *codes, *nums)


def encode_labels(df: DataFrame, y: str) -> tuple[list, Column]:
    """(sorted labels, code of y: place among them)."""
    labels = [r[0] for r in df.select(y).where(F.col(y).isNotNull()).distinct().orderBy(y).collect()]
    return labels, (F.array_position(F.lit(labels), F.col(y)) - 1).cast("int")


def unique_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Distinct values of each column, a null counting as one, in one aggregate."""
    got = _one(df, **{f"u{i}": F.countDistinct(c) + F.max(F.col(c).isNull().cast("int")) for i, c in enumerate(columns)})
    return {c: got[f"u{i}"] or 0 for i, c in enumerate(columns)}


def non_constant(df: DataFrame, columns: list[str], threshold: int = 1) -> list[str]:
    """Columns with more than `threshold` distinct values; all of them if there are no more rows than that."""
    if df.limit(threshold + 1).count() <= threshold:
        return list(columns)
    if threshold == 1:  # no distinct values to count: the least and the largest differ, or there are nulls beside values
        got = _each(df, columns, varied=lambda x, i: F.coalesce(F.when(F.count(x) > 0, (F.min(x) != F.max(x)) | (F.count_if(x.isNull()) > 0)), F.lit(False)))
        return [c for c in columns if got[c]["varied"]]
    counts = unique_counts(df, columns)
    return [c for c in columns if counts[c] > threshold]


def masked_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns without a single value in the frame."""
    kinds = dict(df.dtypes)
    real = [c for c in columns if kinds[c] in ("float", "double")]
    some = _each(df, real, n=lambda x, i: F.count(F.nanvl(x.cast("double"), F.lit(None)))) | _each(df, [c for c in columns if c not in real], n=lambda x, i: F.count(x))
    return [c for c in columns if not some[c]["n"]]


class Stage:
    """fit(df, columns) gathers statistics; column(c) is the transformed column; transform applies it to all."""

    columns: list[str]

    def column(self, c: str, x: Column | None = None) -> Column:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.column(c) for c in self.columns})

    def over(self, values: Column, columns: list[str]) -> Column:
        """The same on an array that holds the given columns' values."""
        return F.array(*(self.column(c, F.element_at(values, i + 1)) for i, c in enumerate(columns)))


class Standard(Stage):
    """(x - mean) / (population std + 1e-6), within +-100."""

    def fit(self, df: DataFrame, columns: list[str]) -> Standard:
        got = _each(df, columns, m=lambda x, i: F.avg(x), s=lambda x, i: F.stddev_pop(x) + 1e-6)
        self.columns, self.stats = list(columns), {c: (got[c]["m"], got[c]["s"]) for c in columns}
        return self

    def over(self, values: Column, columns: list[str]) -> Column:
        if any(None in self.stats[c] for c in columns):
            return super().over(values, columns)
        means, stds = zip(*(self.stats[c] for c in columns), strict=True)
        return F.transform(values, lambda v, i: zscore(v, _at(means, i), _at(stds, i)))

    def column(self, c: str, x: Column | None = None) -> Column:
        m, s = self.stats[c]
        return zscore(F.col(c) if x is None else x, F.lit(m), F.lit(s))

    def inverse(self, c: str, z: Column) -> Column:
        m, s = self.stats[c]
        return z * s + m


class OutlierClip(Stage):
    """Bounds mean +- k std (sample, at least 1e-6) of the values that lie within mean +- k std; soft clipping beyond them."""

    def __init__(self, threshold: float = 4.0):
        self.threshold = threshold

    def fit(self, df: DataFrame, columns: list[str]) -> OutlierClip:
        k = self.threshold
        spread = lambda x: F.greatest(F.lit(1e-6), F.coalesce(F.when(F.count(x) > 1, F.stddev_samp(x)), F.lit(0.0)))
        one = _each(df, columns, m=lambda x, i: F.avg(x), s=lambda x, i: spread(x))
        means, stds = [one[c]["m"] for c in columns], [one[c]["s"] for c in columns]
        inside = lambda x, i: F.when(F.abs(x - _at(means, i)) <= k * _at(stds, i), x)
        two = _each(df, columns, m=lambda x, i: F.avg(inside(x, i)), s=lambda x, i: spread(inside(x, i)))
        self.columns, self.bounds = list(columns), {c: (v["m"] - k * v["s"], v["m"] + k * v["s"]) if v["m"] is not None else (0.0, 0.0) for c, v in two.items()}
        return self

    def over(self, values: Column, columns: list[str]) -> Column:
        low, high = zip(*(self.bounds[c] for c in columns), strict=True)
        return F.transform(values, lambda v, i: soft_clip(v, _at(low, i), _at(high, i)))

    def column(self, c: str, x: Column | None = None) -> Column:
        low, high = self.bounds[c]
        return soft_clip(F.col(c) if x is None else x, F.lit(low), F.lit(high))


class Robust(Stage):
    """(x - median) / (IQR / 1.349); an IQR of 0 counts as 1."""

    def fit(self, df: DataFrame, columns: list[str]) -> Robust:
        got = _one(df, **{f"q{i}": F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) for i, c in enumerate(columns)})
        self.columns, self.stats = list(columns), {}
        for i, c in enumerate(columns):
            a, m, b = got[f"q{i}"]
            self.stats[c] = (m, (b - a) / 1.3489795003921634 or 1.0)
        return self

    def column(self, c: str, x: Column | None = None) -> Column:
        m, s = self.stats[c]
        return ((F.col(c) if x is None else x) - m) / s


def yeo_johnson(x: Column, lam: Column) -> Column:
    """The Yeo-Johnson transform for a given exponent."""
    pos = F.when(F.abs(lam) < 1e-9, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    neg = F.when(F.abs(lam - 2) < 1e-9, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, pos).otherwise(neg)


def _yeo_johnson_np(x: np.ndarray, lam: float) -> np.ndarray:
    pos, neg = np.maximum(x, 0.0), np.minimum(x, 0.0)
    up = np.log1p(pos) if abs(lam) < 1e-9 else ((pos + 1) ** lam - 1) / lam
    down = -np.log1p(-neg) if abs(lam - 2) < 1e-9 else -((1 - neg) ** (2 - lam) - 1) / (2 - lam)
    return np.where(x >= 0, up, down)


class Power(Stage):
    """Yeo-Johnson with the likeliest exponent, then standardised.

    Exponents are searched on a grid that narrows in a few rounds. A round is one pass: every task sends the moments of
    its rows for all columns and exponents (so many aggregates would outgrow one generated method), and they are merged.
    """

    def __init__(self, low: float = -4.0, high: float = 6.0, points: int = 9, rounds: int = 5):
        self.low, self.high, self.points, self.rounds = low, high, points, rounds

    def _moments(self, df: DataFrame, grid: list[list[float]]) -> dict[tuple[int, int], tuple[float, float, float, float]]:
        """By (column, exponent): count, mean, population variance, and the sum of sign(x) ln(1 + |x|)."""
        columns = self.columns

        def run(batches):
            rows: dict[tuple[int, int], list[float]] = {}
            for b in batches:
                for i, c in enumerate(columns):
                    x = b.column(c).to_numpy(zero_copy_only=False).astype(float)
                    x = x[np.isfinite(x)]
                    if not len(x):
                        continue
                    slope = float((np.sign(x) * np.log1p(np.abs(x))).sum())
                    for k, lam in enumerate(grid[i]):
                        v = _yeo_johnson_np(x, lam)
                        n, m, m2, s = rows.get((i, k), (0.0, 0.0, 0.0, 0.0))
                        delta, total = v.mean() - m, n + len(v)
                        rows[i, k] = [total, m + delta * len(v) / total, m2 + ((v - v.mean()) ** 2).sum() + delta * delta * n * len(v) / total, s + slope]
            if rows:
                keys = list(rows)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array([float(rows[k][j]) for k in keys]) for j in range(4))], names=["i", "k", "n", "m", "m2", "s"])

        sent = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).mapInArrow(run, "i int, k int, n double, m double, m2 double, s double")
        # merged in SQL: the mean of means by count, and variances about it
        one = sent.groupBy("i", "k").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("m2") + F.col("n") * F.col("m") * F.col("m")).alias("sq"), F.sum("s").alias("s"))
        return {(r["i"], r["k"]): (r["n"], r["nm"] / r["n"], max(0.0, r["sq"] / r["n"] - (r["nm"] / r["n"]) ** 2), r["s"]) for r in one.collect()}

    def fit(self, df: DataFrame, columns: list[str]) -> Power:
        self.columns = list(columns)
        span = [(self.low, self.high)] * len(columns)
        for _ in range(self.rounds):
            grid = [[a + (b - a) * k / (self.points - 1) for k in range(self.points)] for a, b in span]
            got = self._moments(df, grid)
            for i, g in enumerate(grid):
                like = [-got[i, k][0] / 2 * _log(got[i, k][2]) + (lam - 1) * got[i, k][3] if (i, k) in got else -abs(lam - 1) for k, lam in enumerate(g)]
                best = max(range(self.points), key=lambda k: like[k])
                span[i] = g[max(0, best - 1)], g[min(self.points - 1, best + 1)]
        self.lambdas = {c: (a + b) / 2 for c, (a, b) in zip(columns, span, strict=True)}
        got = self._moments(df, [[self.lambdas[c]] for c in columns])
        self.stats = {c: (got[i, 0][1], got[i, 0][2] ** 0.5 or 1.0) if (i, 0) in got else (0.0, 1.0) for i, c in enumerate(columns)}
        return self

    def column(self, c: str, x: Column | None = None) -> Column:
        m, s = self.stats[c]
        return (yeo_johnson(F.col(c) if x is None else x, F.lit(self.lambdas[c])) - m) / s


def _log(v: float | None) -> float:
    import math

    return math.log(v) if v and v > 0 else -745.0


class QuantileNormal(Stage):
    """Empirical distribution function by linear interpolation between quantiles, then the inverse normal one."""

    def __init__(self, n_quantiles: int | None = None, noise: float = 0.0, seed: int = 0):
        self.n_quantiles, self.noise, self.seed = n_quantiles, noise, seed

    def fit(self, df: DataFrame, columns: list[str]) -> QuantileNormal:
        n = self.n_quantiles or max(min(df.count() // 30, 1000), 10)
        if self.noise:  # noise in the fit only, scaled to each column
            std = _one(df, **{f"s{i}": F.stddev_pop(c) for i, c in enumerate(columns)})
            df = df.withColumns({c: F.col(c) + self.noise / max(std[f"s{i}"] or 0.0, self.noise) * F.randn(self.seed + i) for i, c in enumerate(columns)})
        levels = [k / (n - 1) for k in range(n)]
        got = _one(df, **{f"q{i}": F.percentile(c, F.lit(levels)) for i, c in enumerate(columns)})
        self.columns, self.grid = list(columns), {c: got[f"q{i}"] for i, c in enumerate(columns)}
        return self

    def column(self, c: str, x: Column | None = None) -> Column:
        q, n = self.grid[c], len(self.grid[c])
        knots = F.lit(q).cast("array<double>")

        def between(v: Column, k: Column) -> Column:
            a, b = F.element_at(knots, k), F.element_at(knots, k + 1)
            return (k - 1 + F.when(b > a, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - a) / (b - a)))).otherwise(F.when(v > a, 1.0).otherwise(0.0))) / (n - 1)

        # mean of the interpolations from the left and from the right, so that ties map to their middle
        side = lambda v, strict: _let(F.greatest(F.lit(1), F.least(F.lit(n - 1), count_below(knots, n, (lambda k: k < v) if strict else (lambda k: k <= v)))), lambda k: between(v, k))
        ppf = lambda v: _let(F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), (side(v, False) + side(v, True)) / 2)), normal_ppf)
        return _let(F.col(c) if x is None else x, lambda v: F.when(v.isNotNull(), ppf(v)))


def _let(x: Column, f) -> Column:
    """f(x) with x computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


#: Normalisers by name.
NORMALISERS = {"none": None, "power": Power, "quantile": QuantileNormal, "quantile_rtdl": lambda: QuantileNormal(noise=1e-3), "robust": Robust}


class Pipeline:
    """Standardise, normalise, clip outliers. With values outside the fitted range the input is clipped to it first."""

    def __init__(self, method: str = "none", outlier_threshold: float = 4.0, clip_to_fit: bool = False):
        if method not in NORMALISERS:
            raise ValueError(f"unknown normaliser {method!r}; known: {', '.join(NORMALISERS)}")
        self.method, self.threshold, self.clip_to_fit = method, outlier_threshold, clip_to_fit

    def fit(self, df: DataFrame, columns: list[str]) -> Pipeline:
        self.columns = list(columns)
        got = _each(df, columns, a=lambda x, i: F.min(x), b=lambda x, i: F.max(x))
        self.range = {c: (got[c]["a"], got[c]["b"]) for c in columns}
        self.stages: list[Stage] = [Standard().fit(df, columns)]
        df = self.stages[0].transform(df)
        if make := NORMALISERS[self.method]:
            self.stages.append(make().fit(df, columns))
            df = self.stages[-1].transform(df)
        self.stages.append(OutlierClip(self.threshold).fit(df, columns))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.clip_to_fit:
            df = df.withColumns({c: hard_clip(F.col(c), F.lit(a), F.lit(b)) for c, (a, b) in self.range.items() if a is not None})
        for s in self.stages:
            df = s.transform(df)
        return df

    def packed(self, columns: list[str]) -> Column:
        """An array of the given columns' values, transformed: the same as transform, in expressions that don't grow with columns."""
        bounds = lambda c: self.range[c] if self.clip_to_fit else (None, None)
        each = [hard_clip(F.col(c), F.lit(bounds(c)[0]), F.lit(bounds(c)[1])) if bounds(c)[0] is not None else F.col(c) for c in columns]
        values = F.array(*(x.cast("double") for x in each))
        for s in self.stages:
            values = s.over(values, columns)
        return values


def hard_clamp_outliers(df: DataFrame, columns: list[str], threshold: float = 4.0) -> DataFrame:
    """Clamps to mean +- threshold sample stds of the values inside them."""
    clip = OutlierClip(threshold).fit(df, columns)
    return df.withColumns({c: hard_clip(F.col(c), F.lit(clip.bounds[c][0]), F.lit(clip.bounds[c][1])) for c in columns})


def is_categorical(df: DataFrame, columns: list[str], max_categories: int = 10) -> dict[str, bool]:
    """Columns whose values are whole numbers, at most max_categories of them."""
    got = _one(df, **{f"w{i}": F.bool_and(F.col(c) % 1 == 0) for i, c in enumerate(columns)}, **{f"d{i}": F.countDistinct(c) for i, c in enumerate(columns)})
    return {c: bool(got[f"w{i}"]) and got[f"d{i}"] <= max_categories for i, c in enumerate(columns)}


def by_missing_rate(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns by their number of nulls, fewest first."""
    got = _one(df, **{f"m{i}": F.count_if(F.col(c).isNull()) for i, c in enumerate(columns)})
    return [c for _, _, c in sorted((got[f"m{i}"], i, c) for i, c in enumerate(columns))]
