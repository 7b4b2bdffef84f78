"""Distributions given by quantiles, as expressions over ARRAY<DOUBLE>.

Levels default to i/(n+1). Inside, the quantile function is linear between knots; both tails are exponential, fitted to
the first and last knots, or generalised Pareto.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

#: Bounds of the fitted quantities and number of knots of a tail (fixed values).
TOL, SLOPES, BETAS, ETA, TAIL = 1e-6, (1e-6, 1e6), (0.01, 100.0), 0.49, 20


def default_levels(n: int = 999) -> list[float]:
    return [(i + 1) / (n + 1) for i in range(n)]


def sort_quantiles(q: Column) -> Column:
    return F.array_sort(q)


def cummax_quantiles(q: Column) -> Column:
    """Running maximum."""
    run = F.aggregate(q, F.array().cast("array<double>"), lambda a, v: F.concat(a, F.array(F.when(F.size(a) > 0, F.greatest(F.element_at(a, -1), v)).otherwise(v))))
    return run


def isotonic(values: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Pool adjacent violators: the nearest non-decreasing sequence in (weighted) squares."""
    means, sizes, counts = [], [], []
    w = np.ones(len(values)) if weights is None else weights
    for v, k in zip(values, w, strict=True):
        means.append(float(v))
        sizes.append(float(k))
        counts.append(1)
        while len(means) > 1 and means[-2] > means[-1]:
            total = sizes[-2] + sizes[-1]
            means[-2] = (means[-2] * sizes[-2] + means[-1] * sizes[-1]) / total
            sizes[-2], counts[-2] = total, counts[-2] + counts[-1]
            means.pop(), sizes.pop(), counts.pop()
    return np.repeat(means, counts)


def isotonic_quantiles(q: Column, weights: Column | None = None) -> Column:
    """Isotonic regression of each row's quantiles, weighted by an array of the same length if there is one, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def plain(s: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else isotonic(np.asarray(v, float)) for v in s])

    @F.pandas_udf("array<double>")
    def weighted(s: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or k is None else isotonic(np.asarray(v, float), np.asarray(k, float)) for v, k in zip(s, w, strict=True)])

    return plain(q) if weights is None else weighted(q, weights)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


@dataclass(frozen=True)
class Quantiles:
    """A column of n sorted quantiles at fixed levels. tails: 'exp' or 'gpd'; the latter for icdf, cdf and sample alone."""

    q: Column
    n: int
    levels: tuple[float, ...] | None = None
    tails: str = "exp"

    @property
    def alphas(self) -> list[float]:
        return list(self.levels or default_levels(self.n))

    def at(self, i: int) -> Column:
        return F.element_at(self.q, i + 1)

    def _exponential(self, what: str) -> None:
        if self.tails != "exp":
            raise NotImplementedError(f"{what} is known for exponential tails alone")

    def _slope(self, first: int, k: int, logs: list[float]) -> Column:
        """|cov/var| of quantiles first..first+k-1 against logs, within the bounds of a tail's scale."""
        mean = sum(logs) / k
        var = sum((v - mean) ** 2 for v in logs) / k
        centre = sum((self.at(first + i) for i in range(1, k)), self.at(first)) / k
        cov = sum(((self.at(first + i) - centre) * (logs[i] - mean) for i in range(1, k)), (self.at(first) - centre) * (logs[0] - mean)) / k
        return F.greatest(F.lit(BETAS[0]), F.least(F.lit(BETAS[1]), F.abs(cov / max(var, TOL))))

    def tail_scales(self) -> tuple[Column, Column]:
        """Scales of the left and right exponential tails."""
        if self.n < 4:
            raise ValueError("tails need at least four quantiles")
        k, a = min(TAIL, self.n // 4), self.alphas
        left = self._slope(0, k, [math.log(max(v, TOL)) for v in a[:k]]) if k > 1 else F.lit(BETAS[0])
        right = self._slope(self.n - k, k, [math.log(max(1 - v, TOL)) for v in a[-k:]]) if k > 1 else F.lit(BETAS[0])
        return left, right

    def tail_shapes(self) -> tuple[Column, Column]:
        """Shapes of generalised Pareto tails, from the ratio of two spacings to that of an exponential tail."""
        k, a, n = min(TAIL, self.n // 4), self.alphas, self.n

        def shape(i: tuple[int, int, int], d12: Column, d23: Column, logs: tuple[float, float]) -> Column:
            expected = max(logs[0] / max(logs[1], TOL), TOL)
            ratio = d12 / F.greatest(d23, F.lit(TOL)) / expected
            eta = F.when(ratio > TOL, F.log(F.greatest(ratio, F.lit(TOL))) / max(abs(logs[0]), TOL)).otherwise(0.0)
            return F.greatest(F.lit(-ETA), F.least(F.lit(ETA), eta))

        i, j, m = 0, k // 3, 2 * k // 3
        ln = lambda x, y: math.log(max(x / y, TOL))
        left = shape((i, j, m), self.at(j) - self.at(i), self.at(m) - self.at(j), (ln(a[j], a[i]), ln(a[m], a[j])))
        r1, r2, r3 = n - 1, n - 1 - k // 3, n - 1 - 2 * k // 3
        right = shape((r1, r2, r3), self.at(r1) - self.at(r2), self.at(r2) - self.at(r3), (ln(1 - a[r2], 1 - a[r1]), ln(1 - a[r3], 1 - a[r2])))
        return left, right

    def icdf(self, level: Column) -> Column:
        """Quantile function."""
        a, n = self.alphas, self.n
        al, ar = a[0], a[-1]
        bl, br = self.tail_scales()
        ql, qr = self.at(0), self.at(n - 1)
        low, high = F.greatest(level, F.lit(TOL)), F.greatest(1 - level, F.lit(TOL))
        if self.tails == "gpd":
            el, er = self.tail_shapes()
            left = F.when(F.abs(el) < 0.01, ql + bl * F.log(low / al)).otherwise(ql - bl / el * (F.pow(al / low, el) - 1))
            right = F.when(F.abs(er) < 0.01, qr - br * F.log(high / (1 - ar))).otherwise(qr + br / er * (F.pow((1 - ar) / high, er) - 1))
        else:
            left = bl * F.log(low) + (ql - bl * math.log(al))
            right = -br * F.log(high) + (qr + br * math.log(1 - ar))
        levels = F.lit(a).cast("array<double>")
        step = (a[-1] - a[0]) / (n - 1)
        uniform = all(abs(a[i] - a[0] - i * step) < 1e-9 for i in range(n))
        k = F.greatest(F.lit(1), F.least(F.lit(n - 1), (F.floor((level - al) / step + 1e-9) + 1).cast("int") if uniform else F.size(F.filter(levels, lambda v: v <= level))))
        a0, a1, q0, q1 = F.element_at(levels, k), F.element_at(levels, k + 1), F.element_at(self.q, k), F.element_at(self.q, k + 1)
        inside = q0 + (q1 - q0) * (level - a0) / (a1 - a0)
        return F.when(level < al, left).when(level > ar, right).otherwise(inside)

    def _segment(self, z: Column) -> Column:
        """Number (from 1) of the last segment whose lower knot is at most z."""
        return F.greatest(F.lit(1), F.least(F.lit(self.n - 1), F.size(F.filter(self.q, lambda v: v <= z))))

    def cdf(self, z: Column) -> Column:
        a, n = self.alphas, self.n
        al, ar = a[0], a[-1]
        bl, br = self.tail_scales()
        ql, qr = self.at(0), self.at(n - 1)
        if self.tails == "gpd":
            el, er = self.tail_shapes()
            base = lambda e, x: F.greatest(1 + e * x, F.lit(TOL))
            left = F.when(F.abs(el) < 0.01, al * F.exp((z - ql) / bl)).otherwise(al * F.pow(base(el, (ql - z) / bl), -1 / el))
            right = F.when(F.abs(er) < 0.01, 1 - (1 - ar) * F.exp(-(z - qr) / br)).otherwise(1 - (1 - ar) * F.pow(base(er, (z - qr) / br), -1 / er))
        else:
            left = F.exp(F.least(F.lit(0.0), (z - (ql - bl * math.log(al))) / bl))
            right = 1 - F.exp(F.least(F.lit(0.0), (z - (qr + br * math.log(1 - ar))) / -br))
        left = F.greatest(F.lit(0.0), F.least(F.lit(al), left))
        right = F.greatest(F.lit(ar), F.least(F.lit(1.0), right))
        levels, k = F.lit(a).cast("array<double>"), self._segment(z)
        q0, q1, a0, a1 = F.element_at(self.q, k), F.element_at(self.q, k + 1), F.element_at(levels, k), F.element_at(levels, k + 1)
        inside = F.when(q1 > q0, a0 + (a1 - a0) * (z - q0) / (q1 - q0)).otherwise(a0)
        return F.when(z < ql, left).when(z > qr, right).otherwise(inside)

    def density(self, z: Column) -> Column:
        """1 / Q'(F(z)), the slope within its bounds."""
        self._exponential("the density")
        a, n = self.alphas, self.n
        bl, br = self.tail_scales()
        level, levels, k = self.cdf(z), F.lit(a).cast("array<double>"), self._segment(z)
        inside = (F.element_at(self.q, k + 1) - F.element_at(self.q, k)) / (F.element_at(levels, k + 1) - F.element_at(levels, k))
        slope = F.when(z < self.at(0), bl / F.greatest(level, F.lit(TOL))).when(z > self.at(n - 1), br / F.greatest(1 - level, F.lit(TOL))).otherwise(inside)
        return 1 / F.greatest(F.lit(SLOPES[0]), F.least(F.lit(SLOPES[1]), slope))

    def log_prob(self, z: Column) -> Column:
        return F.log(self.density(z))

    def _pairs(self) -> Column:
        """Segments as structs (a, b, da) of neighbouring quantiles and the step of levels."""
        a = self.alphas
        steps = F.lit([a[i + 1] - a[i] for i in range(self.n - 1)]).cast("array<double>")
        return F.zip_with(F.zip_with(F.slice(self.q, 1, self.n - 1), F.slice(self.q, 2, self.n - 1), lambda x, y: F.struct(x.alias("a"), y.alias("b"))), steps, lambda s, d: F.struct(s["a"].alias("a"), s["b"].alias("b"), d.alias("d")))

    def mean(self) -> Column:
        """Mean with both exponential tails."""
        self._exponential("the mean")
        a, (bl, br) = self.alphas, self.tail_scales()
        inside = _sum(F.transform(self._pairs(), lambda s: s["d"] * (s["a"] + s["b"]) / 2))
        return a[0] * (self.at(0) - bl) + inside + (1 - a[-1]) * (self.at(self.n - 1) + br)

    def second_moment(self) -> Column:
        self._exponential("the variance")
        a, (bl, br) = self.alphas, self.tail_scales()
        ql, qr, ar = self.at(0), self.at(self.n - 1), -br
        inside = _sum(F.transform(self._pairs(), lambda s: s["d"] * (s["a"] * s["a"] + s["a"] * s["b"] + s["b"] * s["b"]) / 3))
        return a[0] * (ql * ql - 2 * bl * ql + 2 * bl * bl) + inside + (1 - a[-1]) * (qr * qr - 2 * ar * qr + 2 * ar * ar)

    def variance(self) -> Column:
        m = self.mean()
        return F.greatest(F.lit(0.0), self.second_moment() - m * m)

    def stddev(self) -> Column:
        return F.sqrt(self.variance())

    def plain_mean(self) -> Column:
        """Mean of the quantiles themselves."""
        return _sum(self.q) / self.n

    def plain_variance(self) -> Column:
        """Sample variance of the quantiles."""
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"))
        first = self.at(0)  # sums about one of the values; a mean inside the lambda would be summed anew for each element
        both = F.aggregate(self.q, zero, lambda a, v: F.struct((a["s"] + v - first).alias("s"), (a["ss"] + (v - first) * (v - first)).alias("ss")))
        return F.greatest(F.lit(0.0), (both["ss"] - both["s"] * both["s"] / self.n) / (self.n - 1))

    def sample(self, u: Column) -> Column:
        return self.icdf(u)

    def pinball_crps(self, z: Column) -> Column:
        """CRPS as twice the mean pinball loss over the levels."""
        levels = F.lit(self.alphas).cast("array<double>")
        loss = F.zip_with(self.q, levels, lambda q, a: pinball(z, q, a))
        return 2 * _sum(loss) / self.n

    def crps(self, z: Column) -> Column:
        """CRPS in closed form: 2 * integral of (1{z <= Q(a)} - a) (Q(a) - z) over all levels, spline and exponential tails."""
        self._exponential("the CRPS")
        a, (bl, br) = self.alphas, self.tail_scales()
        al, ar, ql, qr = a[0], a[-1], self.at(0), self.at(self.n - 1)
        level = self.cdf(z)
        starts = F.lit(a[:-1]).cast("array<double>")

        def segment(s, a0):
            d, m = s["d"], (s["b"] - s["a"]) / s["d"]
            r = F.greatest(a0, F.least(a0 + d, level))
            # integral over [a0, x] of (Q - z) and of t (Q - z), with Q(t) = q0 + m (t - a0)
            plain = lambda x: (s["a"] - z) * (x - a0) + m * (x - a0) * (x - a0) / 2
            tilted = lambda x: (s["a"] - z - m * a0) * (x * x - a0 * a0) / 2 + m * (x * x * x - a0 * a0 * a0) / 3
            return (plain(a0 + d) - plain(r)) - tilted(a0 + d)

        inside = _sum(F.zip_with(self._pairs(), starts, segment))
        # left tail: Q(t) = ql + bl ln(t / al) on (0, al); right tail: Q(t) = qr - br ln((1 - t) / (1 - ar)) on (ar, 1)
        r = F.least(F.lit(al), level)
        above = al * (ql - z - bl) - F.when(r > 0, r * (ql - z - bl + bl * F.log(r / al))).otherwise(0.0)
        left = above - (al * al / 2 * (ql - z) - bl * al * al / 4)
        w, v = 1 - ar, 1 - F.greatest(F.lit(ar), level)
        # over s = 1 - t: (1{t >= F} - 1 + s) (Q - z)
        over = F.when(v > 0, v * (qr - z + br - br * F.log(v / w))).otherwise(0.0)
        right = over - w * (qr - z + br) + (w * w / 2 * (qr - z) + br * w * w / 4)
        return F.greatest(F.lit(0.0), F.least(F.lit(1e4), 2 * (left + inside + right)))


def pinball(y: Column, q: Column, alpha) -> Column:
    """max(alpha * (y - q), (alpha - 1) * (y - q))."""
    e = y - q
    return F.greatest(alpha * e, (alpha - 1) * e)
