"""Forecasting: features of time, detected seasons, and one regression a series in a grouped map."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.calendar import calendar_features, extended_calendar_features, fourier_features
from .panel import Panel
from .predictor import bandwidth, weighted_quantiles


class TimeTransform(Protocol):
    """Adds feature columns to a panel of context and horizon rows (told apart by is_context)."""

    def apply(self, panel: Panel, target: str) -> Panel: ...


@dataclass(frozen=True)
class IndexEncoder:
    """running_index: 0, 1, ... over context, then horizon."""

    name: str = "running_index"

    def apply(self, panel: Panel, target: str) -> Panel:
        return panel.with_index(self.name)


@dataclass(frozen=True)
class DatetimeEncoder:
    components: tuple[str, ...] = ("year",)
    seasonal: dict | None = None

    def apply(self, panel: Panel, target: str) -> Panel:
        return panel.assign(**calendar_features(F.col(panel.ts), self.components, self.seasonal))


@dataclass(frozen=True)
class ExtendedDatetimeEncoder:
    components: tuple[str, ...] = ()
    seasonal: dict | None = None

    def apply(self, panel: Panel, target: str) -> Panel:
        return panel.assign(**extended_calendar_features(F.col(panel.ts), self.components, self.seasonal))


@dataclass(frozen=True)
class FourierEncoder:
    periods: tuple[float, ...] = ()
    suffix: str | None = None

    def apply(self, panel: Panel, target: str) -> Panel:
        return panel.assign(**fourier_features(F.row_number().over(panel.window()) - 1, list(self.periods), self.suffix))


@dataclass(frozen=True)
class PeriodicConfig:
    """How seasons are detected."""

    top_k: int = 5
    detrend: str | None = "linear"
    peaks_only: bool = True
    window: bool = True
    pad: int = 2
    round_periods: bool = True
    check_acf: bool = False
    min_relative: float = 0.05
    exclude_zero: bool = True


def detrend(x: np.ndarray, how: str | None) -> np.ndarray:
    """first_diff, linear, constant, loess (local lines over a tenth of the points), or None."""
    if how in (None, "none"):
        return x
    if how == "first_diff":
        return np.diff(x, prepend=x[:1])
    if how == "constant":
        return x - np.nanmean(x)
    t, ok = np.arange(len(x), dtype=float), np.isfinite(x)
    if how == "linear":
        if ok.sum() < 2:
            return x - np.nanmean(x)
        slope, offset = np.polyfit(t[ok], x[ok], 1)
        return x - (slope * t + offset)
    if how == "loess":
        k, out = max(3, int(0.1 * ok.sum())), np.array(x, float)
        for i in t:
            d = np.abs(t[ok] - i)
            near = np.argsort(d, kind="stable")[:k]
            w = (1 - np.minimum(d[near] / max(d[near].max(), 1e-9), 1) ** 3) ** 3 + 1e-9
            a = np.column_stack((np.ones(k), t[ok][near] - i))
            out[int(i)] = x[int(i)] - np.linalg.lstsq(a * np.sqrt(w)[:, None], x[ok][near] * np.sqrt(w), rcond=None)[0][0]
        return out
    raise ValueError(f"unknown detrending {how!r}")


def local_peaks(x: np.ndarray) -> np.ndarray:
    """Places of strict local maxima; the middle of a plateau counts."""
    out, i = [], 1
    while i < len(x) - 1:
        if x[i] > x[i - 1]:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if j < len(x) - 1 and x[j + 1] < x[i]:
                out.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    return np.array(out, int)


def hann(n: int) -> np.ndarray:
    return np.ones(1) if n == 1 else 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))


def autocorrelation(x: np.ndarray, lags: int) -> np.ndarray:
    x = x - x.mean()
    var = (x * x).sum()
    return np.array([1.0 if k == 0 else (x[k:] * x[:-k]).sum() / var if var > 0 else 0.0 for k in range(lags + 1)])


def spectrum(x: np.ndarray, pad: int, window: bool) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, magnitudes) of the zero-padded real Fourier transform; the constant part is 0."""
    y = x * hann(len(x)) if window else x
    n = len(x) * max(1, pad)
    m = np.abs(np.fft.rfft(y, n))
    m[0] = 0.0
    return np.fft.rfftfreq(n), m


def detect_periods(x: np.ndarray, top_k: int = 10, detrend_by: str | None = "first_diff", peaks_only: bool = True, window: bool = True, pad: int = 2, round_periods: bool = True, check_acf: bool = False, min_relative: float = 0.05, exclude_zero: bool = False) -> list[tuple[float, float]]:
    """(period, strength) of the strongest seasons of a series, strongest first."""
    x = detrend(np.asarray(x, float), detrend_by)
    x = x[np.isfinite(x)]
    if len(x) < 3:
        return []
    freq, size = spectrum(x, pad, window)
    bins = local_peaks(size) if peaks_only else np.arange(len(size))
    if not len(bins):
        bins = np.arange(len(size))
    bins = bins[size[bins] >= min_relative * size.max()] if size.max() > 0 else bins[:0]
    bins = bins[np.argsort(-size[bins], kind="stable")][:top_k]
    found: dict[float, float] = {}
    for b in bins:
        period = 1 / freq[b] if freq[b] > 0 else 0.0
        if round_periods:
            period = float(np.rint(period))
        if period == 0 and exclude_zero:
            continue
        found[period] = max(found.get(period, 0.0), float(size[b]))
    if check_acf and found:
        acf = autocorrelation(x, min(len(x) - 1, int(max(found)) + 2))
        strong = {int(p) for p in local_peaks(acf) if acf[p] > 1.96 / np.sqrt(len(x))}
        kept = {p: s for p, s in found.items() if any(abs(p - q) <= 1 for q in strong)}
        found = kept or found
    return sorted(found.items(), key=lambda v: -v[1])


def detect_periods_config(x: np.ndarray, c: PeriodicConfig) -> list[tuple[float, float]]:
    return detect_periods(x, c.top_k, c.detrend, c.peaks_only, c.window, c.pad, c.round_periods, c.check_acf, c.min_relative, c.exclude_zero)


@dataclass(frozen=True)
class AutoPeriodicEncoder:
    """sin_#i and cos_#i of each series' detected periods; 0 where a series has fewer."""

    config: PeriodicConfig = PeriodicConfig()

    def periods(self, panel: Panel, target: str) -> DataFrame:
        """item, periods: one array a series, in a grouped map over the context's values only."""
        item, ts, config = panel.item, panel.ts, self.config
        kind = dict(panel.df.dtypes)[item]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            x = pdf.sort_values(ts)[target].to_numpy(float)
            return pd.DataFrame({item: [pdf[item].iloc[0]], "periods": [[p for p, _ in detect_periods_config(x, config) if p > 0]]})

        return panel.df.where("is_context").select(item, ts, target).groupBy(item).applyInPandas(run, f"{item} {kind}, periods array<double>")

    def apply(self, panel: Panel, target: str) -> Panel:
        df = panel.df.join(self.periods(panel, target), panel.item, "left").withColumn("__i", F.row_number().over(panel.window()) - 1)
        for k in range(self.config.top_k):
            angle = 2 * np.pi * F.col("__i") / F.try_element_at("periods", F.lit(k + 1))
            df = df.withColumns({f"sin_#{k}": F.coalesce(F.sin(angle), F.lit(0.0)), f"cos_#{k}": F.coalesce(F.cos(angle), F.lit(0.0))})
        return panel.with_df(df.drop("periods", "__i"))


#: Transforms by name.
TRANSFORMS: dict[str, Callable[[], TimeTransform]] = {"index": IndexEncoder, "datetime": DatetimeEncoder, "extended_datetime": ExtendedDatetimeEncoder, "periodic": AutoPeriodicEncoder}


def resolve(transforms) -> list[TimeTransform]:
    out = []
    for t in transforms:
        if t == "fourier":
            raise ValueError("the Fourier transform needs periods: give FourierEncoder(periods=...)")
        if isinstance(t, str) and t not in TRANSFORMS:
            raise ValueError(f"unknown transform {t!r}; known: {', '.join(TRANSFORMS)}")
        out.append(TRANSFORMS[t]() if isinstance(t, str) else t)
    return out


def add_features(context: Panel, future: Panel, transforms, target: str = "target") -> Panel:
    """Context and horizon rows with the features of all transforms; is_context tells them apart."""
    both = context.with_horizon(future)
    for t in resolve(transforms):
        both = t.apply(both, target)
    return both


def kernel_forecast(train_x: np.ndarray, train_y: np.ndarray, test_x: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Quantiles of the context targets weighted by a kernel on standardised features; one row a test row."""
    mean, std = train_x.mean(axis=0), train_x.std(axis=0)
    keep = std > 1e-12
    if not keep.any():
        return np.repeat(np.quantile(train_y, levels)[None], len(test_x), axis=0)
    a, b = (train_x[:, keep] - mean[keep]) / std[keep], (test_x[:, keep] - mean[keep]) / std[keep]
    h, d = bandwidth(len(a), int(keep.sum())), int(keep.sum())
    dist = np.maximum((b * b).sum(1)[:, None] + (a * a).sum(1)[None] - 2 * b @ a.T, 0.0)
    order = np.argsort(train_y, kind="stable")
    dist = dist[:, order] - dist.min(axis=1, keepdims=True)
    return weighted_quantiles(train_y[order], np.exp(-dist / (2 * h * h * d)), levels)


class Forecaster:
    """Forecasts every series of a panel. point: mean or median; engine: (train_x, train_y, test_x, levels) -> quantiles."""

    def __init__(self, max_context_length: int = 4096, transforms=("index", "datetime", "periodic"), point: str = "median", engine=kernel_forecast):
        if point not in ("mean", "median"):
            raise ValueError("point must be mean or median")
        self.max_context_length, self.transforms, self.point, self.engine = max_context_length, transforms, point, engine

    def predict(self, context: Panel, future: Panel, quantiles: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), target: str = "target") -> DataFrame:
        """item, time, target (the point forecast) and a column for each quantile, for every row of future."""
        if not all(isinstance(q, float) and 0 <= q <= 1 for q in quantiles):
            raise ValueError("quantiles must be floats in [0, 1]")
        if not future.df.where(F.col(target).isNotNull()).isEmpty():
            raise ValueError("targets of the horizon must be null")
        lost = future.item_ids().join(context.item_ids(), future.item, "left_anti")
        if not lost.isEmpty():
            raise KeyError(f"items without context, such as {lost.first()[0]!r}")
        ready = context.drop_or_zero_missing(target).truncate_context(self.max_context_length)
        ready, future = ready.align_covariates(future, target)
        both = add_features(ready, future, self.transforms, target)
        item, ts = both.item, both.ts
        numeric = [c for c, k in both.df.dtypes if c not in (item, ts, target, "is_context") and k in ("int", "bigint", "smallint", "tinyint", "float", "double")]
        levels, point, engine = np.array(quantiles), self.point, self.engine
        names = [f"{q:g}" for q in quantiles]
        grid = np.unique(np.concatenate((levels, np.arange(1, 100) / 100)))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(ts)
            known = pdf["is_context"].to_numpy(bool)
            x = pdf[numeric].to_numpy(float)
            mean = np.nan_to_num(np.nanmean(np.where(known[:, None], x, np.nan), axis=0)) if known.any() and numeric else 0.0
            x = np.where(np.isnan(x), mean, x)
            late = pdf[~known]
            if not len(late):
                return pd.DataFrame({c: [] for c in (item, ts, "target", *names)})
            q = engine(x[known], pdf[target].to_numpy(float)[known], x[~known], grid)
            out = {item: late[item].to_numpy(), ts: late[ts].to_numpy(), "target": q.mean(axis=1) if point == "mean" else q[:, np.searchsorted(grid, 0.5)]}
            return pd.DataFrame(out | {n: q[:, np.searchsorted(grid, v)] for n, v in zip(names, levels, strict=True)})

        kind = dict(both.df.dtypes)[item]
        schema = f"`{item}` {kind}, `{ts}` timestamp_ntz, target double" + "".join(f", `{n}` double" for n in names)
        return both.df.select(item, ts, target, "is_context", *numeric).groupBy(item).applyInPandas(run, schema)

    def predict_df(self, context: DataFrame, future: DataFrame | None = None, prediction_length: int | None = None, quantiles: tuple[float, ...] = (0.1, 0.5, 0.9), freq: str | None = None) -> DataFrame:
        """The same from plain frames; a single series may come without item_id. Exactly one of future and prediction_length."""
        if (future is None) == (prediction_length is None):
            raise ValueError("give exactly one of future and prediction_length")
        named = lambda df: df if "item_id" in df.columns else df.withColumn("item_id", F.lit(0).cast("long"))
        panel = Panel(named(context).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")))
        if future is None:
            late = panel.build_horizon(prediction_length, freq)
        else:
            df = named(future).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
            late = Panel(df if "target" in df.columns else df.withColumn("target", F.lit(None).cast("double")))
        return self.predict(panel, late, quantiles)


def plot_table(predictions: DataFrame, context: Panel, low: str, high: str, rows: int = 100, truth: DataFrame | None = None) -> DataFrame:
    """What a plot would show: each item's last context rows and its forecast with the outer quantiles as a band."""
    past = context.tail(rows).df.select(context.item, context.ts, F.lit("context").alias("part"), F.col("target").cast("double").alias("value"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    late = predictions.select(context.item, context.ts, F.lit("forecast").alias("part"), F.col("target").alias("value"), F.col(low).alias("low"), F.col(high).alias("high"))
    out = past.union(late)
    return out if truth is None else out.union(truth.select(context.item, context.ts, F.lit("truth"), F.col("target").cast("double"), F.lit(None), F.lit(None)))


def linear_detrend(panel: Panel, target: str = "target", name: str = "detrended") -> Panel:
    """Residuals of each item's least-squares line over its row numbers, in windows alone."""
    w = Window.partitionBy(panel.item)
    df = panel.df.withColumn("__i", (F.row_number().over(panel.window()) - 1).cast("double"))
    slope, offset = F.regr_slope(F.col(target), F.col("__i")).over(w), F.regr_intercept(F.col(target), F.col("__i")).over(w)
    return panel.with_df(df.withColumn(name, F.col(target) - (slope * F.col("__i") + offset)).drop("__i"))


def hann_window(panel: Panel, target: str = "target", name: str = "windowed") -> Panel:
    n = F.count("*").over(Window.partitionBy(panel.item))
    i = F.row_number().over(panel.window()) - 1
    return panel.assign(**{name: F.when(n == 1, F.col(target)).otherwise(F.col(target) * (0.5 - 0.5 * F.cos(2 * np.pi * i / (n - 1))))})
