"""Prediction from context rows without training: a kernel over prepared features behind a replaceable interface.

w(q, c) = exp(-|f(q) - f(c)|^2 / (2 h^2 d)) with h = n^(-1/(d+4)) by default. Classes: logit_k = ln(sum of w over context
rows of class k + eps). Regression: quantiles of the context targets weighted by w.

A context of at most BROADCAST_CELLS numbers travels to the executors as arrays and each query batch is scored in place,
without a shuffle. A larger one is cut into tiles; every query meets every tile, partial sums are added up by query.
No context is cut short here.
"""

from __future__ import annotations

import math
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import count_below
from ..sources.staging import staged

EPS = 1e-9
#: Numbers of a context (rows x columns) up to which it is broadcast: 64 MB.
BROADCAST_CELLS = 8_000_000
#: Numbers of a tile for quantiles: what two workers of an executor hold several times over.
TILE_CELLS = 500_000
#: Quantiles that a regression returns inside.
LEVELS = 999
#: Weights (queries x context rows) that a worker holds at once: 16 MB.
CHUNK_CELLS = 2_000_000


class ContextPredictor(Protocol):
    """Scores query rows against labelled context rows. Both frames hold `features ARRAY<DOUBLE>`."""

    def class_logits(self, context: DataFrame, query: DataFrame, n_classes: int) -> DataFrame: ...

    def quantiles(self, context: DataFrame, query: DataFrame) -> DataFrame: ...


def bandwidth(n: int, d: int) -> float:
    return max(n, 1) ** (-1.0 / (d + 4))


def chunk(n: int) -> int:
    """Query rows to score at once against n context rows."""
    return max(1, min(1024, CHUNK_CELLS // max(n, 1)))


def dealt(query: DataFrame) -> DataFrame:
    """Query rows dealt by number: against a whole context few bytes of them can be much work."""
    return query.repartition(int(query.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def once(query: DataFrame, values: dict[str, Column], score, kind: str) -> DataFrame:
    """query with the columns `kind` that score, a function of frames, adds to the columns `values`; equal values are scored once."""
    own = F.struct(*(v.alias(c) for c, v in values.items()))
    asked = query.select(own.alias("__own")).distinct()
    scored = dealt(asked.select("__own.*")).mapInPandas(score, ", ".join(f"`{c}` double" for c in values) + f", {kind}")
    added = [c for c in scored.columns if c not in values]
    scored = scored.select(F.struct(*(F.col(f"`{c}`") for c in values)).alias("__own"), *added)
    return query.withColumn("__own", own).join(scored, "__own").select(*(query[f"`{c}`"] for c in query.columns), *added)


def weigh(v: np.ndarray, x: np.ndarray, h: float, d: int) -> np.ndarray:
    """Kernel weights of query rows v against context rows x."""
    return np.exp(-np.maximum((v * v).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * v @ x.T, 0.0) / (2 * h * h * d))


def weighted_quantiles(y: np.ndarray, w: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Quantiles of values y (sorted) under each row of weights w: linear between the middles of the weights' steps."""
    total = w.sum(axis=1, keepdims=True)
    w = np.where(total > EPS, w / np.maximum(total, EPS), 1.0 / w.shape[1])
    middle = np.cumsum(w, axis=1) - w / 2
    return np.stack([np.interp(levels, m, y) for m in middle])


class KernelPredictor:
    """The default predictor. h: bandwidth, or None for the rule of thumb."""

    #: Distances don't depend on the order of features, nor class weights on that of classes: views that differ by
    #: permutations alone give the same scores and are scored once.
    order_invariant = True

    def __init__(self, h: float | None = None, broadcast_cells: int = BROADCAST_CELLS, levels: int = LEVELS):
        self.h, self.broadcast_cells, self.levels = h, broadcast_cells, levels

    def _size(self, context: DataFrame) -> tuple[int, int]:
        r = context.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).first()
        return r["n"], r["d"] or 1

    def _arrays(self, context: DataFrame, label: str) -> tuple[np.ndarray, np.ndarray]:
        got = context.select("features", F.col(label).cast("double").alias("y")).toPandas()
        x = np.stack(got["features"].map(np.asarray)) if len(got) else np.zeros((0, 1))
        return x, got["y"].to_numpy()

    def class_logits(self, context: DataFrame, query: DataFrame, n_classes: int) -> DataFrame:
        """query with `logits`. context: features, y (class number)."""
        sums = self.class_sums(context, query, n_classes)
        return sums.select(*query.columns, F.transform("sums", lambda v: F.log(v + EPS)).alias("logits"))

    def class_sums(self, context: DataFrame, query: DataFrame, n_classes: int) -> DataFrame:
        """query with `sums`: the weight of every class. context: features, y (class number)."""
        n, d = self._size(context)
        h = self.h or bandwidth(n, d)
        if n * d > self.broadcast_cells:
            return self._tiled_sums(context, query, n_classes, h, d, n)
        x, y = self._arrays(context, "y")
        one_hot = np.eye(n_classes)[y.astype(int)] if len(y) else np.zeros((0, n_classes))

        @F.pandas_udf("array<double>")
        def score(q: pd.Series) -> pd.Series:
            out, step = [], chunk(len(x))
            for at in range(0, len(q), step):
                v = np.stack(q.iloc[at : at + step].map(np.asarray))
                out += list(weigh(v, x, h, d) @ one_hot)
            return pd.Series(out)

        return query.withColumn("sums", score("features"))

    def _tiled_sums(self, context: DataFrame, query: DataFrame, n_classes: int, h: float, d: int, n: int) -> DataFrame:
        """Large contexts: each different query row is copied to every context tile; a tile is one group of about broadcast_cells numbers. Equal
        context rows travel as one with their number, so that copies don't meet in one tile."""
        tiles = math.ceil(n * d / self.broadcast_cells)
        names, asked = query.columns, query.select("features").distinct()
        sent = asked.withColumn("__tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
        parts = max(1, math.ceil(asked.count() / 100_000))
        sent = sent.withColumn("__part", F.pmod(F.xxhash64("features"), F.lit(parts)).cast("int"))
        held = context.groupBy("features", "y").agg(F.count("*").alias("c")).withColumn("__tile", F.pmod(F.xxhash64("features", "y"), F.lit(tiles)).cast("int")).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

        def add(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(c):
                return pd.DataFrame({"features": [], "sums": []}, dtype=object)
            x, hot = np.stack(c["features"].map(np.asarray)), np.eye(n_classes)[c["y"].to_numpy().astype(int)] * c["c"].to_numpy()[:, None]
            sums, step = [], chunk(len(x))
            for at in range(0, len(q), step):
                v = np.stack(q["features"].iloc[at : at + step].map(np.asarray))
                sums += list(weigh(v, x, h, d) @ hot)
            return pd.DataFrame({"features": q["features"], "sums": sums})

        met = sent.groupBy("__tile", "__part").cogroup(held.groupBy("__tile", "__part")).applyInPandas(add, "features array<double>, sums array<double>")
        sums = met.groupBy("features").agg(*(F.sum(F.element_at("sums", k + 1)).alias(f"s{k}") for k in range(n_classes)))
        out = query.join(sums, "features", "left")
        return out.select(*names, F.array(*(F.coalesce(F.col(f"s{k}"), F.lit(0.0)) for k in range(n_classes))).alias("sums"))

    def quantiles(self, context: DataFrame, query: DataFrame) -> DataFrame:
        """query with `quantiles`: LEVELS quantiles of y under the weights of all context rows. Equal context rows travel as
        one with their number; equal query rows are scored once."""
        n, d = self._size(context)
        h = self.h or bandwidth(n, d)
        held = context.groupBy("features", F.col("y").cast("double").alias("y")).agg(F.count("*").alias("c")).withColumn("k", F.xxhash64("features"))
        asked = query.select("features").distinct()
        if (cells := held.count() * d) > self.broadcast_cells:
            return query.join(self._tiled_quantiles(held, asked, h, d, n, math.ceil(cells / min(self.broadcast_cells, TILE_CELLS))), "features").select(*query.columns, "quantiles")
        got = held.toArrow()
        x, y, c = _sorted(got["features"].combine_chunks().flatten().to_numpy().reshape(-1, d), got["y"].to_numpy(), got["c"].to_numpy(), got["k"].to_numpy())
        levels = np.arange(1, self.levels + 1) / (self.levels + 1)

        @F.pandas_udf("array<double>")
        def score(q: pd.Series) -> pd.Series:
            out, step = [], chunk(len(x))
            for at in range(0, len(q), step):
                w = weigh(np.stack(q.iloc[at : at + step].map(np.asarray)), x, h, d)
                total = w @ c
                w[total <= EPS] = 1.0
                out += [np.interp(levels, *knots(y, c, r, 0.0, t)) for r, t in zip(w, np.where(total > EPS, total, n), strict=True)]
            return pd.Series(out)

        return query.join(dealt(asked).withColumn("quantiles", score("features")), "features").select(*query.columns, "quantiles")

    def _tiled_quantiles(self, held: DataFrame, asked: DataFrame, h: float, d: int, n: int, tiles: int) -> DataFrame:
        """Large contexts, staged and cut into tiles by y. A first pass sums up each tile's weights for each query row, so a second one knows
        the weight in front of its tile, and gives the levels that fall between the last row of the tile before and its own."""
        own, held = F.struct("y", "k"), staged(held, "context")
        # the sample sets where tiles begin, nothing else
        some = sorted(tuple(r[0]) for r in held.select(own).sample(min(1.0, 200 * tiles / held.count()), 0).collect())
        cuts = sorted({some[len(some) * i // tiles] for i in range(1, tiles)}) if some else []
        begins = F.arrays_zip(F.lit([float(y) for y, _ in cuts]).cast("array<double>").alias("y"), F.lit([k for _, k in cuts]).cast("array<long>").alias("k"))
        tile = count_below(begins, len(cuts), lambda b: b <= own) if cuts else F.lit(0)
        parts = max(1, math.ceil(asked.count() / 100_000))
        part = F.pmod(F.xxhash64("features"), F.lit(parts)).cast("int")
        held = held.withColumn("__tile", tile).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        sent = asked.withColumn("__part", part).withColumn("__tile", F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))))
        levels = np.arange(1, self.levels + 1) / (self.levels + 1)

        def met(q: pd.DataFrame, context: pd.DataFrame):
            """(rows of q, their weights against the tile's different features, which of them each context row has, y, c) piece by piece."""
            if len(q) and len(context):
                x, y, c = _sorted(np.stack(context["features"].map(np.asarray)), context["y"].to_numpy(), context["c"].to_numpy(), context["k"].to_numpy())
                x, at = np.unique(x, axis=0, return_inverse=True)
                for i in range(0, len(q), chunk(len(x))):
                    rows = q.iloc[i : i + chunk(len(x))]
                    yield rows, weigh(np.stack(rows["features"].map(np.asarray)), x, h, d), at.reshape(-1), y, c

        def first(q: pd.DataFrame, context: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"features": rows["features"], "__tile": rows["__tile"], "s": w @ np.bincount(at, c, w.shape[1]), "w": w[:, at[-1]], "m": c.sum(), "y": y[-1]}) for rows, w, at, y, c in met(q, context)]
            return pd.concat(out) if out else pd.DataFrame({k: [] for k in ("features", "__tile", "s", "w", "m", "y")}, dtype=object)

        def second(q: pd.DataFrame, context: pd.DataFrame) -> pd.DataFrame:
            features, values = [], []
            for rows, w, own, y, c in met(q, context):
                w[rows["flat"].to_numpy(bool)] = 1.0
                for f, r, before, total, low, at, high in zip(rows["features"], w, rows["before"], rows["total"], rows["low"], rows["at"], rows["high"], strict=True):
                    begin = 0 if np.isnan(low) else np.searchsorted(levels, low, "right")
                    end = len(levels) if np.isnan(high) else np.searchsorted(levels, high, "right")
                    if begin < end:
                        middle, ys = knots(y, c, r[own], before, total)
                        if not np.isnan(low):
                            middle, ys = np.append(low, middle), np.append(at, ys)
                        features.append(f)
                        values.append(np.interp(levels[begin:end], middle, ys))
            return pd.DataFrame({"features": features, "__tile": q["__tile"].iloc[0] if len(q) else 0, "v": values}, dtype=None if features else object)

        row = Window.partitionBy("features").orderBy("__tile")
        kind = "features array<double>, __tile int"
        by = lambda df: df.groupBy("__tile", "__part")
        sums = by(sent).cogroup(by(held)).applyInPandas(first, f"{kind}, s double, w double, m long, y double")
        sums = sums.withColumn("total", F.sum("s").over(Window.partitionBy("features"))).withColumn("flat", F.col("total") <= EPS)
        for c, flat in (("s", F.col("m").cast("double")), ("w", F.lit(1.0)), ("total", F.lit(float(n)))):
            sums = sums.withColumn(c, F.when(F.col("flat"), flat).otherwise(F.col(c)))
        sums = sums.withColumn("before", F.coalesce(F.sum("s").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        sums = sums.withColumn("high", (F.col("before") + F.col("s") - F.col("w") / 2) / F.col("total"))
        sums = sums.select("features", "__tile", "flat", "before", "total", F.lag("high").over(row).alias("low"), F.lag("y").over(row).alias("at"), F.when(F.lead("high").over(row).isNotNull(), F.col("high")).alias("high"))
        got = by(sums.withColumn("__part", part)).cogroup(by(held)).applyInPandas(second, f"{kind}, v array<double>")
        each = F.array_sort(F.collect_list(F.struct("__tile", "v")))
        return got.groupBy("features").agg(each.alias("t")).select("features", F.flatten(F.transform("t", lambda t: t["v"])).alias("quantiles"))


def _sorted(x: np.ndarray, y: np.ndarray, c: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context rows by y, and those of equal y by their hash k, as tiles are cut."""
    order = np.lexsort((k, y))
    return x[order], y[order], c[order]


def knots(y: np.ndarray, c: np.ndarray, w: np.ndarray, before: float, total: float) -> tuple[np.ndarray, np.ndarray]:
    """Quantile function of c copies of each y of weight w a copy: the middles of the first and the last copy's step, and y."""
    end = before + np.cumsum(w * c)
    return np.stack(((end - w * (c - 0.5)) / total, (end - w * 0.5) / total), axis=1).ravel(), np.repeat(y, 2)
