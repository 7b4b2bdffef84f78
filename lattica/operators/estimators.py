"""Classifier and regressor: encode, several views, the context predictor, and the mean over views."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.arrays import argmax, balanced_groups, softmax
from . import ensemble
from .predictor import ContextPredictor, KernelPredictor
from .preprocess import Pipeline, ToNumeric, encode_labels, masked_columns, non_constant

VERSION = "1"


@dataclass
class Settings:
    """Parameters of both estimators."""

    n_estimators: int = 4
    norms: tuple[str, ...] = ("none", "power")
    feature_shuffle: str = "latin"
    class_shuffle: str = "shift"
    outlier_threshold: float = 4.0
    temperature: float = 0.9
    max_context: int | None = 4096
    max_classes: int = 10
    seed: int = 42
    predictor: ContextPredictor = field(default_factory=KernelPredictor, repr=False)


class _Base:
    def __init__(self, **params):
        self.settings = Settings(**params)

    def get_params(self) -> dict:
        return {k: v for k, v in asdict(self.settings).items() if k != "predictor"}

    def _prepare(self, df: DataFrame, features: list[str]) -> DataFrame:
        """Learns the schema, the encoder, the columns that vary and the pipelines. Returns the encoded context."""
        self.schema = [(c, k) for c, k in df.select(*features).dtypes]
        self.encoder = ToNumeric(keep=("__y",)).fit(df.select("__y", *features))
        self.context = self.encoder.transform(df.select("__y", *features)).cache()
        names = [*self.encoder.categories, *self.encoder.means]
        self.names = non_constant(self.context, names) or names[:1]
        used = self.settings.norms[: max(1, self.settings.n_estimators)]
        self.pipelines = {m: Pipeline(m, self.settings.outlier_threshold).fit(self.context, self.names) for m in used}
        return self.context

    def _limit(self, df: DataFrame) -> DataFrame:
        """At most max_context rows, chosen by a seeded hash (a feature: the context's length is a parameter); all rows if None."""
        if self.settings.max_context is None:
            return df
        return df.orderBy(F.xxhash64(*df.columns, F.lit(self.settings.seed))).limit(self.settings.max_context).cache()

    def _sides(self, query: DataFrame, norm: str, masked: set[str]) -> tuple[DataFrame, DataFrame]:
        names = [c for c in self.names if c not in masked] or self.names[:1]
        # packed under another name first: a feature may be called features
        pack = lambda df: df.withColumn("__features", self.pipelines[norm].packed(names))
        return pack(self.limited).select(F.col("__features").alias("features"), F.col("__y").alias("y")), pack(query).drop(*self.names).withColumnRenamed("__features", "features")

    def _query(self, df: DataFrame, key: str) -> tuple[DataFrame, set[str]]:
        features = [c for c, _ in self.schema]
        if missing := [c for c in features if c not in df.columns]:
            raise ValueError(f"query lacks the columns {missing}")
        masked = set(masked_columns(df, features)) if features else set()
        return ToNumeric(keep=(key,), categories=self.encoder.categories, means=self.encoder.means).transform(df), masked

    def save(self, path: str, spark: SparkSession, with_context: bool = True) -> None:
        """A model directory: params.json as a one-row table and the context rows as Parquet."""
        meta = json.dumps({"version": VERSION, "kind": type(self).__name__, "params": self.get_params(), "features": [c for c, _ in self.schema]})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/params")
        if with_context:
            self.raw.write.mode("overwrite").parquet(f"{path}/context")

    @classmethod
    def load(cls, path: str, spark: SparkSession):
        meta = json.loads(spark.read.json(f"{path}/params").first()["meta"])
        if meta["version"] != VERSION:
            import warnings

            warnings.warn(f"model of version {meta['version']}, code of {VERSION}", stacklevel=2)
        params = {k: tuple(v) if isinstance(v, list) else v for k, v in meta["params"].items()}
        model = cls(**params)
        return model.fit(spark.read.parquet(f"{path}/context"), "__y", meta["features"])


class Classifier(_Base):
    """In-context classification; more classes than max_classes are split into groups, a group first and then a class in it."""

    def fit(self, df: DataFrame, y: str, features: list[str] | None = None) -> Classifier:
        features = features or [c for c in df.columns if c != y]
        self.classes, code = encode_labels(df, y)
        if not self.classes:
            raise ValueError("no labelled rows")
        self.raw = df.select(F.col(y).alias("__y"), *features)
        self._prepare(df.where(F.col(y).isNotNull()).withColumn("__y", code), features)
        self.limited = self._limit(self.context)
        k = len(self.classes)
        self.members = ensemble.members(self.settings.n_estimators, len(self.names), k if k <= self.settings.max_classes else None, tuple(self.pipelines), self.settings.feature_shuffle, self.settings.class_shuffle, self.settings.seed)
        return self

    def predict_proba(self, df: DataFrame, key: str) -> DataFrame:
        """key, proba (array in the order of `classes`)."""
        query, masked = self._query(df, key)
        k, s = len(self.classes), self.settings
        if k > s.max_classes:
            return self._grouped(query, masked, key)
        parts, chosen = None, [(m, 1.0) for m in self.members]
        if getattr(s.predictor, "order_invariant", False):
            first = {m.norm: m for m in reversed(self.members)}
            chosen = [(m, sum(x.norm == n for x in self.members) * len(first) / len(self.members)) for n, m in first.items()]
        for m, weight in chosen:
            context, q = self._sides(query, m.norm, masked)
            context = context.withColumn("y", ensemble.shuffle_label(F.col("y"), m.classes)) if m.classes else context
            logits = s.predictor.class_logits(context, q, k)
            own = ensemble.unshuffle(F.col("logits"), m.classes) if m.classes else F.col("logits")
            one = logits.select(key, F.transform(own, (lambda w: lambda v: v * w)(weight)).alias("logits"))
            parts = one if parts is None else parts.union(one)
        return ensemble.average_logits(parts, key, "logits", k, s.temperature).select(key, "proba")

    def _grouped(self, query: DataFrame, masked: set[str], key: str) -> DataFrame:
        """P(class) = P(group) * P(class in group), groups of near-equal sizes."""
        s, k = self.settings, len(self.classes)
        group = balanced_groups(k, s.max_classes)
        n = group[-1] + 1
        context, q = self._sides(query, next(iter(self.pipelines)), masked)
        to = F.element_at(F.lit(group).cast("array<int>"), F.col("y").cast("int") + 1)
        first = s.predictor.class_logits(context.withColumn("y", to), q, n).select(key, "features", softmax(F.col("logits"), s.temperature).alias("__p"))
        for g in range(n):
            own = [c for c in range(k) if group[c] == g]
            part = context.where(F.col("y").isin(own)).withColumn("y", F.col("y") - own[0])
            first = s.predictor.class_logits(part, first, len(own)).withColumn(f"__g{g}", softmax(F.col("logits"), s.temperature)).drop("logits")
        proba = F.concat(*(F.transform(F.col(f"__g{g}"), (lambda g: lambda v: v * F.element_at("__p", g + 1))(g)) for g in range(n)))
        return first.select(key, proba.alias("proba"))

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        """key, prediction: the label of the largest probability, the first of equals."""
        labels = F.lit(self.classes)
        return self.predict_proba(df, key).select(key, F.element_at(labels, (argmax(F.col("proba")) + 1).cast("int")).alias("prediction"), "proba")


class Regressor(_Base):
    """In-context regression: mean, median, variance and any quantiles, from a mean of the views' quantile vectors. All rows
    are context unless max_context is given."""

    def __init__(self, **params):
        super().__init__(**{"max_context": None} | params)

    def fit(self, df: DataFrame, y: str, features: list[str] | None = None) -> Regressor:
        features = features or [c for c in df.columns if c != y]
        df = df.where(F.col(y).isNotNull())
        r = df.agg(F.avg(y).alias("m"), F.stddev_pop(y).alias("s")).first()
        if r["m"] is None:
            raise ValueError("no labelled rows")
        self.mean, self.scale = r["m"], r["s"] or 1.0
        self.raw = df.select(F.col(y).alias("__y"), *features)
        self._prepare(df.withColumn("__y", (F.col(y) - self.mean) / self.scale), features)
        self.limited = self._limit(self.context)
        self.members = ensemble.members(self.settings.n_estimators, len(self.names), None, tuple(self.pipelines), self.settings.feature_shuffle, seed=self.settings.seed)
        return self

    def predict_quantiles(self, df: DataFrame, key: str) -> DataFrame:
        """key, quantiles: the members' mean, in units of y."""
        query, masked = self._query(df, key)
        # feature order doesn't change this kernel's distances, so members that differ by it alone are scored once
        weights = {m: sum(x.norm == m for x in self.members) for m in dict.fromkeys(x.norm for x in self.members)}
        out, names = query.select(key), []
        for i, (norm, n) in enumerate(weights.items()):
            context, q = self._sides(query, norm, masked)
            part = self.settings.predictor.quantiles(context, q).select(key, F.col("quantiles").alias(f"__q{i}"))
            out = part if i == 0 else out.join(part, key)
            names.append((f"__q{i}", n))
        total = sum(n for _, n in names)
        mean = F.transform(F.col(names[0][0]), lambda v: v * (names[0][1] / total))
        for c, n in names[1:]:
            mean = F.zip_with(mean, F.col(c), (lambda n: lambda a, b: a + b * (n / total))(n))
        return out.select(key, F.transform(F.array_sort(mean), lambda v: v * self.scale + self.mean).alias("quantiles"))

    def predict(self, df: DataFrame, key: str, outputs: tuple[str, ...] = ("mean",), alphas: tuple[float, ...] = ()) -> DataFrame:
        """key and the asked outputs: mean, median, variance, raw_quantiles; q_<alpha> for each level of alphas."""
        q = self.predict_quantiles(df, key)
        n = self.settings.predictor.levels
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"))
        add = lambda a, v: F.struct((a["s"] + v).alias("s"), (a["ss"] + (v - self.mean) * (v - self.mean)).alias("ss"))
        both = F.aggregate("quantiles", zero, add)
        sums, shift = both["s"] / n, both["s"] / n - self.mean
        at = lambda a: F.element_at("quantiles", max(1, min(n, round(a * (n + 1)))))
        known = {"mean": sums, "median": at(0.5), "variance": F.greatest(F.lit(0.0), (both["ss"] - n * shift * shift) / (n - 1)), "raw_quantiles": F.col("quantiles")}
        if unknown := [o for o in outputs if o not in known]:
            raise ValueError(f"unknown outputs {unknown}; known: {list(known)}")
        if bad := [a for a in alphas if not 0 <= a <= 1]:
            raise ValueError(f"levels outside [0, 1]: {bad}")
        return q.select(key, *(known[o].alias(o) for o in outputs), *(at(a).alias(f"q_{a:g}") for a in alphas))


def multi_target(model, df: DataFrame, targets: list[str], features: list[str], query: DataFrame, key: str, **predict) -> DataFrame:
    """One model a target; predictions side by side, named after their targets."""
    out = None
    for t in targets:
        p = model().fit(df, t, features).predict(query, key, **predict)
        p = p.select(key, *(F.col(c).alias(f"{t}_{c}") for c in p.columns if c != key))
        out = p if out is None else out.join(p, key)
    return out
