"""Metrics and losses as one aggregation each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.staging import staged
from .quantiles import pinball


def regression_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """mse, mae, r2."""
    e = F.col(y) - F.col(pred)
    return df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop(y) * F.count(y))).alias("r2"))


def log_loss(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Binary cross-entropy of probabilities p of class 1."""
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(p)))
    return df.agg(F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).alias("log_loss"))


def accuracy(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """ROC-AUC by rank sums. Rows are counted by distinct score first, and ranks are running sums over range
    partitions of the scores, so no task orders the whole table."""
    by = df.groupBy(score).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count("*").alias("n"))
    by = staged(by.orderBy(score).withColumn("__at", F.monotonically_increasing_id()), "scores").withColumn("__part", F.shiftright("__at", 33))
    parts = by.groupBy("__part").agg(F.sum("n").alias("__n"))
    ahead = parts.alias("p").join(parts.alias("q"), F.col("q.__part") < F.col("p.__part"), "left").groupBy(F.col("p.__part").alias("__part")).agg(F.coalesce(F.sum("q.__n"), F.lit(0)).alias("__ahead"))
    ranked = by.join(ahead, "__part").withColumn("__upto", F.col("__ahead") + F.sum("n").over(Window.partitionBy("__part").orderBy("__at")))
    rank = F.col("__upto") - (F.col("n") - 1) / 2
    pos, n = F.sum("pos"), F.sum("n")
    return ranked.agg(((F.sum(F.col("pos") * rank) - pos * (pos + 1) / 2) / (pos * (n - pos))).alias("auc"))


def auc_ovr(df: DataFrame, classes: list, y: str = "y", proba: str = "proba") -> dict:
    """Mean one-versus-rest AUC over classes; proba is an array in the order of classes."""
    each = {c: auc(df.select((F.col(y) == c).cast("int").alias("y"), F.element_at(proba, i + 1).alias("score"))).first()["auc"] for i, c in enumerate(classes)}
    return {"auc": sum(each.values()) / len(each), "by_class": each}


def pinball_loss(df: DataFrame, alpha: float, y: str = "y", pred: str = "pred") -> DataFrame:
    return df.agg(F.avg(pinball(F.col(y), F.col(pred), alpha)).alias("pinball"))


def cross_entropy(df: DataFrame, y: str = "y", proba: str = "proba") -> DataFrame:
    """Mean -log p of the true class; y is a zero-based class number."""
    return df.agg(F.avg(-F.log(F.greatest(F.lit(1e-15), F.element_at(proba, F.col(y).cast("int") + 1)))).alias("cross_entropy"))
