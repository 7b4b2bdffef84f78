"""The fine-tuning protocol for the native predictor: chunks of context and query, evaluation, patience, best restored."""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window, functions as F

from .predictor import KernelPredictor

#: Chunks of fewer rows are dropped.
LEAST_CHUNK = 50


class Logger(Protocol):
    def setup(self, config: dict) -> None: ...
    def log_step(self, step: int, values: dict) -> None: ...
    def log_epoch(self, epoch: int, values: dict) -> None: ...
    def finish(self) -> None: ...


class NullLogger:
    def setup(self, config: dict) -> None: ...
    def log_step(self, step: int, values: dict) -> None: ...
    def log_epoch(self, epoch: int, values: dict) -> None: ...
    def finish(self) -> None: ...


class TableLogger(NullLogger):
    """Appends epochs to a metrics table when finished."""

    def __init__(self, spark, path: str):
        self.spark, self.path, self.rows = spark, path, []

    def log_epoch(self, epoch: int, values: dict) -> None:
        self.rows += [(epoch, k, float(v)) for k, v in values.items()]

    def finish(self) -> None:
        if self.rows:
            self.spark.createDataFrame(self.rows, "epoch int, metric string, value double").write.mode("append").parquet(self.path)


def assign_chunks(df: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """df with `chunk`: rows in a seeded random order, cut into chunks of about `size`; small chunks are dropped.

    A row's chunk is a hash bucket, so there is no global sort; sizes vary a little around `size`.
    """
    n = max(1, round(df.count() / size))
    out = df.withColumn("chunk", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n)).cast("int"))
    return out.withColumn("__n", F.count("*").over(Window.partitionBy("chunk"))).where(F.col("__n") >= min(LEAST_CHUNK, size)).drop("__n")


def chunk_count(rows: int, size: int) -> int:
    """Full chunks, and one more if the rest is large enough."""
    full, rest = divmod(rows, size)
    return full + (rest >= LEAST_CHUNK)


def split(df: DataFrame, key: str, query_share: float = 0.2, by: str | None = None, seed: int = 0) -> DataFrame:
    """df with `role`: context or query; with `by`, the share holds within each class (rank by hash in the class)."""
    h = F.xxhash64(key, F.lit(seed))
    if by is None:
        return df.withColumn("role", F.when(F.pmod(h, F.lit(10_000)) < int(query_share * 10_000), "query").otherwise("context"))
    w = Window.partitionBy(by).orderBy(h, key)
    return df.withColumn("role", F.when(F.percent_rank().over(w) < query_share, "query").otherwise("context"))


def coverage(df: DataFrame, y: str) -> bool:
    """Whether every query class is in the context, and there are at least two."""
    r = df.agg(F.collect_set(F.when(F.col("role") == "query", F.col(y))).alias("q"), F.collect_set(F.when(F.col("role") == "context", F.col(y))).alias("c")).first()
    return set(r["q"]) <= set(r["c"]) and len(r["c"]) >= 2


@dataclass
class TuneResult:
    best: float
    best_loss: float
    history: list[tuple[int, float, float]]


def tune_bandwidth(context: DataFrame, query: DataFrame, n_classes: int, start: float = 1.0, epochs: int = 8, patience: int = 3, budget_s: float = 600.0, logger: Logger | None = None) -> TuneResult:
    """Searches the bandwidth that gives the least log-loss on query rows (features, y): each epoch tries a factor around
    the best; the factor shrinks after an epoch without gain; stops on patience or time; the best is returned."""
    logger = logger or NullLogger()
    logger.setup({"start": start, "epochs": epochs, "patience": patience})
    began, step, idle, history = time.monotonic(), 2.0, 0, []

    def loss(h: float) -> float:
        out = KernelPredictor(h).class_logits(context, query, n_classes)
        z = F.aggregate("logits", F.lit(0.0), lambda a, v: a + F.exp(v))
        return out.agg(F.avg(F.log(z) - F.element_at("logits", F.col("y").cast("int") + 1))).first()[0]

    best, best_loss = start, loss(start)
    history.append((0, best, best_loss))
    for epoch in range(1, epochs + 1):
        tried = [(loss(h), h) for h in (best * step, best / step)]
        low, h = min(tried)
        history.append((epoch, h, low))
        logger.log_epoch(epoch, {"loss": low, "bandwidth": h})
        if low < best_loss - 1e-9:
            best, best_loss, idle = h, low, 0
        else:
            step, idle = step**0.5, idle + 1
        if idle >= patience or time.monotonic() - began > budget_s:
            break
    logger.finish()
    return TuneResult(best, best_loss, history)
