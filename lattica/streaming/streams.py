"""Structured Streaming: scoring streams against a fitted context, resampling with watermarks, the last rows of every
series as state, and sources and sinks of synthetic batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.panel import SECONDS, UNITS, parse_freq
from ..operators.predictor import ContextPredictor


def score_stream(stream: DataFrame, context: DataFrame, predictor: ContextPredictor, n_classes: int | None = None) -> DataFrame:
    """A stream of query rows (features) scored against a static context: class logits, or quantiles without n_classes."""
    return predictor.class_logits(context, stream, n_classes) if n_classes else predictor.quantiles(context, stream)


def resample_stream(stream: DataFrame, freq: str, item: str = "item_id", ts: str = "timestamp", target: str = "target", late: str = "1 hour") -> DataFrame:
    """Mean, sum, minimum, maximum and count of each item's windows; rows later than `late` are left out."""
    n, unit = parse_freq(freq)
    if unit not in SECONDS:
        raise ValueError("streams are resampled by seconds, minutes, hours, days or weeks")
    w = F.window(ts, f"{n} {UNITS[unit][0]}")
    agg = stream.withWatermark(ts, late).groupBy(item, w.alias("w")).agg(F.avg(target).alias("mean"), F.sum(target).alias("sum"), F.min(target).alias("min"), F.max(target).alias("max"), F.count(target).alias("n"))
    return agg.select(item, F.col("w.start").alias(ts), "mean", "sum", "min", "max", "n")


def last_rows_stream(stream: DataFrame, n: int, item: str = "item_id", ts: str = "timestamp", target: str = "target", idle: str = "7 days") -> DataFrame:
    """For every series touched in a batch, its last n (time, target) pairs so far: a bounded ring in keyed state.

    A series that stays silent for `idle` of processing time is forgotten.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = dict(stream.dtypes)[item]
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, values = state.get if state.exists else ([], [])
        pairs = list(zip(times, values, strict=True))
        for pdf in batches:
            pairs += list(zip([int(t.value) for t in pdf[ts]], pdf[target].astype(float).tolist(), strict=True))
            pairs = sorted(pairs, key=lambda p: p[0])[-n:]
        times, values = [p[0] for p in pairs], [p[1] for p in pairs]
        state.update((times, values))
        state.setTimeoutDuration(millis)
        yield pd.DataFrame({item: [key[0]], "times": [times], "targets": [values]})

    return stream.groupBy(item).applyInPandasWithState(run, f"{item} {kind}, times array<long>, targets array<double>", "times array<long>, targets array<double>", "update", GroupStateTimeout.ProcessingTimeTimeout)


def batch_files(spark: SparkSession, path: str, schema: str, per_trigger: int = 1, delete: bool = False) -> DataFrame:
    """A stream over batch files as they appear, a number of them at a time, deleted after use if asked."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    return (reader.option("cleanSource", "delete") if delete else reader).parquet(path)


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and reads what it gave, by `batch`. A batch that runs again replaces its own rows."""
    spark, kind = stream.sparkSession, stream.schema
    spark.createDataFrame([], kind).write.parquet(f"{path}/rows/batch=-1")  # a stream without rows gives none
    save = lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
    run = stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{path}/rows")


def write_batches(df: DataFrame, path: str, meta: dict | None = None) -> None:
    """Appends a batch under Spark's commit protocol; meta goes beside it as JSON."""
    import json

    df.write.mode("append").parquet(path)
    if meta:
        df.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}-meta")


class SyntheticSource(DataSource):
    """spark.read.format('lattica_synthetic'): options datasets, rows, features, classes, seed, per_partition."""

    @classmethod
    def name(cls) -> str:
        return "lattica_synthetic"

    def schema(self) -> str:
        return "dataset_id long, row_id int, features array<double>, y double, is_train boolean"

    def reader(self, schema) -> DataSourceReader:
        return _SyntheticReader(self.options)


class _SyntheticReader(DataSourceReader):
    def __init__(self, options):
        self.n, self.per = int(options.get("datasets", 4)), int(options.get("per_partition", 4))
        self.args = {k: int(options[k]) for k in ("rows", "features", "classes", "seed") if k in options}

    def partitions(self):
        return [InputPartition((i, min(i + self.per, self.n))) for i in range(0, self.n, self.per)]

    def read(self, partition):
        from ..operators.synthetic import make_dataset

        for d in range(*partition.value):
            x, y, n_train = make_dataset(d, **self.args)
            for i in range(len(y)):
                yield (d, i, [float(v) for v in x[i]], float(y[i]), i < n_train)
