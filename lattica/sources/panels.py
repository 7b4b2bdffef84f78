"""Panels from frames, files and iterables, with the checks that a panel needs; model directories as sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.panel import Panel, add_steps


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in all float columns, so that aggregates and windows see one kind of missing."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(k)) for c, k in df.dtypes if k in ("float", "double")})


def from_frame(df: DataFrame, item: str | None = None, ts: str | None = None, static: DataFrame | None = None, validate: bool = True) -> Panel:
    """Renames the key columns, parses times and checks the result. An item_id column in the way becomes __item_id."""
    if item and item != "item_id":
        if "item_id" in df.columns:
            df = df.withColumnRenamed("item_id", "__item_id")
        df = df.withColumnRenamed(item, "item_id")
    if ts and ts != "timestamp":
        df = df.withColumnRenamed(ts, "timestamp")
    if missing := {"item_id", "timestamp"} - set(df.columns):
        raise ValueError(f"the frame lacks {sorted(missing)}")
    df = nan_to_null(df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")))
    kind = dict(df.dtypes)["item_id"]
    if kind not in ("string", "int", "bigint", "smallint", "tinyint"):
        raise ValueError(f"item_id must be a string or an integer, not {kind}")
    if validate and (bad := df.agg(F.count_if(F.col("item_id").isNull()).alias("i"), F.count_if(F.col("timestamp").isNull()).alias("t")).first()) and (bad["i"] or bad["t"]):
        raise ValueError(f"{bad['i']} null item ids and {bad['t']} null or unreadable timestamps")
    panel = Panel(df)
    return panel.with_static(static) if static is not None else panel


def from_path(spark: SparkSession, path: str, fmt: str | None = None, **keys) -> Panel:
    """A Parquet, CSV, JSON or ORC file or folder."""
    fmt = fmt or next((f for f in ("parquet", "csv", "json", "orc") if path.rstrip("/").endswith(f)), "parquet")
    reader = spark.read.option("header", True).option("inferSchema", True) if fmt == "csv" else spark.read
    return from_frame(reader.format(fmt).load(path), **keys)


def from_arrays(df: DataFrame, freq: str, item: str = "item_id", start: str = "start", target: str = "target") -> Panel:
    """One row a series: start and an array of targets become one row a time."""
    rows = df.select(item, start, F.posexplode(target).alias("__at", "target"))
    return Panel(nan_to_null(rows.select(F.col(item).alias("item_id"), add_steps(F.col(start).cast("timestamp_ntz"), F.col("__at"), freq).alias("timestamp"), "target")))


def from_iterable(spark: SparkSession, data: Iterable[dict], freq: str) -> Panel:
    """Dicts with `target` and `start`; an item's id is its position unless it brings an item_id."""
    rows = []
    for i, d in enumerate(data):
        if not isinstance(d, dict) or not {"target", "start"} <= set(d):
            raise ValueError("every element must be a dict with target and start")
        rows.append((d.get("item_id", i), str(d["start"]), [float(v) for v in d["target"]]))
    kind = "string" if any(isinstance(r[0], str) for r in rows) else "long"
    return from_arrays(spark.createDataFrame(rows, f"item_id {kind}, start string, target array<double>"), freq)


def check_features(df: DataFrame, fitted: list[tuple[str, str]]) -> None:
    """Names, order and number of columns must be those seen when fitting."""
    names, known = df.columns, [c for c, _ in fitted]
    if names == known:
        return
    if sorted(names) == sorted(known):
        raise ValueError("columns must be in the order seen when fitting")
    raise ValueError(f"columns differ from those seen when fitting: missing {[c for c in known if c not in names]}, unknown {[c for c in names if c not in known]}")
