"""The library's queries over the driver tables, each with the SQL that DuckDB can run beside it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import arrays as A, metrics
from ..functions.calendar import PERIODS, calendar_features, fourier_features
from ..functions.quantiles import Quantiles, cummax_quantiles, isotonic_quantiles, sort_quantiles
from ..operators import ensemble, explain, forecast, preprocess, synthetic, tuning
from ..operators.estimators import Classifier, Regressor, multi_target
from ..operators.panel import Panel
from ..operators.predictor import KernelPredictor, bandwidth
from ..operators.unsupervised import Unsupervised
from ..sources.panels import from_arrays, from_frame, from_path
from ..sources.staging import new_path
from ..streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Rounded to 6 places; + 0 turns -0 to 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> Panel:
    """Events as a panel: user_id, ts, value; error events have no value."""
    df = table(spark, sf, "events")
    return Panel(df.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("target")), "user_id", "ts")


E = "e AS (SELECT user_id, ts::TIMESTAMP AS ts, event_id, CASE WHEN event_type <> 'error' THEN value END AS target FROM events)"
P = "p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e)"
_OUT = "user_id, ts, round(target, 6) + 0.0 AS target"


def _rows(p: Panel) -> DataFrame:
    return p.df.select("user_id", "ts", r6("target").alias("target"))


def _where(condition: str) -> str:
    return f"WITH {E}, {P} SELECT {_OUT} FROM p WHERE {condition}"


# -- flagship


@query(
    f"""WITH {E}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM e),
c AS (SELECT user_id, ts, target, true AS is_context FROM l WHERE k <= 24),
f AS (SELECT user_id, max(ts) + s * INTERVAL 1 HOUR AS ts, NULL::DOUBLE AS target, false AS is_context FROM e, range(1, 4) t(s) GROUP BY user_id, s),
b AS (SELECT * FROM c UNION ALL SELECT * FROM f)
SELECT user_id, ts, round(target, 6) + 0.0 AS target, is_context, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS running_index, year(ts) AS year,
 round(sin(2 * pi() * hour(ts) / 23), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 6), 6) + 0.0 AS weekday_cos FROM b"""
)
def context_and_horizon(spark, sf):
    """The last 24 events of every user and the next 3 hours, with running index and calendar features."""
    p = events(spark, sf)
    both = p.truncate_context(24).with_horizon(p.build_horizon(3, "h")).with_index()
    c = calendar_features(F.col("ts"))
    return both.df.select("user_id", "ts", r6("target").alias("target"), "is_context", "running_index", c["year"].alias("year"), r6(c["hour_of_day_sin"]).alias("hour_sin"), r6(c["day_of_week_cos"]).alias("weekday_cos"))


# -- rows by position and time


@query(_where("i < 5"))
def slice_head(spark, sf):
    return _rows(events(spark, sf).slice_by_timestep(None, 5))


@query(_where("i >= n - 7"))
def slice_tail(spark, sf):
    return _rows(events(spark, sf).tail(7))


@query(_where("i >= 3 AND i < 9"))
def slice_middle(spark, sf):
    return _rows(events(spark, sf).slice_by_timestep(3, 9))


@query(_where("i >= greatest(0, n - 10) AND i < greatest(0, n - 4)"))
def slice_negative(spark, sf):
    return _rows(events(spark, sf).slice_by_timestep(-10, -4))


@query(_where("i >= 50 AND i < greatest(0, n - 1)"))
def slice_past_end(spark, sf):
    return _rows(events(spark, sf).slice_by_timestep(50, -1))


@query(f"WITH {E}, {P} SELECT user_id::VARCHAR || '_train' AS user_id, ts, round(target, 6) + 0.0 AS target FROM p WHERE i < greatest(0, n - 2) - 6 AND i < greatest(0, n - 2)")
def train_split(spark, sf):
    return _rows(events(spark, sf).train_test_split(6, -2, "_train")[0])


@query(_where("i < greatest(0, n - 2)"))
def test_split(spark, sf):
    return _rows(events(spark, sf).train_test_split(6, -2)[1])


@query(f"WITH {E}, {P} SELECT user_id, ts, event_id FROM p WHERE i >= n - 4")
def scoring_known(spark, sf):
    return events(spark, sf).scoring_inputs(4, ["event_id"])[1]


@query(_where("i < greatest(0, n - 4)"))
def scoring_past(spark, sf):
    return _rows(events(spark, sf).scoring_inputs(4, ["event_id"])[0])


@query(f"WITH {E} SELECT {_OUT} FROM e WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12 06:00:00'")
def slice_time(spark, sf):
    return _rows(events(spark, sf).slice_by_time("2024-01-05", "2024-01-12 06:00:00"))


@query(f"WITH {E} SELECT user_id, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS before, count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS after FROM e GROUP BY user_id")
def split_time(spark, sf):
    a, b = events(spark, sf).split_by_time("2024-01-15")
    tag = lambda p, side: p.df.select("user_id", F.lit(side).alias("side"))
    both = tag(a, 0).union(tag(b, 1))
    return both.groupBy("user_id").agg(F.count_if(F.col("side") == 0).alias("before"), F.count_if(F.col("side") == 1).alias("after"))


# -- missing values


def _fill(expr: str, also: str = "") -> str:
    return f"WITH {E}, {P}{also} SELECT user_id, ts, round({expr}, 6) + 0.0 AS target FROM p"


_BEFORE = "last_value(target IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_AFTER = "first_value(target IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(_fill(f"coalesce({_BEFORE}, {_AFTER})"))
def fill_auto(spark, sf):
    return _rows(events(spark, sf).fill_missing("auto", columns=["target"]))


@query(_fill(_BEFORE))
def fill_forward(spark, sf):
    return _rows(events(spark, sf).fill_missing("ffill", columns=["target"]))


@query(_fill(_AFTER))
def fill_backward(spark, sf):
    return _rows(events(spark, sf).fill_missing("bfill", columns=["target"]))


@query(_fill("coalesce(target, -1.5)"))
def fill_constant(spark, sf):
    return _rows(events(spark, sf).fill_missing("constant", -1.5, ["target"]))


@query(
    f"""WITH {E}, {P}, q AS (SELECT *, {_BEFORE} AS v0, {_AFTER} AS v1, {_BEFORE.replace('target', 'CASE WHEN target IS NOT NULL THEN i END')} AS i0,
 {_AFTER.replace('target', 'CASE WHEN target IS NOT NULL THEN i END')} AS i1 FROM p)
SELECT user_id, ts, round(CASE WHEN target IS NOT NULL OR v0 IS NULL THEN target WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (i - i0) / (i1 - i0) END, 6) + 0.0 AS target FROM q"""
)
def fill_interpolate(spark, sf):
    return _rows(events(spark, sf).fill_missing("interpolate", columns=["target"]))


@query(f"WITH {E} SELECT {_OUT} FROM e WHERE target IS NOT NULL")
def drop_missing(spark, sf):
    return _rows(events(spark, sf).dropna("any"))


@query(
    f"""WITH {E}, z AS (SELECT user_id, ts, CASE WHEN user_id % 5 = 0 THEN NULL ELSE target END AS target FROM e), c AS (SELECT *, count(target) OVER (PARTITION BY user_id) AS k FROM z)
SELECT user_id, ts, round(CASE WHEN k <= 1 THEN coalesce(target, 0) ELSE target END, 6) + 0.0 AS target FROM c WHERE k <= 1 OR target IS NOT NULL"""
)
def drop_or_zero(spark, sf):
    p = events(spark, sf)
    return _rows(p.assign(target=F.when(F.col("user_id") % 5 != 0, F.col("target"))).drop_or_zero_missing())


# -- resampling and horizons


def _resample(agg: str, also: str = "") -> str:
    return f"""WITH {E}, b AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS d, {agg} AS v FROM e GROUP BY ALL),
s AS (SELECT user_id, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS d FROM b GROUP BY user_id)
SELECT s.user_id, s.d::TIMESTAMP AS ts, round({'coalesce(v, 0)' if also else 'v'}, 6) + 0.0 AS target FROM s LEFT JOIN b ON b.user_id = s.user_id AND b.d = s.d"""


def _daily(spark, sf, how: str) -> DataFrame:
    p = events(spark, sf)
    return _rows(p.with_df(p.df.drop("event_id")).convert_frequency("D", how))


@query(_resample("avg(target)"))
def resample_mean(spark, sf):
    return _daily(spark, sf, "mean")


@query(_resample("sum(target)", "0"))
def resample_sum(spark, sf):
    return _daily(spark, sf, "sum")


@query(_resample("median(target)"))
def resample_median(spark, sf):
    return _daily(spark, sf, "median")


@query(_resample("max(target)"))
def resample_max(spark, sf):
    return _daily(spark, sf, "max")


@query(_resample("arg_min(target, ts) FILTER (target IS NOT NULL)"))
def resample_first(spark, sf):
    return _daily(spark, sf, "first")


@query(_resample("arg_max(target, ts) FILTER (target IS NOT NULL)"))
def resample_last(spark, sf):
    return _daily(spark, sf, "last")


_PRIORITY = "o_orderpriority AS item_id"


@query(
    """WITH b AS (SELECT o_orderpriority AS item_id, date_trunc('quarter', o_orderdate)::TIMESTAMP AS d, avg(o_totalprice) AS v FROM orders GROUP BY ALL),
s AS (SELECT item_id, unnest(generate_series(min(d), max(d), INTERVAL 3 MONTH)) AS d FROM b GROUP BY item_id)
SELECT s.item_id, (s.d + INTERVAL 3 MONTH - INTERVAL 1 DAY)::TIMESTAMP AS ts, round(v, 4) + 0.0 AS target FROM s LEFT JOIN b ON b.item_id = s.item_id AND b.d = s.d"""
)
def resample_quarter_end(spark, sf):
    """Mean order value by priority and quarter, labelled with the quarter's last day."""
    df = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("item_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_totalprice").alias("target"))
    out = Panel(df, "item_id", "ts").convert_frequency("QE", "mean").df
    return out.select("item_id", "ts", (F.round("target", 4) + 0.0).alias("target"))


def _ticks(step: str) -> str:
    return f"""WITH {E}, o AS (SELECT user_id, date_trunc('day', min(ts)) AS o FROM e GROUP BY user_id),
b AS (SELECT user_id, o, epoch_us(ts - o) // epoch_us({step}) AS k, sum(target) AS v, count(*) AS n FROM e JOIN o USING (user_id) GROUP BY ALL),
s AS (SELECT user_id, o, unnest(range(min(k), max(k) + 1)) AS k FROM b GROUP BY user_id, o)
SELECT s.user_id, (s.o + s.k * {step})::TIMESTAMP AS ts, round(coalesce(v, 0), 6) + 0.0 AS target, coalesce(n, 0) AS n FROM s LEFT JOIN b ON b.user_id = s.user_id AND b.k = s.k"""


def _counted(spark, sf, freq: str) -> DataFrame:
    """Sums and numbers of rows of the events' periods."""
    p = events(spark, sf)
    return p.with_df(p.df.drop("event_id").withColumn("n", F.lit(1).cast("long"))).convert_frequency(freq, "sum").df.select("user_id", "ts", r6("target").alias("target"), "n")


@query(_ticks("INTERVAL 2 DAY"))
def resample_2days(spark, sf):
    return _counted(spark, sf, "2D")


@query(_ticks("INTERVAL 5 HOUR"))
def resample_5hours(spark, sf):
    return _counted(spark, sf, "5h")


@query(_ticks("INTERVAL 36 HOUR"))
def resample_36hours(spark, sf):
    return _counted(spark, sf, "36h")


def _periods(number: str, shown: str, ends: bool) -> str:
    """Sums over two calendar periods; number: a period's, shown: the label of period p."""
    return f"""WITH r AS (SELECT o_orderpriority AS item_id, {number} AS p, o_totalprice AS v FROM orders),
o AS (SELECT item_id, min(p) AS o FROM r GROUP BY item_id),
b AS (SELECT item_id, o, (p - o + {int(ends)}) // 2 AS k, sum(v) AS v, count(*) AS n FROM r JOIN o USING (item_id) GROUP BY ALL),
s AS (SELECT item_id, o, unnest(range(min(k), max(k) + 1)) AS k FROM b GROUP BY item_id, o),
t AS (SELECT s.item_id, s.o + 2 * s.k AS p, v, n FROM s LEFT JOIN b ON b.item_id = s.item_id AND b.k = s.k)
SELECT item_id, ({shown})::TIMESTAMP AS ts, round(coalesce(v, 0), 2) + 0.0 AS target, coalesce(n, 0) AS n FROM t"""


def _orders_by(spark, sf, freq: str) -> DataFrame:
    df = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("item_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_totalprice").alias("target"), F.lit(1).cast("long").alias("n"))
    return Panel(df, "item_id", "ts").convert_frequency(freq, "sum").df.select("item_id", "ts", (F.round("target", 2) + 0.0).alias("target"), "n")


@query(_periods("date_diff('week', DATE '1969-12-29', o_orderdate::DATE)", "DATE '1970-01-04' + p::INT * 7", True))
def resample_2weeks(spark, sf):
    return _orders_by(spark, sf, "2W")


@query(_periods("year(o_orderdate) * 12 + month(o_orderdate) - 1", "make_date(p // 12, p % 12 + 1, 1)", False))
def resample_2month_starts(spark, sf):
    return _orders_by(spark, sf, "2MS")


@query(_periods("year(o_orderdate) * 4 + quarter(o_orderdate) - 1", "last_day(make_date(p // 4, p % 4 * 3 + 3, 1))", True))
def resample_2quarter_ends(spark, sf):
    return _orders_by(spark, sf, "2QE")


@query(f"WITH {E} SELECT user_id, max(ts) + s * INTERVAL 6 HOUR AS ts FROM e, range(1, 6) t(s) GROUP BY user_id, s")
def horizon(spark, sf):
    return events(spark, sf).build_horizon(5, "6h").df.select("user_id", "ts")


@query("SELECT o_orderpriority AS item_id, last_day(date_trunc('month', max(o_orderdate)) + s * INTERVAL 1 MONTH)::TIMESTAMP AS ts FROM orders, range(1, 5) t(s) GROUP BY o_orderpriority, s")
def horizon_month_end(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("item_id"), F.last_day("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_totalprice").alias("target"))
    return Panel(df, "item_id", "ts").build_horizon(4, "ME").df.select("item_id", "ts")


# -- counts and order


@query("SELECT user_id, count(*) AS num_timesteps FROM events GROUP BY user_id")
def timesteps_per_item(spark, sf):
    return events(spark, sf).num_timesteps()


@query("SELECT count(DISTINCT user_id) AS num_items FROM events")
def item_count(spark, sf):
    return events(spark, sf).num_items()


@query("SELECT DISTINCT user_id FROM events")
def item_list(spark, sf):
    return events(spark, sf).item_ids()


@query("SELECT user_id, max(ts)::TIMESTAMP AS last_timestamp FROM events GROUP BY user_id")
def last_timestamps(spark, sf):
    return events(spark, sf).last_timestamp()


@query(f"WITH {E} SELECT user_id, count(target) AS num_valid FROM e GROUP BY user_id")
def valid_counts(spark, sf):
    return events(spark, sf).valid_counts()


@query("WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), s AS (SELECT user_id, n, sum(n) OVER (ORDER BY user_id)::BIGINT AS stop FROM c) SELECT user_id, (stop - n)::BIGINT AS start, stop FROM s")
def item_offsets(spark, sf):
    return events(spark, sf).indptr()


@query(f"WITH {E}, {P} SELECT user_id, ts, i AS running_index FROM p")
def running_index(spark, sf):
    return events(spark, sf).with_index().df.select("user_id", "ts", "running_index")


@query("WITH e AS (SELECT user_id, ts::TIMESTAMP AS ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events) SELECT user_id, ts, round(CASE WHEN i = 1 THEN 0 ELSE d END, 6) + 0.0 AS diff FROM e")
def first_difference(spark, sf):
    p = events(spark, sf)
    p = Panel(table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value"), "user_id", "ts")
    return p.first_difference("value").df.select("user_id", "ts", r6("diff").alias("diff"))


@query(
    """WITH b AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS d FROM events GROUP BY ALL), s AS (SELECT user_id, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS d FROM b GROUP BY user_id)
SELECT user_id, CASE WHEN count(*) >= 3 THEN 'D' END AS freq FROM s GROUP BY user_id"""
)
def frequency_daily(spark, sf):
    """The frequency found in the daily resampled panel."""
    p = events(spark, sf)
    return p.with_df(p.df.drop("event_id")).convert_frequency("D", "mean").frequencies()


@query("SELECT user_id, CASE WHEN count(*) >= 3 THEN 'IRREG' END AS freq FROM events GROUP BY user_id")
def frequency_irregular(spark, sf):
    return events(spark, sf).frequencies()


@query(
    """SELECT user_id, (TIMESTAMP '2024-01-01' + (i - 1) * INTERVAL 1 HOUR)::TIMESTAMP AS timestamp, v AS target
FROM (SELECT user_id, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM (SELECT user_id, list(round(value, 6) ORDER BY ts) AS l FROM events GROUP BY user_id))"""
)
def panel_from_arrays(spark, sf):
    """Arrays of values with a start and a frequency become rows."""
    df = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", F.round("value", 6).alias("v")))), lambda s: s["v"]).alias("target"))
    p = from_arrays(df.withColumn("start", F.lit("2024-01-01 00:00:00")), "h", item="user_id")
    return p.df.select(F.col("item_id").alias("user_id"), "timestamp", "target")


# -- features of time


@query(
    "SELECT event_id, year(ts) AS year, "
    + ", ".join(
        f"round({f}(2 * pi() * ({v}) / {PERIODS[k] - 1}), 6) + 0.0 AS {k}_{f}"
        for k, v in {"second_of_minute": "floor(second(ts))", "minute_of_hour": "minute(ts)", "hour_of_day": "hour(ts)", "day_of_week": "isodow(ts) - 1", "day_of_month": "day(ts) - 1", "day_of_year": "dayofyear(ts) - 1", "week_of_year": "weekofyear(ts) - 1", "month_of_year": "month(ts) - 1"}.items()
        for f in ("sin", "cos")
    )
    + " FROM events"
)
def calendar_encoder(spark, sf):
    df = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return df.select("event_id", *((c if k == "year" else r6(c)).alias(k) for k, c in calendar_features(F.col("ts")).items()))


@query(f"WITH {E}, {P} SELECT user_id, ts, " + ", ".join(f"round({f}(2 * pi() * i / {v}), 6) + 0.0 AS {f}_{v}" for v in (7, 24) for f in ("sin", "cos")) + " FROM p")
def fourier_encoder(spark, sf):
    p = events(spark, sf)
    cols = fourier_features(F.row_number().over(p.window()) - 1, [7, 24])
    return p.df.select("user_id", "ts", *(c.alias(k) for k, c in cols.items())).select("user_id", "ts", *(r6(k).alias(k) for k in cols))


_DAILY_VALUE = "v AS (SELECT user_id, ts::TIMESTAMP AS ts, value AS target, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


@query(f"WITH {_DAILY_VALUE}, l AS (SELECT user_id, regr_slope(target, i) AS a, regr_intercept(target, i) AS b FROM v GROUP BY user_id) SELECT v.user_id, v.ts, round(target - (a * i + b), 5) + 0.0 AS detrended FROM v JOIN l ON l.user_id = v.user_id")
def detrend_linear(spark, sf):
    p = Panel(table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("target")), "user_id", "ts")
    return forecast.linear_detrend(p).df.select("user_id", "ts", (F.round("detrended", 5) + 0.0).alias("detrended"))


@query(f"WITH {_DAILY_VALUE} SELECT user_id, ts, round(CASE WHEN n = 1 THEN target ELSE target * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) END, 6) + 0.0 AS windowed FROM v")
def hann_window(spark, sf):
    p = Panel(table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("target")), "user_id", "ts")
    return forecast.hann_window(p).df.select("user_id", "ts", r6("windowed").alias("windowed"))


# -- joins and sets


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def static_features_join(spark, sf):
    """Orders as a panel of customers, joined to the customers' static features."""
    orders = table(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), "o_orderkey")
    static = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    known = orders.join(static.select("o_custkey"), "o_custkey", "left_semi")
    return Panel(known, "o_custkey", "ts").with_static(static).join_static().select("o_orderkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def items_without_context(spark, sf):
    """Ids of one side that the other lacks."""
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("WITH c AS (SELECT DISTINCT l_returnflag AS v FROM lineitem WHERE l_orderkey % 5 = 0), d AS (SELECT DISTINCT l_returnflag AS v FROM lineitem WHERE l_orderkey % 5 <> 0) SELECT (SELECT count(*) FROM (SELECT v FROM c EXCEPT SELECT v FROM d)) = 0 AS contained, (SELECT list(v ORDER BY v) FROM c) = (SELECT list(v ORDER BY v) FROM d) AS equal")
def class_coverage(spark, sf):
    """Whether the query side's classes are all seen in the context, and whether both sides have the same."""
    df = table(spark, sf, "lineitem").groupBy().agg(F.array_sort(F.collect_set(F.when(F.col("l_orderkey") % 5 == 0, F.col("l_returnflag")))).alias("q"), F.array_sort(F.collect_set(F.when(F.col("l_orderkey") % 5 != 0, F.col("l_returnflag")))).alias("c"))
    return df.select((F.size(F.array_except("q", "c")) == 0).alias("contained"), (F.col("q") == F.col("c")).alias("equal"))


# -- preprocessing

_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark, sf) -> DataFrame:
    """lineitem's numbers, null where l_linenumber = 3."""
    keep = F.col("l_linenumber") != 3
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *(F.when(keep, F.col(c)).alias(c) for c in _NUMS))


_LINES = "l AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"CASE WHEN l_linenumber <> 3 THEN {c} END AS {c}" for c in _NUMS) + " FROM lineitem)"


@query(f"WITH {_LINES}, s AS (SELECT " + ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) + 1e-6 AS s{i}" for i, c in enumerate(_NUMS)) + " FROM l) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(CASE WHEN {c} IS NOT NULL THEN greatest(-100, least(100, ({c} - m{i}) / s{i})) END, 5) + 0.0 AS {c}" for i, c in enumerate(_NUMS)) + " FROM l, s")
def standard_scale(spark, sf):
    df = _lines(spark, sf)
    out = preprocess.Standard().fit(df, _NUMS).transform(df)
    return out.select("l_orderkey", "l_linenumber", *((F.round(c, 5) + 0.0).alias(c) for c in _NUMS))


@query(f"WITH {_LINES}, s AS (SELECT " + ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(_NUMS)) + " FROM l) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(coalesce({c}, m{i}), 5) + 0.0 AS {c}" for i, c in enumerate(_NUMS)) + " FROM l, s")
def mean_impute(spark, sf):
    df = _lines(spark, sf)
    out = preprocess.ToNumeric(keep=("l_orderkey", "l_linenumber")).fit(df).transform(df)
    return out.select("l_orderkey", "l_linenumber", *((F.round(c, 5) + 0.0).alias(c) for c in _NUMS))


_X = "x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 997 = 0 THEN l_extendedprice * 100 ELSE l_extendedprice END AS x FROM lineitem)"
_B = "a AS (SELECT avg(x) AS m, greatest(stddev_samp(x), 1e-6) AS s FROM x), i AS (SELECT avg(x) AS m, greatest(stddev_samp(x), 1e-6) AS s FROM x WHERE abs(x - (SELECT m FROM a)) <= 4 * (SELECT s FROM a))"


def _outlying(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 997 == 0, F.col("l_extendedprice") * 100).otherwise(F.col("l_extendedprice")).alias("x"))


@query(f"WITH {_X}, {_B}, c AS (SELECT l_orderkey, l_linenumber, greatest(i.m - 4 * i.s - ln(1 + abs(x)), x) AS x, i.m + 4 * i.s AS hi FROM x, i) SELECT l_orderkey, l_linenumber, round(least(hi + ln(1 + abs(x)), x), 4) + 0.0 AS x FROM c")
def outlier_soft_clip(spark, sf):
    df = _outlying(spark, sf)
    return preprocess.OutlierClip().fit(df, ["x"]).transform(df).withColumn("x", F.round("x", 4) + 0.0)


@query(f"WITH {_X}, {_B} SELECT l_orderkey, l_linenumber, round(greatest(i.m - 4 * i.s, least(i.m + 4 * i.s, x)), 4) + 0.0 AS x FROM x, i")
def outlier_hard_clip(spark, sf):
    return preprocess.hard_clamp_outliers(_outlying(spark, sf), ["x"]).withColumn("x", F.round("x", 4) + 0.0)


@query("WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS m, quantile_cont(p_retailprice, 0.75) AS b FROM part) SELECT p_partkey, round((p_retailprice - m) / ((b - a) / 1.3489795003921634), 6) + 0.0 AS x FROM part, q")
def robust_scale(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("x"))
    return preprocess.Robust().fit(df, ["x"]).transform(df).withColumn("x", r6("x"))


@query(
    """WITH b AS (SELECT DISTINCT p_brand FROM part WHERE p_brand <> 'Brand#13'), c AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS k FROM b),
t AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS k FROM (SELECT DISTINCT p_type FROM part WHERE p_brand <> 'Brand#13'))
SELECT p_partkey, coalesce(c.k, -1)::DOUBLE AS p_brand, coalesce(t.k, -1)::DOUBLE AS p_type, p_size::DOUBLE AS p_size FROM part LEFT JOIN c ON c.p_brand = part.p_brand LEFT JOIN t ON t.p_type = part.p_type"""
)
def ordinal_encode(spark, sf):
    """Codes learnt without Brand#13, applied to all parts: the unknown brand becomes -1."""
    df = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return preprocess.ToNumeric(keep=("p_partkey",)).fit(df.where("p_brand <> 'Brand#13'")).transform(df)


@query("SELECT unnest(['l_discount', 'l_quantity']) AS kept")
def constant_filter(spark, sf):
    """Columns that vary, of two that do and one constant."""
    df = table(spark, sf, "lineitem").select("l_discount", "l_quantity", F.lit(1).alias("one"))
    return spark.createDataFrame([(c,) for c in preprocess.non_constant(df, df.columns)], "kept string")


@query("SELECT 'l_discount' AS col, false AS categorical UNION ALL SELECT 'l_linenumber', (SELECT count(DISTINCT l_linenumber) <= 10 FROM lineitem) UNION ALL SELECT 'l_quantity', (SELECT count(DISTINCT l_quantity) <= 10 FROM lineitem)")
def infer_categorical(spark, sf):
    df = table(spark, sf, "lineitem").select("l_discount", "l_linenumber", "l_quantity")
    return spark.createDataFrame(sorted(preprocess.is_categorical(df, df.columns).items()), "col string, categorical boolean")


@query("SELECT median(s_acctbal) AS median, min(k) AS mode FROM supplier, (SELECT s_nationkey AS k FROM supplier GROUP BY 1 HAVING count(*) = (SELECT max(c) FROM (SELECT count(*) AS c FROM supplier GROUP BY s_nationkey)))")
def median_and_mode(spark, sf):
    """Warm starts of imputation: the median of numbers, the smallest of the most frequent categories."""
    return table(spark, sf, "supplier").agg(F.median("s_acctbal").alias("median"), F.mode("s_nationkey", True).alias("mode"))


@query("SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::INTEGER AS code FROM part")
def label_encode(spark, sf):
    df = table(spark, sf, "part")
    _, code = preprocess.encode_labels(df, "p_brand")
    return df.select("p_partkey", code.alias("code"))


@query("WITH m AS (SELECT median(p_retailprice) AS m FROM part) SELECT p_partkey, (p_retailprice > m)::INTEGER AS y FROM part, m")
def median_binarize(spark, sf):
    df = table(spark, sf, "part")
    m = df.agg(F.median("p_retailprice")).first()[0]
    return df.select("p_partkey", (F.col("p_retailprice") > m).cast("int").alias("y"))


@query("WITH b AS (SELECT [quantile_cont(p_retailprice, 0.2), quantile_cont(p_retailprice, 0.5), quantile_cont(p_retailprice, 0.9)] AS b FROM part) SELECT p_partkey, len(list_filter(b, lambda v: v < p_retailprice))::INTEGER AS y FROM part, b")
def boundary_classes(spark, sf):
    """Classes by the number of boundaries below a value."""
    df = table(spark, sf, "part")
    b = df.agg(F.percentile("p_retailprice", F.array(F.lit(0.2), F.lit(0.5), F.lit(0.9)))).first()[0]
    return df.select("p_partkey", F.size(F.filter(F.lit(b).cast("array<double>"), lambda v: v < F.col("p_retailprice"))).alias("y"))


# -- arrays, permutations, classes

_PERM = [3, 1, 4, 0, 2, 7, 9, 8, 6, 5]


@query(f"SELECT vec_id, ({_PERM})[label + 1]::INTEGER AS shuffled, label FROM embeddings")
def class_shuffle(spark, sf):
    df = table(spark, sf, "embeddings")
    inv = A.inverse_permutation(_PERM)
    y = ensemble.shuffle_label(F.col("label").cast("int"), tuple(_PERM))
    return df.select("vec_id", y.alias("shuffled"), ensemble.shuffle_label(y, tuple(inv)).cast(dict(df.dtypes)["label"]).alias("label"))


@query("SELECT vec_id, round(list_sum(list_transform(range(64), lambda i: embedding[(i + 1) % 64 + 1]::DOUBLE * embedding[(i + 2) % 64 + 1] * embedding[(i + 4) % 64 + 1])), 6) + 0.0 AS mixed FROM embeddings")
def circular_groups(spark, sf):
    """Sum over places of the product of their circular group (i+1, i+2, i+4)."""
    g = A.circular_groups(F.transform("embedding", lambda v: v.cast("double")), 64)
    s = F.aggregate(g, F.lit(0.0), lambda a, v: a + F.element_at(v, 1) * F.element_at(v, 2) * F.element_at(v, 3))
    return table(spark, sf, "embeddings").select("vec_id", r6(s).alias("mixed"))


@query("SELECT p_partkey, ((p_partkey % 37) // 7)::INTEGER AS d0, ((p_partkey % 37) % 7)::INTEGER AS d1 FROM part")
def mixed_radix(spark, sf):
    bases = A.mixed_radix_bases(37)
    y = (F.col("p_partkey") % 37).cast("int")
    return table(spark, sf, "part").select("p_partkey", A.mixed_radix_digit(y, bases, 0).cast("int").alias("d0"), A.mixed_radix_digit(y, bases, 1).cast("int").alias("d1"))


@query("WITH c AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS k FROM (SELECT DISTINCT p_brand FROM part)) SELECT p_brand, (CASE WHEN k < 9 THEN 0 WHEN k < 17 THEN 1 ELSE 2 END)::INTEGER AS grp FROM c")
def class_groups(spark, sf):
    """25 brands in three near-equal groups of at most ten."""
    df = table(spark, sf, "part").select("p_brand").distinct()
    labels, code = preprocess.encode_labels(df, "p_brand")
    return df.select("p_brand", F.element_at(F.lit(A.balanced_groups(len(labels))).cast("array<int>"), code + 1).alias("grp"))


@query("WITH l AS (SELECT vec_id, list_transform(embedding[1:5], lambda v: v::DOUBLE * 3) AS l FROM embeddings), e AS (SELECT vec_id, list_transform(l, lambda v: exp((v - list_max(l)) / 0.9)) AS e FROM l) SELECT vec_id, round(e[1] / list_sum(e), 6) AS p0, round(e[2] / list_sum(e), 6) AS p1, round(e[5] / list_sum(e), 6) AS p4 FROM e")
def softmax_temperature(spark, sf):
    logits = F.transform(F.slice("embedding", 1, 5), lambda v: v.cast("double") * 3)
    p = table(spark, sf, "embeddings").select("vec_id", A.softmax(logits).alias("p"))
    return p.select("vec_id", *(F.round(F.element_at("p", k + 1), 6).alias(f"p{k}") for k in (0, 1, 4)))


_ACT = {"tanh": "tanh(x)", "leaky_relu": "CASE WHEN x >= 0 THEN x ELSE 0.01 * x END", "relu6": "greatest(0, least(6, x))", "sigmoid": "1 / (1 + exp(-x))", "silu": "x / (1 + exp(-x))", "softplus": "CASE WHEN x > 20 THEN x ELSE ln(1 + exp(x)) END", "rbf": "exp(-x * x)", "unit_interval": "CASE WHEN x >= 0 AND x <= 1 THEN 1 ELSE 0 END", "heaviside": "CASE WHEN x >= 0 THEN 1 ELSE 0 END", "square": "x * x", "modulo": "x - floor(x)", "log_clip_abs": "ln(greatest(abs(x), 1e-3))", "logsigmoid": "least(x, 0) - ln(1 + exp(-abs(x)))"}


@query("WITH x AS (SELECT event_id, (value - 50) / 10 AS x FROM events) SELECT event_id, " + ", ".join(f"round({s}, 6) + 0.0 AS {k}" for k, s in _ACT.items()) + " FROM x")
def activations(spark, sf):
    df = table(spark, sf, "events").select("event_id", ((F.col("value") - 50) / 10).alias("x"))
    return df.select("event_id", *(r6(A.ACTIVATIONS[k](F.col("x"))).alias(k) for k in _ACT))


# -- kernel prediction

_H = bandwidth(400, 64)


@query(
    f"""WITH c AS (SELECT label AS class, list_transform(embedding, lambda v: v::DOUBLE) AS f FROM embeddings WHERE vec_id < 400 AND vec_id % 5 <> 0), q AS (SELECT vec_id AS row_id, list_transform(embedding, lambda v: v::DOUBLE) AS f FROM embeddings WHERE vec_id % 5 = 0 AND vec_id < 500)
SELECT row_id, class, round(sum(exp(-(list_dot_product(q.f, q.f) + list_dot_product(c.f, c.f) - 2 * list_dot_product(q.f, c.f)) / (2 * {_H!r} * {_H!r} * 64))), 5) + 0.0 AS weight FROM q, c GROUP BY row_id, class"""
)
def kernel_class_weights(spark, sf):
    """Weight of every class for every fifth vector, from all the others. The SQL reads vec_id < 500 only, with 320 context rows."""
    df = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("y"), F.transform("embedding", lambda v: v.cast("double")).alias("features"))
    context = df.where("vec_id % 5 <> 0")
    classes, code = preprocess.encode_labels(context, "y")
    got = KernelPredictor().class_sums(context.withColumn("y", code), df.where("vec_id % 5 = 0").select(F.col("vec_id").alias("row_id"), "features"), len(classes))
    each = got.select("row_id", F.explode(F.arrays_zip(F.lit(classes).alias("class"), F.col("sums").alias("weight"))).alias("s"))
    return each.select("row_id", "s.class", (F.round("s.weight", 5) + 0.0).alias("weight"))


_DOT = "list_dot_product(q.f, q.f) + list_dot_product(c.f, c.f) - 2 * list_dot_product(q.f, c.f)"


@query(
    f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS f FROM embeddings), c AS (SELECT * FROM v WHERE vec_id % 5 <> 0), h AS (SELECT pow(count(*), -1.0 / 68) AS h FROM c)
SELECT q.vec_id AS row_id, c.label AS class, round(sum(exp(-({_DOT}) / (2 * h * h * 64))), 5) + 0.0 AS weight FROM v q, c, h WHERE q.vec_id % 5 = 0 GROUP BY q.vec_id, c.label"""
)
def kernel_class_weights_whole(spark, sf):
    """kernel_class_weights beside SQL over the whole table."""
    return kernel_class_weights(spark, sf)


@query(
    f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS f FROM embeddings)
SELECT q.vec_id, round(ln(sum(CASE WHEN c.label = 0 THEN exp(-({_DOT}) / (2 * 0.25 * 64)) ELSE 0 END) + 1e-9), 6) + 0.0 AS logit FROM v q, v c WHERE q.vec_id % 5 = 0 AND c.vec_id % 5 <> 0 GROUP BY q.vec_id"""
)
def kernel_logits_whole(spark, sf):
    """kernel_logits beside SQL over the whole table."""
    return kernel_logits(spark, sf)


# -- quantile distributions

_QN = 19
_QA = [(i + 1) / 20 for i in range(_QN)]


def _brand_quantiles(spark, sf) -> DataFrame:
    q = F.percentile("p_retailprice", F.lit(_QA))
    return table(spark, sf, "part").groupBy("p_brand").agg(q.alias("q"), F.avg("p_retailprice").alias("z"))


def _sql_tail(side: str) -> str:
    logs = [math.log(a) for a in _QA[:4]] if side == "l" else [math.log(1 - a) for a in _QA[-4:]]
    mean = sum(logs) / 4
    var = sum((v - mean) ** 2 for v in logs) / 4
    first = 1 if side == "l" else 16
    cov = " + ".join(f"(q[{first + i}] - (q[{first}] + q[{first + 1}] + q[{first + 2}] + q[{first + 3}]) / 4) * {logs[i] - mean!r}" for i in range(4))
    return f"greatest(0.01, least(100, abs(({cov}) / 4 / {max(var, 1e-6)!r})))"


_QB = f"b AS (SELECT p_brand, [{', '.join(f'quantile_cont(p_retailprice, {a!r})' for a in _QA)}] AS q, avg(p_retailprice) AS z FROM part GROUP BY p_brand), t AS (SELECT *, {_sql_tail('l')} AS bl, {_sql_tail('r')} AS br FROM b)"
_MID = " + ".join(f"0.05 * (q[{i}] + q[{i + 1}]) / 2" for i in range(1, _QN))
_MID2 = " + ".join(f"0.05 * (q[{i}] * q[{i}] + q[{i}] * q[{i + 1}] + q[{i + 1}] * q[{i + 1}]) / 3" for i in range(1, _QN))
_MEAN = f"(0.05 * (q[1] - bl) + {_MID} + 0.05 * (q[19] + br))"


@query(f"WITH {_QB} SELECT p_brand, round({_MEAN}, 4) AS mean, round(greatest(0, 0.05 * (q[1] * q[1] - 2 * bl * q[1] + 2 * bl * bl) + {_MID2} + 0.05 * (q[19] * q[19] + 2 * br * q[19] + 2 * br * br) - {_MEAN} * {_MEAN}), 3) AS variance FROM t")
def quantile_moments(spark, sf):
    d = Quantiles(F.col("q"), _QN, tuple(_QA))
    return _brand_quantiles(spark, sf).select("p_brand", F.round(d.mean(), 4).alias("mean"), F.round(d.variance(), 3).alias("variance"))


@query(
    f"WITH {_QB} SELECT p_brand, round(q[10] + (q[11] - q[10]) * 0.5, 4) AS inside, round(bl * ln(0.01) + q[1] - bl * ln(0.05), 4) AS low, round(-br * ln(0.02) + q[19] + br * ln(0.05), 4) AS high FROM t"
)
def quantile_icdf(spark, sf):
    """The quantile function between knots and in both tails."""
    d = Quantiles(F.col("q"), _QN, tuple(_QA))
    return _brand_quantiles(spark, sf).select("p_brand", *(F.round(d.icdf(F.lit(a)), 4).alias(n) for a, n in ((0.525, "inside"), (0.01, "low"), (0.98, "high"))))


@query(
    f"""WITH {_QB}, k AS (SELECT *, greatest(1, least(18, len(list_filter(q, lambda v: v <= z)))) AS k FROM t)
SELECT p_brand, round(k * 0.05 + 0.05 * (z - q[k]) / (q[k + 1] - q[k]), 6) AS p, round(1 / greatest(1e-6, least(1e6, (q[k + 1] - q[k]) / 0.05)), 6) AS f, round(exp((q[1] - 10 - (q[1] - bl * ln(0.05))) / bl), 6) AS left_p,
 round(1 - exp(-(q[19] + 10 - (q[19] + br * ln(0.05))) / br), 6) AS right_p FROM k"""
)
def quantile_cdf(spark, sf):
    """Distribution function at the mean and 10 beyond both outer knots, and the density at the mean."""
    d = Quantiles(F.col("q"), _QN, tuple(_QA))
    ql, qr = F.element_at("q", 1), F.element_at("q", _QN)
    return _brand_quantiles(spark, sf).select("p_brand", F.round(d.cdf(F.col("z")), 6).alias("p"), F.round(d.density(F.col("z")), 6).alias("f"), F.round(d.cdf(ql - 10), 6).alias("left_p"), F.round(d.cdf(qr + 10), 6).alias("right_p"))


@query(f"WITH {_QB} SELECT p_brand, round(2 * ({' + '.join(f'greatest({a!r} * (z - q[{i + 1}]), {a - 1!r} * (z - q[{i + 1}]))' for i, a in enumerate(_QA))}) / 19, 4) AS crps FROM t")
def quantile_pinball_crps(spark, sf):
    d = Quantiles(F.col("q"), _QN, tuple(_QA))
    return _brand_quantiles(spark, sf).select("p_brand", F.round(d.pinball_crps(F.col("z")), 4).alias("crps"))


@query(f"WITH {_QB} SELECT p_brand, round(list_sum(list_transform(range(1, 20), lambda i: list_max(list_transform(q[1:i], lambda v: round(v % 100, 6))))), 4) AS total, round(list_max(list_transform(q[1:7], lambda v: round(v % 100, 6))), 4) AS q7 FROM t")
def quantile_cummax(spark, sf):
    """Running maximum of unsorted values."""
    x = F.transform("q", lambda v: F.round(v % 100, 6))
    q = _brand_quantiles(spark, sf).select("p_brand", cummax_quantiles(x).alias("q"))
    return q.select("p_brand", F.round(A.reduce_array(F.col("q"), "sum"), 4).alias("total"), F.round(F.element_at("q", 7), 4).alias("q7"))


# -- metrics


@query("WITH p AS (SELECT p_retailprice AS y, 900 + p_size * 10.0 AS f FROM part) SELECT round(avg((y - f) * (y - f)), 4) AS mse, round(avg(abs(y - f)), 6) AS mae, round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(y)), 6) AS r2 FROM p")
def regression_metrics(spark, sf):
    df = table(spark, sf, "part").select(F.col("p_retailprice").alias("y"), (900 + F.col("p_size") * 10.0).alias("pred"))
    return metrics.regression_metrics(df).select(F.round("mse", 4).alias("mse"), F.round("mae", 6).alias("mae"), F.round("r2", 6).alias("r2"))


_SCORED = "s AS (SELECT labels.quality AS y, round(1 / (1 + exp(-(n_chars - 1500) / 1000.0)), 4) AS p FROM labels JOIN documents ON labels.doc_id = documents.doc_id)"


def _scored(spark, sf) -> DataFrame:
    df = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return df.select(F.col("quality").alias("y"), F.round(1 / (1 + F.exp(-(F.col("n_chars") - 1500) / 1000.0)), 4).alias("p"))


@query(f"WITH {_SCORED}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM s) SELECT round((sum(r) FILTER (y = 1) - (sum(y) * (sum(y) + 1)) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r")
def roc_auc(spark, sf):
    return metrics.auc(_scored(spark, sf), "y", "p").select(F.round("auc", 6).alias("auc"))


@query(f"WITH {_SCORED}, c AS (SELECT y, greatest(1e-15, least(1 - 1e-15, p)) AS q FROM s) SELECT round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss FROM c")
def log_loss(spark, sf):
    return metrics.log_loss(_scored(spark, sf)).select(F.round("log_loss", 6).alias("log_loss"))


@query(f"WITH {_SCORED} SELECT round(avg((y = (p >= 0.5)::INTEGER)::INTEGER), 6) AS accuracy FROM s")
def accuracy(spark, sf):
    df = _scored(spark, sf).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    return metrics.accuracy(df).select(F.round("accuracy", 6).alias("accuracy"))


@query("SELECT round(avg(greatest(0.9 * (p_retailprice - 1500), -0.1 * (p_retailprice - 1500))), 6) AS pinball FROM part")
def pinball_loss(spark, sf):
    df = table(spark, sf, "part").select(F.col("p_retailprice").alias("y"), F.lit(1500.0).alias("pred"))
    return metrics.pinball_loss(df, 0.9).select(F.round("pinball", 6).alias("pinball"))


# -- models; those without SQL are tested against NumPy


def _part(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", "p_size", "p_type", "p_brand", "p_retailprice")


@query()
def classify(spark, sf):
    """Class probabilities of held-out vectors from the others."""
    cols = [f"f{i}" for i in range(64)]
    df = table(spark, sf, "embeddings").select("vec_id", "label", *(F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate(cols)))
    model = Classifier(n_estimators=4).fit(df.where("vec_id % 5 <> 0"), "label", cols)
    return model.predict(df.where("vec_id % 5 = 0"), "vec_id")


@query()
def classify_many(spark, sf):
    """25 brands through a tree of groups."""
    df = _part(spark, sf)
    model = Classifier(n_estimators=2).fit(df.where("p_partkey % 5 <> 0").drop("p_partkey"), "p_brand")
    return model.predict(df.where("p_partkey % 5 = 0").drop("p_brand"), "p_partkey")


@query()
def regress(spark, sf):
    """Mean, median and quantiles of part prices."""
    df = _part(spark, sf)
    model = Regressor(n_estimators=2).fit(df.where("p_partkey % 5 <> 0"), "p_retailprice", ["p_size", "p_type", "p_brand"])
    return model.predict(df.where("p_partkey % 5 = 0"), "p_partkey", ("mean", "median", "variance"), (0.1, 0.9))


@query()
def regress_two_targets(spark, sf):
    """Price and tax in every fiftieth order, from the lines of all other orders. Lines of equal quantity and discount are predicted once."""
    features = ["l_quantity", "l_discount"]
    df = table(spark, sf, "lineitem").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumn("pair", F.struct(*features))
    context, late = df.where("l_orderkey % 50 <> 0"), df.where("l_orderkey % 50 = 0")
    got = multi_target(lambda: Regressor(n_estimators=1, max_context=None), context, ["l_extendedprice", "l_tax"], features, late.select("pair", *features).distinct(), "pair")
    return late.select("row_id", "pair").join(got, "pair").select("row_id", *(c for c in got.columns if c != "pair"))


@query()
def forecast_daily(spark, sf):
    """Seven days ahead for every user's daily mean."""
    p = events(spark, sf)
    daily = p.with_df(p.df.drop("event_id")).convert_frequency("D", "mean").fill_missing("auto")
    df = daily.df.select(F.col("user_id").alias("item_id"), F.col("ts").alias("timestamp"), "target")
    return forecast.Forecaster().predict_df(df, prediction_length=7, freq="D")


@query()
def detect_seasons(spark, sf):
    """Detected periods of every user's hourly counts."""
    p = events(spark, sf)
    hourly = p.with_df(p.df.drop("event_id")).convert_frequency("6h", "sum").assign(is_context=F.lit(True))
    return forecast.AutoPeriodicEncoder().periods(hourly, "target")


@query()
def power_transform(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return preprocess.Power().fit(df, ["l_extendedprice"]).transform(df)


@query()
def quantile_normal(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return preprocess.QuantileNormal().fit(df, ["p_retailprice"]).transform(df)


@query()
def full_pipeline(spark, sf):
    df = _outlying(spark, sf)
    return preprocess.Pipeline("power").fit(df, ["x"]).transform(df)


def _numbers(spark, sf) -> DataFrame:
    df = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", (F.col("p_partkey") % 4).cast("double").alias("grp"))
    return df.withColumn("p_retailprice", F.when(F.col("p_partkey") % 11 != 0, F.col("p_retailprice")))


@query()
def impute_chain(spark, sf):
    df = _numbers(spark, sf)
    return Unsupervised().fit(df, ["p_size", "p_retailprice", "grp"]).impute(df)


@query()
def outlier_density(spark, sf):
    df = _numbers(spark, sf)
    return Unsupervised().fit(df, ["p_size", "p_retailprice", "grp"]).score_samples(df, 3)


@query()
def generate_rows(spark, sf):
    return Unsupervised().fit(_numbers(spark, sf), ["p_size", "p_retailprice", "grp"]).generate(spark, 200)


@query("WITH m AS (SELECT avg(p_size) AS a, avg(p_retailprice) AS b FROM part) SELECT p_partkey, 'p_size' AS feature, round(3.0 * (p_size - a), 6) + 0.0 AS phi FROM part, m UNION ALL SELECT p_partkey, 'p_retailprice', round(-0.5 * (p_retailprice - b), 6) + 0.0 FROM part, m")
def shapley_additive(spark, sf):
    got = explain.additive_shapley(table(spark, sf, "part"), "p_partkey", {"p_size": 3.0, "p_retailprice": -0.5})
    return got.select("p_partkey", "feature", r6("phi").alias("phi"))


@query()
def shapley_kernel(spark, sf):
    df = _numbers(spark, sf)
    return explain.KernelExplainer(df, ["p_size", "grp"], "p_retailprice").shapley(df, "p_partkey")


@query()
def shapley_interactions(spark, sf):
    df = _numbers(spark, sf)
    return explain.KernelExplainer(df, ["p_size", "grp"], "p_retailprice").interactions(df, "p_partkey")


@query()
def synthetic_graph(spark, sf):
    return synthetic.datasets(spark, 8, 64, 5, 3, prior="graph")


@query()
def synthetic_layers(spark, sf):
    return synthetic.datasets(spark, 8, 64, 5, prior="mlp").union(synthetic.datasets(spark, 4, 64, 5, prior="tree"))


@query()
def tune_split(spark, sf):
    """Stratified context and query rows in chunks."""
    df = table(spark, sf, "labels").select("doc_id", "quality")
    return tuning.split(tuning.assign_chunks(df, "doc_id", 200), "doc_id", by="quality")


@query(
    """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS f FROM embeddings WHERE vec_id < 500)
SELECT q.vec_id, round(ln(sum(CASE WHEN c.label = 0 THEN exp(-(list_dot_product(q.f, q.f) + list_dot_product(c.f, c.f) - 2 * list_dot_product(q.f, c.f)) / (2 * 0.25 * 64)) ELSE 0 END) + 1e-9), 6) + 0.0 AS logit FROM v q, v c WHERE q.vec_id % 5 = 0 AND c.vec_id % 5 <> 0 GROUP BY q.vec_id"""
)
def kernel_logits(spark, sf):
    """The predictor's logit of class 0 for every fifth vector, bandwidth 0.5. The SQL reads vec_id < 500 only."""
    df = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("y"), F.transform("embedding", lambda v: v.cast("double")).alias("features"))
    out = KernelPredictor(0.5).class_logits(df.where("vec_id % 5 <> 0"), df.where("vec_id % 5 = 0"), 10)
    return out.select("vec_id", r6(F.element_at("logits", 1)).alias("logit"))


# -- sources, sides and items of panels


@query("SELECT user_id AS item_id, ts::TIMESTAMP AS timestamp, round(value, 6) + 0.0 AS value FROM events")
def panel_from_frame(spark, sf):
    p = from_frame(table(spark, sf, "events").select("user_id", "ts", "value"), "user_id", "ts")
    return p.df.select(p.item, p.ts, r6("value").alias("value"))


@query("SELECT o_custkey AS item_id, o_orderdate::TIMESTAMP AS timestamp, o_orderkey, o_totalprice FROM orders")
def panel_from_file(spark, sf):
    p = from_path(spark, f"{sf}/orders.parquet", item="o_custkey", ts="o_orderdate")
    return p.df.select(p.item, p.ts, "o_orderkey", "o_totalprice")


@query(f"WITH {E} SELECT user_id, ts, event_id, round(target, 6) + 0.0 AS target FROM e")
def split_target(spark, sf):
    """Features and targets apart, and side by side again."""
    features, target = events(spark, sf).split_target()
    return features.join(target, ["user_id", "ts"]).select("user_id", "ts", "event_id", r6("target").alias("target"))


@query(f"WITH {E} SELECT {_OUT} FROM e WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 4)")
def select_items(spark, sf):
    """The four longest series."""
    p = events(spark, sf)
    longest = p.num_timesteps().orderBy(F.desc("num_timesteps"), "user_id").limit(4).collect()
    return _rows(p.select_items([r["user_id"] for r in longest]))


@query(f"WITH {E}, {P} SELECT user_id, ts, round(target, 6) + 0.0 AS target, event_id, i < n - 3 AS is_context FROM p")
def shared_covariates(spark, sf):
    """Context and horizon with the covariates that both have."""
    p = events(spark, sf)
    past, late = p.assign(past_only=F.lit(1)).scoring_inputs(3, ["event_id"])
    future = p.with_df(late.withColumn("future_only", F.lit(2)).join(p.df.select("user_id", "ts", "target"), ["user_id", "ts"]))
    a, b = past.align_covariates(future)
    both = a.with_horizon(b).df
    return both.select("user_id", "ts", r6("target").alias("target"), *(c for c in both.columns if c not in ("user_id", "ts", "target")))


@query(f"WITH {E}, {P} SELECT user_id, ts, -1.0::DOUBLE AS target, CASE WHEN i % 2 = 0 THEN round(target, 6) + 0.0 END AS truth FROM p WHERE i >= n - 6")
def join_truth(spark, sf):
    """Predictions of every series' last six rows beside the truth, which is known of every other row."""
    p = events(spark, sf)
    known = p.with_index().df.where("running_index % 2 = 0")
    predicted = p.tail(6).assign(target=F.lit(-1.0))
    return predicted.join_truth(known).select("user_id", "ts", "target", r6("truth").alias("truth"))


@query(
    f"""WITH {E}, b AS (SELECT user_id, min(date_trunc('day', ts)) AS a, max(date_trunc('day', ts)) AS z FROM e GROUP BY user_id),
s AS (SELECT user_id, unnest(generate_series(a, z + INTERVAL 3 DAY, INTERVAL 1 DAY))::TIMESTAMP AS ts, z FROM b), i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i FROM s)
SELECT user_id, ts, ts <= z AS is_context, i AS running_index, month(ts) AS month, round(sin(2 * pi() * (isodow(ts) - 1) / 6), 6) + 0.0 AS day_of_week_sin, round(cos(2 * pi() * i / 7), 6) + 0.0 AS cos_7 FROM i"""
)
def forecast_features(spark, sf):
    """Features of daily context rows and three days ahead, by three transforms one after another."""
    p = events(spark, sf)
    daily = p.with_df(p.df.drop("event_id")).convert_frequency("D", "mean")
    steps = (forecast.IndexEncoder(), forecast.DatetimeEncoder(("month",), {"day_of_week": [7]}), forecast.FourierEncoder((7,)))
    df = forecast.add_features(daily, daily.build_horizon(3, "D"), steps).df
    return df.select("user_id", "ts", "is_context", "running_index", "month", r6("day_of_week_sin").alias("day_of_week_sin"), r6("cos_7").alias("cos_7"))


@query(
    "SELECT event_id, quarter(ts) AS quarter, hour(ts) AS hour_of_day, "
    + ", ".join(f"round({f}(2 * pi() * (isodow(ts) - 1) / {p - 1}), 6) + 0.0 AS day_of_week_{p}_{f}" for p in (7, 14) for f in ("sin", "cos"))
    + " FROM events"
)
def calendar_periods(spark, sf):
    """A component, a value as it is, and a feature with two periods."""
    cols = calendar_features(F.col("ts"), ("quarter",), {"hour_of_day": None, "day_of_week": [7, 14]})
    return table(spark, sf, "events").select("event_id", *((c if k in ("quarter", "hour_of_day") else r6(c)).alias(k) for k, c in cols.items()))


_BINS = f"""{E}, b AS (SELECT user_id, floor(epoch(ts) / 21600)::BIGINT AS p, coalesce(sum(target), 0) AS v FROM e GROUP BY ALL),
s AS (SELECT user_id, min(p) AS p0, max(p) - min(p) + 1 AS n FROM b GROUP BY user_id), g AS (SELECT user_id, p0, n, unnest(range(n)) AS j FROM s),
x AS (SELECT g.user_id, n, j, coalesce(v, 0) AS x FROM g LEFT JOIN b ON b.user_id = g.user_id AND b.p = p0 + j),
l AS (SELECT user_id, regr_slope(x, j) AS a, regr_intercept(x, j) AS c FROM x GROUP BY user_id),
y AS (SELECT x.user_id, n, j, (x - a * j - c) * (0.5 - 0.5 * cos(2 * pi() * j / (n - 1))) AS y FROM x JOIN l ON l.user_id = x.user_id),
k AS (SELECT user_id, n, unnest(range(n + 1)) AS k FROM s),
m AS (SELECT k.user_id, k.n, k, CASE WHEN k = 0 THEN 0 ELSE sqrt(pow(sum(y * cos(pi() * j * k / k.n)), 2) + pow(sum(y * sin(pi() * j * k / k.n)), 2)) END AS m FROM k JOIN y ON y.user_id = k.user_id GROUP BY k.user_id, k.n, k),
q AS (SELECT *, lag(m) OVER (PARTITION BY user_id ORDER BY k) AS before, lead(m) OVER (PARTITION BY user_id ORDER BY k) AS after, max(m) OVER (PARTITION BY user_id) AS top FROM m),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m DESC, k) AS place FROM q WHERE m > before AND m > after AND m >= 0.05 * top),
d AS (SELECT user_id, round_even(1 / (k * (1e0 / (2 * n))), 0) AS period, max(m) AS m FROM t WHERE place <= 5 GROUP BY ALL)"""


@query(f"WITH {_BINS} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY m DESC) - 1 AS place, period FROM d")
def season_periods(spark, sf):
    """Detected periods of every user's sums of six hours, strongest first: trend, window, padded transform and peaks."""
    return detect_seasons(spark, sf).select("user_id", F.posexplode("periods").alias("place", "period"))


# -- statistics, views and draws


@query("SELECT 'l_quantity' AS feature, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice) FROM lineitem")
def fitted_range(spark, sf):
    """The range that a pipeline clips new values to."""
    got = preprocess.Pipeline("none").fit(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]).range
    return spark.createDataFrame([(c, float(a), float(b)) for c, (a, b) in got.items()], "feature string, low double, high double")


@query("WITH s AS (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) + 1e-6 AS s FROM supplier) SELECT p_partkey, round((p_size / 25.0 - 1) * s + m, 5) + 0.0 AS x FROM part, s")
def unscale(spark, sf):
    """Scores back in the units of another table's column."""
    scale = preprocess.Standard().fit(table(spark, sf, "supplier"), ["s_acctbal"])
    return table(spark, sf, "part").select("p_partkey", (F.round(scale.inverse("s_acctbal", F.col("p_size") / 25.0 - 1), 5) + 0.0).alias("x"))


@query("WITH x AS (SELECT s_suppkey, s_acctbal / 1000 AS x FROM supplier) SELECT s_suppkey, " + ", ".join(f"round(CASE WHEN x >= 0 THEN {up} ELSE {down} END, 6) + 0.0 AS {name}" for name, up, down in (("half", "(pow(x + 1, 0.5) - 1) / 0.5", "-(pow(1 - x, 1.5) - 1) / 1.5"), ("zero", "ln(1 + x)", "-(pow(1 - x, 2.0) - 1) / 2"), ("two", "(pow(x + 1, 2.0) - 1) / 2", "-ln(1 - x)"))) + " FROM x")
def power_fixed(spark, sf):
    """The power transform at three given exponents."""
    df = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"))
    return df.select("s_suppkey", *(r6(preprocess.yeo_johnson(F.col("x"), F.lit(lam))).alias(name) for name, lam in (("half", 0.5), ("zero", 0.0), ("two", 2.0))))


@query(f"WITH {_LINES}, n AS (SELECT 0 AS i, 'l_quantity' AS col, count_if(l_quantity IS NULL) AS m FROM l UNION ALL SELECT 1, 'l_orderkey', 0 FROM (SELECT 1) UNION ALL SELECT 2, 'late', (SELECT count_if(l_linenumber > 1) FROM l)) SELECT (row_number() OVER (ORDER BY m, i) - 1)::INTEGER AS place, col FROM n")
def columns_by_missing(spark, sf):
    df = _lines(spark, sf).withColumn("late", F.when(F.col("l_linenumber") <= 1, 1))
    return spark.createDataFrame(list(enumerate(preprocess.by_missing_rate(df, ["l_quantity", "l_orderkey", "late"]))), "place int, col string")


@query("SELECT unnest(['none', 'nan']) AS col")
def empty_columns(spark, sf):
    df = table(spark, sf, "part").select("p_size", F.when(F.col("p_size") < 0, F.col("p_size")).alias("none"), F.lit(float("nan")).alias("nan"))
    return spark.createDataFrame([(c,) for c in preprocess.masked_columns(df, df.columns)], "col string")


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS best FROM embeddings")
def best_class(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", A.argmax(F.col("embedding")).cast("int").alias("best"))


_VIEWS = ensemble.members(3, 64, norms=("none",))


@query(" UNION ALL ".join(f"SELECT vec_id, {m.number} AS member, round(list_sum(list_transform(range(64), lambda i: embedding[({list(m.features)})[i + 1] + 1]::DOUBLE * (i + 1))), 5) + 0.0 AS mixed FROM embeddings" for m in _VIEWS))
def member_views(spark, sf):
    """Every vector in three orders of its features, as a sum weighted by place."""
    df = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("f"))
    mixed = A.reduce_array(F.transform("f", lambda v, i: v * (i + 1)), "sum")
    return ensemble.views(df, "f", _VIEWS).select("vec_id", "member", (F.round(mixed, 5) + 0.0).alias("mixed"))


@query("WITH l AS (SELECT label, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT label, k, avg(v) AS m FROM l GROUP BY ALL), e AS (SELECT label, k, exp((m - max(m) OVER (PARTITION BY label)) / 0.9) AS e FROM m) SELECT label, k::INTEGER AS class, round(e / sum(e) OVER (PARTITION BY label), 6) AS proba FROM e")
def mean_logits(spark, sf):
    """Mean of many logits and its probabilities: each label's vectors are the members of one row."""
    df = table(spark, sf, "embeddings").select("label", F.transform("embedding", lambda v: v.cast("double")).alias("logits"))
    return ensemble.average_logits(df, "label", "logits", 64).select("label", F.posexplode("proba").alias("class", "proba")).withColumn("proba", F.round("proba", 6))


def _prices(spark, sf) -> DataFrame:
    """Every customer's prices in the order of time."""
    each = F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", F.col("o_totalprice").cast("double").alias("v"))))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(each, lambda r: r["v"]).alias("q"))


@query("SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) - 1)::INTEGER AS place, o_totalprice AS v FROM orders")
def sorted_quantiles(spark, sf):
    return _prices(spark, sf).select("o_custkey", F.posexplode(sort_quantiles(F.col("q"))).alias("place", "v"))


@query(
    """WITH o AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders),
s AS (SELECT *, sum(v) OVER (PARTITION BY o_custkey ORDER BY i) AS s FROM o),
m AS (SELECT a.o_custkey, a.i, b.i AS j, (b.s - a.s + a.v) / (b.i - a.i + 1) AS m FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND b.i >= a.i),
l AS (SELECT o_custkey, i, j AS k, min(m) OVER (PARTITION BY o_custkey, i ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM m)
SELECT o_custkey, k::INTEGER AS place, round(max(m) / pi(), 4) AS v FROM l GROUP BY o_custkey, k"""
)
def isotonic_prices(spark, sf):
    """The nearest non-decreasing sequence to every customer's prices; the SQL has it as a maximum of minima of means.
    Divided by pi: means of a few prices lie on the very edges between rounded numbers."""
    each = _prices(spark, sf).select("o_custkey", F.posexplode(isotonic_quantiles(F.col("q"))).alias("place", "v"))
    return each.withColumn("v", F.round(F.col("v") / math.pi, 4))


@query("WITH u AS (SELECT p_partkey, (p_partkey % 97) / 97.0 AS u FROM part) SELECT p_partkey, (CASE WHEN u < 0.04 / 0.38 THEN 0 WHEN u < 0.13 / 0.38 THEN 1 ELSE 2 END)::INTEGER AS class, round(0.09 / 0.38, 6) AS p1, round(greatest(1e-6, least(1 - 1e-6, 0.5 + (u - 0.5) * 0.5)), 6) AS level FROM u")
def tempered_draws(spark, sf):
    """Sharpened class probabilities, the class that a level falls into, and the level of a tempered draw."""
    p, u = A.sharpen(F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5)), 0.5), F.col("p_partkey") % 97 / 97.0
    return table(spark, sf, "part").select("p_partkey", A.sample_category(p, u).cast("int").alias("class"), F.round(F.element_at(p, 2), 6).alias("p1"), F.round(A.tempered_level(u, 0.5), 6).alias("level"))


@query("WITH m AS (SELECT avg(p_size) AS a, avg(p_retailprice) AS b FROM part) SELECT 'p_size' AS feature, round(avg(abs(3.0 * (p_size - a))), 6) AS importance FROM part, m UNION ALL SELECT 'p_retailprice', round(avg(abs(-0.5 * (p_retailprice - b))), 6) FROM part, m")
def feature_importance(spark, sf):
    phi = explain.additive_shapley(table(spark, sf, "part"), "p_partkey", {"p_size": 3.0, "p_retailprice": -0.5})
    return explain.importance(phi).withColumn("importance", F.round("importance", 6))


_CLIPPED = """v AS (SELECT vec_id, label, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
s AS (SELECT k, avg(x) AS m, stddev_pop(x) + 1e-6 AS s FROM v WHERE vec_id % 5 <> 0 GROUP BY k), z AS (SELECT vec_id, label, v.k, greatest(-100, least(100, (x - m) / s)) AS z FROM v JOIN s ON s.k = v.k),
a AS (SELECT k, avg(z) AS m, greatest(1e-6, stddev_samp(z)) AS s FROM z WHERE vec_id % 5 <> 0 GROUP BY k),
i AS (SELECT z.k, avg(z) AS m, greatest(1e-6, stddev_samp(z)) AS s FROM z JOIN a ON a.k = z.k WHERE vec_id % 5 <> 0 AND abs(z - m) <= 4 * a.s GROUP BY z.k),
o AS (SELECT vec_id, label, z.k, greatest(m - 4 * s - ln(1 + abs(z)), z) AS y, m + 4 * s AS hi FROM z JOIN i ON i.k = z.k),
f AS (SELECT vec_id, label, list(least(hi + ln(1 + abs(y)), y) ORDER BY k) AS f FROM o GROUP BY vec_id, label),
h AS (SELECT pow(count(*), -1.0 / 68) AS h FROM f WHERE vec_id % 5 <> 0)"""


@query(
    f"""WITH {_CLIPPED}, l AS (SELECT q.vec_id, c.label, ln(sum(exp(-({_DOT}) / (2 * h * h * 64))) + 1e-9) AS l FROM f q, f c, h WHERE q.vec_id % 5 = 0 AND c.vec_id % 5 <> 0 GROUP BY q.vec_id, c.label),
e AS (SELECT vec_id, label, exp((l - max(l) OVER (PARTITION BY vec_id)) / 0.9) AS e FROM l) SELECT vec_id, arg_max(label, e) AS prediction, round(max(e) / sum(e), 5) AS proba FROM e GROUP BY vec_id"""
)
def classify_vectors(spark, sf):
    """The classifier's label of every fifth vector and its probability, from all the others: scaling, clipping, kernel, softmax."""
    cols = [f"f{i}" for i in range(64)]
    df = table(spark, sf, "embeddings").select("vec_id", "label", *(F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate(cols)))
    model = Classifier(n_estimators=1, norms=("none",), max_context=None).fit(df.where("vec_id % 5 <> 0"), "label", cols)
    got = model.predict(df.where("vec_id % 5 = 0"), "vec_id")
    return got.select("vec_id", "prediction", F.round(F.array_max("proba"), 5).alias("proba"))


# -- streams


def _stream(spark, sf, name: str) -> DataFrame:
    """A table as a stream of files, be it one file or a folder: a plain path would have to be a folder, a pattern needn't be."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


@query("SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts::TIMESTAMP) AS ts, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most, count(value) AS n FROM events GROUP BY ALL")
def stream_resample(spark, sf):
    """Windows of six hours of a stream of all events, none of them late; the last state of each window."""
    rows = _stream(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    agg = streams.resample_stream(rows, "6h", "user_id", "ts", "value", late="1000 days")
    got = streams.drained(agg, new_path(spark, "windows"), "update")
    last = got.groupBy("user_id", "ts").agg(*(F.max_by(c, "batch").alias(c) for c in ("mean", "min", "max", "n")))
    return last.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("mean", 6).alias("mean"), F.round("min", 6).alias("least"), F.round("max", 6).alias("most"), "n")


@query(ORACLE_SQL["kernel_logits_whole"])
def stream_logits(spark, sf):
    """kernel_logits with the query rows as a stream against the static context."""
    prepared = lambda df: df.select("vec_id", F.col("label").alias("y"), F.transform("embedding", lambda v: v.cast("double")).alias("features"))
    queries, context = prepared(_stream(spark, sf, "embeddings")).where("vec_id % 5 = 0").drop("y"), prepared(table(spark, sf, "embeddings")).where("vec_id % 5 <> 0")
    out = streams.score_stream(queries, context, KernelPredictor(0.5), 10)
    got = streams.drained(out.select("vec_id", "logits"), new_path(spark, "scores"))
    return got.select("vec_id", r6(F.element_at("logits", 1)).alias("logit"))
