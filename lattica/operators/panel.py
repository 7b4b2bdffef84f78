"""Algebra over panels: many time series in one frame, one row per (item, time).

Rows are ordered by (item, time); every positional operator is a window over that order, so a panel is never sorted as a
whole and never leaves the executors. Null and NaN targets both count as missing (NaN becomes null when a panel is made).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import staged

IRREGULAR = "IRREG"
#: Units of frequency aliases (fixed values): (Spark unit, whether the label is the period's last day).
UNITS = {"s": ("SECOND", False), "min": ("MINUTE", False), "h": ("HOUR", False), "D": ("DAY", False), "W": ("WEEK", True), "MS": ("MONTH", False), "ME": ("MONTH", True), "QS": ("QUARTER", False), "QE": ("QUARTER", True), "YS": ("YEAR", False), "YE": ("YEAR", True), "B": ("DAY", False)}
#: Seconds of the units that have a fixed length (fixed values).
SECONDS = {"s": 1, "min": 60, "h": 3600, "D": 86400, "W": 604800}
#: Months of the calendar units (fixed values).
MONTHS = {"MS": 1, "ME": 1, "QS": 3, "QE": 3, "YS": 12, "YE": 12}
_DAY = 86_400_000_000


def parse_freq(freq: str) -> tuple[int, str]:
    """'2h' -> (2, 'h')."""
    m = re.fullmatch(r"(\d*)([A-Za-z]+)", freq)
    if not m or m[2] not in UNITS:
        raise ValueError(f"unknown frequency {freq!r}; known: {', '.join(UNITS)}")
    return int(m[1] or 1), m[2]


def _ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone, read from its own fields: the session's time zone plays no part."""
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return day * F.lit(_DAY) + (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * F.lit(1_000_000) + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def _div(a: Column, b: int) -> Column:
    """Floor of a / b in whole numbers."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b)) if b != 1 else a


def _date(days: Column) -> Column:
    return _ntz(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")))


def _business(days: Column) -> Column:
    """Number of the business day that days since 1970 falls on; a weekend counts as its Friday."""
    monday = days + F.lit(3)
    return _div(monday, 7) * 5 + F.least(F.pmod(monday, F.lit(7)), F.lit(4))


def add_steps(ts: Column, steps: Column, freq: str) -> Column:
    """ts moved by a number of periods; calendar periods keep to month ends where the label is one."""
    n, unit = parse_freq(freq)
    if unit == "B":
        days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
        return _ntz(F.timestamp_add("DAY", (_business_day(_business(days) + steps * n) - days).cast("long"), ts))
    if unit in SECONDS:
        return _ntz(F.timestamp_add("SECOND", (steps * n * SECONDS[unit]).cast("long"), ts))
    moved = _ntz(F.timestamp_add("MONTH", (steps * n * MONTHS[unit]).cast("int"), ts))
    return _ntz(F.last_day(moved)) if UNITS[unit][1] else moved


def _business_day(number: Column) -> Column:
    """Days since 1970 of a business day's number."""
    return _div(number, 5) * 7 - 3 + F.pmod(number, F.lit(5))


def period(ts: Column, unit: str) -> Column:
    """Number of the unit's period that holds ts: seconds, minutes, hours, days, weeks from Monday, business days or months since a fixed start."""
    if unit == "W":
        return _div(_div(micros(ts), _DAY) + 3, 7)
    if unit == "B":
        return _business(_div(micros(ts), _DAY))
    if unit in SECONDS:
        return _div(micros(ts), SECONDS[unit] * 1_000_000)
    return _div((F.year(ts) * 12 + F.month(ts) - 1).cast("long"), MONTHS[unit])


def label(number: Column, unit: str) -> Column:
    """The label of a period: its start, or its last day for the frequencies that name period ends."""
    if unit == "W":
        return _date(number * 7 + 3)
    if unit == "B":
        return _date(_business_day(number))
    if unit in SECONDS:
        size = SECONDS[unit] * 1_000_000
        days = _div(number * size, _DAY)
        return _ntz(F.timestamp_add("MICROSECOND", number * size - days * _DAY, _date(days)))
    month = (number + (1 if UNITS[unit][1] else 0)) * MONTHS[unit] - (1 if UNITS[unit][1] else 0)
    first = F.make_date(_div(month, 12).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1))
    return _ntz(F.last_day(first) if UNITS[unit][1] else first)


@dataclass(frozen=True)
class Panel:
    """A frame with an item column and a time column, and perhaps a table of static features by item."""

    df: DataFrame
    item: str = "item_id"
    ts: str = "timestamp"
    static: DataFrame | None = None

    # -- order and columns

    def window(self, *more: Column):
        return Window.partitionBy(self.item).orderBy(self.ts, *more)

    def values(self) -> list[str]:
        """Columns other than the two keys."""
        return [c for c in self.df.columns if c not in (self.item, self.ts)]

    def with_df(self, df: DataFrame) -> Panel:
        return replace(self, df=df)

    def assign(self, **columns: Column) -> Panel:
        return self.with_df(self.df.withColumns(columns))

    def split_target(self, target: str = "target") -> tuple[DataFrame, DataFrame]:
        """(features with keys, keys with target)."""
        return self.df.drop(target), self.df.select(self.item, self.ts, target)

    def sorted(self) -> Panel:
        return self.with_df(self.df.orderBy(self.item, self.ts))

    # -- counts

    def num_timesteps(self) -> DataFrame:
        return self.df.groupBy(self.item).agg(F.count("*").alias("num_timesteps"))

    def num_items(self) -> DataFrame:
        return self.df.agg(F.countDistinct(self.item).alias("num_items"))

    def item_ids(self) -> DataFrame:
        return self.df.select(self.item).distinct()

    def last_timestamp(self) -> DataFrame:
        return self.df.groupBy(self.item).agg(F.max(self.ts).alias("last_timestamp"))

    def valid_counts(self, column: str = "target") -> DataFrame:
        return self.df.groupBy(self.item).agg(F.count(column).alias("num_valid"))

    def indptr(self) -> DataFrame:
        """Where each item's rows begin and end in the sorted frame. The running sum is over items, in range partitions."""
        counts = staged(self.num_timesteps().orderBy(self.item).withColumn("__at", F.monotonically_increasing_id()), "items").withColumn("__part", F.shiftright("__at", 33))
        parts = counts.groupBy("__part").agg(F.sum("num_timesteps").alias("__n"))
        ahead = parts.alias("p").join(parts.alias("q"), F.col("q.__part") < F.col("p.__part"), "left").groupBy(F.col("p.__part").alias("__part")).agg(F.coalesce(F.sum("q.__n"), F.lit(0)).alias("__ahead"))
        run = F.sum("num_timesteps").over(Window.partitionBy("__part").orderBy("__at"))
        return counts.join(ahead, "__part").withColumn("stop", F.col("__ahead") + run).select(self.item, (F.col("stop") - F.col("num_timesteps")).alias("start"), "stop")

    # -- rows by time

    def slice_by_time(self, start, end) -> Panel:
        """start <= time < end."""
        if str(end) < str(start):
            raise ValueError("end is before start")
        return self.with_df(self.df.where((F.col(self.ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(self.ts) < F.lit(end).cast("timestamp_ntz"))))

    def split_by_time(self, cutoff) -> tuple[Panel, Panel]:
        at = F.lit(cutoff).cast("timestamp_ntz")
        return self.with_df(self.df.where(F.col(self.ts) < at)), self.with_df(self.df.where(F.col(self.ts) >= at))

    # -- rows by position

    def slice_by_timestep(self, start: int | None = None, end: int | None = None) -> Panel:
        """Python slice of each item's rows: negative positions count from the end, both are clipped to the item's length."""
        own = self.window()
        if start is not None and start < 0 and end is None:  # the last rows alone: a top-k per item that Catalyst can limit early
            late = Window.partitionBy(self.item).orderBy(F.desc(self.ts))
            return self.with_df(self.df.withColumn("__n", F.row_number().over(late)).where(F.col("__n") <= -start).drop("__n"))
        df = self.df.withColumn("__at", F.row_number().over(own) - 1)
        if (start or 0) >= 0 and end is not None and end >= 0:
            return self.with_df(df.where((F.col("__at") >= (start or 0)) & (F.col("__at") < end)).drop("__at"))
        df = df.withColumn("__len", F.count("*").over(Window.partitionBy(self.item)))
        clip = lambda v, none: none if v is None else F.lit(v) if v >= 0 else F.greatest(F.lit(0), F.col("__len") + v)
        return self.with_df(df.where((F.col("__at") >= clip(start, F.lit(0))) & (F.col("__at") < clip(end, F.col("__len")))).drop("__at", "__len"))

    def tail(self, n: int) -> Panel:
        return self.slice_by_timestep(-n, None)

    def truncate_context(self, max_length: int) -> Panel:
        """The last max_length rows of each item."""
        return self.tail(max_length)

    def train_test_split(self, horizon: int, end_index: int | None = None, suffix: str | None = None) -> tuple[Panel, Panel]:
        """(train, test): test ends at end_index and contains train, which lacks its last `horizon` rows."""
        test = self if end_index is None else self.slice_by_timestep(None, end_index)
        train = test.slice_by_timestep(None, -horizon)
        if suffix:
            named = lambda p: p.with_df(p.df.withColumn(self.item, F.concat(F.col(self.item).cast("string"), F.lit(suffix))))
            train, test = named(train), named(test)
        return train, test

    def scoring_inputs(self, horizon: int, known: list[str] | None = None) -> tuple[Panel, DataFrame | None]:
        """(past without the last `horizon` rows, known covariates of those rows)."""
        late = self.slice_by_timestep(-horizon, None).df.select(self.item, self.ts, *known) if known else None
        return self.slice_by_timestep(None, -horizon), late

    def with_index(self, name: str = "running_index") -> Panel:
        return self.assign(**{name: F.row_number().over(self.window()) - 1})

    def first_difference(self, column: str = "target", name: str = "diff") -> Panel:
        """x[i] - x[i-1]; 0 at the first row."""
        return self.assign(**{name: F.col(column) - F.lag(column, 1).over(self.window())}).with_default(name, 0.0)

    def with_default(self, name: str, value: float) -> Panel:
        first = F.row_number().over(self.window()) == 1
        return self.assign(**{name: F.when(first, F.lit(value)).otherwise(F.col(name))})

    # -- items

    def select_items(self, ids: list) -> Panel:
        """Rows of the given items; unknown ids are an error."""
        known = {r[0] for r in self.df.where(F.col(self.item).isin(ids)).select(self.item).distinct().collect()}
        if missing := [i for i in ids if i not in known]:
            raise KeyError(f"unknown items: {missing}")
        return self.with_df(self.df.where(F.col(self.item).isin(ids)))

    def sample_items(self, n: int, seed: int = 123) -> DataFrame:
        """n items, chosen by a seeded hash."""
        return self.item_ids().orderBy(F.xxhash64(F.col(self.item), F.lit(seed)), self.item).limit(n)

    def with_static(self, static: DataFrame) -> Panel:
        """Static features; every item needs a row, further rows are dropped."""
        missing = self.item_ids().join(static, self.item, "left_anti")
        if not missing.isEmpty():
            raise ValueError(f"static features miss items such as {missing.first()[0]!r}")
        return replace(self, static=static.join(self.item_ids(), self.item, "left_semi"))

    def join_static(self) -> DataFrame:
        return self.df.join(self.static, self.item) if self.static is not None else self.df

    # -- missing values

    def dropna(self, how: str = "any") -> Panel:
        return self.with_df(self.df.na.drop(how, subset=self.values()))

    def drop_or_zero_missing(self, target: str = "target") -> Panel:
        """Items with at most one valid target: missing becomes 0; others: rows with a missing target go."""
        n = F.count(target).over(Window.partitionBy(self.item))
        df = self.df.withColumn("__n", n).where((F.col("__n") <= 1) | F.col(target).isNotNull())
        return self.with_df(df.withColumn(target, F.when(F.col("__n") <= 1, F.coalesce(F.col(target), F.lit(0.0))).otherwise(F.col(target))).drop("__n"))

    def fill_missing(self, method: str = "auto", value: float = 0.0, columns: list[str] | None = None) -> Panel:
        """auto (forward then backward), ffill/pad, bfill/backfill, constant, or interpolate (linear by position; leading
        gaps stay, trailing ones repeat the last value)."""
        past = self.window().rowsBetween(Window.unboundedPreceding, 0)
        ahead = self.window().rowsBetween(0, Window.unboundedFollowing)
        fill = {}
        for c in columns or self.values():
            before, after = F.last(c, True).over(past), F.first(c, True).over(ahead)
            if method == "auto":
                fill[c] = F.coalesce(before, after)
            elif method in ("ffill", "pad"):
                fill[c] = before
            elif method in ("bfill", "backfill"):
                fill[c] = after
            elif method == "constant":
                fill[c] = F.coalesce(F.col(c), F.lit(value))
            elif method != "interpolate":
                raise ValueError(f"unknown fill method {method!r}")
        if method != "interpolate":
            return self.assign(**fill)
        df = self.df.withColumn("__at", F.row_number().over(self.window()))
        for c in columns or self.values():
            at = F.when(F.col(c).isNotNull(), F.col("__at"))
            df = df.withColumns({"__v0": F.last(c, True).over(past), "__v1": F.first(c, True).over(ahead), "__i0": F.last(at, True).over(past), "__i1": F.first(at, True).over(ahead)})
            line = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * (F.col("__at") - F.col("__i0")) / (F.col("__i1") - F.col("__i0"))
            df = df.withColumn(c, F.when(F.col(c).isNotNull() | F.col("__v0").isNull(), F.col(c)).when(F.col("__v1").isNull(), F.col("__v0")).otherwise(line))
        return self.with_df(df.drop("__at", "__v0", "__v1", "__i0", "__i1"))

    # -- frequency

    def frequencies(self) -> DataFrame:
        """item, freq: each item's frequency alias, IRREG if its steps differ; null with fewer than three rows."""
        step = F.lead(self.ts).over(self.window())
        ts, nxt = F.col(self.ts), F.col("__next")
        us, day = micros(ts), _div(micros(ts), _DAY)
        seconds = (micros(nxt) - us) / 1_000_000
        months = (F.year(nxt) - F.year(ts)) * 12 + F.month(nxt) - F.month(ts)
        midnight = F.pmod(us, F.lit(_DAY)) == 0
        at_start = (F.dayofmonth(ts) == 1) & midnight
        at_end = (F.to_date(ts) == F.last_day(ts)) & midnight
        weekday = F.pmod(day + 3, F.lit(7))
        business = (weekday < 5) & (nxt.isNull() | ((micros(nxt) - us) == F.when(weekday == 4, 3 * _DAY).otherwise(_DAY)))
        agg = self.df.withColumn("__next", step).groupBy(self.item).agg(F.count("*").alias("n"), F.min(seconds).alias("s0"), F.max(seconds).alias("s1"), F.min(months).alias("m0"), F.max(months).alias("m1"), F.bool_and(at_start).alias("starts"), F.bool_and(at_end).alias("ends"), F.bool_and(business).alias("business"))
        times = lambda k, name: F.when(k == 1, name).otherwise(F.concat(k.cast("string"), name))
        side = lambda name: F.concat(F.lit(name), F.when(F.col("starts"), "S").otherwise("E"))
        m = F.col("m0")
        calendar = F.when(m != F.col("m1"), F.lit(IRREGULAR)).when(m % 12 == 0, times((m / 12).cast("int"), side("Y"))).when(m % 3 == 0, times((m / 3).cast("int"), side("Q"))).otherwise(times(m, side("M")))
        week = (F.col("s0") / 604800).cast("long")
        fixed = F.when(F.col("s0") % 604800 == 0, times(week, F.lit("W")))
        for unit in ("D", "h", "min", "s"):
            size = SECONDS[unit]
            fixed = fixed.when(F.col("s0") % size == 0, times((F.col("s0") / size).cast("long"), F.lit(unit)))
        alias = F.when(F.col("n") < 3, F.lit(None)).when((F.col("s0") == F.col("s1")) & (F.col("s0") > 0), fixed).when((F.col("starts") | F.col("ends")) & (m > 0), F.coalesce(calendar, F.lit(IRREGULAR)))
        return agg.select(self.item, alias.when(F.col("business"), F.lit("B")).otherwise(F.lit(IRREGULAR)).alias("freq"))

    def infer_frequency(self, raise_if_irregular: bool = False) -> str | None:
        """The alias that all items share, else IRREG."""
        found = [r["freq"] for r in self.frequencies().where("freq is not null").select("freq").distinct().limit(2).collect()]
        if len(found) == 1 and found[0] != IRREGULAR:
            return found[0]
        if not found:
            return None
        if raise_if_irregular:
            raise ValueError("items have no common regular frequency")
        return IRREGULAR

    def convert_frequency(self, freq: str, numeric: str = "mean", other: str = "first") -> Panel:
        """Resamples each item: numeric columns by max, min, sum, mean, median, first or last, others by first or last.
        Empty periods between an item's first and last appear with nulls (0 for sums). Multiples of a unit, such as 2D or
        2ME, begin at the item's first day, or end or begin at its first calendar period, and hold every row once."""
        kinds = dict(self.df.dtypes)
        how = {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg, "median": F.median}

        def agg(c: str) -> Column:
            name = numeric if re.match(r"(tiny|small|big)?int|float|double|decimal|long|short|byte", kinds[c]) else other
            if name in how:
                return how[name](c).alias(c)
            if name not in ("first", "last"):
                raise ValueError(f"unknown aggregate {name!r}")
            pick = F.min_by if name == "first" else F.max_by
            return pick(F.col(c), F.when(F.col(c).isNotNull(), F.col(self.ts))).alias(c)

        n, unit = parse_freq(freq)
        ends, numbered = UNITS[unit][1], self.df.withColumn("__p", period(F.col(self.ts), unit))
        at, shown = F.col("__p"), F.col("__k")
        if n > 1:  # multiples are counted from the item's first day (fixed units) or first period (calendar units)
            first = F.min("__p") if unit not in ("s", "min", "h") else _div(F.min("__p"), 86400 // SECONDS[unit]) * (86400 // SECONDS[unit])
            numbered = numbered.join(numbered.groupBy(F.col(self.item).alias("__item")).agg(first.alias("__o")), F.col(self.item).eqNullSafe(F.col("__item"))).drop("__item")
            at = _div(F.col("__p") - F.col("__o") + (n - 1 if ends else 0), n)
            shown = F.col("__o") + F.col("__k") * n
        keys = [self.item, "__o"] if n > 1 else [self.item]
        sums = numbered.withColumn("__k", at).groupBy(*keys, "__k").agg(*(agg(c) for c in self.values()))
        # the periods up to the next one with rows follow on as empty ones: no join with a spine
        gap = F.lead("__k", 1).over(Window.partitionBy(self.item).orderBy("__k")) - F.col("__k")
        out = sums.withColumn("__n", F.coalesce(gap, F.lit(1))).withColumn("__g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
        own = F.col("__g") == 0
        for c in self.values():
            zero = numeric == "sum" and re.match(r"(tiny|small|big)?int|float|double|decimal", kinds[c])
            kind = dict(out.dtypes)[c]
            out = out.withColumn(c, F.coalesce(F.when(own, F.col(c)), F.lit(0).cast(kind)) if zero else F.when(own, F.col(c)))
        out = out.withColumn("__k", F.col("__k") + F.col("__g")).withColumn("__t", label(shown, unit))
        return self.with_df(out.select(self.item, F.col("__t").alias(self.ts), *self.values()))

    # -- future

    def build_horizon(self, length: int, freq: str | None = None, target: str = "target") -> Panel:
        """The next `length` times of each item, with a null target."""
        if length < 1:
            raise ValueError("the horizon needs at least one step")
        freq = freq or self.infer_frequency(raise_if_irregular=True)
        if freq in (None, IRREGULAR):
            raise ValueError("the panel is irregular; give a frequency")
        last = self.last_timestamp().withColumn("__step", F.explode(F.sequence(F.lit(1), F.lit(length))))
        kind = dict(self.df.dtypes).get(target, "double")
        return Panel(last.select(self.item, add_steps(F.col("last_timestamp"), F.col("__step"), freq).alias(self.ts), F.lit(None).cast(kind).alias(target)), self.item, self.ts)

    def with_horizon(self, future: Panel) -> Panel:
        """Context and horizon in one frame, told apart by is_context; columns of one side only are null in the other."""
        a, b = self.df.withColumn("is_context", F.lit(True)), future.df.withColumn("is_context", F.lit(False))
        return self.with_df(a.unionByName(b, allowMissingColumns=True))

    def align_covariates(self, future: Panel, target: str = "target") -> tuple[Panel, Panel]:
        """Both sides with the covariates they share."""
        both = [c for c in self.values() if c in future.values() and c != target]
        return self.with_df(self.df.select(self.item, self.ts, target, *both)), future.with_df(future.df.select(future.item, future.ts, target, *both))

    def join_truth(self, truth: DataFrame, name: str = "truth", target: str = "target") -> DataFrame:
        """Predictions with the true values at the same (item, time), null where there are none."""
        return self.df.join(truth.select(self.item, self.ts, F.col(target).alias(name)), [self.item, self.ts], "left")
