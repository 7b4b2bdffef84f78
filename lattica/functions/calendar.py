"""Calendar and Fourier features as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Zero-based value and number of periods of each calendar feature (fixed values); the angle is 2*pi*value/(periods-1).
PERIODS = {"second_of_minute": 60, "minute_of_hour": 60, "hour_of_day": 24, "day_of_week": 7, "day_of_month": 30.5, "day_of_year": 365, "week_of_year": 52, "month_of_year": 12}
#: Components that are taken as they are (fixed values).
COMPONENTS = {"year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}


def zero_based(name: str, ts: Column) -> Column:
    """second, minute and hour as they are; Monday, the first day, the first ISO week and January are 0."""
    how = {
        "second_of_minute": lambda: F.second(ts), "minute_of_hour": lambda: F.minute(ts), "hour_of_day": lambda: F.hour(ts), "day_of_week": lambda: F.weekday(ts),
        "day_of_month": lambda: F.dayofmonth(ts) - 1, "day_of_year": lambda: F.dayofyear(ts) - 1, "week_of_year": lambda: F.weekofyear(ts) - 1, "month_of_year": lambda: F.month(ts) - 1,
    }
    if name not in how:
        raise ValueError(f"unknown calendar feature {name!r}")
    return how[name]()


def calendar_features(ts: Column, components: tuple[str, ...] = ("year",), seasonal: dict[str, list[float] | None] | None = None) -> dict[str, Column]:
    """Columns by name: components, and a sine and cosine of each seasonal feature (its own value if it has no period).

    With several periods of one feature, names carry the period.
    """
    seasonal = {k: [v] for k, v in PERIODS.items()} if seasonal is None else seasonal
    out = {c: COMPONENTS[c](ts) for c in components}
    for name, periods in seasonal.items():
        value = zero_based(name, ts)
        if periods is None:
            out[name] = value
            continue
        for p in periods:
            tag = name if len(periods) == 1 else f"{name}_{p:g}"
            angle = value.cast("double") * (2 * math.pi / (p - 1))
            out[f"{tag}_sin"], out[f"{tag}_cos"] = F.sin(angle), F.cos(angle)
    return out


def extended_calendar_features(ts: Column, components: tuple[str, ...] = (), seasonal: dict[str, list[float] | None] | None = None) -> dict[str, Column]:
    """The default features and additions; defaults win where names clash."""
    return calendar_features(ts, tuple(dict.fromkeys(("year", *components))), {**(seasonal or {}), **{k: [v] for k, v in PERIODS.items()}})


def fourier_features(index: Column, periods: list[float], suffix: str | None = None) -> dict[str, Column]:
    """Sine and cosine of 2*pi*index/period for each period."""
    if not periods:
        raise ValueError("Fourier features need periods")
    out = {}
    for k, p in enumerate(periods):
        name = f"{suffix}_{k}" if suffix else f"{p:g}"
        angle = index.cast("double") * (2 * math.pi / p)
        out[f"sin_{name}"], out[f"cos_{name}"] = F.sin(angle), F.cos(angle)
    return out
