"""Domains: how points of a key's timeline become ordered ticks.

Everything inside the engine is a half-open ``[lo, hi)`` pair of ticks:
BIGINT for integers, epoch days for dates, epoch microseconds for
timestamps, DOUBLE for floating point.  Bounds kinds are translated once, at
the edge.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDS = ("right_open", "left_open", "open", "closed")
_EPOCH_DAY = dt.date(1970, 1, 1)
_EPOCH = dt.datetime(1970, 1, 1)


@dataclass(frozen=True)
class Domain:
    """kind: int, date, timestamp or double; minimum and maximum in ticks."""

    kind: str
    minimum: float
    maximum: float
    bounds: str = "right_open"

    def __post_init__(self) -> None:
        if self.bounds not in BOUNDS:
            raise ValueError(f"unknown bounds kind {self.bounds!r}")
        if self.kind == "double" and self.bounds not in ("right_open", "left_open"):
            raise ValueError("a continuous domain takes right_open or left_open bounds only")

    @property
    def discrete(self) -> bool:
        return self.kind != "double"

    @property
    def sql_type(self) -> str:
        return "bigint" if self.discrete else "double"

    def with_bounds(self, bounds: str) -> Domain:
        return Domain(self.kind, self.minimum, self.maximum, bounds)

    def tick(self, point) -> float:
        """A Python point of this domain as a tick; ticks pass through."""
        if point is None:
            raise ValueError("a bound cannot be null")
        if self.kind == "date" and isinstance(point, dt.date):
            return (point - _EPOCH_DAY).days
        if self.kind == "timestamp" and isinstance(point, dt.datetime):
            return (point - _EPOCH) // dt.timedelta(microseconds=1)
        if self.kind == "double":
            if point != point:
                raise ValueError("a bound cannot be NaN")
            return float(point)
        if int(point) != point:
            raise ValueError(f"{point!r} is no tick of a discrete domain")
        return int(point)

    def span(self, length) -> float:
        """A length (number or timedelta) in ticks."""
        if isinstance(length, dt.timedelta):
            return length.days if self.kind == "date" else length // dt.timedelta(microseconds=1)
        return length

    def canonical(self, lo, hi, bounds: str | None = None) -> tuple[float, float]:
        """A Python interval as half-open ticks; reversed and empty ones come out with lo >= hi."""
        a, b = self.tick(lo), self.tick(hi)
        left, right = self.shifts(bounds)
        return a + left, b + right

    def shifts(self, bounds: str | None = None) -> tuple[int, int]:
        """What a bounds kind adds to its two points to make them half-open ticks."""
        return _shifts(bounds or self.bounds) if self.discrete else (0, 0)

    def tick_column(self, column: Column) -> Column:
        if self.kind == "date":
            return F.unix_date(column.cast("date")).cast("bigint")
        if self.kind == "timestamp":
            return F.unix_micros(column.cast("timestamp")).cast("bigint")
        return column.cast(self.sql_type)

    def point_column(self, ticks: Column) -> Column:
        """Back to the domain's own type, for display and sinks."""
        if self.kind == "date":
            return F.date_from_unix_date(ticks.cast("int"))
        if self.kind == "timestamp":
            return F.timestamp_micros(ticks).cast("timestamp_ntz")
        return ticks

    def canonical_columns(self, lo: Column, hi: Column, bounds: Column | str | None = None) -> tuple[Column, Column]:
        """Column version of canonical(); bounds may be a column, so that each row has its own kind."""
        a, b = self.tick_column(lo), self.tick_column(hi)
        if self.discrete and isinstance(bounds, Column):
            left = F.when(bounds.isin("left_open", "open"), 1).otherwise(0)
            right = F.when(bounds.isin("left_open", "closed"), 1).otherwise(0)
            return a + left, b + right
        left, right = self.shifts(bounds if isinstance(bounds, str) else None)
        return a + left, b + right

    def literal(self, tick) -> Column:
        return F.lit(tick).cast(self.sql_type)

    def right_extended(self, hi: Column, ext) -> Column:
        """hi + ext, stopping at the maximum; the sum is never formed where it could overflow."""
        if ext is None:
            return self.literal(self.maximum)
        ext = self.span(ext)
        return F.when(hi > self.maximum - ext, self.literal(self.maximum)).otherwise(hi + ext)

    def left_extended(self, lo: Column, ext) -> Column:
        if ext is None:
            return self.literal(self.minimum)
        ext = self.span(ext)
        return F.when(lo < self.minimum + ext, self.literal(self.minimum)).otherwise(lo - ext)


def _shifts(bounds: str) -> tuple[int, int]:
    return int(bounds in ("left_open", "open")), int(bounds in ("left_open", "closed"))


# The extents of each domain (date and timestamp: 1400-01-01 to 9999-12-31).
INT = Domain("int", -(2**31), 2**31 - 1)
BIGINT = Domain("int", -(2**62), 2**62)
DATE = Domain("date", (dt.date(1400, 1, 1) - _EPOCH_DAY).days, (dt.date(9999, 12, 31) - _EPOCH_DAY).days)
TIMESTAMP = Domain(
    "timestamp",
    (dt.datetime(1400, 1, 1) - _EPOCH) // dt.timedelta(microseconds=1),
    (dt.datetime(9999, 12, 31) - _EPOCH) // dt.timedelta(microseconds=1),
)
DOUBLE = Domain("double", -1.7976931348623157e308, 1.7976931348623157e308)
