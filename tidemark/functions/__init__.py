"""Scalar interval expressions over half-open ``[lo, hi)`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_empty(lo: Column, hi: Column) -> Column:
    return lo >= hi


def exclusive_less(a_hi: Column, b_lo: Column) -> Column:
    """The first interval ends before, or where, the second begins."""
    return a_hi <= b_lo


def more_or_touches(a_hi: Column, b_lo: Column) -> Column:
    return a_hi >= b_lo


def intersects(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return (a_lo < b_hi) & (b_lo < a_hi)


def touches(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return (a_hi == b_lo) | (b_hi == a_lo)


def contains(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return (a_lo <= b_lo) & (a_hi >= b_hi)


def length(lo: Column, hi: Column) -> Column:
    return hi - lo


def lower_edge(lo: Column) -> Column:
    return lo


def upper_edge(hi: Column) -> Column:
    """The last point of a discrete half-open interval."""
    return hi - 1


def intersection(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> tuple[Column, Column]:
    return F.greatest(a_lo, b_lo), F.least(a_hi, b_hi)


def hull(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> tuple[Column, Column]:
    return F.least(a_lo, b_lo), F.greatest(a_hi, b_hi)


def between(a_hi: Column, b_lo: Column) -> tuple[Column, Column]:
    """The gap from the first interval to the second."""
    return a_hi, b_lo


def left_remainder(a_lo: Column, a_hi: Column, b_lo: Column) -> tuple[Column, Column]:
    return a_lo, F.least(a_hi, b_lo)


def right_remainder(a_lo: Column, a_hi: Column, b_hi: Column) -> tuple[Column, Column]:
    return F.greatest(a_lo, b_hi), a_hi


def quantile(column: Column, q: float, accuracy: int = 10_000) -> Column:
    return F.percentile_approx(column, q, accuracy)


def to_vector(column: Column) -> Column:
    return F.collect_list(column)


def to_set(column: Column) -> Column:
    return F.sort_array(F.collect_set(column))
