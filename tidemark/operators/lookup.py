"""Lookups, enumeration and subsetting: filters that reach the scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import algebra, bins


def matching(facts: DataFrame, column: str, wanted) -> DataFrame:
    """Rows whose ``column`` is the scalar, in the iterable, or in the one-column DataFrame."""
    if wanted is None:
        return facts
    if isinstance(wanted, DataFrame):
        probe = wanted.select(F.col(wanted.columns[0]).alias(column)).distinct()
        return facts.join(probe, column, "left_semi").select(*facts.columns)
    if isinstance(wanted, Iterable) and not isinstance(wanted, str | bytes):
        return facts.where(F.col(column).isin(list(wanted)))
    return facts.where(F.col(column) == F.lit(wanted))


def overlapping(facts: DataFrame, lo, hi) -> DataFrame:
    if not lo < hi:
        return facts.where(F.lit(False))
    return facts.where((F.col("lo") < F.lit(hi)) & (F.col("hi") > F.lit(lo)))


def at_point(facts: DataFrame, tick) -> DataFrame:
    return facts.where((F.col("lo") <= F.lit(tick)) & (F.col("hi") > F.lit(tick)))


def overlapping_any(facts: DataFrame, windows: DataFrame, bin_ticks: int | None = None) -> DataFrame:
    """Rows that overlap at least one row of ``windows`` (lo, hi).

    Both sides are dealt to time bins and semi-joined on them, so that many windows
    against many facts needs no nested loop; bins grow with the length of the facts
    (see bins) or, with ``bin_ticks``, have that width.
    """
    asked = algebra.coalesce(windows.select(F.lit(0).alias("_g"), "lo", "hi"), ("_g",)).select("lo", "hi")
    if bin_ticks:
        def cut(rows: DataFrame) -> DataFrame:
            number = F.sequence(F.floor(F.col("lo") / bin_ticks), F.floor((F.col("hi") - 1) / bin_ticks))
            return rows.where("lo < hi").withColumns({"_level": F.lit(0), "_role": F.lit(0), "_bin": F.explode(number)})

        a, b = cut(facts), cut(asked)
    else:
        a, b = bins.dealt(facts, bins.levels(asked).scalar(), True), bins.dealt(asked, bins.levels(facts).scalar(), False)
    b = b.select(*[F.col(c).alias(f"_q{c}") for c in b.columns])
    hit = (F.col("lo") < F.col("_qhi")) & (F.col("_qlo") < F.col("hi"))
    same = (F.col("_level") == F.col("_q_level")) & (F.col("_role") == F.col("_q_role")) & (F.col("_bin") == F.col("_q_bin"))
    return a.join(b, same & hit, "left_semi").select(*facts.columns).distinct()


def distinct_sorted(facts: DataFrame, column: str) -> DataFrame:
    return facts.select(column).distinct().orderBy(column)


def subset(facts: DataFrame, keys=None, values=None) -> DataFrame:
    return matching(matching(facts, "key", keys), "value", values)
