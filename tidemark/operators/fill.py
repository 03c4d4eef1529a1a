"""The gap-filling family: each returns the facts to add; ``union`` applies them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.domain import Domain
from tidemark.operators import algebra, bins

DIRECTIONS = ("backwards", "forwards", "both")


def _pieces(rows: DataFrame, domain: Domain, ext, forwards: bool, backwards: bool) -> DataFrame:
    """Rows (key, value, glo, ghi, before, after): the whole gap, or at most ``ext`` from the sides that hold."""
    whole = F.struct(F.col("glo").alias("lo"), F.col("ghi").alias("hi"))
    if ext is None:
        parts = F.array(whole)
    else:
        ext = domain.span(ext)
        sides = []
        if forwards:
            sides.append(F.when(F.col("before"), F.struct(F.col("glo").alias("lo"), (F.col("glo") + ext).alias("hi"))))
        if backwards:
            sides.append(F.when(F.col("after"), F.struct((F.col("ghi") - ext).alias("lo"), F.col("ghi").alias("hi"))))
        held = F.filter(F.array(*sides), lambda s: s.isNotNull())
        parts = F.when(F.col("ghi") - F.col("glo") <= ext, F.array(whole)).otherwise(held)
    return rows.select("key", "value", F.explode(parts).alias("p")).select("key", "value", "p.lo", "p.hi")


def gap_fills(facts: DataFrame, domain: Domain, ext=None) -> DataFrame:
    """Values on both sides of a gap fill it; a gap longer than ``ext`` gets ``ext`` from each side."""
    return _pieces(algebra.gap_sides(facts).where("before and after"), domain, ext, True, True)


def gap_extensions(facts: DataFrame, domain: Domain, direction: str = "both", ext=None) -> DataFrame:
    """Values before a gap are carried forwards into it, values after it backwards."""
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}")
    forwards, backwards = direction != "backwards", direction != "forwards"
    sides = algebra.gap_sides(facts).where(F.lit(forwards) & F.col("before") | F.lit(backwards) & F.col("after"))
    before, after = F.col("before") & F.lit(forwards), F.col("after") & F.lit(backwards)
    return _pieces(sides.withColumns({"before": before, "after": after}), domain, ext, forwards, backwards)


def start_extensions(facts: DataFrame, domain: Domain, start=None, ext=None) -> DataFrame:
    """Extend the first values of each key backwards, if its first fact begins before ``start``."""
    edge = domain.maximum if start is None else domain.canonical(domain.minimum, start)[1]
    first = facts.groupBy("key").agg(F.min("lo").alias("lo")).where(F.col("lo") < edge)
    new_lo = domain.left_extended(F.col("lo"), ext)
    return facts.join(first, ["key", "lo"]).select("key", "value", new_lo.alias("lo"), F.col("lo").alias("hi")).where("lo < hi")


def end_extensions(facts: DataFrame, domain: Domain, start=None, ext=None) -> DataFrame:
    """Extend the last values of each key forwards, if its last fact reaches past ``start``."""
    edge = domain.minimum if start is None else domain.canonical(start, domain.maximum)[0]
    last = facts.groupBy("key").agg(F.max("hi").alias("hi")).where(F.col("hi") > edge)
    new_hi = domain.right_extended(F.col("hi"), ext)
    return facts.join(last, ["key", "hi"]).select("key", "value", F.col("hi").alias("lo"), new_hi.alias("hi")).where("lo < hi")


def backstop_fills(facts: DataFrame, other: DataFrame) -> DataFrame:
    """Unknown keys are copied whole, known keys only inside their interior gaps."""
    holes = algebra.gaps(facts).select("key", F.col("glo").alias("lo"), F.col("ghi").alias("hi"))
    inside = bins.meeting(other, holes, "key", "key").select(
        F.col("l_key").alias("key"), F.col("l_value").alias("value"), F.greatest("l_lo", "r_lo").alias("lo"), F.least("l_hi", "r_hi").alias("hi")
    )
    unknown = other.join(facts.select("key").distinct(), "key", "left_anti").select("key", "value", "lo", "hi")
    return inside.unionByName(unknown)
