"""Coalescing, segmentation, gaps, set algebra and temporal joins.

All functions take and return DataFrames; ``key, value, lo, hi`` are the
column names.  Each needs one exchange on its grouping columns; windows and
aggregations below are arranged so that they share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import bins


def valid(facts: DataFrame, by: tuple[str, ...] = ("key", "value")) -> DataFrame:
    """Only facts of the model: no null or NaN, and not empty or reversed."""
    rows = facts.where("lo < hi")
    for c in by:
        rows = rows.where(F.col(c).isNotNull())
    return rows.where(~F.isnan("hi")) if facts.schema["hi"].dataType.typeName() in ("double", "float") else rows


def coalesce(facts: DataFrame, by: tuple[str, ...] = ("key", "value"), bin_ticks: int | None = None) -> DataFrame:
    """Merge overlapping or touching facts of equal ``by``; empty facts and nulls vanish.

    ``bin_ticks`` first merges inside bins of ``lo``, which splits the work of a
    hot group over many tasks; merging is associative, so the result is the same.
    """
    rows = valid(facts, by).select(*by, "lo", "hi")
    if bin_ticks:
        number = F.floor(F.col("lo") / F.lit(bin_ticks))
        rows = _islands(rows.withColumn("_bin", number), (*by, "_bin")).select(*by, "lo", "hi")
    return _islands(rows, by)


def _islands(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("lo", "hi")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("_reach", F.max("hi").over(before))
    starts = F.when(F.col("_reach").isNull() | (F.col("lo") > F.col("_reach")), 1).otherwise(0)
    return (
        marked.withColumn("_start", starts)
        .withColumn("_island", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*by, "_island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("_island")
    )


def segments(facts: DataFrame, bin_ticks: int | None = None) -> DataFrame:
    """Disjoint segments per key with the sorted set of values alive: (key, lo, hi, values).

    Each fact is laid over the ranks of its end points, so the rows made are
    those of the answer and there is no join on ranges.  With ``bin_ticks`` facts are
    first cut at bins of that width, which deals a hot key to many tasks; pieces of a
    segment that the cuts parted are merged again (the facts must be coalesced).
    """
    if not bin_ticks:
        return _laid(facts, ("key",)).select("key", "lo", "hi", "values")
    width = F.lit(bin_ticks)
    first, last = F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width) if facts.schema["lo"].dataType.typeName() == "long" else F.floor(F.col("hi") / width)
    pieces = facts.where("lo < hi").withColumn("_bin", F.explode(F.sequence(first, last)))
    edge = facts.schema["lo"].dataType
    clipped = pieces.withColumns({"lo": F.greatest("lo", (F.col("_bin") * width).cast(edge)), "hi": F.least("hi", ((F.col("_bin") + 1) * width).cast(edge))})
    return coalesce(_laid(clipped.where("lo < hi"), ("key", "_bin")), ("key", "values")).select("key", "lo", "hi", "values")


def _laid(facts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    fact = F.struct("value", "lo", "hi")
    ends = facts.where("lo < hi").select(
        *by, fact.alias("fact"), F.explode(F.array(F.col("lo"), F.col("hi"))).alias("t")
    )
    ranked = ends.withColumn("rank", F.dense_rank().over(Window.partitionBy(*by).orderBy("t")))
    edge = F.struct(F.col("rank").alias("rank"), F.col("t").alias("t"), F.lit(None).cast(facts.schema["value"].dataType).alias("value"), F.lit(False).alias("live"))
    steps = F.when(
        F.col("t") == F.col("fact.lo"),
        F.transform(
            F.sequence(F.col("rank"), F.col("last") - 1),
            lambda r: F.struct(r.alias("rank"), F.lit(None).cast(facts.schema["lo"].dataType).alias("t"), F.col("fact.value").alias("value"), F.lit(True).alias("live")),
        ),
    )
    pair = Window.partitionBy(*by, "fact")
    laid = (
        ranked.withColumn("last", F.max("rank").over(pair))
        .select(*by, F.explode(F.concat(F.array(edge), F.coalesce(steps, F.array().cast(_array_of(facts))))).alias("s"))
        .select(*by, "s.*")
        .groupBy(*by, "rank")
        .agg(F.max("t").alias("lo"), F.sort_array(F.collect_set("value")).alias("values"))
    )
    following = F.lead("lo").over(Window.partitionBy(*by).orderBy("rank"))
    return laid.withColumn("hi", following).where(F.size("values") > 0).select(*by, "lo", "hi", "values")


def _array_of(facts: DataFrame) -> str:
    v, t = facts.schema["value"].dataType.simpleString(), facts.schema["lo"].dataType.simpleString()
    return f"array<struct<rank:int,t:{t},value:{v},live:boolean>>"


def gaps(facts: DataFrame, bin_ticks: int | None = None) -> DataFrame:
    """Interior gaps of each key's coverage: (key, glo, ghi)."""
    following = F.lead("lo").over(Window.partitionBy("key").orderBy("lo"))
    return (
        coalesce(facts, ("key",), bin_ticks)
        .withColumn("ghi", following)
        .where(F.col("ghi").isNotNull())
        .select("key", F.col("hi").alias("glo"), "ghi")
    )


def gap_sides(facts: DataFrame) -> DataFrame:
    """The values on either side of each gap: (key, value, glo, ghi, before, after).

    ``before`` says that the value ends where the gap begins, ``after`` that it begins
    where the gap ends.  Windows over the key only: one exchange and no join.
    """
    order = Window.partitionBy("key").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    start = F.when(F.col("_reach").isNull() | (F.col("lo") > F.col("_reach")), 1).otherwise(0)
    island = Window.partitionBy("key").orderBy("_island")
    known = (
        valid(facts).withColumn("_reach", reach).withColumn("_start", start)
        .withColumn("_island", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumns({
            "_end": F.max("hi").over(island.rangeBetween(0, 0)), "_begin": F.min("lo").over(island.rangeBetween(0, 0)),
            "_next": F.min("lo").over(island.rangeBetween(1, 1)), "_last": F.max("hi").over(island.rangeBetween(-1, -1)),
        })
    )
    ends = (F.col("hi") == F.col("_end")) & F.col("_next").isNotNull()
    begins = (F.col("lo") == F.col("_begin")) & F.col("_last").isNotNull()
    sides = F.filter(
        F.array(
            F.when(ends, F.struct(F.col("_end").alias("glo"), F.col("_next").alias("ghi"), F.lit(1).alias("before"), F.lit(0).alias("after"))),
            F.when(begins, F.struct(F.col("_last").alias("glo"), F.col("_begin").alias("ghi"), F.lit(0).alias("before"), F.lit(1).alias("after"))),
        ),
        lambda x: x.isNotNull(),
    )
    rows = known.select("key", "value", F.explode(sides).alias("s")).select("key", "value", "s.*")
    return rows.groupBy("key", "value", "glo", "ghi").agg((F.max("before") > 0).alias("before"), (F.max("after") > 0).alias("after"))


def sandwiched_gaps(facts: DataFrame) -> DataFrame:
    """Gaps with the sorted values on both sides: (key, glo, ghi, before, after)."""
    side = lambda c: F.sort_array(F.collect_set(F.when(F.col(c), F.col("value")))).alias(c)
    return gap_sides(facts).groupBy("key", "glo", "ghi").agg(side("before"), side("after"))


def edge_values(facts: DataFrame, side: str) -> DataFrame:
    """First (side="first") or last segment of each key: (key, lo, hi, values)."""
    pick = F.min_by if side == "first" else F.max_by
    best = segments(facts).groupBy("key").agg(pick(F.struct("lo", "hi", "values"), "lo").alias("_s"))
    return best.select("key", "_s.lo", "_s.hi", "_s.values")


def clip(facts: DataFrame, lo, hi) -> DataFrame:
    """The parts of the facts inside [lo, hi); none if that is empty."""
    if not lo < hi:
        return facts.where(F.lit(False))
    return facts.where((F.col("lo") < hi) & (F.col("hi") > lo)).withColumns(
        {"lo": F.greatest("lo", F.lit(lo).cast(facts.schema["lo"].dataType)), "hi": F.least("hi", F.lit(hi).cast(facts.schema["hi"].dataType))}
    )


def cut(facts: DataFrame, lo: Column, hi: Column, when: Column) -> DataFrame:
    """Remove [lo, hi) from the rows where ``when`` holds; other rows pass unchanged."""
    touched = F.coalesce(when & (F.col("lo") < hi) & (lo < F.col("hi")) & (lo < hi), F.lit(False))
    whole = F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi"))
    left = F.struct(F.col("lo").alias("lo"), F.least(F.col("hi"), lo).alias("hi"))
    right = F.struct(F.greatest(F.col("lo"), hi).alias("lo"), F.col("hi").alias("hi"))
    parts = F.when(touched, F.array(left, right)).otherwise(F.array(whole))
    return facts.select("key", "value", F.explode(parts).alias("p")).select("key", "value", "p.lo", "p.hi").where("lo < hi")


def _sweep(left: DataFrame, right: DataFrame, keep: Column) -> DataFrame:
    """Stretches of each (key, value) by how many facts of either side are alive there."""

    def ends(rows: DataFrame, l: int, r: int) -> DataFrame:  # noqa: E741
        pair = F.array(
            F.struct(F.col("lo").alias("t"), F.lit(l).alias("l"), F.lit(r).alias("r")),
            F.struct(F.col("hi").alias("t"), F.lit(-l).alias("l"), F.lit(-r).alias("r")),
        )
        return rows.where("lo < hi").select("key", "value", F.explode(pair).alias("e")).select("key", "value", "e.*")

    events = ends(left, 1, 0).unionByName(ends(right, 0, 1))
    steps = events.groupBy("key", "value", "t").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    order = Window.partitionBy("key", "value").orderBy("t")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    live = steps.select(
        "key", "value", F.col("t").alias("lo"), F.lead("t").over(order).alias("hi"),
        F.sum("l").over(running).alias("l"), F.sum("r").over(running).alias("r"),
    )
    return coalesce(live.where(keep))


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    return _sweep(left, right, (F.col("l") > 0) & (F.col("r") == 0))


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    return _sweep(left, right, (F.col("l") > 0) & (F.col("r") > 0))


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return coalesce(out)


def same_facts(left: DataFrame, right: DataFrame) -> bool:
    a, b = coalesce(left), coalesce(right)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def temporal_join(ab: DataFrame, bc: DataFrame) -> DataFrame:
    """A->B with B->C gives A->C over the common intervals.

    An equi-join on B and time bins (see bins.meeting), so that a hot B forms no pairs
    of facts that are far apart in time; its bins are dealt to many tasks.
    """
    pairs = bins.meeting(ab, bc, "value", "key").select(
        F.col("l_key").alias("key"), F.col("r_value").alias("value"),
        F.greatest("l_lo", "r_lo").alias("lo"), F.least("l_hi", "r_hi").alias("hi"),
    )
    return coalesce(pairs)


def shared_values(facts: DataFrame) -> DataFrame:
    """A->B with B->A: keys that share values at the same time.

    The relation is symmetric, so only pairs key <= value are joined and merged;
    the others are their mirror images.
    """
    pairs = bins.meeting(facts, facts, "value", "value").where("l_key <= r_key").select(
        F.col("l_key").alias("key"), F.col("r_key").alias("value"),
        F.greatest("l_lo", "r_lo").alias("lo"), F.least("l_hi", "r_hi").alias("hi"),
    )
    pair, mirror = F.struct("key", "value"), F.struct(F.col("value").alias("key"), F.col("key").alias("value"))
    both = F.when(F.col("key") == F.col("value"), F.array(pair)).otherwise(F.array(pair, mirror))
    return coalesce(pairs).select(F.explode(both).alias("p"), "lo", "hi").select("p.key", "p.value", "lo", "hi")


def invert(facts: DataFrame) -> DataFrame:
    return facts.select(F.col("value").alias("key"), F.col("key").alias("value"), "lo", "hi")


def count_overlaps(intervals: DataFrame, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """For each row, in the order of (lo, hi) within ``by``: how many later rows
    overlap it without being identical to it.  Adds ``overlaps``.

    A later row overlaps exactly if it begins before this one ends, so the count
    is a difference of two running counts; no pair of rows is ever formed.
    """
    rows = intervals.where("lo < hi")
    other = [c for c in rows.columns if c not in ("lo", "hi")]
    begins = rows.select(*other, "lo", "hi", F.col("lo").alias("_t"), F.lit(1).alias("_kind"))
    asks = rows.select(*other, "lo", "hi", F.col("hi").alias("_t"), F.lit(0).alias("_kind"))
    group = Window.partitionBy(*by)
    place = begins.withColumn("_n", F.count("*").over(group.orderBy("lo", "hi"))).select(*other, "lo", "hi", "_n", "_t", "_kind")
    asked = asks.select(*other, "lo", "hi", F.lit(None).cast("bigint").alias("_n"), "_t", "_kind")
    both = place.unionByName(asked)
    before = group.orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("_begun", F.sum("_kind").over(before))
    exact = Window.partitionBy(*by, "lo", "hi")
    return (
        counted.withColumn("_place", F.max("_n").over(exact))
        .where("_kind = 0")
        .select(*other, "lo", "hi", (F.col("_begun") - F.col("_place")).alias("overlaps"))
    )
