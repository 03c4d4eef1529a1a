"""Time bins of growing width, so that overlapping facts meet by equality.

A fact of length n belongs to level ceil(log8(n)), whose bins are 8^level ticks
wide: it lies in at most two of them.  Two facts meet at the higher of their levels.
There the longer one is in its own bins and the shorter one a guest; guests
never meet guests, so a hot key with facts of all lengths forms no needless pairs.
Levels that a side does not have are left out, which a scalar subquery tells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_BITS = 3
#: Ticks beyond 2^50 bins are not told apart by a double, so such facts take a wider level.
EXACT_BITS = 50

_NO_LEVELS = "array<int>"


def level_of(lo: Column, hi: Column) -> Column:
    a, b = lo.cast("double"), hi.cast("double")
    length = F.ceil(F.log2(F.least(F.greatest(b - a, F.lit(1e-30)), F.lit(1e308))) / BASE_BITS)
    reach = F.ceil((F.log2(F.greatest(F.abs(a), F.abs(b), F.lit(1e-30))) - EXACT_BITS) / BASE_BITS)
    return F.greatest(length, reach).cast("int")


def bin_of(tick: Column, level: Column) -> Column:
    return F.floor(tick.cast("double") / F.pow(F.lit(float(2**BASE_BITS)), level)).cast("bigint")


def levels(facts: DataFrame) -> DataFrame:
    """One row: the levels that the facts have (a few dozen at most)."""
    return facts.agg(F.sort_array(F.collect_set(level_of(F.col("lo"), F.col("hi")))).cast(_NO_LEVELS).alias("levels"))


def dealt(facts: DataFrame, others: Column, left: bool) -> DataFrame:
    """The facts once for each bin in which they may meet a fact of the other side, whose
    levels are ``others``; adds _level, _role and _bin.  Role 0: both sides own the bin,
    1: the left one does, 2: the right one does."""
    own = level_of(F.col("lo"), F.col("hi"))
    as_owner, as_guest = (1, 2) if left else (2, 1)
    here = facts.where("lo < hi").withColumn("_own", own).withColumn("_others", others)

    def place(level: Column, role: int) -> Column:
        return F.struct(level.cast("int").alias("level"), F.lit(role).alias("role"))

    roles = F.concat(
        F.when(F.array_contains("_others", F.col("_own")), F.array(place(F.col("_own"), 0))).otherwise(F.array().cast("array<struct<level:int,role:int>>")),
        F.when(F.exists("_others", lambda o: o < F.col("_own")), F.array(place(F.col("_own"), as_owner))).otherwise(F.array().cast("array<struct<level:int,role:int>>")),
        F.transform(F.filter("_others", lambda o: o > F.col("_own")), lambda o: place(o, as_guest)),
    )
    placed = here.withColumn("_place", F.explode(roles)).withColumn("_level", F.col("_place.level")).withColumn("_role", F.col("_place.role"))
    bins = F.sequence(bin_of(F.col("lo"), F.col("_level")), bin_of(F.col("hi"), F.col("_level")))
    return placed.withColumn("_bin", F.explode(bins)).drop("_own", "_others", "_place")


def meeting(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """All pairs of overlapping facts of equal keys, once each: columns l_* and r_*."""
    a = dealt(left, levels(right).scalar(), True)
    b = dealt(right, levels(left).scalar(), False)
    a = a.select(*[F.col(c).alias(f"l_{c}") for c in left.columns], "_level", "_role", "_bin")
    b = b.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.col("_level").alias("_level2"), F.col("_role").alias("_role2"), F.col("_bin").alias("_bin2"))
    same = (F.col(f"l_{left_key}") == F.col(f"r_{right_key}")) & (F.col("_level") == F.col("_level2")) & (F.col("_role") == F.col("_role2")) & (F.col("_bin") == F.col("_bin2"))
    overlap = (F.col("l_lo") < F.col("r_hi")) & (F.col("r_lo") < F.col("l_hi"))
    first = bin_of(F.greatest("l_lo", "r_lo"), F.col("_level")) == F.col("_bin")
    return a.join(b, same & overlap & first).drop("_level", "_role", "_bin", "_level2", "_role2", "_bin2")
