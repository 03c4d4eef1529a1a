"""Flattening to one value per key and instant, under a policy.

A policy is a function of Columns ``(status_quo, lo, hi, key, values)`` giving
the chosen value, or null to drop the segment.  A status quo exists for a
multi-valued segment exactly if the segment right before it is single-valued
and touches it, so one ``lag`` over the segments decides everything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import algebra

Policy = Callable[[Column, Column, Column, Column, Column], Column]


def discard(status_quo: Column, lo: Column, hi: Column, key: Column, values: Column) -> Column:
    return F.lit(None)


def prefer_status_quo(fallback: Policy = discard) -> Policy:
    def policy(status_quo: Column, lo: Column, hi: Column, key: Column, values: Column) -> Column:
        keeps = status_quo.isNotNull() & F.array_contains(values, status_quo)
        return F.when(keeps, status_quo).otherwise(fallback(status_quo, lo, hi, key, values))

    return policy


def flatten(facts: DataFrame, policy: Policy | None = None) -> DataFrame:
    policy = policy or prefer_status_quo()
    kind = facts.schema["value"].dataType
    order = Window.partitionBy("key").orderBy("lo")
    lone = F.when(F.size("values") == 1, F.element_at("values", 1))
    seen = (
        algebra.segments(facts)
        .withColumn("_lone", lone)
        .withColumn("_sq", F.when(F.lag("hi").over(order) == F.col("lo"), F.lag("_lone").over(order)))
    )
    chosen = policy(F.col("_sq"), F.col("lo"), F.col("hi"), F.col("key"), F.col("values")).cast(kind)
    value = F.when(F.size("values") == 1, F.col("_lone")).otherwise(chosen)
    return algebra.coalesce(seen.select("key", value.alias("value"), "lo", "hi").where(F.col("value").isNotNull()))
