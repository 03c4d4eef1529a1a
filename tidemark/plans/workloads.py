"""Dictionaries built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.dictionary import TemporalMap
from tidemark.domain import DATE, TIMESTAMP, Domain
from tidemark.sources import table

DAY_MICROS = 86_400_000_000

#: name: (table, key, value, time, length in ticks, domain)
SOURCES: dict[str, tuple[str, str, str, str, int, Domain]] = {
    "status": ("orders", "o_custkey", "o_orderstatus", "o_orderdate", 90, DATE),
    "orders": ("orders", "o_custkey", "o_orderkey", "o_orderdate", 180, DATE),
    "suppliers": ("lineitem", "l_orderkey", "l_suppkey", "l_shipdate", 60, DATE),
    "events": ("events", "user_id", "event_type", "ts", 6 * 3_600_000_000, TIMESTAMP),
    "parts": ("lineitem", "l_partkey", "l_suppkey", "l_shipdate", 60, DATE),
}


def raw_facts(spark: SparkSession, sf_dir: str, name: str, shift: int = 0) -> DataFrame:
    source, key, value, time, length, domain = SOURCES[name]
    frame = table(spark, sf_dir, source)
    lo = domain.tick_column(F.col(time)) + F.lit(shift).cast("bigint")

    def plain(column: str):
        return F.col(column) if dict(frame.dtypes)[column] == "string" else F.col(column).cast("bigint")

    return frame.select(plain(key).alias("key"), plain(value).alias("value"), lo.alias("lo"), (lo + length).alias("hi"))


def temporal_map(spark: SparkSession, sf_dir: str, name: str, shift: int = 0) -> TemporalMap:
    return TemporalMap(raw_facts(spark, sf_dir, name, shift), SOURCES[name][-1])


def hot_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of "parts" with a third of the keys made one: key 0 holds a third of all rows."""
    rows = raw_facts(spark, sf_dir, "parts")
    return rows.withColumn("key", F.when(F.col("key") % 3 == 0, F.lit(0)).otherwise(F.col("key")).cast("bigint"))


def facts_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of "parts" with nulls in every column, and reversed intervals."""
    rows = raw_facts(spark, sf_dir, "parts")
    holes = {"key": F.col("key") % 5, "value": F.col("value") % 7, "lo": F.col("lo") % 11, "hi": F.col("hi") % 13}
    made = {c: F.when(m != 0, F.col(c)) for c, m in holes.items()}
    return rows.withColumns(made).withColumn("hi", F.when(F.col("lo") % 17 == 0, F.col("lo") - 1).otherwise(F.col("hi")))


#: Shapes of a key's facts, by the number n of a row among the m rows of its key:
#: SQL for value, lo and hi.
SHAPES: dict[str, tuple[str, str, str]] = {
    "overlaps": ("n", "n * 10", "n * 10 + 25"),  # each one overlaps the next two
    "pyramid": ("n", "n", "2 * m - n"),  # each one lies inside the one before
    "swaps": ("(o * 7919) % 4", "n * 10", "n * 10 + 10"),  # values that take turns at random
}


def shaped_facts(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    """One fact per order, in groups of about 50 by order number, laid out in one of the SHAPES."""
    order = F.col("o_orderkey").cast("bigint")
    rows = table(spark, sf_dir, "orders").select(F.floor(order / 50).cast("bigint").alias("key"), order.alias("o"))
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("o")).cast("bigint")).withColumn("m", F.count("*").over(Window.partitionBy("key")) + 1)
    value, lo, hi = SHAPES[shape]
    return numbered.select("key", F.expr(value).cast("bigint").alias("value"), F.expr(lo).cast("bigint").alias("lo"), F.expr(hi).cast("bigint").alias("hi"))
