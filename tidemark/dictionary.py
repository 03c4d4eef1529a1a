"""TemporalMap: an immutable one-to-many dictionary valid over intervals.

One DataFrame of coalesced facts ``(key, value, lo, hi)`` serves both
directions; methods return new maps and run nothing.  Points and intervals are
given in the domain's own type or in ticks.

Facts with a null key, value or bound, a NaN bound, or an empty or reversed interval
are no facts: every constructor and insertion leaves them out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.domain import INT, Domain
from tidemark.operators import algebra, fill, flatten, lookup


class TemporalMap:
    def __init__(self, facts: DataFrame, domain: Domain = INT, coalesced: bool = False, bin_ticks: int | None = None):
        """``coalesced`` vouches that the facts are valid and merged already.  ``bin_ticks`` is a
        stretch of time in which one hot key's or pair's facts fit one task: coalescing and
        segmenting are then dealt to such bins first.  Results are the same."""
        rows = facts.select("key", "value", "lo", "hi")
        self.domain, self.bin_ticks = domain, bin_ticks
        #: The same facts, perhaps in pieces: what asks only for values or clips to a window
        #: filters these, so that its filters come before the exchange of the merging.
        self.rows = rows if coalesced else algebra.valid(rows)
        self.facts = rows if coalesced else algebra.coalesce(rows, bin_ticks=bin_ticks)

    # construction

    @classmethod
    def empty(cls, spark: SparkSession, key_type: str = "string", value_type: str = "int", domain: Domain = INT) -> TemporalMap:
        t = domain.sql_type
        return cls(spark.createDataFrame([], f"key {key_type}, value {value_type}, lo {t}, hi {t}"), domain, True)

    @classmethod
    def from_frame(cls, frame: DataFrame, key: str, value: str, lo: str, hi: str, domain: Domain, bounds: str | None = None, bin_ticks: int | None = None) -> TemporalMap:
        """Columns of the domain's own type; ``bounds`` names a kind or a column of kinds.

        Rows with a null key, value or lo are left out (the model has none);
        a null hi means valid from lo on.
        """
        kind = F.col(bounds) if bounds in frame.columns else bounds
        a, b = domain.canonical_columns(F.col(lo), F.col(hi), kind)
        rows = frame.select(F.col(key).alias("key"), F.col(value).alias("value"), a.alias("lo"), F.coalesce(b, domain.literal(domain.maximum)).alias("hi"))
        return cls(rows, domain, bin_ticks=bin_ticks)

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Iterable[tuple], domain: Domain = INT, key_type: str = "string", value_type: str = "int") -> TemporalMap:
        """(key, value, lo, hi) or (key, value, lo, hi, bounds kind) tuples."""
        made = [(k, v, *domain.canonical(lo, hi, *kind)) for k, v, lo, hi, *kind in rows]
        t = domain.sql_type
        return cls(spark.createDataFrame(made, f"key {key_type}, value {value_type}, lo {t}, hi {t}"), domain)

    def _with(self, facts: DataFrame, coalesced: bool = False) -> TemporalMap:
        return TemporalMap(facts, self.domain, coalesced, self.bin_ticks)

    def _within(self, rows: DataFrame, lo, hi) -> DataFrame:
        """Merged facts of ``rows`` (some of self.rows) inside [lo, hi): clipping pieces first gives the same."""
        if rows is self.facts or self.rows is self.facts or (lo is None and hi is None):
            return algebra.clip(rows, *self._query(lo, hi)).where("lo < hi")
        return algebra.coalesce(algebra.clip(rows, *self._query(lo, hi)), bin_ticks=self.bin_ticks)

    def _query(self, lo, hi) -> tuple[float, float]:
        if lo is None and hi is None:
            return self.domain.minimum, self.domain.maximum + self.domain.discrete
        lo = self.domain.minimum if lo is None else lo
        return self.domain.canonical(lo, self.domain.maximum if hi is None else hi)

    def _facts_of(self, rows) -> DataFrame:
        if isinstance(rows, TemporalMap):
            return rows.facts
        if isinstance(rows, DataFrame):
            return rows.select("key", "value", "lo", "hi")
        made = [(k, v, *self.domain.canonical(lo, hi)) for k, v, lo, hi in rows]
        return self.facts.sparkSession.createDataFrame(made, self.facts.schema)

    def _pairs_at(self, pairs, lo, hi) -> DataFrame:
        a, b = self._query(lo, hi)
        if not isinstance(pairs, DataFrame):
            fields = [self.facts.schema["key"], self.facts.schema["value"]]
            pairs = self.facts.sparkSession.createDataFrame(list(pairs), type(self.facts.schema)(fields))
        return pairs.select("key", "value", self.domain.literal(a).alias("lo"), self.domain.literal(b).alias("hi"))

    @staticmethod
    def _swap(rows):
        if isinstance(rows, TemporalMap | DataFrame):
            return algebra.invert(rows.facts if isinstance(rows, TemporalMap) else rows)
        return [(k, v, *rest) for v, k, *rest in rows]

    @staticmethod
    def _swap_pairs(pairs):
        """(value, key) pairs, or a frame of this map's inverse (its key is a value here), the right way round."""
        if isinstance(pairs, DataFrame):
            return pairs.select(F.col("value").alias("key"), F.col("key").alias("value"))
        return [(k, v) for v, k in pairs]

    # insertion and erasure

    def insert(self, rows) -> TemporalMap:
        return self._with(self.rows.unionByName(self._facts_of(rows)))

    def insert_pairs(self, pairs, lo=None, hi=None) -> TemporalMap:
        """(key, value) pairs over one interval; without bounds, for all time; without hi, from lo on."""
        return self._with(self.rows.unionByName(self._pairs_at(pairs, lo, hi)))

    def insert_pair(self, key, value, lo=None, hi=None) -> TemporalMap:
        return self.insert_pairs([(key, value)], lo, hi)

    def inverse_insert(self, rows) -> TemporalMap:
        return self.insert(self._swap(rows))

    def inverse_insert_pairs(self, pairs, lo=None, hi=None) -> TemporalMap:
        return self.insert_pairs(self._swap_pairs(pairs), lo, hi)

    def erase(self, rows) -> TemporalMap:
        return self._with(algebra.subtract(self.facts, self._facts_of(rows)), True)

    def erase_pairs(self, pairs, lo=None, hi=None) -> TemporalMap:
        return self._with(algebra.subtract(self.facts, self._pairs_at(pairs, lo, hi)), True)

    def erase_key(self, key, lo=None, hi=None) -> TemporalMap:
        a, b = self._query(lo, hi)
        return self._with(algebra.cut(self.facts, self.domain.literal(a), self.domain.literal(b), F.col("key") == F.lit(key)), True)

    def erase_interval(self, lo=None, hi=None) -> TemporalMap:
        a, b = self._query(lo, hi)
        return self._with(algebra.cut(self.facts, self.domain.literal(a), self.domain.literal(b), F.lit(True)), True)

    def inverse_erase(self, rows) -> TemporalMap:
        return self.erase(self._swap(rows))

    def inverse_erase_pairs(self, pairs, lo=None, hi=None) -> TemporalMap:
        return self.erase_pairs(self._swap_pairs(pairs), lo, hi)

    def clear(self) -> TemporalMap:
        return self._with(self.facts.where(F.lit(False)), True)

    # lookup

    def find(self, keys=None, lo=None, hi=None) -> DataFrame:
        """Sorted distinct values of one key, several keys, or a frame of keys."""
        rows = lookup.overlapping(lookup.matching(self.rows, "key", keys), *self._query(lo, hi))
        return lookup.distinct_sorted(rows, "value")

    def find_at(self, key, point, strict: bool = False) -> DataFrame:
        """Values at a point.  ``strict`` asks for {point, point}, which is empty unless bounds are closed."""
        if strict:
            return self.find(key, point, point)
        tick = self.domain.tick(point)
        return lookup.distinct_sorted(lookup.at_point(lookup.matching(self.rows, "key", key), tick), "value")

    def find_in(self, keys, windows: DataFrame, bin_ticks: int | None = None) -> DataFrame:
        """Values valid somewhere in a set of query intervals (lo, hi in ticks)."""
        rows = lookup.overlapping_any(lookup.matching(self.rows, "key", keys), windows, bin_ticks)
        return lookup.distinct_sorted(rows, "value")

    def inverse_find(self, values=None, lo=None, hi=None) -> DataFrame:
        return self.invert().find(values, lo, hi).withColumnRenamed("value", "key")

    def inverse_find_at(self, value, point, strict: bool = False) -> DataFrame:
        return self.invert().find_at(value, point, strict).withColumnRenamed("value", "key")

    def inverse_find_in(self, values, windows: DataFrame, bin_ticks: int | None = None) -> DataFrame:
        return self.invert().find_in(values, windows, bin_ticks).withColumnRenamed("value", "key")

    def keys(self) -> DataFrame:
        return lookup.distinct_sorted(self.rows, "key")

    def values(self) -> DataFrame:
        return lookup.distinct_sorted(self.rows, "value")

    def sizes(self) -> DataFrame:
        """One row: n_keys, n_values."""
        return self.rows.agg(F.countDistinct("key").alias("n_keys"), F.countDistinct("value").alias("n_values"))

    def size(self) -> int:
        return self.rows.select("key").distinct().count()

    def inverse_size(self) -> int:
        return self.rows.select("value").distinct().count()

    def is_empty(self) -> bool:
        return self.rows.isEmpty()

    def contains(self, key) -> bool:
        return not lookup.matching(self.rows, "key", key).isEmpty()

    def count(self, key) -> int:
        return int(self.contains(key))

    def contains_value(self, value) -> bool:
        return not lookup.matching(self.rows, "value", value).isEmpty()

    def count_value(self, value) -> int:
        return int(self.contains_value(value))

    # enumeration

    def intervals(self, keys=None, lo=None, hi=None) -> DataFrame:
        bounded = lo is not None or hi is not None
        rows = self._within(lookup.matching(self.rows if bounded else self.facts, "key", keys), lo, hi)
        return rows.orderBy("key", "lo", "hi", "value")

    def iterate(self, keys=None, lo=None, hi=None) -> Iterator[tuple]:
        """(key, value, lo, hi) in that order of key, lo, hi and value, with points of the domain's own
        type for half-open bounds; read partition by partition, so the driver holds one at a time."""
        point = self.domain.point_column
        rows = self.intervals(keys, lo, hi).select("key", "value", point(F.col("lo")).alias("lo"), point(F.col("hi")).alias("hi"))
        return (tuple(r) for r in rows.toLocalIterator())

    def disjoint_intervals(self, keys=None, lo=None, hi=None) -> DataFrame:
        bounded = lo is not None or hi is not None
        facts = lookup.matching(self.facts, "key", keys) if not bounded else self._within(lookup.matching(self.rows, "key", keys), lo, hi)
        return algebra.segments(facts, self.bin_ticks).orderBy("key", "lo")

    def gaps(self) -> DataFrame:
        return algebra.gaps(self.rows, self.bin_ticks)

    def sandwiched_gaps(self) -> DataFrame:
        return algebra.sandwiched_gaps(self.rows)

    def initial_values(self) -> DataFrame:
        return algebra.edge_values(self.facts, "first")

    def final_values(self) -> DataFrame:
        return algebra.edge_values(self.facts, "last")

    def count_overlaps(self) -> DataFrame:
        return algebra.count_overlaps(self.facts)

    def _shown(self) -> Column:
        """The interval as text, with the bounds kind of the map: the points are those it was built from."""
        kind, point = self.domain.bounds, self.domain.point_column
        left, right = self.domain.shifts()
        lo, hi = point(F.col("lo") - left).cast("string"), point(F.col("hi") - right).cast("string")
        return F.concat(F.lit("[" if kind in ("right_open", "closed") else "("), lo, F.lit(","), hi, F.lit("]" if kind in ("left_open", "closed") else ")"))

    def lines(self) -> DataFrame:
        """One text line per segment: key, tab, [v1, v2], tab, interval; ordered."""
        values = F.concat(F.lit("["), F.array_join(F.col("values").cast("array<string>"), ", "), F.lit("]"))
        return self.disjoint_intervals().select(F.concat_ws("\t", F.col("key").cast("string"), values, self._shown()).alias("line"))

    def fact_lines(self) -> DataFrame:
        """key and, as one text, the value and the interval of each fact; ordered."""
        return self.intervals().select("key", F.concat_ws(", ", F.col("value").cast("string"), self._shown()).alias("line"))

    # projection

    def subset(self, keys=None, values=None, lo=None, hi=None) -> TemporalMap:
        if lo is None and hi is None:
            return self._with(lookup.subset(self.facts, keys, values), True)
        return self._with(self._within(lookup.subset(self.rows, keys, values), lo, hi), True)

    def subset_values(self, values, lo=None, hi=None) -> TemporalMap:
        return self.subset(None, values, lo, hi)

    def invert(self) -> TemporalMap:
        return self._with(algebra.invert(self.facts), True)

    def transform_values(self, change) -> TemporalMap:
        return self._with(self.facts.withColumn("value", change(F.col("value"))))

    def transform_keys(self, change) -> TemporalMap:
        return self._with(self.facts.withColumn("key", change(F.col("key"))))

    # joins, gap filling, set algebra, flattening

    def joined_to(self, other: TemporalMap) -> TemporalMap:
        return self._with(algebra.temporal_join(self.facts, other.facts), True)

    def self_joined(self) -> TemporalMap:
        """Keys that share values at the same time: the join with the inverse."""
        return self._with(algebra.shared_values(self.facts), True)

    def _plus(self, delta: DataFrame) -> TemporalMap:
        return self._with(self.rows.unionByName(delta))

    def fill_gaps(self, ext=None) -> TemporalMap:
        return self._plus(fill.gap_fills(self.rows, self.domain, ext))

    def extend_into_gaps(self, direction: str = "both", ext=None) -> TemporalMap:
        return self._plus(fill.gap_extensions(self.rows, self.domain, direction, ext))

    def fill_to_start(self, start=None, ext=None) -> TemporalMap:
        return self._plus(fill.start_extensions(self.rows, self.domain, start, ext))

    def fill_to_end(self, start=None, ext=None) -> TemporalMap:
        return self._plus(fill.end_extensions(self.rows, self.domain, start, ext))

    def fill_gaps_with(self, other: TemporalMap) -> TemporalMap:
        return self._plus(fill.backstop_fills(self.rows, other.rows))

    def merge(self, other: TemporalMap) -> TemporalMap:
        return self._plus(other.rows)

    def subtract(self, other: TemporalMap) -> TemporalMap:
        return self._with(algebra.subtract(self.facts, other.facts), True)

    def intersect(self, other: TemporalMap) -> TemporalMap:
        return self._with(algebra.intersect(self.facts, other.facts), True)

    __add__ = merge
    __sub__ = subtract
    __and__ = intersect

    def equals(self, other: TemporalMap) -> bool:
        return algebra.same_facts(self.facts, other.facts)

    def flattened(self, policy: flatten.Policy | None = None) -> TemporalMap:
        return self._with(flatten.flatten(self.facts, policy), True)
