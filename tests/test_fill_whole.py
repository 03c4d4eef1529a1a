"""The backstop fill over the whole map: every key with a gap, and keys that the map lacks."""

from pyspark.sql import functions as F

from tidemark.plans import queries as plans
from tidemark.plans.workloads import temporal_map

SF = "/root/testdata/sf0.01"


def test_fill_gaps_with_takes_all_keys(spark):
    m, other = temporal_map(spark, SF, "status"), temporal_map(spark, SF, "status", 200)
    found = plans.QUERIES["fill_gaps_with"](spark, SF).cache()
    # nothing of the map is lost, whatever its key
    assert m.facts.select("key").distinct().join(found, "key", "left_anti").isEmpty()
    ticks = F.sum(F.col("hi") - F.col("lo"))
    cover = {r["key"]: r[1] for r in found.groupBy("key").agg(ticks).collect()}
    own = {r["key"]: r[1] for r in m.facts.groupBy("key").agg(ticks).collect()}
    assert all(cover[k] >= n for k, n in own.items())
    # each key whose gap the backstop reaches has grown, also above the first 1,000
    inside = other.facts.join(m.gaps(), "key").where("lo < ghi and glo < hi").select("key").distinct()
    reached = {r["key"] for r in inside.collect()}
    assert max(reached) > 1000 and all(cover[k] > own[k] for k in reached)
    # keys that the map lacks are copied whole
    copied = {tuple(r) for r in found.where("key < 0").collect()}
    assert copied == {(-1 - r["key"], r["value"], r["lo"], r["hi"]) for r in other.facts.collect()}
