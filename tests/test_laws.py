"""Algebraic laws, corner cases and brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark import DATE, DOUBLE, INT, TemporalMap
from tidemark.operators import algebra, bins
from tidemark.sources import read_facts, write_facts

SCHEMA = "key string, value int, lo bigint, hi bigint"


def make(spark, seed, n=120):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), rng.randrange(4), lo := rng.randrange(60), lo + rng.randrange(-2, 9)) for _ in range(n)]
    return TemporalMap(spark.createDataFrame(rows, SCHEMA))


def points(m):
    return {(r["key"], r["value"], t) for r in m.facts.collect() for t in range(r["lo"], r["hi"])}


@pytest.fixture(scope="module")
def two(spark):
    a, b = make(spark, 1), make(spark, 2)
    return TemporalMap(a.facts.cache(), coalesced=True), TemporalMap(b.facts.cache(), coalesced=True)


def test_set_algebra_by_points(two):
    a, b = two
    pa, pb = points(a), points(b)
    assert points(a + b) == pa | pb
    assert points(a - b) == pa - pb
    assert points(a & b) == pa & pb
    assert ((a - b) + (a & b)).equals(a)
    assert (a - a).is_empty()
    assert not a.equals(b)
    assert (a + a).equals(a)
    assert a.invert().invert().equals(a)


def test_facts_are_coalesced(two):
    rows = sorted((r["key"], r["value"], r["lo"], r["hi"]) for r in two[0].facts.collect())
    for x, y in itertools.pairwise(rows):
        assert x[:2] != y[:2] or x[3] < y[2]
    assert algebra.same_facts(algebra.coalesce(two[0].facts, bin_ticks=7), two[0].facts)


def test_subsets_partition(two):
    a = two[0]
    parts = [a.subset([k]) for k in "abc"]
    assert (parts[0] + parts[1] + parts[2]).equals(a)
    assert (a.subset_values([0, 1]) + a.subset_values([2, 3])).equals(a)
    assert points(a.subset(["a", "b"], [1], 10, 30)) == {p for p in points(a) if p[0] in "ab" and p[1] == 1 and 10 <= p[2] < 30}
    assert a.subset([]).is_empty()
    assert a.subset(lo=5, hi=5).is_empty()


def test_erase_and_insert(two):
    a = two[0]
    assert points(a.erase_interval(10, 20)) == {p for p in points(a) if not 10 <= p[2] < 20}
    assert points(a.erase_key("a", 10, 20)) == {p for p in points(a) if p[0] != "a" or not 10 <= p[2] < 20}
    assert points(a.erase_pairs([("a", 1)], 10, 20)) == {p for p in points(a) if p[:2] != ("a", 1) or not 10 <= p[2] < 20}
    assert a.erase_pairs([("z", 1)]).equals(a)
    assert a.inverse_erase([(1, "a", 10, 20)]).equals(a.erase([("a", 1, 10, 20)]))
    assert a.erase([("a", 1, 10, 20)]).insert((a & a.clear().insert([("a", 1, 10, 20)]))).equals(a)
    assert a.insert([("q", 9, 5, 5), ("q", 9, 7, 3)]).equals(a)
    assert a.inverse_insert([(9, "q", 5, 8)]).equals(a.insert([("q", 9, 5, 8)]))
    assert points(a.insert_pair("q", 9, 3, 5)) - points(a) == {("q", 9, 3), ("q", 9, 4)}
    assert a.inverse_insert_pairs([(9, "q")], 3, 5).equals(a.insert_pair("q", 9, 3, 5))


def test_segments_reinserted_give_the_facts(two):
    a = two[0]
    seg = algebra.segments(a.facts)
    again = TemporalMap(seg.select("key", F.explode("values").alias("value"), "lo", "hi"))
    assert again.equals(a)
    flat = algebra.segments(a.flattened().facts)
    assert flat.where(F.size("values") > 1).isEmpty()


def test_gaps_and_edges(two):
    a = two[0]
    covered = {}
    for k, _, t in points(a):
        covered.setdefault(k, set()).add(t)
    expected = set()
    for k, ts in covered.items():
        inner = [t for t in range(min(ts), max(ts)) if t not in ts]
        expected |= {(k, t) for t in inner}
    assert {(r["key"], t) for r in a.gaps().collect() for t in range(r["glo"], r["ghi"])} == expected
    for r in a.sandwiched_gaps().collect():
        assert r["before"] == sorted(v for k, v, t in points(a) if k == r["key"] and t == r["glo"] - 1)
        assert r["after"] == sorted(v for k, v, t in points(a) if k == r["key"] and t == r["ghi"])
    assert {r["key"]: r["lo"] for r in a.initial_values().collect()} == {k: min(ts) for k, ts in covered.items()}
    assert {r["key"]: r["hi"] - 1 for r in a.final_values().collect()} == {k: max(ts) for k, ts in covered.items()}


def test_fill_gaps_with_never_overlaps(two):
    a, b = two
    delta = a.fill_gaps_with(b) - a
    covered = {(k, t) for k, _, t in points(a)}
    assert not covered & {(k, t) for k, _, t in points(delta)}


def test_join_by_points(two):
    a, b = two
    b = b.transform_keys(lambda k: F.ascii(k) - 97)
    right = points(b)
    expected = {(k, w, t) for k, v, t in points(a) for q, w, s in right if v == q and s == t}
    assert points(a.joined_to(b)) == expected


def test_count_overlaps_by_brute_force(spark):
    edges = list(itertools.product(range(4), range(1, 5)))
    rows = [("k", i, lo, lo + n) for i, (lo, n) in enumerate(edges)] + [("k", 99, 0, 1), ("j", 0, 0, 3)]
    found = {(r["key"], r["value"]): r["overlaps"] for r in algebra.count_overlaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, v, lo, hi in rows:
        later = [r for r in rows if r[0] == k and (r[2], r[3]) > (lo, hi)]
        assert found[k, v] == sum(r[2] < hi and lo < r[3] for r in later)


@pytest.mark.parametrize(("kind", "shown"), [("right_open", "[2001-07-{},2001-07-{})"), ("left_open", "(2001-07-{},2001-07-{}]"), ("open", "(2001-07-{},2001-07-{})"), ("closed", "[2001-07-{},2001-07-{}]")])
def test_lines_in_the_maps_own_bounds(spark, kind, shown):
    import datetime as dt

    def day(d):
        return dt.date(2001, 7, d)

    m = TemporalMap.from_rows(spark, [("road", 8, day(4), day(16)), ("road", 6, day(9), day(16)), ("mill", 8, day(10), day(21))], DATE.with_bounds(kind))
    step = {"right_open": 0, "left_open": 0, "open": 1, "closed": -1}[kind]  # from where one segment begins to where the other ends
    lines = [r["line"] for r in m.lines().collect()]
    assert lines == ["mill\t[8]\t" + shown.format("10", "21"), "road\t[8]\t" + shown.format("04", f"{9 + step:02}"), "road\t[6, 8]\t" + shown.format("09", "16")]
    assert [tuple(r) for r in m.subset("road", 6).fact_lines().collect()] == [("road", "6, " + shown.format("09", "16"))]
    assert [r["line"] for r in TemporalMap.from_rows(spark, [("q", 1, 2.5, 4.0)], DOUBLE).lines().collect()] == ["q\t[1]\t[2.5,4.0)"]


def test_iteration_is_ordered(two):
    rows = list(two[0].iterate(["c", "a"], 5, 25))
    assert rows == sorted(rows, key=lambda r: (r[0], r[2], r[3], r[1]))
    assert {(k, v, t) for k, v, lo, hi in rows for t in range(lo, hi)} == {p for p in points(two[0]) if p[0] in "ac" and 5 <= p[2] < 25}


def test_ticks_are_whole():
    assert INT.tick(3.0) == 3
    for bad in (2.7, "x", None):
        with pytest.raises((ValueError, TypeError)):
            INT.tick(bad)
    with pytest.raises(ValueError, match="NaN"):
        DOUBLE.tick(float("nan"))


def test_nulls_and_nan_are_no_facts(spark, two):
    rows = [(None, 1, 0, 5), ("a", None, 0, 5), ("a", 1, None, 5), ("a", 1, 0, None), ("a", 2, 7, 7), ("a", 2, 9, 3), ("z", 3, 0, 4)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in TemporalMap(frame).facts.collect()] == [("z", 3, 0, 4)]
    assert two[0].insert(frame).equals(two[0].insert([("z", 3, 0, 4)]))
    assert (two[0] + TemporalMap(frame)).equals(two[0].insert([("z", 3, 0, 4)]))
    assert two[0].erase(frame).equals(two[0])
    assert [tuple(r) for r in TemporalMap(frame).disjoint_intervals().collect()] == [("z", 0, 4, [3])]
    nan = float("nan")
    odd = spark.createDataFrame([("a", 1, nan, 5.0), ("a", 1, 2.0, nan), ("a", 1, 2.0, 3.0)], "key string, value int, lo double, hi double")
    assert [tuple(r) for r in TemporalMap(odd, DOUBLE).facts.collect()] == [("a", 1, 2.0, 3.0)]


def test_inverse_pairs_as_a_frame(spark, two):
    pairs = spark.createDataFrame([(9, "q"), (1, "a")], "key int, value string")
    assert two[0].inverse_insert_pairs(pairs, 3, 5).equals(two[0].inverse_insert_pairs([(9, "q"), (1, "a")], 3, 5))
    assert two[0].inverse_erase_pairs(pairs, 3, 50).equals(two[0].erase_pairs([("a", 1)], 3, 50))


def test_time_bins_change_nothing(two):
    a = two[0]
    binned = TemporalMap(a.facts, bin_ticks=5)
    assert binned.equals(a) and binned.fill_gaps().equals(a.fill_gaps()) and binned.flattened().equals(a.flattened())
    assert binned.disjoint_intervals().collect() == a.disjoint_intervals().collect()
    assert sorted(binned.gaps().collect()) == sorted(a.gaps().collect())


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_facts_of_all_lengths_meet(spark, kind):
    """Lengths over many levels, both signs, extents of the domain: each overlapping pair exactly once."""
    rng = random.Random(kind)

    def fact(k):
        at, n = rng.choice([0, 1, -1]) * 8 ** rng.randrange(0, 21) + rng.randrange(-9, 9), 8 ** rng.randrange(0, 21)
        lo, hi = max(at, -(2**62)), min(at + rng.randrange(1, n + 1), 2**62)
        return (k, rng.randrange(3), lo, hi) if kind == "bigint" else (k, rng.randrange(3), lo / 64, hi / 64)

    types = f"key int, value int, lo {kind}, hi {kind}"
    left, right = [fact(i) for i in range(150)], [fact(i) for i in range(150)]
    far = 2**62 if kind == "bigint" else 1.7e308
    left += [(900, 1, -far, far), (901, 1, far / 2 if kind == "double" else far // 2, far)]
    right += [(1, 900, -far, far), (1, 901, -far, -far / 2 if kind == "double" else -far // 2)]
    right = [(r[1] if r[0] != 1 or r[1] < 900 else 1, i, r[2], r[3]) for i, r in enumerate(right)]
    pairs = bins.meeting(spark.createDataFrame(left, types), spark.createDataFrame(right, types), "value", "key")
    found = sorted((r["l_key"], r["r_value"]) for r in pairs.collect())
    want = sorted((a[0], b[1]) for a in left for b in right if a[1] == b[0] and a[2] < b[3] and b[2] < a[3] and a[2] < a[3] and b[2] < b[3])
    assert found == want and len(want) > 100


def test_extents_do_not_overflow(spark):
    m = TemporalMap(spark.createDataFrame([("a", 1, INT.minimum, 5), ("b", 1, 5, INT.maximum)], SCHEMA))
    assert m.fill_to_start(None, 10).fill_to_end(None, 10).subset(["a", "b"]).facts.where("hi > 2147483647 or lo < -2147483648").isEmpty()


def test_from_frame_policies(spark):
    frame = spark.createDataFrame([("a", 1, 0, None), (None, 1, 0, 5), ("a", None, 0, 5), ("a", 1, None, 5), ("b", 1, 5, 5), ("b", 2, 9, 3)], "k string, v int, a bigint, b bigint")
    m = TemporalMap.from_frame(frame, "k", "v", "a", "b", INT)
    assert [tuple(r) for r in m.facts.collect()] == [("a", 1, 0, INT.maximum)]


def test_parquet_round_trip_and_empty(spark, tmp_path, two):
    write_facts(two[0], str(tmp_path / "facts"))
    assert read_facts(spark, str(tmp_path / "facts"), INT).equals(two[0])
    e = TemporalMap.empty(spark)
    assert e.is_empty() and (e + two[0]).equals(two[0]) and e.fill_gaps().is_empty() and e.disjoint_intervals().isEmpty() and e.joined_to(e.invert()).is_empty()


def test_stream_of_inserts(spark, tmp_path, two):
    from tidemark.streaming import insert_stream

    two[0].facts.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = insert_stream(stream, str(tmp_path / "out"), INT).option("checkpointLocation", str(tmp_path / "log")).start()
    query.processAllAvailable()
    query.stop()
    assert read_facts(spark, str(tmp_path / "out"), INT, coalesced=False).equals(two[0])
