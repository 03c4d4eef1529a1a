"""A small map of our own over every domain and bounds kind, against a model in plain Python.

The model knows nothing of merging or ranks: it cuts a key's timeline at every end
point and keeps the set of values of each cell.
"""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import DATE, DOUBLE, INT, TIMESTAMP, TemporalMap
from tidemark.operators import flatten

# (key, value, first point, last point) by number of the point.  oak: touching facts, one value split by
# another's; elm: nested and shared end points, then a gap with one value on both sides; ash: two gaps,
# different values around the first; fig: a single fact; yew: equal facts and an empty one
FACTS = [
    ("oak", 11, 1, 3), ("oak", 11, 3, 4), ("oak", 12, 4, 7),
    ("elm", 21, 0, 6), ("elm", 22, 2, 4), ("elm", 23, 4, 6), ("elm", 22, 9, 12), ("elm", 23, 9, 10),
    ("ash", 31, 2, 3), ("ash", 32, 5, 8), ("ash", 33, 7, 8), ("ash", 32, 10, 13),
    ("fig", 41, 6, 7), ("yew", 11, 5, 9), ("yew", 11, 5, 9), ("yew", 12, 8, 8),
]
# what the values lead to
NEXT = [(11, 0.5, 0, 13), (12, 1.5, 2, 5), (12, 2.5, 5, 6), (21, 0.5, 1, 2), (22, 3.5, 3, 11), (23, 3.5, 0, 1), (32, 1.5, 6, 11), (33, 4.5, 8, 9), (41, 2.5, 0, 6), (99, 9.5, 0, 13)]
KINDS = ("right_open", "left_open", "open", "closed")
DAYS = [dt.date(1999, 11, 3) + dt.timedelta(days=9 * i) for i in range(14)]
DOMAINS = [
    (INT, [7 * i - 20 for i in range(14)], 4), (DATE, DAYS, 5), (TIMESTAMP, [dt.datetime(d.year, d.month, d.day, 6, 30) for d in DAYS], dt.timedelta(hours=50)),
    (DOUBLE, [2.5 * i - 4 for i in range(14)], 1.25),
]
CASES = [(d.with_bounds(k), v, n) for d, v, n in DOMAINS for k in KINDS if d.discrete or k in ("right_open", "left_open")]


class Model:
    """Sets of (value) per key and cell between neighbouring end points."""

    def __init__(self, facts, cuts=()):
        self.facts = {f for f in facts if f[2] < f[3]}
        self.cuts = sorted({t for _, _, lo, hi in self.facts for t in (lo, hi)} | set(cuts))

    def cells(self, key):
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            yield a, b, frozenset(v for k, v, lo, hi in self.facts if k == key and lo <= a and b <= hi)

    def keys(self):
        return sorted({f[0] for f in self.facts})

    def merged(self):
        out = set()
        for key, value in {f[:2] for f in self.facts}:
            begin = last = None
            for a, b, values in [*self.cells(key), (None, None, frozenset())]:
                if value in values:
                    begin, last = (a if begin is None else begin), b
                elif begin is not None:
                    out.add((key, value, begin, last))
                    begin = None
        return out

    def segments(self):
        out = []
        for key in self.keys():
            for a, b, values in self.cells(key):
                if values and out and out[-1][0] == key and out[-1][2] == a and out[-1][3] == values:
                    out[-1] = (key, out[-1][1], b, values)
                elif values:
                    out.append((key, a, b, values))
        return [(k, a, b, sorted(v)) for k, a, b, v in out]

    def gaps(self):
        """(key, from, to, values before, values after)"""
        out = []
        for key in self.keys():
            held = [(a, b, v) for a, b, v in self.cells(key) if v]
            out += [(key, x[1], y[0], x[2], y[2]) for x, y in zip(held, held[1:], strict=False) if x[1] < y[0]]
        return out

    def with_(self, facts):
        return Model(self.facts | set(facts))


class Golden:
    def __init__(self, spark, domain, points, length):
        self.spark, self.domain, self.v, self.n = spark, domain, points, domain.span(length)
        self.length = length
        self.schema = f"key string, value int, lo {domain.sql_type}, hi {domain.sql_type}"
        self.map = TemporalMap.from_rows(spark, [(k, v, points[i], points[j]) for k, v, i, j in FACTS], domain)
        self.model = Model([(k, v, *domain.canonical(points[i], points[j])) for k, v, i, j in FACTS])
        self.next = TemporalMap.from_rows(spark, [(k, v, points[i], points[j]) for k, v, i, j in NEXT], domain, "int", "double")

    def same(self, m, model):
        assert {tuple(r) for r in m.facts.collect()} == model.merged()


@pytest.fixture(params=CASES, ids=lambda c: f"{c[0].kind}-{c[0].bounds}")
def golden(request, spark):
    return Golden(spark, *request.param)


def test_facts_segments_and_gaps(golden):
    g = golden
    g.same(g.map, g.model)
    found = [(r["key"], r["lo"], r["hi"], r["values"]) for r in g.map.disjoint_intervals().collect()]
    assert found == g.model.segments()
    gaps = {(r["key"], r["glo"], r["ghi"], frozenset(r["before"]), frozenset(r["after"])) for r in g.map.sandwiched_gaps().collect()}
    assert gaps == set(g.model.gaps())
    assert {(r["key"], r["glo"], r["ghi"]) for r in g.map.gaps().collect()} == {x[:3] for x in gaps}


def test_fills(golden):
    g = golden
    m, model, n = g.map, g.model, g.n
    gaps = model.gaps()
    g.same(m.fill_gaps(), model.with_((k, v, a, b) for k, a, b, x, y in gaps for v in x & y))
    near = [(k, v, *p) for k, a, b, x, y in gaps for v in x & y for p in ([(a, b)] if b - a <= n else [(a, a + n), (b - n, b)])]
    g.same(m.fill_gaps(g.length), model.with_(near))
    on = [(k, v, a, b if b - a <= n else a + n) for k, a, b, x, _ in gaps for v in x]
    back = [(k, v, a if b - a <= n else b - n, b) for k, a, b, _, y in gaps for v in y]
    g.same(m.extend_into_gaps("forwards", g.length), model.with_(on))
    g.same(m.extend_into_gaps("backwards", g.length), model.with_(back))
    g.same(m.extend_into_gaps("both", g.length), model.with_(on + back))
    g.same(m.extend_into_gaps(), model.with_((k, v, a, b) for k, a, b, x, y in gaps for v in x | y))
    least = {k: min(f[2] for f in model.facts if f[0] == k) for k in model.keys()}
    most = {k: max(f[3] for f in model.facts if f[0] == k) for k in model.keys()}
    first = [f for f in model.facts if f[2] == least[f[0]]]
    last = [f for f in model.facts if f[3] == most[f[0]]]
    g.same(m.fill_to_start(), model.with_((k, v, g.domain.minimum, lo) for k, v, lo, _ in first))
    g.same(m.fill_to_end(None, g.length), model.with_((k, v, hi, hi + n) for k, v, _, hi in last))
    before = g.domain.canonical(g.v[0], g.v[2])[1]
    g.same(m.fill_to_start(g.v[2], g.length), model.with_((k, v, lo - n, lo) for k, v, lo, _ in first if lo < before))
    after = g.domain.canonical(g.v[9], g.v[10])[0]
    g.same(m.fill_to_end(g.v[9]), model.with_((k, v, hi, g.domain.maximum) for k, v, _, hi in last if hi > after))
    backstop = [("elm", 77, 3, 11), ("gum", 78, 2, 5)]
    other = TemporalMap.from_rows(g.spark, [(k, v, g.v[i], g.v[j]) for k, v, i, j in backstop], g.domain)
    lo, hi = g.domain.canonical(g.v[3], g.v[11])
    inside = [("elm", 77, max(lo, a), min(hi, b)) for k, a, b, *_ in gaps if k == "elm"]
    g.same(m.fill_gaps_with(other), model.with_([*inside, ("gum", 78, *g.domain.canonical(g.v[2], g.v[5]))]))


SOME = [c for c in CASES if c[0].kind == "int" or c[0].bounds == "right_open"]


@pytest.fixture(params=SOME, ids=lambda c: f"{c[0].kind}-{c[0].bounds}")
def some(request, spark):
    return Golden(spark, *request.param)


def test_find(some):
    g = some

    def values(frame):
        return [r[0] for r in frame.collect()]

    def wanted(keys, *windows):
        return sorted({v for k, v, lo, hi in g.model.facts if k in keys and any(lo < b and a < hi for a, b in windows)})

    everything = (g.domain.minimum, g.domain.maximum)
    assert values(g.map.find()) == wanted(g.model.keys(), everything)
    assert values(g.map.find(["oak", "ash"])) == wanted(["oak", "ash"], everything)
    assert values(g.map.find("elm", g.v[3], g.v[5])) == wanted(["elm"], g.domain.canonical(g.v[3], g.v[5]))
    assert values(g.map.find("nobody")) == []
    # a strict point query asks for {t, t}, which has a point only between closed bounds
    assert bool(values(g.map.find_at("elm", g.v[3], strict=True))) == (g.domain.bounds == "closed")
    asked = [g.domain.canonical(g.v[0], g.v[1]), g.domain.canonical(g.v[9], g.v[11])]
    windows = g.spark.createDataFrame(asked, f"lo {g.domain.sql_type}, hi {g.domain.sql_type}")
    assert values(g.map.find_in(["elm", "ash"], windows)) == wanted(["elm", "ash"], *asked)
    assert values(g.map.inverse_find(11)) == ["oak", "yew"]
    assert values(g.map.inverse_find_in(23, windows)) == ["elm"]
    assert values(g.map.keys()) == g.model.keys()
    assert (g.map.size(), g.map.inverse_size(), g.map.count("fig"), g.map.count("gum"), g.map.contains_value(33)) == (5, 9, 1, 0, True)
    assert g.map.clear().is_empty()
    inside = g.domain.canonical(g.v[2], g.v[9])
    clipped = Model((k, v, max(lo, inside[0]), min(hi, inside[1])) for k, v, lo, hi in g.model.facts)
    g.same(g.map.subset(None, None, g.v[2], g.v[9]), clipped)


def test_flatten(some):
    g = some

    def expected(choose):
        out, last = [], None
        for key, a, b, values in g.model.segments():
            status_quo = last[2] if last and last[0] == key and last[1] == a else None
            value = values[0] if len(values) == 1 else choose(status_quo, values)
            if value is not None:
                out.append((key, value, a, b))
            last = (key, b, values[0] if len(values) == 1 else None)
        return Model(out)

    keeps = lambda s, vs: s if s in vs else None
    g.same(g.map.flattened(), expected(keeps))
    g.same(g.map.flattened(flatten.discard), expected(lambda s, vs: None))

    def custom(status_quo, lo, hi, key, values):
        return F.when(F.array_contains(values, status_quo), status_quo + 1000).otherwise(F.array_max(values))

    g.same(g.map.flattened(custom), expected(lambda s, vs: s + 1000 if s in vs else max(vs)))
    g.same(g.map.flattened(flatten.prefer_status_quo(custom)), expected(lambda s, vs: s if s in vs else max(vs)))


def test_join(some):
    g = some

    def joined(left, right):
        return Model((k, w, max(a, c), min(b, d)) for k, v, a, b in left for q, w, c, d in right if v == q and max(a, c) < min(b, d))

    rows = [tuple(r) for r in g.next.facts.collect()]
    a, b = g.map, g.next
    g.same(a.joined_to(b), joined(g.model.merged(), rows))
    assert a.joined_to(b).invert().equals(b.invert().joined_to(a.invert()))
    e = a.extend_into_gaps()
    model = Model([tuple(r) for r in e.facts.collect()])
    shared = joined(model.merged(), [(v, k, lo, hi) for k, v, lo, hi in model.merged()])
    g.same(e.self_joined(), shared)
    assert e.self_joined().equals(e.joined_to(e.invert()))
