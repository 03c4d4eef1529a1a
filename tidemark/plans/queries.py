"""The registered queries: one per operator, each with DuckDB SQL where it can be put so."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import functions as scalar
from tidemark.dictionary import TemporalMap
from tidemark.domain import BIGINT, BOUNDS, DATE, DOUBLE
from tidemark.operators import algebra, flatten
from tidemark.plans.workloads import SHAPES, SOURCES, facts_with_nulls, hot_facts, raw_facts, shaped_facts, temporal_map
from tidemark.sources import fresh_path, read_facts, table, write_facts

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# 1995-01-01, 1996-01-01, 1996-07-01 in epoch days; the same in a date's type would do as well.
D0, D1, D2 = 9131, 9496, 9678
ALL = (DATE.minimum, DATE.maximum + 1)


def _facts(m: TemporalMap) -> DataFrame:
    return m.facts


def _listed(rows: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        rows = rows.withColumn(c, F.array_join(F.col(c).cast("array<string>"), ","))
    return rows


# SQL pieces: each makes a named common table expression

def _raw(name: str, cte: str = "r", shift: int = 0) -> str:
    source, key, value, time, length, domain = SOURCES[name]
    lo = f"epoch_us({time})" if domain.kind == "timestamp" else f"(CAST({time} AS DATE) - DATE '1970-01-01')"
    plain = {"o_orderstatus": "o_orderstatus", "event_type": "event_type"}.get(value, f"CAST({value} AS BIGINT)")
    return f"{cte} AS (SELECT CAST({key} AS BIGINT) AS key, {plain} AS value, CAST({lo} + {shift} AS BIGINT) AS lo, CAST({lo} + {shift} + {length} AS BIGINT) AS hi FROM {source})"


def _co(cte: str, src: str, by: str = "key, value") -> str:
    """Equal rows are taken once, so that both windows have one total order: with ties, the
    two may number equal rows differently and a start mark land on the wrong one."""
    return f"""{cte} AS (SELECT {by}, min(lo) AS lo, max(hi) AS hi FROM (
      SELECT *, sum(s) OVER (PARTITION BY {by} ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY {by} ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS s
        FROM (SELECT DISTINCT {by}, lo, hi FROM {src} WHERE lo < hi) u) a) b GROUP BY {by}, g)"""


def _map(name: str, cte: str = "f", shift: int = 0) -> str:
    return f"{_raw(name, f'raw_{cte}', shift)}, {_co(cte, f'raw_{cte}')}"


def _seg(cte: str, src: str) -> str:
    return f"""{cte} AS (SELECT key, lo, hi, count(*) AS n, min(value) AS v1, max(value) AS v2, string_agg(CAST(value AS VARCHAR), ',' ORDER BY value) AS "values" FROM (
      SELECT DISTINCT e.key, e.lo, e.hi, f.value FROM (
        SELECT key, t AS lo, lead(t) OVER (PARTITION BY key ORDER BY t) AS hi FROM (SELECT key, lo AS t FROM {src} UNION SELECT key, hi FROM {src}) p) e
      JOIN {src} f ON f.key = e.key AND f.lo <= e.lo AND f.hi >= e.hi) d GROUP BY key, lo, hi)"""


def _gap(cte: str, src: str) -> str:
    return f"""{_co(f'cover_{cte}', src, 'key')}, {cte} AS (SELECT key, hi AS glo, nxt AS ghi FROM (
      SELECT key, hi, lead(lo) OVER (PARTITION BY key ORDER BY lo) AS nxt FROM cover_{cte}) z WHERE nxt IS NOT NULL)"""


def _minus(cte: str, a: str, b: str, keep: str = "l > 0 AND r = 0") -> str:
    return f"""st_{cte} AS (SELECT key, value, t AS lo, lead(t) OVER w AS hi, sum(l) OVER w AS l, sum(r) OVER w AS r FROM (
      SELECT key, value, t, sum(l) AS l, sum(r) AS r FROM (
        SELECT key, value, lo AS t, 1 AS l, 0 AS r FROM {a} UNION ALL SELECT key, value, hi, -1, 0 FROM {a}
        UNION ALL SELECT key, value, lo, 0, 1 FROM {b} UNION ALL SELECT key, value, hi, 0, -1 FROM {b}) u GROUP BY key, value, t) v
      WINDOW w AS (PARTITION BY key, value ORDER BY t)), kept_{cte} AS (SELECT key, value, lo, hi FROM st_{cte} WHERE {keep} AND hi IS NOT NULL), {_co(cte, f'kept_{cte}')}"""


def _clip(src: str, lo: int, hi: int, where: str = "TRUE", columns: str = "key, value") -> str:
    return f"SELECT {columns}, greatest(lo, {lo}) AS lo, least(hi, {hi}) AS hi FROM {src} WHERE lo < {hi} AND hi > {lo} AND {where}"


def _plus(delta: str, ctes: str, cte: str = "o") -> str:
    """Facts f with a delta query added."""
    return f"WITH {ctes}, d AS (SELECT key, value, lo, hi FROM f UNION ALL {delta}), {_co(cte, 'd')} SELECT key, value, lo, hi FROM {cte}"


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


FACTS = "SELECT key, value, lo, hi FROM"

for _name in SOURCES:
    _add(f"coalesce_{_name}", lambda s, d, n=_name: _facts(temporal_map(s, d, n)), f"WITH {_map(_name)} {FACTS} f")
_add("coalesce_binned", lambda s, d: algebra.coalesce(raw_facts(s, d, "parts"), bin_ticks=365), f"WITH {_map('parts')} {FACTS} f")
for _name in ("status", "events", "parts"):
    _add(
        f"segments_{_name}", lambda s, d, n=_name: _listed(algebra.segments(temporal_map(s, d, n).facts), "values"),
        f"WITH {_map(_name)}, {_seg('g', 'f')} SELECT key, lo, hi, \"values\" FROM g",
    )
_add("lines", lambda s, d: temporal_map(s, d, "status").lines(), f"""WITH {_map('status')}, {_seg('g', 'f')}
  SELECT CAST(key AS VARCHAR) || chr(9) || '[' || replace("values", ',', ', ') || ']' || chr(9) || '[' || strftime(DATE '1970-01-01' + CAST(lo AS INTEGER), '%Y-%m-%d') || ',' || strftime(DATE '1970-01-01' + CAST(hi AS INTEGER), '%Y-%m-%d') || ')' AS line FROM g""")
for _kind in BOUNDS:
    _l, _r = int(_kind in ("left_open", "open")), int(_kind in ("left_open", "closed"))
    _add(
        f"bounds_{_kind}",
        lambda s, d, k=_kind: TemporalMap.from_frame(
            table(s, d, "orders").select(F.col("o_custkey").cast("bigint").alias("k"), F.col("o_orderstatus").alias("v"), F.col("o_orderdate").alias("a"), F.date_add(F.col("o_orderdate").cast("date"), 90).alias("b")),
            "k", "v", "a", "b", DATE, k,
        ).facts,
        f"WITH {_raw('status')}, s AS (SELECT key, value, lo + {_l} AS lo, hi + {_r} AS hi FROM r), {_co('f', 's')} {FACTS} f",
    )
_add(
    "bounds_dynamic",
    lambda s, d: TemporalMap.from_frame(
        table(s, d, "orders").select(F.col("o_custkey").cast("bigint").alias("k"), F.col("o_orderstatus").alias("v"), F.col("o_orderdate").alias("a"), F.date_add(F.col("o_orderdate").cast("date"), 90).alias("b"), F.when(F.col("o_orderkey") % 2 == 0, "closed").otherwise("open").alias("kind")),
        "k", "v", "a", "b", DATE, "kind",
    ).facts,
    f"""WITH s AS (SELECT CAST(o_custkey AS BIGINT) AS key, o_orderstatus AS value, CAST((CAST(o_orderdate AS DATE) - DATE '1970-01-01') + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS BIGINT) AS lo,
      CAST((CAST(o_orderdate AS DATE) - DATE '1970-01-01') + 90 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS hi FROM orders), {_co('f', 's')} {FACTS} f""",
)
_add(
    "double_domain",
    lambda s, d: TemporalMap.from_frame(table(s, d, "lineitem").select(F.col("l_suppkey").cast("bigint").alias("k"), F.col("l_returnflag").alias("v"), F.col("l_extendedprice").cast("double").alias("a"), (F.col("l_extendedprice").cast("double") + 64.0).alias("b")), "k", "v", "a", "b", DOUBLE).facts,
    f"WITH s AS (SELECT CAST(l_suppkey AS BIGINT) AS key, l_returnflag AS value, CAST(l_extendedprice AS DOUBLE) AS lo, CAST(l_extendedprice AS DOUBLE) + 64.0 AS hi FROM lineitem), {_co('f', 's')} {FACTS} f",
)

for _name in ("status", "events"):
    _add(f"gaps_{_name}", lambda s, d, n=_name: temporal_map(s, d, n).gaps(), f"WITH {_map(_name)}, {_gap('h', 'f')} SELECT key, glo, ghi FROM h")
_add("sandwiched_gaps", lambda s, d: _listed(temporal_map(s, d, "status").sandwiched_gaps(), "before", "after"), f"""WITH {_map('status')}, {_gap('h', 'f')}
  SELECT h.key, glo, ghi, (SELECT string_agg(DISTINCT value, ',' ORDER BY value) FROM f WHERE f.key = h.key AND f.hi = glo) AS before,
  (SELECT string_agg(DISTINCT value, ',' ORDER BY value) FROM f WHERE f.key = h.key AND f.lo = ghi) AS after FROM h""")
for _side, _agg in (("initial", "min"), ("final", "max")):
    _add(
        f"{_side}_values", lambda s, d, n=_side: _listed(getattr(temporal_map(s, d, "status"), f"{n}_values")(), "values"),
        f"WITH {_map('status')}, {_seg('g', 'f')} SELECT key, lo, hi, \"values\" FROM g WHERE (key, lo) IN (SELECT key, {_agg}(lo) FROM g GROUP BY key)",
    )

# lookups
_add("find_key", lambda s, d: temporal_map(s, d, "status").find(7, D0, D1), f"WITH {_map('status')} SELECT DISTINCT value FROM f WHERE key = 7 AND lo < {D1} AND hi > {D0}")
_add("find_key_all_time", lambda s, d: temporal_map(s, d, "status").find(7), f"WITH {_map('status')} SELECT DISTINCT value FROM f WHERE key = 7")
_add("find_keys", lambda s, d: temporal_map(s, d, "parts").find([1, 5, 9, 12], D0, D1), f"WITH {_map('parts')} SELECT DISTINCT value FROM f WHERE key IN (1, 5, 9, 12) AND lo < {D1} AND hi > {D0}")
_add("find_key_frame", lambda s, d: temporal_map(s, d, "status").find(table(s, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").cast("bigint")), D0, D1), f"WITH {_map('status')} SELECT DISTINCT value FROM f WHERE key IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND lo < {D1} AND hi > {D0}")
_add("find_at", lambda s, d: temporal_map(s, d, "parts").find_at(5, D0), f"WITH {_map('parts')} SELECT DISTINCT value FROM f WHERE key = 5 AND lo <= {D0} AND hi > {D0}")
_add("find_at_strict", lambda s, d: temporal_map(s, d, "parts").find_at(5, D0, strict=True), f"WITH {_map('parts')} SELECT DISTINCT value FROM f WHERE FALSE")


def _windows(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(D0, D0 + 40), (D1, D1 + 40), (D2, D2)], "lo bigint, hi bigint")


_SET = f"((lo < {D0 + 40} AND hi > {D0}) OR (lo < {D1 + 40} AND hi > {D1}))"
_add("find_interval_set", lambda s, d: temporal_map(s, d, "parts").find_in([5, 6], _windows(s)), f"WITH {_map('parts')} SELECT DISTINCT value FROM f WHERE key IN (5, 6) AND {_SET}")
_add("find_interval_set_binned", lambda s, d: temporal_map(s, d, "parts").find_in(None, _windows(s), bin_ticks=64), f"WITH {_map('parts')} SELECT DISTINCT value FROM f WHERE {_SET}")
_add("inverse_find_value", lambda s, d: temporal_map(s, d, "parts").inverse_find(3, D0, D1), f"WITH {_map('parts')} SELECT DISTINCT key FROM f WHERE value = 3 AND lo < {D1} AND hi > {D0}")
_add("inverse_find_values", lambda s, d: temporal_map(s, d, "parts").inverse_find([3, 4]), f"WITH {_map('parts')} SELECT DISTINCT key FROM f WHERE value IN (3, 4)")
_add("inverse_find_at", lambda s, d: temporal_map(s, d, "parts").inverse_find_at(3, D0), f"WITH {_map('parts')} SELECT DISTINCT key FROM f WHERE value = 3 AND lo <= {D0} AND hi > {D0}")
_add("inverse_find_interval_set", lambda s, d: temporal_map(s, d, "parts").inverse_find_in(3, _windows(s)), f"WITH {_map('parts')} SELECT DISTINCT key FROM f WHERE value = 3 AND {_SET}")
_add("keys", lambda s, d: temporal_map(s, d, "status").keys(), f"WITH {_map('status')} SELECT DISTINCT key FROM f")
_add("values", lambda s, d: temporal_map(s, d, "status").values(), f"WITH {_map('status')} SELECT DISTINCT value FROM f")
_add("sizes", lambda s, d: temporal_map(s, d, "parts").sizes(), f"WITH {_map('parts')} SELECT count(DISTINCT key) AS n_keys, count(DISTINCT value) AS n_values FROM f")
_add(
    "membership",
    lambda s, d: (lambda f: f.agg(F.max((F.col("key") == 7).cast("int")).alias("has_key"), F.max((F.col("key") == -1).cast("int")).alias("has_unknown_key"), F.max((F.col("value") == 3).cast("int")).alias("has_value"), (F.count("*") == 0).cast("int").alias("is_empty")))(temporal_map(s, d, "parts").facts),
    f"WITH {_map('parts')} SELECT CAST(max(CASE WHEN key = 7 THEN 1 ELSE 0 END) AS INTEGER) AS has_key, CAST(max(CASE WHEN key = -1 THEN 1 ELSE 0 END) AS INTEGER) AS has_unknown_key, CAST(max(CASE WHEN value = 3 THEN 1 ELSE 0 END) AS INTEGER) AS has_value, CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS INTEGER) AS is_empty FROM f",
)

# enumeration and subsets
_E0, _E1 = 1_704_067_200_000_000, 1_706_745_600_000_000
_add("intervals", lambda s, d: temporal_map(s, d, "status").intervals(None, D0, D1), f"WITH {_map('status')} {_clip('f', D0, D1)}")
_add("intervals_keys", lambda s, d: temporal_map(s, d, "status").intervals([3, 7, 10], D0, D2), f"WITH {_map('status')} {_clip('f', D0, D2, 'key IN (3, 7, 10)')}")
_add("disjoint_intervals", lambda s, d: _listed(temporal_map(s, d, "status").disjoint_intervals(None, D0, D1), "values"), f"WITH {_map('status')}, {_seg('g', 'f')} {_clip('g', D0, D1, columns='key, chr(34) AS q, ' + chr(34) + 'values' + chr(34)).replace('chr(34) AS q, ', '')}")
_add("disjoint_intervals_keys", lambda s, d: _listed(temporal_map(s, d, "parts").disjoint_intervals([3, 7, 10]), "values"), f"WITH {_map('parts')}, {_seg('g', 'f')} SELECT key, lo, hi, \"values\" FROM g WHERE key IN (3, 7, 10)")
_add("subset_keys", lambda s, d: temporal_map(s, d, "status").subset(range(1, 100), lo=D0, hi=D1).facts, f"WITH {_map('status')} {_clip('f', D0, D1, 'key BETWEEN 1 AND 99')}")
_add("subset_keys_values", lambda s, d: temporal_map(s, d, "status").subset(range(1, 100), ["F", "P"]).facts, f"WITH {_map('status')} {FACTS} f WHERE key BETWEEN 1 AND 99 AND value IN ('F', 'P')")
_add("subset_values", lambda s, d: temporal_map(s, d, "status").subset_values(["O"], D0, D2).facts, f"WITH {_map('status')} {_clip('f', D0, D2, chr(39).join(['value = ', 'O', '']))}")
_add("subset_empty", lambda s, d: temporal_map(s, d, "status").subset([], lo=D0, hi=D1).facts, f"WITH {_map('status')} {FACTS} f WHERE FALSE")
_add("invert", lambda s, d: temporal_map(s, d, "parts").invert().facts, f"WITH {_map('parts')} SELECT value AS key, key AS value, lo, hi FROM f")
_add("transform_values", lambda s, d: temporal_map(s, d, "parts").transform_values(lambda v: v % 5).facts, f"WITH {_map('parts')}, t AS (SELECT key, value % 5 AS value, lo, hi FROM f), {_co('o', 't')} {FACTS} o")
_add("transform_keys", lambda s, d: temporal_map(s, d, "parts").transform_keys(lambda k: k % 100).facts, f"WITH {_map('parts')}, t AS (SELECT key % 100 AS key, value, lo, hi FROM f), {_co('o', 't')} {FACTS} o")
for _name in ("events", "parts"):
    _add(
        f"count_overlaps_{_name}", lambda s, d, n=_name: temporal_map(s, d, n).count_overlaps(),
        f"WITH {_map(_name)} SELECT a.key, a.value, a.lo, a.hi, (SELECT count(*) FROM f b WHERE b.key = a.key AND (b.lo, b.hi) > (a.lo, a.hi) AND b.lo < a.hi) AS overlaps FROM f a",
    )

# insertion, erasure, set algebra
_SHIFTED = f"{_map('status')}, {_map('status', 'g', 30)}"
_add("union", lambda s, d: (temporal_map(s, d, "status") + temporal_map(s, d, "status", 30)).facts, f"WITH {_SHIFTED}, d AS ({FACTS} f UNION ALL {FACTS} g), {_co('o', 'd')} {FACTS} o")
_add("difference", lambda s, d: (temporal_map(s, d, "status") - temporal_map(s, d, "status", 30)).facts, f"WITH {_SHIFTED}, {_minus('o', 'f', 'g')} {FACTS} o")
_add("intersection", lambda s, d: (temporal_map(s, d, "status") & temporal_map(s, d, "status", 30)).facts, f"WITH {_SHIFTED}, {_minus('o', 'f', 'g', 'l > 0 AND r > 0')} {FACTS} o")
_add("equality", lambda s, d: (lambda a, b: a.facts.exceptAll(b.facts).unionByName(b.facts.exceptAll(a.facts)).agg(F.count("*").alias("differing")))(temporal_map(s, d, "status"), temporal_map(s, d, "status", 30)), f"WITH {_SHIFTED} SELECT count(*) AS differing FROM (({FACTS} f EXCEPT {FACTS} g) UNION ALL ({FACTS} g EXCEPT {FACTS} f)) x")
_add("insert_rows", lambda s, d: temporal_map(s, d, "status").insert(temporal_map(s, d, "status", 45)).facts, f"WITH {_map('status')}, {_map('status', 'g', 45)}, d AS ({FACTS} f UNION ALL {FACTS} g), {_co('o', 'd')} {FACTS} o")
_add("insert_pairs", lambda s, d: temporal_map(s, d, "status").insert_pairs([(7, "X"), (8, "O"), (-5, "F")], D0, D1).facts, _plus(f"SELECT * FROM (VALUES (7, 'X', {D0}, {D1}), (8, 'O', {D0}, {D1}), (-5, 'F', {D0}, {D1})) v(key, value, lo, hi)", _map("status")))
_add("insert_pair_from", lambda s, d: temporal_map(s, d, "status").insert_pair(7, "X", D0).facts, _plus(f"SELECT 7, 'X', {D0}, {DATE.maximum}", _map("status")))
_add("inverse_insert", lambda s, d: temporal_map(s, d, "status").inverse_insert([("X", 7, D0, D1), ("O", 8, D1, D0)]).facts, _plus(f"SELECT 7, 'X', {D0}, {D1}", _map("status")))
_add("inverse_insert_pairs", lambda s, d: temporal_map(s, d, "status").inverse_insert_pairs([("X", 7), ("O", 8)], D0, D1).facts, _plus(f"SELECT * FROM (VALUES (7, 'X', {D0}, {D1}), (8, 'O', {D0}, {D1})) v(key, value, lo, hi)", _map("status")))


def _erased(where: str, lo: int, hi: int) -> str:
    hit = f"({where}) AND lo < {hi} AND hi > {lo}"
    return f"WITH {_map('status')}, o AS ({FACTS} f WHERE NOT ({hit}) UNION ALL SELECT key, value, lo, least(hi, {lo}) FROM f WHERE {hit} UNION ALL SELECT key, value, greatest(lo, {hi}), hi FROM f WHERE {hit}) {FACTS} o WHERE lo < hi"


_add("erase_rows", lambda s, d: temporal_map(s, d, "status").erase(temporal_map(s, d, "status", 60)).facts, f"WITH {_map('status')}, {_map('status', 'g', 60)}, {_minus('o', 'f', 'g')} {FACTS} o")
_add("erase_pairs", lambda s, d: temporal_map(s, d, "status").erase_pairs([(7, "O"), (8, "F"), (-1, "F")], D0, D1).facts, _erased("(key = 7 AND value = 'O') OR (key = 8 AND value = 'F')", D0, D1))
_add("erase_key", lambda s, d: temporal_map(s, d, "status").erase_key(7, D0, D1).facts, _erased("key = 7", D0, D1))
_add("erase_key_all_time", lambda s, d: temporal_map(s, d, "status").erase_key(7).facts, f"WITH {_map('status')} {FACTS} f WHERE key <> 7")
_add("erase_interval", lambda s, d: temporal_map(s, d, "status").erase_interval(D0, D1).facts, _erased("TRUE", D0, D1))
_add("erase_from", lambda s, d: temporal_map(s, d, "status").erase_interval(D1).facts, _erased("TRUE", D1, DATE.maximum))
_add("inverse_erase", lambda s, d: temporal_map(s, d, "status").inverse_erase([("O", 7, D0, D1)]).facts, _erased("key = 7 AND value = 'O'", D0, D1))
_add("inverse_erase_pairs", lambda s, d: temporal_map(s, d, "status").inverse_erase_pairs([("O", 7), ("F", 8)], D0, D1).facts, _erased("(key = 7 AND value = 'O') OR (key = 8 AND value = 'F')", D0, D1))
_add("clear", lambda s, d: temporal_map(s, d, "status").clear().facts, f"WITH {_map('status')} {FACTS} f WHERE FALSE")

# gap filling
_FG = f"{_map('status')}, {_gap('h', 'f')}"
_LEFT = "SELECT h.key, a.value, glo, ghi FROM h JOIN f a ON a.key = h.key AND a.hi = glo"
_RIGHT = "SELECT h.key, b.value, glo, ghi FROM h JOIN f b ON b.key = h.key AND b.lo = ghi"
_BOTH = f"{_LEFT} JOIN f b ON b.key = h.key AND b.lo = ghi AND b.value = a.value"


def _pieces(src: str, ext: int | None, sides: str) -> str:
    if ext is None:
        return f"SELECT key, value, glo, ghi FROM ({src}) x"
    out = [f"SELECT key, value, glo, ghi FROM ({src}) x WHERE ghi - glo <= {ext}"]
    if "f" in sides:
        out.append(f"SELECT key, value, glo, glo + {ext} FROM ({src}) x WHERE ghi - glo > {ext}")
    if "b" in sides:
        out.append(f"SELECT key, value, ghi - {ext}, ghi FROM ({src}) x WHERE ghi - glo > {ext}")
    return " UNION ALL ".join(out)


for _ext in (None, 30):
    _tag = "" if _ext is None else f"_{_ext}"
    _add(f"fill_gaps{_tag}", lambda s, d, e=_ext: temporal_map(s, d, "status").fill_gaps(e).facts, _plus(_pieces(_BOTH, _ext, "fb"), _FG))
    _add(f"extend_both{_tag}", lambda s, d, e=_ext: temporal_map(s, d, "status").extend_into_gaps("both", e).facts, _plus(_pieces(_LEFT, _ext, "f") + " UNION ALL " + _pieces(_RIGHT, _ext, "b"), _FG))
    _add(f"extend_forwards{_tag}", lambda s, d, e=_ext: temporal_map(s, d, "status").extend_into_gaps("forwards", e).facts, _plus(_pieces(_LEFT, _ext, "f"), _FG))
    _add(f"extend_backwards{_tag}", lambda s, d, e=_ext: temporal_map(s, d, "status").extend_into_gaps("backwards", e).facts, _plus(_pieces(_RIGHT, _ext, "b"), _FG))
for _start in (None, D0):
    for _ext in (None, 30):
        _tag = ("" if _start is None else "_from") + ("" if _ext is None else f"_{_ext}")
        _lo = DATE.minimum if _ext is None else f"CASE WHEN lo < {DATE.minimum + _ext} THEN {DATE.minimum} ELSE lo - {_ext} END"
        _hi = DATE.maximum if _ext is None else f"CASE WHEN hi > {DATE.maximum - _ext} THEN {DATE.maximum} ELSE hi + {_ext} END"
        _s, _e = (DATE.maximum, DATE.minimum) if _start is None else (_start, _start)
        _add(f"fill_to_start{_tag}", lambda s, d, a=_start, e=_ext: temporal_map(s, d, "status").fill_to_start(a, e).facts, _plus(f"SELECT key, value, {_lo}, lo FROM f WHERE lo < {_s} AND (key, lo) IN (SELECT key, min(lo) FROM f GROUP BY key)", _map("status")))
        _add(f"fill_to_end{_tag}", lambda s, d, a=_start, e=_ext: temporal_map(s, d, "status").fill_to_end(a, e).facts, _plus(f"SELECT key, value, hi, {_hi} FROM f WHERE hi > {_e} AND (key, hi) IN (SELECT key, max(hi) FROM f GROUP BY key)", _map("status")))
# the backstop has every customer again under a key that the map lacks
_add(
    "fill_gaps_with",
    lambda s, d: (lambda g: temporal_map(s, d, "status").fill_gaps_with(g + g.transform_keys(lambda k: -1 - k)).facts)(temporal_map(s, d, "status", 200)),
    _plus(
        "SELECT g.key, g.value, greatest(g.lo, glo), least(g.hi, ghi) FROM g JOIN h ON g.key = h.key AND g.lo < ghi AND glo < g.hi UNION ALL SELECT g.key, g.value, g.lo, g.hi FROM g WHERE g.key NOT IN (SELECT key FROM f)",
        f"{_map('status')}, {_map('status', 'b', 200)}, g AS ({FACTS} b UNION ALL SELECT -1 - key, value, lo, hi FROM b), {_gap('h', 'f')}",
    ),
)

# joins
_JOIN = "SELECT a.key, b.value, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM {a} a JOIN {b} b ON a.value = b.key AND a.lo < b.hi AND b.lo < a.hi"
_add("joined_to", lambda s, d: temporal_map(s, d, "orders").joined_to(temporal_map(s, d, "suppliers")).facts, f"WITH {_map('orders')}, {_map('suppliers', 'g')}, j AS ({_JOIN.format(a='f', b='g')}), {_co('o', 'j')} {FACTS} o")
_add("self_joined", lambda s, d: temporal_map(s, d, "suppliers").self_joined().facts, f"WITH {_map('suppliers')}, g AS (SELECT value AS key, key AS value, lo, hi FROM f), j AS ({_JOIN.format(a='f', b='g')}), {_co('o', 'j')} {FACTS} o")


def _on(piece: str, facts: str, holes: str) -> str:
    """A gap piece over other tables than f and h."""
    return piece.replace("FROM h ", f"FROM {holes} h ").replace("JOIN f ", f"JOIN {facts} ")


_FILLED = f"""{_map('suppliers', 'g0')}, {_gap('h1', 'g0')}, d1 AS ({FACTS} g0 UNION ALL {_pieces(_on(_BOTH, 'g0', 'h1'), None, 'fb')}), {_co('g1', 'd1')}, {_gap('h2', 'g1')},
  d2 AS ({FACTS} g1 UNION ALL {_pieces(_on(_LEFT, 'g1', 'h2'), 30, 'f')} UNION ALL {_pieces(_on(_RIGHT, 'g1', 'h2'), 30, 'b')}), {_co('g', 'd2')}"""
_add("filled_join", lambda s, d: temporal_map(s, d, "orders").joined_to(temporal_map(s, d, "suppliers").fill_gaps().extend_into_gaps("both", 30)).facts, f"WITH {_map('orders')}, {_FILLED}, j AS ({_JOIN.format(a='f', b='g')}), {_co('o', 'j')} {FACTS} o")

_add(
    "joined_open_ended", lambda s, d: temporal_map(s, d, "orders").fill_to_end().joined_to(temporal_map(s, d, "suppliers").fill_to_start(D1)).facts,
    f"""WITH {_map('orders', 'f0')}, d1 AS ({FACTS} f0 UNION ALL SELECT key, value, hi, {DATE.maximum} FROM f0 WHERE (key, hi) IN (SELECT key, max(hi) FROM f0 GROUP BY key)), {_co('f', 'd1')},
      {_map('suppliers', 'g0')}, d2 AS ({FACTS} g0 UNION ALL SELECT key, value, {DATE.minimum}, lo FROM g0 WHERE lo < {D1} AND (key, lo) IN (SELECT key, min(lo) FROM g0 GROUP BY key)), {_co('g', 'd2')},
      j AS ({_JOIN.format(a='f', b='g')}), {_co('o', 'j')} {FACTS} o""",
)

# a key and a middle value with a third of all rows; nulls in every column
_HOT = f"{_raw('parts', 'raw_hot')}, hot AS (SELECT CASE WHEN key % 3 = 0 THEN 0 ELSE key END AS key, value, lo, hi FROM raw_hot), {_co('f', 'hot')}"


def _hot(s: SparkSession, d: str) -> TemporalMap:
    return TemporalMap(hot_facts(s, d), DATE, bin_ticks=128)


_add("coalesce_hot", lambda s, d: _facts(_hot(s, d)), f"WITH {_HOT} {FACTS} f")
_add("segments_hot", lambda s, d: _listed(_hot(s, d).disjoint_intervals(), "values"), f"WITH {_HOT}, {_seg('g', 'f')} SELECT key, lo, hi, \"values\" FROM g")
_add("gaps_hot", lambda s, d: _hot(s, d).gaps(), f"WITH {_HOT}, {_gap('h', 'f')} SELECT key, glo, ghi FROM h")
_add(
    "joined_hot", lambda s, d: temporal_map(s, d, "status").transform_values(lambda v: F.when(v == "F", 0).otherwise(F.ascii(v)).cast("bigint")).joined_to(_hot(s, d).subset_values([1, 2, 3])).facts,
    f"WITH {_map('status', 'f0')}, f1 AS (SELECT key, CASE WHEN value = 'F' THEN 0 ELSE ascii(value) END AS value, lo, hi FROM f0), {_co('g', 'f1')}, {_HOT}, h AS ({FACTS} f WHERE value IN (1, 2, 3)), j AS ({_JOIN.format(a='g', b='h')}), {_co('o', 'j')} {FACTS} o",
)
_NULLS = f"""{_raw('parts', 'raw_n')}, holes AS (SELECT CASE WHEN key % 5 <> 0 THEN key END AS key, CASE WHEN value % 7 <> 0 THEN value END AS value, CASE WHEN lo % 11 <> 0 THEN lo END AS lo, CASE WHEN hi % 13 <> 0 THEN hi END AS hi FROM raw_n),
  n AS (SELECT key, value, lo, CASE WHEN lo % 17 = 0 THEN lo - 1 ELSE hi END AS hi FROM holes WHERE key IS NOT NULL AND value IS NOT NULL AND lo IS NOT NULL), known AS ({FACTS} n WHERE hi IS NOT NULL)"""
_add("nulls_left_out", lambda s, d: TemporalMap(facts_with_nulls(s, d), DATE).facts, f"WITH {_NULLS}, {_co('f', 'known')} {FACTS} f")
_add("nulls_inserted", lambda s, d: temporal_map(s, d, "parts", 400).insert(facts_with_nulls(s, d)).facts, f"WITH {_NULLS}, {_map('parts', 'g', 400)}, d AS ({FACTS} g UNION ALL {FACTS} known), {_co('o', 'd')} {FACTS} o")
_add("nulls_segments", lambda s, d: _listed(TemporalMap(facts_with_nulls(s, d), DATE).disjoint_intervals(), "values"), f"WITH {_NULLS}, {_co('f', 'known')}, {_seg('g', 'f')} SELECT key, lo, hi, \"values\" FROM g")

# shapes of facts: successive overlaps, nested pyramids, values that take turns
for _shape, (_v, _from, _to) in SHAPES.items():
    _SHAPE = f"""o AS (SELECT CAST(floor(o_orderkey / 50) AS BIGINT) AS key, CAST(o_orderkey AS BIGINT) AS o FROM orders),
      nm AS (SELECT key, o, row_number() OVER (PARTITION BY key ORDER BY o) AS n, count(*) OVER (PARTITION BY key) + 1 AS m FROM o), shape AS (SELECT key, CAST({_v} AS BIGINT) AS value, CAST({_from} AS BIGINT) AS lo, CAST({_to} AS BIGINT) AS hi FROM nm), {_co('f', 'shape')}"""
    _add(f"shape_{_shape}", lambda s, d, n=_shape: _listed(TemporalMap(shaped_facts(s, d, n), BIGINT).disjoint_intervals(), "values"), f"WITH {_SHAPE}, {_seg('g', 'f')} SELECT key, lo, hi, \"values\" FROM g")

# what answers with a Python value, as one row


def _answers(s: SparkSession, d: str) -> DataFrame:
    m, shifted = temporal_map(s, d, "parts"), temporal_map(s, d, "parts", 30)
    row = (m.contains(7), m.count(-1), m.contains_value(3), m.count_value(-1), m.is_empty(), TemporalMap.empty(s).is_empty(), m.size(), m.inverse_size(), m.equals(temporal_map(s, d, "parts")), m.equals(shifted), m.clear().is_empty())
    return s.createDataFrame([row], "has_key boolean, keys_found int, has_value boolean, values_found int, none boolean, empty_is_empty boolean, n_keys bigint, n_values bigint, same boolean, shifted_same boolean, cleared boolean")


_add("answers", _answers, f"""WITH {_map('parts')}, {_map('parts', 'g', 30)} SELECT count(*) FILTER (key = 7) > 0 AS has_key, CAST(count(*) FILTER (key = -1) > 0 AS INTEGER) AS keys_found, count(*) FILTER (value = 3) > 0 AS has_value, CAST(count(*) FILTER (value = -1) > 0 AS INTEGER) AS values_found,
  count(*) = 0 AS none, TRUE AS empty_is_empty, count(DISTINCT key) AS n_keys, count(DISTINCT value) AS n_values, TRUE AS same, (SELECT count(*) FROM (({FACTS} f EXCEPT {FACTS} g) UNION ALL ({FACTS} g EXCEPT {FACTS} f)) x) = 0 AS shifted_same, TRUE AS cleared FROM f""")


def _round_trip(s: SparkSession, d: str) -> DataFrame:
    path = fresh_path(s, "facts")
    write_facts(temporal_map(s, d, "status"), path)
    return read_facts(s, path, DATE).facts


_add("parquet_round_trip", _round_trip, f"WITH {_map('status')} {FACTS} f")
_add("iterate", lambda s, d: s.createDataFrame(list(temporal_map(s, d, "status").iterate([3, 7, 10], D0, D2)), "key bigint, value string, lo date, hi date"), f"WITH {_map('status')} SELECT key, value, CAST(DATE '1970-01-01' + CAST(lo AS INTEGER) AS DATE) AS lo, CAST(DATE '1970-01-01' + CAST(hi AS INTEGER) AS DATE) AS hi FROM ({_clip('f', D0, D2, 'key IN (3, 7, 10)')}) x")
_add("fact_lines", lambda s, d: temporal_map(s, d, "status").fact_lines(), f"WITH {_map('status')} SELECT key, value || ', [' || strftime(DATE '1970-01-01' + CAST(lo AS INTEGER), '%Y-%m-%d') || ',' || strftime(DATE '1970-01-01' + CAST(hi AS INTEGER), '%Y-%m-%d') || ')' AS line FROM f")
_add(
    "lines_closed",
    lambda s, d: TemporalMap(raw_facts(s, d, "status"), DATE.with_bounds("closed")).lines(),
    f"""WITH {_map('status')}, {_seg('g', 'f')}
  SELECT CAST(key AS VARCHAR) || chr(9) || '[' || replace("values", ',', ', ') || ']' || chr(9) || '[' || strftime(DATE '1970-01-01' + CAST(lo AS INTEGER), '%Y-%m-%d') || ',' || strftime(DATE '1970-01-01' + CAST(hi - 1 AS INTEGER), '%Y-%m-%d') || ']' AS line FROM g""",
)


def _nation(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").where("c_nationkey = 3").select(F.lit("X").alias("key"), F.col("c_custkey").cast("bigint").alias("value"))


_add("inverse_insert_pairs_frame", lambda s, d: temporal_map(s, d, "status").inverse_insert_pairs(_nation(s, d), D0, D1).facts, _plus(f"SELECT CAST(c_custkey AS BIGINT), 'X', {D0}, {D1} FROM customer WHERE c_nationkey = 3", _map("status")))
_add("inverse_erase_pairs_frame", lambda s, d: temporal_map(s, d, "status").inverse_erase_pairs(_nation(s, d).withColumn("key", F.lit("O")), D0, D1).facts, _erased("value = 'O' AND key IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)", D0, D1))

# scalar functions, over each fact and the next one of its key


def _scalars(s: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("key").orderBy("lo", "hi", "value")
    rows = temporal_map(s, d, "status").facts.withColumn("lo2", F.lead("lo").over(order)).withColumn("hi2", F.lead("hi").over(order)).where("lo2 is not null")
    a, b, c, e = (F.col(x) for x in ("lo", "hi", "lo2", "hi2"))
    both, outer, gap, left, right = scalar.intersection(a, b, c, e), scalar.hull(a, b, c, e), scalar.between(b, c), scalar.left_remainder(a, b, c), scalar.right_remainder(a, b, e)
    return rows.select(
        "key", "lo", "hi", scalar.exclusive_less(b, c).alias("exclusive_less"), scalar.more_or_touches(b, c).alias("more_or_touches"), scalar.intersects(a, b, c, e).alias("intersects"),
        scalar.touches(a, b, c, e).alias("touches"), scalar.contains(a, b, c, e).alias("contains"), scalar.length(a, b).alias("length"), scalar.lower_edge(a).alias("lower_edge"), scalar.upper_edge(b).alias("upper_edge"),
        both[0].alias("both_lo"), both[1].alias("both_hi"), scalar.is_empty(*both).alias("both_empty"), outer[0].alias("hull_lo"), outer[1].alias("hull_hi"), gap[0].alias("gap_lo"), gap[1].alias("gap_hi"),
        left[1].alias("left_hi"), right[0].alias("right_lo"),
    )


_add("interval_functions", _scalars, f"""WITH {_map('status')}, p AS (SELECT key, lo, hi, lead(lo) OVER w AS lo2, lead(hi) OVER w AS hi2 FROM f WINDOW w AS (PARTITION BY key ORDER BY lo, hi, value))
  SELECT key, lo, hi, hi <= lo2 AS exclusive_less, hi >= lo2 AS more_or_touches, lo < hi2 AND lo2 < hi AS intersects, hi = lo2 OR hi2 = lo AS touches, lo <= lo2 AND hi >= hi2 AS contains, hi - lo AS length, lo AS lower_edge, hi - 1 AS upper_edge,
  greatest(lo, lo2) AS both_lo, least(hi, hi2) AS both_hi, greatest(lo, lo2) >= least(hi, hi2) AS both_empty, least(lo, lo2) AS hull_lo, greatest(hi, hi2) AS hull_hi, hi AS gap_lo, lo2 AS gap_hi, least(hi, lo2) AS left_hi, greatest(lo, hi2) AS right_lo FROM p WHERE lo2 IS NOT NULL""")
_add("value_sets", lambda s, d: _listed(temporal_map(s, d, "parts").facts.groupBy("key").agg(scalar.to_set(F.col("value")).alias("values"), F.sort_array(scalar.to_vector(F.col("value"))).alias("vector"), scalar.quantile(scalar.length(F.col("lo"), F.col("hi")), 1.0).alias("longest")), "values", "vector"), f"""WITH {_map('parts')}
  SELECT key, (SELECT string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) FROM (SELECT DISTINCT value AS v FROM f g WHERE g.key = f.key) x) AS "values", string_agg(CAST(value AS VARCHAR), ',' ORDER BY value) AS vector, max(hi - lo) AS longest FROM f GROUP BY key""")

# flattening


def _flat(name: str, fallback: str, keeps: bool = True) -> str:
    keep = "WHEN sq IS NOT NULL AND list_contains(string_split(\"values\", ','), sq) THEN sq" if keeps else ""
    return f"""WITH {_map(name)}, {_seg('g', 'f')}, q AS (SELECT *, CASE WHEN lag(n) OVER w = 1 AND lag(hi) OVER w = lo THEN lag(v1) OVER w END AS sq FROM g WINDOW w AS (PARTITION BY key ORDER BY lo)),
      c AS (SELECT key, CASE WHEN n = 1 THEN v1 {keep} ELSE {fallback} END AS value, lo, hi FROM q), k AS (SELECT * FROM c WHERE value IS NOT NULL), {_co('o', 'k')} {FACTS} o"""


def _largest(status_quo: Column, lo: Column, hi: Column, key: Column, values: Column) -> Column:
    return F.array_max(values)


for _name in ("status", "events"):
    _add(f"flatten_{_name}", lambda s, d, n=_name: temporal_map(s, d, n).flattened().facts, _flat(_name, "NULL"))
_add("flatten_discard", lambda s, d: temporal_map(s, d, "status").flattened(flatten.discard).facts, _flat("status", "NULL", False))
_add("flatten_largest", lambda s, d: temporal_map(s, d, "status").flattened(_largest).facts, _flat("status", "v2", False))
_add("flatten_status_quo_largest", lambda s, d: temporal_map(s, d, "events").flattened(flatten.prefer_status_quo(_largest)).facts, _flat("events", "v2"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained temporal join of customers to suppliers through orders."""
    return QUERIES["joined_to"](spark, sf_dir)
