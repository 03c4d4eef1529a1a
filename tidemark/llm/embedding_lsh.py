"""Embedding near-dedup by cross-polytope hashing.

A hash function turns the unit vector by three rounds of random signs and a fast
Hadamard transform and takes the coordinate of largest magnitude with its sign
(Andoni et al., Practical and Optimal LSH for Angular Distance, 2015).  FUNCTIONS
of them make a bucket (one more for tables of over MANY rows), and there are TABLES
tables, more above 128 components and with more functions.  Each vector also probes the
buckets that replace its values by their runners-up, those of least loss first.
Pairs that meet in a bucket, one of them by its own bucket, are verified by the
cosine in double precision.

Equal vectors of a label are one node with a weight.  Large buckets are cut into
chunks of CHUNK vectors and compared chunk against chunk; a pair that meets more
than once counts only at its first meeting, which both ends can tell from their
hashes.  So link counts are summed and links span components without any pair
being emitted.

A vector that is null, zero, of another length, or has null or non-finite
components, and one with a null label, links with nothing; rows of a null
vec_id are linked, but do not name a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, cut
from tidemark.llm.linking import roots_of
from tidemark.llm.words import mix

FUNCTIONS, TABLES, PROBES = 3, 12, 6
CHUNK = 1024
MANY = 10**8
DENSE = 256
SEED = 31


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis (a power of two)."""
    n = x.shape[-1]
    step = 1
    while step < n:
        y = x.reshape(*x.shape[:-1], n // (2 * step), 2, step)
        x = np.concatenate([y[..., 0:1, :] + y[..., 1:2, :], y[..., 0:1, :] - y[..., 1:2, :]], axis=-2).reshape(x.shape)
        step *= 2
    return x


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of x after rounds of random signs and a fast Hadamard transform."""
    for s in signs:
        x = hadamard(x * s) / np.sqrt(x.shape[-1])
    return x


def functions_of(rows: int) -> int:
    """Functions a bucket for a table of so many rows: FUNCTIONS, and more beyond MANY rows, so
    that unrelated vectors in a bucket do not grow with the table."""
    return FUNCTIONS + (rows > MANY)


def tables_of(size: int, functions: int = FUNCTIONS) -> int:
    """Tables for vectors of ``size`` (a power of two): buckets are finer the more components
    there are, and with one function more each pair meets in fewer of them."""
    tables = TABLES + 4 * max(0, size.bit_length() - 8)
    return tables if functions == FUNCTIONS else 2 * tables


def hashes(unit: np.ndarray, functions: int = FUNCTIONS) -> np.ndarray:
    """(vectors, tables, 1 + PROBES) bucket numbers of 31 bits: the own bucket, then the probes."""
    n, dim = unit.shape
    size = 1 << max(1, (dim - 1).bit_length())
    tables = tables_of(size, functions)
    rng = np.random.default_rng([SEED, size] if functions == FUNCTIONS else [SEED, size, functions])
    signs = rng.integers(0, 2, (tables, functions, 3, size)) * 2.0 - 1.0
    dense = size <= DENSE and n > size  # the unit vectors rotated once make the matrix for all rows
    padded = np.zeros((n, size))
    padded[:, :dim] = unit
    out = np.empty((n, tables, 1 + PROBES), dtype=np.int32)
    # which runner-up each probe takes in each function: 0 best, 1 second, 2 third
    choices = np.array(np.meshgrid(*[[0, 1, 2]] * functions, indexing="ij")).reshape(functions, -1).T
    choices = choices[choices.sum(axis=1).argsort(kind="stable")]
    for t in range(tables):
        codes = np.empty((n, functions, 3), dtype=np.int64)
        loss = np.empty((n, functions, 3))
        for f in range(functions):
            if dense:
                x = padded @ rotated(np.eye(size), signs[t, f])
            else:
                x = rotated(padded, signs[t, f])
            size_of = np.abs(x)
            top = np.argpartition(-size_of, min(2, size - 1), axis=1)[:, : min(3, size)]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size_of, top, axis=1), axis=1, kind="stable"), axis=1)
            if top.shape[1] < 3:
                top = np.concatenate([top, top[:, -1:]], axis=1)
            value = np.take_along_axis(x, top, axis=1)
            codes[:, f] = 2 * top + (value < 0)
            loss[:, f] = (np.abs(value[:, :1]) - np.abs(value)) ** 2
        base = np.array([(2 * size) ** f for f in range(functions)])
        cost = sum(loss[:, f][:, choices[:, f]] for f in range(functions))
        bucket = sum(codes[:, f][:, choices[:, f]] * base[f] for f in range(functions))
        if (2 * size) ** functions > 1 << 31:  # distinct buckets of a table rarely share a number
            bucket = (mix(bucket.astype(np.uint64)) >> np.uint64(33)).astype(np.int64)
        order = np.argsort(cost, axis=1, kind="stable")[:, : 1 + PROBES]
        out[:, t] = np.take_along_axis(bucket, order, axis=1)
        out[:, t, 0] = bucket[:, 0]
    return out


def unit_of(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max()  # no overflow or underflow in the norm
    return x / np.sqrt(x @ x)


def _describe(functions: int, kind: str):
    """Rows with the vectors as they are (``kind`` is their numpy type) and their buckets."""
    names = ["vec_id", "label", "valid", "dim", "c1", "c2", "vector", "buckets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                vectors = part.column("embedding").to_pylist()
                labels = part.column("label").to_pylist()
                n = len(vectors)
                valid = np.zeros(n, dtype=bool)
                dims, c1, c2 = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
                kept: list[bytes | None] = [None] * n
                buckets: list[list[int] | None] = [None] * n
                by_dim: dict[int, list[tuple[int, np.ndarray]]] = {}
                for i, v in enumerate(vectors):
                    if v and labels[i] is not None and not any(x is None for x in v):
                        x = np.array(v, dtype=np.float64)
                        if np.isfinite(x).all() and x.any():
                            kept[i] = np.array(v, dtype=kind).tobytes()
                            by_dim.setdefault(len(v), []).append((i, unit_of(x)))
                for dim, found in by_dim.items():
                    at = [i for i, _ in found]
                    unit = np.array([x for _, x in found])
                    bits = np.ascontiguousarray(unit + 0.0).view(np.uint64)
                    weight = mix(np.arange(1, dim + 1, dtype=np.uint64))
                    valid[at], dims[at] = True, dim
                    c1[at] = mix((mix(bits) * weight).sum(axis=1, dtype=np.uint64)).view(np.int64)
                    c2[at] = mix((mix(bits ^ np.uint64(0x5DEECE66D)) * (weight | np.uint64(1))).sum(axis=1, dtype=np.uint64)).view(np.int64)
                    for i, h in zip(at, hashes(unit, functions).reshape(len(at), -1), strict=True):
                        buckets[i] = h.tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"), pa.array(valid), pa.array(dims), pa.array(c1), pa.array(c2), pa.array(kept, pa.binary()), pa.array(buckets, pa.list_(pa.int32()))],
                    names=names,
                )

    return run


def _verify(threshold: float, kind: str):
    """Rows sorted by task (bucket and pair of chunks): link counts of nodes and spanning links."""

    def task(table: int, value: int, first: int, second: int, node, weight, own, chunk, x, h, out: list) -> None:
        left, right = np.flatnonzero(chunk == first), np.flatnonzero(chunk == second)
        count = np.zeros(len(node), dtype=np.int64)
        links_a, links_b = [], []
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            near = x[some] @ x[right].T >= threshold
            near &= own[some][:, None] | own[right][None, :]
            if first == second:
                near &= some[:, None] < right[None, :]
            i, j = np.nonzero(near)
            a, b = some[i], right[j]
            for lo in range(0, len(a), 20_000):
                p, q = a[lo : lo + 20_000], b[lo : lo + 20_000]
                hp, hq = h[p], h[q]
                in_p = (hp[:, :, :1] == hq).any(axis=2)  # q comes to p's own bucket
                in_q = (hq[:, :, :1] == hp).any(axis=2)
                here = (in_p | in_q).argmax(axis=1) == table
                big = np.iinfo(np.int32).max
                chosen = np.minimum(np.where(in_p[:, table], hp[:, table, 0], big), np.where(in_q[:, table], hq[:, table, 0], big))
                mine = here & (chosen == value)
                p, q = p[mine], q[mine]
                count += np.bincount(p, weight[q], len(node)).astype(np.int64) + np.bincount(q, weight[p], len(node)).astype(np.int64)
                links_a.append(p)
                links_b.append(q)
        if links_a and count.any():
            root = roots_of(len(node), np.concatenate(links_a), np.concatenate(links_b))
            counted, moved = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(node)))
            out.append((np.zeros(len(counted), dtype=bool), node[counted], count[counted]))
            out.append((np.ones(len(moved), dtype=bool), node[moved], node[root[moved]]))

    def tasks(held: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
        """Runs the tasks that are complete; returns the rows of the one that may go on."""
        columns = {c: held.column(c).to_numpy() for c in ("task", "tab", "value", "first", "second", "node", "weight", "own", "chunk")}
        edges = np.flatnonzero(np.diff(columns["task"])) + 1
        bounds = np.concatenate([[0], edges, [held.num_rows] if last else []]).astype(np.int64)
        out: list = []
        vectors, buckets = held.column("vector"), held.column("buckets").combine_chunks()
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo < 2:
                continue
            c = {k: v[lo:hi] for k, v in columns.items()}
            x = np.array([unit_of(np.frombuffer(v, dtype=kind).astype(np.float64)) for v in vectors.slice(lo, hi - lo).to_pylist()])
            h = buckets.slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, -1, 1 + PROBES)
            order = np.lexsort((~c["own"], c["node"]))
            ranked = c["node"][order]
            keep = order[np.concatenate([[True], ranked[1:] != ranked[:-1]])]
            task(int(c["tab"][0]), int(c["value"][0]), int(c["first"][0]), int(c["second"][0]), *(c[k][keep] for k in ("node", "weight", "own", "chunk")), x[keep], h[keep], out)
        kinds = (bool, np.int64, np.int64)
        arrays = [pa.array(np.concatenate([o[i] for o in out] or [np.zeros(0, dtype=k)])) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=["edge", "a", "b"]), held.slice(bounds[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for start in range(0, batch.num_rows, 4 * CHUNK):
                part = pa.Table.from_batches([batch.slice(start, 4 * CHUNK)])
                held = part if held is None else pa.concat_tables([held, part])
                found, held = tasks(held, False)
                yield found
        if held is not None and held.num_rows:
            yield tasks(held, True)[0]

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per input row."""
    rows = vectors.select("vec_id", "embedding", "label")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, valid boolean, dim bigint, c1 bigint, c2 bigint, vector binary, buckets array<int>"
    kind = "<f4" if kinds["embedding"] == "array<float>" else "<f8"
    described = cut(rows.mapInArrow(_describe(functions_of(rows.count()), kind), schema), "vectors")
    same = ["label", "dim", "c1", "c2"]
    nodes = (
        described.where("valid").groupBy(*same)
        .agg(F.count("*").alias("weight"), F.min("vec_id").alias("least_id"), F.first("vector").alias("vector"), F.first("buckets").alias("buckets"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = cut(nodes, "vector-nodes")

    places = nodes.select("node", "label", "dim", F.posexplode("buckets").alias("at", "value"))
    places = places.withColumn("tab", F.floor(F.col("at") / (1 + PROBES)).cast("int")).withColumn("own", F.col("at") % (1 + PROBES) == 0)
    bucket = ["label", "dim", "tab", "value"]
    places = places.drop("at")
    busy = places.groupBy(*bucket).agg(F.count("*").alias("m"), F.count_if("own").alias("owned")).where("owned > 0 and m > 1")
    members = places.join(busy, bucket).withColumn("chunks", F.ceil(F.col("m") / CHUNK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("chunk")).alias("first"), F.greatest(c, F.col("chunk")).alias("second")))
    tasks = members.withColumn("task", F.explode(others)).select("node", *bucket, "own", "chunk", F.col("task.first").alias("first"), F.col("task.second").alias("second"))
    tasks = tasks.withColumn("task", F.xxhash64(*bucket, "first", "second"))
    loaded = tasks.join(nodes.select("node", "weight", "vector", "buckets"), "node").select("task", "tab", "value", "first", "second", "node", "weight", "own", "chunk", "vector", "buckets", "label", "dim")
    loaded = loaded.repartition("task").sortWithinPartitions("task", "label", "dim").drop("label", "dim")
    found = cut(loaded.mapInArrow(_verify(threshold, kind), "edge boolean, a bigint, b bigint"), "vector-links")

    counts = found.where("not edge").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    linked = components(found.where("edge").select("a", "b"))
    final = nodes.join(counts, "node", "left").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = final.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of = final.join(least, "component").select(*same, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id", F.lit(True).alias("valid"))
    return (
        described.select("vec_id", "valid", *same).join(of, [*same, "valid"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
