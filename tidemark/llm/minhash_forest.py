"""MinHash near-dedup with an LSH forest.

A document's set are its distinct 5-word shingles (A-Z lower-cased; the whole
sequence if it has fewer words; empty without words).  Documents are linked at
100 * intersection >= 75 * union.  Steps:

1. One pass gives each row its set's size and 128-bit fingerprint, 128 MinHash
   values and the heads of 32 sorted signature orders ("trees").  Rows of equal
   sets become one node before anything is compared.
2. Each tree sorts the nodes by its order of the signature.  Nodes whose orders agree
   to depth 4 are a region; from there the depth follows the data.  The longest common
   prefixes of neighbours split a region into ever deeper intervals, which are joined
   from the longest prefix to the shortest: where two intervals meet, the neighbours are
   compared on their whole signatures (62 of 128 values must agree), and only if this does
   not make one family of both, members of different families are too.  So a region of
   copies takes one comparison a node, and no pair of a region stays undecided.  Regions
   of more than REGION nodes are dealt to tasks by the next values of their order; what
   that parts is compared block by block.  A link at similarity 0.75 is missed by all 32
   trees with probability (1 - 0.75^4)^32 < 6e-6, by the agreement test < 1e-9.
3. The candidate families so found are confirmed on the full sets through an inverted
   index.  Families beyond FAMILY nodes are dealt to blocks that first link against
   common pivots, then block pairs of different components are compared exactly.

Nulls: a null text has an empty set and no links; rows with a null doc_id take
part in linking, and a component without any doc_id gets a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bitmap, components, cut, free_name, small, tidy
from tidemark.llm.linking import exact_links
from tidemark.llm.words import mix, sequence_hash, shingle_hashes, word_hashes

TREES, DEPTH, BITS = 32, 4, 128
REGION = 1024
FAMILY = 500
FAMILY_VALUES = 1_000_000
BLOCK = 500
PIVOTS = 16
AGREE = 62
ORDER_BYTES = 16
#: Bound of the prefilter before the sets are read again: 128 MB, 64 to 128 bits a node up to there.
FILTER_BITS = 1 << 30

_rng = np.random.Generator(np.random.PCG64(977))
_A = (_rng.integers(0, 1 << 31, BITS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, BITS, dtype=np.uint32)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words, _, _ = word_hashes(np.frombuffer((text or "").encode(), dtype=np.uint8), fold=True)
    if not len(words):
        return words
    if len(words) < k:
        return np.array([sequence_hash(words) ^ len(words)], dtype=np.uint64)
    return np.unique(shingle_hashes(words, k))


def _fingerprint(values: np.ndarray) -> tuple[int, int]:
    a = int(mix(values + np.uint64(0x1234567)).sum(dtype=np.uint64))
    b = int(mix(values ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))
    return a - (1 << 64) * (a >> 63), b - (1 << 64) * (b >> 63)


def _signature(values: np.ndarray) -> np.ndarray:
    low = np.full(BITS, 0xFFFFFFFF, dtype=np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 2048):
        np.minimum(low, (short[i : i + 2048, None] * _A + _B).min(axis=0), out=low)
    return low


def _describe(k: int):

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                n, c1, c2 = [], [], []
                sigs = np.zeros((part.num_rows, BITS), dtype=np.uint32)
                for i, text in enumerate(part.column("text").to_pylist()):
                    values = shingle_set(text, k)
                    a, b = _fingerprint(values)
                    n.append(len(values))
                    c1.append(a)
                    c2.append(b)
                    if len(values):
                        sigs[i] = _signature(values)
                head = np.zeros((part.num_rows, TREES), dtype=np.uint64)
                by_tree = sigs.reshape(part.num_rows, TREES, DEPTH).astype(np.uint64)
                for j in range(DEPTH):
                    head = mix(head * np.uint64(31) + by_tree[:, :, j] + np.uint64(j + 1))
                head = mix(head + np.arange(TREES, dtype=np.uint64))
                short = (sigs ^ (sigs >> np.uint32(8))).astype(np.uint8)
                keep = [name for name in part.schema.names if name != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(name) for name in keep], pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()),
                     pa.FixedSizeListArray.from_arrays(pa.array(head.view(np.int64).ravel()), TREES).cast(pa.list_(pa.int64())),
                     pa.array([s.tobytes() for s in short], pa.binary())],
                    names=[*keep, "n", "c1", "c2", "heads", "sig"],
                )
        tidy()

    return run


def common_prefixes(orders: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of each row with the next."""
    differ = orders[1:] != orders[:-1]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), orders.shape[1])


def interval_links(orders: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of the families of one sorted region, built from its deepest intervals up."""
    m = len(sigs)
    family = list(range(m))  # a family is named by its first member
    members = [[i] for i in range(m)]
    # of the interval that begins or ends at a position: its other end, and the families in it
    low, high = list(range(m)), list(range(m))
    inside: list[list[int]] = [[i] for i in range(m)]

    def agree(i: int, others: np.ndarray) -> np.ndarray:
        return (sigs[others] == sigs[i]).sum(axis=1) >= AGREE

    def join(a: int, b: int) -> int:
        a, b = (a, b) if len(members[a]) >= len(members[b]) else (b, a)
        for i in members[b]:
            family[i] = a
        members[a] += members[b]
        members[b] = []
        return a

    for at in np.argsort(-common_prefixes(orders), kind="stable").tolist():
        lo, hi = low[at], high[at + 1]
        left, right = inside[lo], inside[at + 1]
        if (sigs[at] == sigs[at + 1]).sum() >= AGREE:  # the neighbours of the longest prefix first
            join(family[at], family[at + 1])
            left, right = list({family[f] for f in left}), list({family[f] for f in right})
        if len(left) == len(right) == 1 and left == right:
            both = left
        else:
            few, many = (left, right) if len(left) <= len(right) else (right, left)
            for f in list(few):
                own = family[f]
                rest = [g for g in {family[g] for g in many} if g != own]
                if not rest:
                    continue
                others = np.array([i for g in rest for i in members[g] if lo <= i <= hi])
                for i in list(members[own]):
                    if lo <= i <= hi and len(others):
                        near = {family[x] for x in others[agree(i, others)].tolist()} - {family[i]}
                        if near:
                            for g in near:
                                join(family[i], g)
                            others = others[[family[x] != family[i] for x in others.tolist()]]
            both = list({family[f] for f in left} | {family[f] for f in right})
        low[hi], high[lo], inside[lo] = lo, hi, both
    root = np.array([min(members[f]) for f in family], dtype=np.int64) if m else np.zeros(0, dtype=np.int64)
    moved = np.flatnonzero(root != np.arange(m))
    return moved, root[moved]


def _region_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (region, node, sig, order), sorted by region and order: links that span candidate families."""
    none = np.zeros(0, dtype=np.int64)
    keys, nodes, sigs, orders = none, none, np.zeros((0, BITS), dtype=np.uint8), np.zeros((0, ORDER_BYTES), dtype=np.uint8)

    def links(stop: int) -> pa.RecordBatch:
        a, b = [none], [none]
        edge = np.flatnonzero(np.diff(keys[:stop])) + 1
        bounds = np.concatenate([[0], edge, [stop]]).astype(np.int64)
        sizes = np.diff(bounds)
        two = bounds[:-1][sizes == 2]  # a region of two is one comparison
        two = two[(sigs[two] == sigs[two + 1]).sum(axis=1) >= AGREE]
        a.append(nodes[two + 1])
        b.append(nodes[two])
        for lo, hi in zip(bounds[:-1][sizes > 2].tolist(), bounds[1:][sizes > 2].tolist(), strict=True):
            for at in range(lo, hi, REGION):
                first = max(lo, at - 16)  # the last neighbours of the part before
                last = min(hi, at + REGION)
                moved, root = interval_links(orders[first:last], sigs[first:last])
                a.append(nodes[first + moved])
                b.append(nodes[first + root])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def matrix(column: pa.Array, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate([keys, batch.column("region").to_numpy(zero_copy_only=False)])
        nodes = np.concatenate([nodes, batch.column("node").to_numpy(zero_copy_only=False)])
        sigs = np.concatenate([sigs, matrix(batch.column("sig"), BITS)])
        orders = np.concatenate([orders, matrix(batch.column("order"), ORDER_BYTES)])
        edges = np.flatnonzero(np.diff(keys))
        done = int(edges[-1]) + 1 if len(edges) else 0
        if not done and len(keys) > 16 * REGION:
            done = len(keys) - REGION  # inside one region: hand on its parts, keep the neighbours
            yield links(done)
            done -= 16
        elif done:
            yield links(done)
        keys, nodes, sigs, orders = keys[done:], nodes[done:], sigs[done:], orders[done:]
    if len(keys):
        yield links(len(keys))


def _compare_stragglers(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between a block of stragglers and a block of members of one region."""
    few, all_ = rows[rows["few"]].drop_duplicates("node"), rows[~rows["few"]].drop_duplicates("node")
    sig = np.frombuffer(b"".join(all_["sig"]), dtype=np.uint8).reshape(-1, BITS)
    node, family = all_["node"].to_numpy(), all_["family"].to_numpy()
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for one, own, s in zip(few["node"], few["family"], few["sig"], strict=True):
        near = np.flatnonzero((family != own) & ((sig == np.frombuffer(s, dtype=np.uint8)).sum(axis=1) >= AGREE))
        _, first = np.unique(family[near], return_index=True)  # one link to each other family joins them
        a.append(np.full(len(first), one))
        b.append(node[near[first]])
    return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})


def _straggler_links(crowd: DataFrame, families: DataFrame, sigs: DataFrame) -> DataFrame:
    """What splitting a crowded region can miss: its members outside the region's largest
    family are compared with all its members, block by block."""
    known = crowd.join(families, "node", "left").withColumn("family", F.coalesce("family", "node"))
    sizes = known.groupBy("head", "family").agg(F.count("*").alias("c"))
    top = sizes.groupBy("head").agg(F.max_by("family", F.struct("c", "family")).alias("top"), F.sum("c").alias("m"), F.max("c").alias("most")).where("m > most")
    blocks = lambda n: F.ceil(n / REGION).cast("int")
    rows = known.drop("m").join(top, "head").withColumns({"all_blocks": blocks(F.col("m")), "few_blocks": blocks(F.col("m") - F.col("most"))}).join(sigs, "node")

    def own(n: str):
        return F.pmod(F.xxhash64("node"), n).cast("int")

    members = rows.select("head", "node", "family", "sig", F.lit(False).alias("few"), own("all_blocks").alias("x"), F.explode(F.sequence(F.lit(0), F.col("few_blocks") - 1)).alias("y"))
    stragglers = rows.where("family <> top").select("head", "node", "family", "sig", F.lit(True).alias("few"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("x"), own("few_blocks").alias("y"))
    return members.unionByName(stragglers).groupBy("head", "x", "y").applyInPandas(_compare_stragglers, "a bigint, b bigint").distinct()


def _sets_of(k: int, passed: bytes):
    """(c1, c2, values) of the rows that may be in a family; ``passed`` is a bitmap over c1."""
    bits = np.frombuffer(passed, dtype=np.uint8)
    size = 8 * len(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = []
                for text in batch.column("text").slice(start, 512).to_pylist():
                    values = shingle_set(text, k)
                    if len(values):
                        a, b = _fingerprint(values)
                        at = a & (size - 1)
                        if bits[at >> 3] >> (at & 7) & 1:
                            rows.append((a, b, values.tobytes()))
                c1, c2, blob = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(blob, pa.binary())], names=["c1", "c2", "blob"])
        tidy()

    return run


def _confirm(similarity: tuple[int, int]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node").sort_values("node")
        sets = [np.frombuffer(b, dtype=np.uint64) for b in rows["blob"]]
        a, b = exact_links(sets, *similarity)
        node = rows["node"].to_numpy()
        return pd.DataFrame({"a": node[a], "b": node[b]})

    return run


def near_components(docs: DataFrame, k: int = 5, similarity: tuple[int, int] = (75, 100), row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, component; one row per input row.

    ``component`` numbers the components, and is null for an empty set; ``row``
    names a column to hand on as ``_row``.  Empty input gives no rows; equal rows are
    linked to each other; other columns of the input are not read.
    """
    rows = docs.select("doc_id", *([F.col(row).alias("_row")] if row else []), "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    described = cut(rows.mapInArrow(_describe(k), f"{kinds}, n bigint, c1 bigint, c2 bigint, heads array<bigint>, sig binary"), "described")
    nodes = (
        described.where("n > 0").groupBy("c1", "c2", "n")
        .agg(F.min("doc_id").alias("least_id"), F.first("heads").alias("heads"), F.first("sig").alias("sig"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = cut(nodes, "nodes")

    heads = nodes.select("node", F.posexplode("heads").alias("tree", "head"))
    crowded = heads.groupBy("head").agg(F.count("*").alias("m")).where("m > 1")
    order = F.expr(f"substring(concat(sig, sig), (tree + 1) * {DEPTH} + 1, {ORDER_BYTES})")
    deeper = F.when(F.col("m") > REGION * 4096, 3).when(F.col("m") > REGION * 64, 2).when(F.col("m") > REGION, 1).otherwise(0)
    crowd = heads.join(crowded.where(F.col("m") > REGION), "head").select("head", "m", "node")
    members = (
        heads.join(crowded, "head").join(nodes.select("node", "sig"), "node")
        .withColumn("order", order)
        .withColumn("deeper", deeper)
        .withColumn("region", F.xxhash64("head", F.expr("substring(order, 1, deeper)")))
        .select("region", "node", "sig", "order")
        .repartition("region").sortWithinPartitions("region", "order", "node")
    )
    similar = cut(members.mapInArrow(_region_links, "a bigint, b bigint"), "similar")
    families = cut(components(similar).withColumnRenamed("component", "family"), "families")
    if not crowded.where(F.col("m") > REGION).isEmpty():
        more = cut(_straggler_links(crowd, families, nodes.select("node", "sig")), "stragglers")
        if not more.isEmpty():
            stars = families.select(F.col("node").alias("a"), F.col("family").alias("b"))
            families = cut(components(stars.unionByName(more)).withColumnRenamed("component", "family"), "families")

    named = families.join(nodes.select("node", "c1", "c2"), "node")
    blobs = rows.select("text").mapInArrow(_sets_of(k, bitmap(named.select("c1"), "c1", FILTER_BITS)), "c1 bigint, c2 bigint, blob binary")
    blobs = blobs.groupBy("c1", "c2").agg(F.first("blob").alias("blob"))
    sets = named.join(blobs, ["c1", "c2"]).select("family", "node", "blob")
    sizes = families.join(nodes.select("node", "n"), "node").groupBy("family").agg(F.count("*").alias("m"), F.sum("n").alias("values"))
    large = cut(sizes.where((F.col("m") > FAMILY) | (F.col("values") > FAMILY_VALUES)).select("family", "m"), "large")

    if large.isEmpty():
        links = sets.groupBy("family").applyInPandas(_confirm(similarity), "a bigint, b bigint")
    else:
        sets = cut(sets, "sets")
        large = small(large)
        links = sets.join(large, "family", "left_anti").groupBy("family").applyInPandas(_confirm(similarity), "a bigint, b bigint")
        links = links.unionByName(_large_links(sets.join(large, "family"), similarity))
    linked = components(links)

    final = nodes.select("c1", "c2", "n", "least_id", "node").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = final.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of = final.join(least, "component").select("c1", "c2", "n", "component_id", "component")
    handed = ["_row"] if row else []
    return (
        described.select("doc_id", *handed, "n", "c1", "c2").join(of, ["c1", "c2", "n"], "left")
        .select("doc_id", *handed, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("component")).alias("component"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component that of the smallest doc_id
    (of equal or null ids the first) stays; rows without words stay.  ``docs`` must give
    the same rows in the same partitions when read again, as files do."""
    row = free_name(docs.columns, "_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    found = cut(near_components(numbered, row=row).select("_row", "doc_id", "component"), "near")
    best = found.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("best"))
    stays = best.select(F.col("best._row").alias("_row")).unionByName(found.where("component is null").select("_row"))
    return numbered.join(stays.withColumnRenamed("_row", row), row, "left_semi").select(*docs.columns)


def _large_links(sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links inside families of m nodes, too large for one task, in blocks of about BLOCK nodes."""
    dealt = sets.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pivot = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks") * F.lit(BLOCK)) < PIVOTS
    everywhere = F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = dealt.select("family", "node", "blob", F.explode(everywhere).alias("task"))
    links = cut(first.groupBy("family", "task").applyInPandas(_confirm(similarity), "a bigint, b bigint"), "block-links")

    label = components(links)
    known = cut(sets.drop("m").join(label, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component"), "known")
    sizes = known.groupBy("family", "part").agg(F.count("*").alias("m"))
    # small parts share blocks, large parts have blocks of their own
    slot = F.when(F.col("m") >= BLOCK, F.struct(F.col("part").alias("p"), F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / BLOCK)).cast("bigint").alias("q"), F.lit(True).alias("alone")))
    totals = small(sizes.groupBy("family").agg(F.ceil(F.sum(F.when(F.col("m") < BLOCK, F.col("m")).otherwise(0)) / BLOCK).alias("shared"), F.count("*").alias("parts")).where("parts > 1"))
    placed = (
        known.join(totals, "family").join(sizes, ["family", "part"])
        .withColumn("slot", F.coalesce(slot, F.struct(F.lit(-1).cast("bigint").alias("p"), F.pmod(F.xxhash64("node"), F.greatest("shared", F.lit(1))).cast("bigint").alias("q"), F.lit(False).alias("alone"))))
        .select("family", "node", "blob", "slot")
    )
    slots = placed.select("family", "slot").distinct()
    a, b = slots.alias("a"), slots.alias("b")
    ordered = F.col("a.slot") <= F.col("b.slot")
    different = ~((F.col("a.slot.p") == F.col("b.slot.p")) & F.col("a.slot.alone"))
    pairs = a.join(b, (F.col("a.family") == F.col("b.family")) & ordered & different).select("a.family", F.col("a.slot").alias("s"), F.col("b.slot").alias("t"))
    pairs = pairs.withColumn("task", F.struct("s", "t")).select("family", "task", F.explode(F.array("s", "t")).alias("slot"))
    return placed.join(pairs, ["family", "slot"]).select("family", "task", "node", "blob").groupBy("family", "task").applyInPandas(_confirm(similarity), "a bigint, b bigint").unionByName(links)
