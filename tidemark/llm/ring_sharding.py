"""Consistent-hash ring with virtual nodes and bounded loads; DataFrame functions only.

Keys are placed on a ring of SLOTS slots by the hash of their text, so equal
texts are neighbours and stay together as far as the bound allows.  A key goes to
the shard of the next virtual node clockwise; keys that overflow a full shard
continue clockwise.  With the bound "rows" (n // shards, one more for the first
n % shards of them) every shard is filled exactly, so counts are at most one
apart.  Only the counts of the arcs (at most ``shards * virtual_nodes``, fixed by
the parameters) come to the driver; rows are ranked inside (arc, part), where
the parts of an arc are ranges of the text's hash and grow in number with its rows.
Only a text with more rows than fit a part is subdivided by doc_id, so that one
which a third of the rows share is ranked in many tasks; it follows the arc's other
texts.  So all rows of a text have ranks in a row, and where an arc overflows, each
cut between two shards parts at most one text.

Null texts have size 1 and the CRC of the empty text, and lie together on the
ring; equal rows get slots of their own.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

SLOTS = 1 << 14
PART_ROWS = 20_000
#: A text is subdivided if it also has more than one in so many of all rows: that many rows are broadcast at most.
HEAVY_TEXTS = 10_000


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(slot, shard) of the virtual nodes in clockwise order; one shard more only adds nodes."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            place = int.from_bytes(hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=8).digest(), "big") % SLOTS
            taken.setdefault(place, shard)
    return sorted(taken.items())


def flows(nodes: list[tuple[int, int]], counts: dict[int, int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, first rank, end rank, shard, first slot): each arc's keys go to its own
    shard up to the capacity, the rest clockwise to the next shards with room."""
    room, filled, pieces, over = list(capacity), [0] * len(capacity), [], []

    def put(arc: int, lo: int, hi: int, shard: int) -> int:
        take = min(hi - lo, room[shard])
        if take:
            pieces.append((arc, lo, lo + take, shard, filled[shard]))
            room[shard] -= take
            filled[shard] += take
        return lo + take

    for arc, (_, shard) in enumerate(nodes):
        n = counts.get(arc, 0)
        at = put(arc, 0, n, shard)
        if at < n:
            over.append((arc, at, n))
    for arc, at, n in over:
        step = arc
        while at < n:
            step = (step + 1) % len(nodes)
            at = put(arc, at, n, nodes[step][1])
    return pieces


def shard_rows(docs: DataFrame, shards: int = 8, virtual_nodes: int = 128) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per input row."""
    spark = docs.sparkSession
    nodes = ring(shards, virtual_nodes)
    text = F.coalesce(F.col("text"), F.lit(""))
    arc_of_slot, arc = [], 0
    for slot in range(SLOTS):
        while arc < len(nodes) and nodes[arc][0] < slot:
            arc += 1
        arc_of_slot.append((slot, arc % len(nodes)))
    arcs = F.broadcast(spark.createDataFrame(arc_of_slot, "slot_no int, arc int"))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("place"),
    )
    rows = rows.withColumn("slot_no", F.pmod("place", F.lit(SLOTS)).cast("int"))
    placed = cut(rows.join(arcs, "slot_no").select("doc_id", "size", "text_crc32", "place", "arc"), "placed")

    counts = {r["arc"]: r["n"] for r in placed.groupBy("arc").agg(F.count("*").alias("n")).toLocalIterator()}
    total = sum(counts.values())
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    made: dict[int, list] = {}
    for arc, lo, hi, shard, first in flows(nodes, counts, capacity):
        made.setdefault(arc, []).append((lo, hi, shard, first))
    parts = [(arc, max(1, -(-n // PART_ROWS)), made[arc]) for arc, n in counts.items()]
    plan = F.broadcast(spark.createDataFrame(parts, "arc int, parts int, pieces array<struct<lo:bigint,hi:bigint,shard:int,first:bigint>>"))

    most = max(PART_ROWS, total // HEAVY_TEXTS)
    heavy = placed.join(plan.where("parts > 1").select("arc"), "arc").groupBy("arc", "place").agg(F.count("*").alias("n")).where(F.col("n") > most)
    heavy = F.broadcast(heavy.select("arc", "place", F.ceil(F.col("n") / PART_ROWS).cast("bigint").alias("splits")))
    alone = F.col("splits").isNotNull()
    by_place = F.shiftright(F.shiftrightunsigned("place", 34) * F.col("parts"), 30)
    dealt = (
        placed.join(plan.select("arc", "parts"), "arc").join(heavy, ["arc", "place"], "left")
        .withColumn("heavy", alone).withColumn("at", F.when(alone, F.col("place")).otherwise(F.lit(0)))
        .withColumn("part", F.when(alone, F.pmod(F.xxhash64("doc_id"), "splits")).otherwise(by_place)).drop("parts", "splits")
    )
    part = ["arc", "heavy", "at", "part"]
    before = Window.partitionBy("arc").orderBy("heavy", "at", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*part).agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy(*part).orderBy("place", "doc_id", "text_crc32", "size")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(starts, part).withColumn("rank", F.col("rank") + F.col("start"))
    piece = F.expr("filter(pieces, p -> rank >= p.lo and rank < p.hi)[0]")
    return ranked.join(plan.select("arc", "pieces"), "arc").withColumn("piece", piece).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("piece.shard").alias("shard"),
        (F.col("piece.first") + F.col("rank") - F.col("piece.lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
