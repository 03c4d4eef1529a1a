"""Shared storage, lineage cuts and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import sources
from tidemark.llm.linking import roots_of

#: Links (of two numbers) that one task joins; beyond that they are joined in distributed rounds.
ONE_TASK = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_written: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the folder that the driver and all executors share (see sources.shared_folder)."""
    _written.append(sources.fresh_path(spark, name))
    return _written[-1]


def release(spark: SparkSession, but: tuple[str, ...] = ()) -> None:
    """Deletes what this process has cut so far, except the paths ``but``; results still to
    be read depend on it.  What is left at the end of the process is deleted then."""
    for path in [p for p in _written if p not in but]:
        _written.remove(path)
        drop_path(spark, path)


def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if _written and spark is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            release(spark)


atexit.register(_release_at_exit)


def cut(frame: DataFrame, name: str = "cut") -> DataFrame:
    """Write to the shared folder and read back: a lineage cut that outlives any executor.

    The shuffles before it are needed no more; the driver's collection lets Spark's cleaner
    delete their files now, not when the driver next runs short of memory.
    """
    path = fresh_path(frame.sparkSession, name)
    frame.write.parquet(path)
    for _ in range(2):  # at the first, the JVM's side of this call still holds the write's plan
        gc.collect()
        frame.sparkSession.sparkContext._jvm.java.lang.System.gc()
        time.sleep(0.2)  # the cleaner works in a thread of its own
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def small(frame: DataFrame, most: int = 100_000) -> DataFrame:
    """A cut of the frame, to be broadcast if it has at most ``most`` rows (of a few numbers each);
    beyond that, joins with it shuffle as Spark sees fit."""
    frame = cut(frame, "small")
    return F.broadcast(frame) if frame.count() <= most else frame


def free_name(columns: list[str], name: str) -> str:
    """``name``, or that with underscores before it, which none of the columns has (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def last_path() -> str:
    """Where the latest cut went."""
    return _written[-1]


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def bitmap(values: DataFrame, column: str, most: int) -> bytes:
    """A bitmap over the low bits of a column of hashes: a power of two of at least 64 bits a
    row and at most ``most`` bits in all, so its size is measured and bounded.  It only saves
    work: what it lets through is joined exactly, and a full bitmap lets all through."""
    size = 1 << 18
    rows = values.count()
    while size < min(most, 64 * rows):
        size <<= 1
    at = F.col(column).bitwiseAND(size - 1) + 1
    marked = values.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
    out = np.zeros(size // 8, dtype=np.uint8)
    maps = marked.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    # the iterator runs a job for each partition: one for each 4 MB, not one for each shuffle partition
    for row in maps.repartition(max(1, size >> 25)).toLocalIterator():
        first = (int(row["bucket"]) - 1) * 4096
        out[first : first + 4096] |= np.frombuffer(row["map"], dtype=np.uint8)
    return out.tobytes()


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def tidy() -> None:
    """Gives a Python worker's freed memory back, at the end of a task: workers live on."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): (node, component), component = smallest node.

    Alternates large-star and small-star steps (Kiveris et al., Connected
    Components in MapReduce and Beyond, 2014) until every component is a star.
    Nodes without a link to another node do not occur.  Nothing is collected:
    each round is two joins on the node, written to the shared folder.

    Up to ONE_TASK links are joined by one task instead: the driver keeps what it knows of
    each stage and task, and the rounds have some ten stages each of as many tasks as there
    are shuffle partitions, however few the links.
    """
    spark = edges.sparkSession
    star, first = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"), True
    if star.count() <= ONE_TASK:
        kind = star.schema["u"].dataType.simpleString()
        return star.repartition(1).mapInArrow(_joined, f"node {kind}, component {kind}")
    last = last_path()
    while not star.isEmpty() and (first or not _is_star(star)):
        first = False
        both = star.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.*")
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
        small = large.join(nearest, "u").select(F.explode(pairs).alias("e")).select("e.*").where("u <> v").distinct()
        before = last
        star, last = cut(small, "edges"), last_path()
        _written.remove(before)
        drop_path(spark, before)
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all links (u, v) given."""
    ends: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]]
    for batch in batches:
        for side, column in zip(ends, batch.columns, strict=True):
            side.append(column.to_numpy(zero_copy_only=False))
    u, v = map(np.concatenate, ends)
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = roots_of(len(nodes), at[: len(u)], at[len(u) :])
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def _is_star(star: DataFrame) -> bool:
    roles = star.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("top")), F.struct(F.col("v").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("top")))).alias("r")).select("r.*")
    return roles.groupBy("x").agg(F.sum("low").alias("low"), F.max("top").alias("top")).where("low > 1 or (low > 0 and top > 0)").isEmpty()
