"""Exact dedup by composable polynomial fingerprints.

A text is hashed in chunks; H(a+b) = H(a) * r^len(b) + H(b) (mod p) puts chunk
hashes together in any grouping.  A text of more than LONG bytes is dealt out in chunks
that are hashed in parallel, whatever task they are in: each chunk's hash is shifted by
the length that follows it, so that the text's hash is a plain sum of them.  Shorter
texts are hashed where they are, by the same arithmetic.  Two primes and the byte
length identify a candidate group.  Rows of groups of more than one row are then
compared chunk by chunk: for each chunk number the smallest and largest chunk must be
the same bytes.  That aggregation combines before the shuffle, so a group holding a
third of all rows is no hot spot.  A group that fails the comparison is split by the
texts' SHA-256.

Texts are read once to be hashed, and those of repeated fingerprints once more to be
compared; everything else is done on rows of numbers, which are written once.

Null texts count as empty; an empty table gives no rows.  Of equal texts the row of the
largest doc_id stays (a null doc_id is smallest; of fully equal rows one stays).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bitmap, cut, free_name

CHUNK = 1 << 16
PRIMES = (2147483647, 2147483629)
ROOTS = (1103515245, 742938285)
#: Bound of the prefilter before texts are compared: 128 MB, 64 to 128 bits an entry up to there.
FILTER_BITS = 1 << 30
#: A text of more bytes is hashed by several tasks.
LONG = 64 * CHUNK


def _powers(root: int, prime: int) -> np.ndarray:
    out = np.ones(CHUNK, dtype=np.uint64)
    done = 1
    while done < CHUNK:
        step = pow(root, done, prime)
        take = min(done, CHUNK - done)
        out[done : done + take] = out[:take] * np.uint64(step) % np.uint64(prime)
        done += take
    return out[::-1].copy()  # the last byte of a chunk has power 0


_TABLES = [_powers(r, p) for r, p in zip(ROOTS, PRIMES, strict=True)]


def chunk_fingerprint(data: np.ndarray) -> tuple[int, int, int]:
    """(length, hash, hash) of at most CHUNK bytes."""
    values = data.astype(np.uint64) + np.uint64(1)
    # each product is below 2^40 and there are at most 2^16: the sum fits
    hashes = [int((values * t[CHUNK - len(data) :]).sum(dtype=np.uint64)) % p for t, p in zip(_TABLES, PRIMES, strict=True)]
    return len(data), hashes[0], hashes[1]


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """Fingerprint of the concatenation; associative, with (0, 0, 0) as identity."""
    n = right[0]
    first, second = ((left[i + 1] * pow(ROOTS[i], n, PRIMES[i]) + right[i + 1]) % PRIMES[i] for i in (0, 1))
    return left[0] + n, first, second


def fingerprint(data: bytes) -> tuple[int, int, int]:
    whole, every = (0, 0, 0), np.frombuffer(data, dtype=np.uint8)
    for i in range(0, len(every), CHUNK):
        whole = combine(whole, chunk_fingerprint(every[i : i + CHUNK]))
    return whole


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("_text")
        found = [fingerprint((column[i].as_py() or "").encode()) for i in range(len(column))]
        n, a, b = zip(*found, strict=True) if found else ((), (), ())
        keep = [batch.column(i) for i in range(batch.num_columns - 1)]
        arrays = [*keep, pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "_n", "_a", "_b"])


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_row, a, b): hashes of single chunks, shifted by the bytes that follow them in their text."""
    for batch in batches:
        a, b = [], []
        for chunk, after in zip(batch.column("chunk").to_pylist(), batch.column("after").to_pylist(), strict=True):
            _, x, y = combine(chunk_fingerprint(np.frombuffer(chunk, dtype=np.uint8)), (after, 0, 0))
            a.append(x)
            b.append(y)
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["_row", "a", "b"])


def _mark(n, a, b):
    """What the prefilter of repeated fingerprints goes by: of columns or of numbers."""
    return a + 31 * b + n


def _chunks(passed: bytes):
    """Chunks of texts whose fingerprint may be repeated, with it."""
    size = 8 * len(passed)
    names, kinds = ["_n", "_a", "_b", "chunk_no", "chunk"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            column = batch.column("_text")
            for i in range(len(column)):
                text = (column[i].as_py() or "").encode()
                n, a, b = fingerprint(text)
                at = _mark(n, a, b) % size
                if not passed[at >> 3] >> (at & 7) & 1:
                    continue
                for k in range(0, max(1, len(text)), CHUNK):
                    rows.append((n, a, b, k // CHUNK, text[k : k + CHUNK]))
                held += len(text)
                if held > 8 << 20:
                    yield batch_of()
                    rows.clear()
                    held = 0
        yield batch_of()

    return run


def chunks_of(texts: DataFrame, *carry: str) -> DataFrame:
    """``carry`` columns, chunk_no, chunk and after (bytes that follow it) of each text in ``_text``."""
    data, size = F.encode("_text", "UTF-8"), F.octet_length("_text")
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(size / CHUNK).cast("int") - 1, F.lit(0)))
    rows = texts.select(*carry, data.alias("_data"), size.cast("bigint").alias("_size"), F.explode(numbers).alias("chunk_no"))
    chunk = F.substring(F.col("_data"), F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK))
    return rows.select(*carry, "chunk_no", chunk.alias("chunk"), F.greatest(F.col("_size") - (F.col("chunk_no") + 1).cast("bigint") * CHUNK, F.lit(0)).alias("after"))


def described(rows: DataFrame) -> DataFrame:
    """Adds _n, _a, _b to rows with _row and (last) _text, which goes."""
    carry = rows.columns[:-1]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    long = F.octet_length("_text") > LONG
    short = rows.where(~long).mapInArrow(_describe, f"{kinds}, _n bigint, _a bigint, _b bigint")
    huge = rows.where(long)
    parts = chunks_of(huge, "_row").repartition("_row", "chunk_no").select("_row", "chunk", "after").mapInArrow(_shifted, "_row bigint, a bigint, b bigint")
    whole = parts.groupBy("_row").agg((F.sum("a") % PRIMES[0]).alias("_a"), (F.sum("b") % PRIMES[1]).alias("_b"))
    joined = huge.select(*carry, F.octet_length("_text").cast("bigint").alias("_n")).join(whole, "_row").select(*carry, "_n", "_a", "_b")
    return short.unionByName(joined)


def exact_rows(docs: DataFrame, digest: bool = True) -> DataFrame:
    """doc_id, keep_id, group_size, kept, _row and (digest) text_sha256; one row per input row.

    ``_row`` is monotonically_increasing_id() of ``docs``, which must give the same rows in
    the same partitions when it is read again, as files do; put other frames through
    common.cut first.  Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").alias("_id"), F.monotonically_increasing_id().alias("_row"), F.sha2(text, 256).alias("_sha"), text.alias("_text"))
    known = cut(described(texts if digest else texts.drop("_sha")), "fingerprints")
    key = ["_n", "_a", "_b"]
    groups = known.groupBy(*key).agg(F.count("*").alias("group_size"), F.max(F.struct("_id", "_row")).alias("_keep"))
    repeated = cut(groups.where("group_size > 1"), "repeated")
    members = cut(known.join(repeated, key), "members")

    long = F.octet_length("_text") > LONG
    marks = bitmap(repeated.select(_mark(F.col("_n"), F.col("_a"), F.col("_b")).alias("mark")), "mark", FILTER_BITS)
    short = texts.select("_text").where(~long).mapInArrow(_chunks(marks), "_n bigint, _a bigint, _b bigint, chunk_no int, chunk binary")
    huge = chunks_of(texts.select("_row", "_text").where(long).join(members.select("_row", *key), "_row"), *key).drop("after")
    compared = short.unionByName(huge).groupBy(*key, "chunk_no").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    unequal = cut(compared.where("low <> high").select(*key).distinct(), "unequal")
    if not unequal.isEmpty():
        apart = members.join(unequal, key, "left_semi")
        if not digest:
            apart = apart.join(texts.select("_row", "_sha"), "_row")
        parts = apart.groupBy(*key, "_sha").agg(F.count("*").alias("_size"), F.max(F.struct("_id", "_row")).alias("_own"))
        apart = apart.drop("group_size", "_keep").join(parts, [*key, "_sha"]).withColumnsRenamed({"_size": "group_size", "_own": "_keep"})
        members = members.join(unequal, key, "left_anti").unionByName(apart.select(*members.columns))
    alone = known.join(repeated.select(*key), key, "left_anti").withColumns({"group_size": F.lit(1).cast("bigint"), "_keep": F.struct("_id", "_row")})
    every = members.unionByName(alone.select(*members.columns))
    out = [F.col("_id").alias("doc_id"), F.col("_keep._id").alias("keep_id"), F.col("group_size"), (F.col("_row") == F.col("_keep._row")).alias("kept"), F.col("_row")]
    return every.select(*out, *([F.col("_sha").alias("text_sha256")] if digest else []))


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row per input row."""
    return exact_rows(docs).drop("_row")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    row = free_name(docs.columns, "_row")
    gone = exact_rows(docs, digest=False).where("not kept").select(F.col("_row").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(gone, row, "left_anti").select(*docs.columns)
