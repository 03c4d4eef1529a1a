"""Substring dedup by De Bruijn compaction.

The edges of the graph are the windows of WINDOW consecutive words, its nodes the
overlaps of WINDOW - 1 words.  A word is removed if a window over it occurs, as a
word sequence, at any other place, same document included.

1. Every window has a least ANCHOR-word gram by hash (its minimiser), and equal
   windows have the same one.  Grams are counted; a bitmap over the repeated ones, sized
   by their number up to ANCHOR_BITS, tells which windows can be repeated.  Of more grams
   than it holds at FULL bits each, every text gets the list of its repeated ones by a
   semi-join instead, and in step 3 that of the minimisers of path ends.  Either only
   saves work.
2. Those windows are counted by 96-bit hash, with the least and largest hash (all 96
   bits) of the windows before and after them.  The repeated ones are the edges that
   matter; one joins the next without branching if each is the other's only neighbour.
   A join on these links compacts paths: just their first and last edges go on.
3. A second reading of the sources gives the coordinates of first and last edges; in
   each text they alternate and so delimit the repeated spans.
4. Verification: while the words of the spans are taken out, each span is digested by
   SHA-256 over its words, and the spans of a path must all have the same words.  Paths
   whose spans differ (windows that share 96 bits of hash) are decided window by window
   by SHA-256, as is everything if some text's ends do not alternate; normally there are none.

Rows of equal text are told apart by nothing but their number, so results are kept
by text (128 bits of hashes of it), and any doc_id, null or repeated, will do.  Null
texts have no words; an empty table gives no rows; the order of rows does not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bitmap, cut, in_bitmap
from tidemark.llm.words import least_positions, mix, shingle_hashes, word_bounds, word_hashes

WINDOW, ANCHOR = 35, 20
MERGED = 1 << 19
#: Bounds of the two prefilters (128 MB each); they have 64 to 128 bits an entry up to there.
ANCHOR_BITS, EDGE_BITS = 1 << 30, 1 << 30
#: Bits an entry below which the first would let too much through and lists take its place.
FULL = 8


def _words(text: str | None) -> np.ndarray:
    return word_hashes(np.frombuffer((text or "").encode(), dtype=np.uint8), fold=False)[0]


def anchors_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, for each window the position of its least gram)."""
    grams = shingle_hashes(words, ANCHOR)
    return grams, least_positions(grams, WINDOW - ANCHOR + 1)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            found = [np.zeros(0, dtype=np.uint64)]
            for text in batch.column("text").slice(start, 512).to_pylist():
                words = _words(text)
                if len(words) >= WINDOW:
                    grams, least = anchors_of(words)
                    found.append(grams[np.unique(least)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["gram"])


def identity(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 96 bits by which windows are told apart: 64 (never 0, which stands for no window) and 32."""
    check = shingle_hashes(mix(words ^ np.uint64(0xA0761D6478BD642F)), WINDOW)
    return shingle_hashes(words, WINDOW) | np.uint64(1), (check >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, k1) of the minimisers of texts, merged over MERGED of them, as many texts may be equal."""
    grams, texts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]

    def merged() -> pa.RecordBatch:
        g, k = np.concatenate(grams), np.concatenate(texts)
        order = np.lexsort((k, g))
        g, k = g[order], k[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])]) if len(g) else np.zeros(0, dtype=bool)
        del grams[1:], texts[1:]
        return pa.RecordBatch.from_arrays([pa.array(g[new]), pa.array(k[new])], names=["gram", "k1"])

    held = 0
    for batch in batches:
        for text, k1 in zip(batch.column("text"), batch.column("k1").to_pylist(), strict=True):
            words = _words(text.as_py())
            if len(words) < WINDOW:
                continue
            found, least = anchors_of(words)
            grams.append(found[np.unique(least)].view(np.int64))
            texts.append(np.full(len(grams[-1]), k1))
            held += len(grams[-1])
            if held > MERGED:
                yield merged()
                held = 0
    yield merged()


def _listed(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """The texts with any of these (distinct) minimisers, and which of them: ``grams``, a text's own at most."""
    has = rows.select("text", "k1").mapInArrow(_pairs, "gram bigint, k1 bigint").join(grams, "gram", "left_semi")
    return rows.join(has.groupBy("k1").agg(F.collect_set("gram").alias("grams")), "k1")


def _windows(words: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window hashes, check hashes, positions of those whose minimiser is wanted, their minimisers);
    ``wanted`` is a bitmap (of bytes) or a list (of 64-bit numbers)."""
    grams, least = anchors_of(words)
    possible = np.flatnonzero((in_bitmap(wanted, grams) if wanted.dtype == np.uint8 else np.isin(grams.view(np.int64), wanted))[least])
    if not len(possible):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32), possible, np.zeros(0, dtype=np.int64)
    return *identity(words), possible, grams[least[possible]].view(np.int64)


def _texts(part: pa.RecordBatch, bits: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, wanted minimisers) of each text: the bitmap's, or the text's own list where there is none."""
    own = part.column("grams") if bits is None else None
    for i, text in enumerate(part.column("text").to_pylist()):
        yield _words(text), bits if own is None else own[i].values.to_numpy()


def _merged(columns: list[np.ndarray]) -> list[np.ndarray]:
    """(h, c, n, bh, bc, ah, ac, gram if given) of distinct windows: how often they are there, and their
    neighbours, 0 where there is none or places differ."""
    order = np.lexsort((columns[1], columns[0]))
    columns = [x[order] for x in columns]
    h, c = columns[:2]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    out = [h[first], c[first], np.diff(np.append(first, len(h)))]
    for x, y in (columns[2:4], columns[4:6]):
        same = np.ones(len(first), dtype=bool)
        same[run[(x != x[first][run]) | (y != y[first][run])]] = False
        out += [np.where(same, x[first], 0), np.where(same, y[first], 0)]
    return out + [x[first] for x in columns[6:]]


_EDGE = "h bigint, c int, n bigint, bh bigint, bc int, ah bigint, ac int"


def _edges(anchor_map: bytes | None):
    """Possible windows with their neighbours, merged over MERGED of them: a window that a third
    of all documents share comes to a task of the next stage once for some thousand documents.
    Without a map the texts bring lists, and windows go on with their minimisers."""
    bits = None if anchor_map is None else np.frombuffer(anchor_map, dtype=np.uint8)
    kinds = [np.int64, np.int32] * 3 + [np.int64] * (bits is None)
    names = ["h", "c", "n", "bh", "bc", "ah", "ac", "gram"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[] for _ in kinds]
        held = 0

        def merged() -> pa.RecordBatch:
            found = _merged([np.concatenate(p or [np.zeros(0, dtype=k)]) for p, k in zip(parts, kinds, strict=True)])
            for p in parts:
                p.clear()
            kinds_out = [pa.int64(), pa.int32(), pa.int64(), *[pa.int64(), pa.int32()] * 2, pa.int64()][: len(found)]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, kinds_out, strict=True)], names=names[: len(found)])

        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                for words, wanted in _texts(batch.slice(start, 128), bits):
                    if len(words) < WINDOW:
                        continue
                    hashes, check, at, gram = _windows(words, wanted)
                    if len(at):
                        around = np.concatenate([[np.uint64(0)], hashes, [np.uint64(0)]]).view(np.int64)
                        beside = np.concatenate([[np.int32(0)], check, [np.int32(0)]])
                        columns = (around[at + 1], beside[at + 1], around[at], beside[at], around[at + 2], beside[at + 2], gram)
                        for part, values in zip(parts, columns[: len(parts)], strict=True):
                            part.append(values)
                        held += len(at)
                    if held > MERGED:
                        yield merged()
                        held = 0
        yield merged()

    return run


def _ends(anchor_map: bytes | None, edge_map: bytes | None):
    bits, ends = (None if m is None else np.frombuffer(m, dtype=np.uint8) for m in (anchor_map, edge_map))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                hs, cs, ats, owner = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
                for i, (words, wanted) in enumerate(_texts(part, bits)):
                    if len(words) < WINDOW:
                        continue
                    hashes, check, at, _ = _windows(words, wanted)
                    at = at[in_bitmap(ends, hashes[at])] if ends is not None and len(at) else at
                    if len(at):
                        hs.append(hashes[at])
                        cs.append(check[at])
                        ats.append(at)
                        owner.append(np.full(len(at), i))
                own = np.concatenate(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(cs)), part.column("k1").take(pa.array(own)), part.column("k2").take(pa.array(own)), pa.array(np.concatenate(ats))],
                    names=["h", "c", "k1", "k2", "at"],
                )

    return run


def _joined(raw: bytes, low: np.ndarray, high: np.ndarray, first: int, last: int) -> bytes:
    """The words first..last with one space between them, whatever separates them."""
    return b" ".join(raw[low[first] : high[last]].split())


def _digest(raw: bytes, low: np.ndarray, high: np.ndarray, first: int, last: int) -> bytes:
    return hashlib.sha256(_joined(raw, low, high, first, last)).digest()


_SPAN = pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int32()), ("d", pa.binary())]))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes the spans out; with ``windows`` (positions decided one by one) those instead."""
    for batch in batches:
        decided = "windows" in batch.schema.names
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            n_words, n_removed, digest, spans, odd = [], [], [], [], []
            starts = part.column("windows" if decided else "firsts").to_pylist()
            stops = [None] * part.num_rows if decided else part.column("lasts").to_pylist()
            for text, firsts, lasts in zip(part.column("text").to_pylist(), starts, stops, strict=True):
                raw = (text or "").encode()
                low, high = word_bounds(np.frombuffer(raw, dtype=np.uint8))
                n, found, wrong = len(low), [], False
                a = b = np.zeros(0, dtype=np.int64)
                if decided:
                    a = b = np.array(firsts or [], dtype=np.int64)
                elif firsts or lasts:
                    firsts = sorted(firsts, key=lambda f: f["at"])
                    a, b = np.array([f["at"] for f in firsts], dtype=np.int64), np.sort(np.array(lasts, dtype=np.int64))
                    wrong = bool(len(a) != len(b) or (a > b).any() or (a[1:] <= b[:-1]).any() or b[-1] + WINDOW > n)
                    if not wrong:
                        found = [{"h": f["h"], "c": f["c"], "d": _digest(raw, low, high, i, j + WINDOW - 1)} for f, i, j in zip(firsts, a.tolist(), b.tolist(), strict=True)]
                if len(a) and not wrong:
                    depth = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(depth, a, 1)
                    np.add.at(depth, b + WINDOW, -1)
                    stays = np.concatenate([[False], np.cumsum(depth[:n]) == 0, [False]])
                    edge = np.flatnonzero(stays[1:] != stays[:-1])
                    kept = b" ".join([_joined(raw, low, high, i, j - 1) for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                    gone = n - int(stays.sum())
                else:
                    kept, gone = b" ".join(raw.split()), 0
                n_words.append(n)
                n_removed.append(gone)
                digest.append(hashlib.sha256(kept).hexdigest())
                spans.append(found)
                odd.append(wrong)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("k1"), part.column("k2"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, _SPAN), pa.array(odd, pa.bool_())],
                names=["doc_id", "k1", "k2", "n_words", "n_removed", "kept_sha256", "spans", "odd"],
            )


def _exact_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, at, d, copies): windows of the given spans, all of a text's where there are none given, by SHA-256."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in ("text", "k1", "k2", "copies", "s")}
            raw = (row["text"] or "").encode()
            low, high = word_bounds(np.frombuffer(raw, dtype=np.uint8))
            spans = [(0, len(low) - WINDOW)] if row["s"] is None else [(s["a"], s["b"]) for s in row["s"]]
            at = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in spans]))
            for lo in range(0, len(at), 20_000):
                some = at[lo : lo + 20_000].tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["k1"]] * len(some), pa.int64()), pa.array([row["k2"]] * len(some), pa.int64()), pa.array(some, pa.int64()),
                     pa.array([_digest(raw, low, high, x, x + WINDOW - 1) for x in some], pa.binary()), pa.array([row["copies"]] * len(some), pa.int64())],
                    names=["k1", "k2", "at", "d", "copies"],
                )


def path_ends(rows: DataFrame) -> DataFrame:
    """(k1, k2, firsts, lasts): window positions at which repeated paths begin (with the path) and end in each text."""
    grams = cut(rows.select("text").mapInArrow(_anchors, "gram bigint").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    listed = FULL * grams.count() > ANCHOR_BITS
    own = ["gram"] if listed else []
    sides = ("bh", "bc", "ah", "ac")
    if listed:
        anchors, found = None, _listed(rows, grams).select("text", "grams").mapInArrow(_edges(None), f"{_EDGE}, gram bigint")
    else:
        anchors = bitmap(grams, "gram", ANCHOR_BITS)
        found = rows.select("text").mapInArrow(_edges(anchors), _EDGE)
    edges = found.repartition("h", "c").groupBy("h", "c").agg(
        F.sum("n").alias("n"), *[f(x).alias(f"{f.__name__}_{x}") for x in sides for f in (F.min, F.max)], *[F.min(x).alias(x) for x in own]
    )

    def only(h: str, c: str, x: str) -> Column:
        """One half of the neighbour on one side, if all places of the window have the same one there."""
        one = (F.col(f"min_{h}") == F.col(f"max_{h}")) & (F.col(f"min_{c}") == F.col(f"max_{c}")) & (F.col(f"min_{h}") != 0)
        return F.when(one, F.col(f"min_{x}")).alias(x)

    edges = cut(edges.where("n > 1").select("h", "c", *own, only("bh", "bc", "bh"), only("bh", "bc", "bc"), only("ah", "ac", "ah"), only("ah", "ac", "ac")), "edges")
    # a link x -> y that both ends agree on does not branch
    forward = edges.where("ah is not null").select(F.col("h").alias("xh"), F.col("c").alias("xc"), F.col("ah").alias("yh"), F.col("ac").alias("yc"))
    backward = edges.where("bh is not null").select(F.col("bh").alias("xh"), F.col("bc").alias("xc"), F.col("h").alias("yh"), F.col("c").alias("yc"))
    links = cut(forward.join(backward, ["xh", "xc", "yh", "yc"], "left_semi"), "links")
    first = edges.join(links.select(F.col("yh").alias("h"), F.col("yc").alias("c")), ["h", "c"], "left_anti").select("h", "c", *own, F.lit(True).alias("first"))
    last = edges.join(links.select(F.col("xh").alias("h"), F.col("xc").alias("c")), ["h", "c"], "left_anti").select("h", "c", *own, F.lit(False).alias("first"))
    ends = cut(first.unionByName(last), "ends")
    place = "h bigint, c int, k1 bigint, k2 bigint, at bigint"
    if listed:
        found = _listed(rows, ends.select("gram").distinct()).select("k1", "k2", "text", "grams").mapInArrow(_ends(None, None), place)
    else:
        found = rows.select("k1", "k2", "text").mapInArrow(_ends(anchors, bitmap(ends.select("h"), "h", EDGE_BITS)), place)
    # equal texts report the same places; sets count them once
    return found.join(ends, ["h", "c"]).groupBy("k1", "k2").agg(
        F.collect_set(F.when(F.col("first"), F.struct("at", "h", "c"))).alias("firsts"), F.collect_set(F.when(~F.col("first"), F.col("at"))).alias("lasts")
    )


def _decided_windows(rows: DataFrame, ends: DataFrame, doubted: DataFrame, every: bool) -> DataFrame:
    """(k1, k2, windows) of texts in which a path is in doubt: positions of windows that truly repeat.

    A window belongs to one path, so its equals lie on the same path and are in doubt too:
    counting among the doubted decides.  With ``every`` all windows of all texts are counted.
    """
    same = rows.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    pairs = F.arrays_zip(F.array_sort("firsts").alias("f"), F.array_sort("lasts").alias("l"))
    spans = ends.select("k1", "k2", F.explode(pairs).alias("p")).select("k1", "k2", F.col("p.f.at").alias("a"), F.col("p.l").alias("b"), "p.f.h", "p.f.c")
    if every:
        asked = same.withColumn("s", F.lit(None).cast("array<struct<a:bigint,b:bigint>>"))
    else:
        hit = spans.join(doubted, ["h", "c"], "left_semi")
        asked = same.join(hit.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("s")), ["k1", "k2"])
    windows = cut(asked.select("text", "k1", "k2", "copies", "s").mapInArrow(_exact_windows, "k1 bigint, k2 bigint, at bigint, d binary, copies bigint"), "exact")
    again = windows.groupBy("d").agg(F.sum("copies").alias("n")).where("n > 1").select("d")
    sure = windows.join(again, "d", "left_semi").select("k1", "k2", "at")
    if every:
        return same.select("k1", "k2").join(sure.groupBy("k1", "k2").agg(F.collect_set("at").alias("windows")), ["k1", "k2"], "left")
    texts = hit.select("k1", "k2").distinct()
    # the other spans of these texts stand as they are
    rest = spans.join(doubted, ["h", "c"], "left_anti").join(texts, ["k1", "k2"], "left_semi")
    sure = sure.unionByName(rest.select("k1", "k2", F.explode(F.sequence("a", "b")).alias("at")))
    return texts.join(sure.groupBy("k1", "k2").agg(F.collect_set("at").alias("windows")), ["k1", "k2"], "left")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; one row per input row."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), F.col("text")).alias("k2"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, k1 bigint, k2 bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<h:bigint,c:int,d:binary>>, odd boolean"
    out = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    ends = cut(path_ends(rows), "spans")
    found = cut(rows.join(ends, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "text", "firsts", "lasts").mapInArrow(_removed, schema), "verified")

    spans = found.select(F.explode("spans").alias("s")).select("s.*")
    compared = spans.groupBy("h", "c").agg(F.count("*").alias("n"), F.min("d").alias("least"), F.max("d").alias("most"))
    doubted = cut(compared.where("n < 2 or least <> most").select("h", "c"), "doubted")
    every = not found.where("odd").isEmpty()
    if not every and doubted.isEmpty():
        return found.select(*out)
    decided = cut(_decided_windows(rows, ends, doubted, every), "decided")
    again = rows.join(decided, ["k1", "k2"]).select("doc_id", "k1", "k2", "text", "windows").mapInArrow(_removed, schema)
    return found.join(decided, ["k1", "k2"], "left_anti").select(*out).unionByName(again.select(*out))
