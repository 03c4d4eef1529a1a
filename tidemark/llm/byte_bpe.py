"""Byte-level BPE by corpus-level merge replay.

The distinct new pieces of a stretch of the corpus (about STRETCH bytes) form
one symbol sequence with links to neighbours.  An inverted index maps each pair of
adjacent symbols, by the rank of its merge, to its positions; a heap gives the pairs
in rank order, each merge is applied at all its positions at once, and only the two
neighbours of a merged place are looked up anew.  Where a merge makes a pair of
lower rank than its own, that piece is done alone in strict order.  Finished pieces
are kept in a bounded table.  No shuffle.

Null texts are empty: no tokens.  Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.common import tidy

KNOWN_PIECES = 250_000
STRETCH = 3_000_000
_SIDE = 1 << 24


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def split_patterns(pattern: str) -> tuple[str, str]:
    """The pattern for ``re`` with its classes spelled out, for ASCII and for any text.

    ``re`` splits several times faster than ``regex``, whose classes are only read here.
    """
    import regex

    def ranges(wanted: str) -> str:
        test, out, start, last = regex.compile(wanted), [], None, None
        for c in range(sys.maxunicode + 2):
            if c <= sys.maxunicode and not 0xD800 <= c < 0xE000 and test.match(chr(c)):
                start, last = (c if start is None else start), c
            elif start is not None:
                out.append(f"\\U{start:08x}-\\U{last:08x}" if start != last else f"\\U{start:08x}")
                start = None
        return "".join(out)

    def spelled(letters: str, numbers: str, spaces: str) -> str:
        out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
        for name, members in ((r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\s", f"[{spaces}]"), (r"\S", f"[^{spaces}]")):
            out = out.replace(name, members)
        if "\\p" in out:
            raise ValueError("the pattern uses a class other than \\p{L} and \\p{N}")
        return out

    return spelled("A-Za-z", "0-9", " \\t-\\r"), spelled(ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\p{White_Space}"))


def splitter(patterns: tuple[str, str]):
    """findall for a pair of split_patterns(); ``re`` keeps the compiled forms between tasks."""
    ascii_only, any_text = (re.compile(p).findall for p in patterns)
    return lambda text: ascii_only(text) if text.isascii() else any_text(text)


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_rank = {rank: token for token, rank in ranks.items()}
        self.symbol = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        found = []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left = ranks.get(token[:i])
                if left is not None and (right := ranks.get(token[i:])) is not None:
                    found.append((left * _SIDE + right, rank))
        found.sort()
        #: every pair of symbols that a merge joins, and its rank
        self.pairs = np.array([k for k, _ in found], dtype=np.int64)
        self.pair_ranks = np.array([r for _, r in found], dtype=np.int64)

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, or -1."""
        key = left * _SIDE + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], -1)

    def encode(self, pieces: Iterable[bytes]) -> list[list[int]]:
        """Token ids of each piece."""
        pieces = list(pieces)
        whole = [self.ranks.get(p) for p in pieces]
        split = [i for i, w in enumerate(whole) if w is None and pieces[i]]
        out: list[list[int]] = [[] if w is None else [w] for w in whole]
        if not split:
            return out
        sizes = np.array([len(pieces[i]) for i in split])
        symbols = self.symbol[np.frombuffer(b"".join([pieces[i] for i in split]), dtype=np.uint8)]
        piece = np.repeat(np.arange(len(split)), sizes)
        n = len(symbols)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(sizes)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        alive, odd = np.ones(n, dtype=bool), np.zeros(len(split), dtype=bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray) -> np.ndarray:
            """Puts the pairs that begin at the places into the index; their ranks."""
            rank = self._rank_of(symbols[places], symbols[after[places]])
            joined = np.flatnonzero(rank >= 0)
            order = joined[np.argsort(rank[joined], kind="stable")]
            ranked = rank[order]
            cuts = np.flatnonzero(np.diff(ranked)) + 1
            for part in np.split(order, cuts) if len(order) else []:
                r = int(rank[part[0]])
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(places[part])
            return rank

        enter(np.flatnonzero(after >= 0))
        while heap:
            rank = heapq.heappop(heap)
            held = index.pop(rank)
            places = np.unique(np.concatenate(held)) if len(held) > 1 else held[0]
            places = places[alive[places] & (after[places] >= 0)]
            places = places[self._rank_of(symbols[places], symbols[after[places]]) == rank]
            if not len(places):
                continue
            # of pairs that overlap in a run, the first, third, ... merge
            linked = np.concatenate([[False], after[places[:-1]] == places[1:]])
            if linked.any():
                step = np.arange(len(places))
                places = places[(step - np.maximum.accumulate(np.where(linked, 0, step))) % 2 == 0]
            right = after[places]
            beyond = after[right]
            symbols[places] = rank
            alive[right] = False
            after[places] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = places[inner]
            left = before[places]
            touched = np.unique(np.concatenate([left[left >= 0], places[inner]]))
            if len(touched):
                made = enter(touched)
                lower = touched[(made >= 0) & (made < rank)]
                odd[piece[lower]] = True
        ids = symbols[alive].tolist()
        bounds = np.concatenate([[0], np.cumsum(np.bincount(piece[alive], minlength=len(split)))]).tolist()
        for j, i in enumerate(split):
            out[i] = ids[bounds[j] : bounds[j + 1]]
        for j in np.flatnonzero(odd):
            out[split[j]] = self.encode_alone(pieces[split[j]])
        return out

    def encode_alone(self, piece: bytes) -> list[int]:
        """One piece by its merges in strict order: for pieces where a merge makes a pair of lower rank."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        heap = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            right = after[at]
            if not parts[at] or right < 0 or self.ranks.get(parts[at] + parts[right]) != rank:
                continue
            parts[at] += parts[right]
            parts[right] = b""
            after[at] = after[right]
            if after[at] >= 0:
                before[after[at]] = at
            for low, high in ((before[at], at), (at, after[at])):
                if low >= 0 and high >= 0 and (made := self.ranks.get(parts[low] + parts[high])) is not None:
                    heapq.heappush(heap, (made, low))
        return [self.ranks[p] for p in parts if p]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.of_rank.__getitem__, ids))


def _stretches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, end) of consecutive texts of about STRETCH bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held >= STRETCH:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _coder(ranks: dict[bytes, int], patterns: tuple[str, str], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, split = MergeReplay(ranks), splitter(patterns)
        name_of = {rank: str(rank) for rank in replay.of_rank}.__getitem__
        text_of: dict[str, str] = {}
        data_of: dict[str, bytes] = {}
        for batch in batches:
            for start, end in _stretches(batch.column("text")):
                split_texts = [split(t) if t else [] for t in batch.column("text").slice(start, end - start).to_pylist()]
                if len(text_of) > KNOWN_PIECES:
                    text_of.clear()
                    data_of.clear()
                fresh = list(set(chain.from_iterable(split_texts)).difference(text_of))
                for piece, ids in zip(fresh, replay.encode([p.encode() for p in fresh]), strict=True):
                    text_of[piece] = " ".join(map(name_of, ids))
                    data_of[piece] = replay.decode(ids)
                n, ids_sha, text_sha, ids_out = [], [], [], []
                for pieces in split_texts:
                    joined = " ".join(map(text_of.__getitem__, pieces))
                    n.append(joined.count(" ") + 1 if joined else 0)
                    ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(b"".join(map(data_of.__getitem__, pieces))).hexdigest())
                    if with_ids:
                        ids_out.append([int(i) for i in joined.split()])
                own = batch.column("doc_id").slice(start, end - start)
                arrays = [own, pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                    names.append("ids")
                del split_texts, pieces, fresh
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        del replay, text_of, data_of
        tidy()

    return run


def encoded(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) per row.

    The rank file is read once on the driver (its size is that of the vocabulary).
    """
    rows = docs.select("doc_id", "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(_coder(read_ranks(ranks_path), split_patterns(pattern), with_ids), schema + (", ids array<int>" if with_ids else ""))
