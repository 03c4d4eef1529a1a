"""Toxicity scoring: a bidirectional gated recurrent network with attention pooling.

Each word is a word embedding plus the mean of the embeddings of its character
pieces (prefixes, suffixes, trigrams); both tables are hashed, so any word has a
vector.  Two GRUs read a window of WINDOW words in both directions, attention pools
their states, and a linear layer gives the window's logit.  Windows overlap by half,
cover the whole text, and a document's score is that of its highest window.

Training is in numpy on a bounded sample of labelled rows (TOXIC and CLEAN rows at
most, drawn by a hash of doc_id from the rows with crc32(doc_id) mod 5 <> 0), on
all windows of each row, STEP_WINDOWS of them at a time.
Labels, lang, source and doc_id are no inputs of a score.  The weights go to the
executors with the function; scoring is one pass without a shuffle.

Null and empty texts are one window of padding and get the score of the bias
alone; without any labelled rows of both classes every score is 0.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, free_name, tidy

WINDOW, STRIDE = 64, 32
WORD_ROWS, CHAR_ROWS, WIDTH, HIDDEN, ATTENTION = 1 << 15, 1 << 15, 8, 8, 8
INPUT = 2 * WIDTH
TOXIC, CLEAN = 1500, 2500
STEP_WINDOWS = 1024
EPOCHS, STEPS = 3, 300
KNOWN_WORDS = 150_000
GROUP = 512
#: Bytes of text that one job of the training sample brings to the driver.
READ_BYTES = 4 << 20

_words = re.compile(r"[^\W_]+").findall


def words_of(text: str | None) -> list[str]:
    return _words((text or "").lower())


def features_of(word: str) -> tuple[int, list[int]]:
    """Row of the word table and rows of the character table: prefixes, suffixes and
    trigrams of the marked UTF-8 form."""
    data = word.encode()
    marked = b"^" + data + b"$"
    pieces = [marked[i : i + 3] for i in range(len(marked) - 2)]
    pieces += [marked[:k] + b"*" for k in range(3, min(len(marked), 9))]
    pieces += [b"*" + marked[-k:] for k in range(3, min(len(marked), 6))]
    return crc32(data) & (WORD_ROWS - 1), [crc32(p) & (CHAR_ROWS - 1) for p in pieces]


class Features:
    """Table rows of many words in flat arrays: word, and char[start[i]:start[i + 1]]."""

    def __init__(self, word: np.ndarray, char: np.ndarray, start: np.ndarray):
        self.word, self.char, self.start = word, char, start

    @classmethod
    def of(cls, words: Iterable[str]) -> Features:
        word, char, start = array("i"), array("i"), array("q", [0])
        for w in words:
            row, pieces = features_of(w)
            word.append(row)
            char.extend(pieces)
            start.append(len(char))
        return cls(np.array(word, dtype=np.int64), np.array(char, dtype=np.int64), np.array(start))

    def take(self, rows: np.ndarray) -> Features:
        sizes = np.diff(self.start)[rows]
        start = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(start[-1]) + np.repeat(self.start[rows] - start[:-1], sizes)
        return Features(self.word[rows], self.char[at], start)


def summed_by(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sums of their rows)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return ranked[first], np.add.reduceat(rows[order], first)


def windows_of(ids: np.ndarray, pad: int) -> np.ndarray:
    """(windows, WINDOW): every word is in a window; the last is padded."""
    n = len(ids)
    count = 1 if n <= WINDOW else -(-(n - WINDOW) // STRIDE) + 1
    room = np.full((count - 1) * STRIDE + WINDOW, pad, dtype=np.int64)
    room[:n] = ids
    return np.lib.stride_tricks.sliding_window_view(room, WINDOW)[::STRIDE]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name; all float32."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"word": normal(WORD_ROWS, WIDTH, scale=0.05), "char": normal(CHAR_ROWS, WIDTH, scale=0.05)}
        for d in "fb":
            self.p[f"x{d}"] = normal(INPUT, 3 * HIDDEN, scale=0.4)
            self.p[f"h{d}"] = normal(HIDDEN, 3 * HIDDEN, scale=0.25)
            self.p[f"c{d}"] = np.zeros(3 * HIDDEN, dtype=np.float32)
        self.p |= {"wa": normal(2 * HIDDEN, ATTENTION, scale=0.4), "va": normal(ATTENTION, scale=0.5), "wo": normal(2 * HIDDEN, scale=0.4), "bo": np.full(1, -1.0, dtype=np.float32)}

    def inputs(self, features: Features) -> np.ndarray:
        """Input vector of each word."""
        if not len(features.word):
            return np.zeros((0, INPUT), dtype=np.float32)
        char = np.add.reduceat(self.p["char"][features.char], features.start[:-1]) / np.diff(features.start)[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][features.word], char], axis=1)

    def projected(self, inputs: np.ndarray) -> list[np.ndarray]:
        """Each direction's input terms by word."""
        return [inputs @ self.p[f"x{d}"] + self.p[f"c{d}"] for d in "fb"]

    def states(self, terms: np.ndarray, u: np.ndarray, steps: Iterable[int], keep: list | None = None, live: np.ndarray | None = None) -> np.ndarray:
        """terms (WINDOW, n, 3 * HIDDEN); padding leaves the state as it is."""
        n = terms.shape[1]
        h = np.zeros((n, HIDDEN), dtype=np.float32)
        out = np.empty((WINDOW, n, HIDDEN), dtype=np.float32)
        for t in steps:
            a = h @ u
            x = terms[t]
            gates = _sigmoid(x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            if live is not None and not live[t].all():
                z = np.where(live[t][:, None], z, np.float32(1))
            candidate = np.tanh(x[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((t, h, z, r, candidate, a[:, 2 * HIDDEN :]))
            h = candidate + z * (h - candidate)
            out[t] = h
        return out

    def forward(self, terms: list[np.ndarray], live: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; live (WINDOW, n) marks the words."""
        kept: list[list | None] = [None, None] if keep is None else [[], []]
        padded = None if live.all() else live
        forth = self.states(terms[0], self.p["hf"], range(WINDOW), kept[0], padded)
        back = self.states(terms[1], self.p["hb"], range(WINDOW - 1, -1, -1), kept[1], padded)
        both = np.concatenate([forth, back], axis=2)
        seen = np.tanh(both @ self.p["wa"])
        score = np.where(live, seen @ self.p["va"], np.float32(-1e9))
        weight = np.exp(score - score.max(axis=0)) * live
        weight /= np.maximum(weight.sum(axis=0), np.float32(1e-9))
        pooled = (weight[:, :, None] * both).sum(axis=0)
        if keep is not None:
            keep.update(both=both, seen=seen, weight=weight, pooled=pooled, kept=kept)
        return pooled @ self.p["wo"] + self.p["bo"][0]

    def gradients(self, keep: dict, slope: np.ndarray) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
        """Gradients of the weights and of both directions' input terms, for the logits' slope."""
        p, both, seen, weight, pooled = self.p, keep["both"], keep["seen"], keep["weight"], keep["pooled"]
        g = {"wo": pooled.T @ slope, "bo": np.array([slope.sum()], dtype=np.float32)}
        d_pooled = slope[:, None] * p["wo"]
        d_both = weight[:, :, None] * d_pooled
        d_weight = (both * d_pooled).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["va"] = np.tensordot(d_score, seen, axes=([0, 1], [0, 1]))
        d_seen = d_score[:, :, None] * p["va"] * (1 - seen * seen)
        g["wa"] = np.tensordot(both, d_seen, axes=([0, 1], [0, 1]))
        d_both = d_both + d_seen @ p["wa"].T
        d_terms = []
        for i, d in enumerate("fb"):
            u, at = p[f"h{d}"], slice(i * HIDDEN, (i + 1) * HIDDEN)
            d_u, carry = np.zeros_like(u), 0.0
            d_x = np.empty((WINDOW, both.shape[1], 3 * HIDDEN), dtype=np.float32)
            for t, h, z, r, candidate, inner in reversed(keep["kept"][i]):
                d_h = d_both[t, :, at] + carry
                d_candidate = d_h * (1 - z) * (1 - candidate * candidate)
                d_a = np.concatenate([d_h * (h - candidate) * z * (1 - z), d_candidate * inner * r * (1 - r), d_candidate * r], axis=1)
                d_x[t] = d_a
                d_x[t, :, 2 * HIDDEN :] = d_candidate
                d_u += h.T @ d_a
                carry = d_h * z + d_a @ u.T
            g[f"h{d}"] = d_u
            d_terms.append(d_x)
        return g, d_terms


def trained(rows: Iterable[tuple[str | None, int]], seed: int = 5) -> Network | None:
    """A network fitted to whole documents (text, label): the highest window of a document carries its label."""
    place: dict[str, int] = {}
    documents, labels = [], []
    for text, label in rows:
        documents.append(np.array([place.setdefault(w, len(place)) for w in words_of(text)], dtype=np.int32))
        labels.append(label)
    y = np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return None
    net, rng = Network(seed), np.random.default_rng(seed)
    features = Features.of(place)
    pad = len(place)
    del place
    _start_from_odds(net, documents, features, y)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items() if k not in ("word", "char")}
    squares = {k: np.full(len(net.p[k]), 1e-4, dtype=np.float32) for k in ("word", "char")}
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    step = 0
    # small samples are read more often
    for epoch in range(max(EPOCHS, min(4 * EPOCHS, STEPS * 64 // len(documents)))):
        order = rng.permutation(len(documents))
        for at in range(0, len(order), 64):
            chosen, parts, owner = order[at : at + 64], [], []
            for j, i in enumerate(chosen):
                w = windows_of(documents[i], pad)
                parts.append(w)
                owner += [j] * len(w)
            index, own = np.concatenate(parts).T, np.array(owner)
            live = index != pad
            used, local = np.unique(index, return_inverse=True)
            local = local.reshape(index.shape)
            some = features.take(used[used != pad])
            inputs = net.inputs(some)
            if used[-1] == pad:
                inputs = np.concatenate([inputs, np.zeros((1, INPUT), dtype=np.float32)])
            projected = net.projected(inputs)
            spans = [slice(lo, lo + STEP_WINDOWS) for lo in range(0, len(own), STEP_WINDOWS)]
            keep: dict = {}

            def forward(span: slice) -> np.ndarray:
                keep.clear()
                return net.forward([x[local[:, span]] for x in projected], live[:, span], keep)

            logit = np.concatenate([forward(span) for span in spans])
            # share of each window in its document: a soft maximum, harder with each epoch
            sharp = 1.0 + min(epoch, EPOCHS)
            highest = np.full(len(chosen), -np.inf)
            np.maximum.at(highest, own, logit)
            share = np.exp(sharp * (logit - highest[own]))
            total = np.bincount(own, share, len(chosen))
            share = (share / total[own]).astype(np.float32)
            value = np.bincount(own, share * logit, len(chosen))
            slope = (balance[chosen] * (1 / (1 + np.exp(-value)) - y[chosen]) / len(chosen)).astype(np.float32)
            grads: dict[str, np.ndarray] = {}
            d_inputs = np.zeros_like(inputs)
            for span in spans:
                if len(spans) > 1:
                    forward(span)
                some_grads, d_terms = net.gradients(keep, slope[own[span]] * share[span])
                for d, d_x in zip("fb", d_terms, strict=True):
                    d_x *= live[:, span, None]
                    words, by_word = summed_by(local[:, span].ravel(), d_x.reshape(-1, 3 * HIDDEN))
                    some_grads[f"x{d}"] = inputs[words].T @ by_word
                    some_grads[f"c{d}"] = by_word.sum(axis=0)
                    d_inputs[words] += by_word @ net.p[f"x{d}"].T
                grads = {k: grads[k] + g if grads else g for k, g in some_grads.items()}
            step += 1
            _adam(net, grads, moments, step)
            real = len(some.word)
            if real:
                sizes = np.diff(some.start)
                _adagrad(net.p["word"], squares["word"], some.word, d_inputs[:real, :WIDTH])
                _adagrad(net.p["char"], squares["char"], some.char, np.repeat(d_inputs[:real, WIDTH:] / sizes[:, None], sizes, axis=0))
    return net


def _start_from_odds(net: Network, documents: list[np.ndarray], features: Features, y: np.ndarray) -> None:
    """The first value of each embedding starts as the shrunk log odds of its documents being toxic."""
    for name in ("word", "char"):
        counts = np.zeros((2, len(net.p[name])), dtype=np.float64)
        for ids, label in zip(documents, y, strict=True):
            some = features.take(np.unique(ids))
            counts[int(label), np.unique(getattr(some, name))] += 1
        clean, toxic = (1 - y).sum(), y.sum()
        odds = np.log((counts[1] + 1) / (toxic + 2)) - np.log((counts[0] + 1) / (clean + 2))
        total = counts.sum(axis=0)
        net.p[name][:, 0] = np.clip(odds, -3, 3) * total / (total + 8)


def _adam(net: Network, grads: dict[str, np.ndarray], moments: dict, step: int, rate: float = 0.01) -> None:
    norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
    scale = min(1.0, 1.0 / max(norm, 1e-9))
    for k, g in grads.items():
        m, v = moments[k]
        g = g * scale
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


def _adagrad(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, grads: np.ndarray, rate: float = 0.03) -> None:
    unique, total = summed_by(rows, grads)
    squares[unique] += (total * total).mean(axis=1)
    weights[unique] -= rate * total / np.sqrt(squares[unique])[:, None]


class Scorer:
    """Scores texts by batches; word terms are kept in a bounded table."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        pad = np.zeros((1, 3 * HIDDEN), dtype=np.float32)
        pad[:, :HIDDEN] = 30  # the update gate stays shut: padding leaves the state
        self.tables, self.filled = [np.repeat(pad, 1024, axis=0) for _ in "fb"], 1

    def _learn(self, fresh: list[str]) -> None:
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            made = self.net.projected(self.net.inputs(Features.of(part)))
            end = self.filled + len(part)
            for d in (0, 1):
                if end > len(self.tables[d]):
                    more = np.zeros((max(end, 2 * len(self.tables[d])), 3 * HIDDEN), dtype=np.float32)
                    more[: self.filled] = self.tables[d][: self.filled]
                    self.tables[d] = more
                self.tables[d][self.filled : end] = made[d]
            self.place.update(zip(part, range(self.filled, end), strict=True))
            self.filled = end

    def scores(self, texts: list[str | None]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        if len(self.place) > KNOWN_WORDS:
            self.clear()
        self._learn(list({w for words in split for w in words if w not in self.place}))
        find = self.place.__getitem__
        best = np.full(len(texts), -np.inf)
        held, owner = [], []
        for i, words in enumerate(split):
            found = windows_of(np.fromiter(map(find, words), dtype=np.int64, count=len(words)), 0)
            held.append(found)
            owner.append(np.full(len(found), i))
        windows, own = np.concatenate(held), np.concatenate(owner)
        for at in range(0, len(windows), GROUP):
            index = np.ascontiguousarray(windows[at : at + GROUP].T)
            logit = self.net.forward([t[index] for t in self.tables], index != 0)
            np.maximum.at(best, own[at : at + GROUP], logit)
        return 1 / (1 + np.exp(-best))


def clean(docs: DataFrame, labels: DataFrame, below: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``below``, with all their columns, whatever their names."""
    name = free_name(docs.columns, "score")
    return scored(docs, labels, docs.columns, name).where(F.col(name) < below).select(*docs.columns)


def _scoring(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None if net is None else Scorer(net)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column("_text").to_pylist()
                score = np.zeros(len(texts)) if scorer is None else scorer.scores(texts)
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score, pa.float64())], names=[*part.schema.names[:-1], "score"])
        del scorer
        tidy()

    return run


def fitted(docs: DataFrame, labels: DataFrame) -> Network | None:
    """The network trained on a bounded sample of the labelled rows (TOXIC + CLEAN at most)."""
    learn = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", "toxic").distinct()
    picked = [learn.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for label, most in ((1, TOXIC), (0, CLEAN))]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # TOXIC + CLEAN rows of two numbers at most
    rows = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    found = trained(_in_order(cut(rows, "sample")))
    tidy()
    return found


def _in_order(rows: DataFrame) -> Iterator[tuple[str | None, int]]:
    """(text, toxic) of the sample by doc_id.  A job reads what READ_BYTES hold (or one text), however
    the rows are partitioned."""
    sizes = sorted((r["doc_id"], r["size"]) for r in rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).collect())
    at = 0
    while at < len(sizes):
        end, held = at + 1, sizes[at][1]
        while end < len(sizes) and held + sizes[end][1] <= READ_BYTES:
            held += sizes[end][1]
            end += 1
        part = rows.where(F.col("doc_id").between(sizes[at][0], sizes[end - 1][0])).collect()
        yield from ((r["text"], int(r["toxic"])) for r in sorted(part, key=lambda r: r["doc_id"]))
        at = end


def scored(docs: DataFrame, labels: DataFrame, carry: list[str], name: str = "score") -> DataFrame:
    """``carry`` columns and, under ``name`` (none of theirs), the score of every row."""
    rows = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.col("text").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    found = rows.mapInArrow(_scoring(fitted(docs, labels)), f"{kinds}, score double" if kinds else "score double")
    return found.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], F.col("score").alias(name))
