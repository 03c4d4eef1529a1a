"""Main text of HTML pages, with a suffix array per host for what markup leaves open.

Markup decides where it can: navigation, footers, forms, scripts and the like, and
elements whose class, id or role says so, are chrome; what is inside an article (or
else a main) element is the text.  Where a page has neither, its blocks are open.

The token streams of chrome and open blocks of all pages of a host are joined, and
sorted by suffix in blocks of pages.  Each run of suffixes that agree in their first
RUN tokens is one row (host, run, number of pages); summing these rows over all
blocks merges the suffix arrays, so a host with a third of all pages is no hot
spot.  A block of fewer than RUN tokens is a run of its own, taken whole.  Runs found
on at least MIN_PAGES pages of a host are boilerplate, whatever the host's size; open
blocks lose the tokens that such runs cover and keep their unique runs.  A page of
which nothing would be left is a copy, not boilerplate: it stays.
Text inside article or main is not cut by runs, since whole copied articles would go.

A null html or url is empty; pages without a host form a host of their own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.words import mix, word_hashes

RUN, MIN_PAGES = 6, 2
PAGE_BLOCK = 256

# HTML elements by what they mean here.
RAW = frozenset("script style title noscript iframe textarea xmp noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav footer aside form button select dialog menu head svg canvas object audio video datalist".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption html body".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus reply replies share sharing social related recommended "
    "newsletter subscribe subscription popup modal overlay widget toolbar pagination pager login signin signup search hidden".split()
)
ARTICLE_WORDS = frozenset("ad ads advert adverts advertisement sponsored promo related comment comments reply replies".split())
LAYOUT_PREFIXES = frozenset("has no with without".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())

_token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_attribute = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_part = re.compile(r"[a-z]+")


def _is_chrome(name: str, attributes: str, in_main: bool) -> bool:
    if name in CHROME or (name == "header" and not in_main):
        return True
    if not attributes.strip() or name in ("html", "body", "main"):
        return False
    telling = ARTICLE_WORDS if name == "article" else CHROME_WORDS
    for key, a, b, c in _attribute.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id"):
            for words in map(_part.findall, value.split()):
                if words and words[0] in LAYOUT_PREFIXES:
                    continue  # has-sidebar and the like speak of the page, not of the element
                if not telling.isdisjoint(words) or ("header" in words and not in_main and name != "article"):
                    return True
        elif key == "role" and value in CHROME_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks_of(page: str) -> list[tuple[str, str]]:
    """(kind, text) of the page's blocks in order; kind is chrome, article, main or open."""
    out: list[tuple[str, str]] = []
    stack: list[str] = []
    kinds: list[str] = []
    parts: list[str] = []
    at = 0
    kind = "open"

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((kind, text))

    def close(depth: int) -> None:
        nonlocal kind
        flush()
        del stack[depth:]
        del kinds[depth:]
        kind = kinds[-1] if kinds else "open"

    while True:
        found = _token.search(page, at)
        if found is None:
            parts.append(page[at:])
            break
        if found.start() > at:
            parts.append(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if name == "br":
                parts.append(" ")
            elif name in stack:
                depth = len(stack) - 1 - stack[::-1].index(name)
                if any(s in BLOCK or kinds[depth + i] != kind for i, s in enumerate(stack[depth:])):
                    close(depth)
                else:
                    del stack[depth:]
                    del kinds[depth:]
                    kind = kinds[-1] if kinds else "open"
            elif name in BLOCK:
                flush()
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = len(page) if end is None else page.find(">", end.end()) + 1 or len(page)
            continue
        if name in CLOSES_P and "p" in stack and not {"button", "table"} & set(stack[len(stack) - stack[::-1].index("p") :]):
            close(len(stack) - 1 - stack[::-1].index("p"))
        elif name in ("li", "dd", "dt", "option", "tr", "td", "th") and stack and stack[-1] == name:
            close(len(stack) - 1)
        if name in BLOCK:
            flush()
        if name in VOID:
            if name == "br":
                parts.append(" ")
            continue
        if found[3].endswith("/") and name not in BLOCK:
            continue
        inner = kind
        if kind != "chrome":
            if _is_chrome(name, found[3], kind in ("article", "main")):
                inner = "chrome"
            elif name == "article":
                inner = "article"
            elif name == "main" and kind == "open":
                inner = "main"
        if inner != kind:
            flush()
        stack.append(name)
        kinds.append(inner)
        kind = inner
    flush()
    return out


def decided(blocks: list[tuple[str, str]]) -> tuple[list[str] | None, list[str], list[str]]:
    """(the text's blocks or None, open blocks, chrome blocks)."""
    for kind in ("article", "main"):
        text = [t for k, t in blocks if k == kind]
        if text:
            return text, [], [t for k, t in blocks if k != kind]
    return None, [t for k, t in blocks if k == "open"], [t for k, t in blocks if k == "chrome"]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def token_hashes(text: str) -> np.ndarray:
    return word_hashes(np.frombuffer(text.encode(), dtype=np.uint8), fold=False)[0]


def suffix_runs(tokens: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of the suffix array that agree in RUN tokens: (hash of the run's tokens, pages in it).

    ``tokens`` holds the streams one after another with zeros between blocks; the
    suffixes are sorted by prefix doubling up to RUN tokens.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < RUN:
        step = min(width, RUN - width)
        following = np.zeros(n, dtype=np.int64)
        following[: max(0, n - step)] = rank[step:] + 1
        rank = np.unique(rank * (n + 2) + following, return_inverse=True)[1].astype(np.int64)
        width += step
    order = np.lexsort((page, rank))  # the suffix array, pages in order inside equal prefixes
    grams = gram_hashes(tokens)
    full = order[grams[order] != 0]
    if not len(full):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    new = np.concatenate([[True], rank[full][1:] != rank[full][:-1]])
    other = new | np.concatenate([[True], page[full][1:] != page[full][:-1]])
    first = np.flatnonzero(new)
    return grams[full[first]], np.add.reduceat(other.astype(np.int64), first)


def gram_hashes(tokens: np.ndarray) -> np.ndarray:
    """Hash of the RUN tokens from each position; 0 where they cross the end of a block."""
    n = len(tokens)
    out, whole = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for i in range(RUN):
        part = np.zeros(n, dtype=np.uint64)
        part[: max(0, n - i)] = tokens[i:]
        out = out * np.uint64(0x9E3779B97F4A7C15) + part
        whole &= part != 0
    return np.where(whole, mix(out) | np.uint64(1), np.uint64(0))


def short_blocks(stream: np.ndarray) -> np.ndarray:
    """Distinct hashes of the blocks of fewer than RUN tokens, each taken whole, in a page's stream."""
    stops = np.flatnonzero(stream == 0)
    starts = np.concatenate([[0], stops[:-1] + 1]).astype(np.int64)
    sizes = stops - starts
    short = (sizes > 0) & (sizes < RUN)
    starts, sizes = starts[short], sizes[short]
    out = sizes.astype(np.uint64)
    for i in range(RUN - 1):
        has = sizes > i
        out[has] = mix(out[has]) * np.uint64(0x9E3779B97F4A7C15) + stream[starts[has] + i]
    return np.unique(mix(out) | np.uint64(1))


def _stream(blocks: list[str]) -> np.ndarray:
    stop = np.zeros(1, dtype=np.uint64)
    return np.concatenate([x for b in blocks for x in (token_hashes(b), stop)] or [stop])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, gram, pages, page): runs of each block of pages; page is set for open positions."""
    for batch in batches:
        for start in range(0, batch.num_rows, PAGE_BLOCK):
            part = batch.slice(start, PAGE_BLOCK)
            by_host: dict[str, list[tuple[int, np.ndarray]]] = {}
            hosts, grams, pages, rows = [], [], [], []
            for url, page, row in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), part.column("_row").to_pylist(), strict=True):
                text, open_, chrome = decided(blocks_of(page or ""))
                host = host_of(url)
                by_host.setdefault(host, []).append((row, _stream(open_ + chrome)))
                if text is None and open_:
                    own = _stream(open_)
                    found = np.unique(np.concatenate([gram_hashes(own), short_blocks(own)]))
                    found = found[found != 0]
                    hosts += [host] * len(found)
                    grams.append(found)
                    pages.append(np.zeros(len(found), dtype=np.int64))
                    rows += [row] * len(found)
            for host, streams in by_host.items():
                tokens = np.concatenate([s for _, s in streams])
                owner = np.repeat(np.arange(len(streams)), [len(s) for _, s in streams])
                whole, on = np.unique(np.concatenate([short_blocks(s) for _, s in streams]), return_counts=True)
                for found, count in (suffix_runs(tokens, owner), (whole, on)):
                    hosts += [host] * len(found)
                    grams.append(found)
                    pages.append(count)
                    rows += [None] * len(found)
            none = np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(np.concatenate(grams or [none]).view(np.int64)), pa.array(np.concatenate(pages or [none.astype(np.int64)])), pa.array(rows, pa.int64())],
                names=["host", "gram", "pages", "page"],
            )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, PAGE_BLOCK):
            part = batch.slice(start, PAGE_BLOCK)
            texts, by_markup = [], []
            hits = part.column("_hits").to_pylist() if "_hits" in part.schema.names else [None] * part.num_rows
            for page, covered in zip(part.column("html").to_pylist(), hits, strict=True):
                text, open_, _ = decided(blocks_of(page or ""))
                by_markup.append(text is not None)
                texts.append("\n\n".join(text if text is not None else uncovered(open_, covered)))
            sizes = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(by_markup)], names=["page_id", "url", "text", "n_chars", "by_markup"])


def uncovered(blocks: list[str], covered: list[int] | None) -> list[str]:
    """Blocks without the tokens that boilerplate runs cover."""
    if not covered:
        return blocks
    gone = np.array(covered, dtype=np.int64).view(np.uint64)
    kept = []
    for block in blocks:
        words, tokens = block.encode().split(), token_hashes(block)
        if len(tokens) < RUN:
            if not np.isin(short_blocks(_stream([block])), gone).any():
                kept.append(block)
            continue
        hit = np.flatnonzero(np.isin(gram_hashes(tokens), gone))
        cover = np.zeros(len(words) + RUN, dtype=bool)
        for i in range(RUN):
            cover[hit + i] = True
        text = b" ".join(w for w, c in zip(words, cover, strict=False) if not c).decode()
        if text:
            kept.append(text)
    return kept or blocks


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, by_markup; one row per input row."""
    rows = pages.select("page_id", "url", "html", F.monotonically_increasing_id().alias("_row"))
    runs = cut(rows.mapInArrow(_runs, "host string, gram bigint, pages bigint, page bigint").groupBy("host", "gram", "page").agg(F.sum("pages").alias("pages")), "runs")
    repeated = runs.where(f"page is null and pages >= {MIN_PAGES}").select("host", "gram")
    asked = runs.where("page is not null").select("host", "gram", "page")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    if not asked.isEmpty():
        hits = cut(asked.join(repeated, ["host", "gram"]).groupBy("page").agg(F.collect_set("gram").alias("_hits")), "hits")
        rows = rows.join(hits.withColumnRenamed("page", "_row"), "_row", "left")
    return rows.mapInArrow(_texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint, by_markup boolean")
