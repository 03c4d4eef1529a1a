"""Extraction, archives, tokens, scores, shards and mixes, with awkward rows."""

import collections
import gzip
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import byte_bpe, main_text, ring_sharding, temperature_mixing, toxicity, warc

tokenizers = pytest.importorskip("public_tokenizers")
DOC = "doc_id bigint, text string, lang string, source string, n_chars string, arc string, tokens string, s string, label string, rank string, plan string"
PAGE = "page_id bigint, url string, html string, row string, digest string, host string"


def stored(spark, tmp_path, rows, schema, parts=3):
    path = str(tmp_path / "rows")
    width = schema.count(",") + 1
    spark.createDataFrame([(*r, *["x"] * (width - len(r))) for r in rows], schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


# tokens


@pytest.fixture(scope="module")
def own():
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    return path, ranks, tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_kind_of_character(own):
    _, ranks, library = own
    replay, split = byte_bpe.MergeReplay(ranks), byte_bpe.splitter(byte_bpe.split_patterns(tokenizers.PATTERN))
    texts = [f"a{c}b {c}{c}1 {c} \n{c}" for c in map(chr, [*range(0x500), *range(0x500, 0xD800, 61), *range(0xE000, 0x110000, 997)])]
    for text in texts:
        pieces = split(text)
        assert "".join(pieces) == text
        ids = [i for x in replay.encode(p.encode() for p in pieces) for i in x]
        assert ids == library.encode_ordinary(text)


def test_replay_in_a_crowd_and_alone(own):
    _, ranks, library = own
    rng = random.Random(2)
    pieces = {"".join(rng.choice("abehrstéü ") for _ in range(rng.randrange(1, 14))) for _ in range(3000)} | {"a" * n for n in range(1, 90)} | {"é" * 50, " " * 70, "\x00" * 9}
    pieces = sorted(pieces)
    replay = byte_bpe.MergeReplay(ranks)
    for piece, ids in zip(pieces, replay.encode(p.encode() for p in pieces), strict=True):
        assert ids == library._core_bpe.encode_single_piece(piece.encode()) == (replay.encode_alone(piece.encode()) if piece.encode() not in ranks else ids)
        assert replay.decode(ids) == piece.encode()


def test_merges_that_make_lower_ranks():
    """A vocabulary in which merging makes a pair of lower rank than the merge itself."""
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"bc": 300, b"ab": 310, b"bca": 257, b"cab": 299, b"abca": 258, b"aa": 320}
    library = tiktoken.Encoding("low", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    pieces = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 20))) for _ in range(500)]
    replay = byte_bpe.MergeReplay(ranks)
    for piece, ids in zip(pieces, replay.encode(p.encode() for p in pieces), strict=True):
        assert ids == library.encode_ordinary(piece)


def test_encoded_rows(spark, tmp_path, own):
    path, _, library = own
    texts = [(1, "Hello, world's end.\n\n  é"), (2, None), (3, ""), (1, "Hello, world's end.\n\n  é"), (None, "<|endoftext|>"), (4, "x" * 30_000), (5, " " * 5000 + "1²½ 漢字 😀\x1c  "), (6, "the idea " * 20_000)]
    docs = stored(spark, tmp_path, texts, DOC)
    found = byte_bpe.encoded(docs, path, tokenizers.PATTERN, with_ids=True).collect()
    assert len(found) == len(texts)
    for r in found:
        text = dict(texts)[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert (r["ids"], r["n_tokens"]) == (ids, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.encoded(docs.limit(0), path, tokenizers.PATTERN).collect() == []


# main text

PAGES = [
    ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li>Menu<li>More</ul></nav><!-- x <p>no</p> -->"
     "<div class='top-ad'>Buy</div><article><h1>A &amp; B</h1><p><b>one\n two<br>three<p>four &lt;x&gt; &copy</p><aside>side</aside><form>f<input></form>"
     "<div id=comments><p>reader</p></div><div class=\"loading\">kept</div></article><footer>foot</footer></body></html>", "A & B\n\none two three\n\nfour <x> ©\n\nkept"),
    ("<main><header>site</header><p>x</p></main><p>outside</p>", "site\n\nx"),
    ("<body><header>site</header><p>x</p><div role=navigation>nav</div><div hidden>no</div><div style='display: none'>no</div><p>y&nbsp; z</p></body>", "x\n\ny z"),
    (None, ""), ("", ""), ("plain text", "plain text"), ("a < b", "a < b"), ("<p>unclosed <b>bold <i>it", "unclosed bold it"), ("<script>never closed <p>x</p>", ""),
    ("<article><p>x</p><article class=comment><p>c</p></article></article>", "x"), ("<article class='post has-sidebar'><div class=no-ads>x</div></article>", "x"), ("<table><tr><td>1<td>2</tr></table>", "1\n\n2"), ("<p>" + "w " * 50_000 + "</p>", " ".join(["w"] * 50_000)),
    ("<nav>open nav <p>x", ""), ("</p></div>stray", "stray"), ("<p a='>'>q</p><br/><img src=x>", "q"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_blocks(page, text):
    kept, open_, _ = main_text.decided(main_text.blocks_of(page or ""))
    assert "\n\n".join(open_ if kept is None else kept) == text


def test_boilerplate_of_a_host_by_suffix_array(spark, tmp_path):
    rng = random.Random(1)
    shared = "Read our terms of use before you go on please"
    pages, want = [], {}
    for i in range(60):
        own = " ".join(f"w{rng.randrange(10_000)}" for _ in range(20))
        host = "a.example" if i < 40 else f"h{i}.example"
        pages.append((i, f"http://{host}/{i}", f"<div><p>{own}</p><p>{shared}</p><p>tail{i} {shared}</p></div>"))
        want[i] = f"{own}\n\ntail{i}" if i < 40 else f"{own}\n\n{shared}\n\ntail{i} {shared}"
    copy = "<p>all of this page is found on the other page too</p>"
    pages += [(100, "http://c.example/1", copy), (101, "http://c.example/2", copy), (102, None, "<p>x</p>"), (None, "::bad::", None), (103, "http://a.example/z", "")]
    found = main_text.main_texts(stored(spark, tmp_path, pages, PAGE)).collect()
    assert len(found) == len(pages)
    got = {r["page_id"]: r["text"] for r in found}
    assert {i: got[i] for i in want} == want
    assert got[100] == got[101] == "all of this page is found on the other page too"
    assert (got[102], got[None], got[103]) == ("x", "", "")
    assert all(r["n_chars"] == len(r["text"]) for r in found)


def test_main_text_of_nothing(spark, tmp_path):
    assert main_text.main_texts(stored(spark, tmp_path, [], PAGE)).collect() == []


def test_suffix_runs_by_brute_force():
    rng = np.random.default_rng(5)
    tokens = rng.integers(0, 3, 400).astype(np.uint64)
    page = np.sort(rng.integers(0, 6, 400))
    tokens[np.flatnonzero(np.diff(page))] = 0
    grams, pages = main_text.suffix_runs(tokens, page)
    seen = collections.defaultdict(set)
    for i in range(400 - main_text.RUN + 1):
        g = tuple(tokens[i : i + main_text.RUN])
        if 0 not in g:
            seen[g].add(page[i])
    assert sorted(pages) == sorted(len(s) for s in seen.values()) and len(set(grams)) == len(seen)


# archives


def test_archives_round_trip(spark, tmp_path):
    long, tricky = "<p>" + "é" * 200_000, "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9
    pages = [(5, "http://a/", "q" * 100), (3, "http://b/", "q" * 100), (9, None, "q" * 100), (1, "u", "q" * 99), (2, "u", "q" * 99), (4, "a\r\nb", None), (6, "u", ""), (7, "u", long), (8, "u", long), (10, "u", tricky), (3, "http://b/", "q" * 100), (None, "u", "n" * 200), (None, "u", tricky)]
    path = str(tmp_path / "archive")
    warc.write_archives(stored(spark, tmp_path, pages, PAGE), path)
    records = warc.read_records(spark, path)
    assert records.groupBy("record_type").count().where("record_type in ('request', 'metadata')").agg({"count": "sum"}).first()[0] == 2 * len(pages)
    captures = warc.assembled(records)
    assert captures.count() == len(pages) and captures.where("request is null or metadata is null or response is null").isEmpty()
    found = collections.Counter(tuple(r) for r in warc.page_captures(captures).drop("capture_id").collect())
    want, first = collections.Counter(), {}
    for i, _, h in sorted(pages, key=lambda p: (p[0] is None, p[0])):
        data = (h or "").encode()
        original = first.setdefault(h, (i, len(first))) if len(data) >= 100 else None
        again = original is not None and original[0] is not None and (h, "seen") in first
        first[h, "seen"] = True
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", original[0] if again else None] += 1
    assert found == want


def test_archives_keep_the_ids_type(spark, tmp_path):
    pages = spark.createDataFrame([("a-1", "u", "q" * 200), ("a-2", "u", "q" * 200), (None, "u", "")], "page_id string, url string, html string")
    warc.write_archives(pages, str(tmp_path / "archive"))
    found = warc.page_captures(warc.assembled(warc.read_records(spark, str(tmp_path / "archive"))), "string").collect()
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in found), key=str) == [("a-1", "response", None), ("a-2", "revisit", "a-1"), (None, "response", None)]


def test_archives_of_nothing(spark, tmp_path):
    warc.write_archives(stored(spark, tmp_path, [], PAGE), str(tmp_path / "archive"))
    assert warc.page_captures(warc.assembled(warc.read_records(spark, str(tmp_path / "archive")))).collect() == []


def test_reading_pieces_and_members(spark, tmp_path):
    """Records in pieces of any size; gzipped files of one member, of many, and plain ones."""
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nContent-Type: application/warc-fields\r\nContent-Length: 6\r\n\r\nk: v\r\n\r\n\r\n"
    whole = record * 3
    for step in (1, 7, 10_000):
        found = list(warc.records_of(whole[i : i + step] for i in range(0, len(whole), step)))
        assert [b for _, b in found] == [b"k: v\r\n"] * 3
    with pytest.raises(ValueError, match="inside"):
        list(warc.records_of(iter([record[:-9]])))
    for i, (data, end) in enumerate(((whole, ""), (gzip.compress(record) * 3, ".gz"), (gzip.compress(whole), ".gz"))):
        (tmp_path / f"part-{i}.warc{end}").write_bytes(data)
    assert [r["fields"] for r in warc.read_records(spark, str(tmp_path)).collect()] == [{"k": "v"}] * 9


def test_blocks_full_of_separators(spark, tmp_path):
    """Line breaks of every kind, bytes that are no UTF-8 and a block of 20 MB come back as they were."""
    rng = random.Random(5)
    blocks = [b"".join(rng.choice((b"\r", b"\n", b"\r\n\r\n", b"x", b"\xff")) for _ in range(rng.randrange(200))) for _ in range(300)]
    blocks += [b"", b"\r\n\r\n", b"\r\n\r\n" * 5, b"\r\n\r" * 5_000_000]
    heads = [f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{i}>\r\nContent-Type: x\r\nContent-Length: {len(b)}\r\n\r\n".encode() for i, b in enumerate(blocks)]
    (tmp_path / "part-0.gz").write_bytes(gzip.compress(b"".join(h + b + b"\r\n\r\n" for h, b in zip(heads, blocks, strict=True))))
    found = {r["record_id"]: (r["payload_bytes"], r["payload_digest"]) for r in warc.read_records(spark, str(tmp_path)).collect()}
    assert found == {f"<{i}>": (len(b), hashlib.sha256(b).hexdigest()) for i, b in enumerate(blocks)}


def test_assembly_of_incomplete_captures(spark):
    rows = [("<1>", "response", "u", None, None, "t", 1, "d", None), ("<2>", "request", "u", "<1>", None, "t", 1, "d", None), ("<3>", "metadata", "u", "<9>", None, "t", 1, "d", {"page_id": "4"}), ("<4>", "warcinfo", None, None, None, "t", 1, "d", None)]
    found = {r["capture_id"]: r for r in warc.assembled(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert found["<1>"]["request"]["record_id"] == "<2>" and found["<1>"]["metadata"] is None
    assert found["<9>"]["response"] is None and found["<9>"]["metadata"]["record_id"] == "<3>"
    assert found["<4>"]["response"] is None


# scores


def test_gradients():
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    terms = [rng.standard_normal((toxicity.WINDOW, 3, 3 * toxicity.HIDDEN)) for _ in "fb"]
    live = np.ones((toxicity.WINDOW, 3), dtype=bool)
    live[50:, 1] = False

    def logits():
        keep = {}
        return net.forward(terms, live, keep), keep

    _, keep = logits()
    slope = np.array([0.3, -1.0, 0.7])
    grads, d_terms = net.gradients(keep, slope)
    for name in ("hf", "hb", "wa", "va", "wo", "bo"):
        at = tuple(rng.integers(0, s) for s in net.p[name].shape)
        old, step = net.p[name][at], 1e-4
        net.p[name][at] = old + step
        up = slope @ logits()[0]
        net.p[name][at] = old - step
        down = slope @ logits()[0]
        net.p[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=1e-4), name
    terms[0][5, 0, 3] += 1e-4
    up = slope @ logits()[0]
    terms[0][5, 0, 3] -= 2e-4
    assert d_terms[0][5, 0, 3] == pytest.approx((up - slope @ logits()[0]) / 2e-4, rel=2e-2, abs=1e-4)


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 96, 97, 1000):
        w = toxicity.windows_of(np.arange(n), -1)
        assert w.shape[1] == toxicity.WINDOW and set(w.ravel()) - {-1} == set(range(n))
        if n > 64:
            assert (np.diff(w[:, 0]) == toxicity.STRIDE).all()


def test_scores_on_held_out_rows(spark, tmp_path):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(700):
        w = [f"w{rng.randrange(800)}" for _ in range(rng.randrange(5, 250))]
        bad = rng.random() < 0.3
        for _ in range(4 if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(["vile", "nasty", f"scurrf{rng.randrange(999)}"])
        texts.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    texts += [(10_000, None), (10_001, ""), (10_002, "..."), (None, "w1 w2"), (10_003, "w5 " * 5000 + "vile nasty vile " + "w7 " * 5000), (3, texts[3][1])]
    docs = stored(spark, tmp_path, texts, DOC)
    held = spark.createDataFrame([*labels, (10_000, 1), (None, 1), (5, None)], "doc_id bigint, toxic int")
    found = toxicity.scored(docs, held, ["doc_id", "s"]).collect()
    assert len(found) == len(texts) and all(0 <= r["score"] <= 1 for r in found)
    score = {r["doc_id"]: r["score"] for r in found}
    test = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((score[i] >= 0.5) == dict(labels)[i] for i in test)
    assert right / len(test) > 0.9
    assert score[10_000] == score[10_001] == score[10_002]
    assert score[10_003] > 0.5  # a long text is read to its middle and end
    # without labels of both classes there is nothing to learn
    assert {r["score"] for r in toxicity.scored(docs, held.where("toxic = 0"), ["doc_id"]).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), held, ["doc_id"]).collect() == []


# shards


def test_shards_are_even_and_slots_gapless(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ring_sharding, "PART_ROWS", 16)
    texts = [(i, "hot") for i in range(150)] + [(i, f"t{i % 211} é") for i in range(150, 400)] + [(400, None), (401, ""), (None, "n"), (None, "n"), (7, "hot")]
    docs = stored(spark, tmp_path, texts, DOC)
    found = ring_sharding.shard_rows(docs).collect()
    assert len(found) == len(texts)
    slots = collections.defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    assert sorted(map(str, found)) == sorted(map(str, ring_sharding.shard_rows(docs.repartition(5)).collect()))
    # copies that fit stay together
    places = collections.defaultdict(set)
    for r in found:
        places[r["text_crc32"]].add(r["shard"])
    assert sum(len(p) == 1 for p in places.values()) > 0.8 * len(places)
    assert ring_sharding.shard_rows(docs.limit(0)).collect() == []


def test_one_more_shard_moves_little():
    rng = random.Random(1)
    nodes, grown = ring_sharding.ring(8, 128), ring_sharding.ring(9, 128)

    def owner(ring, place):
        return next((s for p, s in ring if p >= place), ring[0][1])

    keys = [rng.randrange(ring_sharding.SLOTS) for _ in range(2000)]
    moved = [(owner(nodes, k), owner(grown, k)) for k in keys]
    assert all(a == b or b == 8 for a, b in moved) and sum(a != b for a, b in moved) < 500


def test_overflow_goes_clockwise_by_brute_force(spark, tmp_path):
    """Every key walked alone: its own shard if there is room, else the next shard clockwise that has some."""
    rng = random.Random(12)
    texts = [(i, f"t{rng.randrange(90)}") for i in range(700)] + [(1000 + i, "hot " * 3) for i in range(300)] + [(5000, "long " * 60_000), (5001, None), (5002, "")]
    shards, virtual = 5, 3
    found = ring_sharding.shard_rows(stored(spark, tmp_path, texts, DOC), shards, virtual).collect()
    nodes, room = ring_sharding.ring(shards, virtual), [len(texts) // shards + (s < len(texts) % shards) for s in range(shards)]

    def arc_of(text):
        place = spark.sql("select pmod(xxhash64(:t), :n) as p", {"t": text, "n": ring_sharding.SLOTS}).first()["p"]
        return next((i for i, (at, _) in enumerate(nodes) if at >= place), 0)

    arcs = {t: arc_of(t or "") for t in {t for _, t in texts}}
    want, waiting = collections.Counter(), collections.Counter(arcs[t] for _, t in texts)
    for arc in sorted(waiting):  # first every arc's keys to their own shard
        for _ in range(waiting[arc]):
            if room[nodes[arc][1]]:
                room[nodes[arc][1]] -= 1
                want[arc, nodes[arc][1]] += 1
                waiting[arc] -= 1
    for arc in sorted(waiting):  # then what is left over walks on
        for _ in range(waiting[arc]):
            step = arc
            while not room[nodes[step % len(nodes)][1]]:
                step += 1
            room[nodes[step % len(nodes)][1]] -= 1
            want[arc, nodes[step % len(nodes)][1]] += 1
    by_id = dict(texts)
    assert collections.Counter((arcs[by_id[r["doc_id"]]], r["shard"]) for r in found) == want
    assert next(r["size"] for r in found if r["doc_id"] == 5000) == 300_001


def test_flows_fill_up_to_the_bound():
    nodes = ring_sharding.ring(4, 16)
    counts = {0: 500, 3: 20, 9: 77}
    pieces = ring_sharding.flows(nodes, counts, [150, 149, 149, 149])
    assert sum(hi - lo for _, lo, hi, _, _ in pieces) == 597
    for arc, n in counts.items():
        mine = sorted((lo, hi) for a, lo, hi, _, _ in pieces if a == arc)
        assert mine[0][0] == 0 and mine[-1][1] == n and all(x[1] == y[0] for x, y in zip(mine, mine[1:], strict=False))


# mixes


def test_mix_meets_its_weights(spark, tmp_path):
    rng = random.Random(6)
    sizes = {"big": 900, "mid": 300, "small": 60, None: 40}
    texts = [(i, " ".join(["w"] * rng.randrange(1, 40)), None, s) for s, n in sizes.items() for i in range(n)]
    texts += [(5000, None, None, "mid"), (5001, "", None, "mid"), (None, "w w", None, "mid")]
    docs = stored(spark, tmp_path, texts, DOC)
    for limit, entropy in ((2.0, None), (6.0, None), (None, 0.9)):
        found = temperature_mixing.mixed(docs, ["doc_id", "text", "source", "s"], limit or 2.0, entropy, block_tokens=200).collect()
        own = collections.Counter()
        for i, t, _, s in texts:
            own[s] += max(1, len((t or "").split()))
        got, weight = collections.Counter(), {}
        reads = collections.Counter()
        for r in found:
            got[r["source"]] += r["tokens"]
            weight[r["source"]] = r["mix_weight"]
            reads[r["source"], r["doc_id"], r["text"]] += 1
        assert set(reads) == {(s, i, t) for i, t, _, s in texts}  # every document is there
        assert sum(weight.values()) == pytest.approx(1)
        total = sum(got.values())
        for s in sizes:
            assert got[s] / total == pytest.approx(weight[s], rel=0.06)
        repeats = {s: got[s] / own[s] for s in sizes}
        if entropy is None:
            assert max(repeats.values()) == pytest.approx(limit, rel=0.08) and min(repeats.values()) == pytest.approx(1)
        else:
            assert -sum(w * math.log(w) for w in weight.values()) == pytest.approx(entropy * math.log(4), abs=1e-3)
    assert temperature_mixing.mixed(docs.limit(0), ["doc_id"]).collect() == []


# the pipeline


def test_pipeline_by_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    from tidemark.llm.common import cut

    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf), name)
        counts.append(docs.count())
        if name != "bpe":
            assert docs.columns == columns
        if name in ("exact_dedup", "near_dedup"):
            assert docs.select("text").distinct().count() == counts[-1]
    assert rows > counts[0] >= counts[1] >= counts[2] <= counts[3] == counts[4]
    assert corpus_pipeline.ORACLE_SQL is None


def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from tidemark.llm import queries

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        frame = queries.QUERIES[name](spark, sf)
        columns = sorted(frame.columns)
        answer = con.execute(f"select {', '.join(columns)} from ({sql}) x")
        assert sorted(map(tuple, frame.select(*columns).collect()), key=str) == sorted(answer.fetchall(), key=str), name
