"""Each stage of the pipeline, given its own input, against a brute-force version of it."""

import collections
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F
from test_dedup import near_by_brute_force

import corpus_pipeline
from tidemark.llm import toxicity
from tidemark.llm.common import cut

SF = "/root/testdata/sf0.001"
tokenizers = pytest.importorskip("public_tokenizers")


def rows_of(frame):
    return collections.Counter(tuple(r) for r in frame.collect())


def tokens(text):
    return max(1, len(re.findall(r"[^\x20\x09-\x0D]+", text or "")))


def test_every_stage_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.orderBy("doc_id").limit(30)
    copies = some.withColumn("doc_id", F.col("doc_id") + 1_000_000)
    near = some.withColumn("doc_id", F.col("doc_id") + 2_000_000).withColumn("text", F.concat("text", F.lit(" one more ending")))
    docs.unionByName(copies).unionByName(near).repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    at, stages = {c: i for i, c in enumerate(docs.columns)}, dict(corpus_pipeline.STAGES)
    name, text, source = at["doc_id"], at["text"], at["source"]

    def after(stage, frame):
        return cut(stages[stage](spark, frame, SF), stage)

    # toxicity: each row scored alone
    scorer = toxicity.Scorer(toxicity.fitted(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    found = after("toxicity", docs)
    assert rows_of(found) == {r: n for r, n in rows_of(docs).items() if scorer.scores([r[text]])[0] < 0.5}

    # exact copies: of equal texts the largest doc_id
    given, found = rows_of(found), after("exact_dedup", found)
    last = {}
    for r in given:
        last[r[text] or ""] = max(last.get(r[text] or "", -1), r[name])
    assert rows_of(found) == {r: 1 for r in given if last[r[text] or ""] == r[name]} and len(last) < len(given)

    # near copies: of each component of all pairs the smallest doc_id
    given, found = rows_of(found), after("near_dedup", found)
    kept = near_by_brute_force([(r[name], r[text]) for r in given])
    assert rows_of(found) == {r: 1 for r in given if kept[r[name]][2] or not kept[r[name]][0]} and sum(k[2] for k in kept.values()) < len(given)

    # mixing: whole epochs, and one reading more for as many tokens as the budget leaves
    given, found = rows_of(found), after("mixing", found)
    read = rows_of(found)
    sizes = collections.Counter()
    for r in given:
        sizes[r[source]] += tokens(r[text])
    largest, ratio = max(sizes.values()), max(sizes.values()) / min(sizes.values())
    power = min(1.0, math.log(2) / math.log(ratio)) if ratio > 1 else 1.0
    assert set(read) == set(given)
    for s, n in sizes.items():
        readings = (largest / n) ** power
        epochs = math.floor(readings + 1e-9)
        rest = max(0, round((readings - epochs) * n))
        mine = [r for r in given if r[source] == s]
        assert all(read[r] in (epochs, epochs + 1) for r in mine)
        more = sum(tokens(r[text]) for r in mine if read[r] > epochs)
        assert more <= rest + 1 and rest - more < max(tokens(r[text]) for r in mine)

    # encoding: by the library, one row for each reading
    tiktoken = pytest.importorskip("tiktoken")
    from tidemark.llm import byte_bpe

    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = collections.Counter()
    for r, n in read.items():
        ids = library.encode_ordinary(r[text] or "")
        want[r[name], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] += n
    assert rows_of(after("bpe", found).select("doc_id", "n_tokens", "ids_sha256")) == want
