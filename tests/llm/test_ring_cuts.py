"""An overflow between two shards cuts at most one text, however large the arc is."""

import collections

import pytest

from tidemark.llm import ring_sharding

DOC = "doc_id bigint, text string"


@pytest.mark.parametrize("hot", [0, 900])
def test_an_overflow_cuts_at_most_one_text(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(ring_sharding, "PART_ROWS", 16)
    shards, nodes = 4, 2
    rows = [(i, "hot") for i in range(hot)] + [(hot + i, f"text {i % 500}") for i in range(1500)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, DOC).repartition(5).write.parquet(path)
    found = ring_sharding.shard_rows(spark.read.parquet(path), shards, nodes).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(len(rows)))
    slots = collections.defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert sorted(map(len, slots.values())) == [len(rows) // shards] * shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    places = collections.defaultdict(set)
    for r in found:
        places[r["text_crc32"]].add(r["shard"])
    # an arc is cut once for each further shard that it overflows to, and a shard fills up once
    assert sum(len(p) > 1 for p in places.values()) <= shards * nodes + shards
