"""What the driver remembers of jobs and tasks does not follow the number of shuffle partitions."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, toxicity

PARTITIONS = 60


@contextmanager
def many_partitions(spark, group):
    held = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup(group, group)
    try:
        yield
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
        for k, v in before.items():
            spark.conf.set(k, v)


def jobs_of(spark, group):
    return spark.sparkContext.statusTracker().getJobIdsForGroup(group)


def tasks_of(spark, group):
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in jobs_of(spark, group) for s in tracker.getJobInfo(j).stageIds}
    return sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)


def test_bitmap_in_few_jobs(spark):
    values = spark.range(3000).select(F.xxhash64("id").alias("v"))
    with many_partitions(spark, "bitmap"):
        got = common.bitmap(values, "v", 1 << 30)
    want = bytearray(len(got))
    for r in values.collect():
        at = r["v"] & (8 * len(got) - 1)
        want[at >> 3] |= 1 << (at & 7)
    assert got == bytes(want) and len(jobs_of(spark, "bitmap")) < 12


def test_training_sample_in_order_by_ranges(spark, tmp_path, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("words of "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 7 == 0).cast("int").alias("toxic"))
    given = []
    monkeypatch.setattr(toxicity, "trained", lambda rows, seed=5: given.append(list(rows)))
    with many_partitions(spark, "sample"):
        toxicity.fitted(docs, labels)
    assert len(jobs_of(spark, "sample")) < 20
    monkeypatch.setattr(toxicity, "READ_BYTES", 100)
    toxicity.fitted(docs, labels)
    ids = [int(t.split()[-1]) for t, _ in given[0]]
    assert ids == sorted(ids) and len(ids) > 300 and given[0] == given[1] and all(toxic == (i % 7 == 0) for i, (_, toxic) in zip(ids, given[0], strict=True))


@pytest.mark.parametrize("links", [0, 1, 400])
def test_few_links_in_few_tasks_and_many_in_rounds(spark, monkeypatch, links):
    rng = random.Random(links)
    pairs = [(rng.randrange(-300, 300) * (1 << 50), rng.randrange(-300, 300) * (1 << 50)) for _ in range(links)]
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    with many_partitions(spark, f"links-{links}"):
        alone = common.components(edges).collect()
    assert tasks_of(spark, f"links-{links}") < 4 * PARTITIONS
    monkeypatch.setattr(common, "ONE_TASK", -1)
    rounds = common.components(edges).collect()
    assert sorted(map(tuple, alone)) == sorted(map(tuple, rounds))
    assert len({r["node"] for r in alone}) == len(alone) == len({n for p in pairs if p[0] != p[1] for n in p})
