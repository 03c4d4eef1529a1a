"""Every stage with null, empty, repeated and clashing rows; nothing is left behind or left set."""

import os

import corpus_pipeline
from tidemark.llm import common
from tidemark.llm.common import cut

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, _row string, score string, tokens string, n string"


def test_stages_with_awkward_rows(spark, tmp_path):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (None, "one two three four five six"), (3, ""), (None, None), (4, "other words of a text that stands alone here"), (5, "x" * 50_000), (6, "w " * 30_000), (6, " \n\t")]
    extra = [(i, t, None, [None, "a", "b"][k % 3], None, "x", "y", "z", "t", "n") for k, (i, t) in enumerate(rows)]
    path = str(tmp_path / "in")
    os.makedirs(path)
    spark.createDataFrame(extra, DOC).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (3, 0, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, counts = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, path), name)
        counts[name] = docs.count()
        if name != "bpe":
            assert docs.columns == columns
            assert {tuple(r[5:]) for r in docs.collect()} == {("x", "y", "z", "t", "n")}
        if name == "exact_dedup":
            assert {(r["text"] or "") for r in docs.select("text").collect()} == {(t or "") for _, t in rows}
    # no labels of both classes: nothing is rejected; six texts differ, null counting as empty
    assert counts["toxicity"] == len(rows) and counts["exact_dedup"] == counts["near_dedup"] == 6
    # every source is read once at least
    assert counts["bpe"] == counts["mixing"] >= counts["near_dedup"]


def test_run_cleans_up(spark, tmp_path):
    path = str(tmp_path / "none")
    os.makedirs(path)
    spark.createDataFrame([], DOC).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    common.release(spark)
    before = spark.conf.get(corpus_pipeline.ARROW_SETTING)
    assert corpus_pipeline.run(spark, path).collect() == []
    assert spark.conf.get(corpus_pipeline.ARROW_SETTING) == before
    assert len(common._written) == 1  # what the last stage reads
    common.release(spark)
    assert not common._written
