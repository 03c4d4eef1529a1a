"""Training reads every window of the sampled rows, of long rows too."""

import random

import numpy as np

from tidemark.llm import toxicity


def test_training_reads_every_window(monkeypatch):
    rng, seen = random.Random(3), []
    forward = toxicity.Network.forward

    def counted(net, terms, live, keep=None):
        seen.append(live.shape[1])
        return forward(net, terms, live, keep)

    rows = [(" ".join(f"w{rng.randrange(500)}" for _ in range(n)) + (" vile" if n % 2 else ""), n % 2) for n in (30, 31, 900, 901, 20_000)]
    texts = sum(len(toxicity.windows_of(np.zeros(len(toxicity.words_of(t)), dtype=np.int64), -1)) for t, _ in rows)
    monkeypatch.setattr(toxicity.Network, "forward", counted)
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "STEPS", 0)
    monkeypatch.setattr(toxicity, "STEP_WINDOWS", 10_000)
    whole = toxicity.trained(rows)
    assert seen == [texts]
    # many passes of few windows give the same network
    monkeypatch.setattr(toxicity, "STEP_WINDOWS", 50)
    parts = toxicity.trained(rows)
    assert max(seen[1:]) == 50
    assert all(np.allclose(whole.p[k], parts.p[k], atol=1e-4) for k in whole.p)


def test_long_rows_are_in_the_sample(spark, monkeypatch):
    rows = []
    monkeypatch.setattr(toxicity, "trained", lambda found, *_: rows.extend(tuple(r) for r in found))
    docs = spark.createDataFrame([(i, "word " * n) for i, n in enumerate((5, 10, 20_000, 40_000, 7, 9))], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id bigint, toxic int")
    toxicity.fitted(docs, labels)
    learnable = [i for i in range(6) if toxicity.crc32(str(i).encode()) % 5]
    assert {2, 3} & set(learnable) and len(rows) == len(learnable)
    assert any(len(t) > 90_000 for t, _ in rows)
