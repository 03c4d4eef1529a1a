"""Boilerplate does not depend on how large its host is, nor on how short a block is."""

import random

from tidemark.llm import main_text

PAGE = "page_id bigint, url string, html string"
EACH = 12


def pages_of(host, templates):
    rng, out, want = random.Random(7), [], []
    for t in range(templates):
        notice = f"Notice {t} of our terms which you should read before you go on"
        menu = "".join(f"<div>{w}{t}</div>" for w in ("Home", "News", "About us"))
        for i in range(EACH):
            own = " ".join(f"w{rng.randrange(100_000)}" for _ in range(20))
            out.append((f"http://{host}/{t}/{i}", f"<body>{menu}<p>{own}</p><p>{notice}</p><div>only{t}x{i}</div></body>"))
            want.append(f"{own}\n\nonly{t}x{i}")
    return out, want


def test_a_host_of_many_templates(spark, tmp_path):
    pages, want = [], []
    for host, templates in (("one.example", 1), ("four.example", 4), ("many.example", 30)):
        rows, texts = pages_of(host, templates)
        pages += rows
        want += texts
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    # copies, and short blocks that only one page of a host has, stay
    rows += [(10_000, "http://copy.example/1", "<p>Home</p>"), (10_001, "http://copy.example/2", "<p>Home</p>"), (10_002, "http://lone.example/", "<p>News0</p><p>Home0</p>")]
    path = str(tmp_path / "pages")
    spark.createDataFrame(rows, PAGE).repartition(3).write.parquet(path)
    found = {r["page_id"]: r["text"] for r in main_text.main_texts(spark.read.parquet(path)).collect()}
    assert [found[i] for i in range(len(want))] == want
    assert (found[10_000], found[10_001], found[10_002]) == ("Home", "Home", "News0\n\nHome0")
