"""The ten operators as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, debruijn_dedup, embedding_lsh, fingerprint_dedup, main_text, minhash_forest, ring_sharding, temperature_mixing, toxicity, warc
from tidemark.llm.common import fresh_path, table

RANKS = "byte_bpe_50k.tiktoken"


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(table(spark, sf_dir, "pages"))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_lsh.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_components(table(spark, sf_dir, "documents")).drop("component")


def op5_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_sharding.shard_rows(table(spark, sf_dir, "documents"))


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temperature_mixing.mixed(table(spark, sf_dir, "documents"), ["doc_id", "source"])


def op7_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op8_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pages = fresh_path(spark, "warc"), table(spark, sf_dir, "pages")
    warc.write_archives(pages, path)
    return warc.page_captures(warc.assembled(warc.read_records(spark, path)), pages.schema["page_id"].dataType.simpleString()).drop("capture_id")


def op9_fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return docs.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_main_text, op2_cross_polytope, op3_byte_bpe, op4_minhash_forest, op5_ring_sharding, op6_temperature_mixing, op7_debruijn_dedup, op8_warc_transactions, op9_fingerprint_dedup, op10_toxicity)
}

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _component_sql(nodes: str, links: str) -> str:
    """CTEs ending in component(id, component_id), for links(a, b) in both directions."""
    return f"""reach(id, other) AS (SELECT id, id FROM {nodes} UNION SELECT r.id, l.b FROM reach r JOIN {links} l ON l.a = r.other),
      component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""


ORACLES: dict[str, str] = {
    "op2_cross_polytope": f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_inner_product(e, e) > 0),
      links AS (SELECT a.id AS a, b.id AS b FROM good a JOIN good b ON a.label = b.label AND a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
      {_component_sql('v', 'links')}
      SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = c.id) AS n_links, component_id, id = component_id AS kept FROM component c""",
    "op4_minhash_forest": f"""WITH RECURSIVE w AS (SELECT doc_id AS id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
      s AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM w) x),
      n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
      shared AS (SELECT p.id AS a, q.id AS b, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.id <> q.id GROUP BY p.id, q.id),
      links AS (SELECT a, b FROM shared JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
      {_component_sql('w', 'links')}
      SELECT c.id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, c.id = component_id AS kept FROM component c LEFT JOIN n ON n.id = c.id""",
    "op7_debruijn_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
      g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35) x),
      r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
      hit AS (SELECT doc_id, i FROM g JOIN r USING (h)),
      gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM hit),
      one AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
      kept AS (SELECT o.doc_id, o.i, o.word FROM one o LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL),
      k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM kept GROUP BY doc_id)
      SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id""",
    "op8_warc_transactions": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
      f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
      SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f ON f.d = p.d AND n >= 100""",
    "op9_fingerprint_dedup": """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
      FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
