"""The registered queries of the training-data operators, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, hmm, language_id, mixing, quality, simhash, substring_dedup, token_file, warc
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_taken(table(spark, sf_dir, "documents"))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_digests(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.assign_components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

ORACLE = {
    "op6_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT k, unnest(range(1, len(w) - 33)) AS pos, w FROM d WHERE len(w) >= 35),
h AS (SELECT k, pos, md5(array_to_string(w[pos:pos + 34], ' ')) AS h FROM s),
r AS (SELECT k, pos FROM (SELECT k, pos, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
c AS (SELECT k, list(DISTINCT pos + i) AS gone FROM (SELECT k, pos, unnest(range(0, 35)) AS i FROM r) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN c USING (k)
""",
    "op7_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS pos FROM i WHERE len(w) > 0),
b AS (SELECT DISTINCT item_id, n, array_to_string(w[pos:pos + n - 1], ' ') AS s FROM p),
q AS (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n),
h AS (SELECT q.k, q.pos, b.n, b.item_id FROM (SELECT k, pos, n, array_to_string(w[pos:pos + n - 1], ' ') AS s FROM q) q JOIN b ON q.n = b.n AND q.s = b.s),
c AS (SELECT k, count(DISTINCT x) AS n_hit FROM (SELECT k, unnest(range(pos, pos + n)) AS x FROM h) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS ids FROM (SELECT DISTINCT k, item_id::VARCHAR AS item FROM h) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(ids, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)
""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (
  SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
    list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(sha1(body), (5 * (k // 4) + 1)::INT, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31) + 1, 1)), 'string_agg', '') AS payload_digest
  FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM m
""",
    "op10_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
g AS (SELECT doc_id, text_sha256, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id) AS kept, text_sha256 FROM g
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
