"""Registered queries of the corpus operators, with SQL for a second engine where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sightline.llm.common import read
from sightline.llm.decontamination import decontaminate
from sightline.llm.exact_dedup import exact_dedup
from sightline.llm.html_text import extract_text
from sightline.llm.language import identify_languages
from sightline.llm.mixing import mix_sources
from sightline.llm.near_dup import near_duplicates
from sightline.llm.pii import find_personal_data
from sightline.llm.prefix_trie import NODE, conversation_trie
from sightline.llm.substring_dedup import substring_dedup
from sightline.llm.token_files import token_files
from sightline.llm.toxicity import score_toxicity
from sightline.llm.warc import archive_pages
from sightline.llm.word_runs import alter, periodic_runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = archive_pages(read(spark, sf_dir, "pages"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op1_warc"] = """
WITH n AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS f FROM n
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f <> page_id THEN f END AS refers_to
FROM m
"""


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read(spark, sf_dir, "documents"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).drop("row")


ORACLES["op6_exact_dedup"] = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, h AS text_sha256
FROM n WINDOW g AS (PARTITION BY h)
"""


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read(spark, sf_dir, "documents"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))


@query
def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("row")


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read(spark, sf_dir, "conversations")).select(NODE)


# crc32 bit by bit over the digits of an id; a node's subtree is found by the prefixes of its smallest member
ORACLES["op11_prefix_trie"] = """
WITH RECURSIVE ids AS (
  SELECT DISTINCT conv_id, cast(conv_id AS varchar) AS digits FROM conversations WHERE conv_id IS NOT NULL
), crc(conv_id, digits, i, c) AS (
  SELECT conv_id, digits, 0, 4294967295::BIGINT FROM ids
  UNION ALL
  SELECT conv_id, digits, i + 1, list_reduce(
    list_prepend(xor(c, ascii(substr(digits, i + 1, 1))::BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))
  FROM crc WHERE i < length(digits)
), conv AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(c, 4294967295) % 9 AS h FROM crc WHERE i = length(digits)
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), r AS (
  SELECT c.conv_id, t.n, t.role, t.text FROM conv c JOIN t ON t.conv_id = c.base WHERE t.n <= c.h
  UNION ALL
  SELECT c.conv_id, t.n + 100, t.role, t.text FROM conv c JOIN t ON t.conv_id = c.conv_id WHERE t.n > c.h
), s AS (
  SELECT conv_id, row_number() OVER w AS depth, octet_length(encode(text)) AS bytes,
         list({'role': role, 'text': text}) OVER (w ROWS UNBOUNDED PRECEDING) AS path
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY n)
), p AS (
  SELECT conv_id, 0 AS depth, 0 AS bytes, sha256('') AS path FROM conv
  UNION ALL SELECT conv_id, depth, bytes, sha256(cast(to_json(path) AS varchar)) FROM s
), e AS (
  SELECT conv_id, max(depth) AS last FROM p GROUP BY conv_id
), n AS (
  SELECT p.depth, p.path, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(p.bytes) AS bytes,
         sha256(coalesce(string_agg(cast(p.conv_id AS varchar), ',' ORDER BY p.conv_id) FILTER (WHERE p.depth = e.last), '')) AS ends_sha256
  FROM p JOIN e USING (conv_id) GROUP BY p.depth, p.path
), k AS (
  SELECT n.*, q.path AS up FROM n LEFT JOIN p q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1
), c AS (
  SELECT up AS path, depth - 1 AS depth, count(*) AS n_children FROM k WHERE up IS NOT NULL GROUP BY 1, 2
), m AS (
  SELECT k.*, coalesce(c.n_children, 0) AS n_children FROM k LEFT JOIN c USING (path, depth)
), below AS (
  SELECT q.depth, q.path, sum((m.n_convs - 1) * m.bytes) AS saved_tokens, count(*) FILTER (WHERE m.n_children = 0) AS n_leaves
  FROM m JOIN p q ON q.conv_id = m.conv_id AND q.depth <= m.depth GROUP BY 1, 2
)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, below.n_leaves,
       cast(below.saved_tokens AS bigint) AS saved_tokens, m.ends_sha256
FROM m JOIN below USING (path, depth) LEFT JOIN m u ON u.path = m.up AND u.depth = m.depth - 1
"""


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(read(spark, sf_dir, "documents"), prepare=alter)


@query
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read(spark, sf_dir, "documents"))
