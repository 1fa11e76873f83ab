"""The queries that apply the operators to whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, egrid, fim, langid, licenses, maxscore, packing, planes, secrets, simhash, trie, vptree, warc
from .common import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.detect(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.round_trip(table(spark, sf_dir, "documents"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_egrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egrid.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.round_trip(table(spark, sf_dir, "documents"))


#: In the order of the operators' numbers.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_langid, op2_secrets, op3_licenses, op4_bpe, op5_warc, op6_packing, op7_maxscore, op8_simhash, op9_vptree, op10_planes, op11_trie, op12_egrid, op13_fim)}

#: Base-32 SHA-1 has no function in DuckDB: five bits at a time from the hex digest.
WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS last,
    list_transform(range(0, 8), lambda i: ('0x' || substr(hex, CAST(i AS INT) * 5 + 1, 5))::BIGINT) AS fives FROM p
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(fives, lambda x: list_aggregate(list_transform(range(0, 4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> CAST(15 - 5 * j AS BIGINT)) & 31 AS INT) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""

TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, a byte and then its eight bits at a time; DuckDB has no function for it."""
    bit = "CASE WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END"
    byte = f"list_reduce(list_prepend(xor(crc, CAST(ord(c) AS BIGINT)), list_transform(range(0, 8), lambda i: CAST(0 AS BIGINT))), lambda acc, i: {bit})"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda crc, x: {byte.replace('CAST(ord(c) AS BIGINT)', 'x')}), 4294967295)"


#: Prefixes as lists of digests of their turns.
TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, list(struct_pack(d := d, chars := chars) ORDER BY turn NULLS FIRST, d) AS own FROM t GROUP BY conv_id
), h AS (
  SELECT *, {crc32_sql('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM o
), r AS (
  SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS turns FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100
), l AS (
  SELECT conv_id, len(turns) AS n, list_transform(turns, lambda x: x.d) AS ds, list_transform(turns, lambda x: x.chars) AS cs FROM r
), p AS (
  SELECT conv_id, n, depth, ds[1:depth] AS prefix, CASE WHEN depth > 0 THEN cs[depth] ELSE 0 END AS chars FROM (SELECT *, unnest(range(0, CAST(n AS BIGINT) + 1)) AS depth FROM l)
), v AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256 FROM p GROUP BY depth, prefix
), k AS (
  SELECT v.*, x.n_children FROM v LEFT JOIN (SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY ALL) x USING (depth, prefix)
), s AS (
  SELECT a.depth, a.prefix, count(*) FILTER (WHERE b.n_children IS NULL) AS n_leaves, CAST(sum((b.n_convs - 1) * b.chars) AS BIGINT) AS saved_tokens FROM v a JOIN k b ON b.depth >= a.depth AND b.prefix[1:a.depth] = a.prefix GROUP BY ALL
)
SELECT k.conv_id, k.depth, q.conv_id AS parent_conv_id, k.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, k.ends_sha256
FROM k JOIN s USING (depth, prefix) LEFT JOIN v q ON q.depth = k.depth - 1 AND q.prefix = k.prefix[1:k.depth - 1]
"""

FIM_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents
), h AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, list_transform(range(0, 4), lambda k: ('0x' || substr(hex, CAST(8 * k + 1 AS INT), 8))::BIGINT) AS h FROM u
), c AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": WARC_SQL, "op7_maxscore": TOP_SQL, "op11_trie": TRIE_SQL, "op13_fim": FIM_SQL}
