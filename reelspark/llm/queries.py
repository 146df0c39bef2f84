"""The queries of this subpackage: name -> function of (spark, folder of tables), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import bpe, decontaminate, htmltree, langid, quality, rans, sharding, simhash, substring, warc
from reelspark.session import ship, spread


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    tokens = bpe.encode(_table(spark, folder, "documents"), keep=["doc_id"], decode=True)
    return tokens.select("doc_id", *bpe.digests(F.col("ids"), F.col("decoded")))


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_rans(spark: SparkSession, folder: str) -> DataFrame:
    return rans.round_trip(_table(spark, folder, "documents"))


def op4_html(spark: SparkSession, folder: str) -> DataFrame:
    return htmltree.main_text(_table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(_table(spark, folder, "documents"))


def op6_substring(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return substring.dedupe(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.round_trip(_table(spark, folder, "pages"))
    main = [f"response.{c} AS {name}" for c, name in (("page_id", "page_id"), ("payload_bytes", "payload_bytes"), ("payload_digest", "payload_digest"), ("type", "record_type"), ("refers_to", "refers_to"))]
    return found.selectExpr(*main, "response.target_uri AS url", "request.record_id IS NOT NULL AND metadata.record_id IS NOT NULL AS complete")


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.groups(_table(spark, folder, "documents"), shingle=4, max_distance=4)
    return found.select("doc_id", simhash.hex_digits("id").alias("fingerprint"), "component_id")


def op9_langid(spark: SparkSession, folder: str) -> DataFrame:
    return langid.predict(_table(spark, folder, "documents"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_decontaminate": op2_decontaminate,
    "op3_rans": op3_rans,
    "op4_html": op4_html,
    "op5_sharding": op5_sharding,
    "op6_substring": op6_substring,
    "op7_warc": op7_warc,
    "op8_simhash": op8_simhash,
    "op9_langid": op9_langid,
    "op10_quality": op10_quality,
}
#: Operators 1 to 3 and 8 to 10 need tokenizers, edit distances, XXH64 or trained models, which SQL lacks; tests hold them against brute force.
SQL: dict[str, str] = {
    # for pages of one plain article, as those of the tables are
    "op4_html": r"""
WITH a AS (SELECT page_id, url, regexp_replace(replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<br>', ' '), '</?b>', '', 'g') AS body FROM pages),
     b AS (SELECT page_id, url, [trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) FOR x IN string_split_regex(body, '</?(?:p|h1)>')] AS blocks FROM a),
     c AS (SELECT page_id, url, array_to_string([x FOR x IN blocks IF x <> ''], chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c""",
    "op5_sharding": r"""
WITH t AS (SELECT list(v ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda a, i: xor(a >> 1, 3988292384 * (a & 1))) AS v FROM range(256) r(n))),
     d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\1 ', 'g'), ' ') AS h FROM documents),
     c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || x)::BIGINT FOR x IN h IF x <> '']), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d, t),
     s AS (SELECT *, ((sum(size) OVER (ORDER BY doc_id) - size) * 16 // sum(size) OVER ())::INT AS shard FROM c)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM s""",
    "op6_substring": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM w WHERE len(w) >= 50), x AS (SELECT doc_id, i, hash(w[i:i + 49]) AS h FROM p),
     f AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS owner FROM x) WHERE owner < doc_id),
     g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM f), l AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY 1),
     k AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, CASE WHEN gone IS NULL THEN w ELSE [w[j] FOR j IN range(1, len(w) + 1) IF NOT list_contains(gone, j)] END AS kept FROM w LEFT JOIN l ON l.doc_id = w.doc_id)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
    "op7_warc": r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, url, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
     x AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to, url, true AS complete FROM x""",
}
