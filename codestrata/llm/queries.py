"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir, table
from .decontaminate import find_leaks
from .language_id import identify
from .lm_scoring import score_documents
from .ngram_join import similar_classes
from .piece_codec import piece_digests
from .quality import quality_report
from .sharding import shard_by_bytes
from .token_counts import count_tokens
from .toxicity import score_toxicity
from .warc import round_trip


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return shard_by_bytes(table(spark, sf_dir, "documents"), 8)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = round_trip(table(spark, sf_dir, "pages"), shared_dir(spark))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return similar_classes(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return quality_report(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_piece_codec": op6_piece_codec,
    "op7_warc": op7_warc,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
}

#: The same results in plain SQL, where it can express them on whole tables.
ORACLES: dict[str, str] = {
    "op1_sharding": """WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
      d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
      c AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(CAST(length(h) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32 FROM d, crc),
      s AS (SELECT *, CAST(sum(size) OVER w - size AS BIGINT) AS start_byte, CAST(sum(size) OVER () AS BIGINT) AS total, row_number() OVER w AS n FROM c WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size)),
      p AS (SELECT *, CAST((2 * start_byte + size) * 8 // (2 * total) AS INTEGER) AS shard FROM s)
      SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY n) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard, start_byte FROM p""",
    "op2_ngram_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
      g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS g FROM w WHERE len(w) > 0),
      n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1), b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
      l AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE k >= 0.8 * (p.n + q.n - k) - 1e-9),
      r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.doc_id)
      SELECT d.doc_id, c.class_id, CAST((SELECT count(*) FROM l WHERE l.a = d.doc_id) AS BIGINT) AS n_links FROM documents d JOIN (SELECT doc_id, min(m) AS class_id FROM r GROUP BY 1) c USING (doc_id)""",
    "op7_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), m AS (SELECT *, octet_length(encode(h)) AS n, max(page_id) OVER (PARTITION BY h) AS rep FROM p)
      SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> rep THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> rep THEN rep END AS refers_to FROM m""",
}
