"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from almanack.llm.session import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanack.llm.substrings import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanack.llm.suffix_array import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanack.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanack.llm.decontaminate import scan

    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanack.llm.language import languages

    return languages(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanack.llm.bpe_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanack.llm.shards import byte_shards

    return byte_shards(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanack.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanack.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanack.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanack.llm.band_join import near_prices

    return near_prices(table(spark, sf_dir, "items"), table(spark, sf_dir, "sale_lines"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanack.llm.prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanack.llm.pii import pii_digests

    return pii_digests(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (op1_substring_dedup, op2_suffix_array, op3_packing, op4_decontamination, op5_language_id, op6_token_counts, op7_byte_shards, op8_toxicity, op9_quality, op10_jaccard_join, op11_band_join, op12_prefix_trie, op13_pii, pipeline)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

#: CRC-32 of short ASCII strings: the table by its rule, then a fold over the characters.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tbl)"
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)), lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"

#: The rows of op4 by joined words, of op11 by a join on ranges of prices, of op12 by whole prefixes. The others need a library's tokens, code
#: points, xxHash, fitted models or, as op1, op2 and op10, more memory than SQL of this kind has at any size; tests/llm holds them against brute force.
ORACLES = {
    "op11_band_join": f"""WITH {_CRC_TABLE}, i AS (SELECT item_id, floor(100 * price + 0.5)::BIGINT AS p FROM items),
l AS (SELECT sale_id, line_no::BIGINT AS line_no, item_id AS line_item_id, 2 * floor(100 * amount + 0.5)::BIGINT + quantity AS n, 2 * quantity::BIGINT AS d FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity <> 0 AND amount IS NOT NULL),
u AS (SELECT sale_id, line_no, line_item_id, CASE WHEN d > 0 THEN (n - ((n % d) + d) % d) // d ELSE (-n - ((-n % -d) - d) % -d) // -d END AS u, {_CRC.format("sale_id || ',' || coalesce(line_no::VARCHAR, '') || ',' || line_item_id")} AS c FROM l, crc),
j AS (SELECT item_id, abs(u - p) AS gap, u, sale_id, line_no, line_item_id, c FROM i JOIN u ON u BETWEEN p - greatest(50, abs(p) // 200 + 1) AND p + greatest(50, abs(p) // 200 + 1) AND line_item_id <> item_id AND (abs(u - p) <= 50 OR 1000 * abs(u - p) <= 5 * least(u, p))),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY gap, u, sale_id, line_no NULLS FIRST, line_item_id)::INT AS rank FROM j), s AS (SELECT item_id, count(*) AS n_pairs, sum(gap)::BIGINT AS gap_sum, sum(c)::BIGINT AS lines_crc FROM j GROUP BY item_id)
SELECT i.item_id, coalesce(rank, 0)::INT AS rank, gap, u, sale_id, line_no, r.line_item_id, coalesce(n_pairs, 0)::BIGINT AS n_pairs, coalesce(gap_sum, 0)::BIGINT AS gap_sum, coalesce(lines_crc, 0)::BIGINT AS lines_crc FROM i LEFT JOIN s ON s.item_id = i.item_id LEFT JOIN r ON r.item_id = i.item_id AND rank <= 10""",
    "op12_prefix_trie": f"""WITH {_CRC_TABLE}, o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') || chr(2) || coalesce(text, '') AS k, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, n, c - c % 5 AS base, {_CRC.format("c::VARCHAR")} % 9 AS h FROM (SELECT c, count(*) AS n FROM o GROUP BY c), crc), w AS (SELECT v.c, v.h, v.base, least(v.h, coalesce(b.n, 0)) AS head FROM v LEFT JOIN v b ON b.c = v.base),
t AS (SELECT w.c, o.pos AS depth, k, bytes FROM w JOIN o ON o.c = w.base AND o.pos <= w.h UNION ALL SELECT w.c, o.pos - w.h + w.head, k, bytes FROM w JOIN o ON o.c = w.c AND o.pos > w.h),
q AS (SELECT w.c, coalesce(x.ks, []) AS ks, coalesce(x.bs, []) AS bs FROM w LEFT JOIN (SELECT c, list(k ORDER BY depth) AS ks, list(bytes ORDER BY depth) AS bs FROM t GROUP BY c) x ON x.c = w.c),
m AS (SELECT c, d, len(ks) AS n, md5(d || ':' || array_to_string(ks[1:d], chr(1))) AS node, CASE WHEN d > 0 THEN md5((d - 1) || ':' || array_to_string(ks[1:d - 1], chr(1))) END AS up, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS bytes FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM q)),
g AS (SELECT node, any_value(up) AS up, any_value(d) AS d, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d) AS ends FROM m GROUP BY node),
ch AS (SELECT up AS node, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY up), e AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN ch USING (node)),
z AS (SELECT DISTINCT a.node AS top, b.node AS node FROM m a JOIN m b ON a.c = b.c AND b.d >= a.d), s AS (SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM z JOIN e USING (node) GROUP BY top)
SELECT e.conv_id, e.d::BIGINT AS depth, p.conv_id AS parent_conv_id, e.n_convs::BIGINT AS n_convs, e.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256 FROM e JOIN s ON s.top = e.node LEFT JOIN e p ON p.node = e.up""",
    "op4_decontamination": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
b AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS w FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS k FROM i WHERE len(ws) > 0)),
s AS (SELECT DISTINCT n FROM b), p AS (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, s WHERE len(ws) >= n),
h AS (SELECT p.r, p.k, p.n, b.item_id FROM p JOIN b ON b.n = p.n AND b.w = array_to_string(p.ws[p.k:p.k + p.n - 1], ' ')),
hw AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS w FROM (SELECT DISTINCT r, k, n FROM h)) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)""",
}


def oracle_sql() -> dict[str, str]:
    return ORACLES
