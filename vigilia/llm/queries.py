"""The registered queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigilia.llm.common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilia.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"], "html")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilia.llm.warc import archive, page_ids

    return page_ids(archive(table(spark, sf_dir, "pages"), "page_id", "url", "html", payload=False), "page_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vigilia.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilia.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilia.llm.language import identify

    return identify(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilia.llm.quality import fit_rules, judge

    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit_rules(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality"), "doc_id", "text")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilia.llm.lm import score_corpus

    return score_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilia.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text")


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilia.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilia.llm.sharding import shard_records

    return shard_records(table(spark, sf_dir, "documents"), "doc_id", "text", 40)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vigilia.llm.alignment import align_corpus

    return align_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilia.llm.suffixes import drop_repeats

    return drop_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilia.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS sha,
             max(page_id) OVER (PARTITION BY body) AS keep FROM p),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((((('0x' || substr(sha, CAST(5 * (i // 4) + 1 AS BIGINT), 5))::BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1)::BIGINT, 1)), '') AS payload_digest FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to,
       CASE WHEN page_id = keep THEN true END AS digest_ok
FROM b
"""


OP13_SQL = """
WITH said AS (
  SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT CAST(b AS UBIGINT) AS b, list_reduce(list_prepend(CAST(b AS UBIGINT), [CAST(i AS UBIGINT) FOR i IN range(8)]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END) AS t FROM range(256) r(b)),
crc AS (SELECT list(t ORDER BY b) AS t FROM bits),
known AS (
  SELECT conv, conv - conv % 20 AS source,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, [CAST(ascii(d) AS UBIGINT) FOR d IN string_split(CAST(conv AS VARCHAR), '')]), lambda x, y: xor(x >> 8, any_t[CAST(xor(x, y) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv FROM said), (SELECT t AS any_t FROM crc)),
led AS (SELECT k.conv, s.place AS depth, s.role, s.text FROM known k JOIN said s ON s.conv = k.source AND s.place <= k.h),
own AS (SELECT k.conv, s.place - k.h + coalesce(t.n, 0) AS depth, s.role, s.text
        FROM known k JOIN said s ON s.conv = k.conv AND s.place > k.h LEFT JOIN (SELECT conv, count(*) AS n FROM led GROUP BY conv) t ON t.conv = k.conv),
turns AS (SELECT * FROM led UNION ALL SELECT * FROM own),
step AS (SELECT conv, CAST(depth AS BIGINT) AS depth, length(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words,
                sha256(concat(strlen(role), ':', role, text)) AS h FROM turns),
paths AS (SELECT conv, depth, words, sha256(string_agg(h, '') OVER (PARTITION BY conv ORDER BY depth)) AS name FROM step
          UNION ALL SELECT conv, 0, 0, '' FROM known),
tops AS (SELECT conv, max(depth) AS last FROM paths GROUP BY conv),
nodes AS (SELECT p.depth, p.name, min(p.conv) AS conv_id, count(*) AS n_convs, any_value(p.words) AS words,
                 sha256(coalesce(string_agg(CAST(p.conv AS VARCHAR), ',' ORDER BY p.conv) FILTER (WHERE t.last = p.depth), '')) AS ends_sha256
          FROM paths p JOIN tops t USING (conv) GROUP BY p.depth, p.name),
edges AS (SELECT DISTINCT a.depth AS above_depth, a.name AS above, b.depth, b.name FROM paths a JOIN paths b ON a.conv = b.conv AND b.depth >= a.depth),
kids AS (SELECT above_depth AS depth, above AS name, count(*) AS n_children FROM edges WHERE depth = above_depth + 1 GROUP BY 1, 2),
sums AS (SELECT e.above_depth AS depth, e.above AS name, count(*) FILTER (WHERE k.name IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
         FROM edges e JOIN nodes n ON n.depth = e.depth AND n.name = e.name LEFT JOIN kids k ON k.depth = e.depth AND k.name = e.name GROUP BY 1, 2)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.name = n.name LEFT JOIN kids k ON k.depth = n.depth AND k.name = n.name
LEFT JOIN edges e ON e.depth = n.depth AND e.name = n.name AND e.above_depth = n.depth - 1 LEFT JOIN nodes u ON u.depth = e.above_depth AND u.name = e.above
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op13_prefix_trie": OP13_SQL}
