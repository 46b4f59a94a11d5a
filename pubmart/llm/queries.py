"""The registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pubmart.llm import (
    ann,
    bpe,
    chunks,
    hard_negatives,
    lm_score,
    near_dups,
    packing,
    pii,
    prefix_trie,
    quality,
    spotsigs,
    toxicity,
    url_filter,
)
from pubmart.llm.common import table


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_pairs(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path(packing.VOCABULARY))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encoded(table(spark, sf_dir, "documents"), tokenizer_path(bpe.FILE), public_tokenizers.PATTERN)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, ann.every_twentieth(vectors))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lm_scores,
        op2_url_filters,
        op3_fingerprints,
        op4_substring_dedup,
        op5_quality,
        op6_near_duplicates,
        op7_packing,
        op8_pii,
        op9_byte_bpe,
        op10_nearest_neighbours,
        op11_prefix_trie,
        op12_toxicity,
        op13_hard_negatives,
    )
}

OP2_SQL = r"""
WITH parts AS (
    SELECT page_id,
           translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), rules(action, rule_host, rule_path) AS (
    VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
           ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fitting AS (
    SELECT host, path, arg_max(action, length(rule_host || rule_path)) AS action,
           arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule
    FROM (SELECT DISTINCT host, path FROM parts)
    JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY host, path
)
SELECT page_id, parts.host, parts.path, rule,
       coalesce(action, CASE WHEN parts.host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fitting ON parts.host = fitting.host AND parts.path = fitting.path
"""

OP11_SQL = """
WITH RECURSIVE turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place,
           coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    -- crc32 of the id's decimal digits, a bit at a time
    SELECT conv_id, count(*) AS n,
           xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
               lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, step:
                   CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 6 AS head
    FROM turns GROUP BY conv_id
), rebuilt AS (
    SELECT conv_id, place, role, text FROM convs JOIN turns USING (conv_id) WHERE place >= head
    UNION ALL
    SELECT c.conv_id, t.place - 1000000, t.role, t.text
    FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.place < c.head
), steps AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, length(text) AS size,
           sha256(length(role) || ':' || role || text) AS unit
    FROM rebuilt
), paths AS (
    SELECT conv_id, 0 AS depth, 0 AS size, '' AS path FROM convs
    UNION ALL
    SELECT conv_id, depth, size, string_agg(unit, '') OVER (PARTITION BY conv_id ORDER BY depth) FROM steps
), ends AS (
    SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id
), nodes AS (
    SELECT path, any_value(p.depth) AS depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(CAST(e.conv_id AS VARCHAR), ',' ORDER BY e.conv_id), '')) AS ends_sha256
    FROM paths p LEFT JOIN ends e USING (conv_id, depth) GROUP BY path
), shape AS (
    SELECT n.path, n.depth, n.conv_id, n.n_convs, n.ends_sha256, (n.n_convs - 1) * n.size AS saved,
           any_value(up.conv_id) AS parent_conv_id, count(down.path) AS n_children
    FROM nodes n
    LEFT JOIN nodes up ON n.depth > 0 AND up.path = left(n.path, 64 * (n.depth - 1))
    LEFT JOIN nodes down ON down.depth = n.depth + 1 AND left(down.path, 64 * n.depth) = n.path
    GROUP BY ALL
)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, a.parent_conv_id, a.n_convs, a.n_children,
       CAST(count(*) FILTER (WHERE b.n_children = 0) AS BIGINT) AS n_leaves,
       CAST(sum(b.saved) AS BIGINT) AS saved_tokens, a.ends_sha256
FROM shape a JOIN (SELECT s.*, unnest(range(s.depth + 1)) AS above FROM shape s) b
     ON b.above = a.depth AND left(b.path, 64 * a.depth) = a.path
GROUP BY ALL
"""

OP13_SQL = """
WITH vectors AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS whole
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.id AS anchor_id, b.id AS other_id, a.label = b.label AS same,
           CAST(list_dot_product(a.whole, b.whole) AS BIGINT) AS score
    FROM vectors a JOIN vectors b ON a.id <> b.id
    WHERE a.id % 100 = 0
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score
    FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

ORACLES: dict[str, str] = {
    "op2_url_filters": OP2_SQL.strip(),
    "op11_prefix_trie": OP11_SQL.strip(),
    "op13_hard_negatives": OP13_SQL.strip(),
}
