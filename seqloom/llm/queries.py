"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import (
    boilerplate,
    conversations,
    exact_dedup,
    language,
    mixing,
    neighbours,
    ngram_join,
    packing,
    periodic_runs,
    privacy,
    quality,
    secrets,
    token_shards,
)
from seqloom.llm.shared import table


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mixture(table(spark, folder, "documents"))
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("shards")).alias("taken"),
        "source",
        "shards",
        "places",
    )


def op2_privacy(spark: SparkSession, folder: str) -> DataFrame:
    return privacy.find_personal_data(table(spark, folder, "documents"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.predict(docs, language.train(docs))


def op5_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return token_shards.write_shards(docs, token_shards.shard_folder(spark))


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(table(spark, folder, "documents"))


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, folder, "documents"))


def op8_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, folder, "embeddings"))


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


def op10_boilerplate(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.drop_boilerplate(table(spark, folder, "pages"))


def op11_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.damaged_and_repaired(table(spark, folder, "conversations"))


def op12_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.train(docs, table(spark, folder, "labels")))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, folder, "documents"), repeat_tails=True)


OP7_SQL = """
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
), sets AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]
            for i in range(1, len(w) - 2)])) END AS s
    FROM words
), flat AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets
), links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.h = b.h AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id, doc_id AS other FROM sets
    UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), lowest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id,
    CASE WHEN len(s) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY s) END AS class_size
FROM sets JOIN lowest USING (doc_id)
"""

OP9_SQL = """
WITH n AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_chars,
        regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS body
    FROM documents
), r AS (
    SELECT doc_id, body,
        first_value(doc_id) OVER (PARTITION BY body ORDER BY n_chars DESC, doc_id NULLS LAST) AS keep_id,
        count(*) OVER (PARTITION BY body) AS group_size
    FROM n
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept,
    sha256(body) AS text_sha256
FROM r
"""


OP10_SQL = f"""
WITH cut AS (
    SELECT row_number() OVER () AS n, page_id,
        lower(regexp_extract(coalesce(url, ''), '{boilerplate.HOST}', 1)) AS host,
        [y for y in [trim(regexp_replace(x, '{boilerplate.TAG}', '', 'g'), ' ')
            for x in string_split_regex(coalesce(html, ''), '{boilerplate.BREAK}')] if y <> ''] AS lines
    FROM pages
), totals AS (SELECT host, count(*) AS pages FROM cut GROUP BY host
), seen AS (
    SELECT host, line, count(*) AS n
    FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM cut) GROUP BY host, line
), common AS (
    SELECT host, list(line) AS common FROM seen JOIN totals USING (host)
    WHERE n >= {boilerplate.LEAST_PAGES} AND n > {boilerplate.RATIO} * pages GROUP BY host
), kept AS (
    SELECT page_id, host, lines,
        [x for x in lines if NOT list_contains(coalesce(common, []), x)] AS kept
    FROM cut LEFT JOIN common USING (host)
)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
    coalesce(array_to_string(kept, chr(10)), '') AS text
FROM kept
"""


def queries() -> dict:
    listed = (
        op1_mixing,
        op2_privacy,
        op3_packing,
        op4_language,
        op5_token_shards,
        op6_secrets,
        op7_ngram_join,
        op8_neighbours,
        op9_exact_dedup,
        op10_boilerplate,
        op11_conversations,
        op12_quality,
        op13_periodic_runs,
    )
    return {query.__name__: query for query in listed}


def oracle_sql() -> dict[str, str]:
    return {"op7_ngram_join": OP7_SQL, "op9_exact_dedup": OP9_SQL, "op10_boilerplate": OP10_SQL}
