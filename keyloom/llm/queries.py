"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import decontam, dedup, htmltext, jaccard, langid, licenses, lm, mixing, stages, tokencount, urlgraph
from keyloom.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.held_out)


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.lm_scores(docs, lm.held_out)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(table(spark, sf_dir, "pages"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_lm_scores, op3_jaccard_join, op4_license_scan, op5_exact_dedup, op6_token_counts, op7_decontamination, op8_html_text, op9_url_filter, op10_source_mix, pipeline)
    return {f.__name__: f for f in found}


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
classes AS (
  SELECT list_sort(s) AS s, min(doc_id) AS rep, any_value(len(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY 1),
shingles AS (SELECT rep, n, unnest(s) AS shingle FROM classes),
pairs AS (
  SELECT a.rep AS x, b.rep AS y, count(*) AS o, any_value(a.n) AS xn, any_value(b.n) AS yn
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs WHERE 100 * o >= 80 * (xn + yn - o) UNION ALL SELECT y, x FROM pairs WHERE 100 * o >= 80 * (xn + yn - o)),
reach(node, root) AS (
  SELECT rep, rep FROM classes
  UNION
  SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.node),
roots(x, root) AS (SELECT node, min(root) FROM reach GROUP BY node)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id
FROM sets d LEFT JOIN classes c ON list_sort(d.s) = c.s LEFT JOIN roots r ON r.x = c.rep
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": OP3_SQL, "op4_license_scan": licenses.oracle_sql(), "op5_exact_dedup": OP5_SQL}
