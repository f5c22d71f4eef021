"""Queries and SQL over source files (problems 5 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftlake.llm.distinctive import distinctive_terms, first_by_tfidf
from siftlake.llm.handwritten import classify_files
from siftlake.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 3 terms of every chunk by tf x ln(N / df), out of the operator's candidates."""
    scored = distinctive_terms(table(spark, sf_dir, "chunks"), "chunk_id", "content", top=10, by_tfidf=3)
    return first_by_tfidf(scored, "chunk_id", 3).select("chunk_id", "term")


def p5_distinctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 5 terms of every chunk by divergence."""
    return distinctive_terms(table(spark, sf_dir, "chunks"), "chunk_id", "content", top=5)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that nobody wrote by hand for the project."""
    return classify_files(table(spark, sf_dir, "chunks")).filter("NOT handwritten").select("file_path")


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with the reasons that speak against hand-written source."""
    return classify_files(table(spark, sf_dir, "chunks"))


def p6_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with its leaves and those that another repository has too: what speaks for a copy."""
    return classify_files(table(spark, sf_dir, "chunks")).select("file_path", "leaves", "common")


QUERIES = {"p5_found": p5_found, "p5_distinctive": p5_distinctive, "p6_found": p6_found, "p6_classes": p6_classes, "p6_shared": p6_shared}

_TERMS = """
WITH one AS (SELECT DISTINCT chunk_id, content FROM chunks WHERE chunk_id IS NOT NULL),
words AS (SELECT chunk_id, unnest(regexp_extract_all(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z_][a-z0-9_]*')) AS term FROM one),
tfs AS (SELECT chunk_id, term, count(*) AS tf FROM words GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tfs GROUP BY term),
lens AS (SELECT chunk_id, sum(tf) AS dl FROM tfs GROUP BY chunk_id),
sizes AS (SELECT count(*) AS n, CAST(sum(dl) AS DOUBLE) AS total FROM lens)
"""

ORACLE = {
    "p5_found": _TERMS
    + """, ranked AS (SELECT chunk_id, term, row_number() OVER (PARTITION BY chunk_id ORDER BY round(tf * ln(n / df), 6) DESC, term) AS r
FROM tfs JOIN dfs USING (term), sizes WHERE df >= 2)
SELECT chunk_id, term FROM ranked WHERE r <= 3""",
    "p5_distinctive": _TERMS
    + """, kls AS (SELECT chunk_id, term, CAST(tf AS INTEGER) AS tf, df, round(tf * ln(n / df), 6) AS tfidf,
  (tf + total / n * (cf / total)) / (dl + total / n) AS p, cf / total AS q FROM tfs JOIN dfs USING (term) JOIN lens USING (chunk_id), sizes WHERE df >= 2),
ranked AS (SELECT *, p * ln(p / q) AS kl, row_number() OVER (PARTITION BY chunk_id ORDER BY round(p * ln(p / q), 12) DESC, term) AS r FROM kls)
SELECT chunk_id, term, tf, df, kl, tfidf FROM ranked WHERE r <= 5""",
    "p6_shared": r"""
WITH one AS (SELECT DISTINCT chunk_id, replace(file_path, '\', '/') AS path, content FROM chunks WHERE chunk_id IS NOT NULL AND file_path IS NOT NULL),
cut AS (SELECT chunk_id, path, list_filter(list_transform(string_split(coalesce(content, ''), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) > 3) AS l FROM one),
windows AS (SELECT path, unnest(CASE WHEN len(l) < 3 THEN l ELSE list_transform(range(1, len(l) - 1), lambda i: l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2]) END) AS leaf FROM cut),
common AS (SELECT leaf FROM windows GROUP BY leaf HAVING count(DISTINCT split_part(path, '/', 1)) > 1),
per AS (SELECT path, count(*) AS leaves, count(common.leaf) AS common FROM windows LEFT JOIN common USING (leaf) GROUP BY path)
SELECT p.path AS file_path, CAST(coalesce(leaves, 0) AS BIGINT) AS leaves, CAST(coalesce(common, 0) AS BIGINT) AS common FROM (SELECT DISTINCT path FROM one) p LEFT JOIN per ON per.path = p.path""",
}
