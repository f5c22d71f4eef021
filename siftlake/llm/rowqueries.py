"""Queries and SQL over scores and vectors (problems 2 and 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm.neighbours import nearest_neighbours
from siftlake.llm.topn import holding_scores, top_n_per_group
from siftlake.session import table


def _best_chunks(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    held = holding_scores(table(spark, sf_dir, "scored"), "query_id", "chunk_id", "scored_at", "score", ["start_line"])
    return top_n_per_group(held, "query_id", "score", n, ["start_line", "chunk_id"], placed=True)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 10 chunks of every query."""
    return _best_chunks(spark, sf_dir, 10).select("query_id", "chunk_id")


def p2_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 chunks of every query with their place and score."""
    return _best_chunks(spark, sf_dir, 25).select("query_id", "position", "chunk_id", "score")


#: Recall asked for of near-equal vectors, and of the nearest however far they are.
CLOSE_RECALL, ANY_RECALL = 0.9995, 0.93


def _similar(spark: SparkSession, sf_dir: str, k: int, min_cosine: float, recall: float, report: dict | None = None) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "vectors"), "chunk_id", "v", k, min_cosine, recall, report=report)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with cosine 0.80 or more of which one is among the 5 nearest of the other."""
    near = _similar(spark, sf_dir, 5, 0.8, CLOSE_RECALL)
    return near.select(F.least("chunk_id", "near").alias("chunk_id_a"), F.greatest("chunk_id", "near").alias("chunk_id_b")).distinct()


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every chunk vector its 5 nearest, however far, with cosine."""
    return _similar(spark, sf_dir, 5, -1.0, ANY_RECALL)


def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether held-out queries, answered by brute force over all rows, find nine of ten of their 5 nearest."""
    report: dict = {}
    _similar(spark, sf_dir, 5, -1.0, ANY_RECALL, report)
    return spark.createDataFrame([(5, report.get("recall", 1.0) >= 0.9)], "k int, reached boolean")


QUERIES = {"p2_found": p2_found, "p2_ranked": p2_ranked, "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p3_recall": p3_recall}

_HELD = """
WITH held AS (SELECT query_id, chunk_id, arg_max(struct_pack(s := score, l := start_line), scored_at) AS x FROM scored
              WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY query_id, chunk_id),
ranked AS (SELECT query_id, chunk_id, x.s AS score, row_number() OVER (PARTITION BY query_id ORDER BY x.s DESC, x.l NULLS LAST, chunk_id) AS position
           FROM held WHERE x.s IS NOT NULL AND NOT isnan(x.s))
"""

ORACLE = {
    "p3_recall": "SELECT 5 AS k, TRUE AS reached",
    "p2_found": _HELD + "SELECT query_id, chunk_id FROM ranked WHERE position <= 10",
    "p2_ranked": _HELD + "SELECT query_id, CAST(position AS INTEGER) AS position, chunk_id, score FROM ranked WHERE position <= 25",
    "p3_found": """
WITH one AS (SELECT DISTINCT chunk_id, CAST(v AS DOUBLE[]) AS v FROM vectors WHERE v IS NOT NULL
             AND len(list_filter(v, lambda x: isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
sims AS (SELECT a.chunk_id AS a, b.chunk_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS c FROM one a, one b WHERE a.chunk_id <> b.chunk_id),
top AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM sims) WHERE r <= 5 AND c >= 0.8)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM top""",
}
