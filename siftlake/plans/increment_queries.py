"""Queries and SQL of the incremental operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators.increment import completed_ledger, files_to_process, subtract_ranges, _entries, _extent
from siftlake.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths the next index run must take up."""
    due = files_to_process(table(spark, sf_dir, "files"), table(spark, sf_dir, "manifest"), table(spark, sf_dir, "index_runs"))
    return due.select("path")


def p1_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed chunk positions per run, as disjoint intervals (in halves of a position)."""
    return completed_ledger(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "index_runs"))


def p1_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that entries lay claim to and no successful run completed."""
    manifest = table(spark, sf_dir, "manifest")
    claimed = _entries(manifest).select("run_id", *_extent())
    gaps = subtract_ranges(claimed, completed_ledger(manifest, table(spark, sf_dir, "index_runs")), ["run_id"])
    return gaps.select("run_id", (F.col("lo") / 2).cast("bigint").alias("first"), (F.col("hi") / 2).cast("bigint").alias("beyond"))


QUERIES = {"p1_found": p1_found, "p1_ledger": p1_ledger, "p1_gaps": p1_gaps}

_MERGED = """
claims AS (SELECT run_id, 2 * start AS lo, 2 * (start + count) AS hi FROM manifest
           WHERE mtime_ns IS NOT NULL AND start IS NOT NULL AND count IS NOT NULL AND run_id IN (SELECT run_id FROM index_runs WHERE {where})),
marked AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY run_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM claims),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM marked)
"""

ORACLE = {
    "p1_found": """
WITH now AS (SELECT path, arg_max(mtime_ns, seen_at) AS m FROM files GROUP BY path),
done AS (SELECT path, arg_max(mtime_ns, run_id) AS m FROM manifest JOIN (SELECT DISTINCT run_id FROM index_runs WHERE status = 'ok') USING (run_id)
         WHERE mtime_ns IS NOT NULL AND start IS NOT NULL AND count IS NOT NULL GROUP BY path)
SELECT now.path FROM now LEFT JOIN done ON now.path = done.path WHERE done.m IS NULL OR done.m IS DISTINCT FROM now.m""",
    "p1_ledger": "WITH "
    + _MERGED.format(where="status = 'ok'")
    + "SELECT run_id, CAST(min(lo) AS BIGINT) AS lo, CAST(max(hi) AS BIGINT) AS hi FROM grouped GROUP BY run_id, island",
    "p1_gaps": "WITH "
    + _MERGED.format(where="status <> 'ok'")
    + "SELECT run_id, CAST(min(lo) // 2 AS BIGINT) AS first, CAST(max(hi) // 2 AS BIGINT) AS beyond FROM grouped GROUP BY run_id, island",
}
