"""Queries and SQL over speed results and retriever scores (problems 4 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm.common import one_record
from siftlake.llm.outranking import agreed_front, outrank, rank_by_flow
from siftlake.llm.quantiles import build_sketches, element_values, exact_quantiles, merge_sketches, sketch_quantiles, tail_heavy_groups
from siftlake.session import scratch_table, table


def _latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_record(table(spark, sf_dir, "tool_results"), "result_id", ["tool", "repo", "latencies_ms", "recorded_at"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool and repo pairs whose 99th percentile is at least 8 times their median."""
    values = element_values(_latencies(spark, sf_dir), ["tool", "repo"], "latencies_ms")
    return tail_heavy_groups(values, ["tool", "repo"], 0.99, 0.5, 8.0).select("tool", "repo")


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and higher percentiles per tool and repo out of daily sketches.

    ``value`` is made exact from the records between the sketch's bounds; ``within`` tells
    whether the sketch's own bounds (four standard errors) hold it.
    """
    groups = ["tool", "repo"]
    values = scratch_table(element_values(_latencies(spark, sf_dir).withColumn("day", F.to_date("recorded_at")), [*groups, "day"], "latencies_ms"), "values")
    daily = build_sketches(values, [*groups, "day"])
    bounds = scratch_table(sketch_quantiles(merge_sketches(daily, groups), groups, [0.5, 0.9, 0.95, 0.99]), "bounds")
    exact = exact_quantiles(values, bounds, groups)
    same = [exact[c].eqNullSafe(bounds[c]) for c in (*groups, "p")]
    both = exact.join(bounds, [*same])
    return both.select(exact["tool"], exact["repo"], exact["n"], exact["p"], F.round("value", 6).alias("value"), ((F.col("value") >= F.col("lower")) & (F.col("value") <= F.col("upper"))).alias("within"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that every retriever puts in front: preferred to by fewer than 10 others in each list."""
    return agreed_front(outrank(table(spark, sf_dir, "retrieved"), threshold=0.0), 10).select("query_id", "chunk_id")


def p7_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every returned chunk with its net flow and place, and the first line of its text."""
    ranked = rank_by_flow(outrank(table(spark, sf_dir, "retrieved"))).select("query_id", F.col("position").cast("bigint").alias("position"), "chunk_id", F.round("net_flow", 6).alias("net_flow"))
    texts = one_record(table(spark, sf_dir, "chunks").select("chunk_id", F.substring_index("content", "\n", 1).alias("first_line")), "chunk_id", ["first_line"])
    return ranked.join(texts, "chunk_id", "left")


QUERIES = {"p4_found": p4_found, "p4_percentiles": p4_percentiles, "p7_found": p7_found, "p7_ranking": p7_ranking}

ORACLE = {
    "p4_found": """
WITH one AS (SELECT DISTINCT result_id, tool, repo, latencies_ms FROM tool_results WHERE result_id IS NOT NULL),
vals AS (SELECT tool, repo, unnest(latencies_ms) AS v FROM one)
SELECT tool, repo FROM vals WHERE v IS NOT NULL AND NOT isnan(v) AND v >= 0 GROUP BY tool, repo
HAVING quantile_cont(v, 0.99) >= 8 * quantile_cont(v, 0.5)""",
    "p4_percentiles": """
WITH one AS (SELECT DISTINCT result_id, tool, repo, latencies_ms FROM tool_results WHERE result_id IS NOT NULL),
vals AS (SELECT tool, repo, v FROM (SELECT tool, repo, unnest(latencies_ms) AS v FROM one) WHERE v IS NOT NULL AND NOT isnan(v) AND v >= 0),
ps AS (SELECT unnest([0.5, 0.9, 0.95, 0.99])::DOUBLE AS p),
agg AS (SELECT tool, repo, count(*) AS n, quantile_cont(v, [0.5, 0.9, 0.95, 0.99]) AS q FROM vals GROUP BY tool, repo)
SELECT tool, repo, n, unnest([0.5, 0.9, 0.95, 0.99])::DOUBLE AS p, round(unnest(q), 6) AS value, TRUE AS within FROM agg""",
    "p7_found": """
WITH best AS (SELECT query_id, chunk_id, retriever, max(score) AS s FROM retrieved WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
placed AS (SELECT *, rank() OVER (PARTITION BY query_id, retriever ORDER BY s DESC) - 1 AS higher FROM best),
lists AS (SELECT query_id, count(DISTINCT retriever) AS n FROM best GROUP BY query_id)
SELECT query_id, chunk_id FROM placed JOIN lists USING (query_id) GROUP BY query_id, chunk_id, n HAVING count(*) = n AND max(higher) < 10""",
    "p7_ranking": """
WITH best AS (SELECT query_id, chunk_id, retriever, max(score) AS s FROM retrieved
              WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL AND retriever IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
pct AS (SELECT *, count(*) OVER list AS n, (rank() OVER (list ORDER BY s) - 1 + count(*) OVER (PARTITION BY query_id, retriever, s) / 2.0) / count(*) OVER list AS x
        FROM best WINDOW list AS (PARTITION BY query_id, retriever)),
flows AS (SELECT a.query_id, a.chunk_id, a.retriever, sum(least(greatest((a.x - b.x) / 0.25, 0), 1) - least(greatest((b.x - a.x) / 0.25, 0), 1)) / greatest(any_value(a.n) - 1, 1) AS flow
          FROM pct a JOIN pct b USING (query_id, retriever) GROUP BY ALL),
lists AS (SELECT query_id, count(DISTINCT retriever) AS m FROM best GROUP BY query_id),
net AS (SELECT query_id, chunk_id, (sum(flow) - (m - count(*))) / m AS f FROM flows JOIN lists USING (query_id) GROUP BY query_id, chunk_id, m),
ranked AS (SELECT query_id, chunk_id, round(f, 6) AS net_flow, row_number() OVER (PARTITION BY query_id ORDER BY round(f, 9) DESC, chunk_id) AS position FROM net),
texts AS (SELECT chunk_id, max(split_part(content, chr(10), 1)) AS first_line FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id)
SELECT query_id, position, ranked.chunk_id, net_flow, first_line FROM ranked LEFT JOIN texts ON ranked.chunk_id = texts.chunk_id""",
}
