"""Queries that once stopped short of the whole job, on small tables beyond the old bound."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.plans import registry


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """80 files with the same keyword; what the query looks for stands in the last of them."""
    at = str(tmp_path_factory.mktemp("many"))
    files = [(f"f{i:02}.py:0", f"def tokenizer_{i:02}(): tokenizer", f"src/f{i:02}.py", 1, 1, "python") for i in range(80)]
    spark.createDataFrame(files, "chunk_id string, content string, file_path string, start_line int, end_line int, language string").write.parquet(f"{at}/chunks.parquet")
    tasks = [(1, "where is the tokenizer", "python", "r", None, [("src/f79.py", None, None)]), (2, "tokenizer", "python", "r", None, [("src/gone.py", None, None)])]
    spark.createDataFrame(tasks, "task_id int, query string, language string, repo string, category string, targets array<struct<path string, start_line int, end_line int>>").write.parquet(f"{at}/tasks.parquet")
    spark.createDataFrame([(1, "semantic", "f79.py:0", 0.9)], "query_id int, retriever string, chunk_id string, score double").write.parquet(f"{at}/retrieved.parquet")
    return at


def test_keyword_baseline_ranks_every_file(spark, many_files):
    ranked = registry.queries()["grep_keyword_rank"](spark, many_files).collect()
    assert sorted((r["query_id"], r["rank"], r["file_path"]) for r in ranked) == [(q, i + 1, f"src/f{i:02}.py") for q in (1, 2) for i in range(80)]


def test_first_hit_is_looked_for_in_every_file(spark, many_files):
    (r,) = registry.queries()["paired_reduction"](spark, many_files).collect()
    assert (r["n_paired"], r["better"]) == (1, 1.0) and r["median_reduction"] == pytest.approx(1 - 1 / 80)


def test_related_chunks_are_asked_in_the_middle_of_files_too(spark, tmp_path):
    v = np.random.default_rng(4).normal(size=(300, 64)).astype("f4")
    names = [f"src/a{i:03}.py:{i}" for i in range(300)]
    rows = [(c, "x = 1", c.split(":")[0], 5, 6, "python") for c in names]
    spark.createDataFrame(rows, "chunk_id string, content string, file_path string, start_line int, end_line int, language string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(c, x.tolist()) for c, x in zip(names, v)], "chunk_id string, v array<float>").write.parquet(f"{tmp_path}/vectors.parquet")
    number = {c: int(hashlib.md5(c.encode()).hexdigest()[:12], 16) for c in names}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = u @ u.T - 3 * np.eye(300)
    want = {(number[c], names[j]) for i, c in enumerate(names) if number[c] % 50 == 0 for j in np.argsort(-sims[i])[:5]}
    got = registry.queries()["find_related"](spark, str(tmp_path)).collect()
    assert want and {(r["query_id"], r["chunk_id"]) for r in got} == want


def test_keyword_ranking_is_not_sorted_outside_its_tasks(spark, many_files):
    plan = registry.queries()["grep_keyword_rank"](spark, many_files)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_first_hit_of_several_covering_files(spark):
    from siftlake.operators import evaluate as E

    chunks = spark.createDataFrame([(f"s/f{i}.py", "alpha " * (i + 1) + ("beta" if i in (2, 4) else "")) for i in range(6)], "file_path string, content string")
    files = spark.createDataFrame([(f"s/f{i}.py", 1, 9, 40 * (i + 1)) for i in range(6)], "file_path string, start_line int, end_line int, chars long")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, "gamma")], "query_id bigint, query string")
    targets = spark.createDataFrame([(1, 0, "s/f5.py", None, None), (1, 1, "s/f4.py", None, None), (2, 0, "s/f1.py", 2, 3), (3, 0, "s/f1.py", None, None)], "query_id bigint, target int, path string, start int, end int")
    got = E.keyword_first_hits(asked, chunks, files, targets, [], 99)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    ranked = E.keyword_ranking(asked, chunks, []).join(files, "file_path")
    whole = E.first_hits(E.coverage_curve(ranked.selectExpr("*", "start_line AS s"), targets, F.expr("chars div 4")), targets, 99)
    rows = lambda df: sorted((r["query_id"], r["tokens"], r["found"]) for r in df.collect())
    assert rows(got) == rows(whole) == [(1, 80, True), (2, 30, True), (3, 99, False)]
