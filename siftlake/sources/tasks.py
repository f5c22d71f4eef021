"""Annotated queries and repository lists from JSON files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.text import infer_category

_TASK = "struct<query:string,category:string,language:string,relevant:array<string>,secondary:array<string>>"


def read_tasks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per task: ``repo, position, query, category, targets``.

    The repository is the file's name. A target is a path or an object with a path and
    possibly a span; primary targets come before secondary ones.
    """
    raw = spark.read.option("wholetext", True).text(paths)
    repo = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    parsed = raw.select(repo.alias("repo"), F.posexplode(F.from_json("value", f"array<{_TASK}>")).alias("position", "t"))
    # An object stays JSON text when read as a string, a plain path stays a path.
    number = lambda t, k: F.get_json_object(t, f"$.{k}").cast("int")
    target = lambda t: F.struct(F.coalesce(F.when(F.startswith(t, F.lit("{")), F.get_json_object(t, "$.path")), t).alias("path"), number(t, "start_line").alias("start_line"), number(t, "end_line").alias("end_line"))
    targets = F.transform(F.concat(F.coalesce("t.relevant", F.array().cast("array<string>")), F.coalesce("t.secondary", F.array().cast("array<string>"))), target)
    return parsed.select("repo", "position", "t.query", "t.category", targets.alias("targets"))


def read_repos(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, language string, url string, revision string, benchmark_root string").option("multiLine", True).json(path)


def with_repositories(tasks: DataFrame, repos: DataFrame) -> DataFrame:
    """Tasks of the repositories that are at hand: ``repo, query, category, targets, language``.

    The language is that of the repository (``repos``: name, language); a task without a
    category gets it from its query. Tasks of other repositories are left out.
    """
    known = repos.select(F.col("name").alias("repo"), F.col("language").alias("_language")).dropDuplicates(["repo"])
    joined = tasks.join(known, "repo")
    return joined.withColumns({"language": F.col("_language"), "category": F.coalesce("category", infer_category(F.col("query")))}).drop("_language")


def filter_tasks(tasks: DataFrame, repos: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """Tasks of any of the repositories and any of the languages; None or nothing is no filter."""
    for column, wanted in (("repo", repos), ("language", languages)):
        tasks = tasks.filter(F.col(column).isin(wanted)) if wanted else tasks
    return tasks


def results_json(query: str, rows: list, lines: int | None = None) -> str:
    """A result set as JSON text; ``lines`` as for snippets."""
    def shown(text: str) -> str:
        return text if lines is None else "\n".join(text.splitlines()[:lines])

    results = [{"location": f"{r['file_path']}:{r['start_line']}-{r['end_line']}", "score": r["score"], **({} if lines == 0 else {"content": shown(r["content"])})} for r in rows]
    return json.dumps({"query": query, "results": results}, ensure_ascii=False)
