"""Command line: search, find-related, index, file-types, savings, clear."""

from __future__ import annotations

import argparse
import datetime as dt
import os
import sys
import time

from pyspark.sql import functions as F

from siftlake.operators import search as S
from siftlake.operators.usage import read_log, usage_records, usage_report, write_log
from siftlake.session import build_session, file_system, remove_tree
from siftlake.snapshots import Snapshots, snapshot_root
from siftlake.sources.languages import KINDS, language_table
from siftlake.sources.tasks import results_json


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftlake")
    sub = p.add_subparsers(dest="command", required=True)

    def common(q, k: int = 5):
        q.add_argument("--content", nargs="+", choices=KINDS[:3], default=["code"])
        q.add_argument("-k", "--top-k", type=int, default=k)
        q.add_argument("--max-snippet-lines", type=int, default=None)
        q.add_argument("--format", choices=("json", "text"), default="json")

    q = sub.add_parser("search")
    q.add_argument("query")
    q.add_argument("paths", nargs="*", default=["."])
    common(q)
    q = sub.add_parser("find-related")
    q.add_argument("file")
    q.add_argument("line", type=int)
    q.add_argument("paths", nargs="*", default=["."])
    common(q)
    q = sub.add_parser("index")
    q.add_argument("paths", nargs="*", default=["."])
    q.add_argument("--content", nargs="+", choices=KINDS[:3], default=["code"])
    sub.add_parser("file-types")
    sub.add_parser("savings")
    q = sub.add_parser("clear")
    q.add_argument("what", choices=("all", "index", "savings", "orphans"), nargs="?", default="all")
    return p


def _log_path(spark) -> str:
    return f"{snapshot_root(spark)}/usage"


def _answer(index, ranked, query: str, call: str, args) -> str:
    rows = ranked.select("query_id", "rank", "chunk_id", "score").join(index.chunks, "chunk_id").orderBy("rank")
    found = rows.collect()  # at most top-k rows
    sizes = index.chunks.groupBy("file_path").agg(F.sum(F.octet_length("content")).alias("size"))
    if found:
        write_log(usage_records(rows, sizes, time.time(), call, args.max_snippet_lines), _log_path(index.chunks.sparkSession))
    if args.format == "json":
        return results_json(query, found, args.max_snippet_lines)
    return "\n\n".join(f"{r['file_path']}:{r['start_line']}-{r['end_line']}  ({r['score']:.4f})\n{r['content']}" for r in found) or "no results"


def run(argv: list[str], spark=None) -> str:
    args = _parser().parse_args(argv)
    spark = spark or build_session("siftlake-cli", **{"spark.log.level": "ERROR"})
    registry = Snapshots(spark)
    if args.command == "file-types":
        rows = language_table(spark).groupBy("content_type").agg(F.sort_array(F.collect_set("ext")).alias("e")).orderBy("content_type").collect()
        return "\n".join(f"{r['content_type']}: {' '.join(r['e'])}" for r in rows)
    if args.command == "savings":
        fs, at = file_system(spark, _log_path(spark))
        return usage_report(read_log(spark, _log_path(spark)), dt.datetime.now(dt.timezone.utc)) if fs.exists(at) else "nothing recorded yet"
    if args.command == "clear":
        if args.what in ("all", "savings"):
            remove_tree(spark, _log_path(spark))
        n = registry.clear(args.what == "orphans") if args.what != "savings" else 0
        return f"removed {n} snapshots"
    index = registry.get_all(args.paths, args.content)
    if args.command == "index":
        r = index.stats().first()
        return f"{r['indexed_files']} files, {r['total_chunks']} chunks, languages: {r['languages']}"
    if args.top_k < 1 or (args.max_snippet_lines or 0) < 0:
        raise ValueError("--top-k must be positive and --max-snippet-lines not negative")
    if args.command == "search":
        asked = spark.createDataFrame([(1, args.query)], "query_id bigint, query string")
        found = S.search(index, asked, k=args.top_k, rerank="code" in args.content)
        return _answer(index, found, args.query, "search", args)
    lookup = spark.createDataFrame([(args.file, args.line)], "path string, line int")
    seeds = S.resolve_chunk(index.chunks, lookup).select(F.lit(1).cast("bigint").alias("query_id"), "chunk_id")
    if seeds.isEmpty():
        raise ValueError(f"no chunk at {args.file}:{args.line}")
    return _answer(index, S.find_related(index, seeds, args.top_k), f"{args.file}:{args.line}", "find_related", args)


def main() -> int:
    try:
        print(run(sys.argv[1:]))
        return 0
    except (ValueError, FileNotFoundError, NotADirectoryError, RuntimeError) as error:
        print(error, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
