"""Queries and SQL of the usage log, evaluation, chunking and scanning."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.text import STOPWORDS, is_git_url
from siftlake.operators import chunking as C
from siftlake.operators import evaluate as E
from siftlake.operators import usage as U
from siftlake.operators.index import prepare_chunks
from siftlake.operators.search import top_k
from siftlake.plans import sql as Q
from siftlake.plans.search_queries import _tasks
from siftlake.session import scratch_path, scratch_table, table
from siftlake.sources.files import file_status
from siftlake.sources.ignore import is_ignored, parse
from siftlake.sources.languages import language_rows, language_table, suffix, with_language
from siftlake.sources.tasks import filter_tasks, with_repositories
from siftlake.streaming.usage import daily_usage, stream_log

NOW = dt.datetime(2024, 1, 29, 12)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a usage log."""
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0))
    return e.select(
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").alias("call"), F.lit(1).alias("results"),
        (k * 10).alias("snippet_chars"), F.floor(F.col("value") * 10).cast("bigint").alias("file_chars"),
    ).withColumn("ts", F.col("us") / 1_000_000)


def savings_buckets(spark, sf_dir):
    log = _log(spark, sf_dir)
    return U.savings_buckets(log, NOW, F.to_date(F.timestamp_micros("us")))


def call_type_share(spark, sf_dir):
    return U.call_shares(_log(spark, sf_dir)).select("call", "calls", F.round("share", 9).alias("share"))


def usage_daily(spark, sf_dir):
    events = _log(spark, sf_dir).withColumn("at", F.timestamp_micros("us"))
    return daily_usage(events).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "call", "calls", "snippet_chars", "file_chars", "saved_chars")


def usage_stream(spark, sf_dir):
    """The same by day, through the log sink, the file stream and a streaming aggregation."""
    at = scratch_path(spark, "log")
    U.write_log(_log(spark, sf_dir).select("ts", "call", "results", "snippet_chars", "file_chars"), f"{at}/log")
    name = "usage_" + at.rsplit("-", 1)[-1]
    run = daily_usage(stream_log(spark, f"{at}/log")).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "call", "calls", "snippet_chars", "file_chars", "saved_chars")


#: Each retriever's list for a query is judged for itself: a run is 3 * query_id + place of the retriever.
RETRIEVERS = ["bm25", "grep", "semantic"]


def _runs(df, query="query_id"):
    """Every row once for each retriever, with the number of the run for that of the query."""
    run = F.explode(F.array(*[(F.col(query).cast("bigint") * len(RETRIEVERS) + i) for i in range(len(RETRIEVERS))]))
    return df.withColumn("_run", run).drop(query).withColumnRenamed("_run", query)


def _results(spark, sf_dir, n=50):
    """The held results of every run, ranked, with their chunks."""
    held = table(spark, sf_dir, "retrieved").filter(F.expr("score IS NOT NULL AND NOT isnan(score)") & F.col("retriever").isin(RETRIEVERS))
    run = F.col("query_id").cast("bigint") * len(RETRIEVERS) + F.array_position(F.array(*[F.lit(r) for r in RETRIEVERS]), F.col("retriever")) - 1
    held = held.groupBy(run.alias("query_id"), "chunk_id").agg(F.max("score").alias("score"))
    chunks = prepare_chunks(table(spark, sf_dir, "chunks")).select("chunk_id", "file_path", "start_line", "end_line", "content")
    return top_k(held, n).join(chunks, "chunk_id")


def _targets(spark, sf_dir):
    return _runs(E.task_targets(table(spark, sf_dir, "tasks")))


def span_overlap_join(spark, sf_dir):
    return E.span_hits(_results(spark, sf_dir), _targets(spark, sf_dir))


def ndcg_at_10(spark, sf_dir):
    return E.ndcg(_results(spark, sf_dir), _targets(spark, sf_dir), 10).select("query_id", F.round("ndcg", 9).alias("ndcg"))


def ndcg_by_category(spark, sf_dir):
    scores = E.ndcg(_results(spark, sf_dir), _targets(spark, sf_dir), 10)
    return E.by_category(scores, _runs(table(spark, sf_dir, "tasks"), "task_id")).select("category", F.round("ndcg", 9).alias("ndcg"), "queries")


def ndcg_macro(spark, sf_dir):
    scores = scratch_table(E.ndcg(_results(spark, sf_dir), _targets(spark, sf_dir), 10), "ndcg")
    return E.macro_average(scores, _runs(table(spark, sf_dir, "tasks"), "task_id")).select(*[F.round(c, 9).alias(c) for c in ("macro", "median", "p90", "p95", "p99")])


def ndcg_by_language(spark, sf_dir):
    scores = E.ndcg(_results(spark, sf_dir), _targets(spark, sf_dir), 10)
    return E.by_language(scores, _runs(table(spark, sf_dir, "tasks"), "task_id")).select("language", F.round("ndcg", 9).alias("ndcg"), "queries")


def _curve(spark, sf_dir):
    return E.coverage_curve(_results(spark, sf_dir), _targets(spark, sf_dir))


def coverage_curve(spark, sf_dir):
    return _curve(spark, sf_dir)


def recall_at_budget(spark, sf_dir):
    return E.recall_at(_curve(spark, sf_dir), _targets(spark, sf_dir), [500, 1000, 2000, 4000, 8000, 16_000, 32_000]).select("budget", F.round("recall", 9).alias("recall"))


def tokens_first_hit(spark, sf_dir):
    return E.first_hits(_curve(spark, sf_dir), _targets(spark, sf_dir), 32_000)


def grep_keyword_rank(spark, sf_dir):
    """Every file that has a keyword of the query, ranked."""
    chunks = prepare_chunks(table(spark, sf_dir, "chunks"))
    return E.keyword_ranking(_tasks(spark, sf_dir), chunks, STOPWORDS).select("query_id", "rank", "file_path", "hits")


def paired_reduction(spark, sf_dir):
    """Tokens to the first hit: ranked chunks against reading whole files by keyword.

    The first hit is looked for in all ranked files. Queries of which no file covers a
    target are never found, so their files need no ranking.
    """
    chunks, targets = prepare_chunks(table(spark, sf_dir, "chunks")), E.task_targets(table(spark, sf_dir, "tasks"))
    whole = chunks.groupBy("file_path").agg(F.sum(F.length("content")).alias("chars"), F.lit(1).alias("start_line"), F.max("end_line").alias("end_line"))
    other = E.keyword_first_hits(_tasks(spark, sf_dir), chunks, whole, targets, STOPWORDS, 32_000)
    out = E.paired_reduction(E.first_hits(_curve(spark, sf_dir), _runs(targets), 32_000), _runs(other))
    return out.select("n_paired", *[F.round(c, 9).alias(c) for c in ("median_reduction", "mean_reduction", "better")])


def savings_of_results(spark, sf_dir):
    sizes = table(spark, sf_dir, "files").groupBy(F.col("path").alias("file_path")).agg(F.max("size").alias("size"))
    return U.usage_records(_results(spark, sf_dir, 5), sizes, 0.0, lines=10).groupBy("call").agg(F.count("*").alias("records"), F.sum("results").alias("results"), F.sum("snippet_chars").alias("snippet_chars"), F.sum("file_chars").alias("file_chars"))


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")


def chunk_lines(spark, sf_dir):
    return C.chunk_lines(_documents(spark, sf_dir)).select("path", "slot", "start_line", "end_line", F.length("content").alias("chars"), F.md5("content").alias("digest"))


def syntax_chunks(spark, sf_dir):
    """Every file put together again from its chunks, then cut by syntax or lines."""
    chunks = prepare_chunks(table(spark, sf_dir, "chunks"))
    files = chunks.groupBy(F.col("file_path").alias("path"), "language").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "chunk_id", "content"))), lambda c: c["content"]), "\n").alias("text"))
    return C.chunk_syntax(files).select("path", "slot", "start_line", "end_line", F.length("content").alias("chars"))


def language_of_files(spark, sf_dir):
    files = table(spark, sf_dir, "files").select("path").distinct()
    return with_language(files).select("path", "ext", F.col("language").alias("by_suffix"), "content_type")


def ext_by_content(spark, sf_dir):
    dim = language_table(spark)
    return dim.groupBy("content_type").agg(F.sort_array(F.collect_set("ext")).alias("exts"))


def file_states(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", file_status(F.octet_length(F.coalesce("text", F.lit(""))), F.col("text")).alias("status"))


def git_urls(spark, sf_dir):
    repos = table(spark, sf_dir, "tasks").select("repo").distinct()
    forms = F.array(F.col("repo"), F.concat(F.lit("https://example.org/"), "repo"), F.concat(F.lit("git@example.org:x/"), "repo"), F.concat(F.lit("/src/"), "repo"))
    return repos.select(F.explode(forms).alias("source")).select("source", is_git_url(F.col("source")).alias("git"))


def task_filters(spark, sf_dir):
    """Tasks joined with their repositories, of three languages."""
    tasks = table(spark, sf_dir, "tasks").select("task_id", "repo", "query", "category", F.size("targets").alias("targets")).distinct()
    repos = table(spark, sf_dir, "files").groupBy(F.col("repo").alias("name")).agg(F.max("language").alias("language")).filter("name IS NOT NULL")
    return filter_tasks(with_repositories(tasks, repos), languages=["rust", "typescript", "ruby"]).select("task_id", "repo", "language", "category", "targets")


def ignore_eval(spark, sf_dir):
    """Which files a set of ignore rules leaves out."""
    rules = parse(["tests/", "*.rb", "!keep_*.rb", "/*/docs/**", "**/internal/*.go", "[a-c]*-kit/"])
    paths = table(spark, sf_dir, "files").select("path").filter("path IS NOT NULL").distinct()

    def run(batches):
        import pandas as pd

        def one(path: str) -> bool:
            parts = path.split("/")
            return any(is_ignored("/".join(parts[:i]), i < len(parts), rules)[0] for i in range(1, len(parts) + 1))

        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"path": pdf["path"], "ignored": [one(p) for p in pdf["path"]]})

    return paths.mapInPandas(run, "path string, ignored boolean")


QUERIES = {
    f.__name__: f
    for f in (
        savings_buckets, call_type_share, usage_daily, usage_stream, span_overlap_join, ndcg_at_10, ndcg_by_category, ndcg_by_language, ndcg_macro, coverage_curve, recall_at_budget,
        tokens_first_hit, grep_keyword_rank, paired_reduction, savings_of_results, chunk_lines, syntax_chunks, language_of_files, ext_by_content, file_states, git_urls, ignore_eval, task_filters,
    )
}

_LOG = """log AS (SELECT CAST(ts AS DATE) AS day, event_type AS call, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) * 10 AS snippet_chars,
CAST(floor(value * 10) AS BIGINT) AS file_chars FROM events)"""
_DAILY = f"""WITH {_LOG} SELECT strftime(day, '%Y-%m-%d') AS day, call, count(*) AS calls, CAST(sum(snippet_chars) AS BIGINT) AS snippet_chars, CAST(sum(file_chars) AS BIGINT) AS file_chars,
CAST(sum(greatest(0, file_chars - snippet_chars)) AS BIGINT) AS saved_chars FROM log GROUP BY ALL"""
_RESULTS = f"""{Q.CHUNKS},
held AS (SELECT CAST(query_id AS BIGINT) * 3 + list_position(['bm25', 'grep', 'semantic'], retriever) - 1 AS query_id, chunk_id, max(score) AS score FROM retrieved
  WHERE score IS NOT NULL AND NOT isnan(score) AND retriever IN ('bm25', 'grep', 'semantic') GROUP BY ALL),
topped AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM held),
results AS (SELECT query_id, rank, one.* FROM topped JOIN one USING (chunk_id) WHERE rank <= 50),
flat AS (SELECT DISTINCT task_id AS query_id, generate_subscripts(targets, 1) - 1 AS target, unnest(targets) AS t FROM (SELECT DISTINCT task_id, targets FROM tasks)),
ptargets AS (SELECT query_id, CAST(target AS INTEGER) AS target, replace(t.path, '\\', '/') AS path,
  CASE WHEN t.start_line IS NOT NULL AND t.end_line IS NOT NULL THEN t.start_line END AS s, CASE WHEN t.start_line IS NOT NULL AND t.end_line IS NOT NULL THEN t.end_line END AS e FROM flat),
runs AS (SELECT unnest([0, 1, 2]) AS run),
targets AS (SELECT CAST(query_id AS BIGINT) * 3 + run AS query_id, target, path, s, e FROM ptargets, runs),
hits AS (SELECT r.query_id, target, rank FROM results r JOIN targets t ON r.query_id = t.query_id AND (file_path = path OR ends_with(file_path, '/' || path) OR ends_with(path, '/' || file_path))
  AND (s IS NULL OR NOT (end_line < s OR start_line > e))),
wanted AS (SELECT query_id, count(*) AS n FROM targets GROUP BY query_id),
firsts AS (SELECT query_id, target, min(rank) AS rank FROM hits GROUP BY ALL),
gained AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg FROM (SELECT DISTINCT query_id, rank FROM firsts WHERE rank <= 10) GROUP BY ALL),
scores AS (SELECT w.query_id, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM wanted w LEFT JOIN gained USING (query_id)),
fresh AS (SELECT query_id, rank, count(*) AS new FROM firsts GROUP BY ALL)"""
_CURVE = """curve AS (SELECT r.query_id, r.rank, CAST(sum(length(content) // 4) OVER w AS BIGINT) AS tokens, CAST(coalesce(sum(new) OVER w, 0) AS BIGINT) AS covered
FROM results r LEFT JOIN fresh f ON f.query_id = r.query_id AND f.rank = r.rank WINDOW w AS (PARTITION BY r.query_id ORDER BY r.rank))"""
_FIRST = "SELECT w.query_id, CAST(coalesce(min(tokens), 32000) AS BIGINT) AS tokens, min(tokens) IS NOT NULL AS found FROM wanted w LEFT JOIN {c} c ON c.query_id = w.query_id AND covered > 0 GROUP BY w.query_id"
_GREP = f"""asked AS (SELECT DISTINCT task_id AS query_id, query FROM tasks WHERE trim(coalesce(query, '')) <> ''),
kw AS (SELECT DISTINCT query_id, lower(w) AS word FROM (SELECT query_id, unnest(regexp_extract_all(query, '[a-zA-Z][a-zA-Z0-9]*')) AS w FROM asked) WHERE length(w) >= 3 AND NOT list_contains({Q.STOP}, lower(w))),
fw AS (SELECT DISTINCT file_path, lower(w) AS word FROM (SELECT file_path, unnest(regexp_extract_all(content, '[a-zA-Z][a-zA-Z0-9]*')) AS w FROM one)),
gh AS (SELECT query_id, file_path, count(*) AS hits FROM kw JOIN fw USING (word) GROUP BY ALL),
grepped AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, file_path) AS INTEGER) AS rank FROM gh))"""

_DIM = "dim(ext, language, content_type) AS (VALUES " + ", ".join(f"('{s}', '{lang}', '{k}')" for s, lang, k in language_rows()) + ")"

ORACLE = {
    "ext_by_content": f"WITH {_DIM} SELECT content_type, list_sort(list(DISTINCT ext)) AS exts FROM dim GROUP BY content_type",
    "chunk_lines": r"""WITH RECURSIVE d AS (SELECT CAST(doc_id AS VARCHAR) AS path, text FROM documents WHERE regexp_matches(text, '\S')),
l AS (SELECT path, text, list_transform(regexp_extract_all(text, '[^\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]*(?:\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}])|[^\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]+'), lambda x: length(x)) AS ns FROM d),
-- i lines are read, s and e bound the open chunk; (cs, ce) is the chunk that this line closed
step(path, i, s, e, slot, cs, ce) AS (
  SELECT path, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS INTEGER), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM l
  UNION ALL
  SELECT step.path, i + 1, CASE WHEN i < len(ns) AND (e - s + ns[i + 1] <= 750 OR e = s) THEN s ELSE e END, CASE WHEN i < len(ns) THEN e + ns[i + 1] ELSE e END,
    CASE WHEN i < len(ns) AND (e - s + ns[i + 1] <= 750 OR e = s) THEN slot ELSE slot + 1 END,
    CASE WHEN i < len(ns) AND (e - s + ns[i + 1] <= 750 OR e = s) THEN NULL ELSE s END, CASE WHEN i < len(ns) AND (e - s + ns[i + 1] <= 750 OR e = s) THEN NULL ELSE e END
  FROM step JOIN l USING (path) WHERE i <= len(ns)),
c AS (SELECT path, slot - 1 AS slot, text[cs + 1:ce] AS content, text[1:cs] AS before FROM step JOIN l USING (path) WHERE cs IS NOT NULL AND ce > cs)
SELECT path, slot, CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS INTEGER) AS start_line,
  CAST(length(before) - length(replace(before, chr(10), '')) + 1 + length(content[1:length(content) - 1]) - length(replace(content[1:length(content) - 1], chr(10), '')) AS INTEGER) AS end_line,
  CAST(length(content) AS INTEGER) AS chars, md5(content) AS digest FROM c""",
    "savings_buckets": f"""WITH {_LOG}, p AS (SELECT unnest(['Today', 'Last 7 days', 'All time']) AS period),
s AS (SELECT period, count(day) AS calls, coalesce(sum(snippet_chars), 0)::BIGINT AS snippet_chars, coalesce(sum(file_chars), 0)::BIGINT AS file_chars,
 coalesce(sum(greatest(0, file_chars - snippet_chars)), 0)::BIGINT AS saved_chars
 FROM p LEFT JOIN log ON period = 'All time' OR (period = 'Today' AND day = DATE '2024-01-29') OR (period = 'Last 7 days' AND day > DATE '2024-01-22') GROUP BY period)
SELECT *, CAST(saved_chars // 4 AS BIGINT) AS saved_tokens, CAST(CASE WHEN file_chars = 0 THEN 0 ELSE round_even(100.0 * saved_chars / file_chars, 0) END AS INTEGER) AS saved_percent FROM s""",
    "call_type_share": f"WITH {_LOG} SELECT call, count(*) AS calls, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM log GROUP BY call",
    "usage_daily": _DAILY,
    "usage_stream": _DAILY,
    "span_overlap_join": f"WITH {_RESULTS} SELECT query_id, target, rank FROM hits",
    "ndcg_at_10": f"WITH {_RESULTS} SELECT query_id, round(ndcg, 9) AS ndcg FROM scores",
    "ndcg_by_category": f"""WITH {_RESULTS}, k AS (SELECT DISTINCT CAST(task_id AS BIGINT) * 3 + run AS query_id, coalesce(category, CASE WHEN NOT contains(trim(query), ' ') THEN 'symbol' WHEN starts_with(lower(query), 'how ') THEN 'architecture'
 WHEN query IS NOT NULL THEN 'semantic' ELSE 'semantic' END) AS category FROM tasks, runs)
SELECT category, round(avg(ndcg), 9) AS ndcg, count(*) AS queries FROM scores JOIN k USING (query_id) GROUP BY category""",
    "ndcg_macro": f"""WITH {_RESULTS}, l AS (SELECT DISTINCT CAST(task_id AS BIGINT) * 3 + run AS query_id, language FROM tasks, runs), per AS (SELECT language, avg(ndcg) AS m FROM scores JOIN l USING (query_id) GROUP BY language)
SELECT round((SELECT avg(m) FROM per), 9) AS macro, round(quantile_cont(ndcg, 0.5), 9) AS median, round(quantile_cont(ndcg, 0.9), 9) AS p90,
 round(quantile_cont(ndcg, 0.95), 9) AS p95, round(quantile_cont(ndcg, 0.99), 9) AS p99 FROM scores""",
    "ndcg_by_language": f"""WITH {_RESULTS}, l AS (SELECT DISTINCT CAST(task_id AS BIGINT) * 3 + run AS query_id, language FROM tasks, runs)
SELECT language, round(avg(ndcg), 9) AS ndcg, count(*) AS queries FROM scores JOIN l USING (query_id) GROUP BY language""",
    "coverage_curve": f"WITH {_RESULTS}, {_CURVE} SELECT * FROM curve",
    "recall_at_budget": f"""WITH {_RESULTS}, {_CURVE}, b AS (SELECT unnest([500, 1000, 2000, 4000, 8000, 16000, 32000])::BIGINT AS budget),
best AS (SELECT query_id, budget, max(covered) AS covered FROM curve, b WHERE tokens <= budget GROUP BY ALL)
SELECT budget, round(avg(coalesce(covered, 0) / n), 9) AS recall FROM wanted CROSS JOIN b LEFT JOIN best USING (query_id, budget) GROUP BY budget""",
    "tokens_first_hit": f"WITH {_RESULTS}, {_CURVE} {_FIRST.format(c='curve')}",
    "grep_keyword_rank": f"WITH {Q.CHUNKS}, {_GREP} SELECT query_id, rank, file_path, hits FROM grepped",
    "paired_reduction": f"""WITH {_RESULTS}, {_CURVE}, {_GREP},
whole AS (SELECT file_path, sum(length(content)) AS chars FROM one GROUP BY file_path), gt AS (SELECT g.*, chars FROM grepped g JOIN whole USING (file_path)),
ghit AS (SELECT query_id, target, min(rank) AS rank FROM gt JOIN (SELECT file_path, max(end_line) AS end_line FROM one GROUP BY file_path) USING (file_path) JOIN ptargets t USING (query_id)
  WHERE (file_path = path OR ends_with(file_path, '/' || path) OR ends_with(path, '/' || file_path)) AND (s IS NULL OR NOT (end_line < s OR 1 > e)) GROUP BY ALL),
gnew AS (SELECT query_id, rank, count(*) AS new FROM ghit GROUP BY ALL),
gcurve AS (SELECT g.query_id, g.rank, CAST(sum(chars // 4) OVER w AS BIGINT) AS tokens, coalesce(sum(new) OVER w, 0) AS covered FROM gt g LEFT JOIN gnew f ON f.query_id = g.query_id AND f.rank = g.rank
  WINDOW w AS (PARTITION BY g.query_id ORDER BY g.rank)),
a AS ({_FIRST.format(c='curve')}),
b AS (SELECT CAST(w.query_id AS BIGINT) * 3 + run AS query_id, CAST(coalesce(min(tokens), 32000) AS BIGINT) AS tokens, min(tokens) IS NOT NULL AS found
  FROM (SELECT DISTINCT query_id FROM ptargets) w CROSS JOIN runs LEFT JOIN gcurve c ON c.query_id = w.query_id AND covered > 0 GROUP BY w.query_id, run),
both_ AS (SELECT a.tokens AS x, b.tokens AS y FROM a JOIN b USING (query_id) WHERE a.found AND b.found AND b.tokens > 0)
SELECT count(*) AS n_paired, round(1 - quantile_cont(x / y, 0.5), 9) AS median_reduction, round(1 - avg(x / y), 9) AS mean_reduction, round(avg(CASE WHEN x < y THEN 1.0 ELSE 0.0 END), 9) AS better FROM both_""",
    "savings_of_results": f"""WITH {_RESULTS}, five AS (SELECT * FROM results WHERE rank <= 5), sizes AS (SELECT path AS file_path, max(size) AS size FROM files GROUP BY path),
shown AS (SELECT query_id, count(*) AS results, sum(length(array_to_string(string_split(content, chr(10))[1:10], chr(10)))) AS snippet_chars FROM five GROUP BY query_id),
read AS (SELECT query_id, sum(size) AS file_chars FROM (SELECT DISTINCT query_id, file_path FROM five) JOIN sizes USING (file_path) GROUP BY query_id)
SELECT 'search' AS call, count(*) AS records, CAST(sum(results) AS BIGINT) AS results, CAST(sum(snippet_chars) AS BIGINT) AS snippet_chars, CAST(sum(coalesce(file_chars, 0)) AS BIGINT) AS file_chars FROM shown LEFT JOIN read USING (query_id)""",
    "language_of_files": f"WITH {_DIM}"
    + r""", f AS (SELECT DISTINCT path, lower(regexp_extract(string_split(path, '/')[-1], '^.+(\.[^.]+)$', 1)) AS ext FROM files)
SELECT path, f.ext AS ext, language AS by_suffix, content_type FROM f LEFT JOIN dim ON f.ext = dim.ext""",
    "file_states": r"""SELECT doc_id, CASE WHEN strlen(coalesce(text, '')) > 1000000 THEN 'too_large' WHEN strlen(coalesce(text, '')) < 128 AND NOT regexp_matches(coalesce(text, ''), '\S') THEN 'empty' ELSE 'valid' END AS status FROM documents""",
    "git_urls": """WITH r AS (SELECT DISTINCT repo FROM tasks), s AS (SELECT unnest([repo, 'https://example.org/' || repo, 'git@example.org:x/' || repo, '/src/' || repo]) AS source FROM r)
SELECT source, starts_with(source, 'https://') OR starts_with(source, 'git@') AS git FROM s""",
    "ignore_eval": r"""SELECT path, regexp_matches(path, '(^|/)tests/') OR len(list_filter(string_split(path, '/'), lambda c: ends_with(c, '.rb') AND NOT starts_with(c, 'keep_'))) > 0
 OR regexp_matches(path, '^[^/]+/docs/.+') OR regexp_matches(path, '(^|/)internal/[^/]*\.go(/|$)') OR regexp_matches(path, '(^|/)[a-c][^/]*-kit/') AS ignored
FROM (SELECT DISTINCT path FROM files WHERE path IS NOT NULL)""",
    "task_filters": """WITH r AS (SELECT repo, max(language) AS language FROM files WHERE repo IS NOT NULL GROUP BY repo),
t AS (SELECT DISTINCT task_id, repo, query, category, len(targets) AS targets FROM tasks)
SELECT task_id, repo, r.language AS language, coalesce(category, CASE WHEN NOT contains(trim(query), ' ') THEN 'symbol' WHEN starts_with(lower(query), 'how ') THEN 'architecture' ELSE 'semantic' END) AS category,
  CAST(targets AS INTEGER) AS targets FROM t JOIN r USING (repo) WHERE r.language IN ('rust', 'typescript', 'ruby')""",
}
