"""Retrieval quality: NDCG, recall within a token budget, tokens to the first hit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions.text import infer_category, normal_path
from siftlake.operators.best import stored
from siftlake.session import scratch_path

# Fixed values of the keyword search that serves as the baseline.
KEYWORD = "[a-zA-Z][a-zA-Z0-9]*"


def task_targets(tasks: DataFrame) -> DataFrame:
    """``query_id, target, path, start_line, end_line``; half a span is no span."""
    one = tasks.select(F.col("task_id").cast("bigint").alias("query_id"), "targets").distinct()
    flat = one.select("query_id", F.posexplode("targets").alias("target", "t"))
    span = F.col("t.start_line").isNotNull() & F.col("t.end_line").isNotNull()
    return flat.select("query_id", "target", normal_path(F.col("t.path")).alias("path"), F.when(span, F.col("t.start_line")).alias("start"), F.when(span, F.col("t.end_line")).alias("end"))


def span_hits(results: DataFrame, targets: DataFrame) -> DataFrame:
    """``query_id, target, rank`` of every result that covers a target.

    The join is on query and file name; that one path ends with the other and that the
    lines overlap is checked on what meets.
    """
    name = lambda c: F.element_at(F.split(F.col(c), "/"), -1)
    r = results.select("query_id", "rank", "file_path", F.col("start_line").alias("s"), F.col("end_line").alias("e"), name("file_path").alias("name"))
    t = targets.withColumn("name", name("path"))
    tail = (F.col("file_path") == F.col("path")) | F.endswith("file_path", F.concat(F.lit("/"), "path")) | F.endswith("path", F.concat(F.lit("/"), "file_path"))
    overlap = F.col("start").isNull() | ~((F.col("e") < F.col("start")) | (F.col("s") > F.col("end")))
    return r.join(t, ["query_id", "name"]).filter(tail & overlap).select("query_id", "target", "rank")


def covering_files(files: DataFrame, targets: DataFrame) -> DataFrame:
    """``query_id, file_path`` of every file that covers a target of the query, whatever its rank."""
    name = lambda c: F.element_at(F.split(F.col(c), "/"), -1)
    asked = targets.select("query_id", name("path").alias("_n")).distinct()
    near = files.withColumn("_n", name("file_path")).join(asked, "_n").withColumn("rank", F.col("file_path"))
    return span_hits(near, targets).select("query_id", F.col("rank").alias("file_path")).distinct()


def ndcg(results: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """``query_id, ndcg`` of every query with a target.

    Targets found at one rank count once, the ideal counts each target.
    """
    first = span_hits(results, targets).groupBy("query_id", "target").agg(F.min("rank").alias("rank"))
    gained = first.filter(F.col("rank") <= k).select("query_id", "rank").distinct().groupBy("query_id").agg(F.sum(F.lit(1.0) / F.log2(F.col("rank") + 1)).alias("dcg"))
    wanted = targets.groupBy("query_id").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + F.lit(1)))
    return wanted.join(gained, "query_id", "left").select("query_id", (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def by_category(scores: DataFrame, tasks: DataFrame) -> DataFrame:
    """Mean score per category; tasks without one get it from the query."""
    kinds = tasks.select(F.col("task_id").cast("bigint").alias("query_id"), F.coalesce("category", infer_category(F.col("query")), F.lit("unknown")).alias("category")).dropDuplicates(["query_id"])
    return scores.join(kinds, "query_id").groupBy("category").agg(F.avg("ndcg").alias("ndcg"), F.count("*").alias("queries"))


def by_language(scores: DataFrame, tasks: DataFrame) -> DataFrame:
    """Mean score per language; tasks without one are a language of their own (null)."""
    langs = tasks.select(F.col("task_id").cast("bigint").alias("query_id"), "language").dropDuplicates(["query_id"])
    return scores.join(langs, "query_id").groupBy("language").agg(F.avg("ndcg").alias("ndcg"), F.count("*").alias("queries"))


def macro_average(scores: DataFrame, tasks: DataFrame) -> DataFrame:
    """Mean of the means per language, and percentiles over all queries."""
    per = by_language(scores, tasks)
    places = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    overall = scores.agg(F.percentile("ndcg", F.array(*[F.lit(p) for p in places.values()])).alias("p"))
    return per.agg(F.avg("ndcg").alias("macro")).crossJoin(F.broadcast(overall)).select("macro", *[F.col("p")[i].alias(n) for i, n in enumerate(places)])


def coverage_curve(results: DataFrame, targets: DataFrame, tokens: Column | None = None) -> DataFrame:
    """``query_id, rank, tokens, covered``: running tokens and targets covered, per rank."""
    cost = F.expr("length(content) div 4") if tokens is None else tokens
    first = span_hits(results, targets).groupBy("query_id", "target").agg(F.min("rank").alias("rank")).groupBy("query_id", "rank").agg(F.count("*").alias("new"))
    by = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = results.select("query_id", "rank", cost.alias("cost")).join(first, ["query_id", "rank"], "left")
    return rows.select("query_id", "rank", F.sum("cost").over(by).alias("tokens"), F.coalesce(F.sum("new").over(by), F.lit(0)).alias("covered"))


def recall_at(curve: DataFrame, targets: DataFrame, budgets: list[int]) -> DataFrame:
    """Mean recall within each token budget over all queries with targets."""
    wanted = targets.groupBy("query_id").agg(F.count("*").alias("n"))
    every = F.explode(F.array(*[F.lit(b).cast("bigint") for b in budgets]))
    each = wanted.withColumn("budget", every)
    reached = curve.withColumn("budget", every).filter("tokens <= budget")
    best = reached.groupBy("query_id", "budget").agg(F.max("covered").alias("covered"))
    joined = each.join(best, ["query_id", "budget"], "left")
    return joined.groupBy("budget").agg(F.avg(F.coalesce("covered", F.lit(0)) / F.col("n")).alias("recall"))


def first_hits(curve: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """``query_id, tokens`` to the first target; ``cap`` if none is found."""
    hit = curve.filter("covered > 0").groupBy("query_id").agg(F.min("tokens").alias("tokens"))
    wanted = targets.select("query_id").distinct()
    return wanted.join(hit, "query_id", "left").select("query_id", F.coalesce("tokens", F.lit(cap)).cast("bigint").alias("tokens"), F.col("tokens").isNotNull().alias("found"))


def paired_reduction(ours: DataFrame, other: DataFrame) -> DataFrame:
    """Median and mean saving in tokens to the first hit, over queries that both answer."""
    both = ours.filter("found").select("query_id", F.col("tokens").alias("a")).join(other.filter("found AND tokens > 0").select("query_id", F.col("tokens").alias("b")), "query_id")
    ratio = F.col("a") / F.col("b")
    return both.agg(F.count("*").alias("n_paired"), (1 - F.percentile(ratio, F.lit(0.5))).alias("median_reduction"), (1 - F.avg(ratio)).alias("mean_reduction"), F.avg((F.col("a") < F.col("b")).cast("int")).alias("better"))


def _keyword_tables(queries: DataFrame, chunks: DataFrame, stopwords: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """``query_id, words`` of every query with keywords, and ``file_path, words`` of every file
    with the keywords that stand in it."""
    words = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(KEYWORD), F.lit(0)), F.lower))
    kept = F.filter(words("query"), lambda w: (F.length(w) >= least) & ~F.array_contains(F.array(*[F.lit(s) for s in stopwords]), w))
    asked = queries.select("query_id", F.explode(kept).alias("word")).groupBy("query_id").agg(F.collect_set("word").alias("words"))
    found = chunks.select("file_path", F.explode(words("content")).alias("word"))
    known = found.join(asked.select(F.explode("words").alias("word")).distinct(), "word", "left_semi")
    return asked, known.groupBy("file_path").agg(F.collect_set("word").alias("words"))


def _against_files(folder: str, answer):
    """A task's queries against all files of the shared folder. ``answer`` gets the files by path,
    the rows of queries and a function that counts the keywords of a query in every file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = None
        for batch in batches:
            if batch.num_rows and files is None:
                if not (parts := list(stored(folder))):
                    return
                files = pa.Table.from_batches(parts).combine_chunks()
                files = files.take(pc.sort_indices(files.column("file_path"))).combine_chunks()
                lists = files.column("words").chunk(0)
                coded = pc.list_flatten(lists).dictionary_encode()
                code = coded.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                owner = pc.list_parent_indices(lists).to_numpy()[order].astype(np.intp)
                start = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1)).tolist()
                place = {w: i for i, w in enumerate(coded.dictionary.to_pylist())}

                def count(words: list[str]) -> np.ndarray:
                    hits = np.zeros(files.num_rows, np.int32)
                    for i in (place[w] for w in words if w in place):
                        hits[owner[start[i] : start[i + 1]]] += 1
                    return hits

            if batch.num_rows:
                yield from answer(files, batch, count)

    return run


def _spread(queries: DataFrame) -> DataFrame:
    return queries.repartition(4 * queries.sparkSession.sparkContext.defaultParallelism, "query_id")


def keyword_ranking(queries: DataFrame, chunks: DataFrame, stopwords: list[str], least: int = 3) -> DataFrame:
    """Files by the number of distinct query keywords they contain: the grep baseline.

    ``query_id, rank, file_path, hits``. Tasks hold the files' keywords, read from the shared
    folder, and rank all files of a query at once: the rows, as many as queries times files,
    are neither shuffled nor sorted anywhere else.
    """
    asked, files = _keyword_tables(queries, chunks, stopwords, least)
    folder = scratch_path(queries.sparkSession, "files")
    files.write.parquet(folder)

    def rank(files: pa.Table, batch: pa.RecordBatch, count) -> Iterator[pa.RecordBatch]:
        paths = files.column("file_path").chunk(0)
        for i, words in enumerate(batch.column("words").to_pylist()):
            hits = count(words)
            at = np.flatnonzero(hits)
            at = at[np.argsort(-hits[at], kind="stable")]
            for begin in range(0, len(at), 100_000):
                some = at[begin : begin + 100_000]
                ranks = np.arange(begin + 1, begin + len(some) + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(np.full(len(some), i))), pa.array(ranks), paths.take(pa.array(some)), pa.array(hits[some].astype(np.int64))], names=["query_id", "rank", "file_path", "hits"])

    kind = asked.schema["query_id"].dataType.simpleString()
    return _spread(asked).mapInArrow(_against_files(folder, rank), f"query_id {kind}, rank int, file_path string, hits bigint")


def keyword_first_hits(queries: DataFrame, chunks: DataFrame, files: DataFrame, targets: DataFrame, stopwords: list[str], cap: int, least: int = 3) -> DataFrame:
    """``query_id, tokens, found``: tokens of the files that are read by keyword until the first
    covers a target, as :func:`first_hits` of the whole ranking would give, which is not written
    out. ``files`` has file_path, start_line, end_line and chars.
    """
    asked, known = _keyword_tables(queries, chunks, stopwords, least)
    folder = scratch_path(queries.sparkSession, "files")
    known.join(files.select("file_path", F.expr("chars div 4").alias("cost")), "file_path").write.parquet(folder)
    wanted = covering_files(files, targets).groupBy("query_id").agg(F.collect_list("file_path").alias("covers"))

    def first(files: pa.Table, batch: pa.RecordBatch, count) -> Iterator[pa.RecordBatch]:
        paths, cost = files.column("file_path").chunk(0), files.column("cost").to_numpy()
        tokens = []
        for words, covers in zip(batch.column("words").to_pylist(), batch.column("covers")):
            hits = count(words)
            at = pc.index_in(covers.values, value_set=paths).drop_null().to_numpy()
            at = np.sort(at[hits[at] > 0])
            if not len(at):
                tokens.append(None)
                continue
            last = at[np.argmax(hits[at])]  # of those with most keywords the first by path
            before = hits > hits[last]
            before[: last + 1] |= hits[: last + 1] == hits[last]
            tokens.append(int(cost[before].sum()))
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(tokens, pa.int64())], names=["query_id", "tokens"])

    kind = asked.schema["query_id"].dataType.simpleString()
    found = _spread(asked.join(wanted, "query_id")).mapInArrow(_against_files(folder, first), f"query_id {kind}, tokens bigint")
    return first_hits(found.filter("tokens IS NOT NULL").withColumn("covered", F.lit(1)), targets, cap)


#: Weight of the semantic side (None: by query) and whether results are reranked.
MODES = {f"{name}{'+ranking' if rerank else ''}": (alpha, rerank) for name, alpha in (("lexical", 0.0), ("semantic", 1.0), ("auto", None), ("even", 0.5)) for rerank in (False, True)}


def mode_quality(index, queries: DataFrame, targets: DataFrame, k: int = 10, modes: dict | None = None) -> DataFrame:
    """``mode, ndcg, queries``: mean quality of every way to combine the retrievers.

    Both retrievers are asked once and definitions looked for once; only weighing and reranking
    differ by mode. The rankings are united, so all modes are judged in one pass.
    """
    from siftlake.operators.search import OVERFETCH, combine_placed, definers, pair_up, placed, query_facts, retrieve, with_definers
    from siftlake.session import scratch_table

    picked = modes or MODES
    asked = queries.filter(F.trim(F.coalesce("query", F.lit(""))) != "").select("query_id", "query")
    pairs = scratch_table(pair_up(*retrieve(index, asked, OVERFETCH * k)), "pairs")
    found = scratch_table(with_definers(pairs, definers(index, query_facts(asked), pairs)), "defined")
    rows = placed(found, index.chunks)
    out = None
    for number, (alpha, rerank) in enumerate(picked.values()):
        # One query table for all modes: the mode becomes part of the query's number.
        part = combine_placed(rows, asked, k, alpha, rerank).withColumn("query_id", F.col("query_id") * len(picked) + number)
        out = part if out is None else out.unionByName(part)
    copies = targets.withColumn("_m", F.explode(F.array(*[F.lit(i) for i in range(len(picked))]))).withColumn("query_id", F.col("query_id") * len(picked) + F.col("_m")).drop("_m")
    names = F.element_at(F.array(*[F.lit(n) for n in picked]), (F.col("query_id") % len(picked) + 1).cast("int"))
    return ndcg(out, copies, k).groupBy(names.alias("mode")).agg(F.avg("ndcg").alias("ndcg"), F.count("*").alias("queries"))
