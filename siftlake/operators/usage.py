"""Usage analytics: what searches saved against reading whole files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.functions.text import snippet

LOG_SCHEMA = "ts double, call string, results int, snippet_chars bigint, file_chars bigint"


def usage_records(results: DataFrame, sizes: DataFrame, now: float, call: str = "search", lines: int | None = None) -> DataFrame:
    """One log record per query of a result set (query_id, file_path, content)."""
    shown = results.groupBy("query_id").agg(F.count("*").cast("int").alias("results"), F.sum(F.length(snippet(F.col("content"), lines))).alias("snippet_chars"))
    files = results.select("query_id", "file_path").distinct().join(sizes.select("file_path", "size"), "file_path")
    read = files.groupBy("query_id").agg(F.sum("size").alias("file_chars"))
    both = shown.join(read, "query_id", "left")
    return both.select(F.lit(float(now)).alias("ts"), F.lit(call).alias("call"), "results", "snippet_chars", F.coalesce("file_chars", F.lit(0)).alias("file_chars"))


def write_log(records: DataFrame, path: str) -> None:
    """Append; each task's file appears as a whole or not at all."""
    records.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of a log; lines that do not parse or lack a field are dropped."""
    return spark.read.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").json(path).dropna()


def savings_buckets(log: DataFrame, now: dt.datetime, day: Column | None = None) -> DataFrame:
    """Overlapping periods today, last 7 days and all time (UTC dates), from one pass.

    Saved characters are clamped at 0 for each record. Empty periods are 0.
    """
    day = F.to_date(F.timestamp_micros((F.col("ts") * 1_000_000).cast("bigint"))) if day is None else day
    today = F.lit(now.date())
    periods = [("All time", F.lit(True)), ("Last 7 days", day > F.date_sub(today, 7)), ("Today", day == today)]
    add = lambda name, c, hit: F.coalesce(F.sum(F.when(hit, c)), F.lit(0)).alias(name)
    saved = F.greatest(F.lit(0), F.col("file_chars") - F.col("snippet_chars"))
    row = log.agg(*[add(f"{c}{i}", v, hit) for i, (_, hit) in enumerate(periods) for c, v in (("a", F.lit(1)), ("b", F.col("snippet_chars")), ("c", F.col("file_chars")), ("d", saved))])
    rows = F.array(*[F.struct(F.lit(n).alias("period"), F.col(f"a{i}").alias("calls"), F.col(f"b{i}").alias("snippet_chars"), F.col(f"c{i}").alias("file_chars"), F.col(f"d{i}").alias("saved_chars")) for i, (n, _) in enumerate(periods)])
    out = row.select(F.explode(rows).alias("r")).select("r.*")
    ratio = F.bround(F.lit(100.0) * F.col("saved_chars") / F.nullif(F.col("file_chars"), F.lit(0)))
    return out.withColumns({"saved_tokens": F.expr("saved_chars div 4"), "saved_percent": F.coalesce(ratio, F.lit(0.0)).cast("int")})


def call_shares(log: DataFrame) -> DataFrame:
    """Calls of each type and their share."""
    counts = log.groupBy("call").agg(F.count("*").alias("calls"))
    # A row per call type is left, so one window over them all is small.
    return counts.select("call", "calls", (F.col("calls") / F.sum("calls").over(Window.partitionBy())).alias("share"))


def human(n: float) -> str:
    for size, unit in ((1e9, "B"), (1e6, "M"), (1e3, "k")):
        if abs(n) >= size:
            return f"{n / size:.1f}{unit}"
    return f"{n:.0f}"


def usage_report(log: DataFrame, now: dt.datetime) -> str:
    """The report as text."""
    lines = [f"{'Period':<12} {'Calls':>8} {'Saved tokens':>14} {'Saved':>6}"]
    order = {"Today": 0, "Last 7 days": 1, "All time": 2}
    for r in sorted(savings_buckets(log, now).collect(), key=lambda r: order[r["period"]]):
        bar = "#" * (r["saved_percent"] // 5)
        lines.append(f"{r['period']:<12} {human(r['calls']):>8} {'~' + human(r['saved_tokens']):>14} {r['saved_percent']:>5}% {bar}")
    for r in call_shares(log).orderBy(F.desc("calls"), "call").collect():
        lines.append(f"  {r['call']}: {human(r['calls'])} ({100 * r['share']:.0f}%)")
    return "\n".join(lines)
