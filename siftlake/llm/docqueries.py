"""Queries and SQL over documents (problems 8, 9 and 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.llm.mixing import mix, out_of_reach
from siftlake.llm.packing import pack, sizes
from siftlake.llm.repetition import measure_repetition
from siftlake.session import table

WINDOW = 2_048


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(sizes(table(spark, sf_dir, "documents"), "doc_id", "text").dropDuplicates(["doc_id"]), "doc_id", WINDOW)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are cut: those with a second piece in some container."""
    return _packed(spark, sf_dir).filter("piece = 1").select("doc_id")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what of it stands in containers, in how many, and whether all of these hold at most their capacity."""
    box = Window.partitionBy("container")  # a container has at most as many rows as tokens
    placed = _packed(spark, sf_dir).withColumn("_load", F.sum("tokens").over(box))
    return placed.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.max(F.col("_load")).alias("_m")).select("doc_id", "tokens", "pieces", (F.col("_m") <= WINDOW).alias("fits"))


def _mix(spark: SparkSession, sf_dir: str):
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their share with the repeats allowed."""
    return out_of_reach(_mix(spark, sf_dir)[1]).select("source")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source has, may give and should give, and what the fit takes of its own records."""
    shares = _mix(spark, sf_dir)[1]
    return shares.select("source", "target_share", "max_repeats", "tokens", "capacity", F.round("target_tokens", 3).alias("target_tokens"), F.round("labelled_tokens", 3).alias("labelled_tokens"), "short")


def p9_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, expected and reached share of every source, unlabelled records counted by their memberships."""
    return _mix(spark, sf_dir)[1].select("source", "target_share", "expected_tokens", "drawn_tokens", "reached_share")


def p9_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is drawn into the mix."""
    return _mix(spark, sf_dir)[0].drop("member")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of 40 tokens or more of which at least 0.35 repeats."""
    return measure_repetition(table(spark, sf_dir, "documents")).filter("tokens >= 40 AND repeated >= 0.35").select("doc_id")


def p10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated share, perplexity and the verdict of the bands."""
    measured = measure_repetition(table(spark, sf_dir, "documents"))
    return measured.select("doc_id", "lang", "tokens", *[F.round(c, 6).alias(c) for c in ("repeated", "perplexity", "low", "high")], "rejected")


QUERIES = {
    "p8_found": p8_found, "p8_containers": p8_containers, "p9_found": p9_found, "p9_shares": p9_shares, "p9_reached": p9_reached, "p9_draws": p9_draws,
    "p10_found": p10_found, "p10_repetition": p10_repetition,
}

TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]"
_SIZED = f"WITH sized AS (SELECT DISTINCT doc_id, source, coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0) AS tokens FROM documents)"
_NAMED = r""", named AS (SELECT lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS source, tokens FROM sized WHERE source IS NOT NULL),
total AS (SELECT sum(tokens) AS t FROM named), per AS (SELECT source, sum(tokens) AS tokens FROM named GROUP BY source)
"""

ORACLE = {
    "p10_repetition": f"""
WITH texts AS (SELECT DISTINCT doc_id, coalesce(lower(trim(lang)), 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE doc_id IS NOT NULL),
plain AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS t FROM texts)),
runs AS (SELECT doc_id, w || chr(10) || lead(w, 1) OVER o || chr(10) || lead(w, 2) OVER o || chr(10) || lead(w, 3) OVER o || chr(10) || lead(w, 4) OVER o || chr(10) || lead(w, 5) OVER o
  || chr(10) || lead(w, 6) OVER o || chr(10) || lead(w, 7) OVER o AS run FROM plain WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
shares AS (SELECT doc_id, 1 - count(DISTINCT run) / count(*) AS repeated FROM runs WHERE run IS NOT NULL GROUP BY doc_id),
shaped AS (SELECT doc_id, i, regexp_replace(w, '[0-9]', '0', 'g') AS w FROM plain),
seq AS (SELECT doc_id, w, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY i), '') AS v FROM shaped),
pairs AS (SELECT v, w, count(*) AS c FROM seq GROUP BY ALL),
words AS (SELECT w, count(*) AS kinds FROM pairs GROUP BY w),
cn AS (SELECT count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c = 3) AS n3, count(*) FILTER (c = 4) AS n4 FROM pairs),
kn AS (SELECT count(*) FILTER (kinds = 1) AS n1, count(*) FILTER (kinds = 2) AS n2, count(*) FILTER (kinds = 3) AS n3, count(*) FILTER (kinds = 4) AS n4, count(*) AS vocabulary, sum(kinds) AS total FROM words),
cd AS (SELECT n1 / greatest(n1 + 2 * n2, 1) AS y, least(1, greatest(0, 1 - 2 * y * n2 / greatest(n1, 1))) AS d1, least(2, greatest(0, 2 - 3 * y * n3 / greatest(n2, 1))) AS d2, least(3, greatest(0, 3 - 4 * y * n4 / greatest(n3, 1))) AS d3 FROM cn),
kd AS (SELECT n1 / greatest(n1 + 2 * n2, 1) AS y, least(1, greatest(0, 1 - 2 * y * n2 / greatest(n1, 1))) AS d1, least(2, greatest(0, 2 - 3 * y * n3 / greatest(n2, 1))) AS d2, least(3, greatest(0, 3 - 4 * y * n4 / greatest(n3, 1))) AS d3, vocabulary, total FROM kn),
cut AS (SELECT w, kinds, CASE kinds WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS d FROM words, kd),
freed AS (SELECT sum(d) AS f FROM cut),
shared AS (SELECT w, (kinds - d) / total + f / total / (vocabulary + 1) AS share FROM cut, kd, freed),
contexts AS (SELECT v, sum(c) AS total, sum(CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END) / sum(c) AS rest FROM pairs, cd GROUP BY v),
logs AS (SELECT v, w, ln(greatest((c - CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END) / total + rest * share, 1e-12)) AS l FROM pairs JOIN contexts USING (v) JOIN shared USING (w), cd),
per AS (SELECT doc_id, count(*) AS tokens, exp(-avg(l)) AS perplexity FROM seq JOIN logs USING (v, w) GROUP BY doc_id),
joined AS (SELECT texts.doc_id, lang, coalesce(tokens, 0) AS tokens, coalesce(repeated, 0.0) AS repeated, perplexity FROM texts LEFT JOIN shares ON shares.doc_id = texts.doc_id LEFT JOIN per ON per.doc_id = texts.doc_id),
bands AS (SELECT lang, quantile_disc(perplexity, 0.03) AS low, quantile_disc(perplexity, 0.97) AS high FROM joined GROUP BY lang)
SELECT doc_id, lang, tokens, round(repeated, 6) AS repeated, round(perplexity, 6) AS perplexity, round(low, 6) AS low, round(high, 6) AS high, coalesce(perplexity < low OR perplexity > high, FALSE) AS rejected FROM joined JOIN bands USING (lang)""",
    "p10_found": f"""
WITH toks AS (SELECT DISTINCT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TOKEN}') AS t FROM documents WHERE text IS NOT NULL),
runs AS (SELECT doc_id, list_slice(t, i, i + 7) AS run FROM (SELECT doc_id, t, unnest(range(1, len(t) - 6)) AS i FROM toks WHERE len(t) >= 40))
SELECT doc_id FROM runs GROUP BY doc_id HAVING 1 - count(DISTINCT run) / count(*) >= 0.35""",
    "p8_containers": _SIZED + " SELECT doc_id, tokens, CAST(ceil(tokens / 2048.0) AS BIGINT) AS pieces, TRUE AS fits FROM sized WHERE tokens > 0",
    "p8_found": _SIZED + " SELECT doc_id FROM sized WHERE tokens > 2048",
    "p9_found": _SIZED
    + _NAMED
    + "SELECT m.source FROM mix_targets m LEFT JOIN per USING (source), total WHERE coalesce(per.tokens, 0) * m.max_repeats < m.target_share * total.t",
    "p9_shares": _SIZED
    + _NAMED
    + """SELECT m.source, target_share, max_repeats, CAST(coalesce(per.tokens, 0) AS BIGINT) AS tokens, CAST(coalesce(per.tokens, 0) * max_repeats AS BIGINT) AS capacity,
round(target_share * t, 3) AS target_tokens, round(least(target_share * t, CAST(coalesce(per.tokens, 0) * max_repeats AS DOUBLE)), 3) AS labelled_tokens,
coalesce(per.tokens, 0) * max_repeats < target_share * t AS short FROM mix_targets m LEFT JOIN per USING (source), total""",
}
