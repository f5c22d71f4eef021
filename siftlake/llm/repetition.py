"""Repetition inside a document: n-gram perplexity bands and the exact share of repeated runs.

A bigram model with modified Kneser-Ney smoothing is counted by Spark over all documents:
each task counts the pairs of its own texts, and only counts are shuffled. The model is
kept as arrays sorted by hash that every task holds. Beyond a bound every task holds the
logarithms of the most frequent pairs only, and the rarer ones of its texts are joined from
the written tables, so any size gives the unpruned model. A document's perplexity is set
against the bands of its language; repetitive texts fall below, garbage above.

Perplexity under a model of the whole collection cannot tell *how much* of a text repeats
itself, so the same pass counts a document's runs of eight tokens and how many of them
are different: that share is exact and decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import bytetokens
from siftlake.llm.bytetokens import Tokens, scan
from siftlake.session import scratch_table

#: Pairs and words a task may hold (12 to 20 bytes each); rarer ones are joined.
HELD_PAIRS = 2_000_000
HELD_WORDS = 1_000_000
RUN = 8
#: Share of a language's documents below the lower and above the upper band.
BANDS = (0.03, 0.97)

#: For the model all digits are alike: numbers say little and would fill the arrays.
_SHAPED = bytetokens._VALUE.copy()
_SHAPED[48:58] = _SHAPED[48]
_BEGIN = np.uint64(0x1234567)


def _pairs(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(previous, word) of every token; the first of a text follows the beginning."""
    word = tokens.hashes(_SHAPED)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    firsts = tokens.first[:-1][np.diff(tokens.first) > 0]
    before[firsts] = _BEGIN
    return before, word


def _pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return bytetokens._mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def _combine(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v, w, c = (np.concatenate(x) for x in zip(*parts))
    _, at, group = np.unique(_pair_hash(v, w), return_index=True, return_inverse=True)
    return v[at], w[at], np.bincount(group, weights=c).astype(np.int64)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        v, w, c = _combine(held)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(w.view(np.int64)), pa.array(c)], names=["v", "w", "c"])

    for batch in batches:
        for _, tokens in scan(batch.column(0)):
            if len(tokens.start):
                v, w = _pairs(tokens)
                held.append(_combine([(v, w, np.ones(len(v)))]))
                if sum(len(x[0]) for x in held) > 3_000_000:
                    held[:] = [_combine(held)]
                    if len(held[0][0]) > 2_000_000:
                        yield out()
    if held:
        yield out()


@dataclass
class PairModel:
    """Sorted hashes with values; ``discount[min(c, 3)]`` is taken off a count."""

    pair: np.ndarray
    pair_count: np.ndarray
    context: np.ndarray
    context_total: np.ndarray
    context_rest: np.ndarray
    word: np.ndarray
    word_share: np.ndarray
    unknown: float
    discount: np.ndarray

    @staticmethod
    def _find(keys: np.ndarray, asked: np.ndarray, values: np.ndarray, otherwise: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(asked), otherwise)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where(keys[at] == asked, values[at], otherwise)

    def log_probability(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability after the one before it."""
        words, w_at = np.unique(word, return_inverse=True)
        contexts, v_at = np.unique(before, return_inverse=True)
        pairs, p_at = np.unique(_pair_hash(before, word), return_inverse=True)
        share = self._find(self.word, words, self.word_share, self.unknown)[w_at]
        total = self._find(self.context, contexts, self.context_total, 1.0)[v_at]
        rest = self._find(self.context, contexts, self.context_rest, 1.0)[v_at]
        count = self._find(self.pair, pairs, self.pair_count, 0.0)[p_at]
        own = np.maximum(count - self.discount[np.minimum(count, 3).astype(int)], 0) / total
        return np.log(np.maximum(own + rest * share, 1e-12))


def _cutoff(table: DataFrame, count: str, most: int) -> int:
    """The least count whose n-grams, with all more frequent ones, are at most ``most``."""
    # Beyond 1,000 the steps are powers of two, so the histogram is a few thousand rows.
    step = F.when(F.col(count) <= 1000, F.col(count)).otherwise(F.expr(f"cast(shiftleft(1L, cast(floor(log2({count})) as int)) as bigint)"))
    kept = 0
    rows = table.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect()
    least = (rows[0]["s"] + 1) if rows else 1
    for r in rows:
        kept += r["count"]
        if kept > most:
            break
        least = r["s"]
    return int(least)


def _sorted(table: DataFrame, columns: list[str]) -> list[np.ndarray]:
    got = table.toArrow()
    arrays = [got.column(c).to_numpy() for c in columns]
    order = np.argsort(arrays[0].view(np.uint64), kind="stable")
    return [arrays[0].view(np.uint64)[order], *[a[order] for a in arrays[1:]]]


@dataclass
class Counts:
    """The whole model as written tables: ``pairs`` (v, w, c), ``contexts`` (v, total, rest), ``words`` (w, kinds, share)."""

    pairs: DataFrame
    contexts: DataFrame
    words: DataFrame
    unknown: float
    discount: np.ndarray


def _rest(least: int, discount: np.ndarray) -> list:
    """``total`` and ``rest`` of a context if pairs below ``least`` are not kept."""
    taken = F.when(F.col("c") < least, F.col("c")).when(F.col("c") == 1, discount[1]).when(F.col("c") == 2, discount[2]).otherwise(discount[3])
    return [F.sum("c").cast("double").alias("total"), (F.sum(taken.cast("double")) / F.sum("c")).alias("rest")]


def _taken(count: str, discount: np.ndarray):
    """What is taken off a count: one of three discounts."""
    c = F.col(count)
    return F.when(c == 1, float(discount[1])).when(c == 2, float(discount[2])).otherwise(float(discount[3]))


def _discounts(table: DataFrame, count: str) -> np.ndarray:
    """The three discounts of modified Kneser-Ney smoothing, from the counts of counts."""
    n = [0, *table.agg(*[F.count(F.when(F.col(count) == i, 1)) for i in (1, 2, 3, 4)]).first()]
    y = n[1] / max(n[1] + 2 * n[2], 1)
    return np.array([0.0, *[min(i, max(0.0, i - (i + 1) * y * n[i + 1] / max(n[i], 1))) for i in (1, 2, 3)]])


def count_model(docs: DataFrame, text: str) -> Counts:
    """Counts all texts; nothing is left out."""
    pairs = docs.select(text).mapInArrow(_count_pairs, "v bigint, w bigint, c bigint").groupBy("v", "w").agg(F.sum("c").alias("c"))
    pairs = scratch_table(pairs, "pairs")
    discount = _discounts(pairs, "c")
    words = scratch_table(pairs.groupBy("w").agg(F.count("*").alias("kinds")), "words")
    # The lower order is smoothed by the continuation counts in the same way; what that frees is shared evenly.
    lower = _discounts(words, "kinds")
    vocabulary, kinds, freed = words.agg(F.count("*"), F.sum("kinds"), F.sum(_taken("kinds", lower))).first()
    vocabulary, kinds = vocabulary or 0, kinds or 1
    flat = float(freed or 0.0) / kinds / (vocabulary + 1)
    words = words.withColumn("share", (F.col("kinds") - _taken("kinds", lower)) / kinds + flat)
    contexts = scratch_table(pairs.groupBy("v").agg(*_rest(1, discount)), "contexts")
    return Counts(pairs, contexts, words, max(flat, 1e-9), discount)


def _held_pairs(pairs: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pair hashes and the column ``value`` of these pairs."""
    got = pairs.select("v", "w", value).toArrow()
    v, w, x = (got.column(c).to_numpy() for c in ("v", "w", value))
    h = _pair_hash(v.view(np.uint64), w.view(np.uint64))
    order = np.argsort(h, kind="stable")
    return h[order], x[order]


def hold_model(counts: Counts, held_pairs: int = HELD_PAIRS, held_words: int = HELD_WORDS) -> PairModel:
    """The counts as arrays, at most ``held_pairs`` and ``held_words`` entries; what is rarer backs off."""
    pairs, contexts, words = counts.pairs, counts.contexts, counts.words
    least = _cutoff(pairs, "c", held_pairs)
    if least > 1:
        contexts = scratch_table(pairs.groupBy("v").agg(*_rest(least, counts.discount)), "contexts")
    c_least, w_least = _cutoff(contexts.withColumn("n", F.col("total").cast("bigint")), "n", held_words), _cutoff(words, "kinds", held_words)
    h, c = _held_pairs(pairs.filter(F.col("c") >= least).withColumn("c", F.least("c", F.lit(2**31 - 1)).cast("int")), "c")
    return PairModel(
        h, c, *_sorted(contexts.filter(F.col("total") >= c_least), ["v", "total", "rest"]),
        *_sorted(words.filter(F.col("kinds") >= w_least), ["w", "share"]), unknown=counts.unknown, discount=counts.discount,
    )


def fit_model(docs: DataFrame, text: str, held_pairs: int = HELD_PAIRS, held_words: int = HELD_WORDS) -> PairModel:
    """Counts all texts and holds the model, at most ``held_pairs`` and ``held_words`` entries."""
    return hold_model(count_model(docs, text), held_pairs, held_words)


def fits(counts: Counts, held_pairs: int, held_words: int) -> bool:
    return counts.pairs.count() <= held_pairs and max(counts.contexts.count(), counts.words.count()) <= held_words


@dataclass
class PairLogs:
    """Logarithms of the probabilities of the most frequent pairs, by sorted hash."""

    pair: np.ndarray
    log: np.ndarray


def pair_logs(counts: Counts) -> DataFrame:
    """``v, w, c, log``: every pair with the natural logarithm that ``PairModel`` gives it."""
    d = counts.discount
    off = F.when(F.col("c") == 1, d[1]).when(F.col("c") == 2, d[2]).otherwise(d[3])
    own = F.greatest(F.col("c") - off, F.lit(0.0)) / F.col("total")
    joined = counts.pairs.join(counts.contexts, "v").join(counts.words.select("w", "share"), "w")
    return joined.select("v", "w", "c", F.log(F.greatest(own + F.col("rest") * F.col("share"), F.lit(1e-12))).alias("log"))


def _asked_pairs(held_b):
    """Per text its tokens and the logarithms of its held pairs; then a row per pair that is not held."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["t", "v", "w", "n", "log"]
        for batch in batches:
            for at, tokens in scan(batch.column(0)):
                if not len(tokens.start):
                    continue
                held: PairLogs = held_b.value
                name, count = batch.column(1).slice(at, len(tokens.first) - 1).to_numpy(), tokens.counts()
                v, w = _pairs(tokens)
                pairs, p_at = np.unique(_pair_hash(v, w), return_inverse=True)
                logs = PairModel._find(held.pair, pairs, held.log, np.nan)[p_at]
                open_ = np.isnan(logs)
                of = np.repeat(np.arange(len(count)), count)
                sums = np.bincount(of, weights=np.where(open_, 0.0, logs), minlength=len(count))
                some = count > 0
                none = pa.nulls(int(some.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(name[some]), none, none, pa.array(count[some].astype(np.int64)), pa.array(sums[some])], names=names)
                if open_.any():
                    n = int(open_.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name[of[open_]]), pa.array(v[open_].view(np.int64)), pa.array(w[open_].view(np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64())], names=names
                    )

    return go


def joined_perplexity(docs: DataFrame, text: str, counts: Counts, held_pairs: int) -> DataFrame:
    """``t, perplexity`` per different text (``t``: its xxhash64) under the unpruned model.

    The most frequent pairs are looked up in the task; the others are few per text and
    meet their logarithms in a join.
    """
    logs = scratch_table(pair_logs(counts), "logs")
    least = _cutoff(logs, "c", held_pairs)
    held_b = docs.sparkSession.sparkContext.broadcast(PairLogs(*_held_pairs(logs.filter(F.col("c") >= least), "log")))
    asked = docs.select(text, F.xxhash64(text).alias("t")).mapInArrow(_asked_pairs(held_b), "t bigint, v bigint, w bigint, n bigint, log double")
    asked = scratch_table(asked, "asked")
    rare = asked.filter("v IS NOT NULL").select("t", "v", "w").join(logs.filter(F.col("c") < least).select("v", "w", "log"), ["v", "w"])
    parts = asked.filter("v IS NULL").select("t", "n", "log").unionByName(rare.select("t", F.lit(0).cast("bigint").alias("n"), "log"))
    # Repeated texts add to both sums alike.
    return parts.groupBy("t").agg(F.exp(-F.sum("log") / F.sum("n")).alias("perplexity"))


def repeated_share(tokens: Tokens, run: int = RUN) -> np.ndarray:
    """1 - different / all runs of ``run`` consecutive tokens of each text; 0 without a run."""
    h = tokens.hashes()
    share = np.zeros(len(tokens.first) - 1)
    if len(h) < run:
        return share
    runs = np.zeros(len(h) - run + 1, dtype=np.uint64)
    odd = np.uint64(0xD6E8FEB86659FD93)
    for j in range(run):
        runs = runs * odd + h[j : len(h) - run + 1 + j]
    for i, (a, b) in enumerate(zip(tokens.first[:-1], tokens.first[1:])):
        n = b - a - run + 1
        if n > 1:
            own = np.sort(runs[a : a + n])
            share[i] = np.count_nonzero(own[1:] == own[:-1]) / n
    return share


def _measure(model_b, run: int, key: str):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, tokens in scan(batch.column(0)):
                n, count = len(tokens.first) - 1, tokens.counts()
                perplexity = np.full(n, np.nan)
                if len(tokens.start) and model_b is not None:
                    logs = np.append(np.cumsum(model_b.value.log_probability(*_pairs(tokens))), 0.0)
                    upto = np.where(tokens.first > 0, logs[tokens.first - 1], 0.0)
                    some = count > 0
                    perplexity[some] = np.exp(-np.diff(upto)[some] / count[some])
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), part.column(3), pa.array(count.astype(np.int64)), pa.array(repeated_share(tokens, run)), pa.array(perplexity, mask=np.isnan(perplexity))],
                    names=[key, "lang", "_t", "tokens", "repeated", "perplexity"],
                )

    return go


def measure_repetition(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", run: int = RUN, bands: tuple[float, float] = BANDS,
    held_pairs: int = HELD_PAIRS, held_words: int = HELD_WORDS,
) -> DataFrame:
    """One row per document: ``key, lang, tokens, repeated, perplexity, low, high, rejected``.

    ``repeated`` is exact: 1 - (different runs) / (runs) of ``run`` tokens with A-Z lowered.
    ``low`` and ``high`` are the bands of the document's language, ``rejected`` tells
    whether its perplexity lies outside. Null languages and ``und`` are one language.
    Null and empty texts have 0 tokens, share 0 and no perplexity and are not rejected;
    texts are taken whole; null keys are left out and repeated keys are one document;
    no documents, no rows; other columns are ignored. ``held_pairs`` and ``held_words``
    bound what a task holds and change no result.
    """
    spark: SparkSession = docs.sparkSession
    known = docs.filter(F.col(key).isNotNull())
    counts = count_model(known, text)
    held = fits(counts, held_pairs, held_words)
    model_b = spark.sparkContext.broadcast(hold_model(counts, held_pairs, held_words)) if held else None
    kind = docs.schema[key].dataType.simpleString()
    language = F.coalesce(F.lower(F.trim(F.col(lang))), F.lit("und"))
    measured = known.select(text, key, language.alias("lang"), F.xxhash64(text).alias("_t")).mapInArrow(
        _measure(model_b, run, key), f"`{key}` {kind}, lang string, _t bigint, tokens bigint, repeated double, perplexity double"
    )
    measured = measured.dropDuplicates([key])
    if not held:
        measured = scratch_table(measured, "shares").drop("perplexity").join(joined_perplexity(known, text, counts, held_pairs), F.col("_t") == F.col("t"), "left").drop("t")
    measured = scratch_table(measured, "measured")
    limits = measured.groupBy("lang").agg(F.percentile_approx("perplexity", list(bands), 10_000).alias("_b")).select("lang", F.get("_b", F.lit(0)).alias("low"), F.get("_b", F.lit(1)).alias("high"))
    outside = (F.col("perplexity") < F.col("low")) | (F.col("perplexity") > F.col("high"))
    return measured.join(limits, "lang").withColumn("rejected", F.coalesce(outside, F.lit(False))).select(key, "lang", "tokens", "repeated", "perplexity", "low", "high", "rejected")
