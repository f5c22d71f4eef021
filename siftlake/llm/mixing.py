"""Mixing sources to target shares: soft membership and projected gradient.

A classifier fitted on a bounded sample of labelled records gives every unlabelled record
its probabilities of belonging to each source; a labelled record belongs to its source.
Every record has a rate, how often it is drawn, between 0 and its cap. The rates are
fitted so that the expected tokens of each source match the targets: least squares,
minimised by projected gradient steps. Records of one source have one membership and one
cap, so they move as one; each task moves the rates of its own unlabelled records, and only
one number per source is summed up. The labelled records are fitted first, which shows the
sources that their repeats cannot bring to their target; unlabelled records then come in
from rate 0 where they are wanted. Rates become whole copies by a hash of the record, and
the shares reached are reported.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.bytetokens import scan, token_counts
from siftlake.llm.packing import sizes
from siftlake.session import scratch_table

#: Labelled records the classifier is fitted on, at most (a bounded sample by hash).
FIT_ROWS = 4_000
FEATURES = 1 << 14
#: The fit ends when no source moves by this share of the total in a step.
TOLERANCE = 1e-5
#: Steps after which a fit that still moves is given up with an error.
MOST_STEPS = 1_000


def source_name(column) -> F.Column:
    """Sources are the same whatever their case and outer blanks."""
    return F.lower(F.trim(F.regexp_replace(column, r"^\s+|\s+$", "")))


def _counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, log-damped counts of hashed tokens) in slices."""
    for at, tokens in scan(texts):
        n = len(tokens.first) - 1
        owner = np.repeat(np.arange(n), tokens.counts())
        cell = (tokens.hashes() % np.uint64(FEATURES)).astype(np.int64)
        for low in range(0, n, 500):
            high, a, b = min(n, low + 500), tokens.first[low], tokens.first[min(n, low + 500)]
            flat = np.bincount((owner[a:b] - low) * FEATURES + cell[a:b], minlength=(high - low) * FEATURES)
            yield at + low, np.log1p(flat.reshape(high - low, FEATURES))


class SourceClassifier:
    """Multinomial naive Bayes over hashed tokens, calibrated by the square root of the length."""

    def __init__(self, sources: list[str], log_prior: np.ndarray, log_like: np.ndarray):
        self.sources, self.log_prior, self.log_like = sources, log_prior, log_like

    @classmethod
    def fit(cls, texts: pa.Array, labels: list[str], sources: list[str]) -> SourceClassifier:
        """Sources without a record in the sample have no probability anywhere."""
        at = {s: i for i, s in enumerate(sources)}
        y = np.array([at[x] for x in labels])
        sums, rows = np.full((len(sources), FEATURES), 0.05), np.bincount(y, minlength=len(sources)) + 0.5
        for low, x in _counts(texts):
            for s in range(len(sources)):
                sums[s] += x[y[low : low + len(x)] == s].sum(axis=0)
        rows = np.where(np.bincount(y, minlength=len(sources)) > 0, rows, 0.0)
        with np.errstate(divide="ignore"):
            return cls(sources, np.log(rows / rows.sum()), np.log(sums / sums.sum(axis=1, keepdims=True)))

    def posteriors(self, texts: pa.Array) -> np.ndarray:
        out = np.tile(np.exp(self.log_prior), (len(texts), 1))
        for low, x in _counts(texts):
            score = self.log_prior + (x @ self.log_like.T) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
            score -= score.max(axis=1, keepdims=True)
            p = np.exp(score)
            out[low : low + len(x)] = p / p.sum(axis=1, keepdims=True)
        return out


def fit_classifier(df: DataFrame, key: str, text: str, source: str, sources: list[str], rows: int = FIT_ROWS) -> SourceClassifier | None:
    """Fitted on at most ``rows`` labelled records, the first by a hash of the key; None without any."""
    # The hash threshold comes from the number of labelled records, so only the sample's texts move.
    labelled = df.filter(F.col(source).isin(sources) & (F.length(text) > 0))
    n = labelled.count()
    if not n:
        return None
    share, place = min(1.0, 1.5 * rows / n), F.pmod(F.xxhash64(F.lit(5), key), F.lit(1 << 20))
    picked = labelled.filter(place < int(share * (1 << 20)) + 1).groupBy(key).agg(F.max(F.struct(text, source)).alias("_r"))
    sample = picked.orderBy(F.xxhash64(F.lit(5), key), key).limit(rows).select(f"_r.{text}", f"_r.{source}").toPandas()
    return SourceClassifier.fit(pa.array(sample[text].tolist(), pa.string()), sample[source].tolist(), sources) if len(sample) else None


def _rates(member: np.ndarray, cap: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rates of unlabelled records after the given steps: start at 0, move, stay within [0, cap]."""
    rate = np.zeros(len(cap))
    for g in steps:
        rate = np.clip(rate - member @ g, 0.0, cap)
    return rate


def _totals(steps: list[np.ndarray], k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(k)
        for pdf in batches:
            if len(pdf):
                member = np.stack(pdf["member"].to_numpy())
                total += member.T @ (_rates(member, pdf["cap"].to_numpy(), steps) * pdf["tokens"].to_numpy())
        yield pd.DataFrame({"s": np.arange(k), "total": total})

    return run


@dataclass
class Fit:
    """``rate`` per source and what it was before unlabelled records came in; ``steps`` from which
    these follow; expected tokens of the labelled records alone, and of all."""

    rate: np.ndarray
    labelled_rate: np.ndarray
    steps: list[np.ndarray]
    labelled: np.ndarray
    expected: np.ndarray
    residual: float


def fit_rates(on_hand: np.ndarray, cap: np.ndarray, targets: np.ndarray, soft: DataFrame | None = None, soft_weight: np.ndarray | None = None) -> Fit:
    """Least squares for expected tokens = ``targets`` by projected gradient.

    ``on_hand`` and ``cap`` are the tokens and the greatest rate per source, ``soft`` the
    unlabelled records (tokens, member, cap). A step is the gap of each source over the
    tokens that could fill it, which never overshoots. Both fits go on until nothing moves
    by TOLERANCE of the total; ``residual`` is the greatest gap that is left.
    """
    k, tolerance = len(targets), TOLERANCE * (float(targets.sum()) or 1.0)
    rate = np.minimum(1.0, cap)
    for _ in range(MOST_STEPS):
        moved = np.clip(rate - (rate * on_hand - targets) / np.maximum(on_hand, 1.0), 0.0, cap)
        still, rate = np.abs(moved - rate) * on_hand, moved
        if still.max(initial=0.0) < tolerance * 1e-3:
            break
    labelled_rate, labelled = rate, rate * on_hand
    reached = labelled
    steps: list[np.ndarray] = []
    if soft is not None:
        weight = np.maximum(on_hand + soft_weight, 1.0)
        while True:
            g = (reached - targets) / weight
            steps.append(g)
            rate = np.clip(rate - g, 0.0, cap)
            got = soft.mapInPandas(_totals(list(steps), k), "s int, total double").groupBy("s").agg(F.round(F.sum("total"), 3).alias("total")).collect()
            before, reached = reached, rate * on_hand
            for r in got:
                reached[r["s"]] += r["total"]
            if np.abs(reached - before).max() < tolerance:
                break
            if len(steps) >= MOST_STEPS:
                raise RuntimeError(f"the rates still move after {MOST_STEPS} steps")
    return Fit(rate, labelled_rate, steps, labelled, reached, float(np.abs(reached - targets).max(initial=0.0)))


def mix(
    df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", unlabelled: bool = True,
    count: Callable[[pa.Array], np.ndarray] = token_counts, report: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Draws records to the shares of ``targets`` (source, target_share, max_repeats).

    Returns (draws, shares). ``draws``: ``key, source, tokens, rate, copies, member`` of every
    record with copies > 0, never more than its source's ``max_repeats``; an unlabelled record
    (null source) is drawn at most once and only if ``unlabelled``. ``shares``, a row per
    target: tokens on hand, the most that repeats allow (``capacity``), ``target_tokens``,
    ``labelled_tokens`` (what the fit expects of the source's own records), whether it stays
    ``short`` with all of them at their cap, and, with unlabelled records counted by their
    memberships, the expected and drawn tokens and the share of the mix reached. ``report``
    receives the steps and the residual of the fit.

    The size of the mix is the tokens of all records with a source; each key counts once
    (of rows that differ under one key the greatest source and size). Sources compare
    without case and outer blanks; records of sources without a target are counted in the
    total and never drawn; texts that are null have no tokens; targets without records
    reach 0. Target sources must be few (they are held by the driver). ``count`` measures
    texts; packing.public_tokenizer(path) does so by a tokenizer file.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    named = df.select(key, text, source_name(F.col(source)).alias("source"))
    wanted = sorted(targets.filter(F.col("source").isNotNull()).select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").collect())
    names = [r["source"] for r in wanted]
    k, cap = len(names), np.array([float(max(r["max_repeats"] or 0, 0)) for r in wanted])
    sized = sizes(named, key, text, ["source"], count).groupBy(key).agg(F.max(F.struct("source", "tokens")).alias("_r")).select(key, "_r.*")
    sized = scratch_table(sized.filter("tokens > 0"), "sized")
    held = {r["source"]: r["t"] for r in sized.filter(F.col("source").isNotNull()).groupBy(F.when(F.col("source").isin(names), F.col("source")).alias("source")).agg(F.sum("tokens").alias("t")).collect()}
    total = float(sum(v or 0 for v in held.values()))
    on_hand = np.array([float(held.get(s) or 0) for s in names])
    aim = np.array([(r["target_share"] or 0.0) * total for r in wanted])

    soft, soft_weight = None, None
    classifier = fit_classifier(named, key, text, "source", names) if unlabelled and k else None
    if classifier is not None:
        rule_b = spark.sparkContext.broadcast(classifier)  # sources x FEATURES numbers

        def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = rule_b.value.posteriors(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(p), pa.list_(pa.float64()))], names=[key, "member"])

        open_ = named.filter(F.col("source").isNull() & F.col(key).isNotNull()).select(key, text)
        guessed = open_.mapInArrow(guess, f"`{key}` {kind}, member array<double>").groupBy(key).agg(F.max("member").alias("member"))
        soft = scratch_table(sized.filter(F.col("source").isNull()).join(guessed, key).select(key, "tokens", "member", F.lit(1.0).alias("cap")), "soft")
        per = soft.select("tokens", F.posexplode("member").alias("s", "p")).groupBy("s").agg(F.round(F.sum(F.col("p") * F.col("tokens")), 3).alias("w")).collect()
        soft_weight = np.zeros(k)
        for r in per:
            soft_weight[r["s"]] = r["w"]
    fit = fit_rates(on_hand, cap, aim, soft, soft_weight)
    if report is not None:
        report.update(steps=len(fit.steps), residual=fit.residual)

    lookup = lambda values: F.create_map(*[x for s, v in zip(names, values) for x in (F.lit(s), F.lit(float(v)))])
    none = F.lit(None).cast("array<double>")
    rated = sized.filter(F.col("source").isin(names))
    if k:
        rated = rated.select(key, "source", "tokens", lookup(cap)[F.col("source")].alias("cap"), lookup(fit.rate)[F.col("source")].alias("rate"), none.alias("member"))
    else:
        rated = rated.select(key, "source", "tokens", F.lit(0.0).alias("cap"), F.lit(0.0).alias("rate"), none.alias("member"))
    if soft is not None:

        def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(rate=_rates(np.stack(pdf["member"].to_numpy()), pdf["cap"].to_numpy(), fit.steps))

        moved = soft.mapInPandas(move, f"`{key}` {kind}, tokens bigint, member array<double>, cap double, rate double")
        rated = rated.unionByName(moved.select(key, F.lit(None).cast("string").alias("source"), "tokens", "cap", "rate", "member"))
    chance = F.pmod(F.xxhash64(F.lit(11), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.least(F.floor(F.col("rate")) + (chance < F.col("rate") - F.floor("rate")).cast("int"), F.col("cap")).cast("int")
    draws = rated.select(key, "source", "tokens", "rate", copies.alias("copies"), "member").filter("copies > 0")

    place = F.create_map(*[x for i, s in enumerate(names) for x in (F.lit(s), F.lit(i))]) if k else F.lit(None).cast("map<string,int>")
    own = draws.filter(F.col("source").isNotNull()).select(place[F.col("source")].alias("s"), (F.col("copies") * F.col("tokens")).cast("double").alias("t"))
    other = draws.filter(F.col("source").isNull()).select("copies", "tokens", F.posexplode("member").alias("s", "p")).select("s", (F.col("copies") * F.col("tokens") * F.col("p")).alias("t"))
    drawn = own.unionByName(other).groupBy("s").agg(F.round(F.sum("t"), 3).alias("drawn_tokens"))
    base = spark.createDataFrame(
        [
            (i, s, float(w["target_share"] or 0.0), int(c), int(h), int(h) * int(c), float(a), float(x), bool(r == c and x < a), float(e))
            for i, (s, w, c, h, a, x, r, e) in enumerate(zip(names, wanted, cap, on_hand, aim, fit.labelled, fit.labelled_rate, fit.expected))
        ],
        "s int, source string, target_share double, max_repeats int, tokens bigint, capacity bigint, target_tokens double, labelled_tokens double, short boolean, expected_tokens double",
    )
    shares = base.join(drawn, "s", "left").fillna(0, ["drawn_tokens"]).drop("s")
    whole = F.sum("drawn_tokens").over(Window.partitionBy())  # a row per target
    return draws, shares.withColumn("reached_share", F.coalesce(F.col("drawn_tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0)))


def out_of_reach(shares: DataFrame) -> DataFrame:
    """Targets that the fit could not bring to their tokens with all of the source's records at their cap."""
    return shares.filter("short")
