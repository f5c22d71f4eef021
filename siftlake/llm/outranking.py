"""One ranking from several differently scaled scores: outranking net flow.

Scores are turned into percentiles within their own list, so their range plays no part.
For each score a preference function says how strongly one item is put before another,
from 0 at equal percentiles to 1 at a distance of ``threshold`` (0: at any difference).
An item's positive flow is its mean preference over all others, its negative flow the mean
preference of all others over it, and the net flow the difference. With linear preference
the sum over all pairs needs only counts and sums of the percentiles below a few points,
which sorted prefix sums give exactly: no pair is ever formed.

The rows are range-partitioned by (query, scorer, score) once. A list that lies within one
partition gets its flows on the spot from sorted arrays; only a partition's first and last
list can go on elsewhere, and those are finished by prefix sums over stretches of
percentiles, so a list may hold a third of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.operators.prefix import prefix_sums
from siftlake.session import scratch_table

#: Percentiles are cut into this many stretches; each holds an even share of a list.
STRETCHES = 64


def usable_scores(df: DataFrame, query: str, item: str, scorer: str, score: str) -> DataFrame:
    """The highest usable score (not null, not NaN) of an item from each scorer."""
    ok = F.col(query).isNotNull() & F.col(item).isNotNull() & F.col(scorer).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    return df.filter(ok).groupBy(query, item, scorer).agg(F.max(F.col(score).cast("double")).alias(score))


def list_flows(scores: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positive and negative flow of every entry of one whole list, ascending in ``scores``."""
    n = len(scores)
    first = np.searchsorted(scores, scores, side="left")
    upto = np.searchsorted(scores, scores, side="right")
    others = max(n - 1, 1)
    if not threshold:
        return first / others, (n - upto) / others
    x = (first + upto) / 2 / n
    below = np.concatenate([[0.0], np.cumsum(x)])

    def under(y: np.ndarray, side: str) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(x, y, side=side)
        return at, below[at]

    (w1, s1), (w3, s3) = under(x - threshold, "right"), under(x + threshold, "right")
    w2, s2 = upto, below[upto]
    over = w1 + ((w2 - w1) * x - (s2 - s1)) / threshold
    less = (n - w3) + ((s3 - s2) - (w3 - w2) * x) / threshold
    return over / others, less / others


def _local(threshold: float, names: list[str]):
    """Flows of the lists that lie within one sorted partition; its first and last list pass as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # parts of the list being read
        current, seen_first = None, False

        def out(parts: list[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts).combine_chunks()
            n = t.num_rows
            if whole:
                plus, minus = list_flows(t.column(names[3]).to_numpy(), threshold)
                extra = [pa.array(plus), pa.array(minus), pa.array(np.full(n, n, dtype=np.int64))]
            else:
                extra = [pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int64())]
            for b in pa.Table.from_arrays([*t.columns, *extra], names=[*names, "plus", "minus", "n"]).to_batches():
                yield b

        for batch in batches:
            if not batch.num_rows:
                continue
            q, s = batch.column(0), batch.column(1)
            same = pc.and_(pc.equal(q[1:], q[:-1]), pc.equal(s[1:], s[:-1])).to_numpy(zero_copy_only=False) if batch.num_rows > 1 else np.ones(0, bool)
            cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                key = (q[a], s[a])
                if current is not None and key != current:
                    yield from out(held, seen_first)
                    held, seen_first = [], True
                current = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from out(held, False)

    return run


def _positions(best: DataFrame, query: str, scorer: str, score: str) -> DataFrame:
    """Per distinct score of a list: ``c`` items, ``upto`` items up to it, list size ``n``,
    and the percentile ``x`` of the middle of its ties."""
    values = best.groupBy(query, scorer, score).agg(F.count("*").alias("c"))
    summed = prefix_sums(values, [query, scorer], [F.col(score)], {"upto": F.col("c")})
    size = values.groupBy(query, scorer).agg(F.sum("c").alias("n"))
    return summed.join(size, [query, scorer]).select(query, scorer, score, "c", "n", "upto", ((F.col("upto") - F.col("c") / 2) / F.col("n")).alias("x"))


def _split_flows(best: DataFrame, query: str, scorer: str, score: str, threshold: float) -> DataFrame:
    """``query, scorer, score, plus, minus, n``: as :func:`list_flows` for lists of any size."""
    placed = _positions(best, query, scorer, score)
    others = F.greatest(F.col("n") - 1, F.lit(1))
    if not threshold:
        return placed.select(query, scorer, score, ((F.col("upto") - F.col("c")) / others).alias("plus"), ((F.col("n") - F.col("upto")) / others).alias("minus"), "n")
    data = placed.select(query, scorer, F.col("x").alias("at"), F.lit(0).alias("tag"), F.col("c").cast("double").alias("w"), (F.col("c") * F.col("x")).alias("wx"), F.lit(None).cast("double").alias("x"))
    asks = placed.select(query, scorer, "x", F.explode(F.array(*[F.struct((F.col("x") + d).alias("at"), F.lit(t).alias("tag")) for d, t in ((-threshold, 1), (0.0, 2), (threshold, 3))])).alias("_a"))
    asks = asks.select(query, scorer, "_a.at", "_a.tag", F.lit(0.0).alias("w"), F.lit(0.0).alias("wx"), "x")
    points = data.unionByName(asks).withColumn("_s", F.greatest(F.lit(-1), F.least(F.lit(STRETCHES), F.floor(F.col("at") * STRETCHES))))
    totals = points.groupBy(query, scorer, "_s").agg(F.sum("w").alias("_tw"), F.sum("wx").alias("_twx"))
    # At most STRETCHES + 2 rows of a list.
    before = Window.partitionBy(query, scorer).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(query, scorer, "_s", F.coalesce(F.sum("_tw").over(before), F.lit(0.0)).alias("_cw"), F.coalesce(F.sum("_twx").over(before), F.lit(0.0)).alias("_cwx"))
    inside = Window.partitionBy(query, scorer, "_s").orderBy("at", "tag").rowsBetween(Window.unboundedPreceding, 0)
    running = points.select(query, scorer, "_s", "x", "tag", F.sum("w").over(inside).alias("_w"), F.sum("wx").over(inside).alias("_wx"))
    asked = running.filter("tag > 0").join(carry, [query, scorer, "_s"]).select(query, scorer, "x", "tag", (F.col("_w") + F.col("_cw")).alias("_w"), (F.col("_wx") + F.col("_cwx")).alias("_wx"))
    pick = lambda t, v: F.max(F.when(F.col("tag") == t, F.col(v)))
    sums = asked.groupBy(query, scorer, "x").agg(*[pick(t, v).alias(f"{v}{t}") for t in (1, 2, 3) for v in ("_w", "_wx")])
    x, t = F.col("x"), F.lit(threshold)
    over = F.col("_w1") + ((F.col("_w2") - F.col("_w1")) * x - (F.col("_wx2") - F.col("_wx1"))) / t
    under = (F.col("n") - F.col("_w3")) + ((F.col("_wx3") - F.col("_wx2")) - (F.col("_w3") - F.col("_w2")) * x) / t
    return placed.join(sums, [query, scorer, "x"]).select(query, scorer, score, (over / others).alias("plus"), (under / others).alias("minus"), "n")


def flows_per_list(
    df: DataFrame, query: str = "query_id", item: str = "chunk_id", scorer: str = "retriever", score: str = "score", threshold: float = 0.25
) -> DataFrame:
    """``query, scorer, item, score, plus, minus, n``: an item's flows within each of its lists of n items."""
    best = usable_scores(df, query, item, scorer, score)
    names = [query, scorer, item, score]
    schema = T.StructType([*[best.schema[c] for c in names], T.StructField("plus", T.DoubleType()), T.StructField("minus", T.DoubleType()), T.StructField("n", T.LongType())])
    ordered = best.select(*names).repartitionByRange(query, scorer, score).sortWithinPartitions(query, scorer, score)
    flows = scratch_table(ordered.mapInArrow(_local(threshold, names), schema), "flows")
    open_ = flows.filter("n IS NULL").select(*names)
    finished = open_.join(_split_flows(open_, query, scorer, score, threshold), [query, scorer, score]).select(*names, "plus", "minus", "n")
    return flows.filter("n IS NOT NULL").unionByName(finished)


def outrank(
    df: DataFrame,
    query: str = "query_id",
    item: str = "chunk_id",
    scorer: str = "retriever",
    score: str = "score",
    weights: dict[str, float] | None = None,
    threshold: float = 0.25,
) -> DataFrame:
    """Net flow of every item that any scorer gave a usable score for the query.

    Columns ``query, item, net_flow, n_scores, n_scorers, most_outranked``: the weighted mean
    of the flows of all scorers that returned something usable for the query; how many of
    them scored the item; and the greatest negative flow of any of those lists, counted in
    items. With ``threshold`` 0 any difference is a full preference, and ``most_outranked``
    is the number of items strictly above. A scorer that does not return an item puts all of
    its list before it and counts -1. Scorers without any usable score for the query do not
    count. Repeated rows and several scores of one pair are one score, the highest; null
    keys, null and NaN scores are unusable, infinite ones are ordinary; lists without any
    difference and lists of one item give flow 0; no rows in, no rows out; other columns are
    ignored.
    """
    flows = flows_per_list(df, query, item, scorer, score, threshold)
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col(scorer) == name, F.lit(float(w))).otherwise(weight)
    rows = flows.withColumn("_w", weight)
    scorers = rows.groupBy(query, scorer, "_w").agg(F.lit(1).alias("_1")).groupBy(query).agg(F.count("*").alias("n_scorers"), F.sum("_w").alias("_all"))
    per_item = rows.groupBy(query, item).agg(
        F.sum(F.col("_w") * (F.col("plus") - F.col("minus"))).alias("_f"),
        F.sum("_w").alias("_seen"),
        F.count("*").alias("n_scores"),
        F.max(F.col("minus") * F.greatest(F.col("n") - 1, F.lit(1))).alias("most_outranked"),
    )
    return per_item.join(scorers, query).select(
        query, item, ((F.col("_f") - (F.col("_all") - F.col("_seen"))) / F.col("_all")).alias("net_flow"), "n_scores", "n_scorers", "most_outranked",
    )


def agreed_front(ranked: DataFrame, n: int) -> DataFrame:
    """Of a ranking with ``threshold`` 0 the items that every scorer puts in front.

    The negative flow decides: in each list fewer than ``n`` items are preferred to it.
    """
    return ranked.filter((F.col("n_scores") == F.col("n_scorers")) & (F.round("most_outranked", 6) < n))


def rank_by_flow(ranked: DataFrame, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """Adds ``position`` in each query: net flow (9 decimals) descending, then item."""
    keyed = ranked.withColumn("_f", F.round("net_flow", 9))
    return prefix_sums(keyed, [query], [F.col("_f").desc(), F.col(item)], {"position": F.lit(1)}).drop("_f")
