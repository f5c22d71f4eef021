"""Filling containers of fixed capacity: multiway differencing.

Items are spread over shards by hash; each shard is packed for itself, so the work is
one pass over numbers. In a shard the partitions to merge are those with the largest
imbalance, and they are merged against each other: the fullest windows of one with the
emptiest of the other. That gives windows of nearly equal size. If windows still
overflow, they exchange items with windows that have room, and only for what stays over the
number of windows is raised and differenced again.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.bytetokens import token_counts
from siftlake.session import scratch_table

#: Exchanges are looked for in blocks of at most this many pairs of offers.
BLOCK_OFFERS = 4_000_000
#: Items of a shard: enough to fill windows well, few enough for one short task.
SHARD_ITEMS = 1_000


def public_tokenizer(path: str) -> Callable[[pa.Array], np.ndarray]:
    """Token counts by a tokenizer file of the ``tokenizers`` library, for ``sizes(count=...)``."""

    def count(texts: pa.Array) -> np.ndarray:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return np.array([len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)], dtype=np.int64)

    return count


def sizes(df: DataFrame, key: str, text: str, keep: list[str] | None = None, count: Callable[[pa.Array], np.ndarray] = token_counts) -> DataFrame:
    """``key``, the kept columns and ``tokens`` of the whole text (0 if null); null keys are left out."""
    columns = [key, *(keep or [])]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema], "tokens bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(count(b.column(0)))], names=[*columns, "tokens"])

    return df.filter(F.col(key).isNotNull()).select(F.col(text).alias("_text"), *columns).mapInArrow(run, schema)


def difference(weights: np.ndarray, k: int) -> tuple[list[list[int]], np.ndarray]:
    """Karmarkar-Karp differencing into ``k`` parts: the items of each part and their sums.

    A partial partition is kept as its non-empty parts in descending order of size.
    """
    heap: list = []
    for i in np.argsort(-weights, kind="stable"):
        w = int(weights[i])
        heap.append((-w, len(heap), np.array([w]), [[int(i)]]))
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a, xs = heapq.heappop(heap)
        _, _, b, ys = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            sums, parts = np.concatenate([a, b]), xs + ys
        else:  # the smallest of the one meet the smallest of the other crosswise; the rest meet empty parts
            meet = a[len(a) - over :] + b[len(b) - over :][::-1]
            sums = np.concatenate([a[: len(a) - over], b[: len(b) - over], meet])
            mixed = [x + y for x, y in zip(xs[len(a) - over :], ys[len(b) - over :][::-1])]
            parts = xs[: len(a) - over] + ys[: len(b) - over] + mixed
        order = np.argsort(-sums, kind="stable")
        sums, parts = sums[order], [parts[i] for i in order]
        gap = int(sums[0]) - (int(sums[-1]) if len(sums) == k else 0)
        serial += 1
        heapq.heappush(heap, (-gap, serial, sums, parts))
    if not heap:
        return [], np.empty(0, dtype=np.int64)
    return heap[0][3], heap[0][2]


def _subsets(weights: np.ndarray, part: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """Single items and pairs of a window, one for each different weight."""
    found: dict[int, tuple[int, ...]] = {}
    kinds: dict[int, list[int]] = {}
    for x in part:
        kinds.setdefault(int(weights[x]), []).append(x)
    for w, xs in kinds.items():
        found.setdefault(w, (xs[0],))
    ordered = list(kinds.items())
    for i, (w, xs) in enumerate(ordered):
        if len(xs) > 1:
            found.setdefault(2 * w, (xs[0], xs[1]))
        for u, ys in ordered[i + 1 :]:
            found.setdefault(w + u, (xs[0], ys[0]))
    return list(found.items())


def _exchange(give: list, offers: list, room: np.ndarray, need: int) -> tuple[int, int, int] | None:
    """(offer given, window, offer taken): the exchange that frees ``need`` with least to spare, else the
    one that frees most; none if none frees anything."""
    mine, best, found = np.array([w for w, _ in give]), None, None
    windows = np.flatnonzero(room > 0)
    sizes = np.array([len(offers[i]) for i in windows], dtype=np.int64)
    at = 0
    while at < len(windows):  # some windows at a time: those with many small items have many offers
        upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]) * len(mine), BLOCK_OFFERS)))
        some = windows[at:upto]
        where = np.repeat(some, sizes[at:upto])
        theirs = np.array([w for i in some for w, _ in offers[i]])
        which = np.concatenate([np.arange(n) for n in sizes[at:upto]])
        gain = mine[:, None] - theirs[None, :]
        fits = (gain > 0) & (gain <= room[where][None, :])
        if fits.any():
            cures = fits & (gain >= need)
            rank = np.where(cures, gain - need, np.where(fits, (1 << 40) - gain, 1 << 60))
            i, j = np.unravel_index(int(np.argmin(rank)), gain.shape)
            if best is None or rank[i, j] < best:
                best, found = rank[i, j], (int(i), int(where[j]), int(which[j]))
        at = upto
    return found


def _settle(weights: np.ndarray, parts: list[list[int]], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Windows that overflow a little exchange one or two items with windows that have room.

    For the fullest window the exchange that just cures it is taken, else the one that
    helps most. A window that no exchange helps gives up the smallest item that suffices.
    Returns windows that all fit and the items given up.
    """
    loose: list[int] = []
    parts = [list(p) for p in parts]
    room = np.array([capacity - int(weights[p].sum()) for p in parts])
    offers = [[(0, ()), *_subsets(weights, p)] for p in parts]
    while room[full := int(np.argmin(room))] < 0:
        give = offers[full][1:]
        found = _exchange(give, offers, room, int(-room[full]))
        if found is None:
            enough = [x for x in parts[full] if weights[x] >= -room[full]] or parts[full]
            item = min(enough, key=lambda x: (weights[x], x))
            parts[full].remove(item)
            loose.append(item)
            changed = (full,)
        else:
            i, other, j = found
            out, back = give[i][1], offers[other][j][1]
            parts[full] = [x for x in parts[full] if x not in out] + list(back)
            parts[other] = [x for x in parts[other] if x not in back] + list(out)
            changed = (full, other)
        for w in changed:
            room[w] = capacity - int(weights[parts[w]].sum())
            offers[w] = [(0, ()), *_subsets(weights, parts[w])]
    return parts, loose


def fill(weights: np.ndarray, capacity: int, exchange: bool = True) -> list[list[int]]:
    """Parts of at most ``capacity``; every weight must fit.

    Differencing into as many windows as the total needs makes them nearly equal. Windows
    that overflow are settled by exchanges; what they still have to give up goes, again by
    differencing, into additional windows: the number rises only by what is over. Without
    ``exchange`` the number is raised and everything differenced again until all fit, which
    takes more windows if these hold few items each.
    """
    if not len(weights):
        return []
    k = min(len(weights), max(1, math.ceil(int(weights.sum()) / capacity)))
    parts, sums = difference(weights, k)
    if not exchange:
        while sums.max() > capacity:
            k = min(len(weights), k + max(1, int((sums > capacity).sum()) // 4))
            parts, sums = difference(weights, k)
        return [p for p in parts if p]
    loose: list[int] = []
    if sums[0] > capacity:
        parts, loose = _settle(weights, parts, capacity)
    out = [p for p in parts if p]
    if len(loose) == len(weights):
        return [[i] for i in loose]
    at = np.array(loose, dtype=np.int64)
    return out + [[int(at[i]) for i in p] for p in fill(weights[at], capacity)]


def pack(sized: DataFrame, key: str, capacity: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Items ``key, tokens`` put into containers: ``container, key, piece, tokens``.

    An item of at most ``capacity`` tokens is never cut. A larger one is cut into full
    containers (pieces 0, 1, ...) of its own and a last piece that is packed with the
    others. Items of no tokens are in no container. Containers are named
    ``shard-number``, cut pieces have ``key-piece``. Keys must be unique; equal sizes,
    many or few items and no items at all are fine; sizes must not be null.
    """
    sized = scratch_table(sized.select(key, "tokens").filter("tokens > 0"), "sizes")
    n = sized.filter(F.col("tokens") % capacity != 0).count()
    shards = max(1, math.ceil(n / shard_items))
    whole = F.floor(F.col("tokens") / capacity)
    full = sized.filter(whole > 0).select(key, F.explode(F.sequence(F.lit(0), (whole - 1).cast("int"))).alias("piece"))
    full = full.select(F.concat_ws("-", F.lit("cut"), F.col(key).cast("string"), "piece").alias("container"), key, "piece", F.lit(capacity).cast("bigint").alias("tokens"))
    rest = sized.select(key, whole.cast("int").alias("piece"), (F.col("tokens") % capacity).alias("tokens")).filter("tokens > 0")
    kind = sized.schema[key].dataType.simpleString()

    def one_shard(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "piece"], kind="stable").reset_index(drop=True)
        number = np.empty(len(pdf), dtype=np.int64)
        for i, part in enumerate(fill(pdf["tokens"].to_numpy(), capacity)):
            number[part] = i
        return pd.DataFrame({"container": [f"{key_[0]}-{i}" for i in number], key: pdf[key], "piece": pdf["piece"], "tokens": pdf["tokens"]})

    # A fixed number of tasks: the rows are few bytes, which would otherwise all become one task.
    placed = rest.withColumn("_shard", F.pmod(F.xxhash64(key, "piece"), F.lit(shards))).repartition(min(shards, 10_000), "_shard")
    packed = placed.groupBy("_shard").applyInPandas(
        one_shard, f"container string, `{key}` {kind}, piece int, tokens bigint"
    )
    return full.unionByName(packed)
