"""Percentiles of very large columns: mergeable relative-rank sketches.

A sketch is a stack of compactors. When a compactor is full its lower part is sorted and
every second value moves up one level with double weight; the upper part stays as it is.
How deep a compaction reaches follows a schedule (the number of trailing ones of a
counter), so the largest values are hardly ever touched: the rank error at a percentile
q is proportional to 1 - q, which keeps the 99th and 99.9th percentile sharp. Sketches of
partitions, days or whole tables are merged level by level.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.session import scratch_table

#: Values in one section of a compactor. The relative rank error is about 0.13 / SECTION (one sigma).
SECTION = 64
SECTIONS = 3
#: Values that a task lays out by group at a time (8 bytes each, thrice).
HELD_VALUES = 4_000_000


class RelativeSketch:
    """Levels of (values, compactions so far, section size, sections); weight 2**level."""

    def __init__(self, section: int = SECTION, seed: int = 1):
        self.section, self.n, self.rnd = section, 0, np.random.default_rng(seed)
        self.least, self.most = math.inf, -math.inf
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.state: list[int] = [0]

    def _sections(self, level: int) -> int:
        """More sections the more often a level was compacted, as its rank error adds up."""
        return SECTIONS + max(0, int(math.log2(self.state[level] + 1)) // 2)

    def _capacity(self, level: int) -> int:
        return 2 * self._sections(level) * self.section

    def update(self, values: np.ndarray) -> None:
        if len(values):
            self.n += len(values)
            self.least, self.most = min(self.least, float(values.min())), max(self.most, float(values.max()))
            self.levels[0] = np.concatenate([self.levels[0], values])
            self._compress()

    @classmethod
    def merged(cls, parts: list[RelativeSketch]) -> RelativeSketch:
        """All parts as one: levels are put together, then compressed once."""
        out = cls(parts[0].section)
        height = max(len(p.levels) for p in parts)
        out.levels = [np.concatenate([p.levels[h] for p in parts if h < len(p.levels)]) for h in range(height)]
        out.state = [0] * height
        for p in parts:
            for h, state in enumerate(p.state):
                out.state[h] |= state
        out.n = sum(p.n for p in parts)
        out.least, out.most = min(p.least for p in parts), max(p.most for p in parts)
        out._compress()
        return out

    def merge(self, other: RelativeSketch) -> None:
        self.__dict__.update({k: v for k, v in self.merged([self, other]).__dict__.items() if k != "rnd"})

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            if len(self.levels[h]) >= self._capacity(h):
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                    self.state.append(0)
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        values = np.sort(self.levels[h])
        deep = (~self.state[h] & (self.state[h] + 1)).bit_length()  # trailing ones + 1
        keep = self._capacity(h) - min(deep, self._sections(h)) * self.section
        cut = (len(values) - keep) // 2 * 2
        self.levels[h + 1] = np.concatenate([self.levels[h + 1], values[int(self.rnd.integers(2)) : cut : 2]])
        self.levels[h] = values[cut:]
        self.state[h] += 1

    def _weighted(self) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(v), 1 << h, dtype=np.int64) for h, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weights[order])

    def at_ranks(self, ranks: np.ndarray) -> np.ndarray:
        """The value at each 0-based rank; ranks outside give the least and greatest value."""
        if not self.n:
            return np.full(len(ranks), np.nan)
        values, upto = self._weighted()
        found = values[np.clip(np.searchsorted(upto, np.floor(ranks), side="right"), 0, len(values) - 1)]
        return np.where(ranks <= 0, self.least, np.where(ranks >= self.n - 1, self.most, found))

    def quantiles(self, probs: np.ndarray, sigmas: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Estimate, lower and upper bound at each probability.

        The bounds move the rank by ``sigmas`` standard errors of (1 - p) * n.
        """
        probs = np.asarray(probs, dtype=float)
        rank = probs * max(self.n - 1, 0)
        slack = sigmas * 0.13 / self.section * (self.n - rank) + (1 if sigmas else 0)
        exact = len(self.levels) == 1
        slack = np.where(exact, 1 if sigmas else 0, slack)
        return self.at_ranks(np.round(rank)), self.at_ranks(np.floor(rank - slack)), self.at_ranks(np.ceil(rank + slack))

    def to_bytes(self) -> bytes:
        head = struct.pack("<qddii", self.n, self.least, self.most, self.section, len(self.levels))
        body = b"".join(struct.pack("<qi", s, len(v)) + v.astype("<f8").tobytes() for v, s in zip(self.levels, self.state))
        return head + body

    @classmethod
    def from_bytes(cls, raw: bytes, seed: int = 1) -> RelativeSketch:
        n, least, most, section, count = struct.unpack_from("<qddii", raw)
        out, at = cls(section, seed), struct.calcsize("<qddii")
        out.n, out.least, out.most, out.levels, out.state = n, least, most, [], []
        for _ in range(count):
            state, size = struct.unpack_from("<qi", raw, at)
            at += 12
            out.levels.append(np.frombuffer(raw, "<f8", size, at).astype(float))
            out.state.append(state)
            at += 8 * size
        return out


def _codes(columns: list[pa.Array]) -> np.ndarray:
    """One number per row, equal for rows that agree in all columns; nulls agree."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for column in columns:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        own = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        code = np.unique(code * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    return code


def _build(groups: list[str], section: int):
    """Sketches of a task's rows: values are laid out by group, then each group is one array."""

    def flush(held: list[pa.RecordBatch], schema: pa.Schema) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        code = _codes([t.column(g) for g in groups])
        lists = t.column("values").chunk(0)
        size = np.diff(lists.offsets.to_numpy())
        flat, of = lists.flatten().to_numpy().astype(float), np.repeat(code, size)
        order = np.argsort(of, kind="stable")
        flat, ends = flat[order], np.cumsum(np.bincount(of, minlength=code.max() + 1))
        first = np.unique(code, return_index=True)[1]
        sketches = []
        for lo, hi in zip(np.r_[0, ends[:-1]], ends):
            sketch = RelativeSketch(section)
            sketch.update(flat[lo:hi])
            sketches.append(sketch)
        heads = t.select(groups).take(pa.array(first)).combine_chunks()
        columns = [heads.column(g).chunk(0).cast(schema.field(g).type) for g in groups]
        columns += [pa.array([x.n for x in sketches], pa.int64()), pa.array([x.to_bytes() for x in sketches], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[*groups, "n", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(pc.sum(pc.list_value_length(b.column("values"))).as_py() or 0 for b in held) > HELD_VALUES:
                yield flush(held, batch.schema)
                held = []
        if held:
            yield flush(held, held[0].schema)

    return run


def _merge(groups: list[str]):
    """Merges the sketches of equal groups, which come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, parts = None, []  # the group being read: a batch of one row, and its sketches

        def done() -> pa.RecordBatch:
            sketch = RelativeSketch.merged(parts)
            return pa.RecordBatch.from_arrays([*[head.column(g) for g in groups], pa.array([sketch.n], pa.int64()), pa.array([sketch.to_bytes()], pa.binary())], names=[*groups, "n", "sketch"])

        for batch in batches:
            if not batch.num_rows:
                continue
            code = _codes([batch.column(g) for g in groups])
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), batch.num_rows]
            raw = batch.column("sketch").to_pylist()
            for a, b in zip(cuts, cuts[1:]):
                here = batch.slice(a, 1).select(groups)
                if head is not None and not here.equals(head):
                    yield done()
                    parts = []
                head = here
                parts += [RelativeSketch.from_bytes(x) for x in raw[a:b]]
                if len(parts) > 64:
                    parts = [RelativeSketch.merged(parts)]
        if head is not None:
            yield done()

    return run


def element_values(df: DataFrame, groups: list[str], values: str) -> DataFrame:
    """``groups`` and ``values``: each row's usable elements (not null, not NaN, not negative), if it has any."""
    usable = F.filter(F.col(values).cast("array<double>"), lambda x: (x >= 0) & ~F.isnan(x))
    return df.select(*groups, usable.alias("values")).filter(F.size("values") > 0)


def _schema(df: DataFrame, groups: list[str], rest: str) -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*groups).schema], rest])


def build_sketches(values: DataFrame, groups: list[str], section: int = SECTION) -> DataFrame:
    """One sketch per combination of ``groups`` (add a day to keep daily sketches).

    Every task sketches its own rows; only sketches are shuffled, one of a few kilobytes per
    task and group, so a group with a third of all rows is no larger than others. Null
    group values form groups; groups without a usable value do not appear.
    """
    parts = values.select(*groups, "values").mapInArrow(_build(groups, section), _schema(values, groups, "n bigint, sketch binary"))
    return merge_sketches(parts, groups)


def merge_sketches(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of days, partitions or tables combined into one per ``groups``.

    Equal groups are merged as they stream by, in a fixed order: a repeated task gives the
    same sketch again.
    """
    ordered = sketches.select(*groups, "n", "sketch").repartition(*groups).sortWithinPartitions(*groups, "sketch")
    return ordered.mapInArrow(_merge(groups), _schema(sketches, groups, "n bigint, sketch binary"))


def sketch_quantiles(sketches: DataFrame, groups: list[str], probs: list[float], sigmas: float = 4.0) -> DataFrame:
    """Rows ``groups, n, p, estimate, lower, upper``; the bounds hold at ``sigmas`` errors."""
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in sketches.select(*groups).schema], "n bigint", "p double", "estimate double", "lower double", "upper double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                *g, n, raw = row
                for p, e, lo, hi in zip(probs, *RelativeSketch.from_bytes(raw).quantiles(np.array(probs), sigmas)):
                    out.append((*g, n, p, e, lo, hi))
            if out:
                yield pd.DataFrame(out, columns=[*groups, "n", "p", "estimate", "lower", "upper"])

    return sketches.select(*groups, "n", "sketch").mapInPandas(run, schema)


def _same(a: DataFrame, b: DataFrame, groups: list[str]):
    cond = F.lit(True)
    for g in groups:
        cond = cond & a[g].eqNullSafe(b[f"_b_{g}"])
    return cond


def _between(values: DataFrame, bounds: DataFrame, groups: list[str]) -> DataFrame:
    """Percentiles from the values between bounds; null where a rank lies outside them."""
    b = bounds.select(*[F.col(g).alias(f"_b_{g}") for g in groups], "p", "n", "lower", "upper")
    inside = F.filter("values", lambda x: (x >= F.col("lower")) & (x <= F.col("upper")))
    below = F.size(F.filter("values", lambda x: x < F.col("lower")))
    counted = F.concat(F.array(F.struct(F.lit(None).cast("double").alias("v"), below.alias("c"))), F.transform(inside, lambda x: F.struct(x.alias("v"), F.lit(1).alias("c"))))
    near = values.join(b, _same(values, b, groups)).select(*groups, "p", "n", F.explode(counted).alias("_e"))
    by_value = near.groupBy(*groups, "p", "n", F.col("_e.v").alias("_v")).agg(F.sum("_e.c").alias("c"))
    order = Window.partitionBy(*groups, "p", "n").orderBy(F.col("_v").asc_nulls_first())
    upto = by_value.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.col("p") * (F.col("n") - 1)
    hit = lambda r: F.min(F.when(F.col("upto") > r, F.struct("upto", "_v")))["_v"]
    picked = upto.groupBy(*groups, "p", "n").agg(hit(F.floor(rank)).alias("a"), hit(F.ceil(rank)).alias("b"))
    part = rank - F.floor(rank)
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * part)
    return picked.select(*groups, "p", "n", value.alias("value"))


def exact_quantiles(values: DataFrame, bounds: DataFrame, groups: list[str]) -> DataFrame:
    """Exact percentiles (linear interpolation) from the values between a sketch's bounds.

    For every group and p the values below ``lower`` are only counted, and the few within
    [lower, upper] are counted by value and ordered. Where one of the two ranks lies outside
    the bounds, which six standard errors make improbable, the bounds are widened to
    everything: no group is lost. Columns ``groups, p, n, value``.
    """
    found = scratch_table(_between(values, bounds, groups), "quantiles")
    lost = found.filter("value IS NULL")
    if lost.isEmpty():
        return found
    open_ = lost.select(*groups, "p", "n", F.lit(-math.inf).alias("lower"), F.lit(math.inf).alias("upper"))
    return found.filter("value IS NOT NULL").unionByName(_between(values, open_, groups))


def tail_heavy_groups(values: DataFrame, groups: list[str], high: float, middle: float, times: float) -> DataFrame:
    """Groups whose ``high`` percentile is at least ``times`` their ``middle`` one.

    The sketches decide which groups cannot qualify (their bounds at six standard errors
    lie too far off); the rest is checked exactly. Columns ``groups, n, middle, high``.
    """
    values = scratch_table(values, "values")
    probs = [middle, high]
    # Written down: a row per group and p, which decides by its size how the values meet it.
    bounds = scratch_table(sketch_quantiles(build_sketches(values, groups), groups, probs, sigmas=6.0), "bounds")
    pair = bounds.groupBy(*groups, "n").agg(
        F.max(F.when(F.col("p") == high, F.col("upper"))).alias("_high"), F.max(F.when(F.col("p") == middle, F.col("lower"))).alias("_mid")
    )
    possible = pair.filter(F.col("_high") >= times * F.col("_mid")).select(*[F.col(g).alias(f"_b_{g}") for g in groups])
    open_ = bounds.join(possible, _same(bounds, possible, groups), "left_semi")
    exact = exact_quantiles(values, open_, groups)
    both = exact.groupBy(*groups, "n").agg(
        F.max(F.when(F.col("p") == middle, F.col("value"))).alias("middle"), F.max(F.when(F.col("p") == high, F.col("value"))).alias("high")
    )
    return both.filter(F.col("high") >= times * F.col("middle"))
