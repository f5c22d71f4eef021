"""The first rows of every query, kept while a task's rows pass by.

A task holds some thousand rows at a time and scores them for the queries, which it reads
block by block from the shared folder. Of each query it keeps the rows that can still be
among the first ``k`` of all it has seen, so what it hands on and holds is bounded by the
queries and not by the pairs of a query and a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Queries that are scored at once, rows that a task holds, hits it keeps before it hands them on.
QUERY_BLOCK, HELD_ROWS, HELD_HITS = 64, 16_384, 4_000_000
#: Rows that all tasks hand on should not be many more than this, as long as there are tasks for all cores.
HANDED_ON = 5_000_000
#: Scores are compared to 9 decimals later on: closer ones may be equal.
MARGIN = 1e-9

#: Scores of all held rows for a block of queries, as a matrix; what is no result lies below ``least``.
Scorer = Callable[[pa.RecordBatch], np.ndarray]


def stored(folder: str, columns: list[str] | None = None, size: int = 65_536) -> Iterator[pa.RecordBatch]:
    """Batches of a table in the shared folder, always in the same order."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, at = pafs.FileSystem.from_uri(folder)
    for path in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.base_name.startswith("part-")):
        with fs.open_input_file(path) as file:
            yield from (b for b in pq.ParquetFile(file).iter_batches(batch_size=size, columns=columns) if b.num_rows)


class Kept:
    """What a task keeps for a block of queries: hits, and what a query's score must reach."""

    def __init__(self, queries: pa.Array, k: int, least: float):
        self.queries, self.k, self.least = queries, k, least
        self.floor = np.full(len(queries), -np.inf)
        self.clear()

    def clear(self) -> None:
        self.q, self.row, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, scores: np.ndarray, base: int, names: list[pa.Array]) -> None:
        n, k = scores.shape[1], self.k
        limit, fresh = self.floor - MARGIN, np.isneginf(self.floor)
        if n > k and fresh.any():
            m = min(n, 20 * k)  # the k-th best of some rows is a bound for all
            limit[fresh] = np.partition(scores[fresh, :m], m - k, axis=1)[:, m - k] - MARGIN
        q, row = np.divmod(np.flatnonzero(scores >= np.maximum(limit, self.least)[:, None]), n)
        if not len(q):
            return
        self.q, self.row, self.score = np.r_[self.q, q], np.r_[self.row, row + base], np.r_[self.score, scores[q, row]]
        self._order(np.lexsort((-self.score, self.q)))
        first = np.searchsorted(self.q, np.arange(len(self.floor)))
        last = np.flatnonzero(np.arange(len(self.q)) - first[self.q] == k - 1)
        self.floor[self.q[last]] = self.score[last]
        self._order(np.flatnonzero(self.score >= self.floor[self.q] - MARGIN))
        if len(self.q) > 4 * k * len(self.floor):
            self._cut_ties(names)

    def _order(self, at: np.ndarray) -> None:
        self.q, self.row, self.score = self.q[at], self.row[at], self.score[at]

    def _cut_ties(self, names: list[pa.Array]) -> None:
        """Of rows with the very same score only the first ``k`` by name can count."""
        rows, back = np.unique(self.row, return_inverse=True)
        order = pc.sort_indices(pa.chunked_array(names).take(pa.array(rows))).to_numpy()
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows))
        self._order(np.lexsort((place[back], -self.score, self.q)))
        new = np.r_[True, (self.q[1:] != self.q[:-1]) | (self.score[1:] != self.score[:-1])]
        at = np.arange(len(self.q))
        self._order(np.flatnonzero(at - np.maximum.accumulate(np.where(new, at, 0)) < self.k))


def best_rows(folder: str, k: int, scorer: Callable[[pa.Table], Scorer], least: float):
    """A task's rows (with chunk_id) against all queries of the folder: ``query_id, chunk_id, score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        names: list[pa.Array] = []
        kept: list[Kept] = []

        def answer() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            base, score = sum(map(len, names)), scorer(rows)
            names.append(rows.column("chunk_id").chunk(0))
            for number, block in enumerate(stored(folder, size=QUERY_BLOCK)):
                if number == len(kept):
                    kept.append(Kept(block.column("query_id"), k, least))
                kept[number].add(score(block), base, names)
            if sum(len(x.q) for x in kept) > HELD_HITS or base + rows.num_rows > 1_000_000:
                yield from hand_on()

        def hand_on() -> Iterator[pa.RecordBatch]:
            every = pa.chunked_array(names, pa.string())
            for x in kept:
                if len(x.q):
                    found = every.take(pa.array(x.row)).combine_chunks()
                    yield pa.RecordBatch.from_arrays([x.queries.take(pa.array(x.q)), found.chunk(0) if isinstance(found, pa.ChunkedArray) else found, pa.array(x.score)], names=["query_id", "chunk_id", "score"])
                x.clear()
            names.clear()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= HELD_ROWS:
                yield from answer()
        if held:
            yield from answer()
        yield from hand_on()

    return run


def best_of(rows: DataFrame, folder: str, k: int, scorer: Callable[[pa.Table], Scorer], least: float) -> DataFrame:
    """At least the best ``k`` rows of every query, from tasks that are few if there are many queries."""
    spark = rows.sparkSession
    asked = max(1, spark.read.parquet(folder).count())
    tasks = max(spark.sparkContext.defaultParallelism, HANDED_ON // (asked * k))
    return rows.coalesce(tasks).mapInArrow(best_rows(folder, k, scorer, least), "query_id bigint, chunk_id string, score double")
