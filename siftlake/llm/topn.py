"""Top N rows of every group, reading only row groups that can still matter.

The rows are clustered by group into parquet files. Within a file the row groups are bands
of depth: the first holds the best rows of each of the file's groups, the next twice as
many of the following ones, and so on, whatever N will be asked. Beside the files stands a
table of statistics: for every row group and every group in it the number of rows, and the
best and the worst of them: greatest and least score, with the ties that order equal scores.
A reader goes through row groups from the top and skips one as soon as its best row is
strictly below the N-th best of every group in it. Two sources give those N-th rows: the
statistics (row groups with N rows of a group prove that their worst row is reached N times),
and the rows read so far.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.session import scratch_path, scratch_table

#: Rows of a group in the first band; each further band holds twice as many as the one before.
BAND_ROWS = 32
#: Rows of a row group, about. For tables of terabytes on an object store raise it to some 100,000.
ROW_GROUP_ROWS = 4_096


def holding_scores(scored: DataFrame, group: str, item: str, when: str, score: str, carry: list[str]) -> DataFrame:
    """Of the rows of one (group, item) the one with the latest ``when``.

    Among equal times the greatest (score, carried columns) holds, a null score being the
    least. Rows with a null group or item are no candidates. The result is range-partitioned
    by group and a hash of the item: groups lie together, and a group with a third of all
    rows is spread over a third of the tasks. That one shuffle also serves the layout.
    """
    known = scored.filter(F.col(group).isNotNull() & F.col(item).isNotNull()).select(group, item, F.struct(when, score, *carry).alias("_b"), F.xxhash64(item).alias("_h"))
    best = known.repartitionByRange(group, "_h").groupBy(group, "_h", item).agg(F.max("_b").alias("_b"))
    return best.select(group, item, f"_b.{score}", *[f"_b.{c}" for c in carry])


@dataclass
class Layout:
    """Clustered files and their statistics: ``file, rg, band, rows, member, n, best, worst``, a row per row group and group."""

    statistics: DataFrame
    group: str
    score: str
    ties: list[str]
    schema: T.StructType


def _filesystem(path: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _lay_out(path: str, group: str, columns: list[str], band_rows: int, group_rows: int):
    """Writes a partition, sorted by (group, best first), as one file in bands; gives its statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        file, writer, written = f"{path}/part-{uuid.uuid4().hex}.parquet", None, 0
        bands: dict[int, list[pa.RecordBatch]] = {}
        last, rank = None, 0

        def flush(band: int) -> pa.RecordBatch:
            nonlocal writer, written
            t = pa.Table.from_batches(bands.pop(band))
            if writer is None:
                fs, at = _filesystem(file)
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                writer = pq.ParquetWriter(at, t.schema, filesystem=fs, compression="snappy")
            writer.write_table(t, row_group_size=t.num_rows)
            g = t.column(group).combine_chunks()  # groups one after the other, each from its best row down
            first = np.flatnonzero(np.r_[True, pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)])
            last_row = np.r_[first[1:], len(g)] - 1
            keys = [c for c in columns if c != group]
            best, worst = (pa.StructArray.from_arrays([t.column(c).combine_chunks().take(pa.array(at)) for c in keys], names=keys) for at in (first, last_row))
            n = len(first)
            numbers = [pa.array(np.full(n, written, dtype=np.int32)), pa.array(np.full(n, band, dtype=np.int32)), pa.array(np.full(n, t.num_rows, dtype=np.int64))]
            written += 1
            return pa.RecordBatch.from_arrays([pa.array([file] * n), *numbers, g.take(pa.array(first)), pa.array(last_row - first + 1), best, worst], names=["file", "rg", "band", "rows", "member", "n", "best", "worst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(columns.index(group))
            new = np.r_[last is None or g[0].as_py() != last, pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)].astype(bool)
            start = np.maximum.accumulate(np.where(new, np.arange(len(g)), -rank if not new[0] else 0))
            place = np.arange(len(g)) - start
            last, rank = g[len(g) - 1].as_py(), int(place[-1]) + 1
            band = np.log2(place // band_rows + 1).astype(np.int64)
            for b in np.unique(band).tolist():
                part = batch.filter(pa.array(band == b))
                bands.setdefault(b, []).append(part)
                if sum(x.num_rows for x in bands[b]) >= group_rows:
                    yield flush(b)
        for b in sorted(bands):
            yield flush(b)
        if writer is not None:
            writer.close()

    return run


def lay_out(df: DataFrame, group: str, score: str, ties: list[str], band_rows: int = BAND_ROWS, group_rows: int = ROW_GROUP_ROWS, placed: bool = False) -> Layout:
    """Write ``df`` (usable rows) clustered by group in bands of depth.

    ``placed``: the rows of a group lie together already, as :func:`holding_scores` gives
    them; else they are range-partitioned, so that a group of any size is spread over as
    many files as its share of the rows. A repeated task writes another file; only those
    that the statistics name are ever read.
    """
    columns = [group, score, *ties]
    usable = df.select(*columns).filter(F.col(group).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    if not placed:
        usable = usable.withColumn("_h", F.xxhash64(*columns)).repartitionByRange(group, "_h").select(*columns)
    ordered = usable.sortWithinPartitions(group, F.col(score).desc(), *[F.col(t).asc_nulls_last() for t in ties])
    key = T.StructType([usable.schema[c] for c in (score, *ties)])
    fields = [("file", T.StringType()), ("rg", T.IntegerType()), ("band", T.IntegerType()), ("rows", T.LongType()), ("member", usable.schema[group].dataType), ("n", T.LongType()), ("best", key), ("worst", key)]
    path = scratch_path(df.sparkSession, "clustered")
    statistics = ordered.mapInArrow(_lay_out(path, group, columns, band_rows, group_rows), T.StructType([T.StructField(*f) for f in fields]))
    return Layout(scratch_table(statistics, "statistics"), group, score, ties, T.StructType([usable.schema[c] for c in columns]))


def row_group_plan(layout: Layout, n: int) -> DataFrame:
    """One row per row group: ``file, rg, band, rows, members, bests, skip``.

    A group's proven N-th row is the worst row of the row groups that, taken in descending
    order of their worst, hold N of its rows; ``skip`` tells that the best row of each
    contained group is strictly below that group's.
    """

    def key(row: str) -> Column:
        """Ascending from the best row: score descending, then the ties, nulls last."""
        ties = [x for t in layout.ties for x in (F.col(f"{row}.{t}").isNull().alias(f"no_{t}"), F.col(f"{row}.{t}"))]
        return F.struct((-F.col(f"{row}.{layout.score}")).alias("below"), *ties)

    keyed = layout.statistics.withColumns({"_best": key("best"), "_worst": key("worst")})
    by = Window.partitionBy("member").orderBy("_worst", "file", "rg").rowsBetween(Window.unboundedPreceding, 0)
    reached = keyed.withColumn("_upto", F.sum("n").over(by))
    proven = reached.withColumn("_nth", F.min(F.when(F.col("_upto") >= n, F.col("_worst"))).over(Window.partitionBy("member")))
    below = F.coalesce(F.col("_best") > F.col("_nth"), F.lit(False))
    return proven.groupBy("file", "rg", "band", "rows").agg(
        F.min(below.cast("int")).cast("boolean").alias("skip"), F.collect_list(F.struct("member", "best")).alias("_m")
    ).select("file", "rg", "band", "rows", F.col("_m.member").alias("members"), F.col("_m.best").alias("bests"), "skip")


def _read_descending(group: str, score: str, ties: list[str], columns: list[str], n: int):
    def best(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, *ties], ascending=[False] + [True] * len(ties), na_position="last", kind="stable")
        return rows[rows.groupby(group, sort=False).cumcount() < n]

    def key(row) -> tuple:
        """As in the plan; ``row`` maps columns to values."""
        return (-row[score], *[x for t in ties for x in ((True, 0) if pd.isna(row[t]) else (False, row[t]))])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for pdf in batches:
            for file, plan in zip(pdf["file"], pdf["plan"]):
                fs, at = _filesystem(file)
                source = pq.ParquetFile(at, filesystem=fs)
                kept, nth, band = None, {}, None
                for part in sorted(plan, key=lambda p: (p["band"], p["rg"])):
                    if part["band"] != band and kept is not None:  # every deeper band is met with the N-th rows of all before
                        kept = best(kept)
                        last = kept[kept.groupby(group, sort=False).cumcount() == n - 1]
                        nth = {r[group]: key(r) for r in last.to_dict("records")}
                    band = part["band"]
                    if nth and all(g in nth and key(h) > nth[g] for g, h in zip(part["members"], part["bests"])):
                        continue
                    rows = source.read_row_group(int(part["rg"]), columns=columns).to_pandas()
                    kept = rows if kept is None else pd.concat([kept, rows], ignore_index=True)
                if kept is not None and len(kept):
                    yield best(kept)[columns]

    return read


def top_n(layout: Layout, n: int) -> DataFrame:
    """The ``n`` best rows of every group of a layout; see :func:`top_n_per_group`."""
    group, score, ties = layout.group, layout.score, layout.ties
    columns = [group, score, *ties]
    plan = row_group_plan(layout, n).filter(~F.col("skip"))
    tasks = plan.groupBy("file").agg(F.collect_list(F.struct("rg", "band", "members", "bests")).alias("plan"))
    # A file's plan is some kilobytes, and AQE would make one task of all.
    tasks = tasks.repartition(max(1, layout.statistics.select("file").distinct().count()))
    best = tasks.mapInPandas(_read_descending(group, score, ties, columns, n), layout.schema)
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), *[F.col(t).asc_nulls_last() for t in ties])
    # Every file has given at most n rows of a group, so this window is short.
    return best.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def top_n_per_group(
    df: DataFrame, group: str, score: str, n: int, ties: list[str], band_rows: int = BAND_ROWS, group_rows: int = ROW_GROUP_ROWS, placed: bool = False
) -> DataFrame:
    """The ``n`` best rows of every group: columns group, score, ties and ``position``.

    Order: score descending, then ``ties`` ascending with nulls last; give ties that end
    in a unique column. Rows whose score is null or NaN and rows without a group are no
    candidates; infinite scores are. Groups with fewer candidates give all of them; equal
    scores at the N-th place are decided by the ties; fully equal rows count as often as
    they occur. No rows in, no rows out. Other columns are not read.
    """
    return top_n(lay_out(df, group, score, ties, band_rows, group_rows, placed), n)
