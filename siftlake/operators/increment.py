"""Processing only what is new or changed: a ledger of disjoint sequence intervals.

Every record has a position on an axis (an offset in a partition, a chunk number in
a run). The ledger holds the positions that committed batches have processed, as
disjoint half-open intervals per axis. What is left to do is *available minus
ledger*; that subtraction also finds gaps in the middle, so a record that shows up
late with a low number, or that belonged to a batch that died, is neither skipped
nor processed twice. A batch's output and the merged intervals of everything done so
far become visible together, as the next numbered version of the ledger; of two
writers that worked on one version only one can publish the next.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.session import scratch_table

#: Axes are cut into stretches of this many positions, so that one long axis is not one task.
STRETCH = 1 << 24
#: Sequence numbers of an axis of file versions, about.
AXIS = 1 << 16


def _cut(ranges: DataFrame, lo: str, hi: str, stretch: int) -> DataFrame:
    """Split every interval at the borders of the stretches it touches."""
    pieces = ranges.withColumn(
        "_s", F.explode(F.expr(f"sequence({lo} div {stretch}L, ({hi} - 1) div {stretch}L)"))
    )
    return (
        pieces.withColumn(lo, F.greatest(F.col(lo), F.col("_s") * stretch))
        .withColumn(hi, F.least(F.col(hi), (F.col("_s") + 1) * stretch))
    )


def _islands(ranges: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.coalesce((F.col(lo) > reach).cast("int"), F.lit(1)))
    marked = marked.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")


def _across(inner: DataFrame, keys: list[str], lo: str, hi: str, stretch: int) -> DataFrame:
    """Joins the intervals that meet at a border of two stretches; the others stay with their stretch."""
    at_border = F.expr(f"`{lo}` % {stretch}L = 0 OR `{hi}` % {stretch}L = 0")
    place = F.when(at_border, F.lit(-1)).otherwise(F.expr(f"`{lo}` div {stretch}L"))
    return _islands(inner.withColumn("_g", place), [*keys, "_g"], lo, hi).select(*keys, lo, hi)


def merge_ranges(ranges: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", stretch: int = STRETCH) -> DataFrame:
    """Overlapping or touching intervals [lo, hi) of an axis made one.

    Works in two levels: inside each stretch of an axis, then across the borders between
    stretches, which at most two of a stretch's merged intervals touch; the others are
    final and never meet in one task. Rows with a null bound and empty or
    negative intervals are ignored; a null key is an axis of its own; repeated rows and
    overlaps change nothing; no rows give no rows. Other columns are dropped.
    """
    ranges = ranges.select(*keys, F.col(lo).cast("bigint").alias(lo), F.col(hi).cast("bigint").alias(hi))
    ranges = ranges.filter(F.col(hi) > F.col(lo))
    inner = _islands(_cut(ranges, lo, hi, stretch), [*keys, "_s"], lo, hi).drop("_s")
    return _across(inner, keys, lo, hi, stretch)


def subtract_ranges(
    available: DataFrame, processed: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", stretch: int = STRETCH
) -> DataFrame:
    """The disjoint intervals that are available and not processed: the work list.

    A sweep over interval borders inside each stretch; borders that touch are joined
    again afterwards. Nulls and empty intervals as in :func:`merge_ranges`.
    """
    a = _cut(merge_ranges(available, keys, lo, hi, stretch), lo, hi, stretch).withColumn("_a", F.lit(1)).withColumn("_p", F.lit(0))
    p = _cut(merge_ranges(processed, keys, lo, hi, stretch), lo, hi, stretch).withColumn("_a", F.lit(0)).withColumn("_p", F.lit(1))
    both = a.unionByName(p)
    border = both.select(
        *keys,
        "_s",
        F.explode(
            F.array(
                F.struct(F.col(lo).alias("at"), F.col("_a").alias("da"), F.col("_p").alias("dp")),
                F.struct(F.col(hi).alias("at"), (-F.col("_a")).alias("da"), (-F.col("_p")).alias("dp")),
            )
        ).alias("b"),
    )
    at = border.groupBy(*keys, "_s", F.col("b.at").alias("at")).agg(F.sum("b.da").alias("da"), F.sum("b.dp").alias("dp"))
    by = Window.partitionBy(*keys, "_s").orderBy("at")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    swept = at.select(
        *keys,
        "_s",
        F.col("at").alias(lo),
        F.lead("at").over(by).alias(hi),
        F.sum("da").over(upto).alias("_a"),
        F.sum("dp").over(upto).alias("_p"),
    )
    gaps = _islands(swept.filter("_a > 0 AND _p = 0").drop("_a", "_p"), [*keys, "_s"], lo, hi)
    return _across(gaps.drop("_s"), keys, lo, hi, stretch)


def mark_covered(
    records: DataFrame, ledger: DataFrame, keys: list[str], lo: Column, hi: Column, stretch: int = STRETCH
) -> DataFrame:
    """``records`` plus ``covered``: whether one ledger interval holds all of [lo, hi).

    ``ledger`` has columns ``keys``, ``lo``, ``hi`` with disjoint, merged intervals. The
    join is on (axis, stretch), never on the axis alone. Records with a null bound and
    empty ranges are not covered.
    """
    parts = ledger.select(
        *[F.col(k).alias(f"_l{i}") for i, k in enumerate(keys)],
        F.col("lo").alias("_llo"),
        F.col("hi").alias("_lhi"),
        F.explode(F.expr(f"sequence(lo div {stretch}L, (hi - 1) div {stretch}L)")).alias("_ls"),
    )
    placed = records.withColumn("_lo", lo.cast("bigint")).withColumn("_hi", hi.cast("bigint"))
    placed = placed.withColumn("_at", F.expr(f"_lo div {stretch}L"))
    on = (F.col("_at") == F.col("_ls")) & (F.col("_llo") <= F.col("_lo")) & (F.col("_hi") <= F.col("_lhi")) & (F.col("_lo") < F.col("_hi"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_l{i}"))
    joined = placed.join(parts, on, "left").withColumn("covered", F.col("_ls").isNotNull())
    return joined.select(*records.columns, "covered")


def current_versions(observations: DataFrame, path: str = "path", version: str = "mtime_ns", seen: str = "seen_at") -> DataFrame:
    """One row per path: the version with the latest ``seen``; among equals the higher version."""
    best = F.max(F.struct(F.col(seen), F.col(version)))
    return observations.filter(F.col(path).isNotNull()).groupBy(path).agg(best.alias("_b")).select(path, F.col(f"_b.{version}").alias(version))


def completed_ledger(manifest: DataFrame, runs: DataFrame) -> DataFrame:
    """Chunk positions that successful runs finished, as disjoint intervals per run.

    A file without chunks still has a range: positions are doubled, a file with ``count``
    chunks at ``start`` covers [2*start, 2*(start+count)), an empty one [2*start,
    2*start+1), so that its completion is on record as well.
    """
    done = _entries(manifest).join(runs.filter(F.col("status") == "ok").select("run_id").distinct(), "run_id")
    return merge_ranges(done.select("run_id", *_extent()), ["run_id"])


def _entries(manifest: DataFrame) -> DataFrame:
    whole = manifest.select("run_id", "path", "mtime_ns", F.col("start").cast("bigint").alias("start"), F.col("count").cast("bigint").alias("count"))
    return whole.dropna()


def _extent() -> tuple[Column, Column]:
    lo = 2 * F.greatest(F.col("start"), F.lit(0))
    hi = lo + F.when(F.col("count") > 0, 2 * F.col("count")).otherwise(1)
    return lo.alias("lo"), hi.alias("hi")


def version_axes(versions: DataFrame, length: int = AXIS) -> DataFrame:
    """Gives every different (path, mtime_ns) a sequence number: columns ``axis, seq, path, mtime_ns``.

    Paths are spread over axes of about ``length`` numbers by hash, so an axis is one small
    task however many files there are. Within an axis numbers are dense, so files that
    need nothing lie side by side and their numbers merge into few intervals.
    """
    versions = versions.select("path", "mtime_ns").distinct()
    axes = max(1, -(-versions.count() // length))
    placed = versions.withColumn("axis", F.pmod(F.xxhash64("path"), F.lit(axes)))
    order = Window.partitionBy("axis").orderBy("path", F.col("mtime_ns").asc_nulls_first())
    return placed.withColumn("seq", (F.row_number().over(order) - 1).cast("bigint")).select("axis", "seq", "path", "mtime_ns")


def files_to_process(files: DataFrame, manifest: DataFrame, runs: DataFrame, axis_length: int = AXIS) -> DataFrame:
    """The files that the next run must take up, whatever failed in between.

    Two subtractions of intervals. Within each run, the chunk ranges that manifest entries
    lay claim to are set against the positions that a successful run completed: entries in
    a gap (the run died, or the entry was never filled in) are not done. Across runs, every
    version of a file has a sequence number; the versions that the tree holds now are
    available, the versions of the last completed entries are processed, and available
    minus processed is the work list, as intervals, from which the files follow. A file
    whose time went back to one that an earlier run knew is due again, since only its last
    completed version counts as processed.

    Result ``path, mtime_ns``. Null paths are ignored; a file whose current time is null is
    due; repeated rows count once; paths found only in the manifest are not due; empty
    inputs are fine; extra columns are ignored.
    """
    claims = _entries(manifest).withColumns(dict(zip(("_clo", "_chi"), _extent())))
    marked = mark_covered(claims, completed_ledger(manifest, runs), ["run_id"], F.col("_clo"), F.col("_chi"))
    last = marked.filter("covered").groupBy("path").agg(F.max(F.struct("run_id", "mtime_ns")).alias("_m")).select("path", F.col("_m.mtime_ns").alias("mtime_ns"))
    state = scratch_table(
        current_versions(files).select("path", "mtime_ns", F.lit(True).alias("now")).unionByName(last.select("path", "mtime_ns", F.lit(False).alias("now"))), "versions"
    )
    numbered = scratch_table(version_axes(state, axis_length), "axes")
    placed = state.join(numbered, (state.path == numbered.path) & state.mtime_ns.eqNullSafe(numbered.mtime_ns)).select("axis", "now", F.col("seq").alias("lo"), (F.col("seq") + 1).alias("hi"))
    placed = scratch_table(placed, "placed")
    gaps = subtract_ranges(placed.filter("now"), placed.filter("NOT now"), ["axis"])
    # An axis is short, so an interval's numbers fit in one row's array.
    due = gaps.select("axis", F.explode(F.expr("sequence(lo, hi - 1)")).alias("seq"))
    return numbered.join(due, ["axis", "seq"], "left_semi").select("path", "mtime_ns")


class VersionTaken(Exception):
    """Another writer has published the version this batch was to become."""


class SequenceLedger:
    """A folder with the committed batches of one incremental job.

    ``data/<batch>`` holds a batch's output and ``ranges/<batch>`` the merged intervals of
    everything processed up to and with that batch; both count only once a numbered file in
    ``commits`` names the batch. Version n + 1 is published by creating file n + 1, which
    fails if it exists: of two writers that started from version n one loses, has changed
    nothing that a reader sees, and starts again from what is pending now. A batch that
    dies before its commit leaves files that no reader looks at.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        at = self._path(f"{self.root}/commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def batches(self, version: int | None = None) -> list[str]:
        """The batches of a version, oldest first: a commit file names all of them, one a line."""
        version = self.version() if version is None else version
        if not version:
            return []
        return [r[0] for r in self.spark.read.text(f"{self.root}/commits/{version:08d}").collect() if r[0]]

    def processed(self, version: int | None = None) -> DataFrame | None:
        """Merged intervals of everything committed; None before the first commit."""
        done = self.batches(version)
        return self.spark.read.parquet(f"{self.root}/ranges/{done[-1]}") if done else None

    def output(self) -> DataFrame | None:
        done = self.batches()
        return self.spark.read.parquet(*[f"{self.root}/data/{b}" for b in done]) if done else None

    def pending(self, records: DataFrame, seq: str, version: int | None = None) -> DataFrame:
        """The records whose sequence number lies in no committed interval.

        Records with a null sequence number or a null key of the axis have no position
        and are never due; the caller has to give them one.
        """
        records = records.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [*self.keys, seq]))
        done = self.processed(version)
        if done is None:
            return records
        marked = mark_covered(records, done, self.keys, F.col(seq), F.col(seq) + 1)
        return marked.filter(~F.col("covered")).drop("covered")

    def write(self, output: DataFrame, records: DataFrame, seq: str, version: int | None = None) -> tuple[int, str]:
        """Write a batch's output and the merged intervals, not yet visible.

        Returns (version the batch started from, name of the batch).
        """
        version = self.version() if version is None else version
        batch = f"{version + 1:08d}-{uuid.uuid4().hex[:8]}"
        output.write.parquet(f"{self.root}/data/{batch}")
        spans = records.select(*self.keys, F.col(seq).alias("lo"), (F.col(seq) + 1).alias("hi"))
        before = self.processed(version)
        if before is not None:
            spans = spans.unionByName(before.select(*self.keys, "lo", "hi"))
        merge_ranges(spans, self.keys).write.parquet(f"{self.root}/ranges/{batch}")
        return version, batch

    def _publish(self, name: str, lines: list[str]) -> bool:
        """Create a commit file whole and only if it is not there yet."""
        staged, target = f"{self.root}/staged-{uuid.uuid4().hex}", f"{self.root}/commits/{name}"
        self._fs.mkdirs(self._path(f"{self.root}/commits"))
        out = self._fs.create(self._path(staged), True)
        out.write(bytearray(("\n".join(lines) + "\n").encode()))
        out.close()
        if self._fs.getUri().getScheme() == "file":  # a local rename would replace the target; a link does not
            source, at = (self._path(x).toUri().getPath() for x in (staged, target))
            try:
                os.link(source, at)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(source)
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(staged), self._path(target), no_options)  # refuses an existing target
            return True
        except Exception:
            self._fs.delete(self._path(staged), False)
            if self._fs.exists(self._path(target)):
                return False
            raise

    def commit(self, written: tuple[int, str]) -> None:
        """Make a written batch visible as the next version, or raise :class:`VersionTaken`.

        Committing a batch that is visible already has no effect.
        """
        version, batch = written
        if batch in self.batches():
            return
        if not self._publish(f"{version + 1:08d}", [*self.batches(version), batch]):
            raise VersionTaken(f"version {version + 1} of {self.root}")

    def run(self, records: DataFrame, seq: str, process, attempts: int = 10) -> str | None:
        """One incremental run: process what is due, then commit; None if nothing is due.

        The due records are pinned in a scratch table first, so that output and intervals
        are made of the same rows even if ``records`` grows meanwhile. A run that loses its
        version to another writer starts again with what that writer has left.
        """
        for _ in range(attempts):
            version = self.version()
            due = scratch_table(self.pending(records, seq, version), "due")
            if due.isEmpty():
                return None
            written = self.write(process(due), due, seq, version)
            try:
                self.commit(written)
                return written[1]
            except VersionTaken:
                continue
        raise VersionTaken(f"{self.root}: lost {attempts} times")
