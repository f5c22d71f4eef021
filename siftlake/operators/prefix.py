"""Exact running sums over ordered groups of any size.

A plain window puts a whole group into one task. Here rows are range-partitioned
by (group, order), the totals of every (group, partition) are carried over to the
later partitions of the same group, and only the rest is a window. A group that
holds a third of all rows is spread over a third of the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.session import scratch_table


def prefix_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` plus one column per entry of ``sums``: the sum over all rows of the same
    ``keys`` up to and including this row in ``order``.

    ``order`` must be total within a group wherever the result shall not depend on
    chance; rows that tie are put next to each other and summed in any order. Null
    values count as 0. Null keys form a group of their own. Empty input gives no rows.
    """
    names = list(sums)
    staged = df.select("*", *[F.coalesce(c, F.lit(0)).alias(f"_v_{n}") for n, c in sums.items()])
    ranged = staged.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    # Partition numbers are written down: a recomputed task cannot change them any more.
    ranged = scratch_table(ranged, "prefix")
    totals = ranged.groupBy(*keys, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_part").alias("_kp"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in names],
    )
    # Only a group's later partitions carry anything: at most one row per written partition.
    moved = carry.filter(" OR ".join(f"`_c_{n}` <> 0" for n in names))
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(f"_v_{n}").over(within).alias(f"_r_{n}") for n in names])
    on = F.col("_part") == F.col("_kp")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(moved, on, "left")
    return joined.select(
        *df.columns,
        *[(F.col(f"_r_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in names],
    )
