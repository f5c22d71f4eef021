"""The most similar vectors of every vector: a hierarchical k-means tree.

The upper part of the tree is fitted on a bounded sample and shipped to the executors; its
ends are cells of some ten thousand rows. Each cell then gets its own lower part, fitted by
the task that holds the cell, down to leaves of a few rows: the number of leaves grows with
the collection, and no one holds them all. A query walks the upper part best bin first, by a
priority queue of nodes ordered by similarity to their centroid, and is sent to the cells it
reaches; within a cell it visits the best leaves. How many cells and leaves is calibrated: a
sample of queries is answered exactly against all rows, and visits are widened at the least
cost until the recall asked for is reached. Other queries, also answered exactly, measure it.

Equal vectors are one class, searched once; a class with a third of all rows costs one
row in the index. Cells are worked through in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.common import one_record
from siftlake.session import scratch_table

#: Rows the upper part may be fitted on; with 64 dimensions this is 13 MB on the driver.
SAMPLE_ROWS = 50_000
#: Exactly answered queries: half of them set the visits, the others measure the recall.
CALIBRATION_QUERIES = 1_600
#: Rows of a cell, about, and of a leaf, at most. A sample of SAMPLE_ROWS has a few thousand
#: cells at most: with more than some ten million rows cells grow and are cut into blocks.
CELL_ROWS = 16_000
LEAF_ROWS = 16
#: Leaves of a block that a query visits at least: a thousand rows cost next to nothing.
LEAST_LEAVES = 64
#: Rows of a cell, and queries of a cell, that one task takes at a time.
BLOCK_ROWS = 50_000
#: Queries that a task compares with its block at a time.
SEARCH_QUERIES = 8_192
#: Distances are counted in millionths; query, distance and row of a block then fit in one number, which sorts them.
_MICRO, _NEVER = 1_000_000, (1 << 22) - 1


@dataclass
class Tree:
    """Nodes in order of creation; ``children`` is empty for leaves, ``leaf`` is -1 for inner nodes."""

    centroids: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def n_leaves(self) -> int:
        return sum(x >= 0 for x in self.leaf)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)


def _kmeans(v: np.ndarray, k: int, rnd: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; clusters that run empty are dropped."""
    c = v[rnd.choice(len(v), size=k, replace=False)]
    for _ in range(rounds):
        near = np.argmax(v @ c.T, axis=1)
        member = (near[None, :] == np.arange(len(c))[:, None]).astype(v.dtype)
        c = _unit((member @ v)[member.any(axis=1)])
    return c


def fit_tree(sample: np.ndarray, branching: int = 16, leaf_rows: int = 60, max_depth: int = 8, seed: int = 7) -> Tree:
    """Split the sample recursively until a node holds at most ``leaf_rows`` of it."""
    v = _unit(np.asarray(sample, dtype=np.float32))  # enough for choosing centroids, at half the memory
    rnd = np.random.default_rng(seed)
    dim = v.shape[1] if v.ndim == 2 and len(v) else 1
    centroids, children, leaf = [np.zeros(dim)], [[]], [-1]
    todo, leaves = [(0, v, 0)], 0
    while todo:
        node, rows, depth = todo.pop()
        split = None
        if len(rows) > leaf_rows and depth < max_depth:
            c = _kmeans(rows, min(branching, max(2, math.ceil(len(rows) / leaf_rows))), rnd)
            near = np.argmax(rows @ c.T, axis=1)
            split = [(c[i], rows[near == i]) for i in range(len(c)) if (near == i).any()]
        if split and len(split) > 1:
            for centre, part in split:
                children[node].append(len(centroids))
                centroids.append(centre)
                children.append([])
                leaf.append(-1)
                todo.append((len(centroids) - 1, part, depth + 1))
        else:
            leaf[node], leaves = leaves, leaves + 1
    return Tree(np.array(centroids), children, leaf)


def assign_leaves(tree: Tree, v: np.ndarray) -> np.ndarray:
    """The leaf of each vector: the nearest child at every node on the way down."""
    out, todo = np.zeros(len(v), dtype=np.int64), [(0, np.arange(len(v)))]
    while todo:
        node, rows = todo.pop()
        if tree.leaf[node] >= 0:
            out[rows] = tree.leaf[node]
            continue
        kids = np.array(tree.children[node])
        near = kids[np.argmax(v[rows] @ tree.centroids[kids].T, axis=1)]
        todo += [(k, rows[near == k]) for k in kids if (near == k).any()]
    return out


def best_bins(tree: Tree, v: np.ndarray, visits: int) -> np.ndarray:
    """For each vector its first ``visits`` leaves, best bin first; -1 where there are no more.

    The priority queues of a batch of vectors are rows of one array: in each round every
    vector takes its best node and either notes a leaf or queues the node's children.
    """
    width = max((len(c) for c in tree.children), default=0)
    kids = np.full((len(tree.children), max(width, 1)), -1)
    for i, c in enumerate(tree.children):
        kids[i, : len(c)] = c
    leaf, centroids = np.array(tree.leaf), tree.centroids.astype(np.float32)
    out = np.full((len(v), visits), -1, dtype=np.int64)
    for at in range(0, len(v), 4096):
        some = v[at : at + 4096].astype(np.float32)
        rows = np.arange(len(some))
        nodes, sims, found = np.zeros((len(some), 1), dtype=np.int64), np.ones((len(some), 1), dtype=np.float32), np.zeros(len(some), dtype=np.int64)
        while len(rows):
            best = np.argmax(sims[rows], axis=1)
            top = sims[rows, best]
            rows, best = rows[top > -2], best[top > -2]  # the others have seen all leaves
            node = nodes[rows, best]
            sims[rows, best] = -3
            ends = leaf[node] >= 0
            out[at + rows[ends], found[rows[ends]]] = leaf[node[ends]]
            found[rows[ends]] += 1
            if (~ends).any():
                more = kids[node[~ends]]
                near = np.einsum("bd,bkd->bk", some[rows[~ends]], centroids[more])
                new_nodes, new_sims = np.zeros((len(some), more.shape[1]), dtype=np.int64), np.full((len(some), more.shape[1]), -3, dtype=np.float32)
                new_nodes[rows[~ends]], new_sims[rows[~ends]] = more, np.where(more >= 0, near, -3)
                nodes, sims = np.hstack([nodes, new_nodes]), np.hstack([sims, new_sims])
            rows = rows[found[rows] < visits]
    return out


def usable_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """One row per key whose vector is not null, empty, all zero, and has no null, NaN or infinite element."""
    ok = (
        f"`{vector}` IS NOT NULL AND size(`{vector}`) > 0 AND exists(`{vector}`, x -> x <> 0)"
        f" AND forall(`{vector}`, x -> coalesce(NOT isnan(x) AND abs(x) < double('infinity'), false))"
    )
    return one_record(df, key, [vector]).filter(ok)


def _classes(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Columns ``cls`` (128 bits of the vector's bytes), key, vector."""
    cls = F.concat(F.hex(F.xxhash64(F.col(vector))), F.hex(F.xxhash64(F.lit(77), F.reverse(F.col(vector)))))
    return df.select(cls.alias("cls"), F.col(key).alias("key"), F.col(vector).alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of a column of equally long lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1), dtype=np.float32)
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def _leaf_centres(v: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """The unit mean of each leaf; leaves are numbered from 0 without gaps."""
    order = np.argsort(leaf, kind="stable")
    first = np.searchsorted(leaf[order], np.arange(int(leaf.max()) + 1))
    return _unit(np.add.reduceat(v[order], first, axis=0)).astype(np.float32)


def _assign(tree_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = assign_leaves(tree_b.value, _matrix(b.column("v"))) if b.num_rows else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=[*b.schema.names, "cell"])

    return run


def _grow(leaf_rows: int):
    """The lower part of the tree for one block of a cell: its rows with the number of their leaf."""

    def run(t: pa.Table) -> pa.Table:
        v = _matrix(t.column("v"))
        order = np.argsort(t.column("rid").to_numpy(), kind="stable")  # the same leaves if the task is repeated
        leaf = np.empty(len(v), dtype=np.int32)
        leaf[order] = assign_leaves(fit_tree(v[order], 16, leaf_rows), v[order])
        _, leaf = np.unique(leaf, return_inverse=True)
        return t.append_column("leaf", pa.array(leaf.astype(np.int32)))

    return run


def _exact(queries: np.ndarray, names: np.ndarray, k: int):
    """For one block of a cell the k best rows of each calibration query, with the place their
    leaf takes among the block's leaves: brute force, for calibration only."""

    def run(t: pa.Table) -> pa.Table:
        v, leaf, rid = _matrix(t.column("v")), t.column("leaf").to_numpy(), t.column("rid").to_numpy()
        centres = _leaf_centres(v, leaf)
        out = []
        for at in range(0, len(queries), 200):
            q = queries[at : at + 200]
            sims = np.round(q @ v.T, 6)
            sims[names[at : at + 200, None] == rid[None, :]] = -2
            best = np.argpartition(-sims, k - 1, axis=1)[:, :k] if len(v) > k else np.arange(len(v))[None, :].repeat(len(q), 0)
            to_leaf = q.astype(np.float32) @ centres.T
            own = np.take_along_axis(to_leaf, leaf[best], axis=1)
            place = (to_leaf[:, None, :] > own[:, :, None]).sum(axis=2)
            near = np.take_along_axis(sims, best, axis=1)
            i, j = np.nonzero(near > -2)
            out.append((at + i, rid[best[i, j]], near[i, j], place[i, j]))
        q, near, cos, place = (np.concatenate(x) for x in zip(*out))
        cell = np.full(len(q), t.column("cell")[0].as_py(), dtype=np.int32)
        return pa.table({"q": pa.array(q.astype(np.int32)), "cell": cell, "near": near, "cos": cos, "place": pa.array(place.astype(np.int32)), "leaves": pa.array(np.full(len(q), len(centres), dtype=np.int32))})

    return run


@dataclass
class Visits:
    """Cells per query and leaves per block of a cell; the recall that other queries measured."""

    cells: int
    leaves: int
    all_cells: int
    all_leaves: int
    recall: float


def calibrate(index: DataFrame, tree: Tree, k: int, min_cosine: float, recall: float, queries: int = CALIBRATION_QUERIES, least_leaves: int = LEAST_LEAVES) -> Visits:
    """The cheapest visits that reach ``recall``, and the recall that held-out queries get.

    True neighbours are the k best of a query with at least ``min_cosine``, found by brute
    force over all rows; if no query has one, the k best whatever their cosine. Queries are
    chosen by another hash than the tree's sample.
    """
    n = index.count()
    share = min(1.0, 1.2 * queries / max(n, 1))
    place = F.xxhash64(F.lit(9), "rid")
    asked = index.filter(F.pmod(place, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(place).limit(queries).select("rid", "v").toArrow()
    q, names = _matrix(asked.column("v")), asked.column("rid").to_numpy()
    found = index.groupBy("cell", "block").applyInArrow(_exact(q, names, k), "q int, cell int, near bigint, cos double, place int, leaves int")
    order = Window.partitionBy("q").orderBy(F.desc("cos"), "near")
    true = found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).toPandas()
    if (true["cos"] >= min_cosine).any():
        true = true[true["cos"] >= min_cosine]
    all_leaves, cells = int(index.select("cell", "block", "leaf").distinct().count()), tree.n_leaves
    if true.empty:
        return Visits(1, least_leaves, cells, all_leaves, 1.0)
    bins = best_bins(tree, q, cells)
    at = np.empty((len(q), cells), dtype=np.int64)
    np.put_along_axis(at, bins, np.arange(cells)[None, :].repeat(len(q), 0), axis=1)
    cell_place, leaf_place = at[true["q"].to_numpy(), true["cell"].to_numpy()], true["place"].to_numpy()
    fit = true["q"].to_numpy() % 2 == 0
    if fit.all() or not fit.any():
        fit = np.ones(len(true), dtype=bool)
    best = None
    for m in range(1, cells + 1):
        need = np.sort(np.where(cell_place[fit] < m, leaf_place[fit], 1 << 30))
        f = need[max(0, math.ceil(recall * len(need)) - 1)]
        if f < 1 << 30:
            # In rows: the leaves' centroids and the visited leaves are compared, and the query is sent once a cell.
            cost = m * (all_leaves / cells / 2 + (f + 1) * n / all_leaves + 500)
            if best is None or cost < best[0]:
                best = (cost, m, int(f) + 1)
    _, m, f = best
    f = max(f, least_leaves)
    held = ~fit if (~fit).any() else fit
    return Visits(m, f, cells, all_leaves, float(((cell_place[held] < m) & (leaf_place[held] < f)).mean()))


def _to_cells(tree_b, visits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bins = best_bins(tree_b.value, _matrix(b.column("v")), visits)
                row, _ = np.nonzero(bins >= 0)
                yield pa.RecordBatch.from_arrays([b.column("rid").take(pa.array(row)), b.column("v").take(pa.array(row)), pa.array(bins[bins >= 0].astype(np.int32))], names=["rid", "v", "cell"])

    return run


def _search(k: int, min_cosine: float, visits: int):
    """The k best rows of a block for each query sent to it, in the block's ``visits`` best leaves.

    A block has less than 2**18 rows: blocks of BLOCK_ROWS are drawn by a hash.
    """

    def run(t: pa.Table) -> pa.Table:
        asks = t.column("leaf").is_null().to_numpy()
        rows, asked = t.filter(pa.array(~asks)), t.filter(pa.array(asks))
        out: list[tuple] = []
        if rows.num_rows and asked.num_rows:
            rows = rows.take(pa.array(np.lexsort((rows.column("rid").to_numpy(), rows.column("leaf").to_numpy()))))
            v, leaf, rid = _matrix(rows.column("v")), rows.column("leaf").to_numpy(), rows.column("rid").to_numpy()
            centres = _leaf_centres(v, leaf)
            bounds = np.searchsorted(leaf, np.arange(len(centres) + 1))
            f = min(visits, len(centres))
            by_rank = np.sort(rid)
            rank, most = np.searchsorted(by_rank, rid), round((1 - min_cosine) * _MICRO)
            q_all, asker = _matrix(asked.column("v")), asked.column("rid").to_numpy()
            for at in range(0, len(q_all), SEARCH_QUERIES):
                q, name = q_all[at : at + SEARCH_QUERIES], asker[at : at + SEARCH_QUERIES]
                near = q.astype(np.float32) @ centres.T
                picked = np.argpartition(-near, f - 1, axis=1)[:, :f] if f < len(centres) else np.arange(f)[None, :].repeat(len(q), 0)
                del near
                who, which = np.repeat(np.arange(len(q), dtype=np.int32), f), picked.ravel().astype(np.int32)
                order = np.argsort(which, kind="stable")
                who, ends = who[order], np.searchsorted(which[order], np.arange(len(centres) + 1))
                parts = []
                for leaf_no in np.flatnonzero(np.diff(ends)):
                    mine = who[ends[leaf_no] : ends[leaf_no + 1]]
                    a, b = bounds[leaf_no], bounds[leaf_no + 1]
                    far = _MICRO - np.rint((q[mine] @ v[a:b].T) * _MICRO).astype(np.int64)
                    far[name[mine][:, None] == rid[None, a:b]] = _NEVER
                    nearest = np.partition(far, k - 1, axis=1)[:, k - 1] if b - a > k else np.full(len(mine), _NEVER)
                    i, j = np.nonzero((far <= np.minimum(nearest, most)[:, None]) & (far < _NEVER))
                    parts.append((mine[i].astype(np.int64) << 40) | (far[i, j] << 18) | rank[a + j])
                found = np.sort(np.concatenate(parts))  # by query, distance, then key
                i = found >> 40
                found = found[np.arange(len(i)) - np.searchsorted(i, i) < k]
                out.append((name[found >> 40], by_rank[found & 0x3FFFF], (_MICRO - ((found >> 18) & 0x3FFFFF)) / _MICRO))
        rid, near, cos = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        return pa.table({"rid": pa.array(rid, pa.int64()), "near": pa.array(near, pa.int64()), "cos": pa.array(cos, pa.float64())})

    return run


def nearest_neighbours(
    df: DataFrame,
    key: str,
    vector: str,
    k: int = 5,
    min_cosine: float = -1.0,
    recall: float = 0.98,
    cell_rows: int = CELL_ROWS,
    leaf_rows: int = LEAF_ROWS,
    sample_rows: int = SAMPLE_ROWS,
    least_leaves: int = LEAST_LEAVES,
    report: dict | None = None,
) -> DataFrame:
    """The ``k`` most similar other rows of every row: ``key, near, cos, position``.

    Order: cosine rounded to 6 decimals, then the lower key. Only neighbours with at least
    ``min_cosine`` are given. Null keys and vectors that are null, empty, all zero or not
    finite take no part; vectors must have one length; repeated rows are one; rows with
    equal vectors are each other's neighbours with cosine 1 and are ranked exactly; no
    rows in, no rows out; other columns are ignored. ``report`` receives the cells and
    leaves visited, how many there are, and the recall measured on held-out queries.
    """
    spark = df.sparkSession
    members = scratch_table(_classes(usable_vectors(df, key, vector), key, vector), "members")
    reps = members.groupBy("cls").agg(F.min("key").alias("rep"), F.first("v").alias("v"))
    # Numbers in the order of the keys: they break ties as the keys do, at 8 bytes each.
    reps = scratch_table(reps.orderBy("rep").withColumn("rid", F.monotonically_increasing_id()), "classes")
    n = reps.count()
    if not n:
        return spark.createDataFrame([], f"{key} string, near string, cos double, position int")
    share = min(1.0, sample_rows / n)
    sample = reps.filter(F.pmod(F.xxhash64(F.lit(3), "rid"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("v").toArrow()
    flat = _matrix(sample.column("v")).astype(np.float32)
    tree = fit_tree(flat, 16, max(50, int(len(flat) * cell_rows / n)))
    del sample, flat
    tree_b = spark.sparkContext.broadcast(tree)  # a few thousand centroids at most
    cells = reps.select("rid", "v").mapInArrow(_assign(tree_b), "rid bigint, v array<float>, cell int")
    counts = {r["cell"]: r["count"] for r in cells.groupBy("cell").count().collect()}  # a row per cell of the broadcast tree
    blocks = spark.createDataFrame([(c, math.ceil(x / BLOCK_ROWS)) for c, x in counts.items()], "cell int, nb int")
    spread = lambda c: F.pmod(F.xxhash64("rid"), F.col(c)).cast("int")
    placed = cells.join(F.broadcast(blocks), "cell").select("rid", "v", "cell", spread("nb").alias("block"))
    grown = placed.groupBy("cell", "block").applyInArrow(_grow(leaf_rows), "rid bigint, v array<float>, cell int, block int, leaf int")
    index = scratch_table(grown, "index")
    visits = calibrate(index, tree, k, min_cosine, recall, least_leaves=least_leaves)
    if report is not None:
        report.update(cells=visits.cells, leaves=visits.leaves, all_cells=visits.all_cells, all_leaves=visits.all_leaves, recall=visits.recall, read=visits.cells * min(visits.leaves / visits.all_leaves, 1 / visits.all_cells))

    asks = index.select("rid", "v").mapInArrow(_to_cells(tree_b, visits.cells), "rid bigint, v array<float>, cell int")
    # A cell gets about as many times its rows in queries as cells are visited: so many tasks share them.
    plan = F.broadcast(blocks.withColumn("nq", F.lit(max(1, min(visits.cells, math.ceil(visits.cells * max(counts.values()) / BLOCK_ROWS))))))
    rows = index.join(plan, "cell").select("cell", "block", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("part"), "rid", "v", "leaf")
    sent = asks.join(plan, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"), F.pmod(F.xxhash64(F.lit(1), "rid"), F.col("nq")).cast("int").alias("part"), "rid", "v", F.lit(None).cast("int").alias("leaf"))
    near = rows.unionByName(sent).groupBy("cell", "block", "part").applyInArrow(_search(k, min_cosine, visits.leaves), "rid bigint, near bigint, cos double")
    by = Window.partitionBy("rid").orderBy(F.desc("cos"), "near")
    best = near.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= k).drop("_r")

    # Back from classes to rows. The first k + 1 members of a class are all that can be
    # anyone's neighbours: a member outside them is preceded by k equal vectors.
    in_class = Window.partitionBy("cls").orderBy("key")
    firsts = members.select("cls", "key").withColumn("_o", F.row_number().over(in_class)).filter(F.col("_o") <= k + 1)
    first_of = firsts.groupBy("cls").agg(F.array_sort(F.collect_list("key")).alias("firsts"))
    named = reps.select("cls", "rid").join(first_of, "cls")
    other = named.select(F.col("rid").alias("near"), F.slice("firsts", 1, k).alias("_keys"))
    listed = best.join(other, "near").groupBy("rid").agg(F.collect_list(F.struct((-F.col("cos")).alias("d"), F.col("_keys").alias("keys"))).alias("_l"))
    listed = named.join(listed, "rid", "left").select(
        "cls",
        F.expr("transform(firsts, x -> named_struct('d', -1D, 'key', x))").alias("_own"),
        F.expr("flatten(transform(coalesce(_l, array()), e -> transform(e.keys, x -> named_struct('d', e.d, 'key', x))))").alias("_other"),
    )
    listed = listed.select("cls", F.array_sort(F.concat("_own", "_other")).alias("_all"))
    ranked = members.select("cls", "key").join(listed, "cls").select(
        "key", F.expr(f"posexplode(slice(filter(_all, e -> e.key <> `key` AND -e.d >= {min_cosine}D), 1, {k}))").alias("_p", "_e")
    )
    return ranked.select(F.col("key").alias(key), F.col("_e.key").alias("near"), (-F.col("_e.d")).alias("cos"), (F.col("_p") + 1).alias("position"))
