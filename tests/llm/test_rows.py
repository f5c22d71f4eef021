"""Top N, neighbours, percentiles and outranking against brute force, with dirty input."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.llm.neighbours import assign_leaves, best_bins, fit_tree, nearest_neighbours
from siftlake.llm.outranking import agreed_front, flows_per_list, list_flows, outrank, rank_by_flow
from siftlake.llm.quantiles import RelativeSketch, build_sketches, element_values, exact_quantiles, merge_sketches, sketch_quantiles, tail_heavy_groups
from siftlake.llm.topn import holding_scores, lay_out, row_group_plan, top_n, top_n_per_group

NAN = float("nan")
SCORED = "query_id int, chunk_id string, start_line int, score double, scored_at long, position string, file string"


def _best(rows, n):
    out = {}
    for q in {r[0] for r in rows if r[0] is not None}:
        mine = [r for r in rows if r[0] == q and r[3] is not None and not math.isnan(r[3])]
        out[q] = [r[1] for r in sorted(mine, key=lambda r: (-r[3], r[2] is None, r[2] or 0, r[1]))[:n]]
    return {q: v for q, v in out.items() if v}


def test_top_n_with_a_hot_group(spark):
    rnd = random.Random(1)
    rows = [(0 if rnd.random() < 0.4 else rnd.randrange(60), f"c{i:05}", rnd.choice([None, 1, 2]), rnd.choice([1.0, 0.5, rnd.random(), NAN, None, math.inf]), 0, "p", "f") for i in range(4000)]
    rows += [(None, "x", 1, 1.0, 0, "p", "f"), (99, "only", 1, -5.0, 0, None, None)]
    df = spark.createDataFrame(rows, SCORED)
    got: dict = {}
    for r in top_n_per_group(df, "query_id", "score", 7, ["start_line", "chunk_id"], band_rows=4, group_rows=50).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == _best(rows, 7)
    assert top_n_per_group(df.limit(0), "query_id", "score", 7, ["start_line", "chunk_id"]).count() == 0


def test_row_groups_of_many_groups_are_skipped(spark):
    """A hot group and hundreds of small ones on scales of their own: what is left to read is the first bands."""
    i = F.col("id")
    group = F.when(i % 3 == 0, F.lit(0)).otherwise(1 + i % 400)
    df = spark.range(200_000).select(group.cast("int").alias("g"), ((i * 7919 % 200_003) * F.pow(F.lit(10.0), group % 7)).alias("s"), i.cast("string").alias("c"))
    layout = lay_out(df, "g", "s", ["c"])
    plan = row_group_plan(layout, 10).cache()
    total, skipped = plan.agg(F.count("*"), F.sum(F.col("skip").cast("int"))).first()
    assert total > 30 and skipped > 0.7 * total
    mixed, mixed_skipped = plan.filter("size(members) > 1").agg(F.count("*"), F.sum(F.col("skip").cast("int"))).first()
    assert mixed > 10 and mixed_skipped > 0.5 * mixed  # those of the small groups
    kept = plan.filter("NOT skip").agg(F.sum("rows")).first()[0]
    assert kept < 0.3 * 200_000
    want = {(r["g"], r["c"]) for r in df.withColumn("p", F.expr("row_number() OVER (PARTITION BY g ORDER BY s DESC, c)")).filter("p <= 10").collect()}
    assert {(r["g"], r["c"]) for r in top_n(layout, 10).collect()} == want


def test_the_latest_score_holds(spark):
    rows = [(1, "a", 1, 9.0, 1, "", ""), (1, "a", 2, 3.0, 2, "", ""), (1, "a", 2, 3.0, 2, "", ""), (1, "b", 1, None, 5, "", ""), (1, "b", 1, 8.0, 4, "", ""), (1, "c", 1, 2.0, None, "", ""), (1, None, 1, 2.0, 1, "", ""), (None, "d", 1, 2.0, 1, "", "")]
    held = holding_scores(spark.createDataFrame(rows, SCORED), "query_id", "chunk_id", "scored_at", "score", ["start_line"])
    assert {(r["chunk_id"], r["score"], r["start_line"]) for r in held.collect()} == {("a", 3.0, 2), ("b", None, 1), ("c", 2.0, 1)}


def _brute(rows, k, least):
    keys = sorted({r[0] for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])})
    by = {r[0]: np.array(r[1], dtype=float) for r in rows if r[0] in keys}
    out = {}
    for a in keys:
        sims = [(-round(float(by[a] @ by[b] / np.linalg.norm(by[a]) / np.linalg.norm(by[b])), 6), b) for b in keys if b != a]
        out[a] = [b for s, b in sorted(sims)[:k] if -s >= least]
    return out


def test_neighbours_recall_and_copies(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(25, 16))
    rows = [(f"v{i:04}", (centres[i % 25] + 0.4 * rnd.normal(size=16)).astype("f4").tolist(), "x") for i in range(900)]
    rows += [(f"same{i:03}", rows[0][1], "x") for i in range(450)]  # a third of all rows are copies
    rows += [rows[5], ("zero", [0.0] * 16, None), ("nan", [NAN] + [1.0] * 15, None), ("none", None, None), (None, rows[1][1], None), ("hole", [None] + [1.0] * 15, None), ("double", [2 * x for x in rows[7][1]], None)]
    df = spark.createDataFrame(rows, "key string, cls array<float>, rep string")
    report: dict = {}
    got: dict = {}
    near = nearest_neighbours(df, "key", "cls", k=5, recall=0.97, cell_rows=200, leaf_rows=10, least_leaves=1, report=report)
    for r in near.orderBy("key", "position").collect():
        got.setdefault(r["key"], []).append(r["near"])
    want = _brute(rows, 5, -1)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    found = sum(len(set(got[a]) & set(want[a])) for a in want) / sum(map(len, want.values()))
    assert found >= 0.9 and report["recall"] >= 0.9 and report["read"] < 0.5 and report["all_cells"] > 2
    assert got["same449"] == ["same000", "same001", "same002", "same003", "same004"] and got["same000"][-1] == "same005"
    assert nearest_neighbours(df.limit(0), "key", "cls").count() == 0
    assert nearest_neighbours(df.filter("key = 'zero' OR key = 'v0001'"), "key", "cls").count() == 0


def test_tree_visits_all_leaves_once():
    v = np.random.default_rng(0).normal(size=(500, 8))
    tree = fit_tree(v, branching=4, leaf_rows=30)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert sorted(best_bins(tree, unit[:1], tree.n_leaves)[0].tolist()) == list(range(tree.n_leaves))
    assert best_bins(tree, unit[:1], tree.n_leaves + 2)[0, -2:].tolist() == [-1, -1]
    first = best_bins(tree, unit, 1)[:, 0]
    assert np.mean(first == assign_leaves(tree, unit)) > 0.99
    assert fit_tree(np.ones((300, 4)), leaf_rows=10).n_leaves == 1


def test_sketch_rank_error_and_merge():
    rnd = np.random.default_rng(4)
    values = rnd.lognormal(3, 2, size=400_000)
    whole, parts = RelativeSketch(), [RelativeSketch(seed=i) for i in range(40)]
    for chunk in np.array_split(values, 100):
        whole.update(chunk)
    for sketch, chunk in zip(parts, np.array_split(values, 40)):
        sketch.update(chunk)
    merged = RelativeSketch.from_bytes(parts[0].to_bytes())
    for s in parts[1:]:
        merged.merge(RelativeSketch.from_bytes(s.to_bytes()))
    ordered = np.sort(values)
    for s in (whole, merged):
        assert s.n == len(values) and sum(len(v) << h for h, v in enumerate(s.levels)) <= len(values) + (1 << len(s.levels))
        assert sum(map(len, s.levels)) < 20_000
        for p in (0.5, 0.9, 0.99, 0.999, 0.9999):
            e, lo, hi = (float(x[0]) for x in s.quantiles(np.array([p]), 4.0))
            tail = abs(np.searchsorted(ordered, e) - p * (len(values) - 1)) / ((1 - p) * len(values))
            assert tail < 0.03, (p, tail)
            assert lo <= np.quantile(values, p) <= hi
    assert np.isnan(RelativeSketch().quantiles(np.array([0.5]))[0][0])
    one = RelativeSketch()
    one.update(np.array([7.0]))
    assert one.quantiles(np.array([0.0, 0.5, 1.0]))[0].tolist() == [7.0] * 3


def test_percentiles_by_group(spark):
    rnd = np.random.default_rng(5)
    rows = []
    for i in range(300):
        g = "hot" if i % 3 == 0 else f"g{i % 7}"
        vals = [None, NAN, -1.0] + [float(x) for x in rnd.exponential(10, size=rnd.integers(0, 40))] + ([500.0] * 2 if g == "hot" else [])
        rows.append((g, "r" if i % 2 else None, [None, [], vals][min(i % 10, 2)], i // 50, "extra"))
    df = spark.createDataFrame(rows, "tool string, repo string, lat array<double>, day int, n string")
    values = element_values(df, ["tool", "repo", "day"], "lat")
    truth: dict = {}
    for t, r, v, *_ in rows:
        truth.setdefault((t, r), []).extend(x for x in v or [] if x is not None and not math.isnan(x) and x >= 0)
    truth = {k: np.array(v) for k, v in truth.items() if v}
    sketches = merge_sketches(build_sketches(values, ["tool", "repo", "day"]), ["tool", "repo"])
    bounds = sketch_quantiles(sketches, ["tool", "repo"], [0.5, 0.99])
    exact = {(r["tool"], r["repo"], r["p"]): r["value"] for r in exact_quantiles(values, bounds, ["tool", "repo"]).collect()}
    assert exact == {(*k, p): pytest.approx(np.quantile(v, p)) for k, v in truth.items() for p in (0.5, 0.99)}
    heavy = {(r["tool"], r["repo"]) for r in tail_heavy_groups(values, ["tool", "repo"], 0.99, 0.5, 8.0).collect()}
    assert heavy == {k for k, v in truth.items() if np.quantile(v, 0.99) >= 8 * np.quantile(v, 0.5)}
    assert tail_heavy_groups(values.limit(0), ["tool", "repo"], 0.99, 0.5, 8.0).count() == 0
    narrow = bounds.withColumn("lower", F.lit(1e9)).withColumn("upper", F.lit(-1.0))  # bounds that miss every rank are widened
    assert {(r["tool"], r["repo"], r["p"]): r["value"] for r in exact_quantiles(values, narrow, ["tool", "repo"]).collect()} == {k: pytest.approx(v) for k, v in exact.items()}


RETRIEVED = "query_id int, chunk_id string, retriever string, score double, flow string, x double"


def _flow(scores, t=0.25):
    """Net flow by all pairs."""
    n = len(scores)
    pct = {i: (sum(s < scores[i] for s in scores.values()) + sum(s == scores[i] for s in scores.values()) / 2) / n for i in scores}
    pref = lambda d: min(max(d / t, 0), 1)
    return {i: sum(pref(pct[i] - pct[j]) - pref(pct[j] - pct[i]) for j in scores) / max(n - 1, 1) for i in scores}


def test_flow_equals_all_pairs(spark):
    rnd = random.Random(6)
    rows = [(q, f"c{i}", r, rnd.choice([f(i) for f in (float, lambda i: rnd.random() * 1e9, lambda i: 1.0)]), "f", 1.0) for q in (1, 2) for r in ("a", "b", "c") for i in rnd.sample(range(60), 45)]
    rows += [(1, "c1", "a", None, "f", 1.0), (1, "c2", "a", NAN, "f", 1.0), (1, "c3", "a", math.inf, "f", 1.0), (3, "solo", "a", 5.0, "f", 1.0), (3, "solo", "b", NAN, "f", 1.0), (4, "none", "a", None, "f", 1.0), (None, "x", "a", 1.0, "f", 1.0), rows[0], (5, "p", "a", 2.0, "f", 1.0), (5, "q", "a", 2.0, "f", 1.0)]
    df = spark.createDataFrame(rows, RETRIEVED)
    lists: dict = {}
    for q, c, r, s, *_ in rows:
        if q is not None and s is not None and not math.isnan(s):
            held = lists.setdefault(q, {}).setdefault(r, {})
            held[c] = max(s, held.get(c, -math.inf))
    ranked = outrank(df)
    got = {(r["query_id"], r["chunk_id"]): r for r in ranked.collect()}
    strict = outrank(df, threshold=0.0)
    front = {(r["query_id"], r["chunk_id"]) for r in agreed_front(strict, 10).collect()}
    seen = set()
    for q, per in lists.items():
        flows = {r: _flow(s) for r, s in per.items()}
        for c in {c for s in per.values() for c in s}:
            want = sum(flows[r].get(c, -1.0) for r in per) / len(per)
            assert got[q, c]["net_flow"] == pytest.approx(want, abs=1e-9)
            seen.add((q, c))
            inside = all(c in s and sum(x > s[c] for x in s.values()) < 10 for s in per.values())
            assert ((q, c) in front) == inside
    assert set(got) == seen
    places = rank_by_flow(ranked).filter("query_id = 1").orderBy("position").collect()
    assert [r["position"] for r in places] == list(range(1, len(places) + 1))
    assert all(a["net_flow"] >= b["net_flow"] - 1e-9 for a, b in zip(places, places[1:]))
    assert outrank(df.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0.0, 0.25])
def test_split_lists_have_the_flows_of_whole_ones(spark, threshold):
    """A list that spans all partitions (prefix sums) against one that fits in one task (arrays)."""
    rnd = random.Random(61)
    rows = [(q, f"c{i}", "a", float(rnd.randrange(40)), "f", 1.0) for q, n in ((1, 300), *((q, 3) for q in range(2, 40))) for i in range(n)]
    got = {(r["query_id"], r["chunk_id"]): (r["plus"], r["minus"]) for r in flows_per_list(spark.createDataFrame(rows, RETRIEVED), threshold=threshold).collect()}
    assert len(got) == len(rows)
    for q in (1, 2, 20, 39):
        mine = sorted((s, c) for q2, c, _, s, *_ in rows if q2 == q)
        plus, minus = list_flows(np.array([s for s, _ in mine]), threshold)
        for (_, c), a, b in zip(mine, plus, minus):
            assert got[q, c] == pytest.approx((a, b))


def test_scale_does_not_matter(spark):
    rows = [(1, f"c{i}", r, f(i), "", 0.0) for i in range(20) for r, f in (("a", lambda i: float(i)), ("b", lambda i: math.exp(i) * 1e6))]
    df = spark.createDataFrame(rows, RETRIEVED)
    a = {r["chunk_id"]: round(r["net_flow"], 9) for r in outrank(df).collect()}
    b = {r["chunk_id"]: round(r["net_flow"], 9) for r in outrank(df.withColumn("score", F.when(F.col("retriever") == "b", F.log("score")).otherwise(F.col("score")))).collect()}
    assert a == b
