"""The ledger of disjoint intervals."""

import random

import pytest
from pyspark.sql import functions as F

from siftlake.operators.increment import SequenceLedger, VersionTaken, files_to_process, mark_covered, merge_ranges, subtract_ranges

RANGES = "k string, lo long, hi long, extra string"


def _covered(rows):
    return {(k, i) for k, lo, hi, *_ in rows if lo is not None and hi is not None for i in range(lo, hi)}


@pytest.mark.parametrize("stretch", [3, 1 << 24])
def test_merge_and_subtract_equal_sets_of_positions(spark, stretch):
    rnd = random.Random(7)
    rows = lambda n: [(rnd.choice("ab"), lo := rnd.randrange(40), lo + rnd.randrange(-1, 6), "x") for _ in range(n)]
    have, done = [*rows(30), ("a", None, 4, "x"), (None, 1, 3, None)], rows(12)
    a, p = spark.createDataFrame(have, RANGES), spark.createDataFrame(done, RANGES)
    merged = [tuple(r) for r in merge_ranges(a, ["k"], stretch=stretch).collect()]
    assert _covered(merged) == _covered(have)
    assert sum(hi - lo for _, lo, hi in merged) == len(_covered(have))
    assert all(x == y or h < l2 or h2 < l for x, l, h in merged for y, l2, h2 in merged if x == y and (l, h) != (l2, h2))
    gaps = [tuple(r) for r in subtract_ranges(a, p, ["k"], stretch=stretch).collect()]
    assert _covered(gaps) == _covered(have) - _covered(done)


def test_empty_ranges(spark):
    none = spark.createDataFrame([], RANGES)
    some = spark.createDataFrame([("a", 0, 2, None)], RANGES)
    assert merge_ranges(none, ["k"]).count() == 0
    assert subtract_ranges(none, some, ["k"]).count() == 0
    assert [tuple(r) for r in subtract_ranges(some, none, ["k"]).collect()] == [("a", 0, 2)]
    assert mark_covered(some, none.select("k", "lo", "hi"), ["k"], F.col("lo"), F.col("hi")).first()["covered"] is False


def _due(spark, files, manifest, runs):
    f = spark.createDataFrame(files, "path string, mtime_ns long, seen_at timestamp_ntz, covered string")
    m = spark.createDataFrame(manifest, "run_id int, path string, mtime_ns long, start int, count int, _lo string")
    r = spark.createDataFrame(runs, "run_id int, status string")
    return {x["path"] for x in files_to_process(f, m, r).collect()}


def test_due_files(spark):
    from datetime import datetime as d

    t1, t2 = d(2026, 1, 1), d(2026, 1, 2)
    files = [
        ("same", 5, t1, None), ("same", 5, t1, None), ("changed", 6, t1, None), ("changed", 5, t2, "x"), ("changed", 9, t2, "x"),
        ("back", 3, t1, None), ("new", 1, t1, None), ("killed", 7, t1, None), ("half", 2, t1, None), ("nulltime", None, t1, None),
        (None, 1, t1, None), ("empty", 4, t1, None), ("again", 5, t1, None),
    ]
    manifest = [
        (1, "same", 5, 0, 3, None), (1, "same", 5, 0, 3, None), (1, "changed", 5, 3, 2, None), (1, "back", 3, 5, 1, None), (3, "back", 8, 0, 1, None),
        (2, "killed", 7, 0, 2, None), (1, "half", 2, None, 2, None), (3, "half", None, 1, 2, None), (1, "nulltime", 3, 6, 1, None), (3, "gone", 1, 3, 1, None),
        (1, "empty", 4, 7, 0, None), (1, "again", 5, 8, 2, None), (2, "again", 6, 2, 2, None), (None, "same", 9, 0, 1, None),
    ]
    runs = [(1, "ok"), (2, "killed"), (3, "ok"), (3, "ok")]
    assert _due(spark, files, manifest, runs) == {"changed", "back", "new", "killed", "half", "nulltime"}
    assert _due(spark, [], manifest, runs) == set()
    assert _due(spark, files[:2], [], []) == {"same"}


def test_the_subtraction_decides_which_files_are_due(spark, monkeypatch):
    """Without the intervals of processed versions every file would be due."""
    from siftlake.operators import increment

    files = spark.createDataFrame([(f"p{i}", i, None) for i in range(50)], "path string, mtime_ns long, seen_at timestamp_ntz")
    manifest = spark.createDataFrame([(1, f"p{i}", i if i % 5 else -1, 2 * i, 2) for i in range(50)], "run_id int, path string, mtime_ns long, start int, count int")
    runs = spark.createDataFrame([(1, "ok")], "run_id int, status string")
    want = {f"p{i}" for i in range(0, 50, 5)}
    for length in (4, 1 << 16):
        assert {r["path"] for r in files_to_process(files, manifest, runs, length).collect()} == want
    monkeypatch.setattr(increment, "subtract_ranges", lambda available, processed, keys: increment.merge_ranges(available, keys))
    assert files_to_process(files, manifest, runs).count() == 50


def test_ledger_survives_a_failed_batch(spark, tmp_path):
    ledger = SequenceLedger(spark, f"file://{tmp_path}/job", ["part"])
    log = lambda n, skip=(): spark.createDataFrame([(p, i, f"{p}{i}") for p in "xy" for i in range(n) if (p, i) not in skip], "part string, seq long, body string")
    late = {("x", 2)}
    assert ledger.run(log(5, late), "seq", lambda df: df) is not None

    def broken(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ledger.run(log(8), "seq", broken)
    ledger.write(log(8), log(8), "seq")  # written, but the driver dies before the commit
    assert {(r["part"], r["seq"]) for r in ledger.pending(log(8), "seq").collect()} == late | {(p, i) for p in "xy" for i in (5, 6, 7)}
    batch = ledger.run(log(8), "seq", lambda df: df)
    ledger.commit((1, batch))  # repeated commits are harmless
    assert ledger.run(log(8), "seq", lambda df: df) is None
    out = [(r["part"], r["seq"]) for r in ledger.output().collect()]
    assert len(out) == len(set(out)) == 16
    assert [tuple(r) for r in ledger.processed().orderBy("part").collect()] == [("x", 0, 8), ("y", 0, 8)]


def test_two_writers_do_not_repeat_records(spark, tmp_path):
    log = spark.createDataFrame([("x", i) for i in range(20)], "part string, seq long")
    one, two = (SequenceLedger(spark, f"file://{tmp_path}/job", ["part"]) for _ in range(2))
    one.run(log.filter("seq < 5"), "seq", lambda df: df)
    late = two.write(two.pending(log, "seq"), two.pending(log, "seq"), "seq")  # reads version 1 ...
    one.run(log.filter("seq < 12"), "seq", lambda df: df)  # ... which the other one builds on first
    with pytest.raises(VersionTaken):
        two.commit(late)
    calls = []

    def overtaken(df):
        if not calls:
            one.run(log.filter("seq < 15"), "seq", lambda d: d)
        calls.append(df.count())
        return df

    two.run(log, "seq", overtaken)
    assert calls == [8, 5]
    assert sorted(r["seq"] for r in one.output().collect()) == list(range(20))
    assert [tuple(r) for r in two.processed().collect()] == [("x", 0, 20)]
    assert two.version() == 4 and two.run(log, "seq", overtaken) is None
