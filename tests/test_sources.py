"""Walking, ignore rules, reading, chunking and the usage log."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from siftlake.operators import chunking as C
from siftlake.operators import usage as U
from siftlake.sources.files import cache_key, file_status, list_tree, read_files, skipped_large, walk
from siftlake.sources.languages import extensions, language_rows, suffix, with_language
from siftlake.sources.tasks import read_tasks, results_json
from siftlake.streaming.usage import daily_usage, stream_log


def _tree(root, files):
    for path, text in files.items():
        at = os.path.join(root, path)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


@pytest.mark.parametrize(
    "gitignore,own,expected",
    [
        ("", "", {"a.py", "b.py", "sub/c.py", "sub/deep/d.py", "vendor/e.py"}),
        ("*.py\n!a.py", "", {"a.py"}),
        ("vendor/", "", {"a.py", "b.py", "sub/c.py", "sub/deep/d.py"}),
        ("/b.py\nsub/deep", "", {"a.py", "sub/c.py", "vendor/e.py"}),
        ("**/d.py", "", {"a.py", "b.py", "sub/c.py", "vendor/e.py"}),
        ("sub/\n!sub/c.py", "", {"a.py", "b.py", "vendor/e.py"}),
        ("# comment\n\n?.py", "", set()),
        ("*.py", "!b.py", {"b.py"}),
        ("!*.proto", "", {"a.py", "b.py", "sub/c.py", "sub/deep/d.py", "vendor/e.py", "x.proto"}),
        ("[ab].py", "", {"sub/c.py", "sub/deep/d.py", "vendor/e.py"}),
    ],
)
def test_walk(tmp_path, gitignore, own, expected):
    _tree(tmp_path, {p: "x = 1" for p in ("a.py", "b.py", "sub/c.py", "sub/deep/d.py", "vendor/e.py", "x.proto", "node_modules/f.py", "build/g.py", "notes.txt")})
    _tree(tmp_path, {".gitignore": gitignore, ".siftignore": own})
    assert {p for p, *_ in walk(str(tmp_path), [".py"])} == expected
    os.symlink(tmp_path / "a.py", tmp_path / "link.py")
    assert {p for p, *_ in walk(str(tmp_path), [".py"])} == expected


def test_list_and_read(spark, tmp_path):
    _tree(tmp_path, {"ok.py": "print(1)\n", "bad.py": b"x = '\xff'", "blank.py": "  \n", "README.md": "# hi", "big.py": "x" * 1_000_001})
    listing = list_tree(spark, str(tmp_path))
    assert {r["path"]: r["language"] for r in listing.collect()} == {p: "python" for p in ("ok.py", "bad.py", "blank.py", "big.py")}
    got = {r["path"]: (r["status"], r["text"]) for r in read_files(listing, str(tmp_path)).collect()}
    assert got["ok.py"] == ("valid", "print(1)\n") and got["blank.py"][0] == "empty" and got["big.py"] == ("too_large", None)
    assert got["bad.py"][1] == "x = '\ufffd'"
    assert skipped_large(listing) == "skipped 1 large files: big.py"
    os.remove(tmp_path / "ok.py")
    assert {r["path"]: r["status"] for r in read_files(listing, str(tmp_path)).collect()}["ok.py"] == "unreadable"
    for wrong, error in ((tmp_path / "none", FileNotFoundError), (tmp_path / "bad.py", NotADirectoryError)):
        with pytest.raises(error):
            list_tree(spark, str(wrong))


def test_languages(spark):
    rows = language_rows({".foo": "foolang"})
    assert len({s for s, *_ in rows}) == len(rows) and (".foo", "foolang", "code") in rows
    assert ".md" in extensions(["docs"]) and ".json" not in extensions(["code", "docs", "config"])
    with pytest.raises(ValueError):
        extensions(["nonsense"])
    df = spark.createDataFrame([("a/B.PY",), (".gitignore",), ("Makefile",), ("x.tar.gz",)], "path string")
    assert {r["path"]: r["s"] for r in df.select("path", suffix(F.col("path")).alias("s")).collect()} == {"a/B.PY": ".py", ".gitignore": "", "Makefile": "", "x.tar.gz": ".gz"}
    assert with_language(df).filter("language = 'python'").count() == 1
    states = spark.createDataFrame([(10, " "), (200, " "), (2_000_000, "x"), (0, None)], "n bigint, t string").select(file_status(F.col("n"), F.col("t")).alias("s"))
    assert [r["s"] for r in states.collect()] == ["empty", "valid", "too_large", "empty"]
    assert cache_key("/tmp/a", ["code"]) != cache_key("/tmp/a", ["code", "docs"])


def test_line_chunks(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["a" * rnd.randrange(300), "\n", "é ", "\n\n", "\r\n", "\r", "\x0b", "\x0c", "\x1d", "\x85", "\u2028"]) for _ in range(rnd.randrange(40))) for _ in range(60)]
    texts += ["", "   \n ", "x" * 2000, "ab\n" * 6, "one\n" + "y" * 900 + "\nend"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("n", None)], "path string, text string")
    got: dict = {}
    for r in C.chunk_lines(rows).orderBy("slot").collect():
        got.setdefault(r["path"], []).append((r["slot"], r["start_line"], r["end_line"], r["content"]))
    for i, t in enumerate(texts):
        want, s = [], 0
        for line in t.splitlines(keepends=True) if t.strip() else []:
            if want and want[-1][1] - want[-1][0] + len(line) <= 750:
                want[-1][1] += len(line)
            else:
                want.append([s, s + len(line)])
            s += len(line)
        assert got.get(str(i), []) == [(k, (n := t.count("\n", 0, a) + 1), n + t.count("\n", a, b - 1), t[a:b]) for k, (a, b) in enumerate(want)]
    few = C.chunk_lines(spark.createDataFrame([("p", "ab\n" * 6)], "path string, text string"), limit=10).orderBy("slot").collect()
    assert [(r["start_line"], r["end_line"], r["content"]) for r in few] == [(1, 3, "ab\n" * 3), (4, 6, "ab\n" * 3)]


def test_syntax_chunks(spark):
    code = "".join(f"def f{i}(a, b):\n    if a:\n        return b + {i}\n    return a\n\n" for i in range(60))
    big = "class K:\n" + "".join(f"    def m{i}(self):\n        x = {i}\n        return x\n" for i in range(60))
    for text in (code, big, "x = 'é'\ny = 2\n", "def broken(:", "", "(" * 3000):
        parts = C.python_parts(text)
        if parts is None:
            continue
        assert all(s < e for s, e in parts) and all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))
        assert not parts or parts[-1][1] <= len(text)
    assert len(C.python_parts(code)) > 3 and len(C.python_parts(big)) > 3
    rows = spark.createDataFrame([("a", code, "python"), ("b", code, "go"), ("c", "def broken(:", "python"), ("d", None, None)], "path string, text string, language string")
    got = {p: [r for r in C.chunk_syntax(rows).collect() if r["path"] == p] for p in "abcd"}
    assert len(got["a"]) > 1 and len(got["b"]) > 1 and len(got["c"]) == 1 and not got["d"]
    assert all(r["content"] in code for p in "ab" for r in got[p])


NOW = dt.datetime(2026, 1, 10, 12)


def _log(spark):
    at = lambda *a: dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp()
    rows = [(at(2026, 1, 10, 1), "search", 1, 100, 500), (at(2026, 1, 4), "search", 1, 300, 100), (at(2026, 1, 3, 23), "find_related", 1, 0, 50), (at(2020, 1, 1), "search", 2, 10, 20)]
    return spark.createDataFrame(rows, U.LOG_SCHEMA)


def test_savings(spark):
    got = {r["period"]: (r["calls"], r["saved_chars"]) for r in U.savings_buckets(_log(spark), NOW).collect()}
    assert got == {"Today": (1, 400), "Last 7 days": (2, 400), "All time": (4, 460)}
    assert {r["period"]: r["calls"] for r in U.savings_buckets(_log(spark).limit(0), NOW).collect()} == {p: 0 for p in got}
    assert "search: 3 (75%)" in U.usage_report(_log(spark), NOW)


def test_log_round_trip_and_stream(spark, tmp_path):
    at = str(tmp_path / "log")
    U.write_log(_log(spark), at)
    with open(os.path.join(at, "more.json"), "w") as f:
        f.write('{"ts": 1.0, "call": "search"}\nnot json\n' + json.dumps(dict(ts=2.0, call="x", results=1, snippet_chars=1, file_chars=2)) + "\n")
    log = U.read_log(spark, at)
    assert log.count() == 5
    batch = daily_usage(log.withColumn("at", F.timestamp_micros((F.col("ts") * 1_000_000).cast("bigint"))))
    run = daily_usage(stream_log(spark, at).dropna()).writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {tuple(r) for r in spark.table("days").collect()} == {tuple(r) for r in batch.collect()}


def test_task_files(spark, tmp_path):
    (tmp_path / "repo-a.json").write_text(json.dumps([
        {"query": "q1", "category": "symbol", "relevant": ["a.py", {"path": "b.py", "start_line": 3, "end_line": 9}], "secondary": ["c.py"]},
        {"query": "q2", "relevant": ["d.py"]},
    ]))
    rows = read_tasks(spark, str(tmp_path / "repo-a.json")).orderBy("position").collect()
    assert [(r["repo"], r["query"], [tuple(t) for t in r["targets"]]) for r in rows] == [
        ("repo-a", "q1", [("a.py", None, None), ("b.py", 3, 9), ("c.py", None, None)]), ("repo-a", "q2", [("d.py", None, None)]),
    ]
    row = dict(file_path="a.py", start_line=1, end_line=3, score=0.5, content="x\ny\nz")
    assert json.loads(results_json("q", [row], 2))["results"] == [{"location": "a.py:1-3", "score": 0.5, "content": "x\ny"}]
    assert "content" not in json.loads(results_json("q", [row], 0))["results"][0]


def test_source_tree(spark, tmp_path):
    from siftlake.sources.tree import register

    _tree(tmp_path, {"a.py": "x = 1\n", "b/c.go": "package c", "b/blank.py": " ", "docs/r.md": "# hi", "skip/d.py": "y", ".gitignore": "skip/"})
    register(spark)
    got = spark.read.format("source_tree").option("content", "code,docs").load(str(tmp_path))
    assert {(r["path"], r["language"], r["status"], r["text"]) for r in got.collect()} == {
        ("a.py", "python", "valid", "x = 1\n"), ("b/c.go", "go", "valid", "package c"), ("b/blank.py", "python", "empty", " "), ("docs/r.md", "markdown", "valid", "# hi"),
    }
    names = spark.read.format("source_tree").option("text", "false").option("ignore", "b/").load(str(tmp_path))
    assert [(r["path"], r["text"]) for r in names.collect()] == [("a.py", None)]
