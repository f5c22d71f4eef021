"""Search laws: merge equals rebuild, update equals rebuild, decay equals the greedy loop."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siftlake.operators import index as I
from siftlake.operators import search as S

COLUMNS = "chunk_id string, content string, file_path string, start_line int, end_line int, language string, extra int"


def _chunks(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        ("src/auth.py:0", "def authenticate(token):\n    return token", "src/auth.py", 1, 2, "python", 1),
        ("src/auth.py:1", "def login(user, password):\n    pass", "src/auth.py", 3, 4, "python", 1),
        ("src/users.py:0", "class UserService:\n    def session(self): ...", "src/users.py", 1, 2, "python", 1),
        ("src/dates.go:0", "func formatDate(date string) string", "src/dates.go", 1, 1, "go", 1),
        ("src/dates.go:0", "func formatDate(date string) string", "src/dates.go", 1, 1, "go", 1),
        ("src/empty.go:0", None, "src/empty.go", 1, 1, None, 1),
        ("tests/test_auth.py:0", "def test_authenticate(): authenticate(None)", "tests/test_auth.py", 1, 1, "python", 1),
    ]
    return _chunks(spark, rows)


def _queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query string")


def _postings(index):
    return {(r["term"], r["chunk_id"]): (r["tf"], round(r["impact"], 9)) for r in index.postings.collect()}


def test_bm25_closed_form(spark):
    rows = [("a", "authenticate token", "", 1, 1, None, 0), ("b", "login password", "", 1, 1, None, 0)]
    index = I.build_index(_chunks(spark, rows))
    got = S.lexical_scores(index, _queries(spark, "authenticate")).collect()
    assert [(r["chunk_id"], round(r["score"], 12)) for r in got] == [("a", round(math.log(1 + 1.5 / 1.5) / 2.5, 12))]


def test_hybrid_search(spark, corpus):
    index = I.build_index(corpus)
    got = S.search(index, _queries(spark, "UserService", "authenticate token", "  ", None), k=3).orderBy("query_id", "rank").collect()
    assert got[0]["chunk_id"] == "src/users.py:0"
    second = [r for r in got if r["query_id"] == 1]
    assert second[0]["chunk_id"] == "src/auth.py:0" and [r["rank"] for r in second] == [1, 2, 3]
    assert {r["query_id"] for r in got} == {0, 1}
    only_go = S.search(index, _queries(spark, "date"), k=5, languages=["go"]).collect()
    assert {r["file_path"] for r in only_go} == {"src/dates.go"}
    assert S.search(index, _queries(spark, "date"), k=5, languages=["cobol"]).count() == 0
    plain = S.search(index, _queries(spark, "authenticate"), k=2, rerank=False).collect()
    assert len(plain) == 2
    with pytest.raises(ValueError):
        S.search(index, _queries(spark, "x"), alpha=1.5)


def test_filter_keeps_global_statistics(spark, corpus):
    index = I.build_index(corpus)
    asked = _queries(spark, "authenticate")
    whole = {r["chunk_id"]: r["score"] for r in S.lexical_scores(index, asked).collect()}
    part = {r["chunk_id"]: r["score"] for r in S.lexical_scores(index, asked, S.selected_chunks(index, paths=["src/auth.py"])).collect()}
    assert part == {k: v for k, v in whole.items() if k.startswith("src/auth.py")}


def test_update_equals_rebuild(spark, corpus):
    changed = _chunks(spark, [("src/auth.py:0", "def renewed(): ...", "src/auth.py", 1, 1, "python", 1), ("src/new.py:0", "fresh words", "src/new.py", 1, 1, "python", 1)])
    stale = spark.createDataFrame([("src/auth.py",), ("src/new.py",), ("src/dates.go",)], "path string")
    updated = I.update_index(I.build_index(corpus), changed, stale)
    rest = corpus.filter(~F.col("file_path").isin("src/auth.py", "src/dates.go"))
    assert _postings(updated) == _postings(I.build_index(rest.unionByName(changed)))


def test_merge_keeps_statistics_of_the_union(spark, corpus):
    index = I.build_index(corpus)
    merged = I.merge_indexes({"a": index, "b": index})
    assert merged.chunks.count() == 2 * index.chunks.count()
    df = {r["term"]: r["df"] for r in I.document_frequencies(index.terms).collect()}
    assert {r["term"]: r["df"] for r in I.document_frequencies(merged.terms).collect()} == {t: 2 * n for t, n in df.items()}
    assert I.unique_labels(["x/repo", "y/repo", "z/repo-2", "w/repo", "q/other"]) == ["repo-2", "repo-3", "repo-2-2", "repo", "other"]


def test_snapshot(spark, corpus, tmp_path):
    index, at = I.build_index(corpus), str(tmp_path / "snap")
    index.save(at, root="here")
    assert _postings(I.load_index(spark, at, root="here")) == _postings(index)
    for bad in (dict(root="there"), dict(format=0)):
        with pytest.raises(ValueError):
            I.load_index(spark, at, **bad)
    with pytest.raises(ValueError):
        I.load_index(spark, str(tmp_path / "none"))
    index.chunks.limit(2).write.mode("overwrite").parquet(f"{at}/chunks")
    with pytest.raises(ValueError):
        I.load_index(spark, at)


def _greedy(rows, k):
    out, seen = [], {}
    for score, path, line, cid in sorted(rows, key=lambda r: (-r[0], r[2], r[3])):
        out.append((score * 0.5 ** seen.get(path, 0), line, path, cid))
        seen[path] = seen.get(path, 0) + 1
    return [c for *_, c in sorted(out, key=lambda t: (-round(t[0], 9), *t[1:]))[:k]]


def test_saturation_equals_the_greedy_loop(spark):
    rnd = random.Random(5)
    rows = [(q, f"c{i:02}", f"f{rnd.randrange(4)}", rnd.randrange(9), rnd.choice([0.0, 0.5, 1.0, rnd.random()])) for q in range(8) for i in range(25)]
    df = spark.createDataFrame(rows, "query_id bigint, chunk_id string, file_path string, start_line int, score double")
    got = S.saturate(df, 10).orderBy("query_id", "rank").collect()
    for q in range(8):
        mine = [(s, p, line, c) for x, c, p, line, s in rows if x == q]
        assert [r["chunk_id"] for r in got if r["query_id"] == q] == _greedy(mine, 10)


def test_semantic_edges(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [float("nan"), 1.0]), ("e", [-1.0, 0.1])], "chunk_id string, v array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, v array<double>")
    assert [(r["chunk_id"], r["rank"]) for r in S.semantic_top(rows, asked, 5).orderBy("rank").collect()] == [("a", 1), ("e", 2)]
    assert S.semantic_top(rows, asked.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        S.semantic_top(rows, asked, 0)


def test_resolve_chunk(spark):
    chunks = spark.createDataFrame([("x:0", "src/x.py", 1, 5), ("x:1", "src/x.py", 5, 9)], "chunk_id string, file_path string, start_line int, end_line int")
    asked = spark.createDataFrame([("src\\x.py", 3), ("src/x.py", 5), ("src/x.py", 9), ("src/x.py", 10), ("y", 1)], "path string, line int")
    assert {(r["path"], r["line"]): r["chunk_id"] for r in S.resolve_chunk(chunks, asked).collect()} == {("src\\x.py", 3): "x:0", ("src/x.py", 5): "x:1", ("src/x.py", 9): "x:1"}


def test_manifest_diff(spark):
    schema = "path string, mtime_ns long"
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], schema)
    new = spark.createDataFrame([("a", 1), ("b", 1), ("d", 4)], schema)
    assert {r["path"]: r["state"] for r in I.manifest_diff(old, new).collect()} == {"a": "reuse", "b": "changed", "c": "deleted", "d": "new"}


def test_arriving_files_keep_the_index(spark, corpus, tmp_path):
    from siftlake.streaming.usage import keep_index

    held = {"index": None}

    def apply(batch, number):
        paths = batch.select(F.col("file_path").alias("path"))
        held["index"] = I.build_index(batch) if held["index"] is None else I.update_index(held["index"], batch, paths)
        held["index"] = held["index"].cached()
        held["index"].postings.count()

    at = str(tmp_path / "in")
    corpus.filter("file_path <> 'src/dates.go'").coalesce(1).write.parquet(at)
    for _ in range(2):
        stream = spark.readStream.schema(corpus.schema).parquet(at)
        keep_index(stream, apply, str(tmp_path / "state")).awaitTermination()
        corpus.filter("file_path = 'src/dates.go'").coalesce(1).write.mode("append").parquet(at)
    assert _postings(held["index"]) == _postings(I.build_index(corpus))


def test_best_chunks_come_without_a_row_for_every_pair(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(f"c{i:04}", " ".join(rng.choices(words, [8, 4, 2, 1], k=rng.randint(1, 6))), f"d/f{i % 7}.py", 1, 1, "python" if i % 3 else "go", 0) for i in range(900)]
    index = I.build_index(_chunks(spark, rows))
    asked = _queries(spark, "alpha", "alpha beta beta", "gamma delta", "nothing", "delta alpha gamma beta")
    united = I.index_of(index.chunks, index.terms, index.vectors)
    for by, allowed in ((index, None), (united, S.selected_chunks(index, ["go"]))):
        best, want = S.lexical_top(by, asked, 7, allowed), S.top_k(S.lexical_scores(by, asked, allowed), 7)
        assert by is united or "Join" not in best._jdf.queryExecution().executedPlan().toString()
        got, want = (sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in x.collect()) for x in (best, want))
        assert got == want


def test_a_task_hands_on_k_rows_whatever_it_reads(spark, tmp_path):
    """Over 40,000 rows in three portions, with one score for all of them or rising ones."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from siftlake.operators.best import best_rows

    pq.write_table(pa.table({"query_id": pa.array([1, 2], pa.int64())}), tmp_path / "part-0.parquet")
    ids = np.random.default_rng(1).permutation(40_000)
    rows = pa.table({"chunk_id": pa.array([f"c{i:05}" for i in ids]), "x": pa.array(ids)}).to_batches(max_chunksize=10_000)
    score = lambda held: lambda block: np.stack([np.ones(held.num_rows), held.column("x").to_numpy() + 1.0])
    out = pa.Table.from_batches(list(best_rows(f"file://{tmp_path}", 5, score, 5e-324)(iter(rows)))).to_pylist()
    assert {r["chunk_id"] for r in out if r["query_id"] == 2} == {f"c{i:05}" for i in range(39_995, 40_000)}
    assert {f"c{i:05}" for i in range(5)} <= {r["chunk_id"] for r in out if r["query_id"] == 1} and len(out) < 100


def test_ranking_carries_no_contents_and_reads_definitions_once(spark, corpus):
    index = I.build_index(corpus)
    asked = _queries(spark, "UserService", "authenticate token")
    pairs = S.pair_up(*S.retrieve(index, asked, 2))
    assert "content" not in S.placed(pairs, index.chunks).columns
    found = S.definers(index, S.query_facts(asked), pairs).collect()
    assert [(r["query_id"], r["chunk_id"], r["factor"]) for r in found] == [(0, "src/users.py:0", 3.0)]


def test_a_filter_moves_no_texts_and_writes_no_contents(spark, corpus, tmp_path):
    from siftlake.plans import registry

    corpus.drop("extra").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(1, "date authenticate"), (2, "session")], "task_id int, query string").write.parquet(f"{tmp_path}/tasks.parquet")
    got = registry.queries()["bm25_filtered"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    at = {f.rsplit("/", 1)[0] for f in got.inputFiles()}
    assert at and all(not {"content", "v"} & set(spark.read.parquet(f).columns) for f in at)
    index = I.build_index(corpus)
    asked = spark.createDataFrame([(1, "date authenticate"), (2, "session")], "query_id bigint, query string")
    want = S.top_k(S.lexical_scores(index, asked, S.selected_chunks(index, ["python", "go"])), 10)
    assert sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in got.collect()) == sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 8)) for r in want.collect())


@pytest.mark.parametrize("also", [(), ("language",), ("language", "file_path")])
def test_languages_and_paths_are_united_wherever_they_are_held(spark, corpus, also):
    """Chunks without a language are no match; the statistics stay those of all chunks."""
    index, asked = I.build_index(corpus), _queries(spark, "authenticate date session empty", "go")
    held = I.Index(index.chunks, None, None, None, I.chunk_profiles(index.chunks, encoded=False, also=also))
    for languages, paths in ((["go"], None), (None, ["src/auth.py", "src/empty.go"]), (["go"], ["src/users.py"]), (["cobol"], None)):
        got = S.lexical_top(held, asked, 5, languages=languages, paths=paths)
        want = S.top_k(S.lexical_scores(index, asked, S.selected_chunks(index, languages, paths)), 5)
        rows = [sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in x.collect()) for x in (got, want)]
        assert rows[0] == rows[1] and (rows[0] or languages == ["cobol"])
        missing = {c for c, wanted in (("language", languages), ("file_path", paths)) if wanted} - set(also)
        assert ("Join" in got._jdf.queryExecution().executedPlan().toString()) == bool(missing)
