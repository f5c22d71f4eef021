"""Column expressions against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siftlake.functions import text as T


def _one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def _split(token):
    lower = token.lower()
    parts = [p for p in lower.split("_") if p] if "_" in token else [m.lower() for m in re.findall(T.CAMEL_PART, token)]
    return [lower, *parts] if len(parts) >= 2 else [lower]


def test_tokens_of_random_identifiers(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aZb_C9 .\nHTTPxY-é") for _ in range(rnd.randrange(60))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", "HandlerStack my_func simple getHTTPResponse XMLParser __init__"])], "i int, x string")
    for r in rows.select("i", "x", T.identifier_tokens(F.col("x")).alias("t")).collect():
        assert r["t"] == [p for w in re.findall(T.IDENTIFIER, r["x"]) for p in _split(w)]
    assert _one(spark, None, T.identifier_tokens) == []


@pytest.mark.parametrize(
    "query,symbol,leaf",
    [
        ("HandlerStack", True, "HandlerStack"), ("Sinatra::Base", True, "Base"), ("a\\B", True, "B"), ("p->next", True, "next"), ("os.path", True, "path"), ("_x", True, "_x"),
        ("my_func", True, "my_func"), ("getX", True, "getX"), ("session", False, "session"), ("class Foo", False, "class Foo"), ("how does it work", False, "how does it work"), (" Client ", True, "Client"),
    ],
)
def test_symbols(spark, query, symbol, leaf):
    assert _one(spark, query, T.is_symbol_query) is symbol
    assert _one(spark, query, T.leaf_symbol) == leaf
    assert _one(spark, query, T.resolve_alpha) == (0.3 if symbol else 0.5)


@pytest.mark.parametrize(
    "path,factor",
    [
        ("src/app.py", 1.0), ("pkg/__init__.py", 0.5), ("tests/test_app.py", 0.3), ("src/app_test.go", 0.3), ("src/FooTests.java", 0.3), ("a/compat/b.py", 0.3), ("examples/x.py", 0.3),
        ("types/index.d.ts", 0.7), ("tests/compat/__init__.py", 0.3 * 0.3 * 0.5), ("src\\tests\\x.py", 0.3), ("contest/x.py", 1.0), ("src/foo.spec.tsx", 0.3), ("docs_src/x.py", 0.3), ("test_helper.rb", 0.3),
    ],
)
def test_path_penalty(spark, path, factor):
    assert _one(spark, path, T.path_penalty) == pytest.approx(factor)


def test_stems_and_forms(spark):
    for path, stem in (("a/b.tar.gz", "b.tar"), (".gitignore", ".gitignore"), ("x/.env.local", ".env"), ("noext", "noext"), ("a/foo.", "foo.")):
        assert _one(spark, path, T.stem) == stem
    assert set(_one(spark, "auth_services", T.stem_forms)) == {"auth_services", "authservices", "auth_service", "authservice"}
    assert "cla" in _one(spark, "class", T.stem_forms)


@pytest.mark.parametrize(
    "content,name,found",
    [
        ("class Foo:", "Foo", True), ("x\n  def foo(self)", "foo", True), ("subclass Foo", "Foo", False), ("class Foobar", "Foo", False), ("defmodule A.B.Router do", "Router", True),
        ("create table users (", "users", True), ("Class Foo", "Foo", False), ("data class P(val x)", "P", True), ("fn a.b", "a.b", True), ("class X", "a.b", False), (None, "x", False), ("func Foo[T any]", "Foo", True),
    ],
)
def test_definitions(spark, content, name, found):
    row = spark.createDataFrame([(content, name)], "c string, n string").select(T.defines(F.col("c"), F.col("n")).alias("y")).first()
    assert row["y"] is found


def test_keywords(spark):
    assert _one(spark, "How does the Auth service auth users?", T.query_keywords) == ["auth", "service", "users"]
    row = spark.createDataFrame([(["dependency", "au", "session"], ["dependencies", "auth", "session"])], "k array<string>, p array<string>")
    assert row.select(T.keyword_matches(F.col("k"), F.col("p")).alias("n")).first()["n"] == 1  # "dependency" is no beginning of "dependencies", "au" is too short


def test_snippets_and_lines(spark):
    assert _one(spark, "a\nb\r\nc", lambda c: T.snippet(c, 2)) == "a\nb"
    assert _one(spark, "abc", lambda c: T.snippet(c, 0)) == ""
    assert _one(spark, "abc", lambda c: T.snippet(c, None)) == "abc"
    with pytest.raises(ValueError):
        T.snippet(F.col("x"), -1)


@pytest.mark.parametrize("source,git", [("https://x/y", True), ("git@host:a/b.git", True), ("/tmp/x", False), ("file:///x", True), ("C:/x", False), ("./a", False), ("git@host:/abs", False), ("a b@host:x", False), ("git+ssh://h/x", True), ("ftp://h/x", False), ("HTTPS://x", False), ("x", False)])
def test_git_urls(spark, source, git):
    from siftlake.sources.urls import is_git_url

    assert _one(spark, source, T.is_git_url) is git and is_git_url(source) is git


def test_safe_transports():
    from siftlake.sources.urls import require_safe

    assert require_safe("https://x/y") == "https://x/y" and require_safe("/tmp/x") == "/tmp/x"
    for source in ("file:///etc", "ssh://h/x", "git@host:a/b"):
        with pytest.raises(ValueError):
            require_safe(source)
