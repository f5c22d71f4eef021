"""Snapshots and the command line over a small project."""

import json
import os
import subprocess

import pytest

from siftlake.cli import run
from siftlake.operators.index import build_index, merge_indexes
from siftlake.snapshots import Snapshots, chunk_table
from siftlake.sources.files import list_tree, read_files


def _write(root, **files):
    for name, text in files.items():
        (root / name.replace("__", ".")).write_text(text)


@pytest.fixture()
def project(tmp_path):
    at = tmp_path / "proj"
    at.mkdir()
    _write(at, auth__py="def authenticate(token):\n    return token\n", utils__py="def format_date(d):\n    return str(d)\n", README__md="# Project\nabout dates\n")
    return at


def _postings(index):
    return {(r["term"], r["chunk_id"], r["tf"], round(r["impact"], 9)) for r in index.postings.collect()}


def test_reuse_update_and_rebuild(spark, project, tmp_path):
    registry = Snapshots(spark, str(tmp_path / "cache"))
    first = registry.get(str(project))
    assert {r["file_path"] for r in first.chunks.collect()} == {"auth.py", "utils.py"}
    home = registry._home(str(project), ["code"])
    before = registry._current(home)
    registry._open.clear()
    registry.get(str(project))
    assert registry._current(home) == before  # nothing changed
    _write(project, auth__py="def authenticate(token, user):\n    return user\n", fresh__py="class Fresh: ...\n")
    os.remove(project / "utils.py")
    os.utime(project / "auth.py", ns=(1, 1))  # also a time that goes back is a change
    registry._open.clear()
    updated = registry.get(str(project))
    assert registry._current(home) != before
    rebuilt = build_index(chunk_table(read_files(list_tree(spark, str(project)), str(project))))
    assert _postings(updated) == _postings(rebuilt)
    current = registry._current(home).removeprefix("file://")
    os.rename(f"{current}/terms", f"{current}/gone")
    registry._open.clear()
    assert _postings(registry.get(str(project))) == _postings(rebuilt)  # an incomplete snapshot is rebuilt
    assert registry.get_all([str(project), str(project)]).chunks.count() == rebuilt.chunks.count()
    both = [str(project), str(project.parent)]
    assert registry.get_all(both) is registry.get_all(both)  # merged once while its parts are the same
    assert registry.clear(orphans_only=True) == 0 and registry.clear() == 2


def test_git_source(spark, project, tmp_path):
    for command in (["init", "-q"], ["add", "."], ["-c", "user.name=x", "-c", "user.email=x@y", "commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(project), *command], check=True)
    registry = Snapshots(spark, str(tmp_path / "cache"))
    index = registry.get(f"file://{project}")
    assert {r["file_path"] for r in index.chunks.collect()} == {"auth.py", "utils.py"}
    with pytest.raises(RuntimeError):
        registry.get(f"file://{tmp_path}/none")
    with pytest.raises(ValueError):
        Snapshots(spark, str(tmp_path / "cache"), safe_only=True).get(f"file://{project}")


def test_merging_refuses_other_encoders_and_building_refuses_two_rows_of_one_id(spark):
    chunk = "chunk_id string, content string, file_path string, start_line int, end_line int, language string"
    one = build_index(spark.createDataFrame([("a:0", "def a", "a", 1, 1, None)] * 2, chunk), strict=True)
    other = build_index(spark.createDataFrame([("b:0", "def b", "b", 1, 1, None)], chunk), spark.createDataFrame([("b:0", [1.0, 2.0])], "chunk_id string, v array<double>"))
    with pytest.raises(ValueError):
        merge_indexes({"one": one, "other": other})
    with pytest.raises(ValueError):
        build_index(spark.createDataFrame([("a:0", "x", "a", 1, 1, None), ("a:0", "y", "a", 1, 1, None)], chunk), strict=True)


def test_command_line(spark, project, tmp_path, monkeypatch):
    monkeypatch.setenv("SIFTLAKE_CACHE", str(tmp_path / "cache"))
    got = json.loads(run(["search", "authenticate token", str(project), "-k", "2"], spark))
    assert got["results"][0]["location"].startswith("auth.py:1") and "authenticate" in got["results"][0]["content"]
    assert "content" not in json.loads(run(["search", "format_date", str(project), "--max-snippet-lines", "0"], spark))["results"][0]
    related = json.loads(run(["find-related", "auth.py", "1", str(project)], spark))
    assert [r["location"].split(":")[0] for r in related["results"]] == ["utils.py"]
    assert "2 files" in run(["index", str(project)], spark)
    assert "search: 2" in run(["savings"], spark)
    assert ".py" in run(["file-types"], spark)
    assert run(["clear"], spark) == "removed 1 snapshots" and run(["savings"], spark) == "nothing recorded yet"
    with pytest.raises(FileNotFoundError):
        run(["search", "x", str(tmp_path / "none")], spark)
    with pytest.raises(ValueError):
        run(["find-related", "auth.py", "99", str(project)], spark)
