"""Scanning a source tree: a pruned walk on the driver, reading on the executors."""

from __future__ import annotations

import hashlib
import os
import subprocess
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.sources.ignore import DEFAULT_DIRS, FILES, Rule, is_ignored, parse
from siftlake.sources.languages import extensions, with_language

MAX_FILE_BYTES = int(os.environ.get("SIFTLAKE_MAX_FILE_BYTES", "1000000"))
EMPTY_FILE_BYTES = 128
GIT_TIMEOUT_S = int(os.environ.get("SIFTLAKE_GIT_TIMEOUT", "60"))
#: Tasks read so many files each, unless there are fewer.
FILES_PER_TASK = 200


def _rules_in(directory: str, base: str) -> list[Rule]:
    lines: list[str] = []
    for name in FILES:
        at = os.path.join(directory, name)
        if os.path.isfile(at):
            with open(at, encoding="utf-8", errors="ignore") as f:
                lines += f.read().splitlines()
    return parse(lines, base)


def walk(root: str, suffixes: list[str], ignore: list[str] | None = None) -> Iterator[tuple[str, int, int]]:
    """(path relative to root, size, mtime_ns) of the files to index, directory by directory.

    Ignored directories are not entered, so nothing below them can come back; symbolic
    links are not followed; entries that vanish meanwhile are left out.
    """
    wanted = frozenset(suffixes)

    def enter(base: str, rules: list[Rule]) -> Iterator[tuple[str, int, int]]:
        here = os.path.join(root, base) if base else root
        rules = rules + _rules_in(here, base)
        try:
            entries = sorted((e for e in os.scandir(here) if not e.is_symlink()), key=lambda e: e.name)
        except (FileNotFoundError, NotADirectoryError, PermissionError):
            return
        for entry in entries:
            path = f"{base}/{entry.name}" if base else entry.name
            ignored, passes = is_ignored(path, entry.is_dir(), rules)
            if ignored:
                continue
            if entry.is_dir():
                yield from enter(path, rules)
            elif entry.is_file() and (passes or os.path.splitext(entry.name)[1].lower() in wanted):
                try:
                    stat = entry.stat()
                except OSError:
                    continue
                yield path, stat.st_size, stat.st_mtime_ns

    yield from enter("", parse(sorted(DEFAULT_DIRS) + list(ignore or [])))


def list_tree(spark: SparkSession, root: str, kinds: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """``path, size, mtime_ns, ext, language, content_type`` of a tree."""
    root = os.path.abspath(root)
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    rows = list(walk(root, extensions(kinds or ["code"]), ignore))
    return with_language(spark.createDataFrame(rows, "path string, size bigint, mtime_ns bigint"))


def file_status(size, text):
    """``too_large``, ``empty`` or ``valid``, as a column."""
    blank = (size < EMPTY_FILE_BYTES) & ~F.coalesce(text, F.lit("")).rlike(r"\S")
    return F.when(size > MAX_FILE_BYTES, "too_large").when(blank, "empty").otherwise("valid")


def read_files(listing: DataFrame, root: str, count: int | None = None) -> DataFrame:
    """The listing with ``text`` (UTF-8, bad bytes replaced; null if unreadable or too large) and ``status``."""
    base = os.path.abspath(root)
    n = listing.count() if count is None else count
    spread = listing.repartition(max(1, min(10_000, -(-n // FILES_PER_TASK))), "path")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in listing.schema], "text string"])

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for path, size in zip(pdf["path"], pdf["size"]):
                try:
                    with open(os.path.join(base, path), encoding="utf-8", errors="replace", newline="") as f:
                        texts.append(f.read() if size <= MAX_FILE_BYTES else None)
                except OSError:
                    texts.append(None)
            if len(pdf):
                yield pdf.assign(text=pd.Series(texts, dtype=object, index=pdf.index))

    loaded = spread.mapInPandas(load, schema)
    return loaded.withColumn("status", F.when(F.col("text").isNull() & (F.col("size") <= MAX_FILE_BYTES), "unreadable").otherwise(file_status(F.col("size"), F.col("text"))))


def skipped_large(files: DataFrame, show: int = 5) -> str:
    """A line that names the first files skipped for their size; empty if there are none."""
    rows = files.filter(F.col("size") > MAX_FILE_BYTES).orderBy("path")
    names = [r["path"] for r in rows.select("path").limit(show).collect()]
    more = rows.count() - len(names)
    return f"skipped {len(names) + more} large files: {', '.join(names)}{' ...' if more else ''}" if names else ""


def clone(url: str, ref: str | None = None, parent: str | None = None) -> tempfile.TemporaryDirectory:
    """A shallow clone in a temporary directory, to be closed by the caller.

    ``parent`` should be a folder that all executors reach, as they read the files.
    """
    at = tempfile.TemporaryDirectory(prefix="siftlake-git-", dir=parent)
    command = ["git", "clone", "--quiet", "--depth", "1", *(["--branch", ref] if ref else []), "--", url, at.name]
    try:
        subprocess.run(command, check=True, capture_output=True, timeout=GIT_TIMEOUT_S)
    except (subprocess.SubprocessError, OSError) as error:
        at.cleanup()
        raise RuntimeError(f"cannot clone {url}") from error
    return at


def cache_key(source: str, kinds: list[str]) -> str:
    """Name of a source's snapshot: a hash of its resolved place, and the content types."""
    from siftlake.sources.urls import is_git_url

    place = source if is_git_url(source) else os.path.realpath(source)
    return hashlib.sha256(place.encode()).hexdigest() + "-" + "-".join(kinds)


def cache_root() -> str:
    """Where snapshots lie: SIFTLAKE_CACHE, or the user's cache folder."""
    own = os.environ.get("SIFTLAKE_CACHE")
    return own or os.path.join(os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache"), "siftlake")
