"""Snapshots of source trees: build, reuse, update, validate, merge, clear.

A source's snapshots lie under the cache folder, each in a directory of its own; a pointer
file names the current one and is flipped by a rename, so a reader never sees half of one.
All of it goes through the file system that Spark uses for the folder. On a cluster the
cache folder must be one that all executors reach: SIFTLAKE_CACHE, or the shared folder.
"""

from __future__ import annotations

import json
import os
import tempfile
import threading
import time
import uuid
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators.chunking import CHUNK_CHARS, chunk_syntax
from siftlake.operators.index import Index, build_index, load_index, manifest_diff, merge_indexes, unique_labels, update_index
from siftlake.session import file_system, is_local, read_small, remove_tree, replace_small, shared_dir
from siftlake.sources.files import cache_key, cache_root, clone, list_tree, read_files
from siftlake.sources.urls import is_git_url, require_safe

#: Indexes kept open at a time.
OPEN = 10


def chunk_table(files: DataFrame) -> DataFrame:
    """Chunks of read files, with their ids."""
    good = files.filter("status = 'valid'").select("path", "text", "language")
    cut = chunk_syntax(good).join(good.select("path", "language"), "path")
    return cut.select(F.concat_ws(":", "path", F.col("slot").cast("string")).alias("chunk_id"), "content", F.col("path").alias("file_path"), "start_line", "end_line", "language")


class Snapshots:
    """Driver-side registry of indexes; the rows stay in Spark."""

    def __init__(self, spark: SparkSession, root: str | None = None, safe_only: bool = False):
        self.spark, self.root, self.safe_only = spark, snapshot_root(spark, root), safe_only
        self._open: OrderedDict[str, tuple[Index, float, float]] = OrderedDict()
        self._merged: tuple[tuple, Index] | None = None
        self._locks: dict[str, threading.Lock] = {}
        self._guard = threading.Lock()

    def _home(self, source: str, kinds: list[str]) -> str:
        return f"{self.root}/{cache_key(source, kinds)}"

    def _exists(self, path: str) -> bool:
        fs, at = file_system(self.spark, path)
        return fs.exists(at)

    def _pointer(self, home: str) -> dict:
        try:
            return json.loads(read_small(self.spark, f"{home}/current") or "{}")
        except ValueError:
            return {}

    def _current(self, home: str) -> str | None:
        name = self._pointer(home).get("snapshot")
        return f"{home}/{name}" if name and self._exists(f"{home}/{name}") else None

    def _flip(self, home: str, name: str, source: str) -> None:
        replace_small(self.spark, f"{home}/current", json.dumps({"snapshot": name, "source": source}))

    def get(self, source: str, kinds: list[str] | None = None, ref: str | None = None) -> Index:
        """The index of a directory or git URL: as it is if nothing changed, else updated.

        A snapshot that is incomplete, of another format or does not fit is rebuilt. What a
        git URL gave is not looked at again. An open index is checked again only after
        three times its build time. Callers that ask for one source at a time share one build.
        With ``safe_only`` git URLs of other transports than the web's are refused.
        """
        kinds = kinds or ["code"]
        home = self._home(require_safe(source) if self.safe_only else source, kinds)
        with self._guard:
            lock = self._locks.setdefault(home, threading.Lock())
        with lock:
            return self._get(home, source, kinds, ref)

    def _get(self, home: str, source: str, kinds: list[str], ref: str | None) -> Index:
        if home in self._open:
            index, built, took = self._open[home]
            if is_git_url(source) or time.monotonic() - built < 3 * took:
                self._open.move_to_end(home)
                return index
        began = time.monotonic()
        if is_git_url(source):
            at = self._current(home)
            index = self._load(at, source) if at else None
            if index is None:
                with clone(source, ref, clone_parent(self.spark)) as tree:
                    index = self._build(home, source, tree, kinds)
        else:
            index = self._build(home, source, source, kinds)
        self._open[home] = (index, time.monotonic(), time.monotonic() - began)
        self._open.move_to_end(home)
        while len(self._open) > OPEN:
            self._open.popitem(last=False)
        return index

    def _load(self, at: str, source: str) -> Index | None:
        try:
            return load_index(self.spark, at, source=source, chunk_chars=CHUNK_CHARS)
        except ValueError:
            return None

    def _build(self, home: str, source: str, tree: str, kinds: list[str]) -> Index:
        listing = list_tree(self.spark, tree, kinds).cache()
        at = self._current(home)
        previous = self._load(at, source) if at else None
        if previous is not None:
            known = self.spark.read.parquet(f"{at}/manifest")
            state = manifest_diff(known, listing.select("path", "mtime_ns")).filter("state <> 'reuse'").cache()
            if state.isEmpty():
                return previous
            fresh = read_files(listing.join(state, "path", "left_semi"), tree)
            index = update_index(previous, chunk_table(fresh), state.select("path"))
        else:
            index = build_index(chunk_table(read_files(listing, tree)))
        name = uuid.uuid4().hex
        new = f"{home}/{name}"
        listing.select("path", "mtime_ns").write.parquet(f"{new}/manifest")
        index.save(new, source=source, chunk_chars=CHUNK_CHARS)
        self._flip(home, name, source)
        loaded = self._load(new, source)
        if loaded is None or loaded.chunks.isEmpty():
            raise ValueError(f"nothing to index in {source}")
        if at:
            remove_tree(self.spark, at)
        return loaded

    def get_all(self, sources: list[str], kinds: list[str] | None = None) -> Index:
        """One index over several sources, each mentioned once, labelled by their names."""
        unique = list(dict.fromkeys(sources))
        if len(unique) == 1:
            return self.get(unique[0], kinds)
        parts = {label: self.get(s, kinds) for label, s in zip(unique_labels(unique), unique)}
        key = tuple((label, id(part)) for label, part in parts.items())
        if self._merged is None or self._merged[0] != key:  # the last merged index serves while its parts are the same
            self._merged = (key, merge_indexes(parts))
        return self._merged[1]

    def clear(self, orphans_only: bool = False) -> int:
        """Delete snapshots, or only those whose directory no longer exists."""
        removed = 0
        fs, root = file_system(self.spark, self.root)
        for status in fs.listStatus(root) if fs.exists(root) else []:
            home = status.getPath().toString()
            source = self._pointer(home).get("source")
            if source and (not orphans_only or not (is_git_url(source) or os.path.isdir(source))):
                remove_tree(self.spark, home)
                removed += 1
        self._open.clear()
        self._merged = None
        return removed


def snapshot_root(spark: SparkSession, root: str | None = None) -> str:
    """Where snapshots lie: the given place, SIFTLAKE_CACHE, or the user's cache folder on a
    local master and the shared folder on a cluster. Plain local paths become ``file://`` ones."""
    place = root or os.environ.get("SIFTLAKE_CACHE") or (cache_root() if is_local(spark) else f"{shared_dir(spark)}/siftlake-snapshots")
    return place.rstrip("/") if "://" in place else "file://" + os.path.abspath(place)


def clone_parent(spark: SparkSession) -> str | None:
    """A directory for clones that the executors read too: below the shared folder, which must then be a mounted one."""
    shared = shared_dir(spark)
    if not shared.startswith(("file:/", "/")):
        raise ValueError(f"git sources are cloned into a mounted folder, which {shared} is not; clone them yourself and index the directory")
    parent = "/" + shared.removeprefix("file:").lstrip("/")
    os.makedirs(parent, exist_ok=True)
    return parent


def temporary(spark: SparkSession) -> Snapshots:
    """A registry in a folder of its own, for tests and one-off use."""
    if is_local(spark):
        return Snapshots(spark, tempfile.mkdtemp(prefix="siftlake-snapshots-"))
    return Snapshots(spark, f"{shared_dir(spark)}/siftlake-snapshots-{uuid.uuid4().hex}")
