"""A source tree as a Spark data source: ``spark.read.format("source_tree").load(root)``.

The walk with its pruning happens once where the plan is made; each partition then reads
its share of the files. The tree must be visible to all executors.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftlake.sources.files import EMPTY_FILE_BYTES, FILES_PER_TASK, MAX_FILE_BYTES, walk
from siftlake.sources.languages import extensions, language_rows

SCHEMA = "path string, size bigint, mtime_ns bigint, language string, content_type string, status string, text string"


class _Files(InputPartition):
    def __init__(self, rows: list[tuple[str, int, int]]):
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options["path"])
        self.kinds = options.get("content", "code").split(",")
        self.ignore = [x for x in options.get("ignore", "").split(",") if x]
        self.with_text = options.get("text", "true").lower() == "true"
        self.known = {s: (lang, kind) for s, lang, kind in language_rows()}

    def partitions(self) -> list[InputPartition]:
        if not os.path.exists(self.root):
            raise FileNotFoundError(self.root)
        if not os.path.isdir(self.root):
            raise NotADirectoryError(self.root)
        rows = list(walk(self.root, extensions(self.kinds), self.ignore))
        return [_Files(rows[i : i + FILES_PER_TASK]) for i in range(0, len(rows), FILES_PER_TASK)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path, size, mtime in partition.rows:
            language, kind = self.known.get(os.path.splitext(path)[1].lower(), (None, None))
            status, text = "valid", None
            if size > MAX_FILE_BYTES:
                status = "too_large"
            elif self.with_text or size < EMPTY_FILE_BYTES:
                try:
                    with open(os.path.join(self.root, path), encoding="utf-8", errors="replace", newline="") as f:
                        text = f.read()
                    status = "empty" if size < EMPTY_FILE_BYTES and not text.strip() else "valid"
                except OSError:
                    status = "unreadable"
            yield path, size, mtime, language, kind, status, text if self.with_text else None


class SourceTree(DataSource):
    """Options: ``content`` (kinds, comma-separated), ``ignore`` (more patterns), ``text`` (false: names only)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTree)
