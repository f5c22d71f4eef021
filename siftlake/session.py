"""Spark session defaults and the shared scratch folder.

``scratch_table`` is how long plans are cut: the rows are written once to the
folder that every executor can reach and read back, so losing an executor costs
a re-read and never a recomputation of the whole lineage.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_scratch_roots: set[str] = set()


def build_session(app: str = "siftlake", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once, in case they cannot import it by themselves."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="siftlake-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "siftlake.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)  # the driver serves it; executors fetch their own copy


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process on one machine."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only on a local master without one."""
    configured = spark.sparkContext.getConf().get(_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not is_local(spark):
        raise RuntimeError(f"{_SETTING} must name a folder that all executors reach")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        made = tempfile.mkdtemp(prefix="siftlake-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(made)
        _own_dirs[app] = "file://" + made
    return _own_dirs[app]


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path; what Spark itself would use for it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def read_small(spark: SparkSession, path: str) -> str | None:
    """A small text file, or None if it is not there."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_small(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file aside and move it into place: a reader sees the old one or the new one."""
    fs, at = file_system(spark, path)
    staged = at.suffix("-" + uuid.uuid4().hex)
    out = fs.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark.sparkContext
    rename = context._jvm.org.apache.hadoop.fs.Options.Rename
    options = context._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), context._jsc.hadoopConfiguration()).rename(fs.makeQualified(staged), fs.makeQualified(at), options)


def remove_tree(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone already; the folder is left to the cluster's housekeeping
        pass


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the application's own scratch folder, which is removed at exit."""
    root = f"{shared_dir(spark)}/siftlake-{spark.sparkContext.applicationId}"
    if root not in _scratch_roots:
        _scratch_roots.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame, label: str = "table", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written rows."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Data files directly below ``path`` (one string per written task)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(root)]
    return sorted(p.toString() for p in found if p.getName().startswith("part-"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by name; every registered query starts here."""
    ship_package(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
