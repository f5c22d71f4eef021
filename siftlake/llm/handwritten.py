"""Generated, minified, vendored and data files among source files.

Vendored copies are found by hashes over trees, bottom-up: windows of lines are the
leaves, then chunks, files, directories up to the repository. A node that occurs in
unrelated repositories marks what is below it as a copy. A copy that was changed a little
no longer has the hash of the original file, but keeps most of its leaves. Node hashes are
sums of their children's hashes, so a directory is one row per task before the shuffle,
however many files it has; names play no part, as copies are often renamed.

Generated files are told by a comment: the whole block of comments with which the file
begins or ends is read, by the comment marks of its language. Files without such a comment,
minified scripts and data blobs are told by the layout of the lines. Names of directories
decide nothing; whether a file stands below a usual name for copies is only reported.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import one_record
from siftlake.session import scratch_table

#: Lines of a leaf.
LEAF_LINES = 3
#: A file is a changed copy from this share of leaves that other repositories have too.
SHARED_LEAVES = 0.5
#: Fewer leaves say nothing about a file's origin.
LEAST_LEAVES = 3
#: Fewer lines than this can look uniform by chance.
LAYOUT_LINES = 12
#: Lines after which records of a program repeat, at most.
MOST_PERIOD = 6
#: Levels of directories whose hashes are made in one plan; a written table lies between such blocks.
PLAN_LEVELS = 4

VENDOR_DIRS = (
    "vendor", "third_party", "thirdparty", "third-party", "node_modules", "bower_components", "external", "extern",
    "deps", "bundled", "Godeps", "Pods", "site-packages",
)

#: How a comment line may begin, by language; block comments end with the last entry.
_MARKS = {
    "hash": (re.compile(r"\s*(?:#|\"\"\"|'''|=begin)"), re.compile(r"\"\"\"|'''|=begin"), re.compile(r"\"\"\"|'''|=end")),
    "slash": (re.compile(r"\s*(?://|/\*|\*)"), re.compile(r"/\*"), re.compile(r"\*/")),
    "any": (re.compile(r"\s*(?://|#|/\*|\*|--|;|<!--|%)"), re.compile(r"/\*|<!--"), re.compile(r"\*/|-->")),
}
_STYLE = {
    **dict.fromkeys(("python", "ruby", "shell", "bash", "perl", "r", "yaml", "toml", "elixir", "julia", "make", "dockerfile", "py", "rb", "sh", "pl"), "hash"),
    **dict.fromkeys(("c", "cpp", "csharp", "go", "java", "javascript", "typescript", "rust", "kotlin", "swift", "scala", "dart", "js", "ts", "rs", "h", "cc"), "slash"),
}
_GENERATED = re.compile(
    r"code generated by\b|generated by\b.*\bdo not (?:edit|modify)|@generated\b|\bauto-?generated\b"
    r"|\bautomatically (?:generated|produced|created)|(?:generated|produced|created) automatically"
    r"|automatisch (?:erzeugt|generiert)|g[eé]n[eé]r[eé] automatiquement|generado autom[aá]ticamente|\bregenerate with\b",
    re.I,
)
_WORD, _NUMBER, _LETTER = re.compile(r"[A-Za-z_]\w*"), re.compile(r"-?\d+\w*"), re.compile(r"[g-wyzG-WYZ_]")
_STRING = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'")
_VALUES, _VALUE = re.compile(r"[0-9a-fA-FxX.,;\[\](){}\s+-]*"), re.compile(r"0[xX][0-9a-fA-F]+|\d+")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
_START = re.compile(r"[\w.\s]*=\s*(?=[\[({])")


def _is_data(line: str) -> bool:
    """Whether a line is nothing but values: numbers, hexadecimal or base64 text."""
    if _BASE64.fullmatch(line.strip(" \t\"'`+(,);")):
        return True
    start = _START.match(line)
    body = line[start.end() :] if start else line
    return bool(_VALUES.fullmatch(body)) and len(_VALUE.findall(body)) >= 4


#: What the first and the last character of a line tell about its shape.
_KIND = {**dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", "a"), '"': "q", "'": "q"}


def _recurs(shapes: list) -> bool:
    n = len(shapes)
    return any(sum(map(operator.eq, shapes, shapes[p:])) >= 0.85 * (n - p) > 0 for p in range(1, min(MOST_PERIOD, n // 2) + 1))


def _is_periodic(lines: list[str]) -> bool:
    """Whether the shapes of the lines (words, numbers and strings made alike) recur at one
    distance of at most MOST_PERIOD lines nearly everywhere: records written by a program."""
    lines = [x.strip() for x in lines]
    # Equal shapes begin and end alike; that spares most texts the rest.
    if not _recurs([(_KIND.get(x[0], x[0]), _KIND.get(x[-1], x[-1])) for x in lines]):
        return False
    text = _STRING.sub("s", "\n".join(lines))
    return _recurs(_NUMBER.sub("0", _WORD.sub("w", text)).split("\n"))


def comment_block(lines: list[str], style: str) -> tuple[list[str], bool]:
    """The comment lines with which ``lines`` begin, and whether these are all of them."""
    mark, opens, closes = _MARKS[style]
    inside, n = False, 0
    for n, x in enumerate(lines):  # noqa: B007
        if inside:
            inside = not closes.search(x)
            continue
        at = opens.search(x) if mark.match(x) else None
        if at:
            inside = not closes.search(x, at.end())
        elif not mark.match(x):
            return lines[:n], False
    return lines, True


def _says_generated(lines: list[str]) -> bool:
    return bool(_GENERATED.search("\n".join(lines)))


def _features(text: str, language: str = "") -> tuple:
    """Lines, characters, characters of data lines, lines of a chunk whose layout recurs,
    whether the comments at its beginning or end say generated, whether all of it is
    comment, and the hashes of the leaves."""
    import xxhash

    raw = [x for x in text.split("\n") if x and not x.isspace()]
    if not raw:
        return 0, 0, 0, 0, False, False, True, []
    chars = sum(map(len, raw))
    data = sum(len(x) for x in raw if len(x) > 8 and (len(x) >= 40 or "=" in x or not _LETTER.search(x)) and _is_data(x))
    uniform = len(raw) if _is_periodic(raw) else 0
    style = _STYLE.get(language, "any")
    top, whole = comment_block(raw, style)
    mark = _MARKS[style][0]
    n = len(raw)
    while n and (mark.match(raw[n - 1]) or raw[n - 1].rstrip().endswith("*/")):
        n -= 1
    head, foot = _says_generated(top), _says_generated(raw[n:])
    lines = [s for x in raw if len(s := " ".join(x.split())) > 3]
    h = np.array([xxhash.xxh64_intdigest(s) for s in lines], dtype=np.uint64)
    if len(h) >= LEAF_LINES:
        h = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
    return len(raw), chars, data, uniform, head, foot, whole, h.astype(np.int64).tolist()


_FEATURES = "chunk_id string, path string, slot int, lines bigint, chars bigint, data bigint, uniform bigint, head boolean, foot boolean, whole boolean, leaves array<bigint>"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [*[pa.int64()] * 4, *[pa.bool_()] * 3, pa.list_(pa.int64())]
    names = [x.strip().split(" ")[0] for x in _FEATURES.split(",")]
    for batch in batches:
        for at in range(0, batch.num_rows, 4000):
            part = batch.slice(at, 4000)
            rows = list(zip(*map(_features, part.column("content").to_pylist(), part.column("language").to_pylist())))
            if rows:
                arrays = [part.column("chunk_id"), part.column("path"), part.column("slot"), *[pa.array(r, k) for r, k in zip(rows, kinds)]]
                yield pa.RecordBatch.from_arrays(arrays, names=names)


def chunk_features(chunks: DataFrame) -> DataFrame:
    """One row of layout features and leaf hashes per chunk; repeated rows are one chunk."""
    known = chunks.filter(F.col("chunk_id").isNotNull() & F.col("file_path").isNotNull())
    placed = known.select(
        "chunk_id",
        F.replace(F.col("file_path"), F.lit("\\"), F.lit("/")).alias("path"),
        F.coalesce(F.expr("try_cast(substring_index(chunk_id, ':', -1) AS int)"), F.lit(0)).alias("slot"),
        F.coalesce("content", F.lit("")).alias("content"),
        # Without a language the suffix stands in for it.
        F.lower(F.coalesce("language", F.element_at(F.split("file_path", r"\."), -1))).alias("language"),
    )
    rows = placed.mapInArrow(_extract, _FEATURES)
    return one_record(rows, "chunk_id", ["path", "slot", "lines", "chars", "data", "uniform", "head", "foot", "whole", "leaves"])


def _node(lo: str = "lo", hi: str = "hi") -> list:
    return [F.sum(lo).alias("lo"), F.sum(hi).alias("hi"), F.sum("leaves").alias("leaves")]


def _halves(h) -> list:
    """The two halves of a hash; sums of halves do not overflow."""
    return [h.bitwiseAND(0xFFFFFFFF).alias("lo"), F.shiftrightunsigned(h, 32).alias("hi")]


def tree_hashes(files: DataFrame) -> DataFrame:
    """``dir, hash, leaves`` for every directory, from rows ``path, hash, leaves`` of files."""
    depth = F.size(F.split("path", "/")) - 1
    placed = files.withColumn("depth", depth).withColumn("dir", F.expr("substring_index(path, '/', depth)")).filter("depth > 0")
    deepest = placed.agg(F.max("depth")).first()[0] or 0
    below, levels = None, []
    for d in range(deepest, 0, -1):
        children = placed.filter(F.col("depth") == d).select("dir", *_halves(F.col("hash")), "leaves")
        if below is not None:
            children = children.unionByName(below.select(F.substring_index("dir", "/", d).alias("dir"), *_halves(F.col("hash")), "leaves"))
        below = children.groupBy("dir").agg(*_node()).select("dir", F.xxhash64("lo", "hi").alias("hash"), "leaves")
        if d % PLAN_LEVELS == 0:
            below = scratch_table(below, "dirs")  # keeps the plan of deep trees short
        levels.append(below)
    out = levels[0] if levels else files.select(F.col("path").alias("dir"), "hash", "leaves").limit(0)
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _shared(nodes: DataFrame, node: str) -> DataFrame:
    """Nodes that occur in at least two unrelated repositories."""
    return nodes.groupBy(node).agg(F.min("repo").alias("_a"), F.max("repo").alias("_b")).filter("_a <> _b").select(node)


def classify_files(chunks: DataFrame) -> DataFrame:
    """One row per file: ``file_path`` (with /) and why it is not hand-written.

    Columns ``generated, minified, data, vendored`` (booleans), ``leaves``, ``common`` and
    ``shared_leaves`` (how many and which share are found in another repository),
    ``named_vendor`` (stands below a usual name for copies; no verdict), ``handwritten``.
    The repository is the first part
    of the path; repositories whose whole trees are equal are mirrors and count as one.
    Null chunk ids and paths are ignored, paths with ``\\`` are the same as with ``/``, null
    and blank contents have no lines, without a language the suffix tells the comment marks;
    repeated rows are one chunk; no rows in, no rows out; other columns are ignored.
    """
    rows = scratch_table(chunk_features(chunks), "features")
    files = rows.groupBy("path").agg(
        F.sum("lines").alias("lines"), F.sum("chars").alias("chars"), F.sum("data").alias("data_chars"), F.sum("uniform").alias("uniform"),
        F.min(F.when(F.col("head"), F.col("slot"))).alias("_head"), F.min(F.when(~F.col("whole"), F.col("slot"))).alias("_body"),
        F.max(F.when(F.col("foot"), F.col("slot"))).alias("_foot"), F.max(F.when(~F.col("whole"), F.col("slot"))).alias("_end"), F.sum(F.size("leaves")).alias("leaves"),
        F.bit_xor(F.xxhash64("slot", "leaves")).alias("hash"),
    )
    # The comments at the head may go on over chunks that hold nothing else, and so may those at the foot.
    marked = (F.col("_head") <= F.coalesce("_body", "_head")) | (F.col("_foot") >= F.coalesce("_end", "_foot"))
    files = scratch_table(files.withColumn("head", F.coalesce(marked, F.lit(False))).drop("_head", "_body", "_foot", "_end"), "files")
    trees = scratch_table(tree_hashes(files.select("path", "hash", F.col("leaves").cast("bigint").alias("leaves"))), "trees")

    roots = trees.filter(~F.col("dir").contains("/"))
    mirrors = roots.groupBy("hash").agg(F.min("dir").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    mirrors = roots.join(mirrors, "hash").select(F.col("dir").alias("_mirror"), "_first")
    def with_repo(df: DataFrame, path: str) -> DataFrame:
        top = df.withColumn("_top", F.substring_index(path, "/", 1))
        return top.join(mirrors, F.col("_top") == F.col("_mirror"), "left").withColumn("repo", F.coalesce("_first", "_top")).drop("_top", "_mirror", "_first")

    big = F.col("leaves") >= LEAST_LEAVES
    same_file = _shared(with_repo(files.filter(big), "path"), "hash").select(F.col("hash").alias("_fh"))
    inner = trees.filter(big & F.col("dir").contains("/"))
    same_dir = inner.join(_shared(with_repo(inner, "dir"), "hash"), "hash", "left_semi").select(F.col("dir").alias("_dir"))
    parts = F.split("path", "/")
    above = files.select("path", F.explode(F.expr("transform(sequence(2, greatest(2, size(split(path, '/')) - 1)), i -> substring_index(path, '/', i))")).alias("_dir"))
    in_shared_dir = above.join(same_dir, "_dir", "left_semi").select(F.col("path").alias("_p")).distinct()

    # A leaf counts once per file; a leaf that all files have is one row per file, joined once.
    leaf = rows.filter(F.size("leaves") > 0).select(F.xxhash64("path").alias("file"), F.substring_index("path", "/", 1).alias("_r"), F.explode("leaves").alias("leaf"))
    repos = with_repo(leaf.select("leaf", F.col("_r").alias("path")), "path")
    common = _shared(repos, "leaf")
    kept = leaf.select("file", "leaf").join(common, "leaf", "left_semi").groupBy("file").agg(F.count("*").alias("_common"))

    joined = (
        files.withColumn("file", F.xxhash64("path"))
        .join(kept, "file", "left")
        .join(same_file, F.col("hash") == F.col("_fh"), "left")
        .join(in_shared_dir, F.col("path") == F.col("_p"), "left")
    )
    share = F.coalesce(F.col("_common") / F.col("leaves"), F.lit(0.0))
    vendor_dir = F.arrays_overlap(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), F.lit(list(VENDOR_DIRS)))
    text = F.col("lines") > 0
    flags = joined.select(
        F.col("path").alias("file_path"),
        (text & (F.col("head") | ((F.col("lines") >= LAYOUT_LINES) & (F.col("uniform") >= 0.8 * F.col("lines"))))).alias("generated"),
        (text & (F.col("chars") / F.col("lines") >= 120) & (F.col("data_chars") < 0.7 * F.col("chars"))).alias("minified"),
        (text & (F.col("data_chars") >= 0.7 * F.col("chars"))).alias("data"),
        ((big & (F.col("_fh").isNotNull() | (share >= SHARED_LEAVES))) | F.col("_p").isNotNull()).alias("vendored"),
        "leaves",
        F.coalesce("_common", F.lit(0)).alias("common"),
        share.alias("shared_leaves"),
        vendor_dir.alias("named_vendor"),
    )
    return flags.withColumn("handwritten", ~(F.col("generated") | F.col("minified") | F.col("data") | F.col("vendored")))
