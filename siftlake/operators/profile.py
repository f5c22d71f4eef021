"""Cutting texts into terms, counts and vectors, a batch of rows at a time.

A text's terms all lie in its own row, so they are counted there and nothing is shuffled.
The batch is split into words by Arrow; only words that differ are looked at in Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

#: Dimensions of the built-in encoder.
DIMS = 64


#: Where a new part begins: the letters before and after, for a batch of words at once.
_BORDERS = ["([A-Z])([A-Z][a-z])", "([a-z])([A-Z0-9])", "([A-Z])([0-9])", "([0-9])([A-Za-z])"]


def word_parts(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of every word one after the other, and how many each has: the word in lower
    case, then its parts if it has at least two. Words with ``_`` are cut there, others
    where case or digits change, as :func:`siftlake.functions.text.split_identifier` does."""
    marked = words
    for border in _BORDERS:
        marked = pc.replace_substring_regex(marked, border, r"\1 \2")
    snake = pc.match_substring(words, "_")
    cut = pc.ascii_lower(pc.if_else(snake, pc.replace_substring(words, "_", " "), marked))
    lower = pc.ascii_lower(words)
    # A blank before the cut word keeps the whole word as the first entry of its list.
    both = pc.split_pattern(pc.binary_join_element_wise(lower, pc.ascii_trim_whitespace(cut), " "), " ")
    owner, flat = pc.list_parent_indices(both).to_numpy(), pc.list_flatten(both)
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    n = np.bincount(owner[filled], minlength=len(words))
    first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
    kept = filled & (first | (n[owner] >= 3))
    return flat.filter(pa.array(kept)), np.bincount(owner[kept], minlength=len(words))


@lru_cache(maxsize=200_000)
def direction(term: str) -> tuple[int, float]:
    """A term's fixed dimension and sign."""
    number = int(hashlib.md5(term.encode()).hexdigest()[:8], 16)
    return number % DIMS, 1.0 if number // DIMS % 2 == 0 else -1.0


def profile(keys: pa.Array, texts: pa.Array, encoded: bool = True) -> pa.RecordBatch:
    words = pc.split_pattern_regex(pc.fill_null(texts, ""), "[^a-zA-Z0-9_]+")
    row = pc.list_parent_indices(words).to_numpy().astype(np.int64)
    # An identifier is what follows the leading digits of a run of word characters.
    coded = pc.ascii_ltrim(pc.list_flatten(words), characters="0123456789").dictionary_encode()
    codes = coded.indices.to_numpy()
    terms, sizes = word_parts(coded.dictionary)
    named = terms.dictionary_encode()
    flat, names = named.indices.to_numpy().astype(np.int64), named.dictionary.to_pylist()
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    n = sizes[codes] if len(codes) else np.empty(0, dtype=np.int64)
    at = np.repeat(first[codes] if len(codes) else n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    m = max(1, len(names))
    pairs, tfs = np.unique(np.repeat(row, n) * m + flat[at], return_counts=True)
    owner, term = pairs // m, pairs % m
    offsets = pa.array(np.searchsorted(owner, np.arange(len(keys) + 1)).astype(np.int32))
    counted = [
        keys,
        pa.ListArray.from_arrays(offsets, pa.array(names, pa.string()).take(pa.array(term))),
        pa.ListArray.from_arrays(offsets, pa.array(tfs.astype(np.int64))),
        pa.array(np.bincount(owner, tfs, minlength=len(keys)).astype(np.int64)),
    ]
    if not encoded:
        return pa.RecordBatch.from_arrays(counted, names=["key", "terms", "tfs", "dl"])
    dims, signs = (np.array(x) for x in zip(*map(direction, names))) if names else (np.zeros(1, int), np.zeros(1))
    v = np.zeros((len(keys), DIMS))
    np.add.at(v, (owner, dims[term] if names else owner), (signs[term] if names else 1.0) * np.log1p(tfs))
    norm = np.sqrt((v * v).sum(axis=1))
    some = norm > 1e-9
    v[some] /= norm[some, None]
    rows = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), DIMS).cast(pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([*counted, pc.if_else(pa.array(some), rows, pa.scalar(None, rows.type))], names=["key", "terms", "tfs", "dl", "v"])


def profiles(df: DataFrame, key: str, text: Column, encoded: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """``key, terms, tfs, dl, v`` of every row: its terms and their counts, the sum of the
    counts, and the built-in encoder's unit vector (null if its terms cancel out), which is
    left out unless ``encoded``. The columns in ``also`` are handed on as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                made = profile(part.column(0), part.column(1), encoded)
                yield pa.RecordBatch.from_arrays([*made.columns, *part.columns[2:]], names=[*made.schema.names, *also])

    kind = lambda c: df.schema[c].dataType.simpleString()
    shape = [f"key {kind(key)}", "terms array<string>", "tfs array<bigint>", "dl bigint", *["v array<double>"] * encoded, *(f"`{c}` {kind(c)}" for c in also)]
    return df.select(key, text.alias("_text"), *also).mapInArrow(run, ", ".join(shape)).withColumnRenamed("key", key)
