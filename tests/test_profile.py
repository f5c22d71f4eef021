"""Row-local term counts for arbitrary texts."""

import re
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from siftlake.functions.text import CAMEL_PART, IDENTIFIER
from siftlake.operators.chunking import python_parts
from siftlake.operators.profile import DIMS, profile, word_parts


def _parts(word):
    """The word in lower case and, if there are at least two, its parts."""
    parts = [p for p in word.lower().split("_") if p] if "_" in word else [p.lower() for p in re.findall(CAMEL_PART, word)]
    return [word.lower(), *parts] if len(parts) > 1 else [word.lower()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="aB_9 \n.éC", max_size=80)), min_size=1, max_size=8))
def test_profile_counts_identifiers(texts):
    batch = profile(pa.array(range(len(texts))), pa.array(texts, pa.string()))
    rows = zip(texts, batch["terms"].to_pylist(), batch["tfs"].to_pylist(), batch["dl"].to_pylist(), batch["v"].to_pylist())
    for text, terms, tfs, length, v in rows:
        counts = Counter(p for w in re.findall(IDENTIFIER, text or "") for p in _parts(w))
        assert dict(zip(terms, tfs)) == dict(counts) and length == sum(counts.values())
        assert v is None or (len(v) == DIMS and abs(sum(x * x for x in v) - 1) < 1e-9)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aBcD_9xYZ1", min_size=1, max_size=12), max_size=10))
def test_word_parts(words):
    flat, n = word_parts(pa.array(words, pa.string()))
    ends = [0, *n.cumsum().tolist()]
    assert [flat.to_pylist()[a:b] for a, b in zip(ends, ends[1:])] == [_parts(w) for w in words]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["x = 1", "def f(a):\n    return a", "class K:\n    def m(self):\n        pass", "# note", "if x:\n    y = 'é'\nelse:\n    y = 2", ""]), max_size=30), st.integers(10, 200))
def test_syntax_chunks_are_ordered_and_in_bounds(blocks, limit):
    text = "\n".join(blocks)
    parts = python_parts(text, limit)
    assert all(0 <= s < e <= len(text) for s, e in parts)
    assert all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))
