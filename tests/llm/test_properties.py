"""Properties of the array parts for arbitrary input."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from siftlake.llm.bytetokens import token_counts
from siftlake.llm.handwritten import _features, _is_data
from siftlake.llm.packing import fill
from siftlake.llm.quantiles import RelativeSketch

TOKEN = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=20))
def test_token_counts(texts):
    assert token_counts(pa.array(texts, pa.string())).tolist() == [len(TOKEN.findall(t or "")) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 90))
def test_fill_keeps_every_item_within_capacity(weights, capacity):
    w = np.array(weights, dtype=np.int64)
    parts = fill(w, capacity)
    assert sorted(sum(parts, [])) == list(range(len(w)))
    assert all(p and w[p].sum() <= capacity for p in parts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.floats(0, 1e9), max_size=400), min_size=1, max_size=6))
def test_merged_sketches_keep_count_and_range(parts):
    whole = RelativeSketch(section=8)
    for i, values in enumerate(parts):
        part = RelativeSketch(section=8, seed=i)
        part.update(np.array(values))
        whole.merge(RelativeSketch.from_bytes(part.to_bytes()))
    flat = sorted(x for p in parts for x in p)
    assert whole.n == len(flat)
    if flat:
        ends = whole.quantiles(np.array([0.0, 1.0]))[0]
        assert ends[0] == flat[0] and ends[1] == flat[-1]
        middle = whole.quantiles(np.array([0.5, 0.99]), 6.0)
        assert (middle[1] <= middle[0]).all() and (middle[0] <= middle[2]).all()


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=400))
def test_features_of_any_text(text):
    lines, chars, data, uniform, head, foot, whole, leaves = _features(text)
    assert 0 <= data <= chars and uniform in (0, lines) and len(leaves) <= max(lines, 1)


def test_lines_of_values_are_told_in_linear_time():
    assert _is_data("0x41, " * 50_000) and _is_data("A" * 300_000) and not _is_data("word " * 50_000)
    assert _is_data("X = [1, 2, 3, 4]") and not _is_data("X = [1, 2, 3, 4]  # note") and not _is_data("dead beef 1 2 3 4 zz")
