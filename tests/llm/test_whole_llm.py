"""Queries that once stopped short of the whole job, on small tables beyond the old bound."""

import random

import numpy as np
import pytest

from siftlake.llm.repetition import measure_repetition
from siftlake.llm.rowqueries import p3_neighbours


def test_perplexity_does_not_depend_on_what_a_task_holds(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rnd.choices(words, weights=range(1, 61), k=rnd.randrange(1, 90))) for _ in range(80)] + ["", None, "x", "once only here"]
    rows = [(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[3], (500, texts[4], "en")], "doc_id bigint, text string, lang string")
    whole = {r["doc_id"]: r for r in measure_repetition(df).collect()}
    for held in ({"held_pairs": 100}, {"held_words": 5}, {"held_pairs": 0, "held_words": 0}):
        got = {r["doc_id"]: r for r in measure_repetition(df, **held).collect()}
        assert set(got) == set(whole)
        for i, r in whole.items():
            assert got[i]["perplexity"] == (r["perplexity"] and pytest.approx(r["perplexity"], rel=1e-9))
            assert (got[i]["tokens"], got[i]["repeated"], got[i]["lang"]) == (r["tokens"], r["repeated"], r["lang"])
            assert (got[i]["low"], got[i]["high"]) == (pytest.approx(r["low"], rel=1e-9), pytest.approx(r["high"], rel=1e-9))


def test_every_vector_gets_five_neighbours(spark, tmp_path):
    v = np.random.default_rng(9).normal(size=(60, 64))  # random directions: few cosines reach 0.5
    spark.createDataFrame([(f"c{i:02}", x.astype("f4").tolist()) for i, x in enumerate(v)], "chunk_id string, v array<float>").write.parquet(f"{tmp_path}/vectors.parquet")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = u @ u.T - 3 * np.eye(60)
    want = {(f"c{i:02}", f"c{j:02}") for i in range(60) for j in np.argsort(-sims[i])[:5]}
    assert {(r["chunk_id"], r["near"]) for r in p3_neighbours(spark, str(tmp_path)).collect()} == want
