"""Terms, source files, containers, mixes and repetition against plain Python, with dirty input."""

import bisect
import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftlake.llm.bytetokens import scan, token_counts
from siftlake.llm.distinctive import distinctive_terms, first_by_tfidf
from siftlake.llm.handwritten import classify_files
from siftlake.llm.mixing import mix, out_of_reach
from siftlake.llm.packing import difference, fill, pack, public_tokenizer, sizes
from siftlake.llm.repetition import PairModel, fit_model, measure_repetition

TOKEN = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]")
TERM = re.compile(r"[a-z_][a-z0-9_]*")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _texts(n=200, seed=8):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(["a", "Bc", "9", "_", " ", "\n", "é", "€", "\U0001f600", ".", "\x0b", " ", "İ", "x1"]) for _ in range(rnd.randrange(80))) for _ in range(n)]


def test_tokens_equal_the_pattern():
    texts = [*_texts(), "", None, "word", "a" * 300_000, " " * 50, "end_of_one", "begin_of_next"]
    assert token_counts(pa.array(texts, pa.string())).tolist() == [len(TOKEN.findall(t or "")) for t in texts]
    assert token_counts(pa.array(texts, pa.string()).slice(5, 7)).tolist() == [len(TOKEN.findall(t or "")) for t in texts[5:12]]
    assert token_counts(pa.array([], pa.string())).tolist() == []


def test_token_hashes_tell_tokens_apart():
    texts = _texts(100)
    seen: dict = {}
    for at, tokens in scan(pa.array(texts)):
        hashes = tokens.hashes()
        for i, (a, b) in enumerate(zip(tokens.first[:-1], tokens.first[1:])):
            for h, t in zip(hashes[a:b], TOKEN.findall(texts[at + i].translate(LOWER))):
                assert seen.setdefault(int(h), t) == t
    assert len(set(seen.values())) == len(seen)


CHUNKS = "chunk_id string, content string, file_path string, term string, tf int, language string"


def test_distinctive_terms(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(40)] + ["Common", "x9y", "__init__", "9lead", "é"]
    rows = [(f"c{i:03}", " ".join(rnd.choices(words, k=rnd.randrange(60))), "p", "t", 1, None) for i in range(120)]
    rows += [rows[3], rows[3], ("blank", "  ", "p", "t", 1, None), ("null", None, "p", "t", 1, None), (None, "w1 w2", "p", "t", 1, None), ("long", "w1 w2 w3 " * 20_000, "p", "t", 1, None), ("rare", "unique_here w1", "p", "t", 1, None)]
    df = spark.createDataFrame(rows, CHUNKS)
    counts = {k: collections.Counter(TERM.findall(t.translate(LOWER))) for k, t, *_ in rows if k and t and TERM.findall(t.translate(LOWER))}
    n, dfs, cfs = len(counts), collections.Counter(t for c in counts.values() for t in c), collections.Counter()
    for c in counts.values():
        cfs.update(c)
    total = sum(cfs.values())
    mu = total / n
    want3, want_kl = set(), {}
    for k, c in counts.items():
        known = [t for t in c if dfs[t] >= 2]
        want3 |= {(k, t) for t in sorted(known, key=lambda t: (-round(c[t] * math.log(n / dfs[t]), 6), t))[:3]}
        for t in known:
            q, dl = cfs[t] / total, sum(c.values())
            p = (c[t] + mu * q) / (dl + mu)
            want_kl[k, t] = p * math.log(p / q)
    scored = distinctive_terms(df, "chunk_id", "content", top=4, by_tfidf=3)
    assert {(r["chunk_id"], r["term"]) for r in first_by_tfidf(scored, "chunk_id", 3).collect()} == want3
    best = distinctive_terms(df, "chunk_id", "content", top=4).collect()
    per = collections.Counter(r["chunk_id"] for r in best)
    for r in best:
        assert r["kl"] == pytest.approx(want_kl[r["chunk_id"], r["term"]]) and per[r["chunk_id"]] <= 4
        worse = sorted((v for (k, _), v in want_kl.items() if k == r["chunk_id"]), reverse=True)[:4]
        assert r["kl"] >= worse[-1] - 1e-12
    assert distinctive_terms(df.limit(0), "chunk_id", "content").count() == 0


def _function(rnd, n):
    names = lambda: "".join(rnd.choice("abcdefghij") for _ in range(8))
    lines = []
    for _ in range(n):
        lines.append(rnd.choice([
            f"def {names()}({names()}, {names()}):", f"    if {names()} == {rnd.randrange(99)}:", f"        {names()} = {names()}({names()}, {names()})", f"    return {names()} + {names()}[{rnd.randrange(9)}]",
            f"    for {names()} in {names()}:", f"        {names()}.{names()}({names()})", f"    while not {names()}:", f"    raise {names()}({names()!r})", f"    # {names()} {names()} {names()}",
        ]))
    return "\n".join(lines)


def test_classes_of_files(spark):
    rnd = random.Random(10)
    lib = {f"lib/{x}.py": _function(rnd, 40) for x in "abc"}
    files = {f"{repo}/third/{p}": t for repo in ("r1", "r2") for p, t in lib.items()}
    changed = lib["lib/a.py"].split("\n")
    for i in (3, 17, 30):
        changed[i] = "    patched = True"
    files["r3/src/renamed.py"] = "\n".join(changed)
    own = {f"r{i}/src/own{j}.py": _function(rnd, 30) for i in (1, 2, 3) for j in range(4)}
    files |= own
    files["r1/gen/a.go"] = "// Code generated by tool v1.2. DO NOT EDIT.\n" + _function(rnd, 20)
    files["r1/gen/b.py"] = "#!/usr/bin/env python\n# This file was produced automatically by x.\n" + _function(rnd, 20)
    files["r1/gen/c.go"] = _function(rnd, 60) + "\n// Code generated by tool v1.2. DO NOT EDIT."
    licence = "\n".join(f"// Licence paragraph {i}: {_function(rnd, 1)}" for i in range(40))
    files["r1/gen/licence.go"] = licence + "\n// Code generated by tool v1.2. DO NOT EDIT.\n" + _function(rnd, 20)
    files["r1/gen/block.java"] = "/*\n Licence\n text\n This file was produced automatically by x.\n*/\n" + _function(rnd, 20)
    files["r2/src/marks.py"] = "// Code generated by x. DO NOT EDIT. is no comment here\n" + _function(rnd, 20)
    files["r2/" + "deep/" * 60 + "own.py"] = _function(rnd, 20)
    files["r1/gen/ids.js"] = "\n".join(f"NAME_{i}_ID = {i};" for i in range(60))
    files["r2/src/banner.py"] = '# Writes the banner.\nBANNER = "Code generated by x. DO NOT EDIT."\n' + _function(rnd, 20)
    files["r2/src/note.py"] = "# order: do not edit the order, it matters\n" + _function(rnd, 20)
    files["r2/src/about.py"] = _function(rnd, 20) + "\n# mentions auto-generated code late in the file\n" + _function(rnd, 20)
    files["r1/js/x.min.js"] = "function a(b){return b}" * 80
    files["r1/js/longline.js"] = _function(rnd, 30) + '\nx = "' + "word " * 60 + '"'
    files["r3/src/blob.py"] = "DATA = [\n" + "\n".join(", ".join(hex(rnd.randrange(256)) for _ in range(12)) + "," for _ in range(40)) + "\n]"
    files["r3/src/b64.rb"] = "\n".join('"' + "".join(rnd.choice("abcXYZ019+/") for _ in range(76)) + '"' for _ in range(30))
    files["r3/vendor/tiny.py"] = "x = 1"
    files["r3/vendor_tools/own.py"] = _function(rnd, 20)
    rows = []
    for p, t in files.items():
        lines = t.split("\n")
        for slot in range(0, max(1, len(lines)), 25):
            rows.append((f"{p}:{slot // 25}", "\n".join(lines[slot : slot + 25]), p.replace("/", "\\") if slot else p, "t", 1, None))
    rows += [rows[0], rows[1], ("r9/x.py:0", None, "r9/x.py", None, None, None), ("r9/y.py:0", " \n ", "r9/y.py", None, None, None), (None, "x", "r9/z.py", None, None, None), ("noslot", "a = 1", "plain.py", None, None, None)]
    df = spark.createDataFrame(rows, CHUNKS.replace("term", "lines").replace("tf int", "head int"))
    got = {r["file_path"]: r for r in classify_files(df).collect()}
    flagged = lambda kind: {p for p, r in got.items() if r[kind]}
    assert flagged("vendored") == {p for p in files if "/third/" in p} | {"r3/src/renamed.py"}
    assert flagged("named_vendor") == {"r3/vendor/tiny.py"}  # reported, not decisive
    assert flagged("generated") == {"r1/gen/a.go", "r1/gen/b.py", "r1/gen/c.go", "r1/gen/ids.js", "r1/gen/licence.go", "r1/gen/block.java"} | (flagged("data") & flagged("generated"))
    assert flagged("data") == {"r3/src/blob.py", "r3/src/b64.rb"}
    assert flagged("minified") == {"r1/js/x.min.js"}
    assert set(got) == set(files) | {"r9/x.py", "r9/y.py", "plain.py"}
    assert classify_files(df.limit(0)).count() == 0


def test_mirrors_are_one_repository(spark):
    rnd = random.Random(11)
    own = {f"src/m{j}.py": _function(rnd, 30) for j in range(3)}
    rows = [(f"{repo}/{p}:0", t, f"{repo}/{p}", "t", 1, None) for repo in ("a", "b") for p, t in own.items()]
    assert classify_files(spark.createDataFrame(rows, CHUNKS)).filter("vendored").count() == 0
    more = rows + [("b/src/extra.py:0", _function(rnd, 30), "b/src/extra.py", "t", 1, None)]
    assert classify_files(spark.createDataFrame(more, CHUNKS)).filter("vendored").count() == 6


def test_differencing_balances():
    rnd = np.random.default_rng(12)
    w = rnd.integers(1, 100, size=400)
    parts, sums = difference(w, 10)
    assert sorted(sum(parts, [])) == list(range(400)) and sums.max() - sums.min() <= 2
    assert [int(w[p].sum()) for p in parts] == sums.tolist()
    assert difference(np.array([5]), 3)[1].tolist() == [5] and difference(np.array([], dtype=int), 3)[0] == []


def _best_fit(w, capacity):
    """Windows that best-fit decreasing needs."""
    free: list = []
    for x in sorted(map(int, w), reverse=True):
        at = bisect.bisect_left(free, x)
        bisect.insort(free, (free.pop(at) if at < len(free) else capacity) - x)
    return len(free)


@pytest.mark.parametrize("low,high", [(1, 2049), (1000, 1100), (1, 30), (2048, 2049), (300, 900), (650, 700)])
def test_fill_wastes_little(low, high):
    w = np.random.default_rng(13).integers(low, high, size=700)
    parts = fill(w, 2048)
    assert sorted(sum(parts, [])) == list(range(700)) and all(w[p].sum() <= 2048 for p in parts)
    assert len(parts) <= 1.04 * _best_fit(w, 2048)
    plain = fill(w, 2048, exchange=False)
    assert sorted(sum(plain, [])) == list(range(700)) and all(w[p].sum() <= 2048 for p in plain) and len(plain) >= len(parts)
    assert fill(np.array([], dtype=int), 10) == []


def test_pack_cuts_only_what_does_not_fit(spark):
    rnd = random.Random(14)
    texts = ["w " * rnd.choice([0, 1, 5, 49, 50, 51, 100, 101, 350, rnd.randrange(60)]) for _ in range(500)] + [None, "", "x " * 10_000]
    rows = [(i, t, "c", 3) for i, t in enumerate(texts)]
    sized = sizes(spark.createDataFrame(rows, "doc_id bigint, text string, container string, tokens int"), "doc_id", "text")
    got = pack(sized, "doc_id", 50, shard_items=100).collect()
    need = {i: len(TOKEN.findall(t or "")) for i, t in enumerate(texts)}
    by_doc, by_box = collections.defaultdict(list), collections.Counter()
    for r in got:
        by_doc[r["doc_id"]].append((r["piece"], r["tokens"]))
        by_box[r["container"]] += r["tokens"]
    assert {d: sum(n for _, n in p) for d, p in by_doc.items()} == {d: n for d, n in need.items() if n}
    for d, pieces in by_doc.items():
        assert sorted(p for p, _ in pieces) == list(range(math.ceil(need[d] / 50)))
        assert all(n == 50 for p, n in pieces if p < len(pieces) - 1)
    assert max(by_box.values()) <= 50 and sum(by_box.values()) / 50 / len(by_box) > 0.95
    assert pack(sized.limit(0), "doc_id", 50).count() == 0


def test_public_tokenizer(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "<|endoftext|>")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["tokens"] for r in sizes(df, "doc_id", "text", count=public_tokenizer(path)).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] > 1


DOCS = "doc_id bigint, text string, source string, cap double, member int"


def _mix_rows():
    rnd = random.Random(15)
    vocab = {s: [f"{s}{i}" for i in range(30)] for s in ("big", "mid", "small")}
    rows = [(i, " ".join(rnd.choices(vocab[s], k=rnd.randrange(20, 60))), s, 1.0, 1) for i, s in enumerate(["big"] * 900 + ["mid"] * 300 + ["small"] * 60)]
    rows += [(2000 + i, " ".join(rnd.choices(vocab["small"], k=40)), None, 1.0, 1) for i in range(20)]
    rows += [(3000, "x " * 40, " BIG ", 1.0, 1), (3001, None, "big", 1.0, 1), (3002, "", "mid", 1.0, 1), (None, "x", "big", 1.0, 1), (3003, "y " * 50, "other", 1.0, 1)]
    return rows


def test_mix_reaches_its_targets(spark):
    df = spark.createDataFrame(_mix_rows(), DOCS)
    targets = spark.createDataFrame([("Big", 0.5, 1), ("mid", 0.35, 2), ("small", 0.1, 3), ("gone", 0.05, 4)], "source string, target_share double, max_repeats int")
    draws, report = mix(df, targets, unlabelled=False)
    rows = {r["source"]: r for r in report.collect()}
    assert rows["gone"]["drawn_tokens"] == 0 and {r["source"] for r in out_of_reach(report).collect()} == {"gone"}
    for s in ("big", "mid", "small"):
        assert rows[s]["expected_tokens"] == pytest.approx(rows[s]["target_tokens"], rel=0.001)
        assert rows[s]["drawn_tokens"] == pytest.approx(rows[s]["target_tokens"], rel=0.1)
        assert rows[s]["reached_share"] == pytest.approx(rows[s]["target_share"] / 0.95, rel=0.1)
    got = draws.collect()
    assert max(r["copies"] for r in got if r["source"] == "small") <= 3 and max(r["copies"] for r in got if r["source"] == "big") == 1
    assert len({r["doc_id"] for r in got}) == len(got) and not {3001, 3002, 3003} & {r["doc_id"] for r in got}
    again = {(r["doc_id"], r["copies"]) for r in mix(df, targets, unlabelled=False)[0].collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in got}


def test_unlabelled_records_join_by_their_words(spark):
    df = spark.createDataFrame(_mix_rows(), DOCS)
    targets = spark.createDataFrame([("big", 0.2, 1), ("small", 0.2, 1)], "source string, target_share double, max_repeats int")
    draws, report = mix(df, targets)
    assert {r["doc_id"] for r in draws.filter("source IS NULL").collect()} == set(range(2000, 2020))
    assert {r["source"] for r in out_of_reach(report).collect()} == {"small"}
    empty = mix(df.limit(0), targets)
    assert empty[0].count() == 0 and {r["reached_share"] for r in empty[1].collect()} == {0.0}
    assert mix(df, targets.limit(0))[1].count() == 0


def _share(text, run=8):
    t = TOKEN.findall((text or "").translate(LOWER))
    runs = [tuple(t[i : i + run]) for i in range(len(t) - run + 1)]
    return 1 - len(set(runs)) / len(runs) if runs else 0.0


def test_repetition(spark):
    rnd = random.Random(16)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rnd.choices(words, k=rnd.randrange(5, 120))) for _ in range(150)] + ["spam and eggs again " * 30, "Aa bB " * 300, "a b c d e f g h", "", None, "x" * 100_000, "€ " * 60, *_texts(40)]
    rows = [(i, t, rnd.choice(["en", "de", None, "und", " EN "]), 1, 2.0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [rows[0], (None, "x", "en", 1, 1.0)], "doc_id bigint, text string, lang string, tokens int, low double")
    got = {r["doc_id"]: r for r in measure_repetition(df).collect()}
    assert set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        assert got[i]["repeated"] == pytest.approx(_share(t)) and got[i]["tokens"] == len(TOKEN.findall(t or ""))
    assert {r["lang"] for r in got.values()} == {"en", "de", "und"}
    assert got[150]["perplexity"] < np.median([got[i]["perplexity"] for i in range(150)])
    assert got[153]["perplexity"] is None and got[153]["rejected"] is False
    assert measure_repetition(df.limit(0)).count() == 0
    joined = {r["doc_id"]: r for r in measure_repetition(df, held_pairs=1, held_words=1).collect()}  # nothing held: all joined
    assert set(joined) == set(got)
    for i, r in got.items():
        assert joined[i]["perplexity"] == (None if r["perplexity"] is None else pytest.approx(r["perplexity"], rel=1e-9)) and joined[i]["rejected"] == r["rejected"]


def test_pair_model_is_a_distribution(spark):
    rnd = random.Random(17)
    texts = [" ".join(rnd.choices("abcdefgh", weights=range(1, 9), k=50)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for held in (2_000_000, 20):
        model: PairModel = fit_model(df, "text", held_pairs=held)
        assert len(model.pair) <= held
        known = {w: next(t for _, t in scan(pa.array([w]))).hashes() for w in "abcdefgh"}
        for w in "abcdefgh":
            before = np.repeat(known[w], 8)
            p = np.exp(model.log_probability(before, np.concatenate([known[x] for x in "abcdefgh"])))
            assert 0.9 < p.sum() <= 1.0 + 1e-9
