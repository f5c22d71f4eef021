"""Cutting files into chunks: by lines inside the JVM, by syntax through a provider."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters a chunk should have at most; a single longer line is a chunk of its own.
CHUNK_CHARS = 750
LEAST_NODE, MOST_DEPTH = 50, 500

Provider = Callable[[str], list[tuple[int, int]] | None]


#: Everything that ends a line, and a line with its end.
_ENDS = r"\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029"
LINE = rf"[^{_ENDS}]*(?:\r\n|[{_ENDS}])|[^{_ENDS}]+"
#: A character that is no blank of any kind.
INKED = r"[^\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_CHUNK = "struct<start_line:int,end_line:int,content:string>"


def line_chunks(text: Column, limit: int = CHUNK_CHARS) -> Column:
    """Array of (start_line, end_line, content): lines merged while their lengths stay within the limit.

    One fold over the lines notes where each chunk begins; the chunks are then cut out of the
    array of lines, so the work is in proportion to the text. Lines are numbered by line
    feeds; a line feed at the end belongs to its own line. Null and blank text gives no chunk.
    """
    lines = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LINE), F.lit(0))
    facts = F.transform(lines, lambda x: F.struct(F.length(x).alias("n"), F.endswith(x, F.lit("\n")).cast("int").alias("f")))
    zero = F.lit(0)
    none = F.array().cast("array<struct<i:int,n:int,first:int,last:int>>")
    start = F.struct(none.alias("done"), zero.alias("i"), zero.alias("n"), zero.alias("chars"), F.lit(1).alias("first"), F.lit(1).alias("next"), zero.alias("feed"))

    def closed(acc: Column) -> Column:
        return F.concat(acc["done"], F.array(F.struct(acc["i"].alias("i"), acc["n"].alias("n"), acc["first"].alias("first"), (acc["next"] - acc["feed"]).alias("last"))))

    def step(acc: Column, line: Column) -> Column:
        fits = (acc["chars"] + line["n"] <= limit) | (acc["n"] == 0)
        own = lambda more, alone: F.when(fits, more).otherwise(alone)
        return F.struct(
            own(acc["done"], closed(acc)).alias("done"), own(acc["i"], acc["i"] + acc["n"]).alias("i"), own(acc["n"] + 1, F.lit(1)).alias("n"),
            own(acc["chars"] + line["n"], line["n"]).alias("chars"), own(acc["first"], acc["next"]).alias("first"),
            (acc["next"] + line["f"]).alias("next"), line["f"].alias("feed"),
        )

    cuts = F.aggregate(facts, start, step, lambda acc: F.when(acc["n"] > 0, closed(acc)).otherwise(acc["done"]))
    cut = F.transform(cuts, lambda c: F.struct(c["first"].alias("start_line"), c["last"].alias("end_line"), F.array_join(F.slice(lines, c["i"] + 1, c["n"]), "").alias("content")))
    return F.when(F.coalesce(text, F.lit("")).rlike(INKED), cut).otherwise(F.array()).cast(f"array<{_CHUNK}>")


def chunk_lines(files: DataFrame, path: str = "path", text: str = "text", limit: int = CHUNK_CHARS) -> DataFrame:
    """``path, slot, start_line, end_line, content`` of every chunk; whole texts, any length."""
    return files.select(path, F.posexplode(line_chunks(F.col(text), limit)).alias("slot", "_c")).select(path, "slot", "_c.*")


def _merge(parts: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """Neighbours joined while the sum of their own lengths stays within the limit."""
    out: list[tuple[int, int]] = []
    size = 0
    for s, e in parts:
        if out and size + e - s <= limit:
            out[-1], size = (out[-1][0], e), size + e - s
        else:
            out.append((s, e))
            size = e - s
    return out


def python_parts(text: str, limit: int = CHUNK_CHARS) -> list[tuple[int, int]] | None:
    """Syntax chunks of Python source from the standard parser; None if it does not parse.

    Statements are grouped while they fit; a larger one is split into its own statements.
    """
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    rows = text.encode().split(b"\n")
    starts = [0]
    for row in rows:
        starts.append(starts[-1] + len(row.decode(errors="replace")) + 1)

    def at(line: int, byte: int) -> int:
        return starts[line - 1] + len(rows[line - 1][:byte].decode(errors="replace"))

    def span(node: ast.stmt) -> tuple[int, int]:
        first = min([node, *getattr(node, "decorator_list", [])], key=lambda n: (n.lineno, n.col_offset))
        return at(first.lineno, 0) if first.col_offset == node.col_offset else at(first.lineno, first.col_offset), at(node.end_lineno, node.end_col_offset)

    def split(node: ast.AST, whole: tuple[int, int], depth: int) -> list[tuple[int, int]]:
        inner = [c for f in ("body", "handlers", "orelse", "finalbody") for c in getattr(node, f, []) or [] if isinstance(c, ast.stmt)]
        if not inner or depth > MOST_DEPTH or whole[1] - whole[0] < LEAST_NODE:
            return [whole]
        out, cuts = [], [span(c) for c in inner]
        head = (whole[0], cuts[0][0])
        if text[head[0] : head[1]].strip():
            out.append(head)
        for child, own in zip(inner, cuts):
            own = (max(own[0], out[-1][1] if out else own[0]), own[1])
            if own[1] > own[0]:
                out += split(child, own, depth + 1) if own[1] - own[0] > limit else [own]
        return out

    return _merge(split(tree, (0, len(text)), 0), limit) if text.strip() else []


#: Boundary providers by language; others fall back to lines.
PROVIDERS: dict[str, Provider] = {"python": python_parts}


def chunk_syntax(files: DataFrame, path: str = "path", text: str = "text", language: str = "language", providers: dict[str, Provider] | None = None, limit: int = CHUNK_CHARS) -> DataFrame:
    """Chunks along the syntax where a provider knows the language, else along lines.

    Providers look at the texts of their languages only; a text they cannot parse is cut
    along lines like those of other languages, inside the JVM.
    """
    known = PROVIDERS if providers is None else providers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                found = []
                for t, lang in zip(pdf["_text"], pdf["_language"]):
                    parts = known[lang](t) if lang in known and t else None
                    found.append(parts if parts is None else [{"start_line": (n := t.count("\n", 0, s) + 1), "end_line": n + t.count("\n", s, e - 1), "content": t[s:e]} for s, e in parts])
                yield pdf[["_path", "_text"]].assign(_chunks=pd.Series(found, index=pdf.index, dtype=object))

    named = files.select(F.col(path).alias("_path"), F.col(text).alias("_text"), F.col(language).alias("_language"))
    parsed = named.filter(F.col("_language").isin(list(known))).mapInPandas(run, f"_path string, _text string, _chunks array<{_CHUNK}>")
    rest = named.filter(F.coalesce(~F.col("_language").isin(list(known)), F.lit(True))).select("_path", "_text", F.lit(None).cast(f"array<{_CHUNK}>").alias("_chunks"))
    cut = parsed.unionByName(rest).select("_path", F.posexplode(F.coalesce("_chunks", line_chunks(F.col("_text"), limit))).alias("slot", "_c"))
    return cut.select(F.col("_path").alias("path"), "slot", "_c.*")
