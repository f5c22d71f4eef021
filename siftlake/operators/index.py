"""The index: chunks, postings with their query-independent score part, and vectors.

Everything is keyed by ``chunk_id`` and long: merging indexes is a union, an update is an
anti-join and a union. Corpus statistics are derived from the rows, never kept apart from
them, and BM25's query-independent part (``impact``) is stored per posting, so that a
batch of queries is one join and one aggregation.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.text import enriched, normal_path, path_penalty, path_terms, stem
from siftlake.operators.profile import profiles

# Fixed values of the scoring formula.
K1, B = 1.5, 0.75
FORMAT = 2
PARTS = ("chunks", "terms", "vectors")


def prepare_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk id with everything that depends on the path alone worked out once."""
    one = chunks.filter(F.col("chunk_id").isNotNull()).dropDuplicates(["chunk_id"])
    path = normal_path(F.coalesce("file_path", F.lit("")))
    placed = one.select("chunk_id", path.alias("file_path"), "start_line", "end_line", "language", F.coalesce("content", F.lit("")).alias("content"))
    return placed.withColumns({"stem": F.lower(stem(F.col("file_path"))), "path_terms": path_terms(F.col("file_path")), "penalty": path_penalty(F.col("file_path"))})


def chunk_profiles(chunks: DataFrame, encoded: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """Terms, counts and vector of every chunk's enriched text (see operators.profile)."""
    return profiles(chunks, "chunk_id", enriched(F.col("content"), F.col("file_path")), encoded, also)


def exploded_terms(profiled: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``key, term, tf, dl``: a row per term; ``dl`` is the length of the whole text."""
    rows = profiled.select(key, "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("_e"))
    return rows.select(key, F.col("_e.terms").alias("term"), F.col("_e.tfs").alias("tf"), "dl")


def term_counts(chunks: DataFrame) -> DataFrame:
    """``chunk_id, term, tf, dl`` over the enriched text of every chunk."""
    return exploded_terms(chunk_profiles(chunks))


def document_lengths(chunks: DataFrame) -> DataFrame:
    """``chunk_id, dl``; chunks without any term have length 0."""
    return chunk_profiles(chunks).select("chunk_id", "dl")


def document_frequencies(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def impact(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    """What one occurrence of the term in a query adds to the chunk's score."""
    idf = F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))
    return idf * tf / (F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / avgdl) + tf)


def postings(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, chunk_id, tf, impact``, with statistics over the whole corpus.

    One join on the term; the corpus is one row. Chunks without terms count in its size.
    """
    size = chunks.agg(F.count("*").alias("n")).crossJoin(terms.agg(F.sum("tf").alias("_all")))
    corpus = F.broadcast(size.select("n", (F.col("_all") / F.col("n")).alias("avgdl")))
    joined = terms.join(document_frequencies(terms), "term").crossJoin(corpus)
    return joined.select("term", "chunk_id", "tf", impact(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("avgdl")).alias("impact"))


@dataclass
class Index:
    """Chunks, term counts, postings and vectors of one corpus; and the profiles that terms and
    vectors come from, if the index was not put together from others."""

    chunks: DataFrame
    terms: DataFrame
    postings: DataFrame
    vectors: DataFrame
    profiles: DataFrame | None = None

    def stats(self) -> DataFrame:
        """One row: files, chunks, and chunks per language (null language left out)."""
        per = self.chunks.groupBy("language").count().filter(F.col("language").isNotNull())
        languages = per.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "count")))).alias("languages"))
        return self.chunks.agg(F.countDistinct("file_path").alias("indexed_files"), F.count("*").alias("total_chunks")).crossJoin(F.broadcast(languages))

    def cached(self) -> Index:
        profiled = None if self.profiles is None else self.profiles.cache()
        return Index(self.chunks.cache(), self.terms.cache(), self.postings.cache(), self.vectors.cache(), profiled)

    def save(self, path: str, **metadata) -> None:
        """Write a snapshot; the metadata comes last, a snapshot without it does not count."""
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        # Clustered by term: a query's terms prune row groups by their least and greatest term.
        self.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        spark = self.chunks.sparkSession
        about = {"format": FORMAT, "n_chunks": self.chunks.count(), **metadata}
        spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def build_index(chunks: DataFrame, vectors: DataFrame | None = None, strict: bool = False) -> Index:
    """Index a table of chunks (chunk_id, content, file_path, start_line, end_line, language).

    Repeated rows are one chunk. With ``strict`` different rows under one id are refused.
    """
    columns = ["chunk_id", "content", "file_path", "start_line", "end_line", "language"]
    if strict and not chunks.select(*columns).distinct().groupBy("chunk_id").count().filter("count > 1 AND chunk_id IS NOT NULL").isEmpty():
        raise ValueError("several different chunks have the same id")
    prepared = prepare_chunks(chunks)
    profiled = chunk_profiles(prepared)
    return index_of(prepared, exploded_terms(profiled), chunk_vectors(profiled) if vectors is None else vectors, profiled)


def texts_of(index: Index, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``chunk_id, terms, tfs, dl``, a row per chunk with at least those of its terms that are among ``words``,
    and its language and path if the profiles hold them; and one row with the number of chunks and of all their
    terms: ``n, all``."""
    if index.profiles is not None:
        return index.profiles.drop("v"), index.profiles.agg(F.count("*").alias("n"), F.sum("dl").alias("all"))
    asked = index.terms.join(words, "term", "left_semi").groupBy("chunk_id").agg(F.collect_list(F.struct("term", "tf")).alias("_t"), F.first("dl").alias("dl"))
    size = index.chunks.agg(F.count("*").alias("n")).crossJoin(F.broadcast(index.terms.agg(F.sum("tf").alias("all"))))
    return asked.select("chunk_id", F.col("_t.term").alias("terms"), F.col("_t.tf").alias("tfs"), "dl"), size


def chunk_vectors(profiled: DataFrame, key: str = "chunk_id") -> DataFrame:
    return profiled.filter("v IS NOT NULL").select(key, "v")


def index_of(prepared: DataFrame, terms: DataFrame, vectors: DataFrame, profiled: DataFrame | None = None) -> Index:
    return Index(prepared, terms, postings(prepared, terms), vectors, profiled)


def load_index(spark: SparkSession, path: str, **expected) -> Index:
    """Read a snapshot; raises ValueError if it is incomplete or was made with other metadata."""
    try:
        about = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/metadata").collect()))
        chunks, terms, vectors = (spark.read.parquet(f"{path}/{p}") for p in PARTS)
    except Exception as error:
        raise ValueError(f"no complete snapshot in {path}") from error
    wrong = {k: v for k, v in {"format": FORMAT, **expected}.items() if about.get(k) != v}
    whole = all(t.join(chunks, "chunk_id", "left_anti").isEmpty() for t in (terms, vectors))
    if wrong or chunks.count() != about["n_chunks"] or not whole:
        raise ValueError(f"snapshot in {path} does not match: {sorted(wrong) or 'its rows are not complete'}")
    return index_of(chunks, terms, vectors)


def manifest_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``path, state``: reuse, changed, new or deleted, by modification time."""
    p = previous.select("path", F.col("mtime_ns").alias("_old"), F.lit(True).alias("_p"))
    c = current.select("path", F.col("mtime_ns").alias("_new"), F.lit(True).alias("_c"))
    state = (
        F.when(F.col("_p").isNull(), "new").when(F.col("_c").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "reuse").otherwise("changed")
    )
    return p.join(c, "path", "full").select("path", state.alias("state"))


def update_index(index: Index, changed_chunks: DataFrame, stale_paths: DataFrame) -> Index:
    """The index without the files of ``stale_paths`` (column path) and with the new chunks.

    Only the new chunks are cut into terms; all statistics follow from the united rows.
    """
    stale = stale_paths.select(F.col("path").alias("file_path")).distinct()
    kept = index.chunks.join(stale, "file_path", "left_anti")
    gone = index.chunks.join(stale, "file_path", "left_semi").select("chunk_id")
    fresh = prepare_chunks(changed_chunks)
    profiled = chunk_profiles(fresh)
    terms = index.terms.join(gone, "chunk_id", "left_anti").unionByName(exploded_terms(profiled))
    vectors = index.vectors.join(gone, "chunk_id", "left_anti").unionByName(chunk_vectors(profiled))
    return index_of(kept.unionByName(fresh), terms, vectors)


def unique_labels(sources: list[str]) -> list[str]:
    """The last part of each source as its label, with -2, -3 ... where that is taken."""
    bases = [s.rstrip("/").rsplit("/", 1)[-1].removesuffix(".git") for s in sources]
    labels: dict[int, str] = {}
    taken: set[str] = set()
    for i in sorted(range(len(sources)), key=lambda i: (sources[i], i)):
        label, n = bases[i], 1
        while label in taken:
            n += 1
            label = f"{bases[i]}-{n}"
        taken.add(label)
        labels[i] = label
    return [labels[i] for i in range(len(sources))]


def merge_indexes(parts: dict[str, Index]) -> Index:
    """One index over several; paths and ids get the label in front, terms stay as they are.

    Refuses indexes whose vectors come from encoders of different dimensions.
    """
    found = {label: part.vectors.select(F.size("v").alias("n")).first() for label, part in parts.items()}
    dims = {label: r["n"] for label, r in found.items() if r is not None}
    if len(set(dims.values())) > 1:
        raise ValueError(f"the vectors are of different encoders: {dims}")
    out: list[DataFrame] = []
    for label, part in parts.items():
        c = part.chunks.withColumns({"chunk_id": F.concat(F.lit(label + "/"), "chunk_id"), "file_path": F.concat(F.lit(label + "/"), "file_path")})
        c = c.withColumns({"path_terms": path_terms(F.col("file_path")), "penalty": path_penalty(F.col("file_path"))})
        t, v = (x.withColumn("chunk_id", F.concat(F.lit(label + "/"), "chunk_id")) for x in (part.terms, part.vectors))
        out = [a.unionByName(b) for a, b in zip(out, (c, t, v))] if out else [c, t, v]
    return index_of(*out)
