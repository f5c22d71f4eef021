"""How distinctive a term is for a record: smoothed language-model divergence.

A record's term distribution is smoothed with the collection's (Dirichlet prior of mass
``mu``); a term scores its own contribution to the relative entropy between the two,
``p * ln(p / q)``. Common terms have p close to q and score about 0, frequent terms of the
record that the collection hardly knows score most.

Records are cut into terms once. Their profiles (terms and counts) are written down in
parts. Each part hands on its own counts of terms, a row per different term; these are
summed up per term and the sums go back to the parts that have the term, where they meet
the profiles as these are read from their file. So no posting is ever shuffled, nothing is
held by the driver or broadcast, and a task holds the terms of one part, however large the
collection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.session import scratch_path

#: Records of a part that are scored at a time.
SLICE_RECORDS = 20_000


def _profile_batch(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Terms and counts of each text. A term is [a-z_][a-z0-9_]* with A-Z lowered: of every
    run of word characters what follows its leading digits."""
    words = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), "[^a-z0-9_]+")
    record = pc.list_parent_indices(words).to_numpy()
    terms = pc.ascii_ltrim(pc.list_flatten(words), characters="0123456789")
    kept = pc.not_equal(terms, "")
    record, terms = record[kept.to_numpy(zero_copy_only=False)], pc.filter(terms, kept)
    coded = terms.dictionary_encode()
    n_terms = max(1, len(coded.dictionary))
    pairs, counts = np.unique(record.astype(np.int64) * n_terms + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    offsets = np.searchsorted(pairs // n_terms, np.arange(len(keys) + 1)).astype(np.int32)
    term_lists = pa.ListArray.from_arrays(pa.array(offsets), coded.dictionary.take(pa.array(pairs % n_terms)))
    count_lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts.astype(np.int32)))
    length = np.bincount(record, minlength=len(keys)).astype(np.int64)
    return pa.RecordBatch.from_arrays([keys, term_lists, count_lists, pa.array(length)], names=["key", "terms", "tfs", "dl"])


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            yield _profile_batch(part.column(0), part.column(1))


def term_profiles(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, terms, tfs, dl`` of every record that has a term; one row per key.

    Repeated rows are one record; null keys and null, blank or term-less texts are left
    out; texts are taken whole.
    """
    records = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = df.schema[key].dataType.simpleString()
    profiles = records.mapInArrow(_profile, f"key {kind}, terms array<string>, tfs array<int>, dl bigint").filter("dl > 0")
    return profiles.groupBy("key").agg(F.max(F.struct("dl", "terms", "tfs")).alias("_p")).select("key", "_p.terms", "_p.tfs", "_p.dl")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, term, df, cf) of a task's profiles, merged as they come."""
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        t = pa.concat_tables(held).group_by(["part", "term"]).aggregate([("df", "sum"), ("cf", "sum")])
        return t.rename_columns(["part", "term", "df", "cf"])

    for batch in batches:
        record = pc.list_parent_indices(batch.column("terms"))
        terms, tfs = pc.list_flatten(batch.column("terms")), pc.list_flatten(batch.column("tfs"))
        held.append(pa.table({"part": batch.column("part").take(record), "term": terms, "df": np.ones(len(terms), dtype=np.int64), "cf": pc.cast(tfs, pa.int64())}))
        if sum(t.num_rows for t in held) > 2_000_000:
            held = [merged()]
            if held[0].num_rows > 1_000_000:
                yield from held.pop().to_batches()
    if held:
        yield from merged().to_batches()


def part_statistics(profiles: DataFrame, min_df: int) -> DataFrame:
    """``part, term, df, cf``: the counts over all records, for every part that has the term."""
    parts = profiles.select("part", "terms", "tfs").mapInArrow(_count, "part int, term string, df bigint, cf bigint")
    counted = parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.collect_set("part").alias("parts"))
    return counted.filter(F.col("df") >= min_df).select(F.explode("parts").alias("part"), "term", "df", "cf")


def _scores(tf: np.ndarray, dl: np.ndarray, df: np.ndarray, cf: np.ndarray, n: int, total: int, mu: float) -> tuple[np.ndarray, np.ndarray]:
    q = cf / total
    p = (tf + mu * q) / (dl + mu)
    return p * np.log(p / q), np.round(tf * np.log(n / df), 6)


def _firsts(record: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """Which places of ``order`` (sorted by record) are among the first ``n`` of their record."""
    starts = np.flatnonzero(np.r_[True, record[order][1:] != record[order][:-1]])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[place < n]


def _select(record: np.ndarray, term: np.ndarray, kl: np.ndarray, tfidf: np.ndarray, n: int, by_tfidf: int) -> np.ndarray:
    """The first ``n`` terms of each record by divergence, plus every term whose tf-idf is not
    below the ``by_tfidf``-th best among those: no term that could rank higher is left out."""
    by_kl = np.lexsort((term, -kl, record))
    chosen = np.zeros(len(record), dtype=bool)
    chosen[_firsts(record, by_kl, n)] = True
    if by_tfidf:
        mine = np.flatnonzero(chosen)
        order = mine[np.lexsort((-tfidf[mine], record[mine]))]
        kept = _firsts(record, order, by_tfidf)
        floor = np.full(record.max() + 1 if len(record) else 0, np.inf)
        np.minimum.at(floor, record[kept], tfidf[kept])
        full = np.bincount(record[kept], minlength=len(floor)) >= by_tfidf
        floor[~full] = -np.inf
        chosen |= tfidf >= floor[record]
    return np.flatnonzero(chosen)


def _part_files(folder: str) -> dict[int, str]:
    import pyarrow.fs as pafs

    fs, at = pafs.FileSystem.from_uri(folder)
    names = [f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.base_name.startswith("part-")]
    return {int(p.rsplit("/", 1)[1].split("-")[1]): p for p in names}


def _score_parts(folder: str, n: int, total: int, mu: float, top: int, by_tfidf: int):
    """Meets each part's statistics with its profiles, which are read from their file."""

    def score(part: int, stats: pa.Table, files: dict[int, str]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        stats = stats.sort_by("term").combine_chunks()
        known, df_of, cf_of = stats.column("term").combine_chunks(), stats.column("df").to_numpy(), stats.column("cf").to_numpy()
        source = pq.ParquetFile(files[part], filesystem=pafs.FileSystem.from_uri(folder)[0])
        for batch in source.iter_batches(batch_size=SLICE_RECORDS, columns=["key", "terms", "tfs", "dl"]):
            record = pc.list_parent_indices(batch.column("terms")).to_numpy()
            terms = pc.list_flatten(batch.column("terms"))
            tf = pc.list_flatten(batch.column("tfs")).to_numpy().astype(float)
            coded = terms.dictionary_encode()
            at = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy()[coded.indices.to_numpy()]
            ok = np.flatnonzero(at >= 0)
            if not len(ok):
                continue
            record, at, tf = record[ok], at[ok], tf[ok]
            df, cf = df_of[at], cf_of[at]
            kl, tfidf = _scores(tf, batch.column("dl").to_numpy()[record], df, cf, n, total, mu)
            pick = _select(record, at, kl, tfidf, top, by_tfidf)  # places in the sorted table stand for the terms
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(record[pick])), terms.take(pa.array(ok[pick])), pa.array(tf[pick].astype(np.int32)), pa.array(df[pick]), pa.array(kl[pick]), pa.array(tfidf[pick])],
                names=["key", "term", "tf", "df", "kl", "tfidf"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:  # a task has one part
            for part in pc.unique(batch.column("part")).to_pylist():
                held.setdefault(part, []).append(batch.filter(pc.equal(batch.column("part"), part)))
        files = _part_files(folder) if held else {}
        for part in sorted(held):
            yield from score(part, pa.Table.from_batches(held.pop(part)), files)

    return run


def distinctive_terms(df: DataFrame, key: str, text: str, top: int = 10, mu: float | None = None, min_df: int = 2, by_tfidf: int = 0) -> DataFrame:
    """The ``top`` terms of every record by divergence: ``key, term, tf, df, kl, tfidf``.

    Only terms in at least ``min_df`` records count; ``mu`` defaults to the mean record
    length. With ``by_tfidf`` = m every term that can be among a record's first m by
    tf * ln(N / df) is given as well, which lets a caller apply that order exactly. Ties at
    the last place go to the lower term. Nulls as in :func:`term_profiles`; no records, no rows.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    folder = scratch_path(spark, "profiles")
    # The number of a partition is that of the file it is written to.
    term_profiles(df, key, text).withColumn("part", F.spark_partition_id()).write.parquet(folder)
    profiles = spark.read.schema(f"key {kind}, terms array<string>, tfs array<int>, dl bigint, part int").parquet(folder)
    n, total, parts = profiles.agg(F.count("*"), F.sum("dl"), F.max("part")).first()
    total = total or 0
    mu = float(mu if mu is not None else max(1.0, total / max(n, 1)))
    stats = part_statistics(profiles, min_df).repartitionById((parts or 0) + 1, F.col("part"))
    scored = stats.mapInArrow(_score_parts(folder, n, total, mu, top, by_tfidf), f"key {kind}, term string, tf int, df bigint, kl double, tfidf double")
    return scored.withColumnRenamed("key", key)


def first_by_tfidf(scored: DataFrame, key: str, m: int) -> DataFrame:
    """Of the operator's rows the first ``m`` per record by tf-idf (6 decimals), then term."""
    by = Window.partitionBy(key).orderBy(F.desc("tfidf"), "term")
    return scored.withColumn("position", F.row_number().over(by)).filter(F.col("position") <= m)
