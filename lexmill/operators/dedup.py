"""Near-duplicate removal: shingles, exact Jaccard pairs, MinHash banding, order-preserving greedy keep.

Equal texts are collapsed first; what is compared are distinct texts, each named by the smallest position
that has it.  That is also what a sequential scan keeps, because equal texts share every collision.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.session import materialize, release

PERMUTATIONS = 128
BLOCK = 512


@functools.cache
def band_shape(threshold: float, permutations: int = PERMUTATIONS) -> tuple[int, int]:
    """(bands, rows) for which the areas of false hits below and of misses above the threshold are smallest in sum."""
    s = np.arange(0.0005, 1, 0.001)
    below = s < threshold

    def error(shape: tuple[int, int]) -> float:
        hit = 1 - (1 - s ** shape[1]) ** shape[0]
        return float(np.where(below, hit, 1 - hit).sum())

    return min(((b, r) for b in range(1, permutations + 1) for r in range(1, permutations // b + 1)), key=error)


def distinct_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): normalised distinct non-blank texts with their smallest id."""
    normal = docs.select(F.col(id_col).alias("id"), tx.normalize(text_col).alias("text")).filter("text <> ''")
    return normal.groupBy("text").agg(F.min("id").alias("id")).select("id", "text")


def shingle_sets(texts: DataFrame, k: int = 5) -> DataFrame:
    """(id, s): sorted 64-bit hashes of the distinct shingles."""
    return texts.select("id", F.array_sort(F.transform(tx.shingles("text", k), lambda s: F.xxhash64(s))).alias("s"))


def blocked(rows: DataFrame, keys: list[str], by: str = "id", block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of a self-join on keys, in which a key with many rows is cut to pairs of blocks of ``by``.

    Rows of the pair of blocks (p, o) have p <= o; the left side has the rows of block p, the right side those of o.
    """
    # counts are pre-aggregated and joined back, so that the rows of a hot key pass no single task
    rows = materialize(rows, "keyed")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_rows")).filter("_rows > 1")
    blocks = F.ceil(F.col("_rows") / (block or BLOCK)).cast("int")
    cut = rows.join(counts, keys).withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64(by), blocks).cast("int"))
    left = cut.select("*", F.explode(F.sequence("b", F.col("blocks") - 1)).alias("o")).withColumnRenamed("b", "p")
    right = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("b"))).alias("p")).withColumnRenamed("b", "o")
    return left.drop("_rows", "blocks"), right.drop("_rows", "blocks")


def _self_pairs(rows: DataFrame, keys: list[str], condition: Column, *select: Column) -> DataFrame:
    left, right = blocked(rows, keys)
    on = ((F.col("l.p") < F.col("l.o")) | (F.col("l.id") < F.col("r.id"))) & (F.col("l.id") != F.col("r.id")) & condition
    for k in (*keys, "p", "o"):
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return left.alias("l").join(right.hint("merge").alias("r"), on).select(F.least("l.id", "r.id").alias("i"), F.greatest("l.id", "r.id").alias("j"), *select).distinct()


def jaccard_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(i, j, jaccard): all pairs of distinct texts of at least the threshold, exactly."""
    return similar_texts(distinct_texts(docs, id_col, text_col), k, threshold)


def similar_texts(texts: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(i, j, jaccard) of texts(id, text).

    Prefix filter: sets of Jaccard >= t share one of their first |x| - ceil(t |x|) + 1 elements in any common
    order; ordering by document frequency makes the shared elements rare.  What is left of both sets behind their first common
    element must be long enough for the threshold.  Only names, sizes and places travel with the elements; the sets
    are joined once, to the distinct candidate pairs.
    """
    sets = materialize(shingle_sets(texts, k), "sets")
    frequency = sets.select(F.explode("s").alias("e")).groupBy("e").agg(F.count("*").alias("df")).filter("df > 1")
    size = F.size("s")
    shared = sets.select("id", size.alias("n"), F.explode("s").alias("e")).join(frequency, "e")
    # elements that no other set has come first in the order; they only use up places of the prefix
    ranked = shared.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("es"))
    alone = F.col("n") - F.size("es")
    places = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1 - alone
    prefix = ranked.filter(places > 0).select("id", "n", (F.col("n") - alone).alias("m"), F.posexplode(F.slice("es", F.lit(1), places)).alias("at", "x"))
    prefix = prefix.select("id", "n", (F.col("m") - F.col("at")).alias("left"), F.col("x.e").alias("e"))
    nl, nr = F.col("l.n"), F.col("r.n")
    need = (nl + nr) * (threshold / (1 + threshold)) - 1e-6
    fits = (F.least(nl, nr) >= F.greatest(nl, nr) * threshold - 1e-9) & (F.least("l.left", "r.left") >= need)
    pairs = materialize(_self_pairs(prefix, ["e"], fits), "candidates")
    common = F.size(F.array_intersect("si", "sj"))
    jaccard = common / (F.size("si") + F.size("sj") - common)
    both = pairs.join(sets.select(F.col("id").alias("i"), F.col("s").alias("si")), "i").join(sets.select(F.col("id").alias("j"), F.col("s").alias("sj")), "j")
    return both.select("i", "j", jaccard.alias("jaccard")).filter(F.col("jaccard") >= threshold - 1e-9)


def minhash_bands(sets: DataFrame, bands: int, rows: int, seed: int = 1) -> DataFrame:
    """(id, band): hashes of the bands of each set's MinHash signature, computed for a whole Arrow batch at once."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**64, bands * rows, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 2**64, bands * rows, dtype=np.uint64)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            hashes = [np.asarray(s) for s in pdf["s"]]
            lengths = np.array([len(h) for h in hashes])
            flat = np.concatenate(hashes).view(np.uint64)
            starts = np.cumsum(lengths) - lengths
            key = np.empty((len(pdf), bands), np.uint64)
            for i in range(bands):
                k = np.full(len(pdf), i + 1, np.uint64)
                for j in range(i * rows, (i + 1) * rows):
                    x = flat * a[j] + b[j]
                    low = np.minimum.reduceat(x ^ (x >> np.uint64(29)), starts)
                    k = (k ^ (low >> np.uint64(3))) * np.uint64(0xFF51AFD7ED558CCD)
                    k ^= k >> np.uint64(32)
                key[:, i] = k
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), bands), "band": key.ravel().view(np.int64)})

    return sets.filter(F.size("s") > 0).select("id", "s").mapInPandas(make, f"id {dict(sets.dtypes)['id']}, band long")


def band_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, batch: int | None = None) -> DataFrame:
    """(i, j): pairs of distinct texts that collide in a band; without verification, as a sequential LSH index.

    With ``batch``, only texts of the same run of so many positions collide.
    """
    return colliding_texts(distinct_texts(docs, id_col, text_col), k, threshold, batch)


def colliding_texts(texts: DataFrame, k: int = 5, threshold: float = 0.8, batch: int | None = None) -> DataFrame:
    rows = minhash_bands(shingle_sets(texts, k), *band_shape(threshold))
    rows = rows.withColumn("batch", F.floor(F.col("id") / batch) if batch else F.lit(0))
    return _self_pairs(rows, ["band", "batch"], F.lit(True))


def greedy_keep(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): what a scan in id order keeps if it drops each record that collides with a kept one.

    By rounds: a record without an undecided smaller neighbour is kept, so its larger neighbours are dropped, and
    with them their edges.  Only edges between undecided records iterate; what is never dropped is kept.
    """
    edges = materialize(edges.select("i", "j").distinct(), "edges")
    dropped = None
    while not edges.isEmpty():
        sure = edges.select(F.col("i").alias("id")).distinct().join(edges.select(F.col("j").alias("id")).distinct(), "id", "left_anti")
        gone = materialize(edges.join(sure.withColumnRenamed("id", "i"), "i", "left_semi").select(F.col("j").alias("id")).distinct(), "gone")
        rest = edges.join(gone.withColumnRenamed("id", "i"), "i", "left_anti").join(gone.withColumnRenamed("id", "j"), "j", "left_anti")
        before, edges = edges, materialize(rest.select("i", "j"), "edges")
        release(before)
        dropped = gone if dropped is None else dropped.unionByName(gone)
    return ids.select("id") if dropped is None else ids.select("id").join(dropped, "id", "left_anti")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, exact: bool = True, batch: int | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, with their normalised texts; blank texts are dropped."""
    texts = materialize(distinct_texts(docs, id_col, text_col), "texts")
    edges = similar_texts(texts, k, threshold) if exact else colliding_texts(texts, k, threshold, batch)
    kept = greedy_keep(texts.select("id"), edges)
    return texts.join(kept, "id").withColumnsRenamed({"id": id_col, "text": text_col})
