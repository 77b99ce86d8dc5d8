"""TF-IDF in long form and latent semantic analysis.

Weights: raw term counts, idf = ln((1 + n) / (1 + df)) + 1, rows of length 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import sample
from lexmill.session import materialize


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, term, tf)."""
    return docs.select(id_col, F.explode(tx.terms(text_col)).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    """(term, df) of term counts (one row for each document and term)."""
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, term, weight); the number of documents counts those without terms too."""
    counts = materialize(term_counts(docs, id_col, text_col), "counts")
    n = docs.agg(F.count("*").alias("n_docs"))
    idf = document_frequencies(counts).crossJoin(F.broadcast(n)).select("term", (F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counts.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = raw.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(length, id_col).select(id_col, "term", (F.col("w") / F.col("length")).alias("weight"))


def pair_cosines(weighted: DataFrame, pairs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(i, j, cosine) for pairs(i, j) of document ids; 0 where they share no term."""
    wi = weighted.select(F.col(id_col).alias("i"), "term", F.col("weight").alias("wi"))
    wj = weighted.select(F.col(id_col).alias("j"), "term", F.col("weight").alias("wj"))
    hit = pairs.select("i", "j").join(wi, "i").join(wj, ["j", "term"]).groupBy("i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("c"))
    return pairs.select("i", "j").join(hit, ["i", "j"], "left").select("i", "j", F.coalesce("c", F.lit(0.0)).alias("cosine"))


def components(wanted: int, n_features: int, n_docs: int) -> int:
    """How many components a decomposition can have; below 1 there is none."""
    return min(wanted, n_features - 1, n_docs - 1)


class LatentSpace:
    """Truncated SVD of TF-IDF by a randomised range finder.

    Weights and document frequencies are exact, by term.  Terms are then hashed with signs to ``features`` columns, so that the
    model has a fixed size whatever the vocabulary: products of documents keep their expectation, with an error of
    about 1 / sqrt(features).  Every pass over the documents returns features x (k + extra) partial sums, which Spark adds up.
    """

    def __init__(self, docs: DataFrame, k: int = 100, features: int = 1 << 14, extra: int = 16, power: int = 1, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.features, self.id_col = features, id_col
        weighted = materialize(weights(docs, id_col, text_col), "weights")
        key = F.xxhash64("term")
        place, sign = F.pmod(F.shiftright(key, 1), F.lit(features)).cast("int"), F.when(key.bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)
        sums = weighted.select(id_col, place.alias("x"), (sign * F.col("weight")).alias("w")).groupBy(id_col, "x").agg(F.sum("w").alias("w"))
        rows = sums.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("x", "w"))).alias("r"))  # at most ``features`` entries
        self.rows = materialize(rows.select(id_col, F.transform("r", lambda e: e["x"]).alias("x"), F.transform("r", lambda e: e["w"]).alias("w")), "rows")
        self.k = components(k, weighted.select("term").distinct().count(), docs.count())
        self.vectors = self._fit(extra, power, seed) if self.k >= 1 else np.zeros((features, 0))

    def _product(self, q: np.ndarray) -> np.ndarray:
        """A' A q, summed over all documents."""
        shared = self.rows.sparkSession.sparkContext.broadcast(q)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q = shared.value
            total, seen = np.zeros_like(q), False
            for x, w, starts in _blocks(batches):
                y = np.add.reduceat(w[:, None] * q[x], starts)
                row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
                order = np.argsort(x, kind="stable")
                used = x[order]
                first = np.flatnonzero(np.diff(used, prepend=-1))
                total[used[first]] += np.add.reduceat((w[:, None] * y[row])[order], first)
                seen = True
            if seen:
                used = np.flatnonzero(np.abs(total).sum(axis=1) > 0)
                yield pd.DataFrame({"x": used, "v": list(total[used])})

        width = q.shape[1]
        sums = self.rows.select("x", "w").mapInPandas(part, "x int, v array<double>")
        sums = sums.groupBy("x").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(width)]).alias("v"))
        out = np.zeros_like(q)
        for r in sums.toLocalIterator():  # at most ``features`` rows
            out[r.x] = r.v
        return out

    def _fit(self, extra: int, power: int, seed: int) -> np.ndarray:
        width = min(self.k + extra, self.features)
        q = np.random.default_rng(seed).standard_normal((self.features, width))
        for _ in range(1 + power):
            q = np.linalg.qr(self._product(q))[0]
        _, u = np.linalg.eigh(q.T @ self._product(q))
        return q @ u[:, ::-1][:, : self.k]

    def encode(self) -> DataFrame:
        """(id_col, v): document vectors of length 1 in the latent space."""
        shared, id_col = self.rows.sparkSession.sparkContext.broadcast(self.vectors), self.id_col

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            vectors = shared.value
            for pdf in batches:
                ids, at = pdf[id_col].to_numpy(), 0
                for x, w, starts in _blocks([pdf]):
                    v = np.add.reduceat(w[:, None] * vectors[x], starts)
                    n = np.linalg.norm(v, axis=1, keepdims=True)
                    yield pd.DataFrame({id_col: ids[at : at + len(starts)], "v": list(np.divide(v, n, out=np.zeros_like(v), where=n > 0))})
                    at += len(starts)

        return self.rows.mapInPandas(run, f"{id_col} {dict(self.rows.dtypes)[id_col]}, v array<double>")


def _blocks(batches: Iterator[pd.DataFrame] | list[pd.DataFrame], size: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(columns, weights, first entry of each row) of rows (x, w), about ``size`` entries at a time; no row is empty."""
    for pdf in batches:
        lengths = pdf["x"].map(len).to_numpy()
        group = np.cumsum(lengths) // size
        for g in np.unique(group):
            part = pdf[group == g]
            own = lengths[group == g]
            yield np.concatenate(part["x"].to_list()).astype(np.int64), np.concatenate(part["w"].to_list()), np.cumsum(own) - own


def lsa_scored_pairs(docs: DataFrame, n: int, k: int = 100, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", features: int = 1 << 14) -> DataFrame:
    """(pair, i, j, score): n random pairs of documents, scored 0 to 5 by their latent cosine; none if the texts
    are too few or too alike for a single component."""
    space = LatentSpace(docs, k, seed=seed, id_col=id_col, text_col=text_col, features=features)
    if space.k < 1:
        return docs.sparkSession.createDataFrame([], "pair long, i long, j long, score double")
    encoded = materialize(space.encode(), "encoded")
    ids = sample.numbered(docs.select(F.col(id_col).alias("own")), "own")
    size = docs.agg(F.count("*").alias("n_rows"))
    pairs = sample.random_index_pairs(size, n, F.col("n_rows"), seed)
    named = pairs.join(ids.select(F.col("idx").alias("i"), F.col("own").alias("di")), "i").join(ids.select(F.col("idx").alias("j"), F.col("own").alias("dj")), "j")
    a = encoded.select(F.col(id_col).alias("di"), F.col("v").alias("va"))
    b = encoded.select(F.col(id_col).alias("dj"), F.col("v").alias("vb"))
    both = named.join(a, "di", "left").join(b, "dj", "left")
    cosine = F.coalesce(F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
    score = F.greatest(F.least(cosine, F.lit(1.0)), F.lit(0.0)) * 5
    return both.select("pair", F.col("di").alias("i"), F.col("dj").alias("j"), score.alias("score"))
