"""Nearest neighbours and evaluation metrics on vector tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import vector as vx
from lexmill.operators.sample import numbered

QUERY_BLOCK = 4096  #: query vectors that go to every task at once


def top_k(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(q, doc, sim, rank): the k most similar docs(doc, v) of each of queries(q, v), by cosine; ties by doc.

    A stated set of queries runs against all documents in blocks of QUERY_BLOCK vectors: each task multiplies
    its documents with the block and keeps k a query, so only (partitions * k) rows a query are shuffled.
    A query that names a document (q = doc) is not its own neighbour.
    """
    kinds = (dict(queries.dtypes)["q"], dict(docs.dtypes)["doc"])
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    parts = None
    for b in range(n_blocks):
        rows = queries.filter(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == b).select("q", "v").collect()
        if not rows:
            continue
        ids = [r.q for r in rows]
        shared = queries.sparkSession.sparkContext.broadcast((ids, _unit(np.array([r.v for r in rows], float))))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            best: list[tuple[np.ndarray, np.ndarray]] | None = None
            for pdf in batches:
                if not len(pdf):
                    continue
                docs_ = pdf["doc"].to_numpy()
                sims = q @ _unit(np.stack([np.asarray(v, float) for v in pdf["v"]])).T
                merged = []
                for i, qid in enumerate(ids):
                    s, d = sims[i], docs_
                    keep = d != qid
                    s, d = s[keep], d[keep]
                    if best is not None:
                        s, d = np.concatenate([best[i][0], s]), np.concatenate([best[i][1], d])
                    order = np.lexsort((d, -s))[:k]
                    merged.append((s[order], d[order]))
                best = merged
            if best is not None:
                yield pd.DataFrame({"q": np.repeat(ids, [len(s) for s, _ in best]), "doc": np.concatenate([d for _, d in best]), "sim": np.concatenate([s for s, _ in best])})

        part = docs.select("doc", "v").mapInPandas(search, f"q {kinds[0]}, doc {kinds[1]}, sim double")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return docs.sparkSession.createDataFrame([], f"q {kinds[0]}, doc {kinds[1]}, sim double, rank int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "doc"))
    return parts.withColumn("rank", rank).filter(F.col("rank") <= k)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def positive_ranks(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(q, rank) of queries(q, v, positive): the positive's place among the k nearest docs, null if it isn't there."""
    near = top_k(queries, docs, k)
    hit = near.join(queries.select("q", "positive"), "q").filter("doc = positive").select("q", "rank")
    return queries.select("q").join(hit, "q", "left")


def recall_mrr(ranks: DataFrame, k: int, branch: str = "a") -> DataFrame:
    """(branch, metric, value): Recall@k and MRR@k of ranks(q, rank); no rows without queries."""
    r = F.when(F.col("rank") <= k, F.col("rank"))
    agg = ranks.agg(F.count("*").alias("n"), F.avg(F.when(r.isNotNull(), 1.0).otherwise(0.0)).alias("recall"), F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"))
    both = F.array(F.struct(F.lit(f"retrieval_recall@{k}").alias("metric"), F.col("recall").alias("value")), F.struct(F.lit(f"retrieval_mrr@{k}").alias("metric"), F.col("mrr").alias("value")))
    return agg.filter("n > 0").select(F.lit(branch).alias("branch"), F.explode(both).alias("m")).select("branch", "m.metric", "m.value")


def average_ranks(values: DataFrame, column: str) -> DataFrame:
    """(column, avg_rank): average rank of each distinct value, from counts by value; no global window over rows."""
    counts = values.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    placed = numbered(counts, column)
    # running sums in range partitions would need the same trick once more; counts of distinct values are small
    # beside the rows, and numbered() has already put them in order
    block = F.floor(F.col("idx") / 10_000)
    blocks = placed.withColumn("block", block)
    sums = blocks.groupBy("block").agg(F.sum("n").alias("s"))
    before = sums.select("block", F.coalesce(F.sum("s").over(Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.col("before") + F.col("inner") + (F.col("n") + 1) / 2
    return blocks.withColumn("inner", inner).join(before, "block").select(column, rank.alias("avg_rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, rho): rank correlation with average ranks for ties; null values are left out."""
    own = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    rx = average_ranks(own, "x").withColumnRenamed("avg_rank", "rx")
    ry = average_ranks(own, "y").withColumnRenamed("avg_rank", "ry")
    # one row for each pair of values
    pairs = own.groupBy("x", "y").agg(F.count("*").alias("w")).join(rx, "x").join(ry, "y")
    w, a, b = F.col("w"), F.col("rx"), F.col("ry")
    s = pairs.agg(F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"), F.sum(w * a * b).alias("sab"))
    n = F.col("n")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    var = F.sqrt((F.col("saa") - F.col("sa") * F.col("sa") / n) * (F.col("sbb") - F.col("sb") * F.col("sb") / n))
    return s.filter("n > 0").select(n.alias("n"), F.try_divide(cov, var).alias("rho"))


def skew_check(expected: DataFrame, actual: DataFrame, atol: float = 1e-4, rtol: float = 1e-5) -> DataFrame:
    """(rows, max_diff, match) of two tables (key, v): largest difference, and whether all are within
    atol + rtol * |actual|; rows that only one side has don't match."""
    both = expected.select("key", F.col("v").alias("e")).join(actual.select("key", F.col("v").alias("a")), "key", "full_outer")
    ok = F.col("e").isNotNull() & F.col("a").isNotNull() & (F.size("e") == F.size("a"))
    diffs = F.zip_with("e", "a", lambda e, a: F.struct(F.abs(e - a).cast("double").alias("d"), (F.abs(e - a) <= atol + rtol * F.abs(a)).alias("ok")))
    each = both.select(ok.alias("ok"), F.when(ok, diffs).alias("ds"))
    largest = F.aggregate("ds", F.lit(0.0), lambda s, x: F.greatest(s, x["d"]))
    return each.select("ok", largest.alias("m"), F.forall("ds", lambda x: x["ok"]).alias("close")).agg(
        F.count("*").alias("rows"), F.max("m").alias("max_diff"), F.bool_and(F.col("ok") & F.coalesce("close", F.lit(False))).alias("match")
    )


def unit_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return df.select(F.col(key).alias("key"), vx.unit(vector).alias("v"))
