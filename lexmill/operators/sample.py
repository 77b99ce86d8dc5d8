"""Deterministic sampling, shuffling and pairing by hashed keys.

A sample is the k rows with the smallest hash of seed and key: uniform, mergeable, independent of partitions,
and the same in any engine with SHA-1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import materialize


def salted(seed: int | str, *key: Column | str) -> Column:
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key]))


def hash_number(seed: int | str, *key: Column | str) -> Column:
    """A uniform 48-bit number."""
    return F.conv(F.substring(salted(seed, *key), 1, 12), 16, 10).cast("long")


IN_ONE_TASK = 100_000  #: sample rows that may end in one task


def sample_rows(df: DataFrame, k: int, seed: int | str, *key: str) -> DataFrame:
    """k rows without replacement; all rows if there are no more.

    A large sample is cut by a quantile of the hash first and then numbered in its order, in many tasks; the rows are
    the same.
    """
    order = salted(seed, *key)
    if k <= IN_ONE_TASK:
        return df.orderBy(order, *key).limit(k)
    rows = df.count()
    if rows <= k:
        return df
    share = min(1.0, (k + 10 * k**0.5) / rows)
    keyed = df.withColumn("_order", order)
    some = keyed.filter(hash_number(seed, *key) < int(share * 2**48))
    placed = numbered(some if some.count() >= k else keyed, "_order", *key)
    return placed.filter(F.col("idx") < k).drop("idx", "_order")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``idx``, the place in the order from 0: a range-partitioned sort whose partitions' counts are summed.

    The partitions are written, because their borders come from a sample that differs from run to run.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "parts")
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("inside", inside).join(offsets, "part").withColumn("idx", F.col("inside") - 1 + F.col("before")).drop("part", "inside", "before")


def random_index_pairs(df: DataFrame, n_pairs: int, n_rows: Column, seed: int | str) -> DataFrame:
    """(pair, i, j): pairs of different places below n_rows, uniform over ordered pairs; df is a one-row frame with n_rows."""
    pairs = df.sparkSession.range(n_pairs).withColumnRenamed("id", "pair")
    i = F.pmod(hash_number(f"{seed}i", "pair"), n_rows)
    shift = F.pmod(hash_number(f"{seed}j", "pair"), n_rows - 1)
    one = df.filter(n_rows > 1)
    return pairs.crossJoin(F.broadcast(one)).select("pair", i.alias("i"), F.pmod(i + 1 + shift, n_rows).alias("j"))


def random_pairs(texts: DataFrame, n_pairs: int, seed: int | str, *order: str) -> DataFrame:
    """(pair, a, b): random pairs of different rows of texts(text, order...)."""
    indexed = numbered(texts, *order).select("idx", "text")
    size = texts.agg(F.count("*").alias("n_rows"))
    pairs = random_index_pairs(size, n_pairs, F.col("n_rows"), seed)
    a, b = indexed.select(F.col("idx").alias("i"), F.col("text").alias("a")), indexed.select(F.col("idx").alias("j"), F.col("text").alias("b"))
    return pairs.join(a, "i").join(b, "j").select("pair", "a", "b")


def zipped(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Both sides side by side by their places in the order; the longer side is cut.  The sides share no column."""
    return numbered(left, *left_order).join(numbered(right, *right_order), "idx").drop("idx")
