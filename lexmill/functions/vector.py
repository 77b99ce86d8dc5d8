"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import let


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def unit(a: Column | str) -> Column:
    """The vector divided by its length; a zero vector stays."""
    return let(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)))


def clamp01(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def uncertainty(cosine_: Column) -> Column:
    """1 at a cosine of 0.5, falling to 0 at 0 and 1."""
    return clamp01(1 - F.abs(cosine_ - 0.5) / 0.5)


def jsonl_bytes(df: DataFrame, vector: str = "embedding", per_number: int = 18) -> DataFrame:
    """(rows, dim, bytes): estimated size of the vectors as JSON lines."""
    return df.agg(F.count("*").alias("rows"), F.max(F.size(vector)).cast("long").alias("dim")).select("rows", "dim", (F.col("rows") * F.col("dim") * per_number).alias("bytes"))


def last_token_index(df: DataFrame, mask: str = "mask") -> DataFrame:
    """Adds ``last``: if every row of the table ends with 1 (left-padded), the last position, else sum - 1."""
    table = df.agg(F.bool_and(F.element_at(mask, -1) == 1).alias("_padded_left"))  # one row
    total = F.aggregate(mask, F.lit(0), lambda s, x: s + x)
    last = F.when(F.col("_padded_left"), F.size(mask) - 1).otherwise(total - 1)
    return df.crossJoin(F.broadcast(table)).withColumn("last", last).drop("_padded_left")
