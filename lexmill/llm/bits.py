"""Sets of hashes as bit sets of a fixed size, small enough for every task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 27  #: largest set: 2^27 bits, 16 MB
_POWERS = [1 << k for k in range(63)] + [-(1 << 63)]


def bits_for(count: int) -> int:
    """About sixteen bits for each member; beyond 2^27 bits more strangers pass, and no member is lost."""
    return min(MOST, max(12, (16 * max(count, 1) - 1).bit_length()))


def bit_set(df: DataFrame, place: Column, bits: int) -> bytes:
    """The places, numbers below 2^bits, as a bit set; the driver gets at most one row for 64 places."""
    at = df.select(place.cast("long").alias("at"))
    bit = F.get(F.array(*[F.lit(p).cast("long") for p in _POWERS]), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    rows = at.select(F.shiftright("at", 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("set")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["set"].to_numpy(np.int64)
    return out.tobytes()


def may_be_in(key: str, ids: DataFrame) -> Column:
    """Whether a row's key may be among those of ids(key): true for all that are, and for about one in sixteen others."""
    bits = bits_for(ids.count())
    place = F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1))
    sent = ids.sparkSession.sparkContext.broadcast(bit_set(ids, place, bits))

    @F.pandas_udf("boolean")
    def has(at: pd.Series) -> pd.Series:
        return pd.Series(members(np.frombuffer(sent.value, np.uint8), at.to_numpy(np.int64).view(np.uint64)))

    return has(place)


def members(have: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys are in the bit set, by their lowest bits."""
    place = keys & np.uint64(8 * len(have) - 1)
    return (have[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """df without the rows whose key is among ids(key).  Only rows that the bit set lets pass are joined."""
    may = may_be_in(key, ids)
    return df.filter(~may).unionByName(df.filter(may).join(ids, key, "left_anti"))
