"""Problem 8: long exact spans shared between records.

Two passes over the texts with a count-min sketch between them.

* A text's windows of K characters are hashed, and of any W = span - K + 1 neighbouring windows the smallest
  is selected (winnowing).  The choice depends on the characters alone, so two copies of a span hold the
  same selected window at the same place: no shared span is lost.
* Pass 1: every partition counts its selected windows in a sketch; the sketches are summed.  The sums only
  overestimate.
* Pass 2: windows estimated to occur once are dropped; the rest is grouped exactly.  Occurrences whose
  whole surroundings are equal (every span through the window) are settled by one group-by.  For the others
  every span of full length through the window is hashed to 128 bits, sketched and grouped in the same way.

No pairs are made, and no group is collected: a group of any size is only counted.

Defined cases: null, empty and short texts share nothing; a span repeated inside one record only doesn't
count; rows with the same id are one record, rows without an id are left out; other columns are ignored; an empty table gives no rows; long
texts are hashed whole, in overlapping pieces.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import materialize

SPAN = 160  #: shortest shared span that is reported, in characters
W = 64  #: one window of so many neighbours is selected
K = SPAN - W + 1
SIDE = W - 1  #: a span through a window reaches at most so far beyond it
PIECE = 1 << 19  #: characters hashed at once
ROWS = 3  #: hash functions of the sketch
CHUNK = 1 << 16  #: cells of the sketch that travel together
SALTS = 64  #: groups in which the partitions' chunks are summed first
MAX_BITS = 26  #: largest sketch: 2^26 cells a row, 24 MB when broadcast; past it more windows pass, none is lost

_B = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xFF51AFD7ED558CCD))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    n = PIECE + 2 * SPAN
    base = _B[which] | np.uint64(1)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = base, inverse
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class _Hashed:
    """Prefix sums of a polynomial hash over code points: the hash of any stretch in O(1)."""

    def __init__(self, points: np.ndarray, which: int) -> None:
        up, self.down = _powers(which)
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(_mix(points.astype(np.uint64) + _B[which]) * up[: len(points)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def _pieces(texts: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of many texts, or of a part of a long one, with (row, offset in the text, start, end) of each part."""
    parts: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def packed() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(p[2]) for p in parts])
        ends = np.cumsum(lengths)
        return np.concatenate([p[2] for p in parts]), np.array([(p[0], p[1]) for p in parts]), ends - lengths, ends

    for row, text in enumerate(texts):
        if not isinstance(text, str) or len(text) < SPAN:
            continue
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = 0
        while True:
            part = points[at : at + PIECE]
            if parts and size + len(part) > PIECE:
                yield packed()
                parts, size = [], 0
            parts.append((row, at, part))
            size += len(part)
            if at + PIECE >= len(points):
                break
            at += PIECE - 2 * SPAN
    if parts:
        yield packed()


def _slide(x: np.ndarray, best: np.ufunc) -> np.ndarray:
    """best over x[i : i + W]; W is a power of two."""
    step = 1
    while step < W:
        x = best(x[:-step], x[step:])
        step *= 2
    return x


def _anchors(texts: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, _Hashed, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, position in text, hasher, index, start and end of the part, code points) of the selected windows."""
    for points, places, starts, ends in _pieces(texts):
        hashed = _Hashed(points, 0)
        n = len(points) - K + 1
        index = np.arange(n)
        value = hashed.of(index, index + K)
        part = np.repeat(np.arange(len(starts)), ends - starts)[:n]
        outside = index + K > ends[part]
        # ordered by hash, the last of equal ones first
        key = (value & ~np.uint64((1 << 21) - 1)) | (np.uint64((1 << 21) - 1) - index.astype(np.uint64))
        key[outside] = np.uint64(2**64 - 1)
        low = _slide(key, np.minimum)
        high = _slide(np.concatenate([np.zeros(W - 1, np.uint64), low, np.zeros(W - 1, np.uint64)]), np.maximum)
        chosen = np.flatnonzero((high[:n] == key) & ~outside)
        p = part[chosen]
        yield places[p, 0], places[p, 1] + chosen - starts[p], hashed, chosen, starts[p], ends[p], points


def _cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(_mix(h ^ _MIX[r]) >> np.uint64(64 - bits)).astype(np.int64) for r in range(ROWS)]


def _hash_sketch(batches: Iterator[np.ndarray], bits: int) -> Iterator[pd.DataFrame]:
    """A partition's sketch in compressed chunks; counters stop at 2."""
    counts = np.zeros((ROWS, 1 << bits), np.uint8)
    any_ = False
    for h in batches:
        for r, cells in enumerate(_cells(h, bits)):
            cell, n = np.unique(cells, return_counts=True)
            counts[r, cell] = np.minimum(counts[r, cell] + np.minimum(n, 2), 2)
            any_ |= len(cell) > 0
    if any_:
        for r in range(ROWS):
            for c in range(max(1, (1 << bits) // CHUNK)):
                chunk = counts[r, c * CHUNK : (c + 1) * CHUNK]
                if chunk.any():
                    # the salt is the same when the task runs again, so that no chunk is lost or counted twice
                    yield pd.DataFrame({"r": [r], "c": [c], "salt": [_task() % SALTS], "data": [zlib.compress(chunk.tobytes(), 1)]})


def _task() -> int:
    context = TaskContext.get()
    return context.partitionId() if context is not None else 0


def _sum_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
    total = None
    for data in pdf["data"]:
        chunk = np.frombuffer(zlib.decompress(data), np.uint8)
        total = chunk.copy() if total is None else np.minimum(total + chunk, 2)
    return pd.DataFrame({"r": pdf["r"].iloc[:1], "c": pdf["c"].iloc[:1], "data": [zlib.compress(total.tobytes(), 1)]})


def _twice(pdf: pd.DataFrame) -> pd.DataFrame:
    """The summed chunk as one bit a cell: counted at least twice."""
    total = np.frombuffer(zlib.decompress(_sum_chunks(pdf)["data"].iat[0]), np.uint8)
    return pd.DataFrame({"r": pdf["r"].iloc[:1], "c": pdf["c"].iloc[:1], "data": [zlib.compress(np.packbits(total >= 2).tobytes(), 1)]})


def merged_sketch(parts: DataFrame, bits: int) -> np.ndarray:
    """Sum of all partitions' sketches as one bit a cell: counted at least twice.  Its size is 3 * 2^bits bits."""
    once = parts.groupBy("r", "c", "salt").applyInPandas(_sum_chunks, "r int, c int, data binary")
    both = once.groupBy("r", "c").applyInPandas(_twice, "r int, c int, data binary")  # at most SALTS rows a group
    out = np.zeros((ROWS, (1 << bits) // 8), np.uint8)
    for row in both.toLocalIterator():
        out[row.r, row.c * CHUNK // 8 : (row.c + 1) * CHUNK // 8] = np.frombuffer(zlib.decompress(row.data), np.uint8)
    return out


def _repeated(h: np.ndarray, sketch: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes the merged sketch estimates to occur at least twice."""
    keep = np.ones(len(h), bool)
    for r, cell in enumerate(_cells(h, bits)):
        keep &= (sketch[r, cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return keep


def _bits(count: int) -> int:
    """Cells a row: at least four for each window, so that some 1 % of the single ones pass."""
    return min(MAX_BITS, max(12, int(4 * max(count, 1) - 1).bit_length()))


_ID = "id"


def repeated_windows(docs: DataFrame, bits: int) -> DataFrame:
    """(h, id, at, left, right, c1, c2): selected windows estimated to occur twice, with the hash of the
    surroundings [left, right)."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _hash_sketch((a[2].of(a[3], a[3] + K) for pdf in batches for a in _anchors(pdf["text"])), bits)

    merged = docs.sparkSession.sparkContext.broadcast(merged_sketch(docs.select("text").mapInPandas(sketch, "r int, c int, salt int, data binary"), bits))

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf[_ID].to_numpy()
            for row, at, hashed, index, start, end, points in _anchors(pdf["text"]):
                h = hashed.of(index, index + K)
                keep = _repeated(h, merged.value, bits)
                if not keep.any():
                    continue
                row, at, index, start, end, h = (x[keep] for x in (row, at, index, start, end, h))
                left, right = np.maximum(index - SIDE, start), np.minimum(index + K + SIDE, end)
                other = _Hashed(points, 1)
                yield pd.DataFrame(
                    {
                        "h": h.view(np.int64), "id": ids[row], "at": at.astype(np.int32),
                        "left": (at - index + left).astype(np.int32), "right": (at - index + right).astype(np.int32),
                        "c1": (hashed.of(left, right) + (index - left).astype(np.uint64)).view(np.int64), "c2": other.of(left, right).view(np.int64),
                    }
                )

    kind = dict(docs.dtypes)[_ID]
    return docs.select(_ID, "text").mapInPandas(second, f"h long, id {kind}, at int, left int, right int, c1 long, c2 long")


def _full_spans(todo: DataFrame, bits: int) -> DataFrame:
    """(s1, s2, id, at): spans of SPAN characters estimated to occur twice, of todo(id, text, ats, partner)."""

    def spans(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for i, (text, ats) in enumerate(zip(pdf["text"], pdf["ats"], strict=True)):
            ats = np.unique(np.asarray(ats, np.int64))
            n = len(text)
            first = np.unique((ats[:, None] - np.arange(W)[None, :]).ravel())
            first = first[(first >= 0) & (first + SPAN <= n)]
            block = PIECE - 2 * SPAN
            for b in np.unique(first // block):
                own = first[first // block == b] - b * block
                points = np.frombuffer(text[b * block : b * block + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
                s1, s2 = (_Hashed(points, w).of(own, own + SPAN) for w in (0, 1))
                yield s1, s2, np.full(len(own), i), own + b * block, own

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _hash_sketch((s[0] for pdf in batches for s in spans(pdf)), bits)

    merged = todo.sparkSession.sparkContext.broadcast(merged_sketch(todo.mapInPandas(sketch, "r int, c int, salt int, data binary"), bits))

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            out = []
            for s1, s2, i, at, _ in spans(pdf):
                keep = _repeated(s1, merged.value, bits)
                out.append((s1[keep], s2[keep], ids[i[keep]], at[keep]))
            if out:
                s1, s2, id_, at = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pd.DataFrame({"s1": s1.view(np.int64), "s2": s2.view(np.int64), "id": id_, "at": at.astype(np.int32)})

    return todo.mapInPandas(second, f"s1 long, s2 long, id {dict(todo.dtypes)['id']}, at int")


def shared_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, left, right): stretches of at least SPAN characters that also stand in another record.

    Stretches overlap; their union is exactly what is shared in spans of that length.
    """
    docs = docs.select(F.col(id_col).alias(_ID), F.col(text_col).alias("text")).filter((F.char_length("text") >= SPAN) & F.col(_ID).isNotNull())
    chars = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    found = materialize(repeated_windows(docs, _bits(chars * 2 // (W + 1))), "windows")
    two = lambda c: F.min(c) != F.max(c)
    settled = found.groupBy("h", "c1", "c2").agg(two("id").alias("multi"), F.min("id").alias("one"), F.max("id").alias("two"))
    groups = settled.groupBy("h").agg((F.count_if("multi") > 0).alias("any"), F.count("*").alias("kinds"), two("one").alias("several"))
    # groups with different surroundings: those of one record only must be looked at, and of those that two
    # or more records have, two records stand for all
    open_ = settled.join(groups.filter("kinds > 1 and (any or several)").select("h"), "h")
    member = found.join(settled.filter("multi").select("h", "c1", "c2"), ["h", "c1", "c2"], "left_semi").select("id", "left", "right")
    todo = found.join(open_, ["h", "c1", "c2"]).filter("not multi or id = one or id = two").groupBy("id").agg(F.collect_set("at").alias("ats"))
    todo = materialize(todo.join(docs, "id"), "open")
    spans = todo.agg(F.sum(F.size("ats"))).first()[0] or 0
    full = _full_spans(todo, _bits(spans * W))
    shared = full.groupBy("s1", "s2").agg(two("id").alias("multi")).filter("multi")
    edge = full.join(shared, ["s1", "s2"], "left_semi").select("id", F.col("at").alias("left"), (F.col("at") + SPAN).alias("right"))
    return member.unionByName(edge)


def shared_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col): records that share a span of at least SPAN characters with another record."""
    return shared_parts(docs, id_col, text_col).select(F.col("id").alias(id_col)).distinct()


def shared_amounts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, shared_chars, shared_share, n_spans): how much of each record also stands elsewhere."""
    parts = shared_parts(docs, id_col, text_col).distinct()
    order = Window.partitionBy("id").orderBy("left", "right")
    reach = F.max("right").over(order.rowsBetween(Window.unboundedPreceding, -1))
    union = parts.select("id", "left", "right", reach.alias("reach"))
    per = union.groupBy("id").agg(
        F.sum(F.greatest(F.col("right") - F.greatest("left", F.coalesce("reach", F.lit(0))), F.lit(0))).cast("long").alias("shared_chars"),
        F.count_if(F.col("reach").isNull() | (F.col("left") > F.col("reach"))).alias("n_spans"),
    )
    size = docs.select(F.col(id_col).alias("id"), F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("n_chars"))
    out = size.join(per, "id", "left")
    shared = F.coalesce("shared_chars", F.lit(0).cast("long"))
    return out.select(
        F.col("id").alias(id_col), "n_chars", shared.alias("shared_chars"),
        F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).otherwise(0.0).alias("shared_share"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
    )
