"""Problem 6: filling fixed-capacity sequences with texts.

A text longer than the capacity is cut to full sequences and a rest; only such texts are cut.  Rests and
whole texts are dealt by hash to cells of bounded size, and a swap-based local search packs each cell.  It begins
with a bin for each piece and increases the sum of squared fills at every step until no step is left:

1. single pieces move to other bins, the steepest increase first, which is the largest product of piece and fill;
2. the underfull bins, the emptiest first, give pieces to fuller ones: a piece moves, is exchanged for a smaller one, or
   two are exchanged for one; steps that fill a bin exactly come first, the largest gain first among them.

Emptied bins disappear.  What is underfull then is dealt to fewer cells, where step 2 goes on, until there is one
cell or a round empties no bin.  The rounds shrink quickly, because most bins of a cell are full.

Defined cases: null and blank texts have no tokens and no place, rows without an id neither; rows with the same id and size are one
text; a capacity that is null or below 1 packs nothing; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.sizes import token_sizes
from lexmill.session import materialize

CELL = 20_000  #: pieces packed together


def move_singles(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins after all moves of single pieces to other bins, the steepest increase of the squared fill first."""
    bins = [[s] for s in sizes]
    at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by fill; single pieces are among them
    singles, fills, number = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64), np.arange(capacity + 1)
    for i, s in enumerate(sizes):
        at[s].append(i)
        singles[s] += 1
        fills[s] += 1
    alone: list[list[int]] = [list(x) for x in at]
    room_of = capacity - number

    def take(stack: list[int], fill: int, single: bool) -> int:
        """A bin that still has this fill; entries of bins that have changed are stale."""
        while True:
            i = stack.pop()
            if bins[i] and (len(bins[i]) == 1 or not single) and held[i] == fill:
                return i

    held = list(sizes)
    while True:
        largest = np.maximum.accumulate(np.where(fills > 0, number, 0))  # the fullest bin of at most a fill
        partner = largest[room_of]
        # a piece that is the only bin of its fill is no partner of itself
        partner = np.where((fills == 1) & (singles == 1) & (partner == number), largest[np.maximum(number - 1, 0)], partner)
        gain = np.where(singles > 0, number * partner, 0)
        s = int(gain.argmax())
        if gain[s] == 0:
            return [b for b in bins if b]
        f = int(partner[s])
        moved = take(alone[s], s, True)
        bins[moved] = []
        singles[s] -= 1
        fills[s] -= 1
        i = take(at[f], f, False)
        fills[f] -= 1
        if len(bins[i]) == 1:
            singles[f] -= 1
        bins[i].append(s)
        held[i] = f + s
        at[f + s].append(i)
        fills[f + s] += 1


class _Exchange:
    """Exchanges between the underfull bins of a cell."""

    def __init__(self, bins: list[list[int]], capacity: int) -> None:
        self.capacity, self.bins = capacity, bins
        self.room = [capacity - sum(b) for b in bins]
        self.count = [0] * (capacity + 1)  # underfull bins by room
        self.index: dict[tuple[int, int], list[int]] = {}  # (room, piece or 0) -> bins; may be stale
        for i, r in enumerate(self.room):
            if r > 0:
                self._enter(i)

    def _enter(self, i: int) -> None:
        r = self.room[i]
        self.count[r] += 1
        for x in {0, *self.bins[i]}:
            self.index.setdefault((r, x), []).append(i)

    def _bin(self, room: int, piece: int) -> int | None:
        """An underfull bin with this room and a piece of this size (any bin, if it is 0)."""
        stack = self.index.get((room, piece))
        while stack:
            i = stack[-1]
            if self.room[i] == room and (not piece or piece in self.bins[i]):
                return i
            stack.pop()
        return None

    def _step(self, own: list[int], fill: int) -> tuple[int, int, tuple[int, ...]] | None:
        """(bin, its piece or 0, pieces for it) of the best exchange with a bin that holds ``own``."""
        rooms = [r for r in range(self.capacity, 0, -1) if self.count[r]]
        sizes = sorted(set(own), reverse=True)
        for r in rooms:
            for a in sizes:
                if a >= r and (i := self._bin(r, a - r)) is not None:
                    return i, a - r, (a,)
        twice = {a for a in sizes if own.count(a) > 1}
        pairs = {a + b: (a, b) for k, a in enumerate(sizes) for b in sizes[k:] if a != b or a in twice}
        for r in rooms:
            for total, pair in pairs.items():
                if total >= r and (i := self._bin(r, total - r)) is not None:
                    return i, total - r, pair
        # nothing fills a bin; the largest gain that makes the squared fill grow
        best, most = None, 0
        for r in rooms:
            for gain in range(r - 1, max(most, fill - self.capacity + r), -1):
                a = next((a for a in sizes if a >= gain and self._bin(r, a - gain) is not None), None)
                if a is not None:
                    best, most = (self._bin(r, a - gain), a - gain, (a,)), gain
                    break
        return best

    def _give(self, d: int) -> int:
        """Exchanges of bin d with fuller ones until there is none; the number of steps."""
        own, steps = self.bins[d], 0
        self.count[self.room[d]] -= 1
        self.room[d] = -1  # no partner of itself
        while own and (step := self._step(own, sum(own))) is not None:
            i, x, pieces = step
            for a in pieces:
                own.remove(a)
            if x:
                own.append(x)
                self.bins[i].remove(x)
            self.bins[i].extend(pieces)
            self.count[self.room[i]] -= 1
            self.room[i] -= sum(pieces) - x
            if self.room[i] > 0:
                self._enter(i)
            steps += 1
        self.room[d] = self.capacity - sum(own) if own else 0
        if own:
            self._enter(d)
        return steps

    def run(self) -> list[list[int]]:
        while True:
            order = [(-r, i) for i, r in enumerate(self.room) if r > 0]
            heapq.heapify(order)
            steps = 0
            while order:
                _, i = heapq.heappop(order)
                if self.room[i] > 0:
                    steps += self._give(i)
            if not steps:
                return [b for b in self.bins if b]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece sizes by the whole search."""
    return _Exchange(move_singles(sizes, capacity), capacity).run()


def _places(sizes: np.ndarray, bins: list[list[int]]) -> np.ndarray:
    """The bin of each piece; pieces of equal size are interchangeable."""
    flat = np.array([s for b in bins for s in b], np.int64)
    of = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    place = np.empty(len(sizes), np.int64)
    place[np.argsort(sizes, kind="stable")] = of[np.argsort(flat, kind="stable")]
    return place


def _cut(sizes: DataFrame, limits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The full sequences that long texts are cut to, and the pieces that are left, for every limit."""
    # a handful of rows, joined on a constant key so that Spark broadcasts them only below its size threshold
    each = sizes.withColumn("one", F.lit(1)).join(limits.withColumn("one", F.lit(1)), "one").drop("one")
    cut = each.withColumn("n_full", F.floor(F.col("n_tokens") / F.col("capacity"))).withColumn("rest", F.col("n_tokens") % F.col("capacity"))
    full = cut.filter("n_full > 0").select("stage", "id", "n_tokens", "capacity", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_full") - 1)).alias("piece"))
    full = full.select(
        "stage", F.concat_ws("-", F.lit("f"), "id", "n_tokens", "piece").alias("bin"), "id", "piece",
        (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").cast("long").alias("n_tokens"),
    )
    rest = cut.filter("rest > 0").select(
        "stage", "capacity", F.xxhash64("id", "n_tokens", "stage").alias("key"), "id", F.col("n_full").alias("piece"),
        (F.col("n_full") * F.col("capacity")).alias("first_token"), F.col("rest").alias("n_tokens"),
    )
    return full, rest


def packed_sequences(docs: DataFrame, limits: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, cell: int = CELL) -> DataFrame:
    """(stage, bin, id_col, piece, first_token, n_tokens): every piece's place for every row of ``limits``."""
    sizes = materialize(token_sizes(docs, id_col, text_col, vocabulary_path=vocabulary_path).filter("id is not null and n_tokens > 0").distinct(), "sizes")
    limits = limits.select("stage", F.col("max_seq_length").cast("int").alias("capacity")).filter("capacity >= 1").distinct()
    full, rest = _cut(sizes, limits)
    kind = dict(sizes.dtypes)["id"]
    names = ["stage", "capacity", "bin", "underfull", "id", "piece", "first_token", "n_tokens"]
    schema = f"stage string, capacity int, bin string, underfull boolean, id {kind}, piece long, first_token long, n_tokens long"

    def placed(pdf: pd.DataFrame, bins: list[list[int]], round_: int) -> pd.DataFrame:
        place = _places(pdf["n_tokens"].to_numpy(), bins)
        capacity, prefix = int(pdf["capacity"].iloc[0]), f"c-{round_}-{pdf['cell'].iloc[0]}-"
        open_ = np.array([sum(b) < capacity for b in bins])
        return pdf.assign(bin=[f"{prefix}{p}" for p in place], underfull=open_[place])[names]

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id", "piece"], kind="stable", ignore_index=True)
        return placed(pdf, pack(pdf["n_tokens"].tolist(), int(pdf["capacity"].iloc[0])), 0)

    def again(round_: int):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["n_tokens", "id", "piece"], kind="stable", ignore_index=True)
            bins = [g.tolist() for _, g in pdf.groupby("bin", sort=True)["n_tokens"]]
            return placed(pdf, _Exchange(bins, int(pdf["capacity"].iloc[0])).run(), round_)

        return one

    n_cells, round_ = max(1, -(-sizes.count() // cell)), 1
    parts = rest.withColumn("cell", F.pmod("key", F.lit(n_cells))).drop("key").groupBy("stage", "cell")
    packed = materialize(parts.applyInPandas(first, schema), "packed")
    done = packed.filter("not underfull")
    left = packed.filter("underfull")
    while n_cells > 1:
        state = left.groupBy("stage").agg(F.count("*").alias("pieces"), F.count_distinct("bin").alias("bins")).agg(F.max("pieces"), F.sum("bins")).first()
        n_cells = min(n_cells - 1, -(-(state[0] or 0) // cell))
        if n_cells < 1:
            break
        parts = left.withColumn("cell", F.pmod(F.xxhash64("bin"), F.lit(n_cells))).groupBy("stage", "cell")
        packed = materialize(parts.applyInPandas(again(round_), schema), "packed")
        emptied = state[1] - packed.select("stage", "bin").distinct().count()
        done, left, round_ = done.unionByName(packed.filter("not underfull")), packed.filter("underfull"), round_ + 1
        if not emptied:
            break
    return full.unionByName(done.unionByName(left).select(*full.columns)).withColumnRenamed("id", id_col)


def fill_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(stage, max_seq_length, tokens, pieces, sequences, least_sequences, fill): how full the sequences are; the search
    begins with a sequence for each piece."""
    total = packed.groupBy("stage").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"), F.count_distinct("bin").alias("sequences"))
    return total.join(limits.select("stage", F.col("max_seq_length").cast("int").alias("max_seq_length")).distinct(), "stage").select(
        "stage", "max_seq_length", "tokens", "pieces", "sequences",
        F.ceil(F.col("tokens") / F.col("max_seq_length")).alias("least_sequences"),
        F.round(F.col("tokens") / (F.col("sequences") * F.col("max_seq_length")), 6).alias("fill"),
    )
