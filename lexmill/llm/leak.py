"""Problem 5: evaluation texts leaking into training text.

Latent semantic retrieval.  One pass over the corpus cuts every text to passages: for exact copies all
stretches of at least ``window`` words in a row that stand in the test vocabulary (a copy has no other words, so
none is lost), for paraphrases the union of all windows of a sentence's length with as many known words as
the common subsequence needs, whatever stands between them (unknown words have no weight and equal nothing).
Word weights (TF-IDF) are counted over all passages, in pieces of ``PIECE`` words; a randomised SVD of these
rows is computed by partial products in the partitions.  A window's latent vector is a difference of running
sums, so every window has one.  Candidates are the windows with a rare word of the sentence whose cosine with it
is high enough; they are checked word for word, or, for paraphrases, by the longest common subsequence and
the sentence's telling words.

Nothing depends on the number of test rows: words are named by 64-bit hashes, the vocabulary is a bit set
of fixed size, the latent space has at most ``COLUMNS`` columns (words that share one share a weight, never
an identity), and the sentences go to the tasks in blocks of about ``BLOCK`` words, against passages that are
written once.  The result is the same for any block size.

Words are compared in the consistent form of :mod:`lookalike`, lower-cased, without punctuation; a word
split by a hyphen at a line end is joined.

Defined cases: null and empty texts contain nothing; a test sentence of fewer than ``window`` words has no exact
passage, but the report compares it too; a test sentence of more than ``LONGEST`` words is reported by the best of its
pieces of so many words, which overlap by half; rows without an id are left out; repeated rows give one result
row; other columns are ignored; an empty table on either side gives no rows; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.bits import bit_set
from lexmill.llm.lookalike import fold_text
from lexmill.session import materialize

WINDOW = 8  #: words in a row that make a leak
RANK = 48  #: dimensions of the latent space
OVERSAMPLE = 16
POWER = 1  #: power iterations of the range finder
PIECE = 32  #: words of a row of the TF-IDF matrix
COSINE = 0.95  #: least cosine of a candidate for an exact copy
NEAR = 0.7  #: least cosine of a candidate for a paraphrase
COMMON = 0.75  #: least share of a sentence's words in the common subsequence of a paraphrase
TELLING = 3  #: rarest words of a sentence; a paraphrase keeps all of them but one
LONGEST = 64  #: words of a test sentence that are compared at once
BLOCK = 100_000  #: words of test sentences searched at once
BITS = 24  #: the test vocabulary as a set of 2^24 bits
COLUMNS = 1 << 17  #: most columns of the latent space
LOAD = 1 << 15  #: words of passages whose running sums are held at once
CHUNK = 1 << 15  #: windows compared at once
_CACHE = 1 << 20

_BREAK = re.compile("[-‐‑­]\\s*[\r\n  ]\\s*")
_JOINT = re.compile("[-'’`‑]")


def words_of(text: str) -> list[str]:
    """The words of a text that count."""
    folded = _JOINT.sub("", fold_text(_BREAK.sub("", text)).lower())
    return "".join(c if c.isalnum() or unicodedata.category(c)[0] == "M" else " " for c in folded).split()


def word_id(word: str) -> int:
    """A positive 63-bit name of the word, the same in every process."""
    return (int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1) or 1


class _Ids(dict):
    """Token as it stands in a text -> names of its words, 0 for those outside the vocabulary."""

    def __init__(self, bits: bytes) -> None:
        super().__init__()
        self.bits = bits

    def _known(self, word: str) -> int:
        w = word_id(word)
        at = w & ((1 << BITS) - 1)
        return w if self.bits[at >> 3] >> (at & 7) & 1 else 0

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = tuple(map(self._known, words_of(token)))
        if len(self) < _CACHE:
            self[token] = ids
        return ids


def _runs(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches of at least so many known words in a row."""
    edges = np.diff(np.concatenate([[0], (ids != 0).view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def _least_common(n: int, common: float) -> int:
    """Words that a window must share with a sentence of n words to reach the share ``common``, at least one."""
    return next((k for k in range(1, n + 1) if k / n >= common), n + 1)


def _covered(ids: np.ndarray, least: dict[int, int], run: int) -> list[tuple[int, int]]:
    """Stretches of windows of n words with at least least[n] known words, and of ``run`` known words in a row;
    a text shorter than n is one window."""
    known = np.concatenate([[0], np.cumsum(ids != 0)])
    if known[-1] < min(run, *least.values()):
        return []
    edges = np.zeros(len(ids) + 1, np.int64)
    for n, need in least.items():
        w = min(n, len(ids))
        at = np.flatnonzero(known[w:] - known[:-w] >= need)
        edges[at] += 1
        edges[at + w] -= 1
    for a, b in _runs(ids, run):
        edges[a] += 1
        edges[b] -= 1
    return _runs(np.cumsum(edges[:-1]) > 0, 1)


def passages(docs: DataFrame, bits: bytes, stretches: Callable[[np.ndarray], list[tuple[int, int]]]) -> DataFrame:
    """(id, ids): the passages of all texts as words' names, unknown words as 0."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Ids(shared.value)
        for pdf in batches:
            out: list[tuple] = []
            for id_, text in zip(pdf["id"], pdf["text"], strict=True):
                if not text:
                    continue
                tokens = (_BREAK.sub("", text) if "\n" in text or "\r" in text else text).split()
                ids = np.fromiter(chain.from_iterable(map(known.__getitem__, tokens)), np.int64)
                out += [(id_, ids[a:b]) for a, b in stretches(ids)]
            yield pd.DataFrame(out, columns=["id", "ids"])

    return docs.mapInPandas(cut, f"id {dict(docs.dtypes)['id']}, ids array<long>")


def test_sentences(tests: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(test, side, ids): the words of all test sentences, in pieces of at most LONGEST words."""
    named = tests.select(F.col(id_col).alias("test"), *[F.col(f).alias(f"s{i}") for i, f in enumerate(fields)]).filter("test is not null")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for side in range(len(fields)):
                for t, text in zip(pdf["test"], pdf[f"s{side}"], strict=True):
                    ids = [word_id(w) for w in words_of(text)] if text else []
                    last = max(0, len(ids) - LONGEST)
                    out += [(t, side, ids[a : a + LONGEST]) for a in sorted({*range(0, last, LONGEST // 2), last}) if ids]
            yield pd.DataFrame(out, columns=["test", "side", "ids"])

    return named.distinct().mapInPandas(split, f"test {dict(named.dtypes)['test']}, side int, ids array<long>")


def vocabulary_bits(sentences: DataFrame) -> bytes:
    return bit_set(sentences.select(F.explode("ids").alias("w")), F.col("w").bitwiseAND(F.lit((1 << BITS) - 1)), BITS)


def _column(ids: np.ndarray) -> np.ndarray:
    return (ids >> BITS) & (COLUMNS - 1)


def _rows(pdf: pd.DataFrame, places: np.ndarray, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row, column, count, rows) of the TF-IDF matrix's rows; ``places`` numbers the columns in use, others are -1."""
    for i in range(0, len(pdf), step):
        part = [np.asarray(x, np.int64) for x in pdf["ids"].iloc[i : i + step]]
        row, before = [], 0
        for ids in part:
            row.append(before + np.arange(len(ids)) // PIECE)
            before += -(-len(ids) // PIECE)
        flat, row = np.concatenate(part), np.concatenate(row)
        column = places[_column(flat)]
        keep = (flat != 0) & (column >= 0)
        key, count = np.unique(row[keep] * COLUMNS + column[keep], return_counts=True)
        yield key // COLUMNS, key % COLUMNS, count, before


class Space:
    """The latent space of the passages (ids) over the words of the sentences (ids)."""

    def __init__(self, found: DataFrame, sentences: DataFrame, rank: int = RANK, seed: int = 7) -> None:
        column = F.shiftright("w", BITS).bitwiseAND(F.lit(COLUMNS - 1))
        used = sorted(r.c for r in sentences.select(F.explode("ids").alias("w")).select(column.alias("c")).distinct().collect())  # at most COLUMNS rows
        self.places = np.full(COLUMNS, -1, np.int32)
        self.places[used] = np.arange(len(used))
        self.found, self.m = found.select("ids"), len(used)
        self.idf = self._idf()
        self.vectors = self._svd(rank, seed)

    def _idf(self) -> np.ndarray:
        """Smoothed inverse document frequencies of the columns over all passages."""
        places, m = self.places, self.m

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            df, n = np.zeros(m + 1, np.int64), 0
            for pdf in batches:
                for _, column, _, rows in _rows(pdf, places):
                    df[:m] += np.bincount(column, minlength=m)
                    n += rows
            df[m] = n
            at = np.flatnonzero(df)
            yield pd.DataFrame({"w": at.astype(np.int32), "n": df[at]})

        df = np.zeros(m + 1)
        for r in self.found.mapInPandas(part, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).collect():  # at most COLUMNS + 1 rows
            df[r.w] = r.n
        return np.log((1 + df[m]) / (1 + df[:m])) + 1

    def _product(self, q: np.ndarray) -> np.ndarray:
        """A'A q: partitions sum their rows' share, Spark the partitions'."""
        sc = self.found.sparkSession.sparkContext
        shared, width = sc.broadcast((q, self.idf, self.places)), q.shape[1]

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q, idf, places = shared.value
            total, seen = np.zeros_like(q), False
            for pdf in batches:
                for row, column, count, rows in _rows(pdf, places):
                    if not len(row):
                        continue
                    seen = True
                    w = count * idf[column]
                    w = w / np.sqrt(np.bincount(row, w * w, rows))[row]
                    first = np.flatnonzero(np.diff(row, prepend=-1))
                    y = np.zeros((rows, width))
                    y[row[first]] = np.add.reduceat(w[:, None] * q[column], first)
                    order = np.argsort(column, kind="stable")
                    column = column[order]
                    first = np.flatnonzero(np.diff(column, prepend=-1))
                    total[column[first]] += np.add.reduceat((w[:, None] * y[row])[order], first)
            if seen:
                used = np.flatnonzero(np.abs(total).sum(axis=1) > 0)
                yield pd.DataFrame({"w": used.astype(np.int32), "v": list(total[used])})

        sums = self.found.mapInPandas(part, "w int, v array<double>").groupBy("w").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(width)]).alias("v"))
        out = np.zeros_like(q)
        for r in sums.toLocalIterator():  # at most COLUMNS rows
            out[r.w] = r.v
        return out

    def _svd(self, rank: int, seed: int) -> np.ndarray:
        """The first right singular vectors (columns x rank) of the TF-IDF matrix of the passages."""
        width = min(self.m, rank + OVERSAMPLE)
        q = np.random.default_rng(seed).standard_normal((self.m, width))
        for _ in range(1 + POWER):
            q = np.linalg.qr(self._product(q))[0]
        _, vectors = np.linalg.eigh(q.T @ self._product(q))
        return q @ vectors[:, ::-1][:, : min(rank, width)]

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """The columns' numbers, and each column's share in a window's latent vector (the last row is 0)."""
        return self.places, np.vstack([self.idf[:, None] * self.vectors, np.zeros((1, self.vectors.shape[1]))]).astype(np.float32)

    def rarity(self, ids: np.ndarray) -> np.ndarray:
        return self.idf[self.places[_column(ids)]]


def _sums(flat: np.ndarray, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Running sums of the words' latent vectors, one more than there are words."""
    column = np.where(flat == 0, -1, places[_column(flat)])  # -1 is the row of zeros
    out = np.zeros((len(flat) + 1, weights.shape[1]))
    np.cumsum(weights[column], axis=0, out=out[1:])
    return out


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; two vectors without a share in the latent space are alike."""
    dot, na, nb = np.einsum("ij,ij->i", a, b), np.sqrt(np.einsum("ij,ij->i", a, a)), np.sqrt(np.einsum("ij,ij->i", b, b))
    none = (na < 1e-6) | (nb < 1e-6)
    return np.where(none, (na < 1e-6) & (nb < 1e-6), dot / np.where(none, 1, na * nb))


@dataclass
class Block:
    """Some test sentences and the rare words by which windows are looked up for them."""

    tests: list
    sides: np.ndarray
    want: np.ndarray  #: words of each sentence, then -1
    n: np.ndarray
    vectors: np.ndarray
    telling: np.ndarray  #: rarest words, then -1
    must: np.ndarray  #: telling words that a paraphrase must have
    near: tuple  #: index of paraphrases: (words, first entry, entries: sentence, place in the window or -1)
    same: tuple  #: index of exact windows: the same with the windows (sentence, offset) and their vectors


def _index(words: np.ndarray, *columns: np.ndarray) -> tuple:
    order = np.argsort(words, kind="stable")
    keys, first = np.unique(words[order], return_index=True)
    return keys, np.append(first, len(words)), tuple(c[order] for c in columns)


def make_block(pdf: pd.DataFrame, space: Space, window: int) -> Block:
    rows = [np.asarray(x, np.int64) for x in pdf["ids"]]
    n = np.array([len(x) for x in rows])
    want = np.full((len(rows), n.max()), -1, np.int64)
    telling = np.full((len(rows), TELLING), -1, np.int64)
    places, weights = space.weights()
    vectors = np.zeros((len(rows), weights.shape[1]))
    near, same, same_vectors = [], [], []
    for s, ids in enumerate(rows):
        want[s, : len(ids)] = ids
        sums = _sums(ids, places, weights)
        vectors[s] = sums[-1]
        rare = space.rarity(ids)
        best = list(dict.fromkeys(ids[np.lexsort((ids, -rare))].tolist()))[:TELLING]
        telling[s, : len(best)] = best
        # a window that may lack one of three telling words has one of the first two
        near += [(k, s) for k in best[: 2 if len(best) == TELLING else 1]]
        for o in range(len(ids) - window + 1):
            k = int(np.lexsort((ids[o : o + window], -rare[o : o + window]))[0])
            same.append((ids[o + k], s, o, k))
            same_vectors.append(sums[o + window] - sums[o])
    must = np.where(telling[:, -1] >= 0, TELLING - 1, (telling >= 0).sum(axis=1))
    near_ = np.array(near, np.int64).reshape(-1, 2)
    same_ = np.array(same, np.int64).reshape(-1, 4)
    return Block(
        pdf["test"].tolist(), pdf["side"].to_numpy(), want, n, vectors, telling, must,
        _index(near_[:, 0], near_[:, 1]),
        _index(same_[:, 0], same_[:, 1], same_[:, 2], same_[:, 3], np.array(same_vectors, np.float32).reshape(-1, weights.shape[1])),
    )


def _loads(pdf: pd.DataFrame, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, row, start, end) of some passages side by side; each word has the borders of its passage.

    Passages longer than LOAD are cut to parts that overlap by a window.
    """
    parts: list[tuple[int, np.ndarray]] = []
    size = 0

    def packed() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for _, p in parts])
        ends = np.cumsum(lengths)
        return np.concatenate([p for _, p in parts]), np.repeat([r for r, _ in parts], lengths), np.repeat(ends - lengths, lengths), np.repeat(ends, lengths)

    for row, ids in enumerate(pdf["ids"]):
        ids = np.asarray(ids, np.int64)
        for a in range(0, max(1, len(ids) - overlap), LOAD):
            part = ids[a : a + LOAD + overlap]
            if parts and size + len(part) > LOAD:
                yield packed()
                parts, size = [], 0
            parts.append((row, part))
            size += len(part)
    if parts:
        yield packed()


def _hits(flat: np.ndarray, index: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of a rare word, entry of the index), some at a time."""
    keys, first, _ = index
    if not len(keys):
        return
    k = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
    at = np.flatnonzero(keys[k] == flat)
    count = first[k[at] + 1] - first[k[at]]
    border = np.cumsum(count) // CHUNK
    for b in np.unique(border):
        own = border == b
        a, c, f = at[own], count[own], first[k[at[own]]]
        yield np.repeat(a, c), np.repeat(f - np.cumsum(c) + c, c) + np.arange(c.sum())


def _common_lengths(want: np.ndarray, n: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences, row by row, by bit-parallel counting; want has at most 64 columns."""
    s = np.full(len(want), 2**64 - 1, np.uint64)
    bit = np.uint64(1) << np.arange(want.shape[1], dtype=np.uint64)
    for j in range(have.shape[1]):
        u = s & np.where(want == have[:, j : j + 1], bit, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        s = (s + u) | (s - u)
    low = np.where(n >= 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~s & low).astype(np.int64)


def _take(flat: np.ndarray, a: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The windows' words, then -2."""
    at = a[:, None] + np.arange(width.max())
    return np.where(np.arange(width.max()) < width[:, None], flat[np.minimum(at, len(flat) - 1)], -2)


def _same_windows(flat: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray, block: Block, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, sentence, offset in it) of all exact windows."""
    _, _, (sentence, offset, inside, vectors) = block.same
    for at, e in _hits(flat, block.same):
        a = at - inside[e]
        fits = (a >= start[at]) & (a + window <= end[at])
        a, e = a[fits], e[fits]
        near = _cosines(sums[a + window] - sums[a], vectors[e]) >= COSINE
        a, e = a[near], e[near]
        want = block.want[sentence[e][:, None], offset[e][:, None] + np.arange(window)]
        equal = (flat[a[:, None] + np.arange(window)] == want).all(axis=1)
        yield a[equal], sentence[e[equal]], offset[e[equal]]


def _compare(flat: np.ndarray, a: np.ndarray, width: np.ndarray, s: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share of the common subsequence, telling words found, whether the sentence stands there whole) of windows."""
    have = _take(flat, a, width)
    want, n = block.want[s, : block.n[s].max()], block.n[s]
    share = _common_lengths(want, n, have) / n
    found = (have[:, None, :] == block.telling[s][:, :, None]).any(axis=2).sum(axis=1)
    whole = np.zeros(len(a), bool)
    if have.shape[1] >= want.shape[1]:
        whole = ((have[:, : want.shape[1]] == want) | (want == -1)).all(axis=1)
    else:
        whole = (n <= have.shape[1]) & ((have == want[:, : have.shape[1]]) | (want[:, : have.shape[1]] == -1)).all(axis=1)
    return share, found, whole


def _windows_near(flat: np.ndarray, start: np.ndarray, end: np.ndarray, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first word, width, sentence) of the windows of a sentence's length around its rare words."""
    for at, e in _hits(flat, block.near):
        s = block.near[2][0][e]
        n = block.n[s]
        lo, hi = np.maximum(start[at], at - n + 1), np.maximum(start[at], np.minimum(at, end[at] - n))
        count = hi - lo + 1
        border = np.cumsum(count) // CHUNK
        for b in np.unique(border):
            own = border == b
            c, at_ = count[own], at[own]
            a = np.repeat(lo[own] - np.cumsum(c) + c, c) + np.arange(c.sum())
            width = np.minimum(np.repeat(n[own], c), np.repeat(end[at_], c) - a)
            yield a, width, np.repeat(s[own], c)


def _search(docs: DataFrame, tests: DataFrame, id_col: str, text_col: str, test_id: str, fields: list[str], window: int, search, columns: str, common: float | None = None) -> DataFrame:
    """``search(block, load, row ids)`` gives the result rows of some passages.

    Passages are runs of ``window`` known words or, with a share ``common``, also all windows that can reach it.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    spark = docs.sparkSession
    columns = columns.format(id=dict(docs.dtypes)["id"], test=dict(tests.dtypes)[test_id])
    sentences = test_sentences(tests, test_id, fields)
    sentences = materialize(sentences if common is not None else sentences.filter(F.size("ids") >= window), "sentences")
    lengths = [r.n for r in sentences.select(F.size("ids").alias("n")).distinct().collect()]  # at most LONGEST rows
    if not lengths:
        return spark.createDataFrame([], columns)
    stretches = partial(_runs, least=window) if common is None else partial(_covered, least={n: _least_common(n, common) for n in lengths}, run=window)
    found = materialize(passages(docs, vocabulary_bits(sentences), stretches), "passages")
    space = Space(found, sentences)
    places, weights = space.weights()
    words = sentences.agg(F.sum(F.size("ids"))).first()[0]
    n_blocks = -(-words // BLOCK)
    names = [c.split()[0] for c in columns.split(", ")]
    out = None
    for b in range(n_blocks):
        rows = sentences.filter(F.pmod(F.xxhash64("test", "side", "ids"), F.lit(n_blocks)) == b).toPandas()
        if not len(rows):
            continue
        shared = spark.sparkContext.broadcast((make_block(rows, space, window), places, weights))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            block, places, weights = shared.value
            for pdf in batches:
                ids = pdf["id"].to_numpy()
                for flat, row, start, end in _loads(pdf, max(window, block.n.max())):
                    for part in search(block, flat, start, end, _sums(flat, places, weights)):
                        at, s, *rest = part
                        if len(at):
                            test = pd.Series([block.tests[i] for i in s])
                            yield pd.DataFrame(dict(zip(names, [ids[row[at]], test, *([block.sides[s], *rest] if rest else [])], strict=True))).drop_duplicates()

        part = found.mapInPandas(run, columns)
        out = part if out is None else out.unionByName(part)
    return out


def leaked_passages(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", test_id: str = "test_id", fields: tuple[str, ...] = ("sentence_a", "sentence_b"), window: int = WINDOW) -> DataFrame:
    """(id_col, test_id): records that contain ``window`` words in a row of a sentence of the test row."""

    def search(block: Block, flat: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray) -> Iterator[tuple]:
        for a, s, _ in _same_windows(flat, start, end, sums, block, window):
            yield a, s

    found = _search(docs, tests, id_col, text_col, test_id, list(fields), window, search, "id {id}, test {test}")
    return found.select(F.col("id").alias(id_col), F.col("test").alias(test_id)).distinct()


_KINDS = ("reworded", "part", "whole")


def leak_report(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", test_id: str = "test_id", fields: tuple[str, ...] = ("sentence_a", "sentence_b"), window: int = WINDOW, cosine: float = NEAR, common: float = COMMON) -> DataFrame:
    """(id_col, test_id, side, cosine, common, kind): test sentences in records, whole, in part or reworded.

    ``part``: at least ``window`` words in a row.  ``reworded``: a window of the sentence's length whose
    cosine is high enough, whose common subsequence with the sentence covers the share ``common`` of it, and
    which has the sentence's telling words (its answer), one of three excepted.  ``cosine`` and ``common`` are the
    largest of the record's windows; for a part they are those of the window that lies like the sentence.
    """

    def search(block: Block, flat: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray) -> Iterator[tuple]:
        def rows(a: np.ndarray, width: np.ndarray, s: np.ndarray, near: np.ndarray, part: bool) -> tuple:
            share, telling, whole = _compare(flat, a, width, s, block)
            keep = np.ones(len(a), bool) if part else (share >= common) & (telling >= block.must[s])
            kind = np.where(whole, 2, int(part)).astype(np.int32)
            return a[keep], s[keep], np.minimum(near[keep], 1.0), share[keep], kind[keep]

        for a, s, o in _same_windows(flat, start, end, sums, block, window):
            if len(a):
                n = block.n[s]
                b = np.clip(a - o, start[a], np.maximum(start[a], end[a] - n))
                width = np.minimum(n, end[a] - b)
                yield rows(b, width, s, _cosines(sums[b + width] - sums[b], block.vectors[s]), True)
        for a, width, s in _windows_near(flat, start, end, block):
            near = _cosines(sums[a + width] - sums[a], block.vectors[s])
            keep = near >= cosine
            if keep.any():
                yield rows(a[keep], width[keep], s[keep], near[keep], False)

    columns = "id {id}, test {test}, side int, cosine double, common double, kind int"
    found = _search(docs, tests, id_col, text_col, test_id, list(fields), window, search, columns, common)
    best = found.groupBy("id", "test", "side").agg(F.max("cosine").alias("cosine"), F.max("common").alias("common"), F.max("kind").alias("kind"))
    names, kinds = F.array(*[F.lit(f) for f in fields]), F.array(*[F.lit(k) for k in _KINDS])
    return best.select(
        F.col("id").alias(id_col), F.col("test").alias(test_id), F.get(names, "side").alias("side"),
        F.round("cosine", 6).alias("cosine"), F.round("common", 6).alias("common"), F.get(kinds, "kind").alias("kind"),
    )
