import numpy as np
import pytest

from lexmill.llm import packing as P
from lexmill.llm import sizes as S

pytestmark = pytest.mark.skipif(not S.default_vocabulary_exists(), reason="no tokenizer files")
DOCS = "doc_id long, text string, id int, bin string"


def fills(bins):
    return sorted(sum(b) for b in bins)


def squares(bins):
    return sum(f * f for f in fills(bins))


def steepest(sizes, capacity):
    """Moves of single pieces by looking at all of them."""
    bins = [[s] for s in sizes]
    while True:
        moves = [(sum(b) * a[0], i, j) for i, a in enumerate(bins) if len(a) == 1 for j, b in enumerate(bins) if i != j and b and sum(b) + a[0] <= capacity]
        if not moves:
            return [b for b in bins if b]
        _, i, j = max(moves)
        bins[j].append(bins[i][0])
        bins[i] = []


def test_moves_are_the_steepest():
    rng = np.random.default_rng(4)
    for capacity in (9, 16, 40):
        sizes = rng.integers(1, capacity + 1, 40).tolist()
        got, want = P.move_singles(sizes, capacity), steepest(sizes, capacity)
        assert sorted(s for b in got for s in b) == sorted(sizes) and max(fills(got)) <= capacity
        assert abs(len(got) - len(want)) <= 1 and squares(got) >= 0.97 * squares(want)  # ties may be broken otherwise


def test_search_increases_squared_fill_and_keeps_pieces():
    rng = np.random.default_rng(0)
    for capacity in (10, 37, 128):
        sizes = rng.integers(1, capacity + 1, 400)
        start = [[int(s)] for s in sizes]
        end = P._Exchange([list(b) for b in start], capacity).run()
        both = P.pack(sizes.tolist(), capacity)
        for bins in (end, both):
            assert sorted(s for b in bins for s in b) == sorted(sizes.tolist())
            assert max(fills(bins)) <= capacity
            assert squares(bins) > squares(start)
        assert len(both) <= 1.06 * max(-(-sizes.sum() // capacity), int((sizes * 2 > capacity).sum()))


def test_every_kind_of_step():
    # a move; one for one; two for one
    assert fills(P._Exchange([[6, 2], [2, 1]], 10).run()) == [1, 10]
    assert fills(P._Exchange([[6, 3], [4]], 10).run()) == [3, 10]
    assert fills(P._Exchange([[5, 4], [3, 2, 9 - 9 + 1]], 10).run()) == [5, 10]
    end = P._Exchange([[6, 3], [4], [3, 2], [5]], 10).run()
    assert len(end) <= 3 and max(fills(end)) == 10


def test_search_empties_bins_of_a_plain_fill():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 60, 600).tolist()
    bins, room = [], 0
    for s in sizes:  # next fit
        if s > room:
            bins.append([])
            room = 128
        bins[-1].append(s)
        room -= s
    end = P._Exchange([list(b) for b in bins], 128).run()
    assert len(end) < 0.9 * len(bins) and sorted(s for b in end for s in b) == sorted(sizes)


def test_pack_edges():
    assert P.pack([], 8) == [] and P.pack([8], 8) == [[8]] and P.pack([1], 1) == [[1]]


def test_exact_cover(spark):
    texts = [None, "", " \n ", "one two three", "word " * 700, "кот " * 90, "x"] + [f"text {i} " * (i % 37 + 1) for i in range(300)]
    rows = [(i, t, 0, "z") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:10], DOCS)
    limits = spark.createDataFrame([("s", 32), ("m", 100), ("none", None), ("zero", 0)], "stage string, max_seq_length int")
    got = P.packed_sequences(docs, limits, cell=120).toPandas()
    size = {r.id: r.n_tokens for r in S.token_sizes(docs, "doc_id", "text").collect() if r.n_tokens}
    assert size[4] > 100
    for stage, capacity in (("s", 32), ("m", 100)):
        own = got[got.stage == stage]
        assert own.groupby("bin").n_tokens.sum().max() <= capacity
        for doc, parts in own.groupby("doc_id"):
            parts = parts.sort_values("piece")
            assert parts.n_tokens.sum() == size[doc]
            assert parts.first_token.tolist() == np.concatenate([[0], parts.n_tokens.cumsum()[:-1]]).tolist()
            assert len(parts) == -(-size[doc] // capacity)  # split only if longer than a sequence
        assert set(own.doc_id) == set(size)
    assert set(got.stage) == {"s", "m"}
    report = {r.stage: r for r in P.fill_report(P.packed_sequences(docs, limits), limits).collect()}
    again = P.packed_sequences(docs, limits, cell=40).toPandas()  # more rounds over underfull bins
    for stage, capacity in (("s", 32), ("m", 100)):
        own, one = again[again.stage == stage], got[got.stage == stage]
        assert own.groupby("bin").n_tokens.sum().max() <= capacity and sorted(zip(own.doc_id, own.piece, own.n_tokens)) == sorted(zip(one.doc_id, one.piece, one.n_tokens))
        assert own.bin.nunique() <= one.bin.nunique() + 2
    assert report["s"].pieces == (got.stage == "s").sum()
    assert report["s"].fill > 0.95 and report["s"].sequences >= report["s"].least_sequences


def test_empty(spark):
    limits = spark.createDataFrame([("s", 32)], "stage string, max_seq_length int")
    assert P.packed_sequences(spark.createDataFrame([], DOCS), limits).count() == 0
    assert P.packed_sequences(spark.createDataFrame([(1, "a", 0, "")], DOCS), limits.limit(0)).count() == 0


def test_sizes_equal_the_tokenizer(spark):
    texts = ["Hello world", "ગુજરાતી લખાણ", " \n\n x", "a" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = S.encoder(S.read_vocabulary())
    got = {r.id: r.n_tokens for r in S.token_sizes(df, "doc_id", "text").collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts)
