import itertools
import random

import pytest

from lexmill.functions import text as tx
from lexmill.operators import corpus, dedup

STS = "sentence_a string, sentence_b string, score int"


def lines_frame(spark, texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id int, pos long, text string")


def test_lines(spark):
    df = spark.createDataFrame([(1, "a  b\r\n\r\nc\rd\n", 0), (2, None, 0), (3, "", 0)], "doc_id int, text string, pos int")
    assert [tuple(r) for r in corpus.corpus_lines(df).orderBy("pos").collect()] == [(1, 0, "a b"), (1, 2, "c"), (1, 3, "d")]


def test_guard(spark):
    held = spark.createDataFrame([("A  test sentence", "Another one", 3), (None, "x", 1)], STS)
    lines = lines_frame(spark, ["A test sentence", "clean"])
    assert [r.text for r in corpus.leaked(lines, held).collect()] == ["A test sentence"]
    assert [r.text for r in corpus.without_leaks(lines, held).collect()] == ["clean"]
    with pytest.raises(corpus.Leakage):
        corpus.require_no_leaks(lines, held)
    corpus.require_no_leaks(lines, None)
    assert corpus.build_corpus(lines_frame(spark, ["clean", "other"]), held).count() == 2
    files = spark.createDataFrame([("b.jsonl", '{"anchor": "Another one", "positive": "p"}'), ("c.txt", "fine")], "path string, text string")
    with pytest.raises(corpus.Leakage, match="b.jsonl"):
        corpus.require_clean_files(files, held)
    corpus.require_clean_files(files.filter("path = 'c.txt'"), held)


def test_first_of_equal_and_adjacent(spark):
    lines = lines_frame(spark, ["x", "y", "x", "z"])
    assert [(r.pos, r.text) for r in corpus.first_of_equal(lines, "doc_id", "pos").orderBy("pos").collect()] == [(0, "x"), (1, "y"), (3, "z")]
    rng = random.Random(3)
    many = spark.createDataFrame([(rng.randrange(9), i, rng.choice("abcdefg") * 3, 7) for i in range(200)], "doc_id int, pos int, text string, n int").repartition(4)
    want = {}
    for r in sorted(many.collect()):
        want.setdefault(r.text, tuple(r))
    assert {tuple(r) for r in corpus.first_of_equal(many, "doc_id", "pos").collect()} == set(want.values())
    assert [(r.a, r.b) for r in corpus.adjacent_pairs(lines).orderBy("pos").collect()] == [("x", "y"), ("y", "x"), ("x", "z")]


def shingle_set(text, k=5):
    w = text.split()
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({" ".join(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b)


def sequential(texts, collide):
    kept = []
    for i, t in enumerate(texts):
        if t.split() and not any(collide(j, i) for j in kept):
            kept.append(i)
    return kept


def noisy(rng, n):
    base = [" ".join(rng.choice("abcdefgh") * 2 + str(rng.randrange(30)) for _ in range(40)) for _ in range(8)]
    out = []
    for _ in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(5))
        out.append(" ".join(w))
    return out


def test_jaccard_pairs_and_greedy_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 4)
    rng = random.Random(1)
    texts = noisy(rng, 60) + ["a b", "a b", "", "  ", "a c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    sets = [shingle_set(t) for t in texts]
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(" ".join(t.split()), i)
    ids = sorted(i for t, i in first.items() if t)
    for threshold in (0.5, 0.8):
        want = {(i, j) for i, j in itertools.combinations(ids, 2) if jaccard(sets[i], sets[j]) >= threshold - 1e-9}
        got = {(r.i, r.j) for r in dedup.jaccard_pairs(df, threshold=threshold).collect()}
        assert got == want and want
        kept = sequential(texts, lambda j, i, t=threshold: jaccard(sets[j], sets[i]) >= t - 1e-9)
        assert sorted(r.doc_id for r in dedup.dedup(df, threshold=threshold).collect()) == kept


def test_greedy_keep_equals_a_scan_on_random_graphs(spark):
    rng = random.Random(2)
    for n, m in ((40, 70), (30, 0), (60, 150)):
        edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
        kept = []
        for i in range(n):
            if not any((j, i) in edges for j in kept):
                kept.append(i)
        e = spark.createDataFrame(sorted(edges), "i int, j int")
        got = sorted(r.id for r in dedup.greedy_keep(spark.createDataFrame([(i,) for i in range(n)], "id int"), e).collect())
        assert got == kept


def test_lsh_keeps_distinct_and_finds_copies(spark):
    texts = ["the quick brown fox jumps over the lazy dog tonight"] * 2 + [f"sentence number {i} with wholly other words {i * 7} and {i * 13} more {i}" for i in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert len(dedup.dedup(df, exact=False).collect()) == 26
    near = [" ".join(f"w{i}" for i in range(60)), " ".join([f"w{i}" for i in range(59)] + ["x"]), "other words entirely here now and then"]
    small = spark.createDataFrame(list(enumerate(near)), "doc_id int, text string")
    assert len(dedup.dedup(small, exact=False, threshold=0.4).collect()) == 2
    assert len(dedup.dedup(small, exact=False, threshold=0.4, batch=1).collect()) == 3


def test_band_shapes():
    # fixed values: shapes that sequential indexes use for 128 permutations
    assert [dedup.band_shape(t) for t in (0.4, 0.5, 0.8, 0.9)] == [(32, 4), (25, 5), (9, 13), (5, 25)]
    for t in (0.05, 0.33, 0.7, 0.77, 0.95, 1.0):
        b, r = dedup.band_shape(t)
        assert b * r <= dedup.PERMUTATIONS
    assert dedup.band_shape(0.3)[1] < dedup.band_shape(0.7)[1] < dedup.band_shape(0.95)[1]


def test_any_threshold(spark):
    texts = ["the quick brown fox jumps over the lazy dog tonight", "the quick brown fox jumps over the lazy dog today", "wholly other words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert len(dedup.dedup(df, exact=False, threshold=0.33).collect()) == 2
    assert len(dedup.dedup(df, exact=False, threshold=0.97).collect()) == 3


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert dedup.dedup(df).count() == 0 and dedup.dedup(df, exact=False).count() == 0
    assert corpus.corpus_lines(df).count() == 0 and df.select(tx.normalize("text")).count() == 0
