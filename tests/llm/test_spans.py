import random

import numpy as np

from lexmill.llm import spans as S

SCHEMA = "doc_id long, text string, id int, h string"


def brute(rows):
    seen, multi = {}, set()
    rows = {(i, t) for i, t in rows if t is not None and len(t) >= S.SPAN}
    for i, t in rows:
        for k in range(len(t) - S.SPAN + 1):
            if seen.setdefault(t[k : k + S.SPAN], i) != i:
                multi.add(t[k : k + S.SPAN])
    out = {}
    for i, t in rows:
        covered = np.zeros(len(t), bool)
        for k in range(len(t) - S.SPAN + 1):
            if t[k : k + S.SPAN] in multi:
                covered[k : k + S.SPAN] = True
        if covered.any():
            out[i] = int(covered.sum())
    return out


def text(rng, n, letters="abcdefgh иж"):
    return "".join(rng.choice(letters) for _ in range(n))


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA).repartition(3)
    amounts = {r.doc_id: r.shared_chars for r in S.shared_amounts(df).collect()}
    found = {r.doc_id for r in S.shared_records(df).collect()}
    assert found == {i for i, n in amounts.items() if n}
    return {i: n for i, n in amounts.items() if n}


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, rng.randrange(0, 900))) for i in range(40)]
    for n in (158, 159, 160, 161, 175, 223, 224, 400):
        span = text(rng, n)
        for _ in range(rng.choice((2, 3))):
            i = rng.randrange(len(rows))
            at = rng.randrange(len(rows[i][1]) + 1)
            rows[i] = (rows[i][0], rows[i][1][:at] + span + rows[i][1][at:])
    # chains: B shares different stretches with A and C that meet in B; only whole copies; edges of texts
    a, c = text(rng, 300), text(rng, 300)
    rows += [(100, a), (101, a[-170:] + c[:165]), (102, c), (103, a), (104, text(rng, 200) + a[:160]), (105, c[140:] + text(rng, 5))]
    want = brute(rows)
    assert len(want) > 12
    assert run(spark, rows) == want


def test_inner_repetition_and_edges(spark):
    rng = random.Random(6)
    span = text(rng, 200)
    rows = [(1, span + "-" + span), (2, None), (3, ""), (4, "short"), (5, "a" * 500), (6, "a" * 159 + "b"), (7, "ab" * 90), (7, "ab" * 90)]
    assert run(spark, rows) == brute(rows) == {}
    rows += [(8, "a" * 300), (9, "\U0001f600" * 80 + span), (10, span[:160])]
    want = brute(rows)
    assert set(want) == {1, 5, 8, 9, 10}
    assert run(spark, rows) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.shared_records(df).count() == 0 and S.shared_amounts(df).count() == 0


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(S, "PIECE", 1000)
    base = text(rng, 5000)
    series = [base, text(rng, 700) + base[2000:2160] + text(rng, 900)]
    import pandas as pd

    found = [set(), set()]
    for row, _, hashed, index, *_ in S._anchors(pd.Series(series)):
        for r, h in zip(row, hashed.of(index, index + S.K), strict=True):
            found[r].add(int(h))
    assert found[0] & found[1]


def test_sketch_only_overestimates():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 5000).astype(np.uint64)
    batches = [np.concatenate([h[:3000]]), np.concatenate([h[2900:]])]
    counts = np.zeros((S.ROWS, 1 << 14), int)
    import zlib

    for b in batches:
        for pdf in S._hash_sketch(iter([b]), 14):
            chunk = np.frombuffer(zlib.decompress(pdf.data[0]), np.uint8)
            counts[pdf.r[0], : len(chunk)] += chunk
    twice = np.packbits(counts >= 2, axis=1)
    passed = S._repeated(h, twice, 14)
    assert passed[2900:3000].all() and passed.mean() < 0.5
