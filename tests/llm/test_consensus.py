import datetime as dt
import itertools
import random

import numpy as np
import pytest

from lexmill.llm import consensus as C

SCHEMA = "id int, item_id int, annotator_id int, label double, created_at timestamp, symbol string, item int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)


def at(minutes):
    return dt.datetime(2025, 1, 1) + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def world(spark):
    """300 items; annotators 1-6 careful, 7 constant, 8 inverted, 9 random, 10 always one too high."""
    rng = random.Random(1)
    truth = {i: rng.randrange(6) for i in range(300)}
    rows, n = [], 0
    for i, t in truth.items():
        for a in rng.sample(range(1, 11), rng.randrange(2, 8)):
            x = t if rng.random() < 0.85 else min(5, max(0, t + rng.choice((-1, 1))))
            x = {7: 3, 8: 5 - t, 9: rng.randrange(6), 10: min(5, t + 1)}.get(a, x)
            rows.append((n, i, a, float(x), at(n)))
            n += 1
    return truth, rows, frame(spark, rows)


def test_consensus_is_the_careful_mode(world):
    truth, rows, df = world
    got = {r.item_id: r.label for r in C.found(df).collect()}
    raters = {i: {a for _, j, a, *_ in rows if j == i} for i in truth}
    assert set(got) == {i for i in truth if len(raters[i]) >= 3}
    for i, label in got.items():
        votes = [x for _, j, a, x, _ in rows if j == i and a <= 6]
        counts = sorted(((votes.count(k), k) for k in range(6)), reverse=True)
        if votes and counts[0][0] > counts[1][0]:
            assert label == counts[0][1]
    assert np.mean([got[i] == truth[i] for i in got]) > 0.93


def test_reliability_and_intervals(spark, world):
    truth, rows, df = world
    annotators = spark.createDataFrame([(a, "n", 1.0) for a in range(1, 13)], "id int, name string, reliability double")
    got = {r.annotator_id: r for r in C.annotator_report(df, annotators).collect()}
    assert set(got) == set(range(1, 13)) and got[11].labels == 0 and got[11].reliability is None
    for a in range(1, 7):
        own = [x == truth[i] for _, i, b, x, _ in rows if b == a]
        assert got[a].reliability > 0.7 and 0 < got[a].low < got[a].reliability < got[a].high < 1 and got[a].low <= np.mean(own) + 0.03 and got[a].high >= np.mean(own) - 0.06
    assert all(got[a].reliability < 0.5 for a in (7, 8, 9, 10))
    assert got[10].offset > 0.5
    model = C.Consensus(df)
    assert model.converged and 0.4 < model.careful < 0.8
    want = {tuple(r) for r in model.items().select("item", "label").collect()}
    for cut in (0.5, 0.6, 0.7):
        assert {tuple(r) for r in model.items(careful=cut).select("item", "label").collect()} == want
    short = C.Consensus(df, rounds=1)
    assert not short.converged and short.rounds == 1
    report = C.agreement_report(df).collect()
    assert {r.raters for r in report} == {"all", "careful"} and all(r.converged and r.rounds > 1 for r in report)


def test_two_groups():
    rng = np.random.default_rng(0)
    apart = np.concatenate([rng.normal(0.3, 0.05, 10), rng.normal(0.88, 0.02, 20)])
    assert 0.4 < C.two_groups(apart, np.ones(30)) < 0.83
    alike = [C.two_groups(rng.normal(0.85, 0.03, 400), np.ones(400)) for _ in range(20)]
    assert alike == [None] * 20
    assert C.two_groups(np.array([]), np.array([])) is None and C.two_groups(np.array([0.5, 0.5]), np.ones(2)) is None


def test_beta_interval():
    rng = np.random.default_rng(1)
    for a, b in ((3.0, 1.0), (40.0, 8.0), (0.6, 2.0), (5000.0, 900.0)):
        x = rng.beta(a, b, 400_000)
        sd = (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
        np.testing.assert_allclose(C.beta_interval(a / (a + b), sd), np.quantile(x, [0.025, 0.975]), atol=0.004)
    assert C.beta_interval(1.0, 0.0) == (1.0, 1.0)


def test_latest_label_counts(spark):
    rows = [
        (1, 1, 1, 2.0, at(1)), (2, 1, 1, 4.0, at(5)), (3, 1, 1, 4.0, at(5)), (4, 1, 1, 1.0, at(2)),
        (5, 1, 2, 3.0, at(1)), (6, 1, 2, 9.0, at(2)), (7, 1, 3, 2.5, None), (8, 1, 4, None, at(1)), (9, 1, 5, -1.0, at(1)),
        (10, None, 5, 1.0, at(1)), (11, 1, None, 1.0, at(1)), (12, 1, 6, 2.3, at(1)), (13, 1, 7, float("nan"), at(1)),
    ]
    got = {(r.item, r.annotator): r.symbol for r in C.latest_labels(frame(spark, rows + rows)).collect()}
    assert got == {(1, 1): 8, (1, 3): 5}


def test_empty_and_few(spark):
    assert C.found(frame(spark, [])).count() == 0
    assert C.agreement_report(frame(spark, [])).count() == 0
    assert C.found(frame(spark, [(1, 1, 1, 3.0, None), (2, 1, 2, 3.0, None)])).count() == 0
    assert [tuple(r) for r in C.found(frame(spark, [(k, 1, k, 3.0, None) for k in range(3)])).collect()] == [(1, 3)]


def test_krippendorff_against_pairs(spark):
    rng = random.Random(2)
    rows = [(n, n // 4, n % 4, rng.randrange(11) / 2, None) for n in range(80) if rng.random() < 0.8]
    got = C.Consensus(frame(spark, rows)).krippendorff("all").first()
    items = {}
    for _, i, _, x, _ in rows:
        items.setdefault(i, []).append(x)
    kept = [v for v in items.values() if len(v) > 1]
    values = [x for v in kept for x in v]
    n = len(values)
    observed = sum((a - b) ** 2 / (len(v) - 1) for v in kept for a, b in itertools.permutations(v, 2)) / n
    expected = sum((a - b) ** 2 for a, b in itertools.permutations(values, 2)) / (n * (n - 1))
    assert got.labels == n and abs(got.alpha - (1 - observed / expected)) < 1e-9


def test_digamma():
    x = np.array([0.15, 0.5, 1.0, 3.3, 50.0])
    h = 1e-5
    from math import lgamma

    slope = [(lgamma(v + h) - lgamma(v - h)) / (2 * h) for v in x]
    np.testing.assert_allclose(C.digamma(x), slope, rtol=1e-6)
