import pytest

from lexmill.llm import mixing as M
from lexmill.llm import sizes as S

pytestmark = pytest.mark.skipif(not S.default_vocabulary_exists(), reason="no tokenizer files")
DOCS = "doc_id long, text string, source string, position int, copy string"
TARGETS = "source string, target_share double, max_repeats int, share int"


def corpus(spark):
    rows = [(i, "some words of a text " * (i % 5 + 1), ["Big", "big ", "BIG"][i % 3], 0, "") for i in range(400)]
    rows += [(1000 + i, "small text here " * (i % 3 + 1), "small-one", 0, "") for i in range(40)]
    rows += [(2000 + i, "tiny", "tiny", 0, "") for i in range(3)]
    rows += [(3000, None, "big", 0, ""), (3001, " ", "big", 0, ""), (3002, "lost", None, 0, ""), (3003, "lost", "unlisted", 0, ""), (0, rows[0][1], "big", 0, "")]
    return spark.createDataFrame(rows, DOCS)


def targets(spark):
    return spark.createDataFrame([("big", 0.5, 1, 0), ("small_one", 0.3, 4, 0), ("tiny", 0.1, 2, 0), ("absent", 0.1, 3, 0)], TARGETS)


def test_shares_repeats_and_report(spark):
    total = 1000
    report = {r.source: r for r in M.share_report(corpus(spark), targets(spark), total_tokens=total).collect()}
    assert abs(report["big"].used_tokens - 500) <= 30 and report["big"].supplied
    assert abs(report["small_one"].used_tokens - 300) <= 15 and report["small_one"].supplied
    assert not report["tiny"].supplied and report["tiny"].used_tokens == 2 * report["tiny"].available_tokens
    assert not report["absent"].supplied and report["absent"].used_tokens == 0
    assert report["unlisted"].used_tokens == 0 and report[None].used_tokens == 0 and report[None].supplied is None
    assert all(abs(r.deviation - (r.actual_share - r.target_share)) < 2e-6 for r in report.values())
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-5


def test_copies_and_order(spark):
    rows = M.curriculum(corpus(spark), targets(spark), total_tokens=1000).toPandas()
    assert rows.position.between(0, 1).all() and rows.position.is_monotonic_increasing
    counts = rows.groupby(["source", "doc_id"]).size().unstack(0)
    assert counts["big"].max() == 1 and counts["tiny"].max() == 2 and counts["small_one"].max() <= 4
    assert not rows.duplicated(["doc_id", "copy"]).any()
    again = M.curriculum(corpus(spark).repartition(7), targets(spark), total_tokens=1000).toPandas()
    assert again.equals(rows)


def test_schedule_is_followed(spark):
    docs = spark.createDataFrame([(i, "same size", "ab"[i % 2], 0, "") for i in range(4000)], DOCS)
    t = spark.createDataFrame([("a", 0.5, 1, 0), ("b", 0.5, 1, 0)], TARGETS)
    rows = M.curriculum(docs, t, tilt={"a": 1.0, "b": -1.0}).toPandas()
    early = rows[(rows.position < 0.25) & (rows.source == "a")].n_tokens.sum() / rows[rows.source == "a"].n_tokens.sum()
    assert abs(early - (0.25 + 1.0 * (0.0625 - 0.25))) < 0.01  # integral of the schedule
    size = rows.n_tokens.iloc[0]
    assert len(rows) == 4000 and size > 0


def test_weights_sum_to_one_at_any_time(spark):
    for tilt in (None, {"big": 0.9, "tiny": -1.0}):
        s = M.schedules(targets(spark), tilt).collect()
        for t in (0.0, 0.3, 1.0):
            assert abs(sum(r.share * (1 + r.slope * (2 * t - 1)) for r in s) - 1) < 1e-9
        assert all(abs(r.slope) <= 1 for r in s)


def test_prefix_sums_equal_a_plain_running_sum(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 10)
    sizes = spark.createDataFrame([(i, "a" if i % 3 else "b", i % 7 + 1) for i in range(300)], "id long, source string, n_tokens long")
    got = M.cumulative(sizes, 3).toPandas().sort_values(["source", "before"])
    for _, own in got.groupby("source"):
        assert own.before.tolist() == (own.n_tokens.cumsum() - own.n_tokens).tolist()


def test_empty(spark):
    docs, t = corpus(spark), targets(spark)
    assert M.curriculum(docs.limit(0), t).count() == 0
    assert M.curriculum(docs, t.limit(0)).count() == 0
    assert M.share_report(docs.limit(0), t).count() == 4
