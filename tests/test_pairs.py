import random

import numpy as np
import pytest

from lexmill.operators import annotate, pairs, retrieval, sample

SCORED = "item_id int, sentence_a string, sentence_b string, score double"


def texts(spark, n):
    return spark.createDataFrame([(1, i, f"line {i}") for i in range(n)], "doc_id int, pos long, text string")


def test_sample(spark):
    df = texts(spark, 1000)
    a = {r.pos for r in sample.sample_rows(df, 100, 7, "pos").collect()}
    assert len(a) == 100 and a == {r.pos for r in sample.sample_rows(df.repartition(5), 100, 7, "pos").collect()}
    assert a != {r.pos for r in sample.sample_rows(df, 100, 8, "pos").collect()}
    assert sample.sample_rows(texts(spark, 10), 100, 7, "pos").count() == 10


def test_numbered_and_zipped(spark):
    df = texts(spark, 500).repartition(7)
    assert all(r.idx == r.pos for r in sample.numbered(df, "pos").collect())
    left = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, x string")
    right = spark.createDataFrame([(20, "y"), (10, "z")], "m int, y string")
    assert {(r.x, r.y) for r in sample.zipped(left, right, ["k"], ["m"]).collect()} == {("a", "z"), ("b", "y")}


def test_random_pairs_and_candidates(spark):
    got = sample.random_pairs(texts(spark, 20), 200, 3, "doc_id", "pos").collect()
    assert len(got) == 200 and all(r.a != r.b for r in got) and len({(r.a, r.b) for r in got}) > 100
    pool = pairs.candidate_pool(texts(spark, 5), 3, 1).collect()
    assert sum(r.kind == "adjacent" for r in pool) == 4 and len(pool) == 7
    assert sample.random_pairs(texts(spark, 1), 5, 3, "doc_id", "pos").count() == 0


def test_silver(spark):
    lines = texts(spark, 12)
    para = spark.createDataFrame([(f"line {i}", p) for i, p in enumerate(["p0", None, "", "line 3", "p4", "p5", "p6"])], "text string, paraphrase string")
    got = pairs.silver_pairs(lines, 9, 1, para).collect()
    assert len(got) == 9 and {r.score for r in got} == {4.8, 2.0, 0.3}
    assert {r.score for r in pairs.silver_pairs(lines, 9, 1).collect()} == {2.0, 0.3}
    assert pairs.silver_pairs(texts(spark, 1), 9, 1).count() == 0


def test_large_samples_are_the_same(spark, monkeypatch):
    df = texts(spark, 1000).repartition(5)
    want = {r.pos for r in sample.sample_rows(df, 300, 7, "pos").collect()}
    monkeypatch.setattr(sample, "IN_ONE_TASK", 10)
    got = sample.sample_rows(df, 300, 7, "pos")
    assert got.columns == df.columns and {r.pos for r in got.collect()} == want
    assert sample.sample_rows(df, 5000, 7, "pos").count() == 1000


@pytest.mark.parametrize("n,reuse", [(20, 2), (500, 2), (500, 1), (7, 3), (500, 5)])
def test_select_capped_against_a_loop(spark, n, reuse):
    rng = random.Random(4)
    pool = [(i, f"s{rng.randrange(15)}", f"s{rng.randrange(15)}", round(rng.random(), 1)) for i in range(120)]  # ties, and texts paired with themselves
    pool += [(200 + i, "hot", f"t{i}", 2.0) for i in range(30)]
    used, want = {}, []
    for p, a, b, s in sorted(pool, key=lambda r: (-r[3], r[0])):
        if len(want) < n and used.get(a, 0) + (a == b) < reuse + (a == b) and used.get(a, 0) < reuse and used.get(b, 0) < reuse:
            want.append(p)
            used[a] = used.get(a, 0) + 1
            used[b] = used.get(b, 0) + 1
    got = [r.pair for r in pairs.select_capped(spark.createDataFrame(pool + [(900, None, "x", 9.0)], "pair int, a string, b string, score double"), n, reuse).collect()]
    assert got == want
    assert pairs.select_capped(spark.createDataFrame([], "pair int, a string, b string, score double"), n).count() == 0


def test_triplets(spark):
    rows = [(i, f"a{i}", f"b{i}", s) for i, s in enumerate([4.8] * 20 + [2.0] * 20 + [0.3] * 20)]
    df = spark.createDataFrame(rows, SCORED)
    got = annotate.percentile_triplets(df).collect()
    assert len(got) == 20 and all(int(r.anchor[1:]) < 20 and int(r.negative[1:]) >= 40 for r in got)
    assert annotate.percentile_triplets(df.limit(0)).count() == 0
    assert annotate.percentile_triplets(df.limit(1)).count() == 0  # positive equals negative
    assert annotate.threshold_triplets(df).count() == 20
    threes = spark.createDataFrame([(1, "a", "b", 3.0)], SCORED)
    assert annotate.threshold_triplets(threes).count() == 0


def test_quality(spark):
    same = spark.createDataFrame([(1, 1), (2, 2), (5, 5)], "a int, b int")
    assert annotate.weighted_kappa(same).first().kappa == 1.0
    one = spark.createDataFrame([(1, 1)], "a int, b int")
    assert annotate.weighted_kappa(one).first().kappa is None
    rng = random.Random(5)
    rows = [(rng.choice((0, 1, 2, 5)), rng.choice((0, 2, 3))) for _ in range(200)]
    labels = sorted({x for r in rows for x in r})
    o = np.zeros((len(labels), len(labels)))
    for a, b in rows:
        o[labels.index(a), labels.index(b)] += 1
    w = np.subtract.outer(np.arange(len(labels)), np.arange(len(labels))) ** 2
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    assert abs(annotate.weighted_kappa(spark.createDataFrame(rows, "a int, b int")).first().kappa - (1 - (w * o).sum() / (w * e).sum())) < 1e-12
    ann = spark.createDataFrame([(1, 1, 1, 1.0), (2, 1, 2, 5.0), (3, 2, 2, 4.0)], "id int, item_id int, annotator_id int, label double")
    who = spark.createDataFrame([(1, "a", 1.0), (2, "b", 0.0)], "id int, name string, reliability double")
    assert {r.item_id: r.weighted_label for r in annotate.weighted_means(ann, who).collect()} == {1: 1.0, 2: None}
    items = spark.createDataFrame([(1, 1.0), (2, 4.0)], "id int, gold_label double")
    got = {r.annotator_id: (r.n_gold, r.n_correct, r.reliability) for r in annotate.reliability_on_gold(ann, items).collect()}
    assert got == {1: (1, 1, 0.6), 2: (2, 1, 0.5)}


def test_queue(spark):
    rows = [(i, "a", "b", u, s) for i, (u, s) in enumerate([(0.1, "pending"), (0.9, "pending"), (None, "pending"), (0.5, "gold"), (0.7, "labeled")])]
    df = spark.createDataFrame(rows, "id int, sentence_a string, sentence_b string, uncertainty double, status string")
    assert [r.id for r in annotate.annotation_queue(df).collect()] == [1, 0, 2, 3]
    assert [r.id for r in annotate.annotation_queue(df, seen=spark.createDataFrame([(1,)], "id int")).collect()] == [0, 2, 3]


def test_retrieval(spark, monkeypatch):
    eye = [(-i - 1, [float(i == j) for j in range(3)], i) for i in range(3)]
    q = spark.createDataFrame(eye, "q int, v array<double>, positive int")
    d = spark.createDataFrame([(i, v) for _, v, i in eye], "doc int, v array<double>")
    got = {r.metric: r.value for r in retrieval.recall_mrr(retrieval.positive_ranks(q, d, 3), 3).collect()}
    assert got == {"retrieval_recall@3": 1.0, "retrieval_mrr@3": 1.0}
    back = spark.createDataFrame([(-i - 1, v, 2 - i if i != 1 else 0) for _, v, i in eye], "q int, v array<double>, positive int")
    assert {r.value for r in retrieval.recall_mrr(retrieval.positive_ranks(back, d, 1), 1).collect()} == {0.0}
    assert retrieval.recall_mrr(retrieval.positive_ranks(q.limit(0), d, 3), 3).count() == 0
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(0)
    m = rng.standard_normal((200, 6))
    docs = spark.createDataFrame([(i, m[i].tolist()) for i in range(200)], "doc int, v array<double>").repartition(4)
    got = {(r.q, r["rank"]): r.doc for r in retrieval.top_k(docs.filter("doc < 30").withColumnRenamed("doc", "q"), docs, 5).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(30):
        order = [j for j in np.lexsort((np.arange(200), -(u @ u[i]))) if j != i][:5]
        assert [got[i, r] for r in range(1, 6)] == order


def test_spearman_and_skew(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 8, 300).astype(float), rng.integers(0, 5, 300).astype(float)
    import pandas as pd

    want = pd.Series(x).rank().corr(pd.Series(y).rank())
    got = retrieval.spearman(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0)], "x double, y double"), "x", "y").first()
    assert got.n == 300 and abs(got.rho - want) < 1e-12
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "key int, v array<double>")
    assert tuple(retrieval.skew_check(a, a).first()) == (2, 0.0, True)
    b = spark.createDataFrame([(1, [1.0, 2.1]), (2, [0.0, 1.0])], "key int, v array<double>")
    assert not retrieval.skew_check(a, b).first().match
    assert not retrieval.skew_check(a, b.limit(1)).first().match


def test_status_from_the_log_and_new_rows(spark, tmp_path):
    from lexmill import schemas
    from lexmill.sources import files

    place = str(tmp_path)
    items = spark.createDataFrame([(1, "a", "b", 0.9, "pending", None), (2, "c", "d", 0.5, "labeled", None), (3, "e", "f", 0.1, "gold", 2.0)], schemas.ITEMS)
    assert files.append_rows(items, place, "items", schemas.ITEMS) == 3
    log = spark.createDataFrame([], schemas.ANNOTATIONS)
    assert files.append_rows(log, place, "annotations", schemas.ANNOTATIONS) == 0
    for label in (4.0, 5.0):  # queue -> label -> export
        stored = files.read_table(spark, place, "annotations")
        queue = annotate.annotation_queue(annotate.derived_status(files.read_table(spark, place, "items"), stored))
        first = queue.first()
        answers = spark.createDataFrame([(first.id, 7, label), (3, 7, 1.0)], "item_id int, annotator_id int, label double")
        assert files.append_rows(annotate.annotation_rows(answers, stored), place, "annotations", schemas.ANNOTATIONS) == 2
    stored = files.read_table(spark, place, "annotations")
    assert sorted(r.id for r in stored.collect()) == [1, 2, 3, 4] and stored.filter("created_at is null").count() == 0
    now = annotate.derived_status(files.read_table(spark, place, "items"), stored)
    assert {r.id: r.status for r in now.collect()} == {1: "labeled", 2: "labeled", 3: "gold"}
    scored = annotate.labelled_pairs(now, stored, None)
    assert {r.anchor for r in annotate.threshold_triplets(scored).collect()} == {"a"}
