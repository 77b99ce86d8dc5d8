import random

import numpy as np

from lexmill.llm import leak as L

DOCS = "doc_id long, text string, ids int, test int"
TESTS = "test_id int, sentence_a string, sentence_b string, doc_id string"
NOUNS = "courier canal bridge lantern harbor teacher museum parade siren pilot".split()
VERBS = "studied praised buried folded rescued counted".split()


def sentence(rng):
    return f"The {rng.choice(NOUNS)} beside the {rng.choice(NOUNS)} {rng.choice(VERBS)} {rng.choice(['four', 'nine'])} {rng.choice(NOUNS)}s near the {rng.choice(NOUNS)} at dawn."


def brute(docs, tests, n=8):
    out = set()
    for d, text, *_ in docs:
        have = " " + " ".join(L.words_of(text or "")) + " "
        for t, a, b, _ in tests:
            for s in (a, b):
                ws = L.words_of(s or "")
                if any(" " + " ".join(ws[k : k + n]) + " " in have for k in range(len(ws) - n + 1)):
                    out.add((d, t))
    return out


def run(spark, docs, tests):
    d, t = spark.createDataFrame(docs, DOCS), spark.createDataFrame(tests, TESTS)
    return {tuple(r) for r in L.leaked_passages(d, t).collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    tests = [(i, sentence(rng), sentence(rng), "x") for i in range(30)] + [(30, None, "too short", "x"), (31, "", " ", "x")]
    docs = []
    for i in range(120):
        words = sentence(rng).split() + [w for _ in range(3) for w in rng.choice(["unseen words here", sentence(rng), "кот"]).split()]
        if i % 3 == 0:
            s = rng.choice(tests[:30])[1].split()
            k = rng.randrange(0, 4)
            words[5:5] = s[k : k + rng.choice((7, 8, 12))]
        docs.append((i, " ".join(words), 0, 0))
    docs += [(500, None, 0, 0), (501, "", 0, 0), docs[0], docs[0]]
    want = brute(docs, tests)
    assert want and run(spark, docs, tests) == want


def test_case_punctuation_breaks_and_lookalikes(spark):
    tests = [(1, "The tired courier beside the frozen canal studied four clay pipes.", None, "x")]
    good = [
        "…the TIRED courier, beside\nthe frozen — canal (studied) four clay…",
        "tired cou-\nrier beside the fro­zen canal studied four clay",
        "Ｔhe tirеd couri​er beside the frozen canal studied x",
    ]
    bad = ["the tired courier beside the old frozen canal studied four", "tired the courier beside the frozen canal studied"]
    docs = [(i, t, 0, 0) for i, t in enumerate(good + bad)]
    assert run(spark, docs, tests) == {(0, 1), (1, 1), (2, 1)}


def test_empty_tables_and_blocks(spark, monkeypatch):
    rng = random.Random(4)
    tests = [(i, sentence(rng), sentence(rng), "x") for i in range(12)]
    docs = [(i, tests[i][1] + " " + tests[i][2], 0, 0) for i in range(12)]
    assert run(spark, [], tests) == set()
    assert run(spark, docs, []) == set()
    monkeypatch.setattr(L, "BLOCK", 50)
    assert run(spark, docs, tests) == brute(docs, tests)


def report(spark, docs, tests, **options):
    return {tuple(r) for r in L.leak_report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(tests, TESTS), **options).collect()}


def test_report_kinds(spark):
    a = "The tired courier beside the frozen canal studied four clay pipes although nobody asked"
    tests = [(1, a, "The museum guide praised three old maps when the siren stopped", "x"), (2, "Six gulls sat on the wall of the old ferry station", None, "x")]
    docs = [
        (1, a, 0, 0), (2, "beside the frozen canal the tired courier studied four clay pipes although nobody asked", 0, 0), (3, "nothing", 0, 0),
        (4, "кот пёс the tired courier beside the frozen canal studied кот пёс", 0, 0), (5, "tired courier beside the frozen canal studied", 0, 0),
    ]
    got = {(r[0], r[1], r[2]): (r[5], r[4]) for r in report(spark, docs, tests)}
    assert got == {
        (1, 1, "sentence_a"): ("whole", 1.0), (2, 1, "sentence_a"): ("reworded", round(11 / 14, 6)), (4, 1, "sentence_a"): ("part", round(8 / 14, 6)),
    }


def test_report_finds_rewordings_with_foreign_words(spark):
    a = "The tired courier beside the frozen canal studied four clay pipes although nobody asked the pilot"
    b = "Six gulls watched trams"  # shorter than the window of exact copies
    tests = [(1, a, b, "x"), (2, "The museum guide praised the old maps beside the siren although the parade stopped", None, "x")]
    changed = "Some tired courier near the frozen canal studied four clay pipes while nobody asked that pilot"
    docs = [
        (1, f"кот пёс {changed} кот пёс", 0, 0), (2, changed, 0, 0), (3, f"кот {b} пёс", 0, 0), (4, "кот Six пёс watched кот trams", 0, 0),
        (5, "кот Some tired courier near the кот пёс пёс кот studied four while nobody asked that pilot", 0, 0), (6, f"кот {a} пёс", 0, 0),
        *[(i, "the old maps beside the parade although the museum guide praised the siren beside the parade", 0, 0) for i in range(10, 20)],
    ]
    got = {(r[0], r[2]): (r[5], r[4]) for r in report(spark, docs, tests) if r[1] == 1}
    assert got == {
        (1, "sentence_a"): ("reworded", 0.75), (2, "sentence_a"): ("reworded", 0.75), (3, "sentence_b"): ("whole", 1.0), (6, "sentence_a"): ("whole", 1.0),
    }


def changed(rng, words, kind, i):
    w, p = list(words), rng.randrange(len(words) - 1)
    if kind == "replaced":
        w[p] = f"newword{i}"
    elif kind == "inserted":
        w.insert(p, f"newword{i}")
    elif kind == "dropped":
        w.pop(p)
    else:
        w[p], w[p + 1] = w[p + 1], w[p]
    return " ".join(w)


def test_report_recall_and_blocks(spark, monkeypatch):
    rng = random.Random(6)
    # every sentence has names of its own, as held-out sentences have
    tests = [(i, sentence(rng).replace("beside", f"of Port {i} beside"), sentence(rng), "x") for i in range(60)]
    kinds = ("replaced", "inserted", "dropped", "swapped")
    docs = [(i * 10 + k, f"{sentence(rng)} {changed(rng, tests[i][1].split(), kind, i)} {sentence(rng)}", 0, 0) for i in range(60) for k, kind in enumerate(kinds)]
    docs += [(1000 + i, f"кот {' '.join(tests[i][1].split()[2:11])} пёс", 0, 0) for i in range(60)]
    got = report(spark, docs, tests)
    for k, _ in enumerate(kinds):
        assert sum((i * 10 + k, i) in {r[:2] for r in got} for i in range(60)) >= 0.9 * 60
    assert run(spark, docs, tests) == brute(docs, tests) <= {r[:2] for r in got}
    monkeypatch.setattr(L, "BLOCK", 50)
    monkeypatch.setattr(L, "LOAD", 64)
    monkeypatch.setattr(L, "CHUNK", 16)
    assert report(spark, docs, tests) == got and run(spark, docs, tests) == brute(docs, tests)


def test_long_test_texts(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(500)}" for _ in range(900)]
    docs = [(1, " ".join(words), 0, 0), (2, " ".join(words[300:420]), 0, 0), (3, " ".join(words[700:707]), 0, 0)]
    tests = [(1, " ".join(words), None, "x")]
    assert run(spark, docs, tests) == {(1, 1), (2, 1)} == {r[:2] for r in report(spark, docs, tests)}


def test_covered_stretches():
    rng = np.random.default_rng(5)
    for _ in range(300):
        ids = np.where(rng.random(rng.integers(1, 30)) < 0.6, 1, 0)
        least = {int(n): L._least_common(int(n), 0.75) for n in rng.integers(1, 12, 3)}
        want = set()
        for n, need in least.items():
            w = min(n, len(ids))
            want |= {i for a in range(len(ids) - w + 1) if (ids[a : a + w] != 0).sum() >= need for i in range(a, a + w)}
        want |= {i for a in range(len(ids) - 4) if (ids[a : a + 5] != 0).all() for i in range(a, a + 5)}
        assert {i for a, b in L._covered(ids, least, 5) for i in range(a, b)} == want


def test_svd_equals_numpy(spark):
    rng = np.random.default_rng(2)
    names = np.array([L.word_id(f"w{k}") for k in range(40)])
    rows = [names[rng.choice(40, size=8, p=np.arange(1, 41) / 820)].tolist() for _ in range(300)]
    space = L.Space(spark.createDataFrame([(r,) for r in rows], "ids array<long>").repartition(3), spark.createDataFrame([(names.tolist(),)], "ids array<long>"), rank=5)
    column = {int(w): int(space.places[L._column(w)]) for w in names}
    a = np.zeros((300, space.m))
    for i, r in enumerate(rows):
        for w in r:
            a[i, column[w]] += space.idf[column[w]]
    df = (a > 0).sum(axis=0)
    np.testing.assert_allclose(space.idf, np.log(301 / (1 + df)) + 1)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    exact = np.linalg.svd(a, full_matrices=False)[1][:5]
    np.testing.assert_allclose(np.linalg.norm(a @ space.vectors, axis=0), exact, rtol=0.02)


def test_common_lengths():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = np.random.default_rng(1)
    for width in (1, 7, 30, 64):
        n = rng.integers(1, width + 1, 50)
        want = np.where(np.arange(width) < n[:, None], rng.integers(1, 9, (50, width)), -1)
        have = rng.integers(0, 9, (50, 40))
        assert L._common_lengths(want, n, have).tolist() == [slow(w[:k], h) for w, k, h in zip(want.tolist(), n, have.tolist(), strict=True)]
