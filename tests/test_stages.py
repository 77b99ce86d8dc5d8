import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill import schemas
from lexmill.functions import training as tr
from lexmill.operators import corpus, plugins, subword, tfidf
from lexmill.plans import pipeline
from lexmill.session import materialize, release, scratch_dir
from lexmill.sources import files
from lexmill.streaming import annotations as stream


def test_text_files(spark, tmp_path):
    p = tmp_path / "raw.txt"
    p.write_bytes(b"first line\r\n\nsecond \xe2\x82 line\n")
    rows = files.read_lines(spark, [str(p)]).orderBy("pos").collect()
    assert [r.text for r in rows][:2] == ["first line", ""] and "�" in rows[2].text
    assert files.nonblank(files.scan_lines(spark, [str(p)])).count() == 2
    with pytest.raises(Exception):
        files.read_lines(spark, [str(p)], strict=True).collect()
    with pytest.raises(files.MissingInput):
        files.require_inputs(spark, [str(tmp_path / "absent.txt")])
    (tmp_path / "empty.txt").touch()
    with pytest.raises(files.MissingInput):
        files.require_inputs(spark, [str(tmp_path / "empty.txt")])
    out = str(tmp_path / "out")
    assert files.write_corpus(spark.createDataFrame([(2, "b"), (1, "a")], "pos int, text string"), out, single_file=True) == 2
    assert [r.value for r in spark.read.text(out).collect()] == ["a", "b"]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "sts.jsonl"
    p.write_text('{"sentence_a": "x  y", "sentence_b": "ü", "score": 4}\n\n{"sentence_a": "a", "sentence_b": "b", "score": 5.0}\n')
    got = {r.sentence_a: r.score for r in files.read_sts(spark, str(p)).collect()}
    assert got == {"x y": 0.8, "a": 1.0}
    p.write_text('{"sentence_a": "x", "score": 4}\n')
    with pytest.raises(Exception, match="missing key"):
        files.read_sts(spark, str(p)).collect()
    out = str(tmp_path / "t")
    triplets = spark.createDataFrame([("ä", "b", "c")], schemas.TRIPLET)
    assert files.write_jsonl(triplets, out, schemas.TRIPLET) == 1
    assert files.read_triplets(spark, out).collect() == triplets.collect()
    emb = spark.createDataFrame([(f"t{i}", [1.0, 0.0]) for i in range(50)], schemas.EMBEDDING)
    files.write_jsonl(emb, str(tmp_path / "e"), schemas.EMBEDDING)
    assert files.read_head(spark, str(tmp_path / "e"), 10).count() == 10
    gold = files.gold_items(spark.createDataFrame([("a", "b", 3)], "sentence_a string, sentence_b string, score int")).first()
    assert gold.status == "gold" and gold.gold_label == 3.0


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert files.read_cache(spark, path).count() == 0
    files.append_cache(spark.createDataFrame([("k1", "v1"), ("k2", ""), ("k3", None)], "key string, value string"), path)
    files.append_cache(spark.createDataFrame([("k4", "v4")], "key string, value string"), path)
    assert {tuple(r) for r in files.read_cache(spark, path).collect()} == {("k1", "v1"), ("k4", "v4")}
    log = spark.createDataFrame([("a", "old", 1), ("a", "new", 2)], "key string, value string, n int")
    assert files.latest_values(log, F.col("n")).first().value == "new"


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"b": 1}}')
    assert files.read_config(str(tmp_path / "c.json")) == {"a": {"b": 1}}
    assert files.jdbc_url({"POSTGRES_HOST": "h", "POSTGRES_DB": "d"}) == "jdbc:postgresql://h:5432/d"
    gb = 1024**3
    files.check_free_space(50 * gb, 10)
    with pytest.raises(OSError):
        files.check_free_space(1 * gb, 5)
    with pytest.raises(OSError):
        files.check_free_space(10 * gb, 5, 8 * gb)


def test_documents_by_plug_in(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"page one|page two|")
    got = files.read_documents(spark, str(tmp_path / "*.pdf"), lambda data: [p.decode() or None for p in data.split(b"|")]).first()
    assert got.text == "page one\npage two\n"


def test_metrics(spark, tmp_path):
    df = spark.createDataFrame([("a", "spearman", 0.5), ("b", "spearman", 0.25)], schemas.METRICS)
    assert files.write_metrics(df, str(tmp_path / "m" / "x.json")) == {"spearman_a": 0.5, "spearman_b": 0.25}
    assert json.loads((tmp_path / "m" / "x.json").read_text())["spearman_b"] == 0.25


def upper():
    class Upper:  # local, so that it reaches the workers by value
        def tag(self, text):
            return [(t, t.lower(), "PROPN" if t[0].isupper() else "NUM" if t.isdigit() else "PRON" if t == "she" else "X") for t in text.split()]

    return Upper()


def test_tagger_rules(spark):
    tokens = [("Anna", "anna", "PROPN"), ("she", "she", "PRON"), ("7", "7", "NUM"), ("e.g.", "e.g.", "X"), (" ", " ", "SPACE"), ("Ran", "Run", "VERB"), ("abbr1", "z", "X"), ("U.S.", "u.s.", "PROPN"), ("3.5", "3.5", "NUM"), ("x", "X", None)]
    one = spark.createDataFrame([(tokens,), (None,), ([],)], "t array<struct<token:string,lemma:string,kind:string>>")
    assert [r.x for r in one.select(plugins.substituted(F.col("t")).alias("x")).collect()] == ["person1 pron1 ordinal1 abbr1 run abbr1 abbr1 ordinal1 x", None, ""]
    df = spark.createDataFrame([("Anna she 7 cats",)], "t string")
    assert df.select(plugins.token_prep(upper())("t").alias("x")).first().x == "person1 pron1 ordinal1 cats"
    assert plugins.token_prep(None)(F.col("t")) is not None


def echo(name, answer, fail=False):
    class Echo:
        def translate(self, text, source, target):
            if fail:
                raise OSError("down")
            return answer and f"{answer}{text}"

    Echo.name = name
    return Echo()


def test_back_translation(spark):
    texts = spark.createDataFrame([("x",), ("y",), ("x",)], "text string")
    empty = spark.createDataFrame([], schemas.CACHE)
    got, fresh = plugins.back_translate(texts, [echo("bad", "", True), echo("ok", "z")], "en", "ru", empty, max_retries=1)
    assert {tuple(r) for r in got.collect()} == {("x", "zzx"), ("y", "zzy")}
    assert fresh.count() == 2
    again, none = plugins.back_translate(texts, [echo("bad", None), echo("ok", None)], "en", "ru", fresh)
    assert {r.paraphrase for r in again.collect()} == {"zzx", "zzy"} and none.count() == 0
    assert plugins.rate_delay(20) == 3.0 and plugins.rate_delay(0) == 0.0 and plugins.rate_delay(60, 4) == 4.0


def test_back_translation_retries_and_keeps_what_it_has(spark, tmp_path):
    class Flaky:
        name = "flaky"

        def translate(self, text, source, target):
            import os

            n = sum(name.startswith(f"{text}-{target}-") for name in os.listdir(self.place))
            open(f"{self.place}/{text}-{target}-{n}", "w").close()
            if text == "bad":
                raise RuntimeError("an error of its own")
            return "" if n < 2 else f"{text}!"

    local = type("Local", (), dict(Flaky.__dict__))  # by value
    p = local()
    p.place = str(tmp_path)
    texts, empty = spark.createDataFrame([("x",), ("bad",)], "text string").coalesce(1), spark.createDataFrame([], schemas.CACHE)
    cache = str(tmp_path.parent / f"{tmp_path.name}-cache")
    got, fresh = plugins.back_translate(texts, [p], "en", "ru", empty, max_retries=6, cache_path=cache, chunk=1)
    assert {tuple(r) for r in got.collect()} == {("x", "x!!"), ("bad", None)}  # asked again after empty answers
    assert fresh.count() == 1 and files.read_cache(spark, cache).count() == 1

    class Wrong:
        name = "wrong"

        def translate(self, text, source, target):
            raise ValueError("unknown provider")

    with pytest.raises(Exception, match="unknown provider"):
        plugins.back_translate(texts, [type("W", (), dict(Wrong.__dict__))()], "en", "ru", empty)


def test_lines_keep_the_order_of_the_list(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        for name, n in (("b.txt", 40), ("a.txt", 30)):
            (tmp_path / name).write_text("".join(f"{name} line {i}\n" for i in range(n)))
        got = files.read_lines(spark, [str(tmp_path / "b.txt"), str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
        assert got.rdd.getNumPartitions() >= 1
        rows = got.orderBy("file", "pos").collect()
        assert [r.text for r in rows] == [f"{n} line {i}" for n, k in (("b.txt", 40), ("a.txt", 30), ("b.txt", 40)) for i in range(k)]
        assert [r.pos for r in rows] == [*range(40), *range(30), *range(40)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert files.read_lines(spark, []).count() == 0


def test_paths_settings_and_counts(spark, tmp_path):
    assert files.resolve("x/y", "/root/") == "/root/x/y" and files.resolve("/x", "/r") == "/x" and files.resolve("s3a://b/x", "/r") == "s3a://b/x"
    files.write_config(spark, str(tmp_path / "c.yaml"), {"a": {"b": [1, "ü"]}})
    assert files.read_config(str(tmp_path / "c.yaml")) == {"a": {"b": [1, "ü"]}}
    none = spark.createDataFrame([], schemas.TRIPLET)
    assert files.write_jsonl(none, str(tmp_path / "none"), schemas.TRIPLET) == 0


def test_encode(spark):
    df = spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, None)], "id int, t string")
    got = {r.id: r.embedding for r in plugins.encode(df, plugins.HashedWords(16), "t").collect()}
    assert got[1] == got[2] and abs(np.linalg.norm(got[1]) - 1) < 1e-5 and got[3] is None


def test_tfidf(spark):
    docs = spark.createDataFrame([(1, "red cat red"), (2, "red dog"), (3, "")], "doc_id int, text string")
    got = {(r.doc_id, r.term): r.weight for r in tfidf.weights(docs).collect()}
    idf = lambda df: np.log(4 / (1 + df)) + 1
    v = np.array([2 * idf(2), idf(1)])
    assert abs(got[1, "red"] - v[0] / np.linalg.norm(v)) < 1e-12
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "i int, j int")
    cos = {(r.i, r.j): r.cosine for r in tfidf.pair_cosines(tfidf.weights(docs), pairs).collect()}
    assert 0 < cos[1, 2] < 1 and cos[1, 3] == 0.0


def test_latent_space(spark):
    rng = np.random.default_rng(3)
    topics = [["cat", "dog", "pet", "fur"], ["sun", "sky", "rain", "wind"], ["bread", "milk", "egg", "salt"]]
    texts = [" ".join(rng.choice(topics[i % 3], 12)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    space = tfidf.LatentSpace(docs, k=3, features=256)
    v = {r.doc_id: np.array(r.v) for r in space.encode().collect()}
    assert v[0] @ v[3] > 0.9 and abs(v[0] @ v[1]) < 0.2
    scored = tfidf.lsa_scored_pairs(docs, 20, k=3, features=256).collect()
    assert len(scored) == 20 and all(0 <= r.score <= 5 for r in scored)
    alone = spark.createDataFrame([(i, "one one") for i in range(5)], "doc_id long, text string")
    assert tfidf.lsa_scored_pairs(alone, 5).count() == 0
    assert tfidf.components(100, 5, 3) == 2


def test_subword(spark):
    docs = spark.createDataFrame([("ab, ab ﬁ",), (None,)], "text string")
    assert {r.token: r.n for r in subword.pretoken_counts(docs).collect()} == {"ab": 2, ",": 1, "fi": 1}
    assert {r.ch: r.n for r in subword.alphabet(docs).collect()} == {"a": 2, "b": 2, ",": 1, "ﬁ": 1}
    import os

    if os.path.exists(subword.TOKENIZER):
        d = subword.tokenizer_diagnostics(docs).first()
        assert d.words == 3 and d.tokens >= 3 and d.unknown == 0
        assert subword.require_coverage(subword.tokenizer_diagnostics(docs)) == 0
    with pytest.raises(subword.TooManyUnknown):
        subword.require_coverage(spark.createDataFrame([(0.5,)], "unk_rate double"))


def test_streaming(spark, tmp_path):
    import datetime as dt

    rows = [(i, i % 4, i % 3, float(i % 6), dt.datetime(2025, 1, 1, i % 24)) for i in range(60)] + [(60, 1, 1, None, None)]
    df = spark.createDataFrame(rows, schemas.ANNOTATIONS)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    src = stream.read_annotations(spark, str(tmp_path / "in"))
    stream.upsert_means(src, str(tmp_path / "out"), str(tmp_path / "s1")).awaitTermination()
    want = {tuple(r) for r in df.filter("label is not null").groupBy("item_id").agg(F.count("*"), F.avg("label")).collect()}
    assert {tuple(r) for r in stream.latest_means(spark, str(tmp_path / "out")).collect()} == want
    means = stream.run_to_end(stream.running_means(src), "means_now", str(tmp_path / "s2"))
    assert {tuple(r) for r in means.collect()} == want
    hourly = stream.run_to_end(stream.hourly_counts(src, "10 days"), "hourly", str(tmp_path / "s3"), "append")
    assert set(hourly.columns) == {"hour", "annotator_id", "n"}


def test_pipeline_reuses_stages(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one line of text here now\nheld out sentence"), (2, "one line of text here now\nsome other words stand here")], "doc_id long, text string")
    sts = spark.createDataFrame([(1, "held out sentence", "zz", 3)], "test_id int, sentence_a string, sentence_b string, score int")
    items = spark.createDataFrame([(i, f"a{i}", f"b{i}", 0.1, "labeled", None) for i in range(4)], schemas.ITEMS)
    ann = spark.createDataFrame([(i, i, 1, float(i + 1), None) for i in range(4)], schemas.ANNOTATIONS)
    places = {}
    for name, df in {"documents": docs, "en_sts_test": sts, "items": items, "annotations": ann}.items():
        places[name] = str(tmp_path / name)
        df.write.parquet(places[name])
    first = pipeline.Pipeline(spark, str(tmp_path / "work"), places)
    t = first.run(pipeline.DEFAULT)
    assert first.ran == ["corpus", "embeddings", "triplets"]
    assert {r.text for r in t["corpus"].collect()} == {"one line of text here now", "some other words stand here"}
    assert t["embeddings"].count() == 2 and t["triplets"].count() >= 1
    assert pipeline.export_triplets(t["triplets"], str(tmp_path / "triplets")) == t["triplets"].count()
    second = pipeline.Pipeline(spark, str(tmp_path / "work"), places)
    second.run(pipeline.DEFAULT)
    assert second.ran == []
    # a source that changes behind its path runs its stages again, wherever the path lies
    before = files.fingerprint(spark, places["items"])
    assert files.fingerprint(spark, f"file:{places['items']}") != files.fingerprint(spark, "file:/nowhere")
    items.limit(3).write.mode("append").parquet(places["items"])
    assert files.fingerprint(spark, places["items"]) != before
    third = pipeline.Pipeline(spark, f"file:{tmp_path}/work", {k: f"file:{v}" for k, v in places.items()})
    third.run(pipeline.DEFAULT)
    assert "triplets" in third.ran
    changed = [pipeline.Stage("triplets", pipeline.triplet_stage, ("items", "annotations"), {"upper": 0.6, "lower": 0.3})]
    second.run(changed)
    assert second.ran == ["triplets"]


def test_command_line(spark, tmp_path):
    import os

    tables = "/root/testdata/sf0.001"
    if not (os.path.isdir(tables) and os.path.exists(subword.TOKENIZER)):
        pytest.skip("no test tables or tokenizer files")
    options = ["--tables", tables, "--work", str(tmp_path / "w"), "--export", str(tmp_path / "out")]
    assert pipeline.main(options) == ["tokenizer", "corpus", "embeddings", "triplets", "evaluation"]
    assert set(json.loads((tmp_path / "out" / "metrics.json").read_text())) == {"spearman_a", "retrieval_recall@10_a", "retrieval_mrr@10_a"}
    assert files.read_triplets(spark, str(tmp_path / "out" / "triplets")).count() > 0 and spark.read.text(str(tmp_path / "out" / "corpus")).count() > 0
    assert pipeline.main(options) == []


def test_evaluate(spark):
    rows = [(i, f"word{i} common", f"word{i} common other", i / 10) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, sentence_a string, sentence_b string, score double")
    got = {r.metric: r.value for r in pipeline.evaluate(df, plugins.HashedWords(512), k=3).collect()}
    assert got["retrieval_recall@3"] == 1.0 and got["retrieval_mrr@3"] <= got["retrieval_recall@3"] and set(got) == {"spearman", "retrieval_recall@3", "retrieval_mrr@3"}


def test_branches_guard_and_svd_evaluation(spark, tmp_path):
    rows = [(i, f"word{i} common", f"word{i} common other", i / 10) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, sentence_a string, sentence_b string, score double")
    got = pipeline.evaluate_branches(df, {"a": plugins.HashedWords(256), "gone": None, "b": plugins.HashedWords(64)}, k=3)
    assert {r.branch for r in got.collect()} == {"a", "b"} and pipeline.evaluate_branches(df, {"x": None}).count() == 0
    leak = spark.createDataFrame([("train.txt", "word3  common")], "path string, text string")
    with pytest.raises(corpus.Leakage, match="train.txt"):
        pipeline.evaluate_branches(df, {"a": plugins.HashedWords(64)}, [leak])
    lines = spark.createDataFrame([(d, p, f"topic{d % 3} word{p % 4} again topic{d % 3} here") for d in range(12) for p in range(3)], "doc_id long, pos long, text string")
    metrics = pipeline.svd_evaluation(lines, {"a": plugins.HashedWords(64)}, n=40, components=4, metrics_path=str(tmp_path / "m.json"))
    assert {r.metric for r in metrics.collect()} == {"spearman", "retrieval_recall@5", "retrieval_mrr@5"}
    assert set(json.loads((tmp_path / "m.json").read_text())) == {"spearman_a", "retrieval_recall@5_a", "retrieval_mrr@5_a"}


def test_silver_set(spark):
    lines = spark.createDataFrame([(1, i, f"line {i}") for i in range(12)], "doc_id int, pos long, text string")
    made, tiers = pipeline.silver_set(lines, [echo("down", "", True), echo("ok", "z")], "en", "ru", spark.createDataFrame([], schemas.CACHE), n=9)
    assert {r.score: r.n for r in tiers.collect()} == {4.8: 3, 2.0: 3, 0.3: 3} and made.count() == 9
    failed, tiers = pipeline.silver_set(lines, [echo("down", "", True)], "en", "ru", spark.createDataFrame([], schemas.CACHE), n=9)
    assert {r.score for r in tiers.collect()} == {2.0, 0.3}


def test_seed_items(spark):
    lines = spark.createDataFrame([(1, i, f"line {i} of {i % 3}") for i in range(30)], "doc_id int, pos long, text string")
    got = pipeline.seed_items(lines, plugins.HashedWords(64), n=10, n_random=40, max_reuse=2).collect()
    texts = [t for r in got for t in (r.sentence_a, r.sentence_b)]
    assert len(got) == 10 and max(texts.count(t) for t in texts) <= 2 and {r.status for r in got} == {"pending"}
    assert [r.uncertainty for r in got] == sorted((r.uncertainty for r in got), reverse=True)
    assert pipeline.seed_items(lines.limit(1), plugins.HashedWords(8)).count() == 0


def test_triplets_by_method(spark):
    lines = spark.createDataFrame([(d, p, f"topic{d % 3} word{p % 4} again topic{d % 3} here") for d in range(12) for p in range(3)], "doc_id long, pos long, text string")
    items = spark.createDataFrame([(i, f"a{i}", f"b{i}", 0.1, "labeled", None) for i in range(10)], schemas.ITEMS)
    ann = spark.createDataFrame([(i, i, 1, float(i % 6), None) for i in range(10)], schemas.ANNOTATIONS)
    for method in ("svd", "backtranslation", "native"):
        got = pipeline.triplets_by(method, lines, items, ann, 30)
        assert got.count() > 0 and got.columns == ["anchor", "positive", "negative"]
    with pytest.raises(ValueError, match="no triplets"):
        pipeline.triplets_by("native", lines, items, ann.limit(0))
    with pytest.raises(ValueError, match="unknown"):
        pipeline.triplets_by("other", lines, items, ann)


def test_embeddings_sink_and_training_arithmetic(spark, tmp_path):
    df = plugins.encode(spark.createDataFrame([("a",), ("b",)], "text string"), plugins.HashedWords(4))
    assert files.write_embeddings(df, str(tmp_path / "e")) == 2
    with pytest.raises(OSError):
        files.write_embeddings(df, str(tmp_path / "f"), free_bytes=10, min_free_gb=1)
    assert not (tmp_path / "f").exists()
    assert tr.calibrated_steps(10, 25, 15.0) == 1000 and tr.calibrated_steps(1, 1, 600.0) == 50
    assert tr.triplet_warmup(10) == 1 and tr.triplet_warmup(100_000) == 100 and tr.ratio_warmup(100, 2, 0.1) == 20
    assert tr.pooling_mode("decoder") == "lasttoken" and tr.pooling_mode("?") == "mean"


def test_materialize(spark):
    t = materialize(spark.range(5), "x")
    assert t.count() == 5 and "/lexmill-" in t.inputFiles()[0] and scratch_dir(spark) in t.inputFiles()[0]
    release(t)
    with pytest.raises(Exception):
        t.collect()
