"""Registry of the engine's own queries and, where SQL can express them, their DuckDB counterparts.

Every query runs over its whole tables; a limit stands only where it is the feature (samples, top-k, queues).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.functions import vector as vx
from lexmill.operators import annotate, corpus, dedup, pairs, plugins, retrieval, sample, subword, tfidf
from lexmill.plans import pipeline, sql
from lexmill.session import materialize, scratch_dir, spread
from lexmill.sources import files
from lexmill.streaming import annotations as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return files.read_table(spark, sf_dir, name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_lines(_docs(spark, sf_dir))


# ---- corpus


@query(f"WITH {sql.LINES} SELECT doc_id, pos, text FROM lines")
def corpus_lines(spark, d):
    return _lines(spark, d)


@query(f"WITH {sql.LINES} SELECT lower(lang) AS lang, count(*) AS lines, sum(length(text))::BIGINT AS chars FROM lines GROUP BY 1")
def corpus_stats_by_lang(spark, d):
    with_lang = corpus.corpus_lines(_docs(spark, d).withColumn("doc_id", F.struct("doc_id", F.lower("lang").alias("lang"))))
    return with_lang.groupBy(F.col("doc_id.lang").alias("lang")).agg(F.count("*").alias("lines"), F.sum(F.char_length("text")).alias("chars"))


@query(f"WITH {sql.LINES} SELECT doc_id, pos, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, pos) AS rn FROM lines) WHERE rn = 1")
def corpus_exact_dedup(spark, d):
    return corpus.first_of_equal(_lines(spark, d), "doc_id", "pos")


@query(f"WITH {sql.SENTENCES} SELECT doc_id, pos, text FROM sentences")
def sentences_split(spark, d):
    return corpus.corpus_sentences(_docs(spark, d))


@query(
    f"""WITH raw AS (SELECT source, unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS line FROM documents WHERE text IS NOT NULL)
    SELECT source, count(*) AS lines, count_if({sql.strip('line')} = '') AS blank, count_if(regexp_full_match({sql.strip('line')}, '\\p{{Nd}}+')) AS junk,
    count_if(length({sql.strip('line')}) < 20) AS short FROM raw GROUP BY source"""
)
def line_kinds_by_source(spark, d):
    raw = _docs(spark, d).select("source", F.explode(F.split("text", tx.LINE_BREAK)).alias("line"))
    s = tx.strip("line")
    return raw.groupBy("source").agg(
        F.count("*").alias("lines"), F.count_if(s == "").alias("blank"), F.count_if(tx.is_junk_line("line")).alias("junk"), F.count_if(F.char_length(s) < tx.MIN_SENTENCE).alias("short")
    )


@query(f"WITH {sql.SENTENCES}, {sql.HELD_OUT} SELECT doc_id, pos, text FROM (SELECT doc_id, pos, {sql.normalize('text')} AS text FROM sentences) JOIN held_out USING (text)")
def leakage_hits(spark, d):
    sentences = corpus.corpus_sentences(_docs(spark, d)).withColumn("text", tx.normalize("text"))
    return corpus.leaked(sentences, table(spark, d, "en_sts_test"))


@query(
    f"""WITH {sql.LINES}, {sql.HELD_OUT} SELECT source, count(*) AS lines, count(h.text) AS leaked FROM lines l LEFT JOIN held_out h ON h.text = l.text GROUP BY source"""
)
def leakage_count_by_source(spark, d):
    docs = _docs(spark, d).withColumn("doc_id", F.struct("doc_id", "source"))
    hashed = corpus.corpus_lines(docs).select(F.col("doc_id.source").alias("source"), F.sha1("text").alias("h"))
    test = corpus.held_out_hashes(table(spark, d, "en_sts_test")).withColumn("leak", F.lit(1))
    return hashed.join(test, "h", "left").groupBy("source").agg(F.count("*").alias("lines"), F.count("leak").alias("leaked"))


@query(f"WITH {sql.LINES}, {sql.HELD_OUT} SELECT doc_id, pos, text FROM lines WHERE text NOT IN (SELECT text FROM held_out)")
def leakage_clean(spark, d):
    return corpus.without_leaks(_lines(spark, d), table(spark, d, "en_sts_test"))


# ---- near-duplicates


@query(f"WITH {sql.DISTINCT_TEXTS}, {sql.SHINGLES} SELECT id, count(*) AS shingles FROM shingles GROUP BY id")
def shingle_counts(spark, d):
    return dedup.distinct_texts(_docs(spark, d), "doc_id", "text").select("id", F.size(tx.shingles("text")).cast("long").alias("shingles"))


@query(f"WITH {sql.DISTINCT_TEXTS}, {sql.SHINGLES} SELECT s, count(*) AS df FROM shingles GROUP BY s ORDER BY df DESC, s LIMIT 50")
def shingle_df_top(spark, d):
    texts = dedup.distinct_texts(_docs(spark, d), "doc_id", "text")
    return texts.select(F.explode(tx.shingles("text")).alias("s")).groupBy("s").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "s").limit(50)


@query(
    f"""WITH {sql.DISTINCT_TEXTS}, {sql.SHINGLES}, sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
    common AS (SELECT a.id AS i, b.id AS j, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)
    SELECT i, j, round(c / (x.n + y.n - c), 6) AS jaccard FROM common JOIN sizes x ON x.id = i JOIN sizes y ON y.id = j WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9"""
)
def near_dup_pairs_jaccard(spark, d):
    return dedup.jaccard_pairs(_docs(spark, d)).select("i", "j", F.round("jaccard", 6).alias("jaccard"))


@query(f"SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS class_id FROM (SELECT doc_id, {sql.normalize('text')} AS t FROM documents) WHERE t <> ''")
def near_dup_classes(spark, d):
    """Membership of documents in classes of equal normalised texts; pairs are between classes."""
    keyed = _docs(spark, d).select("doc_id", tx.normalize("text").alias("t")).filter("t <> ''").select("doc_id", F.sha2("t", 256).alias("k"))
    return keyed.join(keyed.groupBy("k").agg(F.min("doc_id").alias("class_id")), "k").select("doc_id", "class_id")


@query(
    f"""WITH RECURSIVE {sql.DISTINCT_TEXTS}, {sql.SHINGLES}, sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
    common AS (SELECT a.id AS i, b.id AS j, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
    edges AS MATERIALIZED (SELECT i, j FROM common JOIN sizes x ON x.id = i JOIN sizes y ON y.id = j WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
    later AS MATERIALIZED (SELECT j, list(i) AS before, row_number() OVER (ORDER BY j) AS rn FROM edges GROUP BY j),
    scan AS (SELECT 0::BIGINT AS rn, []::BIGINT[] AS dropped UNION ALL
      SELECT l.rn, CASE WHEN len(list_filter(l.before, lambda x: NOT list_contains(s.dropped, x))) > 0 THEN list_append(s.dropped, l.j) ELSE s.dropped END FROM scan s JOIN later l ON l.rn = s.rn + 1)
    SELECT id AS doc_id FROM texts WHERE id NOT IN (SELECT unnest(dropped) FROM (SELECT dropped FROM scan ORDER BY rn DESC LIMIT 1))"""
)
def dedup_greedy_exact(spark, d):
    return dedup.dedup(_docs(spark, d)).select("doc_id")


@query()
def dedup_lsh(spark, d):
    return dedup.dedup(_docs(spark, d), exact=False).select("doc_id")


# ---- sampling and pairs


@query("SELECT doc_id, source FROM documents ORDER BY sha1('42|' || doc_id), doc_id LIMIT 500")
def sample_bottom_k(spark, d):
    return sample.sample_rows(_docs(spark, d).select("doc_id", "source"), 500, 42, "doc_id")


@query(f"WITH {sql.INDEXED}, {sql.random_pairs(1000, 11)} SELECT pair, a, b FROM random_pairs")
def random_pairs(spark, d):
    return sample.random_pairs(_lines(spark, d), 1000, 11, "doc_id", "pos")


_NEXT = "next_lines AS (SELECT doc_id, pos, text AS a, lead(text) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM lines)"


@query(f"WITH {sql.LINES}, {_NEXT} SELECT doc_id, pos, a, b FROM next_lines WHERE b IS NOT NULL")
def adjacent_line_pairs(spark, d):
    return corpus.adjacent_pairs(_lines(spark, d))


@query(f"WITH {sql.INDEXED}, {_NEXT}, {sql.random_pairs(300, 5)} SELECT 'adjacent' AS kind, a, b FROM next_lines WHERE b IS NOT NULL UNION ALL SELECT 'random', a, b FROM random_pairs")
def candidate_pool(spark, d):
    return pairs.candidate_pool(_lines(spark, d), 300, 5)


@query(
    f"""WITH {sql.INDEXED}, {_NEXT}, {sql.random_pairs(100, 9)},
    tiers AS ((SELECT a, b, 2.0::DOUBLE AS score FROM next_lines WHERE b IS NOT NULL ORDER BY sha1('9a|' || doc_id || '|' || pos), doc_id, pos LIMIT 100)
              UNION ALL SELECT a, b, 0.3::DOUBLE FROM random_pairs)
    SELECT a AS sentence_a, b AS sentence_b, score FROM tiers"""
)
def silver_pairs_tiers(spark, d):
    return pairs.silver_pairs(_lines(spark, d), 300, 9)


@query("SELECT sentence_a AS a, sentence_a AS b FROM items")
def simcse_pairs(spark, d):
    return pairs.simcse_pairs(table(spark, d, "items").select(F.col("sentence_a").alias("text")))


def _capped(ordered: str, n: int, most: int = 2) -> str:
    """CTE ``taken(list of pairs)``: a pass over ordered(rn, pair, a, b) that skips pairs whose texts are used up."""
    used = "len(list_filter(g.used, lambda x: x = o.{0}))"
    ok = f"{used.format('a')} < {most} AND {used.format('b')} < {most}"
    return f"""g AS (SELECT 0::BIGINT AS rn, []::VARCHAR[] AS used, []::BIGINT[] AS pairs UNION ALL
      SELECT o.rn, CASE WHEN {ok} THEN list_concat(g.used, [o.a, o.b]) ELSE g.used END, CASE WHEN {ok} THEN list_append(g.pairs, o.pair) ELSE g.pairs END
      FROM g JOIN {ordered} o ON o.rn = g.rn + 1 WHERE len(g.pairs) < {n}),
    taken AS (SELECT unnest(pairs) AS pair FROM (SELECT pairs FROM g ORDER BY rn DESC LIMIT 1))"""


@query(
    f"""WITH RECURSIVE o AS MATERIALIZED (SELECT id::BIGINT AS pair, sentence_a AS a, sentence_b AS b, uncertainty AS score, row_number() OVER (ORDER BY uncertainty DESC, id) AS rn
      FROM items WHERE uncertainty IS NOT NULL AND sentence_a IS NOT NULL AND sentence_b IS NOT NULL), {_capped('o', 200)}
    SELECT pair, a, b, round(score, 6) AS score FROM o WHERE pair IN (SELECT pair FROM taken)"""
)
def select_pairs_capped(spark, d):
    items = table(spark, d, "items").filter("uncertainty is not null")
    pool = items.select(F.col("id").cast("long").alias("pair"), F.col("sentence_a").alias("a"), F.col("sentence_b").alias("b"), F.col("uncertainty").alias("score"))
    return pairs.select_capped(pool, 200).withColumn("score", F.round("score", 6))


_HASH = "('0x' || substr(sha1(w), 1, 16))::UBIGINT"


@query(
    f"""WITH RECURSIVE {sql.LINES}, pool AS MATERIALIZED (SELECT text, row_number() OVER (ORDER BY doc_id, pos) - 1 AS idx
      FROM (SELECT * FROM lines ORDER BY sha1('42|' || doc_id || '|' || pos), doc_id, pos LIMIT 5000)),
    places AS (SELECT pair, {sql.hash_number("42i", "pair")} % n AS i, {sql.hash_number("42j", "pair")} % (n - 1) AS shift, n FROM (SELECT unnest(range(400)) AS pair), (SELECT count(*) AS n FROM pool)),
    candidates AS MATERIALIZED (SELECT a.idx AS pair, a.text AS a, b.text AS b FROM pool a JOIN pool b ON b.idx = a.idx + 1
      UNION ALL SELECT pair + 5000, a.text, b.text FROM places JOIN pool a ON a.idx = i JOIN pool b ON b.idx = (i + 1 + shift) % places.n),
    vectors AS MATERIALIZED (SELECT text, h % 64 AS x, sum(CASE WHEN h >= 9223372036854775808 THEN 1 ELSE -1 END)::DOUBLE AS v
      FROM (SELECT text, {_HASH} AS h FROM (SELECT text, unnest(string_split(text, ' ')) AS w FROM (SELECT DISTINCT text FROM pool))) GROUP BY 1, 2),
    norms AS (SELECT text, sqrt(sum(v * v)) AS n FROM vectors GROUP BY text),
    sides AS MATERIALIZED (SELECT pair, b || '|' || x AS side, v FROM candidates JOIN vectors ON text = a),
    dots AS (SELECT pair, sum(s.v * y.v) AS d FROM sides s JOIN (SELECT text || '|' || x AS side, v FROM vectors) y USING (side) GROUP BY pair),
    o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, pair) AS rn FROM (SELECT c.pair, a, b,
      greatest(least(1 - abs(coalesce(coalesce(d, 0) / nullif(x.n * y.n, 0), 0) - 0.5) / 0.5, 1.0), 0.0) AS score
      FROM candidates c JOIN norms x ON x.text = a JOIN norms y ON y.text = b LEFT JOIN dots ON dots.pair = c.pair)), {_capped('o', 60)}
    SELECT pair, a AS sentence_a, b AS sentence_b, round(score, 6) AS uncertainty, 'pending' AS status FROM o WHERE pair IN (SELECT pair FROM taken)"""
)
def seed_items(spark, d):
    """Items for people to label: the most uncertain pairs of corpus lines, no line more than twice."""
    out = pipeline.seed_items(_lines(spark, d), plugins.HashedWords(64))
    return out.withColumn("uncertainty", F.round("uncertainty", 6)).drop("gold_label")


# ---- annotation


@query(
    """(SELECT id, sentence_a, sentence_b, uncertainty, status FROM items WHERE status = 'pending' ORDER BY uncertainty DESC NULLS LAST, id LIMIT 20)
    UNION ALL (SELECT id, sentence_a, sentence_b, uncertainty, status FROM items WHERE status = 'gold' ORDER BY sha1('0|' || id), id LIMIT 2)"""
)
def annotation_queue(spark, d):
    return annotate.annotation_queue(table(spark, d, "items"))


@query(f"WITH {sql.MEANS} SELECT item_id, n_labels, round(mean_label, 6) AS mean_label FROM means")
def annotation_mean(spark, d):
    return annotate.item_means(table(spark, d, "annotations")).withColumn("mean_label", F.round("mean_label", 6))


@query(
    """SELECT item_id, round(sum(w * label) / nullif(sum(w), 0), 6) AS weighted_label FROM (SELECT item_id, label, coalesce(reliability, 1.0) AS w
    FROM annotations a LEFT JOIN annotators r ON r.id = a.annotator_id WHERE label IS NOT NULL) GROUP BY item_id"""
)
def annotation_weighted_mean(spark, d):
    out = annotate.weighted_means(table(spark, d, "annotations"), table(spark, d, "annotators"))
    return out.withColumn("weighted_label", F.round("weighted_label", 6))


@query(
    """SELECT annotator_id, count(*) AS n_gold, count_if(label = gold_label) AS n_correct, round((count_if(label = gold_label) + 2) / (count(*) + 4), 6) AS reliability
    FROM annotations a JOIN items i ON i.id = a.item_id WHERE gold_label IS NOT NULL GROUP BY annotator_id"""
)
def annotator_reliability(spark, d):
    out = annotate.reliability_on_gold(table(spark, d, "annotations"), table(spark, d, "items"))
    return out.withColumn("reliability", F.round("reliability", 6))


@query(
    f"""WITH {sql.LAST_LABEL}, r AS (SELECT b.annotator_id AS other, a.label AS a, b.label AS b FROM last_label a JOIN last_label b USING (item_id)
      WHERE a.annotator_id = 1 AND b.annotator_id <> 1 AND a.label IS NOT NULL AND b.label IS NOT NULL),
    xs AS (SELECT other, x, row_number() OVER (PARTITION BY other ORDER BY x) AS k FROM (SELECT other, a AS x FROM r UNION SELECT other, b FROM r)),
    ij AS (SELECT r.other, x.k AS i, y.k AS j FROM r JOIN xs x ON x.other = r.other AND x.x = a JOIN xs y ON y.other = r.other AND y.x = b),
    o AS (SELECT other, count(*) AS n, sum((i - j) * (i - j)) AS o FROM ij GROUP BY other),
    mi AS (SELECT other, i, count(*) AS n FROM ij GROUP BY 1, 2), mj AS (SELECT other, j, count(*) AS n FROM ij GROUP BY 1, 2),
    e AS (SELECT mi.other, sum(mi.n * mj.n * (i - j) * (i - j)) AS e FROM mi JOIN mj USING (other) GROUP BY mi.other)
    SELECT other, n, round(1 - o / nullif(e / n, 0), 6) AS kappa FROM o JOIN e USING (other)"""
)
def kappa_quadratic(spark, d):
    ratings = annotate.paired_ratings(table(spark, d, "annotations"), 1)
    return annotate.weighted_kappa(ratings, "other").withColumn("kappa", F.round("kappa", 6))


@query("SELECT id, CASE WHEN status = 'gold' THEN 'gold' WHEN id IN (SELECT item_id FROM annotations WHERE label IS NOT NULL AND item_id IS NOT NULL) THEN 'labeled' ELSE 'pending' END AS status FROM items")
def labelled_status(spark, d):
    """The items' status as the annotation log gives it."""
    return annotate.derived_status(table(spark, d, "items"), table(spark, d, "annotations")).select("id", "status")


@query("SELECT label, count(*) AS n FROM annotations GROUP BY label")
def label_tiers(spark, d):
    return annotate.label_counts(table(spark, d, "annotations"))


_SCORED = f"{sql.MEANS}, scored AS (SELECT id AS item_id, sentence_a, sentence_b, mean_label AS score FROM items JOIN means ON item_id = id WHERE status = 'labeled')"


@query(f"WITH {_SCORED} SELECT item_id, sentence_a, sentence_b, round(score, 6) AS score FROM scored")
def sts_export(spark, d):
    out = annotate.labelled_pairs(table(spark, d, "items"), table(spark, d, "annotations"))
    return out.withColumn("score", F.round("score", 6))


@query(f"SELECT test_id, {sql.normalize('sentence_a')} AS sentence_a, {sql.normalize('sentence_b')} AS sentence_b, score / 5.0::DOUBLE AS score FROM en_sts_test")
def sts_scaled(spark, d):
    return files.scaled_pairs(table(spark, d, "en_sts_test"))


@query(
    f"""WITH {_SCORED}, p AS (SELECT *, row_number() OVER (ORDER BY item_id) AS rn FROM scored WHERE score >= 4), n AS (SELECT *, row_number() OVER (ORDER BY item_id) AS rn FROM scored WHERE score <= 1)
    SELECT p.sentence_a AS anchor, p.sentence_b AS positive, n.sentence_b AS negative FROM p JOIN n USING (rn)"""
)
def triplets_threshold(spark, d):
    return annotate.threshold_triplets(annotate.labelled_pairs(table(spark, d, "items"), table(spark, d, "annotations")))


@query(
    f"""WITH {_SCORED}, c AS (SELECT quantile_cont(score, 0.7) AS hi, quantile_cont(score, 0.3) AS lo FROM scored),
    p AS (SELECT sentence_a, sentence_b, row_number() OVER (ORDER BY sha1('1337p|' || item_id)) AS rn FROM scored, c WHERE score >= hi),
    n AS (SELECT sentence_b AS negative, row_number() OVER (ORDER BY sha1('1337n|' || item_id)) AS rn FROM scored, c WHERE score <= lo)
    SELECT sentence_a AS anchor, sentence_b AS positive, negative FROM p JOIN n USING (rn) WHERE sentence_b <> negative"""
)
def triplets_percentile(spark, d):
    return annotate.percentile_triplets(annotate.labelled_pairs(table(spark, d, "items"), table(spark, d, "annotations")))


@query(f"WITH {sql.MEANS} SELECT item_id, n_labels, round(mean_label, 6) AS mean_label FROM means")
def stream_annotation_means(spark, d):
    """The running means of the annotation log read as a stream, file by file, until nothing is left."""
    import uuid

    place = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    stream.upsert_means(stream.read_annotations(spark, f"{d}/annotations.parquet"), f"{place}/out", f"{place}/state").awaitTermination()
    return stream.latest_means(spark, f"{place}/out").withColumn("mean_label", F.round("mean_label", 6))


# ---- vectors and metrics

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(
    f"""SELECT q, doc, sim, rank FROM (SELECT a.vec_id AS q, b.vec_id AS doc, round({_COS}, 6) AS sim, (row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id))::INT AS rank
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 10"""
)
def knn_topk(spark, d):
    e = table(spark, d, "embeddings")
    queries = e.filter(F.pmod("vec_id", F.lit(100)) == 0).select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    return retrieval.top_k(queries, e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v")), 10).withColumn("sim", F.round("sim", 6))


@query(
    f"""WITH r AS (SELECT a.vec_id AS q, b.vec_id AS doc, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT q.vec_id AS q, rank FROM (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0) q LEFT JOIN r ON r.q = q.vec_id AND r.doc = q.vec_id + 1 AND r.rank <= 100)
    SELECT 'a' AS branch, 'retrieval_recall@100' AS metric, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS value FROM p
    UNION ALL SELECT 'a', 'retrieval_mrr@100', round(avg(coalesce(1.0 / rank, 0.0)), 6) FROM p"""
)
def retrieval_recall_mrr(spark, d):
    e = table(spark, d, "embeddings")
    queries = e.filter(F.pmod("vec_id", F.lit(100)) == 0).select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"), (F.col("vec_id") + 1).alias("positive"))
    ranks = retrieval.positive_ranks(queries, e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v")), 100)
    return retrieval.recall_mrr(ranks, 100).withColumn("value", F.round("value", 6))


@query(
    f"""WITH {sql.MEANS}, v AS (SELECT uncertainty AS x, mean_label AS y FROM items JOIN means ON item_id = id WHERE uncertainty IS NOT NULL),
    r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM v)
    SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r"""
)
def spearman_rho(spark, d):
    means = annotate.item_means(table(spark, d, "annotations"))
    both = table(spark, d, "items").join(means, F.col("id") == F.col("item_id"))
    return retrieval.spearman(both, "uncertainty", "mean_label").withColumn("rho", F.round("rho", 6))


_U = "greatest(least(1 - abs(c - 0.5) / 0.5, 1.0), 0.0)"


@query(f"SELECT i, round(c, 6) AS cosine, round({_U}, 6) AS uncertainty FROM (SELECT a.vec_id AS i, {_COS} AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)")
def pair_uncertainty(spark, d):
    e = table(spark, d, "embeddings")
    both = e.select("vec_id", "embedding").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("vb")), "vec_id")
    out = pairs.scored_uncertainty(both, "embedding", "vb")
    return out.select(F.col("vec_id").alias("i"), F.round("cosine", 6).alias("cosine"), F.round("uncertainty", 6).alias("uncertainty"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def l2_normalize(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vx.norm("embedding"), 6).alias("norm"), F.round(F.get(vx.unit("embedding"), 0), 6).alias("first"))


@query(
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS k FROM embeddings), y AS (SELECT vec_id, sqrt(sum(v * v)) AS n, max(abs(v)) AS m FROM x GROUP BY vec_id),
    d AS (SELECT vec_id, abs(v / m - v / n) AS d, abs(v / n) AS a FROM x JOIN y USING (vec_id))
    SELECT (SELECT count(*) FROM embeddings) AS rows, round(max(d), 6) AS max_diff, bool_and(d <= 0.1 + 1e-5 * a) AS match FROM d"""
)
def skew_check(spark, d):
    """Vectors scaled by their largest number against the same vectors scaled by their length: a skew that must be found."""
    e = table(spark, d, "embeddings")
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    scaled = e.select(F.col("vec_id").alias("key"), tx.let(largest, lambda m: F.transform("embedding", lambda x: x.cast("double") / m)).alias("v"))
    return retrieval.skew_check(scaled, retrieval.unit_vectors(e), atol=0.1).withColumn("max_diff", F.round("max_diff", 6))


@query("SELECT count(*) AS rows, max(len(embedding))::BIGINT AS dim, (count(*) * max(len(embedding)) * 18)::BIGINT AS bytes FROM embeddings")
def embedding_size_estimate(spark, d):
    return vx.jsonl_bytes(table(spark, d, "embeddings"))


# ---- TF-IDF and latent semantic analysis

_TFIDF = r"""
counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents) GROUP BY 1, 2),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM counts GROUP BY term),
raw_w AS (SELECT doc_id, term, tf * idf AS w FROM counts JOIN idf USING (term)),
weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw_w)"""


@query(f"WITH {_TFIDF} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def tfidf_weights(spark, d):
    return tfidf.weights(_docs(spark, d)).withColumn("weight", F.round("weight", 6))


@query(
    f"""WITH {_TFIDF} SELECT p.doc_id AS i, p.doc_id + 1 AS j, round(coalesce(c, 0), 6) AS cosine FROM documents p JOIN documents o ON o.doc_id = p.doc_id + 1
    LEFT JOIN (SELECT a.doc_id, sum(a.weight * b.weight) AS c FROM weights a JOIN weights b ON b.doc_id = a.doc_id + 1 AND b.term = a.term GROUP BY 1) x ON x.doc_id = p.doc_id"""
)
def tfidf_pair_cosine(spark, d):
    docs = _docs(spark, d)
    weighted = materialize(tfidf.weights(docs), "weights")
    next_ = docs.select("doc_id").join(docs.select((F.col("doc_id") - 1).alias("doc_id")), "doc_id").select(F.col("doc_id").alias("i"), (F.col("doc_id") + 1).alias("j"))
    return tfidf.pair_cosines(weighted, next_).withColumn("cosine", F.round("cosine", 6))


@query()
def lsa_pair_scores(spark, d):
    return tfidf.lsa_scored_pairs(_docs(spark, d), 3000, k=100).withColumn("score", F.round("score", 6))


# ---- sub-words


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(nfc_normalize(text), '{sql.PRETOKEN}')) AS token FROM documents) GROUP BY token")
def pretoken_freq(spark, d):
    return subword.pretoken_counts(_docs(spark, d), compatibility=False)


@query(f"SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(nfc_normalize(text), '{sql.WS}+', '', 'g'), '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch")
def char_alphabet(spark, d):
    return subword.alphabet(_docs(spark, d))


@query()
def tokenizer_diagnostics(spark, d):
    return subword.tokenizer_diagnostics(_docs(spark, d))


# ---- caches, prompts, masks


@query("SELECT id, sha1('p1|ru|en|' || sentence_a) AS key FROM items")
def translation_cache_keys(spark, d):
    return table(spark, d, "items").select("id", tx.cache_key(F.lit("p1"), F.lit("ru"), F.lit("en"), F.col("sentence_a")).alias("key"))


@query("SELECT item_id || ':' || annotator_id AS key, arg_max(label, id)::VARCHAR AS value FROM annotations GROUP BY 1")
def cache_latest(spark, d):
    """The annotation log read as an append-only key/value cache: the last entry wins."""
    log = table(spark, d, "annotations").select(F.concat_ws(":", "item_id", "annotator_id").alias("key"), F.col("label").cast("string").alias("value"), "id")
    return files.latest_values(log, F.col("id"))


@query("SELECT id FROM items WHERE id NOT IN (SELECT item_id FROM annotations WHERE item_id IS NOT NULL)")
def cache_misses(spark, d):
    """Items without an entry in the log."""
    return table(spark, d, "items").select("id").join(table(spark, d, "annotations").select(F.col("item_id").alias("id")), "id", "left_anti")


@query("SELECT id, 'Instruct: Represent the sentence' || chr(10) || 'Query: ' || sentence_a AS prompt, 'Represent: ' || sentence_a AS prefixed FROM items")
def prompt_format(spark, d):
    return table(spark, d, "items").select(
        "id", tx.instruction_prompt(F.lit("Represent the sentence"), F.col("sentence_a")).alias("prompt"), tx.prefix_prompt(F.lit("Represent"), F.col("sentence_a")).alias("prefixed")
    )


@query(f"SELECT test_id, len(list_filter(regexp_split_to_array(sentence_a, '{sql.WS}+'), lambda x: x <> ''))::INT - 1 AS last FROM en_sts_test")
def last_token_index(spark, d):
    """The last word of each sentence by masks as long as the longest sentence, padded on the right."""
    t = table(spark, d, "en_sts_test")
    longest = t.agg(F.max(tx.word_count("sentence_a")).alias("longest"))  # one row
    t = t.crossJoin(F.broadcast(longest))
    mask = tx.let(tx.word_count("sentence_a"), lambda n: F.transform(F.sequence(F.lit(1), F.col("longest")), lambda i: (i <= n).cast("int")))
    return vx.last_token_index(t.select("test_id", mask.alias("mask"))).select("test_id", "last")


@query(
    f"""SELECT doc_id, len(w) AS words, count_if_list AS abbreviations FROM (SELECT doc_id, w, len(list_filter(w, lambda x: contains(x, '.') AND regexp_matches(x, '\\p{{L}}'))) AS count_if_list
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{sql.WS}+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL))"""
)
def word_counts(spark, d):
    w = tx.words("text")
    docs = _docs(spark, d).filter("text is not null")
    return docs.select("doc_id", F.size(w).cast("long").alias("words"), F.size(F.filter(w, tx.has_abbreviation_shape)).cast("long").alias("abbreviations"))


# ---- encoding and evaluation


@query()
def triplets_by_svd(spark, d):
    return pipeline.triplets_by("svd", _lines(spark, d), None, None)


@query()
def encode_corpus(spark, d):
    encoded = plugins.encode(_docs(spark, d).filter("text is not null").select("doc_id", "text"), plugins.HashedWords(32))
    return encoded.select("doc_id", F.size("embedding").alias("dim"), F.round(vx.norm("embedding"), 4).alias("norm"))


@query()
def evaluate_encoder(spark, d):
    t = table(spark, d, "en_sts_test").select(F.col("test_id").alias("id"), "sentence_a", "sentence_b", (F.col("score") / 5).alias("score"))
    return pipeline.evaluate(t, plugins.HashedWords(256)).withColumn("value", F.round("value", 4))
