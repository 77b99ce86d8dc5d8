"""Sentence-pair generation: candidates, silver tiers, capped greedy selection, SimCSE pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import vector as vx
from lexmill.operators import sample
from lexmill.operators.corpus import adjacent_pairs
from lexmill.session import materialize, release

PARAPHRASE, ADJACENT, RANDOM = 4.8, 2.0, 0.3  #: fixed silver scores of the three tiers


def simcse_pairs(texts: DataFrame) -> DataFrame:
    """Each text with itself, as positives of contrastive training."""
    return texts.select(F.col("text").alias("a"), F.col("text").alias("b"))


def candidate_pool(lines: DataFrame, n_random: int, seed: int, group: str = "doc_id", pos: str = "pos") -> DataFrame:
    """(kind, a, b): all neighbours and n_random random pairs."""
    near = adjacent_pairs(lines, group, pos).select(F.lit("adjacent").alias("kind"), "a", "b")
    far = sample.random_pairs(lines.select("text", group, pos), n_random, seed, group, pos).select(F.lit("random").alias("kind"), "a", "b")
    return near.unionByName(far)


def silver_pairs(lines: DataFrame, n: int, seed: int, paraphrases: DataFrame | None = None, group: str = "doc_id", pos: str = "pos") -> DataFrame:
    """(sentence_a, sentence_b, score): n pairs of three tiers of equal size, in a seeded order.

    ``paraphrases(text, paraphrase)`` comes from a translator; failed and unchanged ones are dropped.  Without
    it the upper tier is missing.  Fewer than two lines give nothing.
    """
    each = max(1, n // 3)
    near = sample.sample_rows(adjacent_pairs(lines, group, pos), each, f"{seed}a", group, pos)
    tiers = near.select("a", "b", F.lit(ADJACENT).alias("score"))
    far = sample.random_pairs(lines.select("text", group, pos), each, seed, group, pos)
    tiers = tiers.unionByName(far.select("a", "b", F.lit(RANDOM).alias("score")))
    if paraphrases is not None:
        good = paraphrases.filter("paraphrase is not null and paraphrase <> '' and paraphrase <> text")
        top = sample.sample_rows(good, each, f"{seed}p", "text")
        tiers = tiers.unionByName(top.select(F.col("text").alias("a"), F.col("paraphrase").alias("b"), F.lit(PARAPHRASE).alias("score")))
    return tiers.orderBy(sample.salted(f"{seed}s", "score", "a", "b"), "a", "b").limit(n).select(F.col("a").alias("sentence_a"), F.col("b").alias("sentence_b"), "score")


def scored_uncertainty(pairs: DataFrame, a: str = "va", b: str = "vb") -> DataFrame:
    """Adds the cosine of two vector columns and the uncertainty made from it."""
    return pairs.withColumn("cosine", vx.cosine(a, b)).withColumn("uncertainty", vx.uncertainty(F.col("cosine")))


def _all_capped(pool: DataFrame, max_reuse: int) -> DataFrame:
    """The pairs that a pass over pool(pair, a, b, score) in order takes if it skips each whose text is used up.

    By rounds: of each text only the first undecided pairs, as many as it has uses left, can be taken whatever
    becomes of the others; a pair that is among them on both sides is taken.  The first undecided pair always is.
    """
    order = [F.desc("score"), "pair"]
    first = undecided = materialize(pool, "pool")
    taken = None
    while not undecided.isEmpty():
        sides = undecided.select("pair", "score", F.explode(F.array("a", "b")).alias("text")).groupBy("pair", "score", "text").agg(F.count("*").alias("w"))
        if taken is not None:
            used = taken.select(F.explode(F.array("a", "b")).alias("text")).groupBy("text").agg(F.count("*").alias("used"))
            sides = sides.join(used, "text", "left")
        else:
            sides = sides.withColumn("used", F.lit(0).cast("long"))
        own = Window.partitionBy("text").orderBy(*order)
        # each row has a weight of one at least, so rows after the first ``max_reuse`` can't be taken now
        near = sides.withColumn("place", F.row_number().over(own)).filter(F.col("place") <= max_reuse)
        near = near.withColumn("before", F.coalesce(F.sum("w").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        # a text paired with itself is used twice at once, which may be once too much: nothing before it may be undecided
        alone = (F.col("w") == 1) | (F.col("before") == 0)
        open_ = near.filter(alone & (F.col("before") + F.coalesce("used", F.lit(0)) < max_reuse)).groupBy("pair").agg(F.sum("w").alias("w")).filter("w = 2").select("pair")
        new = materialize(undecided.join(open_, "pair", "left_semi"), "taken")
        taken = new if taken is None else taken.unionByName(new)
        full = taken.select(F.explode(F.array("a", "b")).alias("text")).groupBy("text").agg(F.count("*").alias("used")).filter(F.col("used") >= max_reuse).select("text")
        rest = undecided.join(new.select("pair"), "pair", "left_anti")
        for side in ("a", "b"):
            rest = rest.join(full.withColumnRenamed("text", side), side, "left_anti")
        before_, undecided = undecided, materialize(rest.select(*pool.columns), "pool")
        release(before_)
    return taken if taken is not None else first.limit(0)


def select_capped(pool: DataFrame, n: int, max_reuse: int = 2) -> DataFrame:
    """The n pairs of pool(pair, a, b, score) of the highest scores, no text more often than max_reuse.

    What is taken from the first m pairs of the order doesn't depend on the others, so m grows until n are taken.
    """
    own = pool.select("pair", "a", "b", "score").filter("a is not null and b is not null")
    total, m = own.count(), 4 * n
    while True:
        taken = materialize(_all_capped(own if m >= total else own.orderBy(F.desc("score"), "pair").limit(m), max_reuse), "capped")
        if m >= total or taken.count() >= n:
            return taken.orderBy(F.desc("score"), "pair").limit(n)
        m *= 8
