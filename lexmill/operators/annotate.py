"""Annotation statistics and training triplets: means, agreement, reliability, queues, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators import sample
from lexmill.session import materialize

PRIOR = 2  #: pseudo-count of the smoothed reliability
POSITIVE, NEGATIVE = 4.0, 1.0  #: mean labels from which a pair is positive or negative


def item_means(annotations: DataFrame) -> DataFrame:
    """(item_id, n_labels, mean_label): plain means of all labels."""
    return annotations.filter("label is not null").groupBy("item_id").agg(F.count("*").alias("n_labels"), F.avg("label").alias("mean_label"))


def weighted_means(annotations: DataFrame, annotators: DataFrame, default: float = 1.0) -> DataFrame:
    """(item_id, weighted_label): means weighted by the annotators' reliability; null where all weights are 0."""
    w = F.coalesce("reliability", F.lit(default))
    rated = annotations.join(annotators.select(F.col("id").alias("annotator_id"), "reliability"), "annotator_id", "left").filter("label is not null")
    sums = rated.groupBy("item_id").agg(F.sum(w * F.col("label")).alias("wx"), F.sum(w).alias("w"))
    return sums.select("item_id", F.try_divide("wx", "w").alias("weighted_label"))


def smoothed_reliability(correct: Column, total: Column, prior: int = PRIOR) -> Column:
    return (correct + prior) / (total + 2 * prior)


def reliability_on_gold(annotations: DataFrame, items: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(annotator_id, n_gold, n_correct, reliability): smoothed share of right labels on items with a gold label."""
    gold = items.filter("gold_label is not null").select(F.col("id").alias("item_id"), "gold_label")
    per = annotations.join(gold, "item_id").groupBy("annotator_id").agg(F.count("*").alias("n_gold"), F.count_if(F.col("label") == F.col("gold_label")).alias("n_correct"))
    return per.select("annotator_id", "n_gold", "n_correct", smoothed_reliability(F.col("n_correct"), F.col("n_gold"), prior).alias("reliability"))


def weighted_kappa(ratings: DataFrame, group: str | None = None) -> DataFrame:
    """(group, n, kappa) of ratings(group, a, b): Cohen's kappa with quadratic weights.

    Classes are numbered by their order among the labels that occur on either side, as in the usual library
    definition.  Only counts by pair of labels are handled after the first aggregation.  A single class gives null.
    """
    g = [group] if group else []
    # written, because the labels and the counts are both made from it
    counts = materialize(ratings.filter("a is not null and b is not null").groupBy(*g, "a", "b").agg(F.count("*").cast("double").alias("n")), "counts")
    labels = counts.select(*g, F.explode(F.array("a", "b")).alias("x")).distinct()
    # a group has as many rows as there are labels
    ranked = labels.groupBy(*g).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    indexed = counts.join(ranked, g) if g else counts.crossJoin(F.broadcast(ranked))
    indexed = indexed.select(*g, "n", F.array_position("xs", F.col("a")).alias("i"), F.array_position("xs", F.col("b")).alias("j"))
    d = F.col("i") - F.col("j")
    sums = indexed.groupBy(*g).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * d * d).alias("observed"),
        F.sum(F.col("n") * F.col("i")).alias("si"), F.sum(F.col("n") * F.col("i") * F.col("i")).alias("sii"),
        F.sum(F.col("n") * F.col("j")).alias("sj"), F.sum(F.col("n") * F.col("j") * F.col("j")).alias("sjj"),
    )
    # expected sum of squared differences of independent sides, from their first two moments
    expected = F.col("sii") + F.col("sjj") - 2 * F.col("si") * F.col("sj") / F.col("n")
    return sums.filter("n > 0").select(*g, F.col("n").cast("long").alias("n"), (1 - F.try_divide(F.col("observed"), expected)).alias("kappa"))


def paired_ratings(annotations: DataFrame, annotator: int) -> DataFrame:
    """(other, a, b): labels of one annotator and of each other one for the same item; the largest id counts."""
    last = annotations.groupBy("item_id", "annotator_id").agg(F.max_by("label", "id").alias("label"))
    a = last.filter(F.col("annotator_id") == annotator).select("item_id", F.col("label").alias("a"))
    b = last.filter(F.col("annotator_id") != annotator).select("item_id", F.col("annotator_id").alias("other"), F.col("label").alias("b"))
    return a.join(b, "item_id").select("other", "a", "b")


def annotation_queue(items: DataFrame, n: int = 20, n_gold: int = 2, seed: int = 0, seen: DataFrame | None = None) -> DataFrame:
    """The most uncertain pending items and some random gold ones; ``seen(id)`` leaves out items already done."""
    columns = ["id", "sentence_a", "sentence_b", "uncertainty", "status"]
    if seen is not None:
        items = items.join(seen.select("id"), "id", "left_anti")
    pending = items.filter("status = 'pending'").orderBy(F.desc_nulls_last("uncertainty"), "id").limit(n)
    gold = sample.sample_rows(items.filter("status = 'gold'"), n_gold, seed, "id")
    return pending.select(*columns).unionByName(gold.select(*columns))


def label_counts(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("label").agg(F.count("*").alias("n"))


def labelled_pairs(items: DataFrame, annotations: DataFrame, status: str | None = "labeled") -> DataFrame:
    """(item_id, sentence_a, sentence_b, score): items with labels and their mean label."""
    chosen = items.filter(F.col("status") == status) if status else items
    return chosen.select(F.col("id").alias("item_id"), "sentence_a", "sentence_b").join(item_means(annotations), "item_id").select("item_id", "sentence_a", "sentence_b", F.col("mean_label").alias("score"))


def threshold_triplets(scored: DataFrame, positive: float = POSITIVE, negative: float = NEGATIVE) -> DataFrame:
    """(anchor, positive, negative) of scored(item_id, sentence_a, sentence_b, score): positives and negatives side by side in item order."""
    pos = scored.filter(F.col("score") >= positive).select(F.col("item_id").alias("p_id"), F.col("sentence_a").alias("anchor"), F.col("sentence_b").alias("positive"))
    neg = scored.filter(F.col("score") <= negative).select(F.col("item_id").alias("n_id"), F.col("sentence_b").alias("negative"))
    return sample.zipped(pos, neg, ["p_id"], ["n_id"]).select("anchor", "positive", "negative")


def percentile_triplets(scored: DataFrame, upper: float = 0.7, lower: float = 0.3, seed: int = 1337) -> DataFrame:
    """(anchor, positive, negative): pairs at or above one percentile and at or below another, each side in its
    own random order, side by side; triplets whose positive equals the negative are dropped."""
    cuts = scored.agg(F.percentile("score", F.lit(upper)).alias("hi"), F.percentile("score", F.lit(lower)).alias("lo"))
    with_cuts = scored.crossJoin(F.broadcast(cuts))
    pos = with_cuts.filter("score >= hi").select(sample.salted(f"{seed}p", "item_id").alias("p_key"), F.col("sentence_a").alias("anchor"), F.col("sentence_b").alias("positive"))
    neg = with_cuts.filter("score <= lo").select(sample.salted(f"{seed}n", "item_id").alias("n_key"), F.col("sentence_b").alias("negative"))
    return sample.zipped(pos, neg, ["p_key"], ["n_key"]).filter("positive <> negative").select("anchor", "positive", "negative")


def derived_status(items: DataFrame, annotations: DataFrame) -> DataFrame:
    """The items with their status by the log: gold items stay gold, others are labeled if they have a label.

    The log is append-only, so the status is never stored a second time and can't lag behind.
    """
    done = annotations.filter("label is not null").select(F.col("item_id").alias("id")).distinct().withColumn("done", F.lit(True))
    status = F.when(F.col("status") == "gold", "gold").when(F.col("done"), "labeled").otherwise("pending")
    return items.join(done, "id", "left").withColumn("status", status).select(*items.columns)


def new_rows(rows: DataFrame, existing: DataFrame, *order: str) -> DataFrame:
    """Adds ``id``: numbers behind the largest id of the existing table, in the order of the given columns."""
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))  # one row
    return sample.numbered(rows, *order).crossJoin(F.broadcast(last)).withColumn("id", (F.col("idx") + F.col("last") + 1)).drop("idx", "last")


def annotation_rows(answers: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of the annotation table from answers(item_id, annotator_id, label), created now."""
    return new_rows(answers.select("item_id", "annotator_id", "label"), existing, "item_id", "annotator_id", "label").withColumn("created_at", F.current_timestamp())
