"""Problem 7: mixing sources to target shares, in the order of a time-varying curriculum.

A source of share s has the weight schedule  s * (1 + a * (2 t - 1))  over training time t in [0, 1]: it
rises if a > 0, and its integral is s.  The documents of a source stand in a random order, and a document
at the share u of the source's tokens gets the time at which the source's cumulative demand reaches u: the
inverse of  t + a (t^2 - t).  All sources together are range-sorted by that time.

Cumulative tokens come from sums over hash buckets, a prefix sum over the buckets and a window within each
bucket, so no source, however large, passes through one task.

A source supplies min(its demand, its tokens * max_repeats); whole passes come first, the last pass is cut at
the document that comes nearest to the demand.  Targets out of reach are reported as such; the other
sources keep their amounts.

Defined cases: null and blank texts have no tokens and are left out; sources are compared in lower case with
blanks, dots and hyphens as underscores; documents of unlisted or null sources are left out and reported with
share 0; a null or negative target counts as 0, a null max_repeats as 1; rows with the same id, source and
size are one document; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.sizes import token_sizes
from lexmill.session import materialize

BUCKET = 5_000  #: documents in a hash bucket, about
TILT = 0.6  #: how far the default schedules rise or fall


def clean_source(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(source, r"[\s ]+", " "))), r"[\s.\-]+", "_")


def schedules(targets: DataFrame, tilt: dict[str, float] | None = None) -> DataFrame:
    """(source, share, repeats, slope): by default large sources fall and small ones rise.

    The slopes are shifted so that the weights of all sources sum to 1 at any time.  ``targets`` has a row a source.
    """
    t = targets.select(
        clean_source(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"),
        F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("repeats"),
    ).groupBy("source").agg(F.sum("share").alias("share"), F.max("repeats").alias("repeats"))
    everything = Window.partitionBy(F.lit(0))
    if tilt is None:
        raw = F.lit(TILT) * (1 - 2 * F.percent_rank().over(everything.orderBy(F.desc("share"), "source"))) * -1
    else:
        raw = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in (tilt | {"": 0.0}).items() for x in kv]), F.col("source")), F.lit(0.0))
    t = t.withColumn("raw", raw)
    mean = F.try_divide(F.sum(F.col("raw") * F.col("share")).over(everything), F.sum("share").over(everything))
    centred = t.withColumn("slope", F.col("raw") - F.coalesce(mean, F.lit(0.0)))
    largest = F.greatest(F.max(F.abs("slope")).over(everything), F.lit(1.0))
    return centred.select("source", "share", "repeats", (F.col("slope") / largest).alias("slope"))


def supply(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str, total_tokens: int | None, tilt: dict[str, float] | None, vocabulary_path: str | None) -> tuple[DataFrame, DataFrame]:
    """The documents (id, source, n_tokens) and, for each source, what it has and what it must give."""
    sizes = token_sizes(docs.withColumn("source", clean_source(F.col("source"))), id_col, text_col, "source", vocabulary_path=vocabulary_path)
    sizes = materialize(sizes.filter("n_tokens > 0").distinct(), "sizes")
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("documents"))
    plan = have.alias("h").join(schedules(targets, tilt).alias("t"), "source", "full_outer")
    plan = plan.select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("available", "documents", "share", "repeats", "slope")])
    total = F.lit(total_tokens).cast("double") if total_tokens is not None else F.sum(F.col("available")).over(Window.partitionBy(F.lit(0))).cast("double")
    plan = plan.withColumn("demand", F.col("share") * total)
    return sizes, plan.withColumn("given", F.least("demand", F.col("available") * F.col("repeats")))


def cumulative(sizes: DataFrame, seed: int) -> DataFrame:
    """(id, source, n_tokens, before): tokens of the source that stand before, in a random order."""
    n = max(1, min(1 << 16, -(-sizes.count() // BUCKET)))
    keyed = sizes.withColumn("key", F.xxhash64(F.lit(seed), "id", "n_tokens"))
    keyed = keyed.withColumn("bucket", F.pmod(F.shiftright("key", 20), F.lit(n)))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    first = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("tokens").over(first), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return keyed.join(sums, ["source", "bucket"]).select("id", "source", "n_tokens", (F.col("inner") + F.col("offset")).alias("before"))


def mixed(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", total_tokens: int | None = None, tilt: dict[str, float] | None = None, seed: int = 13, vocabulary_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture (position, id_col, source, copy, n_tokens), unsorted, and the plan by source."""
    sizes, plan = supply(docs, targets, id_col, text_col, total_tokens, tilt, vocabulary_path)
    plan = materialize(plan, "plan")
    use = plan.filter("given > 0").select("source", "available", "given", "slope")
    placed = cumulative(sizes, seed).join(use, "source")
    passes = F.ceil(F.col("given") / F.col("available")).cast("int")
    copies = placed.select("*", F.explode(F.sequence(F.lit(0), passes - 1)).alias("copy"))
    middle = F.col("copy") * F.col("available") + F.col("before") + F.col("n_tokens") / 2
    u = middle / F.col("given")
    a = F.col("slope")
    position = 2 * u / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * u))
    taken = copies.filter(middle <= F.col("given"))
    return taken.select(position.alias("position"), F.col("id").alias(id_col), "source", "copy", "n_tokens"), plan


def curriculum(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(position, id_col, source, copy, n_tokens) in training order, range-partitioned by position."""
    rows, _ = mixed(docs, targets, id_col, **options)
    return rows.repartitionByRange("position", id_col, "copy").sortWithinPartitions("position", id_col, "copy")


def share_report(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(source, target_share, documents, available_tokens, max_repeats, used_tokens, actual_share, deviation, supplied).

    ``supplied`` says whether the source could give the amount asked of it (null where none was asked); ``deviation`` is actual share less target,
    which is not 0 for supplied sources either when others fall short.
    """
    rows, plan = mixed(docs, targets, id_col, **options)
    used = rows.groupBy("source").agg(F.sum("n_tokens").alias("used"))
    out = plan.alias("p").join(used.alias("u"), F.col("p.source").eqNullSafe(F.col("u.source")), "left")
    tokens = F.coalesce("u.used", F.lit(0).cast("long"))
    actual = F.coalesce(F.try_divide(tokens, F.sum(tokens).over(Window.partitionBy(F.lit(0)))), F.lit(0.0))
    return out.select(
        "p.source", F.col("share").alias("target_share"), "documents", F.col("available").alias("available_tokens"), F.col("repeats").alias("max_repeats"),
        tokens.alias("used_tokens"), F.round(actual, 6).alias("actual_share"), F.round(actual - F.col("share"), 6).alias("deviation"),
        F.when(F.col("share") > 0, F.col("given") >= F.col("demand")).alias("supplied"),
    )
