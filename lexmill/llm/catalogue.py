"""Queries of the training-data operators, with SQL where SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import consensus, garble, leak, lookalike, mixing, neardup, oracles, packing, spans
from lexmill.session import materialize, spread, temporaries

QUERIES: dict = {}
ORACLES: dict[str, str] = {"p2_found": oracles.P2_FOUND, "p4_found": oracles.P4_FOUND, "p5_found": oracles.P5_FOUND}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "items") else df


# ---- 4: visually identical text


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items whose texts of the same field look the same but are different strings."""
    return lookalike.same_look_pairs(lookalike.item_forms(table(spark, sf_dir, "items"), "skeleton"), "id")


@query
def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's sentences in the consistent form, with the class of those that look the same."""
    forms = materialize(lookalike.item_forms(table(spark, sf_dir, "items")), "forms")
    return lookalike.look_classes(forms, "id").select("id", "field", "form", "class_id")


# ---- 8: long exact spans shared between records

#: All windows of 160 characters that stand in more than one document.
_SPANS = """
spans AS (SELECT doc_id, s, md5(substr(text, s, 160)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 158)) AS s FROM documents WHERE length(text) >= 160)),
shared AS (SELECT doc_id, s FROM spans WHERE h IN (SELECT h FROM spans GROUP BY h HAVING min(doc_id) <> max(doc_id)))"""
ORACLES["p8_found"] = f"WITH {_SPANS} SELECT DISTINCT doc_id FROM shared"
ORACLES["p8_shared_amounts"] = f"""
WITH {_SPANS}, steps AS (SELECT doc_id, s, lead(s) OVER w AS next, lag(s) OVER w AS before FROM shared WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
per AS (SELECT doc_id, sum(least(160, coalesce(next - s, 160)))::BIGINT AS shared_chars, count_if(before IS NULL OR s - before > 160) AS n_spans FROM steps GROUP BY doc_id)
SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(shared_chars, 0)::BIGINT AS shared_chars,
  CASE WHEN length(text) > 0 THEN round(coalesce(shared_chars, 0) / length(text), 6) ELSE 0.0::DOUBLE END AS shared_share, coalesce(n_spans, 0) AS n_spans
FROM documents LEFT JOIN per USING (doc_id)"""


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a stretch of 160 or more characters with another document."""
    return spans.shared_records(table(spark, sf_dir, "documents"))


@query
def p8_shared_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document, how many of its characters also stand elsewhere."""
    return spans.shared_amounts(table(spark, sf_dir, "documents"))


# ---- 5: evaluation texts leaking into training text


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain eight words in a row of a test sentence, with the test pair."""
    return leak.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "en_sts_test"))


@query
def p5_leak_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked test sentences by document: whole, in part or reworded."""
    return leak.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "en_sts_test"))


# ---- 6: filling sequences with texts


@query
def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece's sequence for each input length."""
    return packing.packed_sequences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "seq_limits"))


@query
def p6_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the sequences of each input length are."""
    return packing.fill_report(p6_packed(spark, sf_dir), table(spark, sf_dir, "seq_limits"))


# ---- 7: mixing sources to target weights


@query
def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus in training order."""
    return mixing.curriculum(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


@query
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.share_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


# ---- 1: garbled text from a wrong character encoding


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose sentence_a is garbled in whole or in part; the clean corpus is sentence_b."""
    items = table(spark, sf_dir, "items")
    return garble.garbled_records(items, "id", "sentence_a", items.select(F.col("sentence_b").alias("text")))


@query
def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled sentences as they were written, as far as that is known."""
    items = table(spark, sf_dir, "items")
    return garble.restored_records(items, "id", "sentence_a", items.select(F.col("sentence_b").alias("text")))


# ---- 2: consensus from several annotators' labels


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus label of each item with labels of at least three annotators."""
    return consensus.found(table(spark, sf_dir, "annotations"))


@query
def p2_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus with its posterior probability and the careful annotators' agreement."""
    return consensus.item_report(table(spark, sf_dir, "annotations"))


@query
def p2_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each annotator's reliability estimated from the labels, with a posterior interval."""
    return consensus.annotator_report(table(spark, sf_dir, "annotations"), table(spark, sf_dir, "annotators"))


@query
def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Krippendorff's alpha of all annotators and of the careful ones."""
    return consensus.agreement_report(table(spark, sf_dir, "annotations"))


# ---- 3: near-duplicate records with small edits


def _word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    with temporaries(spark) as keep:
        garbled = keep(materialize(p1_found(spark, sf_dir), "garbled"))
    return neardup.text_word_sets(table(spark, sf_dir, "items"), "id", ["sentence_a", "sentence_b"], garbled)


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items whose words are similar to at least 0.7."""
    return neardup.similar_pairs(_word_sets(spark, sf_dir), last=True)


@query
def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's class of equal word sets, its group of linked items, and its number of links."""
    return neardup.groups(_word_sets(spark, sf_dir), last=True)
