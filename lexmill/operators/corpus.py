"""Corpus building: lines, normalisation, exact duplicates, leakage guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as tx


class Leakage(ValueError):
    """Held-out text stands in training text."""


def corpus_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, pos, text): the normalised, non-blank lines of multi-line texts.

    The whole text is normalised to NFC before it is cut, so the Arrow call is made per text, not per line.
    """
    lines = docs.select(id_col, F.posexplode(F.split(tx.nfc(text_col), tx.LINE_BREAK)).alias("pos", "text"))
    return lines.select(id_col, F.col("pos").cast("long").alias("pos"), tx.collapse("text").alias("text")).filter("text <> ''")


def corpus_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, pos, text): the sentences of texts with line wraps."""
    return docs.select(id_col, F.posexplode(tx.split_sentences(tx.nfc(text_col))).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))


def first_of_equal(lines: DataFrame, *order: str) -> DataFrame:
    """Exact duplicates removed, the first in order kept.

    Only 128-bit hashes are grouped; what is removed is the places of later copies, so that texts are neither sorted nor
    grouped, and not moved either while there are few copies.
    """
    keyed = lines.select(*order, F.unhex(F.md5("text")).alias("k"))
    several = keyed.groupBy("k").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first")).filter("n > 1")
    later = keyed.join(several.select("k", "first"), "k").filter(F.struct(*order) > F.col("first")).select(*order)
    return lines.join(later, list(order), "left_anti").select(*lines.columns)


def held_out_hashes(pairs: DataFrame, fields: tuple[str, ...] = ("sentence_a", "sentence_b")) -> DataFrame:
    """(h): distinct hashes of the normalised held-out sentences."""
    texts = pairs.select(F.explode(F.array(*fields)).alias("text")).filter("text is not null")
    return texts.select(tx.text_hash("text").alias("h")).distinct()


def _hashed(lines: DataFrame, normalized: bool) -> DataFrame:
    return lines.withColumn("h", F.sha1("text") if normalized else tx.text_hash("text"))


def leaked(lines: DataFrame, held_out: DataFrame, normalized: bool = True) -> DataFrame:
    """The lines that stand in the held-out set.  Spark broadcasts the set only while it is small."""
    return _hashed(lines, normalized).join(held_out_hashes(held_out), "h", "left_semi").drop("h")


def without_leaks(lines: DataFrame, held_out: DataFrame, normalized: bool = True) -> DataFrame:
    return _hashed(lines, normalized).join(held_out_hashes(held_out), "h", "left_anti").drop("h")


def require_no_leaks(lines: DataFrame, held_out: DataFrame | None, normalized: bool = True) -> DataFrame:
    """The lines themselves, or an error naming a leaked one; without a held-out set the guard is inactive."""
    if held_out is not None:
        hit = leaked(lines, held_out, normalized).limit(1).collect()
        if hit:
            raise Leakage(f"held-out text in training text: {hit[0].asDict()}")
    return lines


def require_clean_files(texts: DataFrame, held_out: DataFrame) -> None:
    """Error naming the first file of texts(path, text) with a held-out sentence; every JSON string counts."""
    fields = F.when(F.col("text").startswith("{"), F.map_values(F.from_json("text", "map<string,string>")))
    each = texts.select("path", F.explode(F.concat(F.array("text"), F.coalesce(fields, F.array().cast("array<string>")))).alias("text")).filter("text is not null")
    first = leaked(each, held_out, normalized=False).agg(F.min("path")).first()[0]
    if first is not None:
        raise Leakage(f"held-out text in {first}")


def adjacent_pairs(lines: DataFrame, group: str = "doc_id", pos: str = "pos") -> DataFrame:
    """(group, pos, a, b): each line with the next one of its text."""
    w = Window.partitionBy(group).orderBy(pos)
    return lines.select(group, pos, F.col("text").alias("a"), F.lead("text").over(w).alias("b")).filter("b is not null")


def build_corpus(lines: DataFrame, held_out: DataFrame | None, dedup=None) -> DataFrame:
    """Normalised lines -> duplicates removed -> guarded; the guard runs before and after removal."""
    require_no_leaks(lines, held_out)
    kept = dedup(lines) if dedup is not None else lines
    return require_no_leaks(kept, held_out)
