"""Text functions as Spark columns.

White space is what Python's ``str.split`` takes for it; Spark's own ``\\s`` and ``trim`` know less.
Unicode normalisation is the one thing Spark has no function for; it is an Arrow function that hands back
already normalised text untouched.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a Java regular expression class.
WS = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_BREAK = r"\r\n|\r|\n"
#: A sentence ends before an upper-case letter, an opening quote or a bracket; fixed values.
SENTENCE_GAP = rf"""(?<=[.!?…]){WS}+(?=[A-ZА-ЯЁ«"'(])"""
MIN_SENTENCE = 20
#: Words of at least two letters, digits or underscores, marks excluded (the TF-IDF tokens).
TERM = r"[\p{L}\p{N}_]{2,}"
#: Words with their marks, or runs of other signs (the pre-tokens of sub-word tokenizers).
WORD_CHARS = r"\p{L}\p{M}\p{N}\p{Pc}"
PRETOKEN = rf"[{WORD_CHARS}]+|[^{WORD_CHARS}{WS[1:-1]}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside a lambda a plain expression would be computed for
    every element."""
    return F.get(F.transform(F.array(value), body), 0)


def _normal_form(form: str) -> Callable[[Column | str], Column]:
    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() or unicodedata.is_normalized(form, x) else unicodedata.normalize(form, x))

    return normal


def nfc(c: Column | str) -> Column:
    return _normal_form("NFC")(c)


def nfkc(c: Column | str) -> Column:
    return _normal_form("NFKC")(c)


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space become one blank; none is left at the ends."""
    return F.regexp_replace(F.regexp_replace(c, f"{WS}+", " "), "^ | $", "")


def normalize(c: Column | str, script_normalizer: Callable[[Column], Column] | None = None, token_prep: Callable[[Column], Column] | None = None) -> Column:
    """NFC, optional hooks for a script normaliser and for token substitution, collapsed white space; idempotent."""
    out = nfc(c)
    for hook in (script_normalizer, token_prep):
        if hook is not None:
            out = hook(out)
    return collapse(out)


def words(c: Column | str) -> Column:
    """The words between white space, as an array."""
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def is_junk_line(c: Column | str) -> Column:
    """Digits only, such as a page number."""
    return F.when(F.isnotnull(c), strip(c).rlike(r"^\p{Nd}+$"))


def fold_lines(c: Column | str) -> Column:
    """Lines joined to one text: blank lines and page numbers dropped, a word hyphenated at a line end joined."""
    lines = F.transform(F.split(c, LINE_BREAK), strip)
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^\p{Nd}+$"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), "-\n", ""), "\n", " "), f"{WS}{{2,}}", " ")


def split_sentences(c: Column | str) -> Column:
    """Sentences of at least MIN_SENTENCE characters of a text with line wraps, as an array."""
    pieces = F.transform(F.split(fold_lines(c), SENTENCE_GAP), strip)
    return F.filter(pieces, lambda s: F.char_length(s) >= MIN_SENTENCE)


def text_hash(c: Column | str) -> Column:
    """Name of a text up to normalisation."""
    return F.sha1(normalize(c))


def cache_key(provider: Column | str, source: Column | str, pivot: Column | str, text: Column | str) -> Column:
    return F.sha1(F.concat_ws("|", provider, source, pivot, text))


def has_abbreviation_shape(c: Column | str) -> Column:
    """A dot and a letter."""
    c = F.col(c) if isinstance(c, str) else c
    return c.contains(".") & c.rlike(r"\p{L}")


def instruction_prompt(instruction: Column, text: Column) -> Column:
    return F.when(strip(F.coalesce(instruction, F.lit(""))) == "", text).otherwise(F.concat(F.lit("Instruct: "), instruction, F.lit("\nQuery: "), text))


def prefix_prompt(instruction: Column, text: Column) -> Column:
    return F.concat(instruction, F.lit(": "), text)


def terms(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({TERM})"), 1)


def pretokens(c: Column | str) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({PRETOKEN})"), 1)


def shingles(c: Column | str, k: int = 5) -> Column:
    """Distinct runs of k words; a shorter text is one run, an empty one none."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))
        none = F.array().cast("array<string>")
        return F.when(F.size(w) == 0, none).when(F.size(w) < k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(runs))

    return let(words(c), of)
