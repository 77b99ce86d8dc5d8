"""Problem 4: one consistent form for visually identical text.

Texts are cut at white space, every distinct word that can change is exploded to positioned code points,
a broadcast join with a fixed table replaces each code point by its decomposition with look-alike letters
mapped to one prototype (invisible ones to nothing), combining marks are ordered by their class behind
their base letter, and words and texts are rebuilt and recomposed.

Two results per text, each made only if it is wanted:

``skeleton``  equal for any two texts that look the same; look-alike letters stand as Latin prototypes.
``form``      the readable form: the skeleton with each word written back in the script that its
              unambiguous letters show (words of look-alikes only follow the rest of the text).  It is a
              function of the skeleton, so it is just as consistent.

The look-alikes are a parameter: :data:`LOOKALIKE` holds the letters and signs that European, Gujarati and Armenian
texts meet; :func:`read_confusables` makes a table of a file in the format of Unicode's confusables.txt.

Defined cases: a null text has null results; a blank or invisible text has ``''``; repeated rows give one
row; an id with several texts gives a row for each; other columns of the input are ignored whatever their
names; an empty table gives no rows; a text of any length is processed whole.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.operators.dedup import blocked
from lexmill.session import materialize

# Letters of other scripts with the shape of a Latin letter.
CYRILLIC_LIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
}
GREEK_LIKE = {
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
}
OTHER_LIKE = {"օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Ս": "U", "ɡ": "g", "ɑ": "a"}
# Signs with the shape of another sign.
SIGN_LIKE = {
    "‐": "-", "‑": "-", "‒": "–", "―": "—", "․": ".", "⁄": "/",
    "∕": "/", "∣": "|", "∶": ":", "꞉": ":", "։": ":", "׃": ":", "ʼ": "’",
    "׳": "’", "∗": "*", "⋅": "·", "∙": "·", "।": "|",
}
# Gujarati vowels that are drawn as the letter A with a vowel sign.
GUJARATI_LIKE = {"આ": "અા", "ઍ": "અૅ", "એ": "અે", "ઐ": "અૈ", "ઑ": "અૉ", "ઓ": "અો", "ઔ": "અૌ"}
LOOKALIKE = CYRILLIC_LIKE | GREEK_LIKE | OTHER_LIKE | SIGN_LIKE | GUJARATI_LIKE

#: White space of Unicode, as a Java regular expression class.
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{2800}\x{3000}]"
_SPACES = {*map(chr, (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 0x1680, 0x180E, 0x2028, 0x2029, 0x202F, 0x205F, 0x2800, 0x3000)), *map(chr, range(0x2000, 0x200B))}
#: Format characters that show.
_VISIBLE_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
_HIDDEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x180E), 0x180F, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: Kinds of compatibility decomposition that keep the look of the text.
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")

_AMBIGUOUS_LATIN = "".join(sorted(set("".join(v for t in (CYRILLIC_LIKE, GREEK_LIKE) for v in t.values()))))
_TO_CYRILLIC = {v: k for k, v in reversed(CYRILLIC_LIKE.items())}
_TO_GREEK = {v: k for k, v in reversed(GREEK_LIKE.items())}


def _joined(decomposition: list[int]) -> bool:
    """A <compat> decomposition into letters or dots only, such as that of the ligature fi."""
    return len(decomposition) > 1 and all(chr(c).isalpha() or c == 0x2E for c in decomposition)


def read_confusables(path: str) -> dict[str, str]:
    """Look-alikes from lines ``source ; target ; kind # remark`` of hexadecimal code points, with one source each.

    ASCII characters stay as they are: they are the prototypes that other characters are mapped to.
    """
    found = {}
    for line in Path(path).read_text(encoding="utf-8-sig").splitlines():
        parts = [p.strip() for p in line.split("#")[0].split(";")]
        if len(parts) >= 2 and parts[0] and " " not in parts[0]:
            source, target = (("".join(chr(int(c, 16)) for c in p.split())) for p in parts[:2])
            if not source.isascii() and source != target:
                found[source] = target
    return found


def fold_char(ch: str, like: dict[str, str] = LOOKALIKE) -> str:
    """What one character becomes: decomposed, look-alikes mapped, '' if invisible, ' ' if white space."""
    cp = ord(ch)
    if ch in _SPACES:
        return " "
    category = unicodedata.category(ch)
    if cp in _HIDDEN or (category == "Cf" and cp not in _VISIBLE_FORMAT) or (category == "Cc" and (cp < 0x20 or cp == 0x7F)):
        return ""
    if ch in like:
        return like[ch]
    parts = unicodedata.decomposition(ch).split()
    if parts:
        kind = parts.pop(0) if parts[0][0] == "<" else ""
        to = [int(p, 16) for p in parts]
        if not kind or kind in _SAME_LOOK or (kind == "<compat>" and cp not in (0x2116, 0x17F) and (_joined(to) or cp == 0xB5)):
            return "".join(fold_char(chr(c), like) for c in to)
    return ch


@functools.cache
def _default_table() -> dict[str, str]:
    return _make_table(LOOKALIKE)


def fold_table(like: dict[str, str] | None = None) -> dict[str, str]:
    """Every character that changes, by rule from the Unicode data; Hangul syllables stay composed."""
    return _default_table() if like is None else _make_table(like)


def _make_table(like: dict[str, str]) -> dict[str, str]:
    found = {}
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000 or 0xAC00 <= cp < 0xD7A4:
            continue
        ch = chr(cp)
        if (to := fold_char(ch, like)) != ch:
            found[ch] = to
    return found


def fold_frame(spark: SparkSession, like: dict[str, str] | None = None) -> DataFrame:
    """The table as rows (ch, to: code points with their combining class).  Its size is fixed by Unicode."""
    table = fold_table(like)
    marks = {chr(c) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))}
    rows = [(ch, [(c, unicodedata.combining(c)) for c in table.get(ch, ch)]) for ch in sorted(marks | table.keys())]
    pdf = pd.DataFrame({"ch": [r[0] for r in rows], "to": [[{"c": c, "k": k} for c, k in r[1]] for r in rows]})
    return spark.createDataFrame(pdf, T.StructType([T.StructField("ch", T.StringType()), T.StructField("to", T.ArrayType(T.StructType([T.StructField("c", T.StringType()), T.StructField("k", T.IntegerType())])))]))


def _recompose(text: str) -> str:
    text = unicodedata.normalize("NFC", text)
    if "અ" in text:
        for whole, parts in GUJARATI_LIKE.items():
            text = text.replace(parts, whole)
    return text


@F.pandas_udf(T.StringType())
def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else _recompose(x))


def fold_words(words: DataFrame, like: dict[str, str] | None = None) -> DataFrame:
    """(word) -> (word, skeleton, form, other, script); ``words`` holds distinct words.

    ``script`` is c, g, l or m (Cyrillic, Greek, Latin, mixed or none of them) by the unambiguous letters,
    or a if all letters are look-alikes; then ``other`` is the Cyrillic reading.
    """
    spark = words.sparkSession
    chars = words.select("word", F.posexplode(F.split("word", "")).alias("at", "ch"))
    mapped = chars.join(F.broadcast(fold_frame(spark, like)), "ch", "left")
    mapped = mapped.select("word", "at", F.posexplode(F.coalesce("to", F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("k"))))).alias("sub", "x"))
    base = Window.partitionBy("word").orderBy("at", "sub")
    placed = mapped.select("word", "at", "sub", "x.c", "x.k", F.sum((F.col("x.k") == 0).cast("int")).over(base).alias("base"))
    sorted_ = placed.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("base", "k", "at", "sub", "c"))).alias("cs"))
    decomposed = F.coalesce(F.array_join(F.transform("cs", lambda x: x["c"]), ""), F.lit(""))
    # words that vanish (invisible characters only) have no exploded row left
    flat = words.join(sorted_.select("word", decomposed.alias("nfd")), "word", "left").select("word", F.coalesce("nfd", F.lit("")).alias("nfd"))
    latin = F.col("nfd").rlike(rf"[\p{{IsLatin}}&&[^{_AMBIGUOUS_LATIN}]]")
    cyrillic, greek = F.col("nfd").rlike(r"\p{IsCyrillic}"), F.col("nfd").rlike(r"\p{IsGreek}")
    some = F.col("nfd").rlike(rf"[{_AMBIGUOUS_LATIN}]")
    script = (
        F.when(cyrillic & ~latin & ~greek, "c").when(greek & ~latin & ~cyrillic, "g").when(latin & ~cyrillic & ~greek, "l")
        .when(some & ~latin & ~cyrillic & ~greek, "a").otherwise("m")
    )
    to_c = F.translate("nfd", "".join(_TO_CYRILLIC), "".join(_TO_CYRILLIC.values()))
    to_g = F.translate("nfd", "".join(_TO_GREEK), "".join(_TO_GREEK.values()))
    flat = flat.select("word", "nfd", script.alias("script"), to_c.alias("to_c"), to_g.alias("to_g"))
    return flat.select(
        "word", _compose("nfd").alias("skeleton"),
        _compose(F.when(F.col("script") == "c", F.col("to_c")).when(F.col("script") == "g", F.col("to_g")).otherwise(F.col("nfd"))).alias("form"),
        _compose(F.when(F.col("script") == "a", F.col("to_c"))).alias("other"), "script",
    )


def consistent_texts(df: DataFrame, id_col: str, fields: list[str], want: tuple[str, ...] = ("skeleton", "form"), like: dict[str, str] | None = None, direct: bool = True) -> DataFrame:
    """(id_col, field, h, wanted...), one row for each distinct id, field and text; ``h`` is the text's 64-bit hash.

    ``direct``: texts and words of ASCII characters that the table maps to themselves aren't exploded; the
    results are the same without it.
    """
    named = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).alias("text")) for i, f in enumerate(fields)]))
    every = df.select(F.col(id_col).alias("id"), named.alias("p")).select("id", "p.f", "p.text")
    every = every.withColumn("h", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    words = F.filter(F.split("text", SPACE + "+"), lambda w: w != "")
    # nothing in ASCII has a look-alike but white space and control characters
    ascii_only = F.col("text").rlike(r"\A[\x00-\x7f]*\z") if direct else F.lit(False)
    simple = F.col("text").isNull() | ascii_only | (F.size(words) == 0)
    bare = F.regexp_replace("text", r"[\x00-\x08\x0e-\x1b\x7f]", "")
    bare = F.regexp_replace(F.regexp_replace(bare, SPACE + "+", " "), r"\A | \z", "")
    plain = F.when(ascii_only, bare).when(F.col("text").isNotNull(), "")
    short = every.filter(simple).select("id", "f", "h", *[plain.alias(c) for c in want]).distinct()
    # repeated rows are merged when the texts are rebuilt
    tokens = every.filter(~simple).select("id", "f", "h", F.posexplode(words).alias("at", "word"))
    known = F.col("word").rlike(rf"^[\x21-\x7e]*[A-Za-z&&[^{_AMBIGUOUS_LATIN}]][\x21-\x7e]*$") | F.col("word").rlike(r"^[\x21-\x40\x5b-\x60\x7b-\x7e]+$")
    odd = tokens.select("word").filter(~known) if direct else tokens.select("word")
    joined = tokens.join(fold_words(odd.distinct(), like), "word", "left")
    parts = {"skeleton": ["s"], "form": ["f_", "other"]}
    columns = [c for w in want for c in parts[w]]
    script = F.coalesce("script", F.when(F.col("word").rlike("[A-Za-z]"), "l").otherwise("m"))
    joined = joined.select("id", "f", "h", "at", F.coalesce("skeleton", "word").alias("s"), F.coalesce("form", "word").alias("f_"), "other", script.alias("script"))
    # words that are followed or preceded by nothing visible leave no blank
    rebuilt = joined.groupBy("id", "f", "h").agg(
        F.array_sort(F.collect_set(F.when(F.col("s") != "", F.struct("at", *columns)))).alias("ws"),
        (F.count_if(F.col("script") == "c") > F.count_if(F.col("script") == "l")).alias("cyrillic"),
    )
    made = {
        "skeleton": F.array_join(F.transform("ws", lambda w: w["s"]), " "),
        "form": F.array_join(F.transform("ws", lambda w: F.when(F.col("cyrillic") & w["other"].isNotNull(), w["other"]).otherwise(w["f_"])), " "),
    }
    long = rebuilt.select("id", "f", "h", *[made[c].alias(c) for c in want])
    names = F.array(*[F.lit(f) for f in fields])
    return short.unionByName(long).select(F.col("id").alias(id_col), F.get(names, "f").alias("field"), "h", *want)


def same_look_pairs(forms: DataFrame, id_col: str) -> DataFrame:
    """(id_1, id_2, field): rows of :func:`consistent_texts` that look the same but are different strings.

    Pairs are made between the distinct spellings of a look only and then expanded, so that any number of
    exact copies makes no candidate that is not a result.  A look of many spellings is cut to pairs of blocks.
    """
    looks = forms.filter("h is not null").select(F.col(id_col).alias("id"), "field", F.md5("skeleton").alias("k"), F.col("h").alias("v"))
    looks = materialize(looks.filter("id is not null"), "looks")
    several = looks.groupBy("field", "k").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("lo <> hi").select("field", "k")
    rows = materialize(looks.join(several, ["field", "k"]), "several")
    left, right = blocked(rows.select("field", "k", "v").distinct(), ["field", "k"], "v")
    on = ((F.col("l.p") < F.col("l.o")) | (F.col("l.v") < F.col("r.v"))) & (F.col("l.v") != F.col("r.v"))
    for c in ("field", "k", "p", "o"):
        on = on & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    pairs = left.alias("l").join(right.alias("r"), on).select("l.field", "l.k", F.col("l.v").alias("v1"), F.col("r.v").alias("v2"))
    one = pairs.join(rows.select("field", "k", F.col("v").alias("v1"), F.col("id").alias("x")), ["field", "k", "v1"])
    two = one.join(rows.select("field", "k", F.col("v").alias("v2"), F.col("id").alias("y")), ["field", "k", "v2"]).filter("x <> y")
    return two.select(F.least("x", "y").alias("id_1"), F.greatest("x", "y").alias("id_2"), "field").distinct()


def look_classes(forms: DataFrame, id_col: str) -> DataFrame:
    """Adds ``class_id``: the smallest id with a text of the same look in the same field; null for null texts."""
    keyed = forms.withColumn("k", F.md5("skeleton"))
    first = keyed.filter("k is not null").groupBy("field", "k").agg(F.min(id_col).alias("class_id"))
    return keyed.join(first, ["field", "k"], "left").drop("k")


def fold_text(text: str) -> str:
    """The skeleton of a text in plain Python, for use inside Arrow functions."""
    if text.isascii():
        return " ".join(text.translate(_ASCII_CONTROLS).split())
    return " ".join(_recompose(unicodedata.normalize("NFD", text.translate(_translation()))).split())


_ASCII_CONTROLS = {c: " " if chr(c) in _SPACES else None for c in (*range(32), 127)}


@functools.cache
def _translation() -> dict[int, str]:
    return {ord(a): b for a, b in fold_table().items()}


_SPLIT = re.compile(f"[{re.escape(''.join(sorted(_SPACES)))}]+")
_letters: list[tuple[frozenset, frozenset, frozenset]] = []


def script_letters(spark: SparkSession) -> tuple[frozenset, frozenset, frozenset]:
    """The unambiguous Latin letters, the Cyrillic and the Greek ones, as :func:`fold_words` takes them."""
    if not _letters:
        every = F.lit("".join(chr(c) for c in range(0x20, 0x20000) if not 0xD800 <= c < 0xE000))  # none has a letter beyond
        classes = (rf"([\p{{IsLatin}}&&[^{_AMBIGUOUS_LATIN}]])", r"(\p{IsCyrillic})", r"(\p{IsGreek})")
        row = spark.range(1).select(*[F.regexp_extract_all(every, F.lit(c), 1) for c in classes]).first()
        _letters.append(tuple(frozenset(x) for x in row))
    return _letters[0]


class Former:
    """The ``form`` of single texts, equal to that of :func:`consistent_texts`, in plain Python.

    It is for use inside Arrow functions where nothing else is wanted of the texts: no word is shuffled.
    """

    def __init__(self, table: dict[int, str], letters: tuple[frozenset, frozenset, frozenset]) -> None:
        self.table, self.letters = table, letters
        self.word = functools.lru_cache(50_000)(self._word)

    def _word(self, word: str) -> tuple[str, str | None, str]:
        nfd = unicodedata.normalize("NFD", word.translate(self.table))
        latin, cyrillic, greek = (not x.isdisjoint(nfd) for x in self.letters)
        if latin + cyrillic + greek == 1:
            script = "c" if cyrillic else "g" if greek else "l"
        else:
            script = "m" if latin or cyrillic or greek or _AMBIGUOUS.isdisjoint(nfd) else "a"
        form = nfd.translate(_CYRILLIC if script == "c" else _GREEK) if script in "cg" else nfd
        return _recompose(form), _recompose(nfd.translate(_CYRILLIC)) if script == "a" else None, script

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        if text.isascii():
            return " ".join(text.translate(_ASCII_CONTROLS).split())
        words = [self.word(w) for w in _SPLIT.split(text) if w]
        scripts = [w[2] for w in words]
        cyrillic = scripts.count("c") > scripts.count("l")
        return " ".join([other if cyrillic and other is not None else form for form, other, _ in words if form])


_AMBIGUOUS, _CYRILLIC, _GREEK = frozenset(_AMBIGUOUS_LATIN), str.maketrans(_TO_CYRILLIC), str.maketrans(_TO_GREEK)


def form_of(spark: SparkSession) -> Callable[[Column], Column]:
    """A function of a text column: its ``form``."""
    sent = spark.sparkContext.broadcast((_translation(), script_letters(spark)))  # some 7,000 characters

    @F.pandas_udf(T.StringType())
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        former = Former(*sent.value)
        for batch in batches:
            yield pd.Series([former(x) for x in batch], dtype=object)

    return form


def item_forms(items: DataFrame, *want: str) -> DataFrame:
    """The forms of both sentences of the items."""
    return consistent_texts(items, "id", ["sentence_a", "sentence_b"], want or ("skeleton", "form"))
