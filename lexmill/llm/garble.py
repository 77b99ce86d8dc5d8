"""Problem 1: text garbled by a wrong character encoding.

Every distinct word of a clean corpus, and every distinct run of non-ASCII characters in it (accents and
signs inside or between ASCII words), is garbled by all encoding chains.  The words and runs of the examined
texts that the clean corpus doesn't hold are hash-joined with that table, from which a bit set of those words and
runs has removed what can't match before it is shuffled; a hit gives the original.  Runs
that no clean word explains are decoded backwards, strictly, as an exact check for words the clean corpus
lacks, and U+FFFD shows a loss in any case.

Guards: a form that the clean corpus holds, or that only looks different to a machine (see
:mod:`lookalike`) or in case, is no garbling; a form of one character never is, so quoted letters such as an A with
tilde are sound; chains between one-byte encodings count for whole words of some length only.

Defined cases: null texts are sound and rows without an id are left out; empty texts are sound; repeated rows give one row; other
columns are ignored; an empty table gives no rows; words of any length are looked up whole.  With an empty
clean corpus only the backward check and U+FFFD are left.
"""

from __future__ import annotations

import codecs
import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.bits import bit_set, bits_for
from lexmill.llm.lookalike import SPACE, fold_text
from lexmill.session import materialize, parallelism

_LATIN = ("cp1252", "cp437", "cp850", "mac_roman", "latin_1")
_CYRILLIC = ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")
_READ_AS = ("latin_1", "cp1252", "cp1251", "koi8_r", "cp437", "cp866", "cp850", "mac_roman", "mac_cyrillic", "iso8859_5", "cp1250", "iso8859_15")
_TWICE = ("latin_1", "cp1252", "cp1252?", "cp1251")
LOST = "�"
SHARE = 20_000  #: clean units that a task garbles


@functools.cache
def _table(encoding: str) -> str:
    """The 256 characters of a one-byte encoding; bytes it lacks stay as control characters, or are lost with '?'."""
    name, lossy = encoding.rstrip("?"), encoding.endswith("?")
    each = (bytes([b]).decode(name, "replace") for b in range(256))
    return "".join(chr(b) if c == LOST and not lossy else c for b, c in enumerate(each))


def _decode(data: bytes, encoding: str) -> str:
    return codecs.charmap_decode(data, "strict", _table(encoding))[0]


@functools.cache
def _writable(encoding: str) -> frozenset[str]:
    """The characters that a one-byte encoding has."""
    return frozenset(c for c in map(lambda b: bytes([b]).decode(encoding, "ignore"), range(256)) if c)


def _encode(text: str, encoding: str) -> bytes | None:
    """The inverse of ``_decode``; None if the text can't come from it."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        out = bytearray()
        for c in text:
            try:
                out += c.encode(encoding)
            except UnicodeEncodeError:
                if not 0x80 <= ord(c) < 0xA0:
                    return None
                out.append(ord(c))
        return bytes(out)


def _chains() -> list[tuple[str, ...]]:
    """Chains as steps 'written>read'; all UTF-8 ones, those between one-byte encodings, and double ones."""
    utf8 = [(f"utf_8>{e}",) for e in (*_READ_AS, "cp1252?", "cp1251?", "cp1250?")]
    single = [(f"{a}>{b}",) for group in (_LATIN, _CYRILLIC) for a in group for b in ("latin_1", "cp1252", "cp1251", "koi8_r", "cp866", "cp437", "cp850", "mac_roman") if a != b and {a, b} != {"latin_1", "cp1252"}]
    twice = [(f"utf_8>{a}", f"utf_8>{b}") for a in _TWICE for b in _TWICE]
    mixed = [(f"cp1251>{a}", f"utf_8>{b}") for a in ("latin_1", "cp1252") for b in ("latin_1", "cp1252")]
    return utf8 + single + twice + mixed


CHAINS = _chains()
_CONTROLS = re.compile("[\x80-\x9f]")


def _lossy(form: str) -> Iterator[str]:
    """Forms after a clean-up that drops control characters or the circumflexed A before a sign."""
    yield _CONTROLS.sub("", form)
    if "Â" in form:
        yield form.replace("Â", "")
        yield _CONTROLS.sub("", form.replace("Â", ""))


def garble(text: str, chain: tuple[str, ...]) -> str | None:
    """The text after the chain's wrong readings; None where it can't be written in the encoding."""
    for step in chain:
        written, read = step.split(">")
        try:
            text = _decode(text.encode(written), read)
        except UnicodeEncodeError:
            return None
    return text


def _script(text: str) -> set[str]:
    return {unicodedata.name(c, "?").split()[0] for c in text if c.isalpha()}


def garbled_forms(unit: str, whole: bool, weak: bool = False) -> list[tuple[str, str]]:
    """(form, chain) of a word (``whole``) or a run, without those that prove nothing.

    ``weak``: of a word, just those that are too short to prove anything by themselves.
    """
    if weak:
        some = [(garble(unit, chain), " ".join(chain)) for chain in CHAINS if whole and len(chain) == 1 and chain[0][:6] != "utf_8>"]
        strong = {form for form, _ in garbled_forms(unit, whole)}
        return [(f, c) for f, c in some if f and f != unit and f not in strong and LOST not in f]
    out: dict[str, str] = {}
    for chain in CHAINS:
        by_bytes = chain[0].startswith("utf_8>")
        if not by_bytes and not whole:
            continue
        form = garble(unit, chain)
        if form is None or form == unit or len(form) < 2 or form in out or form.strip(LOST) == "":
            continue
        if not by_bytes and len(chain) == 1:
            if len(form) < (4 if len(_script(form)) == 1 else 3) or fold_text(form).lower() == fold_text(unit).lower():
                continue
        out[form] = " ".join(chain)
        if by_bytes:
            for short in _lossy(form):
                if len(short) > max(1, len(unit)) and not short.isascii():
                    out.setdefault(short, " ".join(chain) + " -")
    out.pop(unit, None)
    return list(out.items())


def all_forms(units: list[str]) -> Iterator[tuple[np.ndarray, str]]:
    """(places of units, their forms as lines) by each chain and each clean-up, for many units at once; nothing is left out."""
    everything = np.arange(len(units))
    for chain in CHAINS:
        places, text = everything, "\n".join(units)
        for step in chain:
            written, read = step.split(">")
            if written != "utf_8":
                known = _writable(written)
                lines = text.split("\n")
                kept = [k for k, line in enumerate(lines) if known.issuperset(line)]
                places, text = places[kept], "\n".join([lines[k] for k in kept])
            text = _decode(text.encode(written), read)
            if not len(places):
                break
        if not len(places):
            continue
        yield places, text
        if chain[0].startswith("utf_8>"):
            for short in _lossy(text):
                if short != text:
                    yield places, short


def line_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each line, equal in every process."""
    points = np.frombuffer((text + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(points == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    at = np.arange(len(points)) - np.repeat(starts, ends - starts + 1)
    x = points * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x[ends] = 0
    x = np.add.reduceat(x, starts) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


PROBES = 3  #: places of a unit in the bit set


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(PROBES, lines) places below 2^bits."""
    odd = (np.arange(PROBES, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    return (hashes * odd[:, None]) >> np.uint64(64 - bits)


def _wanted_bits(units: DataFrame) -> tuple[bytes, int]:
    """The units (unit) as a bit set with PROBES places each, and its size."""
    bits = bits_for(4 * units.count())

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def places(s: pd.Series) -> pd.Series:
        return pd.Series(list(_probes(line_hashes("\n".join(s)), bits).T.astype(np.int64)) if len(s) else [], dtype=object)

    return bit_set(units.select(F.explode(places("unit")).alias("at")), F.col("at"), bits), bits


_UTF8 = ("latin_1", "cp1252", "cp1251", "koi8_r", "cp437", "cp866", "cp850", "mac_roman")


def _sound(text: str, alphabet: frozenset[str]) -> bool:
    """Characters of the clean corpus, letters of one script."""
    return alphabet.issuperset(text) and len(_script(text)) <= 1


def ungarble(run: str, alphabet: frozenset[str]) -> str | None:
    """A run of non-ASCII characters decoded backwards through UTF-8, up to three times; None if it can't be.

    The result has only characters of the clean corpus.  Up to three characters at either end of the run may
    belong to a sequence that was cut.
    """
    if run.isalpha() and _sound(run, alphabet):
        return None  # looks like a piece of a word; some letters happen to form a byte sequence
    best = None
    for encoding in _UTF8:
        text, steps = run, 0
        while steps < 3 and len(text) > 1 and not text.isascii():
            data = _encode(text, encoding)
            if data is None:
                break
            for cut in ((0, 0), (0, 1), (1, 0), (0, 2), (1, 1), (2, 0), (2, 1), (1, 2), (2, 2)):
                core = data[cut[0] : len(data) - cut[1]]
                try:
                    decoded = core.decode("utf_8")
                except UnicodeDecodeError:
                    continue
                break
            else:
                break
            if not decoded or len(decoded) >= len(core) or (cut != (0, 0) and len(decoded) < 2):
                break
            text, steps = (decoded if cut == (0, 0) else text[: cut[0]] + decoded + text[len(text) - cut[1] :]), steps + 1
            if _sound(decoded, alphabet) and any(ord(c) > 0x7F for c in decoded):
                if best is None or len(text) < len(best):
                    best = text
            if cut != (0, 0):
                break
    return best


_EDGE = r"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+"
_RUN = r"[^\x00-\x7f]+"
#: Spaces between words of texts that may be garbled: 0xA0 and 0x85 can be parts of a garbled letter.
_PLAIN_SPACE = r"[ \t\r\n\x{2007}\x{2009}\x{202f}\x{3000}]+"
#: A no-break space inside a garbled letter that became a plain one.
_BROKEN = "([Ãà]) (?=[ªÂ«â])"


def _units(texts: DataFrame, keys: list[str], space: str) -> DataFrame:
    """(keys..., kind, unit): words (w) and runs (r) with non-ASCII characters."""
    tokens = texts.filter(F.col("text").rlike(_RUN)).select(*keys, F.explode(F.split("text", space)).alias("t")).filter(F.col("t").rlike(_RUN))
    word = F.regexp_replace("t", f"^{_EDGE}|{_EDGE}$", "")
    runs = F.transform(F.array_distinct(F.regexp_extract_all("t", F.lit(f"({_RUN})"), 1)), lambda r: F.struct(F.lit("r").alias("kind"), r.alias("unit")))
    both = F.concat(F.array(F.struct(F.lit("w").alias("kind"), word.alias("unit"))), runs)
    return tokens.select(*keys, F.explode(both).alias("u")).select(*keys, "u.kind", "u.unit")


def garbled_table(clean: DataFrame, wanted: DataFrame, weak: bool = False) -> DataFrame:
    """(kind, form, original, chain, n): garbled forms of the clean units (kind, unit, n) that may be among
    ``wanted`` (unit).

    All forms are made, but only those in a bit set of the wanted units leave their task; it lets some others
    pass and keeps none back.
    """
    shared = clean.sparkSession.sparkContext.broadcast(_wanted_bits(wanted))
    # partitions by size of the words would be few: the forms are some hundred times as large as they are
    clean = clean.repartition(max(parallelism(clean.sparkSession), -(-clean.count() // SHARE)))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have, bits = np.frombuffer(shared.value[0], np.uint8), shared.value[1]

        def wanted_lines(text: str) -> np.ndarray:
            at = _probes(line_hashes(text), bits)
            return ((have[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1).all(axis=0)

        for pdf in batches:
            units, rows = pdf["unit"].tolist(), []
            some = np.zeros(len(units), bool)
            for places, text in all_forms(units) if units else ():
                some[places[wanted_lines(text)]] = True
            for i in np.flatnonzero(some):
                kind, unit, n = pdf["kind"].iat[i], units[i], pdf["n"].iat[i]
                forms = garbled_forms(unit, kind == "w", weak)
                if forms:
                    keep = wanted_lines("\n".join([f for f, _ in forms]))
                    rows += [(kind, form, unit, chain, n) for (form, chain), k in zip(forms, keep, strict=True) if k]
            yield pd.DataFrame(rows, columns=["kind", "form", "original", "chain", "n"])

    return clean.mapInPandas(make, "kind string, form string, original string, chain string, n long")


def _healed(texts: DataFrame) -> DataFrame:
    return texts.withColumn("text", F.regexp_replace("text", _BROKEN, "$1\u00a0"))


def clean_alphabet(clean: DataFrame) -> frozenset[str]:
    """The non-ASCII characters of the clean units; there are at most as many as Unicode has."""
    found = clean.filter("kind = 'r'").select(F.explode(F.split("unit", "")).alias("c")).distinct().collect()
    return frozenset(r.c for r in found) | frozenset(map(chr, range(32, 127)))


def garbled_units(texts: DataFrame, clean_texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, frozenset[str]]:
    """Of texts(id, text) and clean_texts(text): the units (id, kind, unit), (kind, unit, original, chain) of the
    garbled ones, the clean units and the clean characters."""
    clean = materialize(_units(clean_texts, [], SPACE + "+").groupBy("kind", "unit").agg(F.count("*").alias("n")), "clean")
    alphabet = clean_alphabet(clean)
    units = materialize(_units(_healed(texts), ["id"], _PLAIN_SPACE).join(clean, ["kind", "unit"], "left_anti").distinct(), "units")
    odd = materialize(units.select("kind", "unit").distinct(), "odd")
    table = garbled_table(clean, odd)
    # Spark can't foresee the table's size; without the hint it would broadcast it
    hits = odd.join(table.hint("merge"), (odd.kind == table.kind) & (odd.unit == table.form)).groupBy(odd.kind, odd.unit)
    hits = hits.agg(F.max(F.struct("n", "original", "chain")).alias("b")).select("kind", "unit", "b.original", "b.chain")
    hits = materialize(hits, "hits")

    @F.pandas_udf("string")
    def back(s: pd.Series) -> pd.Series:
        return s.map(lambda r: ungarble(r, alphabet))

    rest = odd.filter("kind = 'r' and length(unit) > 1").join(hits, ["kind", "unit"], "left_anti")
    checked = rest.select("kind", "unit", back("unit").alias("original"), F.lit("backwards").alias("chain")).filter("original is not null")
    return units, hits.unionByName(checked), clean, alphabet


def garbled_records(df: DataFrame, id_col: str, text_col: str, clean_texts: DataFrame) -> DataFrame:
    """(id_col): records whose text is garbled in whole or in part.  clean_texts(text) is the clean corpus."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    units, found, _, _ = garbled_units(texts, clean_texts)
    lost = texts.filter(F.col("text").contains(LOST)).select("id")
    return units.join(found, ["kind", "unit"], "left_semi").select("id").unionByName(lost).distinct().withColumnRenamed("id", id_col)


_EMPTY: list = []


def _replace(text: str, pairs: list) -> str:
    """The garbled words, then the garbled runs, replaced; longer ones first."""
    for kind in "wr":
        own = {p["unit"]: p["original"] for p in pairs if p["kind"] == kind}
        if own:
            pattern = "|".join(re.escape(u) for u in sorted(own, key=lambda u: (-len(u), u)))
            around = (r"(?<![^\s!-/:-@\[-`{-~])", r"(?![^\s!-/:-@\[-`{-~])") if kind == "w" else ("", "")
            text = re.sub(around[0] + f"(?:{pattern})" + around[1], lambda m: own[m.group()], text)
    return text


def restored_records(df: DataFrame, id_col: str, text_col: str, clean_texts: DataFrame) -> DataFrame:
    """(id_col, garbled, restored, complete): the garbled texts as they were written, as far as that is known.

    ``complete`` says that no garbled unit and no lost character is left.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null").distinct()
    units, found, clean, alphabet = garbled_units(texts, clean_texts)
    strong = materialize(units.join(found, ["kind", "unit"]), "strong")
    # words too short to prove anything count in records that have a longer word of the same chain
    short = materialize(strong.select("id", "chain").distinct().join(units.join(found, ["kind", "unit"], "left_anti"), "id"), "short")
    weak = garbled_table(clean, short.select("unit").distinct(), weak=True).groupBy("kind", "form", "chain").agg(F.max(F.struct("n", "original"))["original"].alias("original"))
    short = short.join(weak.withColumnRenamed("form", "unit").hint("merge"), ["kind", "unit", "chain"])
    pairs = strong.unionByName(short).groupBy("id").agg(F.collect_set(F.struct("kind", "unit", "original")).alias("pairs"))

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            new = [_replace(re.sub(_BROKEN, "\\1\u00a0", t), list(p) if p is not None else _EMPTY) for t, p in zip(pdf["text"], pdf["pairs"], strict=True)]
            whole = [LOST not in n and not any(ungarble(r, alphabet) for r in re.findall(_RUN, n)) for n in new]
            yield pd.DataFrame({"id": pdf["id"], "garbled": pdf["text"], "restored": new, "complete": whole})

    bad = texts.join(pairs, "id", "left").filter(F.col("pairs").isNotNull() | F.col("text").contains(LOST))
    out = bad.mapInPandas(fix, f"id {dict(texts.dtypes)['id']}, garbled string, restored string, complete boolean")
    return out.withColumnRenamed("id", id_col)
