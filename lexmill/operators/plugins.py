"""Hooks for models the engine doesn't contain: encoders, translators, taggers.

A plug-in is any picklable object with the method named in its protocol; it is called in Arrow batches.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.functions import vector as vx
from lexmill.session import materialize
from lexmill.sources import files

#: What words of some classes become.
SUBSTITUTES = {"PROPN": "person1", "PRON": "pron1", "NUM": "ordinal1"}
ABBREVIATION = "abbr1"


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class Translator(Protocol):
    name: str

    def translate(self, text: str, source: str, target: str) -> str | None: ...


class Tagger(Protocol):
    def tag(self, text: str) -> list[tuple[str, str, str]]:
        """(token, lemma, word class) of each token."""
        ...


def tagged(tagger: Tagger) -> Callable[[Column], Column]:
    """A text's tokens as an array of (token, lemma, kind); only the tagger itself runs in Python."""

    @F.pandas_udf("array<struct<token:string,lemma:string,kind:string>>")
    def tag(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else [{"token": t, "lemma": m, "kind": k} for t, m, k in tagger.tag(x)])

    return tag


def substituted(tokens: Column) -> Column:
    """Tagged tokens as one text.  Substitutes stay as they are, so that the result can be prepared again; then the
    shape of an abbreviation counts before the word class, and what is neither becomes its lemma."""
    by_kind = F.create_map(*[F.lit(x) for pair in SUBSTITUTES.items() for x in pair])

    def word(t: Column) -> Column:
        done = t["token"].isin(*SUBSTITUTES.values(), ABBREVIATION)
        other = F.coalesce(F.element_at(by_kind, F.coalesce(t["kind"], F.lit(""))), F.lower(t["lemma"]))
        return F.when(done, t["token"]).when(tx.has_abbreviation_shape(t["token"]), ABBREVIATION).otherwise(other)

    return F.array_join(F.transform(F.filter(tokens, lambda t: tx.strip(t["token"]) != ""), word), " ")


def token_prep(tagger: Tagger | None) -> Callable[[Column], Column]:
    """Hook for :func:`lexmill.functions.text.normalize`; without a tagger texts stay as they are."""
    return (lambda c: c) if tagger is None else (lambda c: substituted(tagged(tagger)(c)))


class HashedWords:
    """An encoder without a model: signed hashed word counts.  For tests and for checking pipelines."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        import hashlib

        out = np.zeros((len(texts), self.dim), np.float32)
        for i, text in enumerate(texts):
            for w in text.split():
                h = int.from_bytes(hashlib.sha1(w.encode()).digest()[:8], "big")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        return out


def encode(df: DataFrame, encoder: Encoder, text_col: str = "text", normalize: bool = True, unit: bool = True) -> DataFrame:
    """Adds ``embedding``; texts are normalised on the way, so that batch and single calls agree."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = s[s.notna()].tolist()
            vectors = np.asarray(encoder.encode(known), np.float32)
            if len(vectors) != len(known):
                raise ValueError("the encoder gave another number of vectors than texts")
            each = iter(vectors)
            yield pd.Series([None if x is None else next(each) for x in s], dtype=object)

    text = tx.normalize(text_col) if normalize else F.col(text_col)
    out = df.withColumn("embedding", run(text))
    return out.withColumn("embedding", F.transform(vx.unit("embedding"), lambda x: x.cast("float"))) if unit else out


def back_translate(
    texts: DataFrame, providers: list[Translator], pivot: str, source: str, cache: DataFrame, max_retries: int = 2, delay: float = 0.0, cache_path: str | None = None, chunk: int = 10_000
) -> tuple[DataFrame, DataFrame]:
    """(text, paraphrase) and the new cache entries (key, value).

    Providers are tried in order until one gives a text.  Each round trip is looked up in the cache first; only
    misses of all earlier providers go to a provider.  Empty answers and errors are failures and asked again up
    to ``max_retries`` times; a missing library or a wrong setting (ImportError, ValueError) ends the job.

    Misses are asked for in chunks of about ``chunk`` texts.  With a ``cache_path`` every finished chunk is appended to
    that cache at once, so that a job that fails later has not paid for nothing.
    """
    left = texts.select("text").distinct().withColumn("paraphrase", F.lit(None).cast("string"))
    entries = cache.select("key", "value").filter("value <> ''")
    fresh = entries.limit(0)
    for p in providers:
        keyed = left.withColumn("key", tx.cache_key(F.lit(p.name), F.lit(source), F.lit(pivot), F.col("text")))
        known = materialize(keyed.join(entries, "key", "left"), "known")
        todo = known.filter("paraphrase is null and value is null").select("key", "text")

        def ask(batches: Iterator[pd.DataFrame], p: Translator = p) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"key": pdf["key"], "value": [_round_trip(p, t, pivot, source, max_retries, delay) for t in pdf["text"]]})

        n_chunks = max(1, -(-todo.count() // chunk))
        answers = entries.limit(0)
        for c in range(n_chunks):
            some = todo.filter(F.pmod(F.xxhash64("key"), F.lit(n_chunks)) == c)
            # written, so that no provider is asked twice for a text
            part = materialize(some.mapInPandas(ask, "key string, value string").filter("value is not null"), "answers")
            if cache_path is not None:
                files.append_cache(part, cache_path)
            answers = answers.unionByName(part)
        fresh = fresh.unionByName(answers)
        got = known.join(answers.withColumnRenamed("value", "new"), "key", "left")
        left = got.select("text", F.coalesce("paraphrase", "value", "new").alias("paraphrase"))
    return left, fresh


def _round_trip(p: Translator, text: str, pivot: str, source: str, max_retries: int, delay: float) -> str | None:
    """There and back, until an attempt gives a text.  Every call is followed by half the delay, also after an error,
    so that the rate limit holds when the service is failing."""

    def call(x: str, a: str, b: str) -> str | None:
        try:
            return p.translate(x, a, b)
        except (ImportError, ValueError):
            raise
        except Exception:  # translators have errors of their own; all others count as passing failures
            return None
        finally:
            time.sleep(delay / 2)

    for _ in range(max_retries + 1):
        there = call(text, source, pivot)
        if there and (back := call(there, pivot, source)):
            return back
    return None


def rate_delay(requests_per_minute: float, partitions: int = 1) -> float:
    """Seconds between calls of one of so many partitions; 0 without a limit."""
    return 60.0 * partitions / requests_per_minute if requests_per_minute > 0 else 0.0
