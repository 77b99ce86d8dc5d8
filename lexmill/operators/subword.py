"""Sub-word statistics: pre-token and character frequencies, and diagnostics of a given tokenizer."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as tx

TOKENIZER = os.environ.get("LEXMILL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


class TooManyUnknown(ValueError):
    """The tokenizer doesn't cover the corpus."""


def pretoken_counts(docs: DataFrame, text_col: str = "text", compatibility: bool = True) -> DataFrame:
    """(token, n): frequencies of words and sign runs after NFKC (or NFC) normalisation."""
    normal = (tx.nfkc if compatibility else tx.nfc)(text_col)
    return docs.select(F.explode(tx.pretokens(normal)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def alphabet(docs: DataFrame, text_col: str = "text", compatibility: bool = False) -> DataFrame:
    """(ch, n): how often each character occurs, from the frequencies of the pre-tokens."""
    tokens = pretoken_counts(docs, text_col, compatibility)
    chars = tokens.select(F.explode(F.split("token", "")).alias("ch"), "n").filter("ch <> ''")
    return chars.groupBy("ch").agg(F.sum("n").alias("n"))


@functools.lru_cache(maxsize=4)
def _tokenizer(content: bytes):
    from tokenizers import Tokenizer

    return Tokenizer.from_buffer(content)


def tokenizer_diagnostics(docs: DataFrame, text_col: str = "text", path: str | None = None, unknown: str = "<unk>") -> DataFrame:
    """(tokens, words, unknown, unk_rate, tokens_per_word) of the non-blank lines under a tokenizer's JSON file.

    The file's bytes are broadcast; they have a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Path(path or TOKENIZER).read_bytes())

    @F.pandas_udf("tokens long, unk long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tok = _tokenizer(shared.value)
        unk = tok.token_to_id(unknown)
        for batch in texts:
            ids = [e.ids for e in tok.encode_batch(batch.tolist(), add_special_tokens=False)]
            yield pd.DataFrame({"tokens": [len(i) for i in ids], "unk": [0 if unk is None else i.count(unk) for i in ids]})

    lines = docs.filter(F.col(text_col).isNotNull()).select(F.explode(F.split(text_col, tx.LINE_BREAK)).alias("line")).select(tx.strip("line").alias("line")).filter("line <> ''")
    each = lines.select(count("line").alias("c"), tx.word_count("line").alias("w")).select("c.tokens", "c.unk", "w")
    zero = F.lit(0).cast("long")
    sums = each.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("tokens", "unk", "w")])
    return sums.select(
        "tokens", F.col("w").alias("words"), F.col("unk").alias("unknown"),
        (F.col("unk") / F.greatest("tokens", F.lit(1))).alias("unk_rate"), (F.col("tokens") / F.greatest("w", F.lit(1))).alias("tokens_per_word"),
    )


def require_coverage(diagnostics: DataFrame, most: float = 0.01) -> float:
    rate = diagnostics.first()["unk_rate"]
    if rate > most:
        raise TooManyUnknown(f"{rate:.4f} of the tokens are unknown; at most {most} may be")
    return rate
