"""Text sizes in tokens of a public byte-level BPE tokenizer.

The vocabulary file is a parameter.  The driver reads it and broadcasts its bytes (a file of fixed size, about
1 MB), so that executors need no copy of it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("LEXMILL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the byte-level tokenizers cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, object] = {}


def read_vocabulary(path: str | None = None) -> bytes:
    return Path(path or f"{TOKENIZERS}/{VOCABULARY}").read_bytes()


def encoder(vocabulary: bytes):
    """The tokenizer, built once per process."""
    key = hashlib.sha1(vocabulary).hexdigest()
    if key not in _loaded:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        _loaded[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


def token_sizes(docs: DataFrame, id_col: str, text_col: str, *others: str, vocabulary_path: str | None = None) -> DataFrame:
    """(id, others..., n_tokens BIGINT): 0 for null and blank texts."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(shared.value).encode_ordinary
        for batch in texts:
            yield pd.Series([0 if not t or t.isspace() else len(encode(t)) for t in batch], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), *[F.col(o) for o in others], count(text_col).alias("n_tokens"))


@functools.cache
def default_vocabulary_exists() -> bool:
    return Path(f"{TOKENIZERS}/{VOCABULARY}").exists()
