"""Byte-pair tokens by a vocabulary file that every executor has, in Arrow batches."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(vocabulary: str, pattern: str = PATTERN):
    """The encoding of a file with a base64 token and its rank on each line; loaded once in each worker."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def bpe_tokens(text: Column, vocabulary: str, pattern: str = PATTERN) -> Column:
    """The text's tokens, each decoded by itself: one that is part of a character is a replacement mark. Null for null."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        own = encoding(vocabulary, pattern)
        return pd.Series([[own.decode([t]) for t in own.encode_ordinary(x)] if isinstance(x, str) else None for x in texts], dtype=object)

    return split(text)


def bpe_count(text: Column, vocabulary: str, pattern: str = PATTERN) -> Column:
    """Number of tokens; 0 for null."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        own = encoding(vocabulary, pattern)
        return pd.Series([len(own.encode_ordinary(x)) if isinstance(x, str) else 0 for x in texts], dtype="int64")

    return count(text)
