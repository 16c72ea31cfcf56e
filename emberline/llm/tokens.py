"""Token counts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the pre-split pattern that this family of vocabularies was published with.
PRE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    """Path of the vocabulary that the machine offers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str) -> Any:
    """The encoder of a rank file (base64 token, rank per line)."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("own", pat_str=PRE_SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str | None = None) -> Column:
    """Tokens of the whole text; 0 for NULL and empty ones. Strings that look like special tokens are ordinary text.

    vocabulary: path of a rank file that every executor has.
    """
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in batch], dtype="int64")

    return count(text)


def with_tokens(documents: DataFrame, text: str = "text", vocabulary: str | None = None, into: str = "n_tokens") -> DataFrame:
    """documents with their token counts, taken where the texts are read: no text is shuffled.

    Encoding costs more than its input is large, so read with spark.sql.files.maxPartitionBytes small enough to give every core a part.
    """
    return documents.withColumn(into, token_count(F.col(text), vocabulary))
