"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenising pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Token counts under the vocabulary of a file's content; null and empty texts have 0."""

    def __init__(self, vocabulary: bytes):
        self.encode = _encoding(vocabulary).encode_ordinary

    def __call__(self, text: str | None) -> int:
        return len(self.encode(text)) if text else 0


def with_tokens(df: DataFrame, text_col: str = "text", out_col: str = "n_tokens", tokenizer: str = f"{TOKENIZER_DIR}/{TOKENIZER}") -> DataFrame:
    """The rows with the number of tokens of a text; null and empty texts have 0.

    The vocabulary is read where the plan is made and sent with the job (under 2 MB), so the path need
    not exist on any other machine.
    """
    with open(tokenizer, "rb") as f:
        vocabulary = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(vocabulary.value)
        for texts in batches:
            yield texts.map(counter).astype("int32")

    return df.withColumn(out_col, count(text_col))
