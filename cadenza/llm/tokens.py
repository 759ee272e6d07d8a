"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.ship import by_value
from ..session import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the byte-level vocabularies cut a text into words before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _counter(path: str, ranks_bytes, text: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_bytes.value.splitlines())}
        enc = tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for f in frames:
            sizes = [len(enc.encode_ordinary(x)) if x else 0 for x in f[text]]
            yield f.drop(columns=[text]).assign(n_tokens=pd.Series(sizes, dtype="int64", index=f.index))

    return run


def with_token_counts(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The other columns and n_tokens, the size of the whole text in tokens of the tokenizer file at `tokenizer`.

    Null and empty texts have 0 tokens. The vocabulary (under 1 MB, whatever the data's size) is broadcast. Texts are counted where
    the scan put them, unless it has fewer tasks than there are cores; `df` must not hold a shuffle itself."""
    ranks = df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text] + ["n_tokens long"])
    return spread(df).mapInPandas(_counter(tokenizer, ranks, text), schema)


by_value(__name__)
