"""Text sizes in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranks file of the tokenizer, a parameter of every operator that sizes texts; it must be
#: readable under this path on every worker.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this public tokenizer cuts text before merging bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    """Tokens of a whole text; text that looks like a special token is ordinary text."""
    return len(encoding(path).encode_ordinary(text))


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of each text as long; 0 for null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            yield pa.array([0 if not x.is_valid else len(encode(x.as_py())) for x in batch], pa.int64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "long")(text)
