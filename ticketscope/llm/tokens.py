"""Byte-pair encoding with a published vocabulary, inside tasks."""

from __future__ import annotations

import base64
from functools import lru_cache

import tiktoken
from pyspark.sql import SparkSession

# Fixed value: the split pattern that belongs to the byte-level vocabularies.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Default place of the vocabulary (a parameter of every operator that encodes).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A vocabulary file above this size is refused: it travels to every executor.
MAX_VOCABULARY_BYTES = 16 << 20


def vocabulary(spark: SparkSession, path: str = VOCABULARY):
    """Broadcast of the vocabulary file (base64 token and rank per line)."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary above {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


@lru_cache(maxsize=2)
def encoder(data: bytes) -> tiktoken.Encoding:
    """One encoder per Python worker."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_ids(data: bytes) -> int:
    """Ids of the vocabulary; the next id is free for an end-of-text mark."""
    return 1 + max(int(x.split()[1]) for x in data.splitlines())
