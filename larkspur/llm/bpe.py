"""Byte-level BPE encoding and decoding by tiktoken with a local rank file.

`encode` maps whole texts to token ids and back to bytes. Texts over
`chunk_chars` are cut at safe places first: no match of the split pattern can
span a place between a non-space character and a following space, nor one
between a letter and a digit, so the pieces encode to the ids of the whole text
while the tokeniser holds one piece at a time. A stretch with no safe place is
encoded whole.

Null texts count as empty; empty texts have no ids; repeated rows each keep
their row; an empty table gives an empty result; an input column that has an
output's name is replaced by the output.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkspur.llm import common

RANKS = "byte_bpe_50k.tiktoken"

#: Between a non-space and a space, or a letter and an ASCII digit.
SAFE = regex.compile(r"(?<=\S)(?= )|(?<=\p{L})(?=[0-9])")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, chunk_chars: int) -> Iterator[str]:
    """text in pieces of about chunk_chars, cut only where no pattern match can span."""
    start = 0
    while len(text) - start > chunk_chars:
        cut = SAFE.search(text, start + chunk_chars)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(codec: tiktoken.Encoding, text: str, chunk_chars: int) -> array:
    ids = array("I")
    for piece in safe_pieces(text, chunk_chars):
        ids.extend(codec.encode_ordinary(piece))
    return ids


def encode(
    df: DataFrame,
    text: str = "text",
    ranks_path: str | None = None,
    pattern: str | None = None,
    chunk_chars: int = 1 << 16,
    keep: list[str] | None = None,
) -> DataFrame:
    """df's columns `keep` (all by default) with n_tokens, ids (little-endian unsigned
    32-bit integers) and decoded (the bytes that these ids stand for)."""
    ranks_path = ranks_path or public_tokenizers.path(RANKS)
    pattern = pattern or public_tokenizers.PATTERN

    def compute():
        codec = encoding(ranks_path, pattern)

        def run(texts: list[str | None]) -> dict[str, list]:
            ids = [encode_text(codec, t or "", chunk_chars) for t in texts]
            return {"n_tokens": [len(x) for x in ids], "ids": [x.tobytes() for x in ids], "decoded": [codec.decode_bytes(x.tolist()) for x in ids]}

        return run

    return common.with_outputs(df, text, keep, {"n_tokens": T.LongType(), "ids": T.BinaryType(), "decoded": T.BinaryType()}, compute)
