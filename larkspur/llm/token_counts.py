"""Token counts by sentencepiece, with overlap resynchronisation for huge texts.

A text over `chunk_chars` is encoded in chunks that overlap. Within an overlap
both encodings give token starts with character offsets; they are spliced at a
start that both have and that is proven stable: a space after a character that
isn't white space, where no piece of the vocabulary can reach across. Only tokens
left of it count from the left chunk and only tokens from it on count from the
right one. If an overlap has no such place, it is widened, up to the whole rest.
Models with a piece that can span such a place are never chunked.

Null texts count as empty and have no tokens; repeated rows each keep their row;
an empty table gives an empty result; an input column with an output's name is
replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import common

MODEL = "piece_bpe_32k.model"
STABLE = regex.compile(r"(?<=[\p{L}\p{N}\p{P}]) (?=[\p{L}\p{N}])")


@lru_cache(maxsize=4)
def processor(model_path: str) -> tuple[sentencepiece.SentencePieceProcessor, bool]:
    """The model, and whether no piece holds a space mark after another character."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = (sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size()))
    return sp, not any("▁" in p for p in pieces)


def token_starts(sp: sentencepiece.SentencePieceProcessor, text: str, base: int) -> list[int]:
    """Start of each token of text, as a character offset in the document."""
    raw = np.frombuffer(text.encode(), np.uint8)
    chars = np.append(np.cumsum((raw & 0xC0) != 0x80) - 1, len(text)) + base
    return [int(chars[p.begin]) for p in sp.encode(text, return_type="proto").pieces]


def splice_at(text: str, lo: int, hi: int, left: list[int], right: list[int]) -> int | None:
    """A stable place in (lo, hi) where both encodings begin a token; the one nearest the middle."""
    both = set(left) & set(right)
    places = [m.start() for m in STABLE.finditer(text, lo, hi) if lo < m.start() and m.start() in both]
    return min(places, key=lambda p: abs(2 * p - lo - hi), default=None)


def count_long(sp: sentencepiece.SentencePieceProcessor, text: str, chunk_chars: int, overlap: int) -> int:
    total, done, end = 0, 0, chunk_chars
    left = token_starts(sp, text[:end], 0)
    while end < len(text):
        wide, place = overlap, None
        while place is None:
            start = max(done, end - wide)
            stop = min(len(text), start + chunk_chars + wide)
            if start == done:  # nothing to splice: the rest of this chunk and the next in one
                end = stop
                left = token_starts(sp, text[done:end], done)
                break
            right = token_starts(sp, text[start:stop], start)
            place = splice_at(text, start + 1, end - 1, left, right)
            wide *= 2
        else:
            total += sum(done <= b < place for b in left)
            # from the place on, without the mark that a chunk begins with: the space there is that mark
            done, end = place, stop
            left = [b for b in right if b >= place]
    return total + sum(b >= done for b in left)


def count_tokens(
    df: DataFrame,
    text: str = "text",
    model_path: str | None = None,
    chunk_chars: int = 1 << 16,
    overlap: int = 512,
    limit: int = 4096,
    keep: list[str] | None = None,
) -> DataFrame:
    """df's columns `keep` (all by default) with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    model_path = model_path or public_tokenizers.path(MODEL)
    kept = [c for c in (keep if keep is not None else df.columns) if c not in ("n_bytes", "n_tokens", "over_limit")]

    def compute():
        sp, chunkable = processor(model_path)

        def run(texts: list[str | None]) -> dict[str, list]:
            texts = [t or "" for t in texts]
            counts = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if not chunkable or len(t) <= chunk_chars]
            for i, ids in zip(short, sp.encode([texts[i] for i in short], num_threads=1), strict=True):
                counts[i] = len(ids)
            for i in set(range(len(texts))).difference(short):
                counts[i] = count_long(sp, texts[i], chunk_chars, overlap)
            return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts}

        return run

    found = common.with_outputs(df, text, kept, {"n_bytes": T.LongType(), "n_tokens": T.LongType()}, compute)
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
