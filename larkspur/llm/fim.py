"""Fill-in-middle: texts cut at two ranks into prefix, middle and suffix, put in another order around three marks.

A text is a row of units: code points, or what a regular expression matches, left to right, with
each stretch between two matches as a unit of its own. An indexable skip list finds the cuts: the
bottom lane links pieces of `PIECE` units, each express lane above links every `FAN`-th tower of the lane below, and
every link carries its widths in units and in code points. A descent adds up the widths it passes,
so both cut ranks are met exactly, in logarithmic time, for texts of any length.

Nulls count as empty texts, and an empty text is plain. A text that has a mark in it is plain, so that
no mark is ambiguous. Draws depend on the id and the seed only: repeated ids are cut by the same
draws, a null id draws as the empty text. Columns named like an output give way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import common

PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"
PIECE, FAN = 64, 8


class SkipList:
    """Units of a text under lanes of widths; `reach` gives the code point at which a unit begins."""

    def __init__(self, text: str, pattern: re.Pattern | None = None) -> None:
        self.text, self.pattern = text, pattern
        if pattern is None:
            units = chars = np.diff(np.append(np.arange(0, len(text), PIECE), len(text)))
        else:
            ends = np.fromiter(unit_ends(text, pattern), np.int64)
            marks = np.append(ends[PIECE - 1 :: PIECE], ends[-1:] if len(ends) % PIECE else [])
            chars, units = np.diff(marks, prepend=0), np.diff(np.append(np.arange(0, len(ends), PIECE), len(ends)))
        self.lanes = [(units, chars)]
        while len(self.lanes[-1][0]) > FAN:
            towers = np.arange(0, len(self.lanes[-1][0]), FAN)
            self.lanes.append(tuple(np.add.reduceat(w, towers) for w in self.lanes[-1]))
        self.n_units = int(units.sum())

    def reach(self, rank: int) -> int:
        """The code points before unit `rank` (those of the whole text, if it has no more units)."""
        link = passed = at = 0
        for units, chars in reversed(self.lanes):
            link *= FAN
            while link < len(units) and passed + units[link] <= rank:
                passed, at, link = passed + int(units[link]), at + int(chars[link]), link + 1
        if passed < rank and self.pattern is None:
            return at + rank - passed
        within = unit_ends(self.text, self.pattern, at) if passed < rank else ()
        for _, end in zip(range(rank - passed), within, strict=False):
            at = end
        return at


def unit_ends(text: str, pattern: re.Pattern, start: int = 0) -> Iterator[int]:
    """Where each unit from `start` (the end of a unit) on ends."""
    at = start
    for match in pattern.finditer(text, start):
        if match.start() > at:
            yield match.start()
        if match.end() > match.start():
            yield match.end()
        at = max(at, match.end())
    if at < len(text):
        yield len(text)


def arranged(text: str, draws: tuple[int, int, int, int], pattern: re.Pattern | None, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle, and output of a text."""
    lanes = SkipList(text, pattern)
    n = lanes.n_units
    if not text or any(m in text for m in MARKS) or draws[2] % 100 >= rate:
        return n, "plain", None, None, text
    first, last = (lanes.reach(r) for r in sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if draws[3] % 100 < spm:
        return n, "spm", first, last - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, last - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(df: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, pattern: str | None = None, rate: int = 90, spm: int = 20, seed: int = 1) -> DataFrame:
    """df's columns `keep` (all by default) with n, form, prefix_chars, middle_chars and output of each text.

    Of a hundred texts about `rate` are transformed, of these about `spm` in a hundred with the suffix first. `pattern` is the
    regular expression of the units, code points by default.
    """
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(drawn, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    kept = keep if keep is not None else df.columns
    rows = df.withColumn("__cut", F.struct(F.coalesce(text, F.lit("")).alias("text"), *draws))
    units = None if pattern is None else re.compile(pattern)

    def compute():
        def run(texts: list[dict]) -> dict[str, list]:
            found = [arranged(t["text"], (t["h1"], t["h2"], t["h3"], t["h4"]), units, rate, spm) for t in texts]
            return {name: [f[i] for f in found] for i, name in enumerate(outputs)}

        return run

    outputs = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}
    return common.with_outputs(rows, "__cut", list(kept), outputs, compute)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made of: no mark is in its parts, so the marks cut them apart."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda i: F.element_at(parts, i)
    return F.when(form == "psm", F.concat(part(2), part(4), part(3))).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(output)
