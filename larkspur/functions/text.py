"""Text columns: cleaning, normal forms, labels, pay and experience phrases."""

from __future__ import annotations

import json
import unicodedata
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Character references by name, with and without a closing semicolon, from the standard library's table.
NAMED = {k: v for k, v in html5.items()}
#: Those that need no semicolon, the longest first: what a text may have run on.
OPEN_ENDED = sorted((k for k in NAMED if not k.endswith(";")), key=lambda k: (-len(k), k))
#: What numbers stand for that name no character of their own: code page 1252 for 128 to 159.
MISNUMBERED = {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)} | {"13": "\r", "0": "\ufffd"}
UNMARKED = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<template\b[^>]*>.*?</template\s*>|<[^>]*>"


def first_truthy(*columns: Column) -> Column:
    """The first column that is neither null nor blank, trimmed; '' if there is none."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns), F.lit(""))


def let(value: Column, f) -> Column:
    """f of value, with value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Runs of white space but for single spaces, which stay as they are.
SPACES = r" [\s\x1c-\x1f\x85\pZ]+|[\s\x1c-\x1f\x85\pZ&&[^ ]][\s\x1c-\x1f\x85\pZ]*"
#: Runs of what isn't a lower-case ASCII letter or digit, single spaces too: leaving these out takes two alternatives, which are tried at every character and cost nine times the plain run.
OTHERS = "[^a-z0-9]+"


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def constant_map(entries: dict[str, str]) -> Column:
    """A literal map, folded once from one text."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def decode_entities(c: Column) -> Column:
    """Character references decoded once: by name (the longest one that fits, where no semicolon closes it), by number, by hexadecimal number."""
    head = lambda p, pattern: F.regexp_extract(p, pattern, 1)
    rest = lambda p, used: F.substring(p, F.length(used) + 1, F.length(p))

    def character(n: Column, table: Column) -> Column:
        good = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(good, n).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.coalesce(F.element_at(table, n.cast("string")), char)

    def numbered(p: Column, digits: str, base: int, used: Column, table: Column) -> Column:
        n = F.coalesce(F.conv(head(p, digits), base, 10).try_cast("long"), F.lit(0xFFFD).cast("long"))
        return F.concat(let(n, lambda x: character(x, table)), rest(p, used))

    def named(p: Column, name: Column, table: Column) -> Column:
        run_on = head(p, f"^({'|'.join(OPEN_ENDED)})")
        other = F.when(run_on != "", F.concat(F.element_at(table, run_on), rest(p, run_on))).otherwise(F.concat(F.lit("&"), p))
        return let(F.when(name != "", F.element_at(table, name)), lambda v: F.when(v.isNotNull(), F.concat(v, rest(p, name))).otherwise(other))

    def one(p: Column, table: Column) -> Column:
        decimal, hexadecimal = head(p, r"^(#[0-9]+;?)"), head(p, r"^(#[xX][0-9a-fA-F]+;?)")
        return (
            F.when(p.startswith("amp;"), F.concat(F.lit("&"), rest(p, F.lit("amp;"))))
            .when(decimal != "", numbered(p, r"^#0*([0-9]{1,9})", 10, decimal, table))
            .when(hexadecimal != "", numbered(p, r"^#[xX]0*([0-9a-fA-F]{1,9})", 16, hexadecimal, table))
            .otherwise(named(p, head(p, r"^([A-Za-z][A-Za-z0-9]*;?)"), table))
        )

    joined = lambda x, table: F.concat(F.get(x, F.lit(0)), F.array_join(F.transform(F.slice(x, 2, F.size(x)), lambda p: one(p, table)), ""))
    pieces = let(constant_map(NAMED | MISNUMBERED), lambda table: let(F.split(c, "&(?=[#A-Za-z])"), lambda x: joined(x, table)))
    return F.when(F.contains(c, F.lit("&")), pieces).otherwise(c)


def clean_text(c: Column) -> Column:
    """Text without markup, white space squeezed; null gives ''. Only where both angle brackets occur, tags, comments, scripts and styles are
    stripped and references decoded as markup first. Then references are decoded."""

    def plain(x: Column) -> Column:
        marked = F.contains(x, F.lit("<")) & F.contains(x, F.lit(">"))
        bare = F.when(marked, F.regexp_replace(x, UNMARKED, " ")).otherwise(x)
        return F.aggregate(F.sequence(F.lit(1), F.when(marked, 2).otherwise(1)), bare, lambda text, _: decode_entities(text))

    return let(F.coalesce(c, F.lit("")), lambda x: squeezed(plain(x)))


def clean_nested(c: Column) -> Column:
    """clean_text for markup that was escaped once more."""
    return clean_text(F.aggregate(F.sequence(F.lit(1), F.lit(2)), F.coalesce(c, F.lit("")), lambda text, _: decode_entities(text)))


def folded(c: Column) -> Column:
    """Lower case, with sharp s as ss."""
    return F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("ß"), F.lit("ss")))


def match_text(c: Column) -> Column:
    """Lower-case ASCII letters and digits; every other run is one space."""
    return F.trim(F.regexp_replace(folded(c), OTHERS, " "))


def tech_text(c: Column) -> Column:
    """match_text that keeps + # . and /."""
    return F.trim(F.regexp_replace(folded(c), "[^a-z0-9+#./]+", " "))


def slugify(c: Column, default: str = "job") -> Column:
    return F.coalesce(F.nullif(F.replace(match_text(c), F.lit(" "), F.lit("-")), F.lit("")), F.lit(default))


def ascii_form(text: str) -> str:
    """compact_text of one value."""
    return "".join(x for x in unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower() if x.isalnum())


#: Characters beyond ASCII that compact_text keeps as one ASCII letter or digit, what they become, and a pattern of those that it keeps as several.
DECOMPOSED = {c: ascii_form(c) for c in map(chr, range(0x80, 0x30000)) if unicodedata.decomposition(c)}
ONE = {c: form for c, form in DECOMPOSED.items() if len(form) == 1}
POINTS = sorted(ord(c) for c, form in DECOMPOSED.items() if len(form) > 1)
SEVERAL = "[" + "".join(f"\\x{{{first:x}}}-\\x{{{last:x}}}" for first, last in zip((p for p in POINTS if p - 1 not in POINTS), (p for p in POINTS if p + 1 not in POINTS), strict=True)) + "]"


@pandas_udf(T.StringType())
def ascii_forms(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else ascii_form(x))


def compact_text(c: Column | str) -> Column:
    """Compatibility-decomposed text: ASCII letters and digits alone, in lower case. Only texts with a character that becomes
    several (a ligature, a fraction) are decomposed in Arrow batches; else characters are put in place of characters."""
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    several = F.regexp_replace(text, "[\\x00-\\x7f]+", "").rlike(SEVERAL)
    plain = F.when(text.rlike("[^\\x00-\\x7f]"), F.translate(text, "".join(ONE), "".join(ONE.values()))).otherwise(text)
    return F.coalesce(ascii_forms(F.when(several, text)), F.lower(F.regexp_replace(plain, "[^a-zA-Z0-9]+", "")))


def has_phrase(haystack: Column, needle: Column | str) -> Column:
    """Whether the words of needle occur side by side; both in a normal form."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(F.concat(F.lit(" "), haystack, F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))


def hits(text: Column, terms: tuple[str, ...], phrase: bool = False) -> Column:
    """The terms, in list order, that occur in text: as substrings or as whole phrases."""
    listed = F.array(*map(F.lit, terms))
    if phrase:
        return let(F.concat(F.lit(" "), text, F.lit(" ")), lambda x: F.filter(listed, lambda t: F.contains(x, F.concat(F.lit(" "), t, F.lit(" ")))))
    return let(text, lambda x: F.filter(listed, lambda t: F.contains(x, t)))


def any_hit(text: Column, terms: tuple[str, ...]) -> Column:
    return let(text, lambda x: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(x, t)))


# Words of a slug that stay in capitals.
SLUG_ACRONYMS = ("ai", "bi", "ds", "epm", "ii", "iii", "iv", "ml", "nlp", "sql")


def title_from_slug(slug: Column, acronyms: tuple[str, ...] = SLUG_ACRONYMS) -> Column:
    """Words of a hyphenated slug as a title, acronyms in capitals."""
    words = F.filter(F.split(slug, "[-_]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(F.lower(w).isin(*acronyms), F.upper(w)).otherwise(F.initcap(w))), " ")


def cut_at_marker(title: Column, markers: tuple[str, ...]) -> Column:
    """title up to the earliest marker that isn't at its beginning, without trailing separators."""
    low = F.lower(title)
    first = F.least(*(F.when(F.instr(low, m) > 1, F.instr(low, m)) for m in markers), F.lit(2**31 - 1))
    return F.regexp_replace(F.substring(title, F.lit(1), first - 1), r"[ \-–—,|]+$", "")


def labelled(c: Column, pattern: str, group: int = 1) -> Column:
    """A captured field, trimmed; '' where the pattern doesn't occur."""
    return F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, group))


def strip_age(c: Column) -> Column:
    """Without a closing `3 days ago`."""
    return F.trim(F.regexp_replace(c, r"(?i)\s*(?:posted\s+)?\d+\+?\s+(?:minute|hour|day|week|month|year)s?\s+ago\s*$", ""))


def joined(separator: str, *parts: Column, distinct: bool = False) -> Column:
    """Non-blank parts with a separator between, in order; each once if distinct."""
    kept = F.filter(F.array(*(F.trim(F.coalesce(p, F.lit(""))) for p in parts)), lambda x: x != "")
    return F.array_join(F.array_distinct(kept) if distinct else kept, separator)


def experience_text(low: Column, high: Column) -> Column:
    """A sentence for a range of years; a missing end takes the other's value, '' if both miss."""
    a, b = F.coalesce(low, high), F.coalesce(high, low)
    return F.when(a.isNotNull(), F.concat(F.lit("Experience required: "), a.cast("string"), F.lit(" to "), b.cast("string"), F.lit(" years."))).otherwise("")


def pay_text(currency: Column, low: Column, high: Column) -> Column:
    """`CUR a-b per annum`, one figure if the other misses, '' if both miss."""
    figures = F.concat_ws("-", low.cast("string"), high.cast("string"))
    return F.when(figures != "", F.concat(currency, F.lit(" "), figures, F.lit(" per annum"))).otherwise("")


def remote_label(is_remote: Column, location: Column) -> Column:
    location = F.trim(F.coalesce(location, F.lit("")))
    both = F.when(location != "", F.concat(F.lit("Remote • "), location)).otherwise("Remote")
    return F.when(F.coalesce(is_remote, F.lit(False)), both).otherwise(location)


def multi_location(label: Column, facet: Column, path: Column) -> Column:
    """A label `N locations` becomes the facet's name, marked; an empty label the path's place."""
    many = F.lower(F.trim(label)).rlike(r"^\d+\s+locations?$")
    place = title_from_slug(F.regexp_extract(path, r"/job/([^/]+)/", 1))
    return F.when(many, F.concat(facet, F.lit(" (multi-location)"))).otherwise(first_truthy(label, place))


# Link texts that name no role.
GENERIC_TITLES = (
    "apply", "apply now", "details", "know more", "view", "view role",
    "view job", "read more", "learn more", "open role", "careers", "jobs",
)
GENERIC_OPENINGS = ("apply at ", "opportunities await you at ")


def is_generic_title(title: Column, company: Column) -> Column:
    """Whether a link's title names no role: blank, a stock phrase, the company, or careers at it."""

    def generic(t: Column, c: Column) -> Column:
        opens = t.startswith(GENERIC_OPENINGS[0]) | t.startswith(GENERIC_OPENINGS[1])
        return (t == "") | t.isin(*GENERIC_TITLES) | opens | (t == c) | (t == F.concat(F.lit("careers at "), c))

    bare = F.btrim(F.lower(clean_text(title)), F.lit(" -|:"))
    return let(bare, lambda t: let(F.lower(clean_text(company)), lambda c: generic(t, c)))
