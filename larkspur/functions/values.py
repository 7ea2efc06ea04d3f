"""Nested values, numbers, dates and token sets."""

from __future__ import annotations

import ast
import html
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from larkspur.functions.text import UNMARKED, clean_text, first_truthy, let, match_text

# Words that token sets leave out.
STOPWORDS = (
    "about", "across", "after", "again", "against", "along", "also", "among", "and", "are", "been", "before", "being", "between",
    "build", "building", "built", "can", "delivery", "developed", "developing", "for", "from", "have", "into", "more", "most", "over",
    "production", "professional", "role", "scalable", "systems", "that", "the", "their", "these", "this", "through", "using", "with",
    "work", "worked", "working",
)
COUNTRY_WORDS = ("india", "in", "ind")


def distinct_by_form(items: Column) -> Column:
    """The items, in order, whose match_text no earlier one has."""
    kept = lambda x, forms: F.filter(x, lambda _, i: (F.get(forms, i) != "") & (F.array_position(forms, F.get(forms, i)) == i + 1))
    listed = F.filter(items, lambda x: x != "")
    return let(listed, lambda x: let(F.transform(x, lambda y: F.coalesce(F.nullif(match_text(y), F.lit("")), F.lit(" "))), lambda forms: kept(x, forms)))


def flatten_text(c: Column) -> Column:
    """Parts of a semicolon list, cleaned, each once, joined again."""
    return F.array_join(distinct_by_form(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), clean_text)), "; ")


# Fields of a place, in their order.
LOCATION_FIELDS = (
    "name", "descriptor", "city", "addressLocality", "region", "addressRegion",
    "country", "addressCountry", "alpha2Code", "location", "fullLocation",
    "formattedLocation",
)
EMBEDDED = r"(?s)^(.*?)(\{.*\}|\[.*\])$"


def plain_text(text: str) -> str:
    """clean_text of one value."""
    marked = "<" in text and ">" in text
    for _ in range(1 + marked):
        text = html.unescape(re.sub(UNMARKED, " ", text) if marked else text)
        marked = False
    return " ".join(text.split())


def plain_form(text: str) -> str:
    """match_text of one value."""
    return re.sub("[^a-z0-9]+", " ", text.replace("ß", "ss").lower()).strip()


def parsed(text: str) -> dict | list | None:
    """An object or a list in JSON or as a literal; None for anything else."""
    for read in (json.loads, ast.literal_eval):
        try:
            value = read(text)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
        if isinstance(value, (dict, list)):
            return value
    return None


def place_of(value: object) -> str:
    """A nested place as text, however deep: see flatten_location."""
    if isinstance(value, dict):
        parts = {}
        for part in (place_of(value[k]) for k in LOCATION_FIELDS if value.get(k) is not None):
            if part:
                parts.setdefault(plain_form(part), part)
        return plain_text(" ".join(parts.values()))
    if isinstance(value, list):
        return plain_text("; ".join(merged_places([place_of(v) for v in value])))
    if not isinstance(value, str):
        return plain_text(str(value)) if value else ""
    text = value.strip()
    if found := re.match(EMBEDDED, text):
        prefix, held = plain_text(found[1]), parsed(found[2])
        if held is not None:
            return place_of(prefix or held)
    parts = {}
    for part in map(plain_text, text.split(";")):
        if part:
            parts.setdefault(plain_form(part), part)
    return "; ".join(parts.values())


def merged_places(places: list[str]) -> list[str]:
    """merge_places of one list."""
    adds = lambda long, short: long.startswith(f"{short} ") and set(long[len(short) :].split()) <= set(COUNTRY_WORDS)
    kept: list[tuple[str, str]] = []
    for place in filter(None, places):
        form = plain_form(place)
        for i, (_, other) in enumerate(kept):
            if form == other or adds(form, other):
                break
            if adds(other, form):
                kept[i] = (place, form)
                break
        else:
            kept.append((place, form))
    return [place for place, _ in kept]


@pandas_udf(T.StringType())
def nested_place(texts: pd.Series) -> pd.Series:
    """place_of texts; null stays null, and what is nested too deep for the parser stays text."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else place_of(text)
        except RecursionError:
            return plain_text(text)

    return texts.map(one)


def flatten_location(c: Column) -> Column:
    """A place as text: a list of parts (flatten_text), or an object or list in JSON or a literal at the end. A readable
    text before that wins; else an object gives its LOCATION_FIELDS, each once, and a list its places (merge_places), each flattened
    in turn, at any depth. Only texts that end in a bracket are parsed, in Arrow batches."""

    def known(v: Column) -> Column:
        return v.endswith("}") | v.endswith("]")

    text = F.trim(F.coalesce(c, F.lit("")))
    return F.coalesce(nested_place(F.when(known(text), text)), F.when(~known(text), flatten_text(text)))


def flatten_fields(fields: list[Column]) -> Column:
    """Fields of a place in a fixed order, each once, joined by spaces."""
    return F.array_join(distinct_by_form(F.array(*(first_truthy(c) for c in fields))), " ")


def merge_places(items: Column) -> Column:
    """Places, each once; of two that differ by a closing country word the shorter one, in the earlier's place."""
    adds = lambda long, short: long.startswith(F.concat(short, F.lit(" "))) & (
        F.size(F.array_except(F.filter(F.split(F.substring(long, F.length(short) + 2, 10_000), " "), lambda w: w != ""), F.array(*map(F.lit, COUNTRY_WORDS)))) == 0
    )

    def step(kept: Column, x: Column) -> Column:
        n = match_text(x)
        dropped = F.exists(kept, lambda k: (match_text(k) == n) | adds(n, match_text(k)))
        replaces = F.exists(kept, lambda k: adds(match_text(k), n))
        first = F.array_position(F.transform(kept, lambda k: adds(match_text(k), n)), True)
        swapped = F.transform(kept, lambda k, i: F.when(i + 1 == first, x).otherwise(k))
        return F.when((x == "") | dropped, kept).when(replaces, swapped).otherwise(F.array_append(kept, x))

    cleaned = F.transform(items, clean_text)
    return F.array_join(F.aggregate(cleaned, F.array().cast("array<string>"), step), "; ")


def schema_place(places: Column, remote: Column, countries: Column) -> Column:
    """Places struct(locality, region, country) of a posting's schema; remote ones add `Remote` and the allowed countries."""
    each = F.transform(places, lambda p: flatten_fields([p["locality"], p["region"], p["country"]]))
    extra = F.when(F.coalesce(remote, F.lit(False)), F.array(F.trim(F.concat(F.lit("Remote "), F.array_join(F.coalesce(countries, F.array().cast("array<string>")), " ")))))
    return merge_places(F.concat(F.coalesce(each, F.array().cast("array<string>")), F.coalesce(extra, F.array().cast("array<string>"))))


def nested_places(items: Column, fields: Callable[[Column], list[Column]]) -> Column:
    """Places of a list of structs: the fields of each, wherever they are nested, merged as one place, and the places merged."""
    return F.coalesce(merge_places(F.transform(items, lambda x: merge_places(F.array(*(first_truthy(c) for c in fields(x)))))), F.lit(""))


# What a facet is asked for, and its order.
FACET_COUNTRY, FACET_STATES = "india", ("karnataka", "karnataka india")


def facets_in(value: object) -> Iterator[tuple[str, str, str]]:
    """(parameter, descriptor, id) of the values of all facets, at any depth, that have an id and a parameter."""
    todo = [value]
    while todo:
        item = todo.pop()
        if isinstance(item, list):
            todo += item
        elif isinstance(item, dict):
            values = item.get("values")
            for v in values if isinstance(values, list) else ():
                if isinstance(v, dict):
                    todo.append(v)
                    if v.get("id") and item.get("facetParameter"):
                        yield str(item["facetParameter"]), str(v.get("descriptor") or ""), str(v["id"])


def find_facet(facets: Column, country: str = FACET_COUNTRY, states: tuple[str, ...] = FACET_STATES) -> Column:
    """struct(parameter, id) of the value that names the country or a state, in a JSON list of facets whose values may be facets
    again, at any depth; null without one. First countries of a parameter that says so, then states, then other countries; then by parameter and id.
    A text's values are ranked as they are read, so that a task holds those of one text."""

    def ranked(text: str | None) -> Iterator[tuple[int, str, str]]:
        for parameter, descriptor, name in facets_in(parsed(text or "")):
            form = plain_form(descriptor)
            if form == country:
                yield (0 if "country" in parameter.lower() else 2), parameter, name
            elif form in states:
                yield 1, parameter, name

    @pandas_udf(T.StructType([T.StructField("parameter", T.StringType()), T.StructField("id", T.StringType())]))
    def first(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([min(ranked(text), default=(3, None, None))[1:] for text in texts], columns=["parameter", "id"], dtype=object)

    return let(first(facets), lambda x: F.when(x["parameter"].isNotNull(), x))


NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def posted_pay(text: Column) -> Column:
    """struct(low, high) in lakh a year of a stated range, null if there is none that makes sense."""
    mark = r"(?:₹|rs\.?|inr)"
    short = rf"{mark}?\s*({NUMBER})\s*(?:-|to)\s*{mark}?\s*({NUMBER})\s*(?:lpa|lakhs?)\b"
    long = rf"{mark}\s*([0-9,]{{6,}})\s*(?:-|to)\s*{mark}?\s*([0-9,]{{6,}})\s*(?:per\s+(?:annum|year)|p\.?a\.?)"

    def sensible(t: Column, p: str, scale: float) -> Column:
        number = lambda k: F.replace(F.regexp_extract(t, p, k), F.lit(","), F.lit("")).try_cast("double") / scale
        both = F.struct(number(1).alias("low"), number(2).alias("high"))
        return let(both, lambda r: F.when((r["low"] >= 1) & (r["low"] <= r["high"]) & (r["high"] <= 200), r))

    lowered = F.lower(F.translate(clean_text(text), "−–—", "---"))
    return let(lowered, lambda t: F.coalesce(sensible(t, short, 1.0), sensible(t, long, 100_000.0)))


# What a title is worth if no pay is posted, in lakh a year; the first that fits.
PAY_BY_TITLE = (
    (("machine learning engineer", "ml engineer", "ai engineer", "nlp engineer", "mlops engineer"), 10, 22),
    (("data scientist", "applied scientist", "decision scientist"), 8, 18),
    (("analytics engineer",), 8, 16),
    (("data engineer", "data platform engineer", "data pipeline engineer"), 8, 18),
    (("devops", "platform engineer", "build engineer", "release engineer", "automation engineer", "site reliability", "compute operations"), 7, 16),
    (("data analyst", "product analyst", "business analyst", "bi analyst", "insights analyst", "business intelligence"), 6, 14),
)
PAY_DEFAULT = (7, 15)


def lakh(c: Column) -> Column:
    """At most one decimal, without a closing .0."""
    return F.regexp_replace(F.format_string("%.1f", c), r"\.0$", "")


def pay_label(title: Column, text: Column, table: tuple = PAY_BY_TITLE, default: tuple[int, int] = PAY_DEFAULT) -> Column:
    """`Posted ₹a–b LPA` if a range is stated, else an estimate by the title."""
    posted = lambda pay: F.when(pay.isNotNull(), F.concat(F.lit("Posted ₹"), lakh(pay["low"]), F.lit("–"), lakh(pay["high"]), F.lit(" LPA")))

    def estimate(t: Column) -> Column:
        out = None
        for terms, low, high in table:
            label = F.lit(f"Est. ₹{low}–{high} LPA")
            fits = F.exists(F.array(*map(F.lit, terms)), lambda x: F.contains(t, x))
            out = F.when(fits, label) if out is None else out.when(fits, label)
        return out.otherwise(f"Est. ₹{default[0]}–{default[1]} LPA")

    return F.coalesce(let(posted_pay(text), posted), let(match_text(title), estimate))


def is_stale(valid_through: Column, posted: Column, as_of: Column, days: int) -> Column:
    """Expired, or older than `days` (0: no limit) at as_of; what can't be read isn't stale."""
    old = (posted < as_of - F.make_interval(days=F.lit(days))) if days else F.lit(False)
    return F.coalesce(valid_through < as_of, F.lit(False)) | F.coalesce(old, F.lit(False))


def mail_date(c: Column) -> Column:
    """A date as feeds and mail write it (`Mon, 01 Jun 2015 10:00:00 +0000`), null if it can't be read."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", ""), r"\bGMT$|\bUTC$", "+0000")
    return F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss Z"))


def safe_int(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(0))


def numbers_in(c: Column) -> Column:
    """Distinct figures, with a closing % or +, that no letter stands before."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<![A-Za-z])([0-9]+(?:\.[0-9]+)?%?\+?)"), F.lit(1))
    return F.array_distinct(found)


def token_list(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z][a-z0-9+#./-]{2,})"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS))


def token_set(c: Column) -> Column:
    return F.array_distinct(token_list(c))


def signature(c: Column) -> Column:
    """Tokens in order of the alphabet: equal for texts that differ in word order and punctuation alone."""
    return F.array_sort(token_list(c))
