"""URL columns: canonical forms, identities, fingerprints, provider parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import let, match_text

# What a canonical URL drops, what marks a posting, which hosts and paths are for machines.
DROPPED_PARAMETERS = (
    "domain", "source", "src", "ref", "referrer", "gh_src", "tracking", "q", "query", "keyword", "keywords", "location",
    "page", "lang", "hl", "lastselectedfacet", "selectedcategoriesfacet", "track_view",
)
ID_PARAMETERS = ("id", "jobid", "job_id", "position_id", "opportunityid", "gh_jid")
POSTING_PATH = r"(?i)/(?:jobs?|positions?|postings?|requisitions?|openings?)/[^/]+"
ID_PATH = r"(?i)[0-9a-f]{8}-[0-9a-f-]{20,}|[0-9]{4,}"
MACHINE_HOSTS = ("api.smartrecruiters.com", "api.lever.co", "boards-api.greenhouse.io")
MACHINE_PATHS = ("/wday/cxs/", "/hcmrestapi/", "/posting-api/job-board/", "/recruiting/v2/api/feed/")


def part(url: Column, group: int) -> Column:
    """1: scheme, 2: host, 3: path, 4: query of an http(s) URL, '' without."""
    return F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), r"(?i)^(https?)://([^/?#\s]+)([^?#]*)\??([^#]*)", group)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(part(url, 2), ":[0-9]*$", ""))


def path(url: Column) -> Column:
    return part(url, 3)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def canonical_url(url: Column, require_identity: bool = True) -> Column:
    """A posting's URL without locale, apply step, tracking parameters and fragment, in lower case.

    '' for what isn't http(s) and, unless require_identity is off, for URLs that name no single posting.
    """
    p = F.regexp_replace(part(url, 3), "/{2,}", "/")
    p = F.regexp_replace(p, r"(?i)/en[-_][a-z]{2}(?=/)", "")
    p = F.regexp_replace(p, r"(?i)/apply(?=/|$)", "")
    p = F.coalesce(F.nullif(F.regexp_replace(p, "/+$", ""), F.lit("")), F.lit("/"))

    def whole(items: Column) -> Column:
        named = F.exists(items, lambda x: F.lower(x["name"]).isin(*ID_PARAMETERS))
        query = F.array_join(F.transform(items, lambda x: F.concat(form_encoded(x["name"]), F.lit("="), form_encoded(x["value"]))), "&")
        found = F.lower(F.concat(part(url, 1), F.lit("://"), part(url, 2), p, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))
        good = part(url, 2) != ""
        if require_identity:
            good = good & (p.rlike(POSTING_PATH) | p.rlike(ID_PATH) | named)
        return F.when(good, found).otherwise("")

    name = lambda x: F.lower(x["name"])
    kept = F.filter(parameters(part(url, 4)), lambda x: ~(name(x).startswith("utm_") | name(x).isin(*DROPPED_PARAMETERS)))
    return let(F.array_sort(kept), whole)


def parameters(query: Column) -> Column:
    """(name, value) of the parameters of a query string, decoded; a name without a value has ''."""

    def decoded(x: Column) -> Column:
        return F.url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))

    def one(x: Column) -> Column:
        name = F.substring_index(x, "=", 1)
        return F.struct(decoded(name).alias("name"), decoded(F.substring(x, F.length(name) + 2, F.length(x))).alias("value"))

    return F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), one)


def form_encoded(c: Column) -> Column:
    """Percent-encoded as in a form: letters, digits and _.-~ stay, a space is a plus."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def is_public(url: Column) -> Column:
    """An http(s) URL that no machine interface has."""
    low = F.lower(path(url))
    api = host(url).isin(*MACHINE_HOSTS)
    for marker in MACHINE_PATHS:
        api = api | F.contains(low, F.lit(marker))
    return (part(url, 2) != "") & ~api


def requisition_id(value: Column, allow_plain: bool = False) -> Column:
    """The requisition number in a text or URL, letters and digits in lower case; '' without one."""
    raw = F.coalesce(value, F.lit(""))
    low = F.lower(F.coalesce(F.try_url_decode(raw), raw))
    found = F.coalesce(
        F.nullif(F.regexp_extract(low, r"(?:^|[^a-z0-9])((?:jr|req|requisition|job)[-_ ]?[0-9]{4,})(?:[^a-z0-9]|$)", 1), F.lit("")),
        F.nullif(F.regexp_extract(low, r"(?:^|[^a-z0-9])(r[0-9]{6,})(?:[^a-z0-9]|$)", 1), F.lit("")),
    )
    plain = F.regexp_replace(low, "[^a-z0-9]+", "")
    out = F.regexp_replace(found, "[^a-z0-9]+", "")
    if allow_plain:
        out = F.coalesce(out, F.when(F.length(plain).between(4, 64) & plain.rlike("[0-9]"), plain))
    return F.coalesce(out, F.lit(""))


def digest(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def url_fingerprint(url: Column, require_identity: bool = True) -> Column:
    c = canonical_url(url, require_identity)
    return F.when(c != "", digest(F.lit("url"), c)).otherwise("")


def requisition_fingerprint(company: Column, requisition: Column, url: Column) -> Column:
    found = F.coalesce(F.nullif(requisition_id(requisition, True), F.lit("")), F.nullif(requisition_id(url), F.lit("")))
    return F.when(found.isNotNull(), digest(F.lit("req"), match_text(company), found)).otherwise("")


def semantic_fingerprint(company: Column, title: Column, location: Column) -> Column:
    return digest(match_text(company), match_text(title), match_text(location))


def dedupe_keys(company: Column, title: Column, location: Column, url: Column, requisition: Column, require_identity: bool = True) -> Column:
    """The requisition's and the URL's keys; the semantic key only if there is neither."""
    exact = F.filter(F.array(requisition_fingerprint(company, requisition, url), url_fingerprint(url, require_identity)), lambda k: k != "")
    return F.when(F.size(exact) > 0, exact).otherwise(F.array(semantic_fingerprint(company, title, location)))


def state_key(company: Column, title: Column, location: Column, url: Column, requisition: Column, require_identity: bool = True) -> Column:
    return F.get(dedupe_keys(company, title, location, url, requisition, require_identity), F.lit(0))


# Hosts of providers, in order.
PROVIDER_HOSTS = (("greenhouse.io", "greenhouse"), ("ashbyhq.com", "ashby"), ("myworkdayjobs.com", "workday"))
LEVER_HOSTS = ("jobs.lever.co", "api.lever.co", "api.eu.lever.co")


def provider(url: Column) -> Column:
    """The posting provider that a URL's host names, '' if none."""
    h = host(url)
    out = F.when(h.isin(*LEVER_HOSTS), "lever").when(h == "careers.kula.ai", "kula")
    for marker, name in PROVIDER_HOSTS:
        out = out.when(F.contains(h, F.lit(marker)), name)
    return out.when(F.contains(h, F.lit("oraclecloud.com")) & F.contains(path(url), F.lit("/sites/")), "oracle").otherwise("")


def segment(url: Column, k: int) -> Column:
    """The k-th path segment (from the end if negative), '' if there is none."""
    return F.coalesce(F.try_element_at(segments(url), F.lit(k)), F.lit(""))


def source_identity(ats: Column, url: Column, slug: Column) -> Column:
    at = F.coalesce(F.nullif(F.trim(url), F.lit("")), F.nullif(F.trim(slug), F.lit("")), F.lit(""))
    return F.concat_ws("|", ats, F.lower(F.regexp_replace(at, "/+$", "")))


SLUG_SUFFIXES = ("india", "global", "group", "holdings", "limited", "ltd", "inc", "corp", "corporation", "technology", "technologies", "software", "solutions", "services")


def slug_candidates(name: Column) -> Column:
    """Up to five slugs that a name may have: joined, hyphenated, both without closing company words, as written."""
    plain = F.replace(F.regexp_replace(name, r"\([^)]*\)", " "), F.lit("&"), F.lit(" and "))
    words = F.regexp_extract_all(plain, F.lit("([A-Za-z0-9]+)"), F.lit(1))
    # trailing company words go, but never the first word
    body = F.regexp_replace(F.array_join(words, " "), r"(?i)(?: (?:" + "|".join(SLUG_SUFFIXES) + "))+$", "")
    forms = lambda x: (F.lower(F.replace(x, F.lit(" "), F.lit(""))), F.lower(F.replace(x, F.lit(" "), F.lit("-"))))
    every = F.array(*forms(F.array_join(words, " ")), *forms(body), F.array_join(words, ""))
    return F.slice(F.array_distinct(F.filter(every, lambda s: s != "")), 1, 5)


def urls_in(text: Column, pattern: str, most: int = 12) -> Column:
    """Distinct matches in order, the first `most`."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))), 1, most)


def build_url(base: Column | str, segments: list[Column], parameters: dict[str, Column] | None = None) -> Column:
    """An address from a base, path segments and query parameters; null parameters are left out, a null segment makes it null."""
    base = F.lit(base) if isinstance(base, str) else base
    made = F.concat(F.regexp_replace(base, "/+$", ""), *(F.concat(F.lit("/"), s.cast("string")) for s in segments))
    pairs = [F.concat(F.lit(f"{n}="), v.cast("string")) for n, v in (parameters or {}).items()]
    query = F.array_join(F.array_compact(F.array(*pairs)), "&") if pairs else F.lit("")
    return F.when(query == "", made).otherwise(F.concat(made, F.lit("?"), query))


def encoded_state(state: Column) -> Column:
    """A struct as base64 of its JSON, as request templates carry it."""
    return F.base64(F.encode(F.to_json(state), "UTF-8"))
