"""Reading titles, metadata, links and JSON-LD out of raw pages."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import udtf

from .text import squeeze

# fixed values: hosts that sell tickets
TICKET_HOSTS = (
    "billetlugen", "ticketmaster", "eventim", "billetto", "safeticket", "ticketbutler", "billetten", "livenation",
    "dice.fm", "billetsalg", "place2book", "kulturbillet", "ticketco", "nemtilmeld", "billet.dk", "tikster",
)
# fixed values: first words of titles that are sections of a site
SECTIONS = ("program", "kalender", "calendar", "events?", "koncerter", r"alle\s", "forside", "home", "nyheder", "news", "billetter", "tickets", r"om\s", "about", "kontakt", "contact", "praktisk", "faq", "privatliv", "cookie")


# fixed values: words that say that a show is over
HAPPENED = ("event er afholdt", "afholdt", "har fundet sted", "this event has passed")

_REFERENCES = re.compile(r"(?:&#(?:[xX][0-9A-Fa-f]{1,8}|[0-9]{1,10});)+")


def decode_references(text: str) -> str:
    """Decode runs of numeric references: pairs of surrogates join, lone ones and what is no character become U+FFFD."""

    def run(m: re.Match) -> str:
        codes = [int(x[1:], 16) if x[0] in "xX" else int(x) for x in m[0][2:-1].split(";&#")]
        units = "".join(chr(c) if c <= 0x10FFFF else "\ufffd" for c in codes)
        return units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")

    return _REFERENCES.sub(run, text)


@F.pandas_udf(T.StringType())
def _numeric_entities(s):
    """Numeric character references; nothing else needs Python."""
    return s.map(decode_references, na_action="ignore")


def strip_tags(c: Column, chrome: bool = True, numeric: bool = True) -> Column:
    """Text of a page: without scripts, styles (navigation and footers if ``chrome``), tags and entities."""
    s = bare_text(c, chrome)
    return plain_entities(s, numeric) if chrome else squeeze(F.replace(s, F.lit("&#8211;"), F.lit("-")))


def bare_text(c: Column, chrome: bool = True) -> Column:
    """First half of ``strip_tags``: what is left still has entities."""
    tags = ("script", "style", *(("nav", "footer") if chrome else ()))
    s = whole = F.coalesce(c, F.lit(""))
    for tag in tags:
        s = F.regexp_replace(s, rf"(?is)<{tag}.*?</{tag}>", " ")
    s = F.when(_has(whole, *(f"<{tag}" for tag in tags)), s).otherwise(whole)
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    return F.replace(F.replace(s, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))


def numeric_entities(s: Column) -> Column:
    return F.coalesce(_numeric_entities(F.when(s.contains("&#"), s)), s)  # Python gets only texts that need it


def plain_entities(s: Column, numeric: bool = True) -> Column:
    """Second half of ``strip_tags``. It reads ``s`` several times, so make that a column of its own first."""
    s = numeric_entities(s) if numeric else s
    named = F.regexp_replace(F.regexp_replace(s, r"(?i)&(?:quot|apos|#39);", "'"), r"(?i)&[a-z]+;", " ")
    return squeeze(F.when(s.contains("&"), named).otherwise(s))


def _has(c: Column, *signs: str) -> Column:
    """Whether any of ``signs``, in any case, is in a text: a byte search, much faster than the expressions that it keeps from texts without them."""
    return reduce(Column.__or__, (F.lower(c).contains(sign) for sign in signs))


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null if nothing matches."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def meta_of(c: Column, names: list[str]) -> Column:
    """Content of the first named meta tag that has some, attributes in either order."""
    tries = []
    for n in names:
        q = "[\"']"
        for rx in (rf"(?i)<meta[^>]+(?:property|name)={q}{n}{q}[^>]+content={q}([^\"']*){q}", rf"(?i)<meta[^>]+content={q}([^\"']*){q}[^>]+(?:property|name)={q}{n}{q}"):
            tries.append(F.nullif(squeeze(_found(c, rx)), F.lit("")))
    return F.when(_has(c, "<meta"), F.coalesce(*tries))


def title_source(c: Column) -> Column:
    """Social title, else first heading, else title, as written."""
    return F.coalesce(meta_of(c, ["og:title", "twitter:title"]), F.nullif(_found(c, r"(?is)<h1[^>]*>(.{1,200}?)</h1>"), F.lit("")), _found(c, r"(?is)<title[^>]*>(.{1,200}?)</title>"))


def title_of(c: Column, venue: Column | None = None, numeric: bool = True) -> Column:
    """Social title, else first heading, else title; a trailing venue name goes."""
    return without_venue(strip_tags(title_source(c), numeric=numeric), venue)


def without_venue(t: Column, venue: Column | None = None) -> Column:
    """A cleaned title without a trailing venue name; null if nothing is left."""
    if venue is not None:
        parts = F.split(t, r"\s+[|·»–—-]\s+")
        last, room = F.lower(F.element_at(parts, -1)), F.lower(F.coalesce(venue, F.lit("")))
        site = (F.size(parts) > 1) & (room != "") & (last.contains(F.split(room, " ")[0]) | room.contains(F.split(last, " ")[0]))
        t = F.when(site, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), " - ")).otherwise(t)
    return F.nullif(clean_title(t), F.lit(""))


# our own choices, as the rules they stand for are known from few examples only
TITLE_PREFIXES = ("udsolgt", "ekstrakoncert", "sold out", "aflyst", "flyttet", "ny dato", "få billetter")
CANCELLED, POSTPONED = ("aflyst", "cancelled", "canceled"), ("flyttet", "udskudt", "postponed", "moved", "rescheduled")
NON_MUSICAL = ("quiz", "comedy", "film", "workshop", "foredrag", "strik", "teater", "musical", "banko", "standup", "stand-up", "fyraftenssang")


def clean_title(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, rf"(?iu)^\s*(?:(?:{'|'.join(TITLE_PREFIXES)})\s*[:!\-–—]\s*)+", ""))


def detect_status(c: Column) -> Column:
    s = F.lower(F.coalesce(c, F.lit("")))
    return F.when(s.rlike("|".join(CANCELLED)), "cancelled").when(s.rlike("|".join(POSTPONED)), "postponed").otherwise("scheduled")


def looks_non_musical(c: Column) -> Column:
    """A stem anywhere, inside compounds too; "musical" only as a word's end."""
    s = F.lower(F.coalesce(c, F.lit("")))
    return s.rlike("|".join(x for x in NON_MUSICAL if x != "musical")) | s.rlike(r"musical(?![a-zæøå])")


def is_section(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(rf"(?iu)^(?:{'|'.join(SECTIONS)})")


def already_happened(c: Column) -> Column:
    return F.coalesce(F.substring(c, 1, 1200), F.lit("")).rlike(rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(HAPPENED)})(?![A-Za-z0-9_])")


def ticket_of(c: Column) -> Column:
    """First absolute link to a ticket host."""
    links = F.regexp_extract_all(c, F.lit(r"(?i)href=[\"'](https?://[^\"']+)[\"']"), F.lit(1))
    return F.when(_has(c, "href="), F.get(F.filter(links, lambda u: F.exists(F.array(*map(F.lit, TICKET_HOSTS)), lambda h: F.contains(F.lower(u), h))), 0))


def links_from(c: Column, base: Column, patterns: list[str] | None = None) -> Column:
    """Distinct links under ``base``, absolute, without query strings."""
    hrefs = F.regexp_extract_all(c, F.lit(r"(?i)href=[\"']([^\"'#]+)[\"']"), F.lit(1))
    full = F.transform(hrefs, lambda u: F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).when(F.startswith(u, F.lit("/")), F.concat(base, u)).when(u.rlike("(?i)^https?:"), u))
    own = F.filter(full, lambda u: u.isNotNull() & F.startswith(u, base))
    if patterns:
        own = F.filter(own, lambda u: url_matches(u, patterns))
    return F.array_distinct(F.transform(own, lambda u: F.split(u, r"\?")[0]))


def url_matches(url: Column, patterns: list[str]) -> Column:
    """Any of the substrings; no patterns match all."""
    return F.exists(F.array(*map(F.lit, patterns)), lambda p: F.contains(url, p)) if patterns else F.lit(True)


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def decode_xml(c: Column) -> Column:
    """The five named signs; the ampersand first, as the reference system has it."""
    for name, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#039;", "'")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def escape_html(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def slug(c: Column, sign: str = "-", most: int = 80) -> Column:
    return F.substring(F.regexp_replace(c, "[^A-Za-z0-9]+", sign), 1, most)


def repair_json(c: Column) -> Column:
    """Drop CDATA marks, control characters and commas before a closing bracket."""
    s = F.regexp_replace(F.regexp_replace(c, r"(?i)^\s*(?://)?\s*<!\[CDATA\[", ""), r"(?://)?\s*\]\]>\s*$", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(s, r"[\x00-\x1F]+", " "), r",\s*([}\]])", "$1"))


def json_ld_blocks(c: Column) -> Column:
    blocks = F.regexp_extract_all(c, F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    return F.when(~_has(c, "application/ld+json"), F.array().cast("array<string>")).otherwise(blocks)


def hydration_payload(c: Column) -> Column:
    return F.get(F.regexp_extract_all(c, F.lit(r"(?is)<script[^>]+id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>"), F.lit(1)), 0)


def surfaces(c: Column) -> Column:
    """What a page offers: a struct of counts, keys and distinct samples."""
    return F.struct(
        F.size(json_ld_blocks(c)).alias("json_ld"),
        c.contains("__NEXT_DATA__").alias("next_data"),
        c.contains("__NUXT__").alias("nuxt"),
        c.contains("__APOLLO_STATE__").alias("apollo"),
        F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?i)itemtype=[\"']([^\"']+)[\"']"), F.lit(1))), 1, 20).alias("microdata"),
        F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(20\d\d-\d\d-\d\d)"), F.lit(1))), 1, 10).alias("iso_dates"),
    )


# fixed values: what names a site's platform
PLATFORMS = {
    "wordpress": "wp-content|wp-json", "drupal": "drupal-settings|/sites/default/", "next": "__NEXT_DATA__|/_next/", "nuxt": "__NUXT__|/_nuxt/",
    "gatsby": "___gatsby", "squarespace": "squarespace", "wix": "wixstatic|wix\\.com", "shopify": "cdn\\.shopify", "umbraco": "umbraco",
    "sitecore": "sitecore", "json-ld": "application/ld\\+json", "microdata": "schema\\.org/[A-Za-z]*Event", "ical": "\\.ics[\"'?]", "rss": "application/rss\\+xml", "graphql": "graphql",
}


def platforms(c: Column) -> Column:
    return F.array_compact(F.array(*(F.when(c.rlike(f"(?i){rx}"), F.lit(name)) for name, rx in PLATFORMS.items())))


def objects_of(text: str | None, most: int, groups: list[list[str]], whole: bool) -> Iterator[tuple]:
    """See ``WalkJson``."""
    try:
        root = json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return
    wanted = {k for g in groups for k in g}
    stack, visit = [(root, 0)], 0
    while stack:
        v, depth = stack.pop()
        visit += 1
        if isinstance(v, dict) and all(any(k in v for k in g) for g in groups):
            yield visit, json.dumps(v if whole else {k: x for k, x in v.items() if k in wanted and not isinstance(x, (dict, list))}, ensure_ascii=False)
        if isinstance(v, (dict, list)) and depth < most:
            stack += [(x, depth + 1) for x in reversed(list(v.values()) if isinstance(v, dict) else v)]


@udtf(returnType="visit int, node string")
class WalkJson:
    """Objects of a JSON text in document order that have a member of each group of keys.

    ``node`` is the object, or only its plain members of those keys if not ``whole``.  Text that
    isn't JSON, or is nested deeper than Python reads, gives no rows.
    """

    def eval(self, text: str, most: int, groups: list[list[str]], whole: bool) -> Iterator[tuple]:
        yield from objects_of(text, most, groups, whole)


def objects_in(text: Column, most: int, groups: tuple[tuple[str, ...], ...], whole: bool) -> Column:
    """As ``WalkJson``, as an array of (visit, node) within the row: texts go to Python in batches, without the arguments that all share."""
    wanted = [list(g) for g in groups]

    @F.pandas_udf("visit array<int>, node array<string>")
    def run(s: pd.Series) -> pd.DataFrame:
        found = [list(objects_of(t, most, wanted, whole)) for t in s]
        return pd.DataFrame({"visit": [[v for v, _ in f] for f in found], "node": [[n for _, n in f] for f in found]})

    found = run(text)
    return F.arrays_zip(found["visit"].alias("visit"), found["node"].alias("node"))


def plain_members(text: Column, most: int, keys: tuple[str, ...]) -> Column:
    """The objects that have one of ``keys``, in document order, each with its plain members of these alone: an array within the row."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [node for _, node in objects_of(t, most, [list(keys)], False)])

    return run(text)
