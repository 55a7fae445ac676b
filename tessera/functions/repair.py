"""Repairs of titles and summaries, and the merge that keeps a stored item's quality, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

from tessera.functions import text as T

SENTENCE_END = r"(?<=[.!?])\s+"


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def slug_like(summary: Column) -> Column:
    """At least eight characters of hyphenated letters and digits."""
    s = _blank(summary)
    return (F.length(s) >= 8) & s.rlike("(?i)^[a-z0-9]+(-[a-z0-9]+)+$")


def repeats_title(title: Column, summary: Column) -> Column:
    a, b = F.lower(T.spaces(_blank(title))), F.lower(T.spaces(_blank(summary)))
    return (a != "") & (a == b)


def first_paragraph(body: Column, least: int = 40) -> Column:
    """The first paragraph of at least ``least`` characters, else the first sentence of a text that long, else nothing."""
    parts = F.filter(F.transform(F.split(_blank(body), r"\n\s*\n"), T.spaces), lambda p: (F.length(p) >= least) & ~slug_like(p))
    flat = T.spaces(_blank(body))
    sentence = F.when(F.length(flat) >= least, F.trim(F.split(flat, SENTENCE_END)[0])).otherwise("")
    return F.when(F.size(parts) > 0, F.try_element_at(parts, F.lit(1))).otherwise(sentence)


def repaired_summary(title: Column, summary: Column, body: Column, meta: Column | None = None, most: int = 500) -> Column:
    """A summary that neither repeats the title nor is a slug nor is short, from the page's description or its body."""
    m = F.lit("") if meta is None else _blank(meta)
    poor = lambda s: repeats_title(title, s) | slug_like(s)
    instead = T.let(m, lambda d: F.when((d == "") | poor(d), first_paragraph(body)).otherwise(d))
    taken = T.let(_blank(summary), lambda s: F.when(poor(s) | (F.length(s) < 20), instead).otherwise(s))
    return T.let(taken, lambda t: F.when(poor(t), "").otherwise(T.truncate_words(t, most)))


def merged_title(title: Column, summary: Column, most_words: int = 12) -> Column:
    """(title, summary): a title cut at a colon takes a short first sentence of the summary back."""

    def merged(x: Column) -> Column:
        rest = F.regexp_replace(F.trim(F.substring(x["s"], F.length(x["first"]) + 1, F.length(x["s"]))), r"^[.!?]\s*", "")
        fits = x["t"].rlike(r":\s*$") & (x["s"] != "") & T.word_count(x["first"]).between(1, most_words)
        return F.struct(F.when(fits, T.spaces(F.concat(x["t"], F.lit(" "), x["first"]))).otherwise(x["t"]).alias("title"), F.when(fits & (rest != ""), rest).otherwise(x["s"]).alias("summary"))

    return T.let(F.struct(_blank(title).alias("t"), _blank(summary).alias("s"), F.trim(F.split(_blank(summary), SENTENCE_END)[0]).alias("first")), merged)


def country_name(name: Column) -> Column:
    n = F.nullif(F.trim(name), F.lit(""))
    return F.when(F.lower(n) == "usa", "USA").otherwise(n)


def preserved(status: Column, old: dict[str, Column], new: dict[str, Column]) -> Column:
    """(title, summary, body, unchanged): an incoming draft merged into a stored item without loss of quality.

    old and new hold title, summary and body.  A good automatic item, and a source-limited one whose draft is the same or
    no better, stay as they are.  Otherwise a shorter text keeps the stored one, and a title that has become cut keeps the
    stored title.
    """
    parts = ("title", "summary", "body")
    reasons = lambda x: T.quality_reasons(x["title"], x["summary"], x["body"])
    length = lambda x: T.body_length(x["summary"], x["body"])
    packed = lambda x: F.struct(*[F.coalesce(x[p], F.lit("")).alias(p) for p in parts], reasons(x).alias("reasons"), length(x).alias("length"))

    def merge(x: Column) -> Column:
        o, n = x["o"], x["n"]
        keep_title = (F.length(F.trim(o["title"])) > F.length(F.trim(n["title"])) + 8) & F.array_contains(n["reasons"], "truncated_title") & ~F.array_contains(o["reasons"], "truncated_title")
        shorter = n["length"] < o["length"]
        merged = F.struct(F.when(keep_title, o["title"]).otherwise(n["title"]).alias("title"), *[F.when(shorter, o[p]).otherwise(n[p]).alias(p) for p in parts[1:]])
        return T.let(merged, lambda m: decide(x["status"], o, n, m, shorter))

    def decide(status: Column, o: Column, n: Column, m: Column, shorter: Column) -> Column:
        good, bad_new = F.size(o["reasons"]) == 0, F.size(n["reasons"]) > 0
        same, equal = (reduce(and_, [f(a[p]) == f(b[p]) for p in parts]) for f, a, b in ((F.trim, o, n), (lambda c: c, m, o)))
        limited = (status == "SOURCE_LIMITED") & (same | (bad_new & (n["length"] <= o["length"])))
        automatic = (status == "AUTO") & good

        def result(bad_merged: Column) -> Column:
            stay = (automatic & (bad_new | shorter | bad_merged)) | limited
            return F.struct(*[F.when(stay, o[p]).otherwise(m[p]).alias(p) for p in parts], (stay | (automatic & ~bad_merged & equal)).alias("unchanged"))

        return T.let(F.size(reasons(m)) > 0, result)

    return T.let(F.struct(F.coalesce(status, F.lit("")).alias("status"), packed(old).alias("o"), packed(new).alias("n")), merge)


# What a catalogue's pages hold beside its items.
NAV_PATTERNS = [
    r"\bhome\s+about\s+contact\b", r"\bskip to (main )?content\b", r"\bcookie(s)? (policy|preferences)\b", r"\bprivacy policy\b.*\bterms\b", r"\ball rights reserved\b", r"\bsearch\s+menu\b",
    r"\b(facebook|linkedin|twitter|instagram)\b.*\b(facebook|linkedin|twitter|instagram)\b",
]
PLACEHOLDERS = [r"\bsample text\b", r"\blorem ipsum\b", r"\bstartups list\b", r"\bcorporate number[｜|]", r"\bxxx+ sample\b"]
AUTHOR_PATH, EVENT_PATH = r"(?i)/(author|authors|team|staff|people|profile|member|bio)(/|$)", r"(?i)/(event|events|calendar|seminar|workshop|conference)(/|$)"
AUTHOR_WORDS, GAMBLING, EVENT_WORDS = r"\b(author|editor|staff writer|our team)\b", r"\b(casino|gambling|betting)\b", r"\b(upcoming events?|event poster|register now|rsvp)\b"


def catalogue_junk(path: Column, title: Column, summary: Column, body: Column) -> Column:
    """Why a page is no catalogue item, in the rules' order."""
    nav = lambda c: (F.length(T.spaces(c)) >= 40) & T.spaces(c).rlike(T.any_of(NAV_PATTERNS))
    both = F.lower(F.concat_ws(" ", title, body))
    author = path.rlike(AUTHOR_PATH) | (both.rlike(AUTHOR_WORDS) & both.rlike(GAMBLING))
    event = path.rlike(EVENT_PATH) | F.lower(F.concat_ws(" ", title, summary)).rlike(EVENT_WORDS)
    rules = [
        (path.rlike(AUTHOR_PATH) | path.rlike(EVENT_PATH), "catalogue_non_innovation_path"),
        (author, "catalogue_author_bio"),
        (event, "catalogue_event_page"),
        (nav(summary) | nav(F.left(body, F.lit(2000))), "catalogue_nav_boilerplate"),
        (T.spaces(summary).rlike(T.any_of(PLACEHOLDERS)), "catalogue_placeholder_summary"),
    ]
    return F.array_compact(F.array(*[F.when(condition, F.lit(code)) for condition, code in rules]))


def without_placeholders(summary: Column) -> Column:
    """A summary without a listing's placeholder texts."""
    t = F.regexp_replace(T.spaces(summary), r"(?i)(\bsample text\b\s*)+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)\bstartups list\b", " "), r"(?i)corporate number[｜|][^—\-.]*", "")
    return T.spaces(t)


def _plausible(title: Column) -> Column:
    t = F.trim(title)
    words = T.word_count(t)
    return (t != "") & (F.length(t) <= 180) & (words <= 12) & ~(t.endswith(".") & (words > 6))


def _extends(current: Column, other: Column) -> Column:
    return (F.length(other) > F.length(current)) & F.lower(other).startswith(F.lower(current)) & (current != "")


def _longest(titles: Column) -> Column:
    """The longest of an array of titles, of equal ones the first; null for none."""
    return F.aggregate(titles, F.lit(None).cast("string"), lambda best, t: F.when(best.isNull() | (F.length(t) > F.length(best)), t).otherwise(best))


def fuller_title(title: Column, candidates: Column, summary: Column, body: Column) -> Column:
    """A title made whole: the longest plausible candidate that begins with it, or for a cut title one that is longer and
    not cut; then, for a cut title, the first sentence of summary or body that begins with it."""
    plausible = F.filter(F.transform(F.filter(candidates, lambda t: t.isNotNull()), F.trim), _plausible)

    def extend(x: Column) -> Column:
        longer = F.filter(plausible, lambda t: _extends(x["now"], t) | (x["cut"] & (F.length(t) > F.length(x["now"]) + 3) & ~T.truncated_title(t)))
        return F.struct(F.coalesce(_longest(longer), x["now"]).alias("now"), x["cut"].alias("cut"))

    def lead(text: Column) -> Callable[[Column], Column]:
        first = F.trim(F.split(_blank(text), SENTENCE_END)[0])

        def step(x: Column) -> Column:
            now = x["now"]
            fits = lambda f: x["cut"] & (now != "") & F.lower(_blank(text)).startswith(F.lower(now)) & (F.length(f) > F.length(now) + 4) & _plausible(f)
            return F.struct(T.let(first, lambda f: F.when(fits(f), f).otherwise(now)).alias("now"), x["cut"].alias("cut"))

        return step

    start = T.let(_blank(title), lambda t: F.struct(t.alias("now"), T.truncated_title(t).alias("cut")))
    return T.let(T.let(T.let(start, extend), lead(summary)), lead(body))["now"]


def title_of_slug(slug: Column) -> Column:
    """Words of an address slug, capitalised, a number at its end dropped; null where nothing is left."""
    bare = F.trim(F.regexp_replace(slug, r"-\d+$", ""))
    return F.when(F.length(bare) >= 2, F.array_join(F.transform(F.filter(F.split(bare, "-"), lambda w: w != ""), lambda w: F.initcap(w)), " "))


def title_of_address(url: Column) -> Column:
    """The title that the last part of an item's path spells, or the one before a generic part."""
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    last = F.lower(F.try_element_at(parts, F.lit(-1)))
    own = F.when(last.isin("project", "portfolio", "portfolio-companies", "en"), F.try_element_at(parts, F.lit(-2))).otherwise(last)
    return title_of_slug(own)


def unbranded_title(title: Column, brand: Column, candidates: Column, url: Column) -> Column:
    """For a title that is only a site's name: the longest other candidate or the address's own words."""
    every = F.filter(F.array_append(F.transform(candidates, F.trim), title_of_address(url)), lambda t: t.isNotNull() & (F.length(t) >= 3) & (F.lower(T.spaces(t)) != brand))
    return F.coalesce(_longest(every), F.trim(title))


def description_gate(text: Column, least: int = 150, sentences: int = 2) -> Column:
    """Enough characters, and enough sentences of over twelve."""
    t = T.spaces(text)
    return (F.length(t) >= least) & (F.size(F.filter(F.split(t, "[.!?]+"), lambda s: F.length(F.trim(s)) > 12)) >= sentences)


def without_contacts(html: Column) -> Column:
    """Mail addresses and telephone numbers taken out."""
    links = F.regexp_replace(html, r"(?is)<a\b[^>]*href=[\"'](?:mailto|tel):[^>]*>.*?</a>", "")
    return F.regexp_replace(F.regexp_replace(links, r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", ""), r"\b(?:\+?\d[\d\s().-]{7,}\d)\b", "")


def error_text(message: Column, most: int = 240) -> Column:
    """An error message without the query strings of its addresses, at most ``most`` characters."""
    clean = F.regexp_replace(message, r"(?i)(https?://[^\s)'\"?#]+)[?#][^\s)'\"]*", "$1")
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.left(clean, F.lit(most - 3)), F.lit("...")))


def image_key(url: Column) -> Column:
    """An image's address to compare by: no query or fragment; embedded images as they are."""
    u = F.trim(url)
    return F.when(F.coalesce(u, F.lit("")) == "", None).when(u.startswith("data:"), u).otherwise(F.regexp_replace(u, r"[?#].*$", ""))


def collection_pattern(url: Column) -> Column:
    """A path pattern of the items beside a page: of two parts and more the parent's, of one its own, else two parts."""
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts)
    prefix = F.array_join(F.when(n >= 2, F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(parts), "/")
    return F.when(n == 0, F.lit("^/[^/]+/[^/]+/?$")).otherwise(F.concat(F.lit("^/"), prefix, F.lit("/[^/]+/?$")))
