"""Facet filters: only the predicates that a caller sets reach the plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import text as T
from tessera.functions.geography import continent_names


@dataclass
class SearchFilters:
    """What a search may be narrowed by; None leaves a facet open, an empty list matches nothing."""

    types: list[str] | None = None
    stages: list[str] | None = None
    sources: list[str] | None = None
    countries: list[str] | None = None
    continents: list[str] | None = None
    continent_slugs: list[str] | None = None
    statuses: list[str] | None = None
    topics: list[str] | None = None
    quality: str | None = None  # "strict" or "relaxed"
    grants: bool = False  # whether grant records are shown

    def predicates(self) -> list[Column]:
        out = [F.col("active")]
        for name, wanted in (("resource_type", self.types), ("maturity", self.stages), ("source", self.sources), ("review_status", self.statuses)):
            if wanted is not None:
                out.append(F.col(name).isin(wanted))
        if self.quality:
            out.append(quality_browse(relaxed=self.quality == "relaxed"))
        return out

    def wanted_continents(self) -> list[str] | None:
        """Names of continents and of continent slugs together."""
        if self.continents is None and self.continent_slugs is None:
            return None
        return [*(self.continents or []), *continent_names(self.continent_slugs or [])]


def apply(rows: DataFrame, filters: SearchFilters, locations: DataFrame | None = None, topics: DataFrame | None = None, grants: DataFrame | None = None) -> DataFrame:
    """Rows that pass every set facet.  Country and continent are semi-joins on the small location table; ``topics``
    (id, slug) bears the topic facet, and ``grants`` (id) are left out unless they are asked for."""
    out = rows.where(reduce(lambda a, b: a & b, filters.predicates()))
    if filters.countries is not None:
        out = out.join(locations.where(F.upper("country").isin([c.upper() for c in filters.countries])), "nation_key", "left_semi")
    continents = filters.wanted_continents()
    if continents is not None:
        out = out.join(locations.where(F.upper("continent").isin([c.upper() for c in continents])), "nation_key", "left_semi")
    if filters.topics is not None:
        out = out.join(topics.where(F.col("slug").isin(filters.topics)), "id", "left_semi")
    if grants is not None and not filters.grants:
        out = out.join(grants, "id", "left_anti")
    return out


def quality_browse(relaxed: bool) -> Column:
    """What a public browse shows: no editorial items, enough body, a proper title; strict also bars capital titles."""
    title, summary, body = F.col("title"), F.col("summary"), F.col("body")
    length = lambda c: F.length(F.trim(F.coalesce(c, F.lit(""))))
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = (
        (F.col("resource_type") != "ARTICLE")
        & (F.greatest(length(summary), length(body)) >= (40 if relaxed else 80))
        & (length(title) >= 4)
        & ~low(title).isin(T.BLOCKED_TITLES)
        & ~title.rlike("(?i)websit$")
        & ~title.rlike(r"^#+\s")
        & (low(summary) != low(title))
    )
    if not relaxed:
        capitals = (F.length(T.letters(title)) > 6) & (F.upper(title) == title) & title.rlike("[A-Z]")
        out = out & ~capitals
    return out & ~T.pandemic(title, summary, body)  # the only rule that searches whole bodies comes last


def quality_order() -> list[Column]:
    """Thin or repeated summaries last, then newest."""
    s, t = F.lower(F.trim(F.coalesce("summary", F.lit("")))), F.lower(F.trim(F.coalesce("title", F.lit(""))))
    return [F.when(s == t, 1).when(F.length(s) < 60, 1).otherwise(0), F.col("id").desc()]


def existence_flag(rows: DataFrame, keys: DataFrame, on: str, name: str) -> DataFrame:
    """rows with a boolean column: the key has a row in ``keys``."""
    return rows.join(keys.select(on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


# Words of administration that veto, and of innovation of which one must stand.
ADMIN_WORDS = [r"\bwork programme\b", r"\bgrant agreement\b", r"\bproject management\b", r"\bdissemination\b.*\bonly\b", r"\badministrative\b"]
INNOVATION_WORDS = [
    r"\binnovat", r"\bstartup", r"\bscale-?up", r"\bsme\b", r"\bcommercial", r"\bmarket\b", r"\bproduct\b", r"\btechnology transfer\b", r"\baccelerator\b", r"\bventure\b", r"\beic\b", r"\bhorizon\b",
    r"\bsbir\b", r"\bsttr\b",
]


def innovation_faults(text: Column) -> Column:
    """Why a record is no innovation: no text, each administrative pattern, or no sign of one; empty for one that is."""
    admin = F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(f"admin_pattern:{p}")) for p in ADMIN_WORDS]))
    none = F.when(~text.rlike(T.any_of(INNOVATION_WORDS)), F.array(F.lit("no_innovation_signal"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.array(F.lit("empty_text"))).otherwise(F.when(F.size(admin) > 0, admin).otherwise(none))


def dropped_at_gate(source: Column, reasons: Column, by_source: dict[str, list[str]], strict: list[str]) -> Column:
    """Whether an item is left out at the quality gate: any reason for strict sources, a listed one for the others."""
    out = source.isin(strict) & (F.size(reasons) > 0)
    for name, codes in by_source.items():
        out = out | ((source == name) & F.arrays_overlap(reasons, F.array(*map(F.lit, codes))))
    return F.coalesce(out, F.lit(False))


def missing_image(url: Column) -> Column:
    return url.isNull() | (F.trim(url) == "") | url.startswith("data:")


def junk_person(name: Column) -> Column:
    """A name that is none: one to three single letters, or a legal form."""
    return F.coalesce(F.trim(name).rlike(r"(?i)^[a-z](\s+[a-z]){0,2}$") | T.legal_form(name), F.lit(False))
