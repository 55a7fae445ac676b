"""Keyword taxonomy, regions and stages as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Slugs and their phrases, in rule order.
SECTORS = {
    "agriculture": ["agriculture", "agri-tech", "agritech", "farming", "smallholder", "crop", "livestock", "soil"],
    "water": ["drinking water", "clean water", "potable water", "water access", "sanitation", "hygiene", "desalination", "groundwater", "rainwater", "water scarcity", "water supply", "water filter"],
    "energy": ["energy", "solar", "wind power", "off-grid", "electrification", "battery", "biogas"],
    "food": ["food security", "nutrition", "food system", "food tech"],
    "climate": ["climate", "carbon", "emissions", "decarbon", "net zero", "greenhouse"],
    "health": ["health", "healthcare", "medical", "maternal", "diagnostic", "pharma"],
    "education": ["education", "edtech", "learning", "school", "literacy", "training"],
    "waste": ["waste", "recycling", "landfill", "compost", "circular economy", "plastic waste", "e-waste", "waste management", "solid waste"],
    "biodiversity": ["biodiversity", "conservation", "wildlife", "ecosystem", "reforestation"],
    "finance": ["fintech", "financial inclusion", "microfinance", "insurance", "lending"],
    "government": ["government", "public sector", "policy", "civic tech"],
    "community-development": ["community development", "livelihood", "social enterprise"],
}
PROBLEMS = {
    "drinking-water": ["drinking water", "clean water", "potable water", "water access"],
    "wastewater": ["wastewater", "sewage", "effluent"],
    "irrigation": ["irrigation", "drip irrigation"],
    "food-loss": ["food loss", "food waste", "spoilage", "post-harvest"],
    "energy-access": ["energy access", "electricity access", "off-grid", "unreliable grid"],
    "cold-chain": ["cold chain", "cold storage", "refrigeration"],
    "flooding": ["flooding", "flood risk", "stormwater"],
    "waste-management": ["waste management", "solid waste", "landfill", "recycling", "circular economy", "plastic pollution", "e-waste"],
    "healthcare-access": ["healthcare access", "primary care", "health access"],
    "education-access": ["education access", "out of school", "learning poverty"],
    "financial-inclusion": ["financial inclusion", "unbanked", "underbanked"],
    "biodiversity-loss": ["biodiversity loss", "habitat loss", "deforestation"],
}
TECHNOLOGIES = {
    "solar": ["solar", "photovoltaic", "pv panel"],
    "drip-irrigation": ["drip irrigation", "micro-irrigation"],
    "filtration": ["filtration", "water filter", "membrane"],
    "recycling": ["recycling", "upcycling"],
    "sensors": ["sensor", "iot", "telemetry"],
    "mobile-technology": ["mobile app", "ussd", "sms"],
    "evaporative-cooling": ["evaporative cooling", "cooling chamber"],
}
STAGE_ORDER = ["SCALED", "MULTIPLE_DEPLOYMENTS", "DEPLOYED", "PILOT", "PROTOTYPE", "IDEA", "UNKNOWN"]
# Names of stages, and the words in a text that tell one, in rule order.
STAGE_ALIASES = {
    "IDEA": ["IDEA", "CONCEPT", "EARLY", "SEED", "PRE_SEED"],
    "PROTOTYPE": ["PROTOTYPE", "MVP"],
    "PILOT": ["PILOT", "PILOTING", "TRIAL"],
    "DEPLOYED": ["DEPLOYED", "DEPLOYMENT", "COMMERCIAL", "MARKET"],
    "MULTIPLE_DEPLOYMENTS": ["MULTIPLE_DEPLOYMENTS"],
    "SCALED": ["SCALED", "SCALE", "GROWTH"],
    "UNKNOWN": ["UNKNOWN"],
}
STAGE_SIGNALS = [
    ("PILOT", r"\b(pilot(?:ing)?|trial(?:s)?|proof of concept)\b"),
    ("PROTOTYPE", r"\b(prototype|mvp|beta version)\b"),
    ("DEPLOYED", r"\b(deployed|commerciali[sz]ed|on the market|paying customers?)\b"),
    ("SCALED", r"\b(scaled|scaling|(?:in|across) \d+\+?\s*countries|nationwide rollout)\b"),
    ("IDEA", r"\b(early.?stage|concept|idea stage|pre.?seed)\b"),
    ("PILOT", r"\b(award|grant|funding round|series [abc])\b"),
]
INVESTMENT_SIGNALS = [("IDEA", "seed|pre-seed|idea"), ("PROTOTYPE", "prototype|mvp|beta"), ("PILOT", "pilot|trial"), ("DEPLOYED", "revenue|commercial|deploy|market|growth|scale")]


def tags(text: Column, rules: dict[str, list[str]], most: int = 3) -> Column:
    """The first ``most`` slugs with a phrase that stands between non-alphanumeric characters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.when(low.rlike("(?:^|[^a-z0-9])(?:" + "|".join(map(re.escape, p)) + ")(?:[^a-z0-9]|$)"), F.lit(s)) for s, p in rules.items()]
    return F.slice(F.array_compact(F.array(*hits)), 1, most)


# The continent of a region label, by the whole label, else by the first words that it holds.
REGION_LABELS = {"GLOBAL": "Global", "MENA": "Middle East and North Africa"}
REGION_WORDS = [("MIDDLE EAST", "Middle East and North Africa"), ("AFRICA", "Africa"), ("ASIA", "Asia"), ("PACIFIC", "Asia"), ("EUROPE", "Europe"), ("LATIN", "Americas"), ("AMERICA", "Americas"), ("CARIBBEAN", "Americas")]


def region_continent(label: Column) -> Column:
    """The continent that a label such as ``AFRICA • HEALTH`` names."""
    u = F.upper(F.trim(F.split_part(label, F.lit("•"), F.lit(1))))
    whole = [F.when(u == name, F.lit(continent)) for name, continent in REGION_LABELS.items()]
    return F.coalesce(*whole, *[F.when(u.contains(word), F.lit(continent)) for word, continent in REGION_WORDS])


def region_sector(label: Column) -> Column:
    return F.nullif(F.trim(F.split_part(label, F.lit("•"), F.lit(2))), F.lit(""))


def stage_rank(stage: Column) -> Column:
    out = F.lit(len(STAGE_ORDER))
    for i, s in reversed(list(enumerate(STAGE_ORDER))):
        out = F.when(stage == s, i).otherwise(out)
    return out


def stage_from_trl(text: Column) -> Column:
    """The stage of a technology readiness level in a text: up to 3 an idea, 6 a prototype, 8 a pilot, else deployed."""
    level = F.regexp_extract(text, r"(?i)TRL\s*(\d+)", 1).try_cast("int")
    return F.when(level.isNull(), "UNKNOWN").when(level <= 3, "IDEA").when(level <= 6, "PROTOTYPE").when(level <= 8, "PILOT").otherwise("DEPLOYED")


def first_signal(text: Column, signals: list[tuple[str, str]]) -> Column:
    """The stage of the first pattern that a text holds, or null."""
    out = F.lit(None).cast("string")
    for stage, pattern in reversed(signals):
        out = F.when(text.rlike(f"(?i){pattern}"), stage).otherwise(out)
    return out


def stage_of_label(label: Column) -> Column:
    """The stage that a label names in whatever case and punctuation, or null."""
    key = F.regexp_replace(F.regexp_replace(F.upper(F.trim(label)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    out = F.lit(None).cast("string")
    for stage, names in STAGE_ALIASES.items():
        out = F.when(key.isin(names), stage).otherwise(out)
    return out


def stage_of_metadata(metadata: Column) -> Column:
    """The stage that fields of a JSON object tell: a label or level, a programme's stage, an investment stage."""
    field = lambda *names: F.coalesce(*[F.get_json_object(metadata, f"$.{n}") for n in names])
    known = lambda c: F.nullif(stage_of_label(c), F.lit("UNKNOWN"))
    direct, level = field("stage", "evidence_stage", "maturity_stage", "trl"), field("stage", "evidence_stage", "maturity_stage", "trl").try_cast("double")
    by_level = F.when(level.between(1, 3), "IDEA").when(level.between(4, 6), "PROTOTYPE").when(level.between(7, 8), "PILOT").when(level >= 9, "DEPLOYED")
    by_text = F.when(level.isNull(), F.coalesce(known(direct), first_signal(direct, STAGE_SIGNALS)))
    return F.coalesce(by_text, by_level, known(field("solve_stage", "programme_stage")), first_signal(F.lower(field("investment_stage", "company_stage")), INVESTMENT_SIGNALS))


def slug_with_evidence(label: Column, inferred: Column, names: dict[str, str], rules: dict[str, list[str]], exact_only: bool) -> Column:
    """The slug of a label if the text's own slugs (an array) bear it out, else the first of these.

    names: slug by name; a label that is no name or slug has the first slug that ``rules`` find in it.
    With ``exact_only`` (problems), a label without any evidence stands when the text shows nothing at all.
    """
    norm = F.lower(F.trim(label))
    own = F.create_map(*[F.lit(x) for n, s in names.items() for x in (n, s)])
    slug = F.coalesce(own[norm], F.when(F.regexp_replace(norm, r"\s+", "-").isin(list(names.values())), F.regexp_replace(norm, r"\s+", "-")), F.try_element_at(tags(label, rules), F.lit(1)))
    first = F.try_element_at(inferred, F.lit(1))
    held = F.when(slug.isNotNull() & F.array_contains(inferred, slug), slug)
    rest = F.when(slug.isNotNull() & (F.size(inferred) == 0), slug).otherwise(F.coalesce(first, slug)) if exact_only else F.when(slug.isNotNull(), first)
    return F.when(F.coalesce(norm, F.lit("")) != "", F.coalesce(held, rest))
