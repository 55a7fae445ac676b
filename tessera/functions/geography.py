"""Countries, continents and places in text as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.text import let

# Country names and their ISO 3166-1 codes, dial codes, continents by code and by slug.
COUNTRY_CODES = {
    "algeria": "DZ", "angola": "AO", "benin": "BJ", "botswana": "BW", "burkina faso": "BF", "burundi": "BI", "cabo verde": "CV", "cape verde": "CV", "cameroon": "CM",
    "central african republic": "CF", "chad": "TD", "comoros": "KM", "congo": "CG", "democratic republic of the congo": "CD", "drc": "CD", "cote d'ivoire": "CI",
    "côte d'ivoire": "CI", "ivory coast": "CI", "djibouti": "DJ", "egypt": "EG", "equatorial guinea": "GQ", "eritrea": "ER", "eswatini": "SZ", "swaziland": "SZ",
    "ethiopia": "ET", "gabon": "GA", "gambia": "GM", "the gambia": "GM", "ghana": "GH", "guinea": "GN", "guinea-bissau": "GW", "kenya": "KE", "lesotho": "LS",
    "liberia": "LR", "libya": "LY", "madagascar": "MG", "malawi": "MW", "mali": "ML", "mauritania": "MR", "mauritius": "MU", "morocco": "MA", "mozambique": "MZ",
    "namibia": "NA", "niger": "NE", "nigeria": "NG", "rwanda": "RW", "sao tome and principe": "ST", "senegal": "SN", "seychelles": "SC", "sierra leone": "SL",
    "somalia": "SO", "south africa": "ZA", "south sudan": "SS", "sudan": "SD", "tanzania": "TZ", "togo": "TG", "tunisia": "TN", "uganda": "UG", "zambia": "ZM",
    "zimbabwe": "ZW", "western sahara": "EH", "india": "IN", "bangladesh": "BD", "united states": "US", "usa": "US", "united states of america": "US",
    "united kingdom": "GB", "uk": "GB", "france": "FR", "germany": "DE", "netherlands": "NL", "brazil": "BR", "mexico": "MX", "canada": "CA", "australia": "AU",
    "china": "CN", "japan": "JP", "uae": "AE", "united arab emirates": "AE", "singapore": "SG", "indonesia": "ID", "vietnam": "VN", "philippines": "PH",
    "poland": "PL", "romania": "RO", "ukraine": "UA", "colombia": "CO", "ecuador": "EC", "chile": "CL", "argentina": "AR", "peru": "PE", "bolivia": "BO",
    "paraguay": "PY", "uruguay": "UY", "venezuela": "VE", "guatemala": "GT", "honduras": "HN", "nicaragua": "NI", "costa rica": "CR", "panama": "PA", "cuba": "CU",
    "jamaica": "JM", "haiti": "HT", "dominican republic": "DO", "el salvador": "SV", "belize": "BZ", "guyana": "GY", "suriname": "SR", "belgium": "BE", "spain": "ES",
    "italy": "IT", "portugal": "PT", "sweden": "SE", "norway": "NO", "denmark": "DK", "finland": "FI", "switzerland": "CH", "austria": "AT", "ireland": "IE",
    "new zealand": "NZ", "pakistan": "PK", "nepal": "NP", "sri lanka": "LK", "thailand": "TH", "malaysia": "MY", "cambodia": "KH", "laos": "LA", "myanmar": "MM",
    "south korea": "KR", "korea": "KR", "taiwan": "TW", "israel": "IL", "jordan": "JO", "lebanon": "LB", "turkey": "TR", "iran": "IR", "iraq": "IQ",
    "saudi arabia": "SA", "qatar": "QA", "kuwait": "KW", "bahrain": "BH", "oman": "OM", "yemen": "YE", "kazakhstan": "KZ", "uzbekistan": "UZ",
}
CONTINENT_CODES = {
    "Asia": ["IN", "BD", "CN", "JP", "SG", "ID", "VN", "PH", "NZ", "PK", "NP", "LK", "TH", "MY", "KH", "LA", "MM", "KR", "TW", "KZ", "UZ", "AU"],
    "Middle East and North Africa": ["AE", "IL", "JO", "LB", "TR", "IR", "IQ", "SA", "QA", "KW", "BH", "OM", "YE"],
    "Americas": ["US", "BR", "MX", "CA", "CO", "CL", "AR", "PE", "EC", "BO", "PY", "UY", "VE", "GT", "HN", "NI", "CR", "PA", "CU", "JM", "HT", "DO", "SV", "BZ", "GY", "SR"],
    "Europe": ["BE", "ES", "IT", "PT", "SE", "NO", "DK", "FI", "CH", "AT", "IE", "GB", "FR", "DE", "NL", "PL", "RO", "UA"],
    "Africa": [
        "DZ", "AO", "BJ", "BW", "BF", "BI", "CV", "CM", "CF", "TD", "KM", "CG", "CD", "CI", "DJ", "EG", "GQ", "ER", "SZ", "ET", "GA", "GM", "GH", "GN", "GW", "KE", "LS", "LR", "LY", "MG",
        "MW", "ML", "MR", "MU", "MA", "MZ", "NA", "NE", "NG", "RW", "ST", "SN", "SC", "SL", "SO", "ZA", "SS", "SD", "TZ", "TG", "TN", "UG", "EH", "ZM", "ZW",
    ],
}
CONTINENT_SLUGS = {"africa": "Africa", "asia": "Asia", "europe": "Europe", "americas": "Americas", "mena": "Middle East and North Africa", "global": "Global"}
DIAL_CODES = {
    "254": "Kenya", "255": "Tanzania", "256": "Uganda", "234": "Nigeria", "233": "Ghana", "27": "South Africa", "20": "Egypt", "212": "Morocco", "251": "Ethiopia",
    "250": "Rwanda", "221": "Senegal", "225": "Côte d'Ivoire",
}
# Fixed values too: how a city with its country, and an international number, are found in a text.
CITY_COUNTRY = r"([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ\s.'-]{1,40}),\s*([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ\s.'()-]{2,60})"
PHONE = r"(?:tel:|phone:|call\s)?\+(\d{1,3})[\s.-]?\d"


def mapped(key: Column, table: dict[str, str]) -> Column:
    """The value of a key in a small fixed table, or null."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def country_code(name: Column) -> Column:
    return mapped(F.lower(F.trim(name)), COUNTRY_CODES)


def continent_of(code: Column) -> Column:
    own = F.upper(F.trim(code))
    out = F.lit(None).cast("string")
    for continent, codes in CONTINENT_CODES.items():
        out = F.when(own.isin(codes), continent).otherwise(out)
    return out


def continent_names(slugs: list[str]) -> list[str]:
    """Names of continent slugs; unknown slugs have none."""
    return [CONTINENT_SLUGS[s.strip().lower()] for s in slugs if s.strip().lower() in CONTINENT_SLUGS]


def _trie(names: list[str]) -> str:
    """A pattern of one of some names, the longest first of those that begin alike; each letter is looked at once."""
    ends = "" in names
    heads: dict[str, list[str]] = {}
    for n in names:
        if n:
            heads.setdefault(n[0], []).append(n[1:])
    parts = [re.escape(c) + _trie(rest) for c, rest in heads.items()]
    if not parts:
        return ""
    return f"(?:{'|'.join(parts)}){'?' if ends else ''}" if ends or len(parts) > 1 else parts[0]


# The names that begin alike stand in one branch, and a city never gives back what it took: no comma can follow there.
_NAME = _trie(list(COUNTRY_CODES))
_CITY_FIRST = CITY_COUNTRY.replace("{1,40}", "{1,40}+")


def country_in_text(text: Column) -> Column:
    """(country, code, city): the first ``City, Country`` whose country is known, else the longest country name that
    stands alone; of names of one length, the first of the table.

    Cities are looked for only in texts that have a country's name after a comma, and lone names only where none is found.
    """

    def within(t: Column) -> Column:
        pairs = F.when(F.lower(t).rlike(rf",\s*{_NAME}"), F.regexp_extract_all(t, F.lit(_CITY_FIRST), F.lit(0)))
        country = lambda m: F.regexp_replace(F.trim(F.regexp_replace(m, r"^[^,]*,\s*", "")), "[.,;:]+$", "")
        split = F.transform(pairs, lambda m: F.struct(F.trim(F.substring_index(m, ",", 1)).alias("city"), F.lower(country(m)).alias("country")))
        known = F.get(F.filter(split, lambda p: mapped(p["country"], COUNTRY_CODES).isNotNull()), F.lit(0))
        return F.coalesce(let(known, lambda k: F.when(k.isNotNull(), place(k["country"], k["city"]))), let(alone(t), lambda n: F.when(n.isNotNull(), place(n, F.lit(None).cast("string")))))

    def place(name: Column, city: Column) -> Column:
        return F.struct(F.initcap(name).alias("country"), mapped(name, COUNTRY_CODES).alias("code"), city.alias("city"))

    def alone(t: Column) -> Column:
        names = sorted(COUNTRY_CODES, key=len, reverse=True)
        rank = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
        found = F.regexp_extract_all(F.lower(t), F.lit(rf"(?<![a-z]){_NAME}(?![a-z])"), F.lit(0))
        return F.get(F.array(*map(F.lit, names)), F.array_min(F.transform(found, lambda n: rank[n])))

    return let(text, within)


def country_of_phone(text: Column) -> Column:
    """The country of the first international number; digits of its code are taken greedily."""
    return mapped(F.regexp_extract(text, PHONE, 1), DIAL_CODES)


def with_defaults(rows: DataFrame, by_source: DataFrame, by_category: dict[str, str]) -> DataFrame:
    """rows (source, category, country, code, continent, …) with the geography of their source, else the continent of its
    category; rows with a country or continent stay as they are.  by_source: (source, default_country, default_continent),
    a small table."""
    open_ = F.col("country").isNull() & F.col("continent").isNull()
    out = rows.join(by_source, "source", "left").withColumn("_open", open_)
    has = F.col("default_continent").isNotNull()
    continent = F.when(has, F.col("default_continent")).otherwise(mapped(F.col("category"), by_category))
    return (
        out.withColumn("country", F.when(F.col("_open"), F.col("default_country")).otherwise(F.col("country")))
        .withColumn("code", F.when(F.col("_open") & has, country_code(F.col("default_country"))).otherwise(F.col("code")))
        .withColumn("continent", F.when(F.col("_open"), continent).otherwise(F.col("continent")))
        .drop("_open", "default_country", "default_continent")
    )
