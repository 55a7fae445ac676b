"""English stems, by the published Snowball rules for English (Porter's second stemmer).

``stem`` works on one word; ``stems`` is a column that stems each distinct term of an Arrow batch once.  Words of other
characters than a-z, and those of one or two letters, are their own stems.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The published tables of the rules.  Of several endings the longest counts.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
LEFT_AFTER_PLURALS = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
FIRST_REGION = ["gener", "commun", "arsen"]
STEP_2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent",
    "fulli": "ful", "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "ative": "", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ["ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic"]
DOUBLES = ["bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"]
LI_AFTER = "cdeghkmnrt"

_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT_END = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_VOWEL = re.compile("[aeiouy]")


def _ending(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in SPECIAL:
        return SPECIAL[word]
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))  # a y that is no vowel
    found = _REGION.search(w)
    r1 = next((len(p) for p in FIRST_REGION if w.startswith(p)), found.end() if found else len(w))
    found = _REGION.search(w, r1)
    r2 = found.end() if found else len(w)

    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in LEFT_AFTER_PLURALS:
        return w
    # past and -ing forms
    end = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    elif end and _VOWEL.search(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in DOUBLES:
            w = w[:-1]
        elif len(w) <= r1 and _SHORT_END.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and not _VOWEL.match(w[-2]):
        w = w[:-1] + "i"
    # suffixes of suffixes
    end = _ending(w, STEP_2)
    before = w[: len(w) - len(end)]
    if end and len(before) >= r1 and (end != "ogi" or before.endswith("l")) and (end != "li" or before[-1:] in tuple(LI_AFTER)):
        w = before + STEP_2[end]
    end = _ending(w, STEP_3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP_3[end]
    end = _ending(w, STEP_4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    # a last e or double l
    if w.endswith("e") and (len(w) > r2 or (len(w) > r1 and not _SHORT_END.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(StringType())
def stems(terms: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(terms)
    return pd.Series([stem(t) for t in distinct], dtype=object).reindex(codes).reset_index(drop=True)


def stems_sql(source: str, name: str = "stemmed") -> str:
    """DuckDB common table expressions that end in ``name`` (x, s): the stem of each distinct x of ``source``.

    The rules are said again as patterns over a table, so that SQL and the function above can be held against each other.
    """
    v, c = "[aeiouy]", "[^aeiouy]"
    region = f"^{c}*{v}+{c}"
    short = f"({c}{v}[^aeiouywxY]|^{v}{c})$"
    ends = lambda e: f"w LIKE '%{e}'"
    cut = lambda n: f"left(w, length(w) - {n})"

    def replace(table: dict[str, str], where) -> str:
        arms = [f"WHEN {ends(e)} THEN CASE WHEN {where(e)} THEN {cut(len(e))} || '{t}' ELSE w END" for e, t in sorted(table.items(), key=lambda x: -len(x[0]))]
        return f"CASE {' '.join(arms)} ELSE w END"

    step_2 = replace(STEP_2, lambda e: f"length(w) - {len(e)} >= r1" + {"ogi": f" AND {ends('logi')}", "li": f" AND regexp_matches(w, '[{LI_AFTER}]li$')"}.get(e, ""))
    step_3 = replace(STEP_3, lambda e: f"length(w) - {len(e)} >= {'r2' if e == 'ative' else 'r1'}")
    step_4 = replace(dict.fromkeys(STEP_4, ""), lambda e: f"length(w) - {len(e)} >= r2" + (" AND regexp_matches(w, '[st]ion$')" if e == "ion" else ""))
    special = " ".join(f"WHEN x = '{a}' THEN '{b}'" for a, b in SPECIAL.items())
    kept = ", ".join(f"'{x}'" for x in LEFT_AFTER_PLURALS)
    first = " ".join(f"WHEN w LIKE '{p}%' THEN {len(p)}" for p in FIRST_REGION)
    n = name
    return f"""{n}_0 AS (SELECT DISTINCT x FROM {source}),
{n}_1 AS (SELECT x, regexp_replace(regexp_replace(x, '^y', 'Y'), '({v})y', '\\1Y', 'g') AS w FROM {n}_0 WHERE length(x) > 2 AND regexp_full_match(x, '[a-z]+')),
{n}_2 AS (SELECT *, CASE {first} WHEN regexp_matches(w, '{region}') THEN length(regexp_extract(w, '{region}')) ELSE length(w) END AS r1 FROM {n}_1),
{n}_3 AS (SELECT x, w, r1, CASE WHEN regexp_matches(substr(w, r1 + 1), '{region}') THEN r1 + length(regexp_extract(substr(w, r1 + 1), '{region}')) ELSE length(w) END AS r2 FROM {n}_2),
{n}_4 AS (SELECT x, r1, r2, CASE WHEN {ends('sses')} THEN {cut(2)} WHEN {ends('ied')} OR {ends('ies')} THEN CASE WHEN length(w) > 4 THEN {cut(2)} ELSE {cut(1)} END
  WHEN {ends('us')} OR {ends('ss')} THEN w WHEN {ends('s')} AND regexp_matches({cut(2)}, '{v}') THEN {cut(1)} ELSE w END AS w FROM {n}_3),
{n}_5 AS (SELECT *, CASE WHEN {ends('eedly')} THEN 5 WHEN {ends('eed')} THEN 3 WHEN {ends('ingly')} THEN 5 WHEN {ends('edly')} THEN 4 WHEN {ends('ing')} THEN 3 WHEN {ends('ed')} THEN 2 ELSE 0 END AS e, regexp_matches(w, 'eed(ly)?$') AS eed FROM {n}_4),
{n}_6 AS (SELECT x, r1, r2, w IN ({kept}) AS done, CASE WHEN eed THEN CASE WHEN length(w) - e >= r1 THEN {cut('e')} || 'ee' ELSE w END WHEN e > 0 AND regexp_matches({cut('e')}, '{v}') THEN {cut('e')} ELSE w END AS w,
  e > 0 AND NOT eed AND regexp_matches({cut('e')}, '{v}') AS off FROM {n}_5),
{n}_7 AS (SELECT x, r1, r2, done, CASE WHEN NOT off THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN right(w, 2) IN ({", ".join(f"'{d}'" for d in DOUBLES)}) THEN {cut(1)}
  WHEN length(w) <= r1 AND regexp_matches(w, '{short}') THEN w || 'e' ELSE w END AS w FROM {n}_6),
{n}_8 AS (SELECT x, r1, r2, done, CASE WHEN regexp_matches(w, '.{c}[yY]$') THEN {cut(1)} || 'i' ELSE w END AS w FROM {n}_7),
{n}_9 AS (SELECT x, r1, r2, done, {step_2} AS w FROM {n}_8),
{n}_10 AS (SELECT x, r1, r2, done, {step_3} AS w FROM {n}_9),
{n}_11 AS (SELECT x, r1, r2, done, {step_4} AS w FROM {n}_10),
{n}_12 AS (SELECT x, done, CASE WHEN {ends('e')} AND (length(w) > r2 OR (length(w) > r1 AND NOT regexp_matches({cut(1)}, '{short}'))) THEN {cut(1)} WHEN {ends('ll')} AND length(w) > r2 THEN {cut(1)} ELSE w END AS w FROM {n}_11),
{n} AS (SELECT x, CASE {special} WHEN done THEN {n}_4.w WHEN {n}_12.w IS NULL THEN x ELSE replace({n}_12.w, 'Y', 'y') END AS s FROM {n}_0 LEFT JOIN {n}_12 USING (x) LEFT JOIN {n}_4 USING (x))"""
