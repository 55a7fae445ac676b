"""Full-text legs over whole documents: terms, strict and any-term matches, phrases and exclusions, weighted cover density."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


# Common English words that a search leaves out.
STOP_WORDS = set(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just "
    "don should now cannot could ought would".split()
)


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def query_terms(query: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9]+", query.lower()) if t]


def or_words(query: str) -> list[str]:
    """Words of at least two characters, repeats kept."""
    return [w for w in query.lower().split() if len(w) >= 2]


@dataclass
class Parsed:
    """Alternatives of a web-style query: each a list of phrases that must and that must not occur."""

    alternatives: list[tuple[list[list[str]], list[list[str]]]] = field(default_factory=list)


def parse_query(query: str) -> Parsed:
    """Implicit AND, quoted phrases, ``or`` and ``-not``; malformed input never fails."""
    out, must, never = Parsed(), [], []
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"?|(\S+))', query):
        if not quoted and word.lower() == "or":
            if must or never:
                out.alternatives.append((must, never))
            must, never = [], []
            continue
        phrase = query_terms(quoted or word)
        if phrase:
            (never if minus else must).append(phrase)
    if must or never:
        out.alternatives.append((must, never))
    return out


def has_phrase(tokens: Column, phrase: list[str]) -> Column:
    """The tokens hold the phrase, its words next to each other."""
    if len(phrase) == 1:
        return F.array_contains(tokens, phrase[0])
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(" " + " ".join(phrase) + " ")


def matches(tokens: Column, parsed: Parsed) -> Column:
    out = F.lit(False)
    for must, never in parsed.alternatives:
        one = F.lit(True)
        for p in must:
            one = one & has_phrase(tokens, p)
        for p in never:
            one = one & ~has_phrase(tokens, p)
        out = out | one
    return out


def or_count(tokens: Column, words: list[str]) -> Column:
    """How many of the words the tokens hold; a word of several terms needs them all, repeats count again."""
    out = F.lit(0)
    for w in words:
        own, every = query_terms(w), F.lit(True)
        for t in own:
            every = every & F.array_contains(tokens, t)
        if own:
            out = out + F.when(every, 1).otherwise(0)
    return out


def occurrences(tokens: Column, words: list[str]) -> Column:
    """How often any of the words occurs."""
    return F.size(F.filter(tokens, lambda t: t.isin(words)))


def spots(fields: list[tuple[Column, float]], groups: list[list[str]]) -> Column:
    """(k, place, weight) of the tokens of each group of words, by place; fields are token arrays with weights, placed one
    after another."""
    which = lambda t: F.coalesce(*[F.when(t.isin(g), F.lit(i)) for i, g in enumerate(groups)])

    def placed(tokens: Column, weight: float, offset: Column) -> Column:
        return F.transform(tokens, lambda t, i: F.struct(which(t).alias("k"), (i + offset).cast("int").alias("place"), F.lit(float(weight)).alias("weight")))

    out, offset = F.array().cast("array<struct<k:int,place:int,weight:double>>"), F.lit(0)
    for tokens, weight in fields:
        out = F.concat(out, F.filter(placed(tokens, weight, offset), lambda x: x["k"].isNotNull()))
        offset = offset + F.size(tokens)
    return out


def density(found: Column, n: int) -> Column:
    """Cover density of ``n`` groups of words over their spots: for every shortest cover of all of them, n / (sum of
    1 / weight) / (places it spans)."""

    def step(state: Column, x: Column) -> Column:
        last = F.transform(state["last"], lambda v, i: F.when(i == x["k"], F.struct(x["place"].alias("place"), (1 / x["weight"]).alias("cost"))).otherwise(v))
        low = F.array_min(F.transform(last, lambda v: v["place"]))
        cost = F.aggregate(last, F.lit(0.0), lambda a, v: a + v["cost"])
        more = F.when(low > state["start"], n / cost / (x["place"] - low + 1)).otherwise(0.0)
        return F.struct(last.alias("last"), (state["total"] + more).alias("total"), F.greatest(state["start"], low).alias("start"))

    none = F.struct(F.lit(-1).alias("place"), F.lit(1.0).alias("cost"))
    start = F.struct(F.array(*[none] * n).alias("last"), F.lit(0.0).alias("total"), F.lit(-1).alias("start"))
    return F.aggregate(found, start, step)["total"]


def postings(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(term, id, n): an inverted index."""
    return docs.select(F.col(id_col).alias("id"), F.explode(terms(text)).alias("term")).groupBy("term", "id").agg(F.count("*").alias("n"))


def term_totals(docs: DataFrame, text: Column) -> DataFrame:
    """(term, docs, n): totals of an inverted index in one shuffle; each row's sorted tokens tell where a term is new to it."""
    sorted_ = docs.select(F.sort_array(terms(text)).alias("t"))
    marked = F.transform("t", lambda x, i: F.struct(x.alias("term"), F.when((i == 0) | (F.get("t", i - 1) != x), 1).otherwise(0).alias("new")))
    return sorted_.select(F.inline(marked)).groupBy("term").agg(F.sum("new").alias("docs"), F.count("*").alias("n"))
