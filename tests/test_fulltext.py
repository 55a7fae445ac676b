"""The stored index against searches of whole texts."""

import random
import re

import pyarrow as pa
import pytest
from tessera.functions.stem import stem
from tessera.operators import fulltext
from tessera.operators.fulltext import FullTextIndex, Query
from tessera.operators.lexical import STOP_WORDS

FIELDS = {"title": 1.0, "body": 0.2}
WORDS = ["pump", "pumps", "solar", "water", "filters", "filtering", "the", "of", "farm", "farming", "wind", "cheap", "city", "cities", "x1"]


def texts(n, start=0, seed=0):
    rng = random.Random(seed)
    make = lambda k: " ".join(rng.choices(WORDS, [1, 1, 2, 6, 1, 1, 8, 8, 2, 1, 1, 1, 1, 1, 1], k=k))
    rows = [(start + i, make(rng.randrange(4)), rng.choice([make(rng.randrange(30)), make(3).upper() + "!", None, ""])) for i in range(n)]
    return [*rows, (start + n, "Pump", "solar " * 300), (start + n + 1, None, None)]


def brute(spark, rows, query):
    """(id, strict, n, density) by walking over every text."""
    stop = STOP_WORDS
    words = list(dict.fromkeys(stem(t) for t in re.findall("[a-z0-9]+", query.lower()) if t not in stop))
    out = {}
    for key, title, body in rows:
        spots, at = [], 0
        for text, w in ((title, 1.0), (body, 0.2)):
            for t in re.findall("[a-z0-9]+", (text or "").lower()):
                if t not in stop and stem(t) in words:
                    spots.append((at, words.index(stem(t)), w))
                at += 1
        if not spots:
            continue
        density, last, start = 0.0, {}, -1
        for place, k, w in spots:  # a cover ends here and begins as late as it can
            last[k] = (place, 1 / w)
            if len(last) == len(words) and (low := min(p for p, _ in last.values())) > start:
                density += len(words) / sum(c for _, c in last.values()) / (place - low + 1)
                start = low
        n = len({k for _, k, _ in spots})
        out[key] = (n == len(words), n, round(density, 6))
    return out


def collected(df):
    return {r.id: (r.strict, r.n, round(r.density, 6)) for r in df.collect()}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = texts(3000)
    return rows, FullTextIndex(spark, str(tmp_path_factory.mktemp("index")), FIELDS).add(spark.createDataFrame(rows, "id long, title string, body string"))


@pytest.mark.parametrize("query", ["pumping", "water the farm", "solar filter", "city", "zzz", "cheap wind x1"])
def test_hits_against_brute_force(spark, index, query):
    rows, i = index
    assert collected(i.hits(Query.parse(query))) == brute(spark, rows, query)


@pytest.mark.parametrize("query", ["pump", "water pump", "city x1 wind"])
@pytest.mark.parametrize("size", [1, 7, 200])
def test_pools_are_whole_though_blocks_are_skipped(spark, monkeypatch, index, query, size):
    rows, i = index
    monkeypatch.setattr(fulltext, "FIRST", 2)
    want = brute(spark, rows, query)
    got = collected(i.top(Query.parse(query), size))
    best = lambda found: [sorted((k for k, v in found.items() if v[0]), key=lambda k: (-found[k][2], k))[:size], sorted(found, key=lambda k: (-found[k][1], k))[:size]]
    assert best(got) == best(want)
    assert all(want[k] == v for k, v in got.items())
    assert i.visited <= i.bounds(Query.parse(query)).count() == 12


def test_blocks_that_cannot_change_a_pool_are_skipped(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(fulltext, "FIRST", 3)
    rows = [(k, "", "pump here" + " pump water" * (5 if 2000 <= k < 2010 else 0)) for k in range(8000)]
    i = FullTextIndex(spark, str(tmp_path), FIELDS).add(spark.createDataFrame(rows, "id long, title string, body string"))
    got, want = collected(i.top(Query.parse("pump water"), 8)), brute(spark, rows, "pump water")
    assert sorted(got, key=lambda k: (-got[k][2], k))[:8] == sorted(want, key=lambda k: (-want[k][2], k))[:8] == list(range(2000, 2008))
    assert i.visited == 3 and i.bounds(Query.parse("pump")).count() == 32


def test_only_allowed_rows_fill_a_pool(spark, monkeypatch, index):
    rows, i = index
    monkeypatch.setattr(fulltext, "FIRST", 1)
    some = i.rows.where("id % 7 = 3")
    want = {k: v for k, v in brute(spark, rows, "water pump").items() if k % 7 == 3}
    got = collected(i.top(Query.parse("water pump"), 5, some))
    assert sorted(got, key=lambda k: (-got[k][1], k))[:5] == sorted(want, key=lambda k: (-want[k][1], k))[:5] and all(k % 7 == 3 for k in got)


def test_grammar(spark, index):
    rows, i = index
    stop = STOP_WORDS
    terms = {k: [None if t in stop else stem(t) for t in re.findall("[a-z0-9]+", f"{a or ''} {b or ''}".lower())] for k, a, b in rows}
    phrase = lambda t, p: any(all(w is None or x == w for x, w in zip(t[j : j + len(p)], p)) and len(t[j:]) >= len(p) for j in range(len(t)))
    for text, rule in (
        ('"solar water" -wind', lambda t: phrase(t, ["solar", "water"]) and "wind" not in t),
        ('"water of farms" or city', lambda t: phrase(t, ["water", None, "farm"]) or "citi" in t),
        ("pump -water", lambda t: "pump" in t and "water" not in t),
    ):
        got = {k for k, v in collected(i.hits(Query.parse(text))).items() if v[0]}
        assert got == {k for k, t in terms.items() if rule(t)}


def test_segments_and_removed_documents(spark, tmp_path):
    old, new = texts(400, 0, 1), texts(300, 5000, 2)
    frame = lambda rows: spark.createDataFrame(rows, "id long, title string, body string")
    i = FullTextIndex(spark, str(tmp_path), FIELDS).add(frame(old))
    files = sorted(str(p) for p in tmp_path.rglob("*.parquet"))
    i.add(frame(new))
    assert set(files) <= {str(p) for p in tmp_path.rglob("*.parquet")}  # nothing is rebuilt
    assert collected(i.hits(Query.parse("solar pump"))) == brute(spark, old + new, "solar pump")
    i.remove(spark.range(0, 200)).remove(spark.createDataFrame([(5001,)], "id long"))
    assert collected(i.hits(Query.parse("solar pump"))) == brute(spark, [r for r in old + new if r[0] >= 200 and r[0] != 5001], "solar pump")


def test_a_search_reads_buckets_and_no_text(spark, index):
    _, i = index
    plan = i.hits(Query.parse("solar pump"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan and "In(stem" in plan and "body" not in plan


def test_stop_words_and_blank_queries_match_nothing(spark, index):
    _, i = index
    assert i.top(Query.parse("the of"), 5).isEmpty() and i.top(Query.parse(""), 5).isEmpty()


def test_hybrid_search_scans_no_text(spark, sf):
    from tessera.plans import search

    search.text_index(spark, sf)
    plan = search.search(spark, sf, "thin thing")._jdf.queryExecution().optimizedPlan().toString()
    assert "documents" not in plan and not re.search(r"[#, ](text|body)#", plan)


def test_vectors(spark):
    got = {(r.stem): [(s.place, s.weight) for s in r.spots] for r in fulltext.vectors(spark.createDataFrame([(1, "The Farms", "farming of x")], "id long, title string, body string"), FIELDS).collect()}
    assert got == {"farm": [(1, 1.0), (2, 0.2)], "x": [(4, 0.2)]}


def test_vectors_of_wanted_stems_shuffle_whole_texts_once(spark):
    rows = [(1, "The Farms", "farming of x"), (2, None, "pumps, Pumping!"), (1, "pump", "solar farm"), (3, "", None)]
    df = spark.createDataFrame(rows, "id long, title string, body string")
    got = sorted((r.id, r.stem, [(s.place, s.weight) for s in r.spots]) for r in fulltext.vectors(df, FIELDS, wanted=["farm", "pump"]).collect())
    assert got == [(1, "farm", [(1, 1.0), (2, 0.2), (2, 0.2)]), (1, "pump", [(0, 1.0)]), (2, "pump", [(0, 0.2), (1, 0.2)])]
    assert sorted(tuple(r) for r in fulltext.occurrences(df, FIELDS, wanted=["solar"]).collect()) == [(1, "solar", 1, 0.2)]
    plan = fulltext.vectors(df, FIELDS).groupBy("stem").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 1


def test_vectors_are_made_slice_by_slice(spark, monkeypatch):
    rows = texts(300)
    df = spark.createDataFrame(rows, "id long, title string, body string")
    key = lambda r: (r.id, r.stem, tuple(map(tuple, r.spots)))
    whole = sorted(map(key, fulltext.vectors(df, FIELDS).collect()))
    run = fulltext._spots(2, FIELDS.values(), None)
    monkeypatch.setattr(fulltext, "SLICE_CHARS", 50)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([1] * len(rows)), *[pa.array([r[i] for r in rows], pa.string()) for i in (1, 2)]], names=["id", "n", "_0", "_1"])
    made = list(run(iter([batch])))
    assert len(made) > 20 and sorted((r["id"], r["stem"], tuple((s["place"], s["weight"]) for s in r["spots"])) for b in made for r in b.to_pylist()) == whole
