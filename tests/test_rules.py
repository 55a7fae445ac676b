"""Rules against exact values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import taxonomy as X, text as T
from tessera.operators import lexical, merge, ranking, runs, vectors
from tessera.sources import pages, records


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "url,want",
    [
        ("Http://Shop.Test.:80/Pumps/Hand//?gclid=9&k=v&fbclid=1&c#top", "http://shop.test/Pumps/Hand?c=&k=v"),
        ("https://shop.test:443", "https://shop.test/"),
        ("https://shop.test:8443/?y=2&x=3&y=1", "https://shop.test:8443/?x=3&y=1&y=2"),
        ("//shop.test/a", None),
        ("  ", None),
        ("pumps and filters", None),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, T.canonical_url(F.lit(url))) == want


def test_public_url(spark):
    assert one(spark, T.public_url(F.lit(" "), F.lit(":https://shop.test/one/"))) == "https://shop.test/one"


def test_titles(spark):
    assert one(spark, T.title_case(F.lit("UNO PUMPS FOR DRY FIELDS"))) == "UNO Pumps FOR DRY Fields"
    assert one(spark, T.all_caps(F.lit("RIVER FILTER WORKS 9"))) and not one(spark, T.all_caps(F.lit("River filter WORKS")))
    assert one(spark, T.display_title(F.lit("## A title"))) == "A title"


@pytest.mark.parametrize("name,want", [("nonprofit", True), ("Not applicable", True), ("Sole proprietorship (x)", True), ("River Works plc", False), (None, False)])
def test_legal_form(spark, name, want):
    assert one(spark, T.legal_form(F.lit(name).cast("string"))) is want


def test_organisation_names(spark):
    fault = lambda n, s=None: one(spark, T.org_name_fault(F.lit(n), None if s is None else F.lit(s)))
    assert fault("They sell pumps to farms.") == "sentence" and fault("River  list", "river List") == "source_name"
    assert fault("River Works plc") is None and fault(" ") is None and fault("x") == "short"


def test_organisation_names_beside_marked_letters(spark):
    fault = lambda n: one(spark, T.org_name_fault(F.lit(n)))
    assert fault("Myé own pumps") == "pronoun_start" and fault("Pumps that éis a good name") == "verb"
    assert fault("Mye own pumps") is None and fault("All of the pumps!\n") is None and fault("All of the pumps!") == "sentence"


def test_words_of_other_languages_end_at_marked_letters(spark):
    foreign = lambda t: one(spark, T.needs_translation(F.lit("en"), F.lit(t)))
    assert foreign("éden éder édie one two three four") and foreign("iſt IST Daſs one two three four")
    assert not foreign("xden xder xdie one two three four") and not foreign("den der one two three four five")


def test_truncation_and_text(spark):
    assert one(spark, T.truncate_words(F.lit("one two three four"), 12)) == "one two…"
    assert one(spark, T.truncate_words(F.lit("a b"), 12)) == "a b"
    assert one(spark, T.html_to_text(F.lit("<p>a&amp;b</p><script>x</script> c"))) == "a&b c"
    a, b, c = (one(spark, T.content_hash(F.lit("Title"), F.lit(x).cast("string"), F.lit(y))) for x, y in ((None, "body"), ("", "body"), (None, "other")))
    assert a == b != c


def test_quality_reasons(spark):
    r = one(spark, T.quality_reasons(F.lit("HOME"), F.lit("x"), F.lit("x"), person=F.lit("J"), organisation=F.lit("b-corp"), cohort=F.lit(True)))
    assert r == ["short_description", "blocklist_title", "suspicious_person_name", "legal_form_org_name", "listing_only_thin", "cohort_boilerplate_title"]


def test_taxonomy(spark):
    text = F.lit("A photovoltaic pump against spoilage, for livestock")
    assert one(spark, X.tags(text, X.SECTORS)) == ["agriculture"] and one(spark, X.tags(text, X.PROBLEMS)) == ["food-loss"] and one(spark, X.tags(text, X.TECHNOLOGIES)) == ["solar"]
    assert one(spark, X.region_continent(F.lit("Latin lands • Mills"))) == "Americas" and one(spark, X.region_sector(F.lit("Latin lands • Mills"))) == "Mills"
    assert one(spark, X.stage_from_trl(F.lit("TRL 7"))) == "PILOT" and one(spark, X.stage_from_trl(F.lit("none"))) == "UNKNOWN"


def test_fusion_and_caps(spark):
    lists = {n: spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id string, rank int") for n, ids in (("full_text", "ab"), ("semantic", "bc"))}
    got = ranking.fuse(lists, {}).orderBy(F.desc("score"), "id").collect()
    assert [r.id for r in got] == ["b", "a", "c"] and got[0].lists == ["full_text", "semantic"]
    hits = spark.createDataFrame([(i, s) for i, s in enumerate(["solar"] * 4 + ["x", "y", None, ""])], "id int, source string")
    capped = ranking.cap_per_key(hits, "source", ranking.source_cap(10), [F.col("id")], 4).collect()
    assert [r.id for r in capped] == [0, 1, 2, 4]
    assert ranking.bucket_cap(10) == 2 and ranking.source_cap(4) == 2


def test_query_grammar(spark):
    has = lambda text, q: one(spark, lexical.matches(lexical.terms(F.lit(text)), lexical.parse_query(q)))
    assert has("solar water pump", '"solar water" -wind') and not has("solar pump water", '"solar water"')
    assert has("wind", "solar or wind") and not has("solar wind", "solar -wind") and not has("x", '"')
    assert one(spark, lexical.or_count(lexical.terms(F.lit("off grid solar")), lexical.or_words("Off-grid solar solar wind"))) == 3


def test_upsert_is_idempotent(spark):
    cur = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2")], "id int, title string, h string")
    new = spark.createDataFrame([(2, " ", "h9"), (3, "c", "h3")], "id int, title string, h string")
    first = merge.upsert(cur, new, "id", "h", ["title"])
    assert {(r.id, r.title, r.outcome) for r in first.collect()} == {(1, "a", "absent"), (2, "b", "updated"), (3, "c", "new")}
    again = merge.upsert(first.drop("outcome"), new, "id", "h", ["title"])
    assert {r.outcome for r in again.where("id > 1").collect()} == {"unchanged"}


def test_breaker(spark):
    rows = [("a", i, True) for i in range(25)] + [("b", i, i != 24) for i in range(26)] + [("c", i, i % 3 != 0) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, n int, bad boolean")
    got = {r.k: (r.tripped_at, r.reason) for r in runs.breaker(df, "k", [F.col("n")], F.col("bad")).collect()}
    assert got == {"a": (25, "consecutive"), "c": (50, "rate")}


def test_nearest_ignores_other_dimensions(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, None)], "id int, embedding array<double>")
    assert [r.id for r in vectors.nearest(df, [1.0, 0.1], 5).collect()] == [1, 2]


def test_pages(spark):
    html = '<html><head><title>t</title><meta property="og:title" content="og"></head><body><h1>Head</h1><a href="/x?q=1#f">x</a><a href="//other.org/y">y</a><script>no</script> text</body></html>'
    df = spark.createDataFrame([(1, "https://a.org/p", html), (2, None, None)], "page_id int, url string, html string")
    assert [tuple(r) for r in pages.page_links(df).collect()] == [(1, "https://a.org/x")]
    details = {r.page_id: r for r in pages.page_details(df).collect()}
    assert details[1].title == "Head" and "no" not in details[1].body.split() and details[2].junk == "no_title"
    xml = "<urlset><url><loc> https://a.org/1 </loc></url><url><loc>https://a.org/2</loc></url></urlset>"
    assert one(spark, pages.sitemap_locations(F.lit(xml))) == ["https://a.org/1", "https://a.org/2"]
    rss = "<rss><item><title><![CDATA[T]]></title><link>https://a.org/1</link></item></rss>"
    assert [tuple(x) for x in one(spark, pages.feed_items(F.lit(rss)))] == [("T", "https://a.org/1")]
    assert [tuple(x) for x in one(spark, pages.json_records(F.lit('{"items":[{"id":1,"t":"a"}]}'), "struct<id:int,t:string>"))] == [(1, "a")]
    assert one(spark, pages.json_records(F.lit("nonsense"), "struct<id:int>")) == []


def test_walk(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "from_url string, url string")
    start = spark.createDataFrame([("a",)], "url string")
    assert {(r.url, r.depth) for r in records.walk(start, links, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert records.walk(start, links, 50).count() == 4 and records.walk(start.limit(0), links, 3).count() == 0


def test_robots(spark):
    text = "User-agent: *\nDisallow: /private\nAllow: /private/open\nUser-agent: bad\nDisallow: /"
    rules = records.robots_rules(spark.createDataFrame([("h", text), ("none", "")], "host string, rules string"))
    asked = [("good", "h", "/private/open/x", True), ("good", "h", "/private/x", False), ("bad bot", "h", "/a", False), ("x", "none", "/", True), ("x", "unknown", "/", True)]
    requests = spark.createDataFrame([(i, h, a, p) for i, (a, h, p, _) in enumerate(asked)], "id int, host string, agent string, path string")
    assert {r.id: r.allowed for r in records.robots_decisions(requests, rules).collect()} == {i: ok for i, (*_, ok) in enumerate(asked)}


def test_names_without_marks(spark):
    assert one(spark, T.ascii_name(F.lit("  Çà et là, Ŵœuvre 7 – ﬁne "))) == "ca et la w uvre 7 fine"
    assert one(spark, T.near_key(F.lit("Pompe à énergie"), F.lit("Électro"), F.lit(" fr "))) == "pompe a energie|electro|FR"


def test_near_pairs_are_all_pairs_below_the_bound(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(5, 6))
    v = centres[rng.integers(0, 5, 240)] + rng.normal(size=(240, 6)) * 0.25
    v[50:60], v[77] = v[3], 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0])]
    df = spark.createDataFrame(rows, "id int, embedding array<double>")
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    d = 1 - u @ u.T
    for bound in (0.02, 0.2):
        want = {(i, j) for i in range(240) for j in range(i + 1, 240) if 77 not in (i, j) and d[i, j] < bound}
        for pivots in (1, 7):
            got = vectors.near_pairs(df, bound, pivots=pivots).collect()
            assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    assert vectors.near_pairs(df.limit(0), 0.1).count() == 0


def test_near_pairs_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 50)
    monkeypatch.setattr(vectors, "EXACT_PAIRS", 7)
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(4, 5))[rng.integers(0, 4, 330)] + rng.normal(size=(330, 5)) * 0.2).astype(np.float32)
    v[100:140] = v[0]
    rows = [(i % 320, x.tolist()) for i, x in enumerate(v)] + [(900, [float("nan")] * 5), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("inf")] * 5)]
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    d = 1 - u @ u.T
    want = sorted((min(i % 320, j % 320), max(i % 320, j % 320)) for i in range(330) for j in range(i + 1, 330) if i % 320 != j % 320 and d[i, j] < 0.05)
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"id int, embedding array<{kind}>").repartition(3)
        got = vectors.near_pairs(df, 0.05, pivots=9)
        assert sorted((r.a, r.b) for r in got.collect()) == want
        # a row is stored once, whatever cells it may have to visit
        assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1 and "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_pages_of_a_search_follow_each_other(spark, sf):
    from tessera.plans.search import browse, search

    whole = [r.id for r in search(spark, sf, "thin thing", limit=8).orderBy("rank").collect()]
    parts = [r.id for at in (0, 4) for r in search(spark, sf, "thin thing", limit=4, offset=at).orderBy("rank").collect()]
    assert len(whole) == 8 and parts[:4] == whole[:4] and len(set(parts)) == 8
    assert len({r.source for r in browse(spark, sf, limit=10, diverse=True).collect()}) == browse(spark, sf, limit=10, diverse=True).count()


def test_registry_and_reports(spark, tmp_path):
    good = [{"id": "a", "name": "A", "url": "https://a.org"}]
    assert pages.load_registry(spark, good).count() == 1
    for bad in (good * 2, [{"id": "b", "name": "B", "url": "ftp://b"}], [{"id": "c"}]):
        with pytest.raises(ValueError):
            pages.load_registry(spark, bad)
    df = spark.createDataFrame([(1, ["a", "b"])], "id int, reasons array<string>")
    pages.write_report(df, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).first().reasons == "a|b"
