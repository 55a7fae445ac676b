"""Merges written back, SQL functions against their Column rules, and JSON merges."""

import json

from pyspark.sql import functions as F

from tessera.functions import sql, text as T
from tessera.functions.taxonomy import stage_rank
from tessera.sources.pages import page_links
from tessera.sources.stored import StoredTable


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_upsert_touches_its_buckets_alone_and_can_be_repeated(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}", "h") for i in range(500)], "id long, name string, hash string")
    stored = StoredTable.create(rows, str(tmp_path), "id", buckets=16)
    before = files(tmp_path)
    batch = spark.createDataFrame([(3, "three", "h2"), (7, " ", "h2"), (9, "nine", "h"), (1000, "new", "h")], "id long, name string, hash string")
    assert stored.upsert(batch, "hash", ["name"]) == {"new": 1, "updated": 2, "unchanged": 1}
    after, touched = files(tmp_path), {r.b for r in batch.select(F.pmod(F.xxhash64("id"), F.lit(16)).alias("b")).collect()}
    assert {f for f in before if after.get(f) == before[f]} == {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    once = sorted(map(tuple, stored.read().collect()))
    assert len(once) == 501 and {r[0]: r[1] for r in once}[3] == "three" and {r[0]: r[1] for r in once}[7] == "n7" and {r[0]: r[1] for r in once}[9] == "n9"
    again = files(tmp_path)
    assert stored.upsert(batch, "hash", ["name"]) == {"new": 0, "updated": 0, "unchanged": 4}
    assert files(tmp_path) == again and sorted(map(tuple, stored.read().collect())) == once
    assert stored.upsert(batch.limit(0), "hash", ["name"]) == {} and files(tmp_path) == again


def test_functions_say_what_the_columns_say(spark):
    sql.register(spark)
    sql.register(spark)
    values = ["Héllo  World!", "THE WHOLE TITLE", "The Whole", "", " a-b ", "https://www.Example.org:80/x", "ftp://h", "SCALED", "IDEA", "other", None, "ÀÉ 7", "-x-"]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = spark.sql("SELECT x, to_slug(x) AS a, all_caps(x) AS b, url_host(x) AS c, stage_rank(x) AS d, content_digest(x, NULL, x) AS e FROM {df}", df=df)
    want = df.select("x", T.slug(F.col("x")).alias("a"), T.all_caps(F.col("x")).alias("b"), T.website_host(F.col("x")).alias("c"), T.content_hash(F.col("x"), F.lit(None).cast("string"), F.col("x")).alias("e"))
    assert [(r.x, r.a, r.b, r.c, r.e) for r in got.collect()] == [(r.x, r.a, r.b, r.c, r.e) for r in want.collect()]
    known = [r for r in got.where("x in ('SCALED', 'IDEA')").select("d", stage_rank(F.col("x")).alias("w")).collect()]
    assert (known[0].d < known[1].d) == (known[0].w < known[1].w)


def test_links_of_the_table_function_equal_the_reader(spark, sf):
    sql.register(spark)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = spark.sql("SELECT page_id, l.url FROM {pages}, LATERAL extract_links(html, url) AS l WHERE l.own_host", pages=pages)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, page_links(pages).collect()))


def test_json_merges(spark):
    cases = [
        ('{"a": 1, "b": {"x": 1}}', '{"b": {"y": 2}, "c": null}', {"a": 1, "b": {"y": 2}, "c": None}),
        ("[1]", '{"q": "z\\"é"}', {"q": 'z"é'}), (None, None, {}), ("bad", "5", {}), ('{"a": [1, null, {}]}', "{}", {"a": [1, None, {}]}),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r.i: json.loads(r.m) for r in df.select("i", sql.merged(F.col("a"), F.col("b")).alias("m")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}
    placed = [json.loads(r.m) for r in df.orderBy("i").select(sql.put(F.col("a"), ["b", 'k "q"'], F.lit("[true]")).alias("m")).collect()]
    assert placed[0] == {"a": 1, "b": {"x": 1, 'k "q"': [True]}} and placed[2] == {"b": {'k "q"': [True]}} and placed[4] == {"a": [1, None, {}], "b": {'k "q"': [True]}}
