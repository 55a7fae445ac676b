"""Discovery over stored payloads: sitemaps, crawls, feeds, paged JSON, robots rules, titles and images of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.plans.writes import _expected
from tessera.sources import pages as P, records as S
from tessera.sources.tables import table


@query("""WITH RECURSIVE l AS (SELECT s_suppkey AS a, s_suppkey * 2 % 97 AS b FROM supplier UNION SELECT s_suppkey, s_suppkey * 3 % 89 FROM supplier), w AS (SELECT 1 AS n, 0 AS depth UNION SELECT l.b, w.depth + 1 FROM w JOIN l ON l.a = w.n WHERE w.depth < 5)
SELECT 'u' || n AS url, min(depth) AS depth FROM w GROUP BY n""")
def crawl_depths(spark, sf_dir):
    """Addresses reached from one, with the least number of steps."""
    s = table(spark, sf_dir, "supplier")
    u = lambda c: F.concat(F.lit("u"), c.cast("string"))
    links = s.select(u(F.col("s_suppkey")).alias("from_url"), u(F.col("s_suppkey") * 2 % 97).alias("url")).unionByName(s.select(u(F.col("s_suppkey")).alias("from_url"), u(F.col("s_suppkey") * 3 % 89).alias("url")))
    return S.walk(spark.createDataFrame([("u1",)], "url string"), links, 5)


@query("SELECT 'https://h.example/item/' || n_nationkey AS url FROM nation WHERE n_nationkey % 2 = 0")
def sitemap_urls(spark, sf_dir):
    """Pages of a sitemap index: regions list nations' maps, these list items; the include pattern leaves other pages out."""
    n = table(spark, sf_dir, "nation")
    at = lambda p, c: F.concat(F.lit(f"https://h.example/{p}/"), c.cast("string"))
    loc = lambda c: F.concat(F.lit("<url><loc> "), c, F.lit("</loc></url>"))
    kind = F.when(F.col("n_nationkey") % 2 == 0, "item").otherwise("event")
    maps = n.groupBy("n_regionkey").agg(F.concat_ws("", F.collect_list(loc(F.concat(F.lit("https://h.example/"), kind, F.lit("/"), F.col("n_nationkey").cast("string"))))).alias("xml")).select(at("map", F.col("n_regionkey")).alias("url"), "xml")
    index = n.select("n_regionkey").distinct().agg(F.concat_ws("", F.collect_list(loc(at("map", F.col("n_regionkey"))))).alias("xml")).select(F.lit("https://h.example/index").alias("url"), "xml")
    return S.sitemap_pages(maps.unionByName(index), spark.createDataFrame([("https://h.example/index",)], "url string"), include="/item/")


@query("SELECT p_partkey AS key, CASE WHEN p_partkey % 3 <> 0 THEN 'card ' || p_partkey ELSE p_name END AS title FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 <> 0")
def listing_merge(spark, sf_dir):
    """A feed and a card listing; what both have is the card's."""
    p = table(spark, sf_dir, "part")
    feed = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title"))
    cards = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("key"), F.concat(F.lit("card "), F.col("p_partkey").cast("string")).alias("title"))
    return S.merged_listing(feed, cards, "key")


@query("SELECT CAST(floor(doc_id / 20) AS BIGINT) AS feed, trim(split_part(text, '.', 1)) AS title, 'https://f.example/' || doc_id AS link FROM documents")
def feed_entries(spark, sf_dir):
    """Entries of feeds, here of twenty documents each; titles stand plain or in a section of their own."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    title = F.substring_index("text", ".", 1)
    item = F.concat(F.lit("<item>\n<title>"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<![CDATA["), title, F.lit("]]>"))).otherwise(title), F.lit("</title><link> https://f.example/"), k, F.lit("</link></item>"))
    feeds = d.groupBy(F.floor(F.col("doc_id") / 20).alias("feed")).agg(F.concat(F.lit("<rss>"), F.array_join(F.sort_array(F.collect_list(item)), "\n"), F.lit("</rss>")).alias("xml"))
    return feeds.select("feed", F.inline(P.feed_items(F.col("xml"))))


@query("""SELECT DISTINCT n_regionkey AS listing, n_nationkey AS id, n_name AS title FROM (SELECT *, CAST(ceil(r / 2.0) AS INTEGER) AS page FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation)) WHERE page <= 2 AND n_nationkey % 7 <> 0""")
def paged_listings(spark, sf_dir):
    """Listings of two records a page, the third page malformed; records without a title are left out."""
    from pyspark.sql import Window

    n = table(spark, sf_dir, "nation").withColumn("r", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    record = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.when(F.col("n_nationkey") % 7 != 0, F.col("n_name")).otherwise(" ").alias("title"))
    pages = n.groupBy(F.col("n_regionkey").alias("listing"), F.ceil(F.col("r") / 2).cast("int").alias("page")).agg(F.sort_array(F.collect_list(record)).alias("items"))
    payload = F.when(F.col("page") == 3, F.lit('{"items": [')).otherwise(F.to_json(F.struct("items")))
    found = S.paged_records(pages.select("listing", "page", payload.alias("payload")), "struct<id:string,title:string>", 2)
    return found.select("listing", F.col("id").cast("int").alias("id"), "title")


_ROBOTS = """User-agent: *
Disallow: /private
Allow: /private/open
Crawl-delay: 2

User-agent: tessera
User-agent: other # both
Disallow: /*.pdf$
Allow: /
Disallow: /x
"""
_REQUESTS = [("anybot", "/private/a", False), ("anybot", "/private/open/b", True), ("anybot", "/free", True), ("Tessera/1.0", "/private/a", True), ("tessera", "/doc.pdf", False), ("tessera", "/doc.pdf?x", True), ("other", "/x/y", False), ("other", "/", True)]


@query(f"SELECT s_suppkey AS id, {_expected(_REQUESTS, {'allowed': 2}).replace('p_partkey', 's_suppkey')}, CASE WHEN s_suppkey % 8 < 3 THEN 2.0 END AS delay FROM supplier")
def robots_decisions(spark, sf_dir):
    """Whether an agent may fetch a path: rules as rows, joined and aggregated; the SQL holds what the rules say by hand."""
    rules = S.robots_rules(spark.createDataFrame([("h", _ROBOTS)], "host string, rules string"))
    which = (F.col("s_suppkey") % len(_REQUESTS) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.lit(r[i]) for r in _REQUESTS]), which)
    requests = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("h").alias("host"), pick(0).alias("agent"), pick(1).alias("path"))
    return S.robots_decisions(requests, rules).select("id", "allowed", "delay")


# pages as they are; some headings say nothing, some pages name a title or an image in their head
def _text(c: str) -> str:
    """SQL of the text of a piece of HTML, null where there is none."""
    for pattern, to in (("<[^>]+>", " "), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&#0?39;|&apos;", "''"), ("(?i)&quot;", '"'), ("\\s+", " ")):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"nullif(trim({c}), '')"


def _fine(c: str) -> str:
    return f"CASE WHEN NOT regexp_matches(lower({c}), '{S.BOILERPLATE}') THEN {c} END"


@query(f"""WITH h AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN replace(html, '<h1>', '<h1> Read <b>more</b></h1><h1>') ELSE html END AS html FROM pages),
t AS (SELECT page_id, {_text("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS h1, {_text("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title FROM h)
SELECT page_id, coalesce({_fine('h1')}, CASE WHEN page_id % 3 = 0 THEN 'Og ' || page_id END, {_fine('title')}) AS title, CASE WHEN page_id % 6 = 3 THEN 'https://i.example/p' || page_id || '.png' END AS image FROM t""")
def page_titles(spark, sf_dir):
    """Titles and images of pages in their order of precedence; images that decorate are none."""
    p, k, n = table(spark, sf_dir, "pages"), F.col("page_id"), F.col("page_id").cast("string")
    title = F.concat(F.lit('<meta property="og:title" content="Og '), n, F.lit('">'))
    image = F.concat(F.lit('<meta content="https://i.example/'), F.when(k % 2 == 0, "logo").otherwise("p"), n, F.lit('.png" property="og:image">'))
    html = F.when(k % 4 == 0, F.replace("html", F.lit("<h1>"), F.lit("<h1> Read <b>more</b></h1><h1>"))).otherwise(F.col("html"))
    rows = p.select("page_id", F.concat(F.when(k % 3 == 0, F.concat(title, image)).otherwise(""), html).alias("html"))
    return rows.select("page_id", S.page_title(F.col("html")).alias("title"), S.page_image(F.col("html")).alias("image"))


@query("""SELECT conv_id, turn, left(text, 40) AS title, CASE WHEN turn % 4 = 3 THEN 'UNKNOWN' WHEN turn * 3 <= 3 THEN 'IDEA' WHEN turn * 3 <= 6 THEN 'PROTOTYPE' WHEN turn * 3 <= 8 THEN 'PILOT' ELSE 'DEPLOYED' END AS stage, CASE WHEN role = 'user' THEN role END AS country FROM conversations""")
def embedded_states(spark, sf_dir):
    """Items from the JSON state that a page carries in a script; here the turns of conversations are the items."""
    from tessera.functions.taxonomy import stage_from_trl

    c, turn = table(spark, sf_dir, "conversations"), F.col("turn")
    level = F.when(turn % 4 != 3, F.concat(F.lit("trl "), (turn * 3).cast("string"), F.lit(" of 9")))
    item = F.struct(F.left("text", F.lit(40)).alias("short_name"), level.alias("trl"), F.struct(F.when(F.col("role") == "user", F.col("role")).alias("country")).alias("company"))
    html = F.concat(F.lit("<p>a</p><script type='application/json' id='__STATE__'> "), F.to_json(F.struct(item.alias("item"))), F.lit("</script><p>b</p>"))
    rows = c.select("conv_id", "turn", S.embedded_state(html, "__STATE__").alias("state"))
    field = lambda p: F.get_json_object("state", p)
    return rows.select("conv_id", "turn", field("$.item.short_name").alias("title"), stage_from_trl(F.coalesce(field("$.item.trl"), F.lit(""))).alias("stage"), field("$.item.company.country").alias("country"))


@query("SELECT DISTINCT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"(/[^\"#?]*)', 1)) AS href FROM pages) WHERE href NOT IN ('/the', '/and')")
def links_without_skips(spark, sf_dir):
    """Links of pages less a set of known ones."""
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"#?]*)'), F.lit(1))).alias("href")).distinct()
    skip = spark.createDataFrame([("/the",), ("/and",)], "href string")
    return links.join(F.broadcast(skip), "href", "left_anti").select("page_id", "href")


@query("SELECT host, arg_min(name, rank) AS name FROM (SELECT 'h' || s_nationkey || '.example' AS host, s_name AS name, '0' || s_name AS rank FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'h' || s_nationkey || '.example', 'second ' || s_name, '1' || 'second ' || s_name FROM supplier) GROUP BY host")
def hub_directory(spark, sf_dir):
    """Two directories of hubs, one row for each host, the first directory's."""
    s = table(spark, sf_dir, "supplier")
    url = F.concat(F.lit("https://www.h"), F.col("s_nationkey").cast("string"), F.lit(".example/"))
    return S.hub_rows([s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("name"), url.alias("url")), s.select(F.concat(F.lit("second "), "s_name").alias("name"), url.alias("url"))]).select("host", "name")


@query("SELECT status, status IN (408, 425, 429) OR status BETWEEN 500 AND 599 AS again, count(*) AS n FROM (SELECT [200, 404, 408, 429, 500, 503, 301][event_id % 7 + 1] AS status FROM events) GROUP BY ALL")
def retry_classes(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, [200, 404, 408, 429, 500, 503, 301])), (F.col("event_id") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(status.alias("status"))
    return rows.groupBy("status", S.retryable(F.col("status")).alias("again")).agg(F.count("*").alias("n"))
