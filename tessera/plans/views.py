"""Detail views, facet lists, candidate lists and source browses over the catalogue."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tessera.functions import text as T
from tessera.operators import filters as flt, ranking
from tessera.plans.registry import query
from tessera.plans.search import filtered
from tessera.sources.tables import GRANTS_SQL, LOCATIONS_SQL, RESOURCES_SQL, RUNS_SQL, TOPICS_SQL, locations, resources, runs, table, topics

R = f"WITH {RESOURCES_SQL}"


@query(f"{R}, {TOPICS_SQL}, {GRANTS_SQL} SELECT id FROM res WHERE active AND id IN (SELECT id FROM topics WHERE slug IN ('topic-1', 'topic-6')) AND id NOT IN (SELECT id FROM grants)")
def facet_taxonomy(spark, sf_dir):
    """Items of any of some topics; grant records are left out unless they are asked for."""
    return filtered(spark, sf_dir, flt.SearchFilters(topics=["topic-1", "topic-6"])).select("id")


@query(f"{R} SELECT id FROM res WHERE active")
def facet_with_grants(spark, sf_dir):
    return filtered(spark, sf_dir, flt.SearchFilters(grants=True)).select("id")


@query(f"{R}, {LOCATIONS_SQL}, {GRANTS_SQL} SELECT id FROM res WHERE active AND id NOT IN (SELECT id FROM grants) AND nation_key IN (SELECT nation_key FROM loc WHERE upper(continent) IN ('AFRICA', 'EUROPE'))")
def facet_continent_slug(spark, sf_dir):
    """Continents by slug; an unknown slug adds none."""
    return filtered(spark, sf_dir, flt.SearchFilters(continent_slugs=["africa", " Europe ", "atlantis"])).select("id")


_DETAIL_NOTES = "n AS (SELECT conv_id AS id, to_json(list(struct_pack(turn := turn, role := role) ORDER BY turn))::VARCHAR AS notes FROM conversations GROUP BY 1)"


@query(f"""{R}, {LOCATIONS_SQL}, {TOPICS_SQL}, {_DETAIL_NOTES}, t AS (SELECT id, list_sort(list(slug)) AS topics FROM topics GROUP BY 1)
SELECT res.id, title, summary, md5(body) AS body, language, source, review_status, active, resource_type, maturity, country, continent, s_name AS organisation, p_name AS technology,
  array_to_string(topics, ',') AS topics, coalesce(notes, '[]') AS notes, url AS url, CASE WHEN vec_id IS NULL THEN 'unavailable' ELSE 'available' END AS vector, coalesce(url, 'https://catalogue.example/' || res.id) AS link, length(body) AS size
FROM res LEFT JOIN loc USING (nation_key) LEFT JOIN supplier ON s_suppkey = org_key LEFT JOIN part ON p_partkey = tech_key LEFT JOIN t ON t.id = res.id LEFT JOIN n ON n.id = res.id LEFT JOIN pages ON page_id = res.id LEFT JOIN embeddings ON vec_id = res.id""")
def resource_detail(spark, sf_dir):
    """Items with all that is known of them in twenty fields: dimensions join broadcast, nested lists are made before the join."""
    notes = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("n"))
    tagged = topics(spark, sf_dir).groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("slug")), ",").alias("topics"))
    orgs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("org_key"), F.col("s_name").alias("organisation"))
    kinds = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tech_key"), F.col("p_name").alias("technology"))
    pages, has = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("available").alias("vector"))
    rows = resources(spark, sf_dir).join(F.broadcast(locations(spark, sf_dir)), "nation_key", "left")
    for other, on in ((orgs, "org_key"), (kinds, "tech_key"), (tagged, "id"), (notes, "id"), (pages, "id"), (has, "id")):
        rows = rows.join(other, on, "left")
    return rows.select(
        "id", "title", "summary", F.md5(F.col("body").cast("binary")).alias("body"), "language", "source", "review_status", "active", "resource_type", "maturity", "country", "continent", "organisation", "technology", "topics",
        F.coalesce(F.to_json("n"), F.lit("[]")).alias("notes"), "url", F.coalesce("vector", F.lit("unavailable")).alias("vector"),
        F.coalesce("url", F.concat(F.lit("https://catalogue.example/"), F.col("id").cast("string"))).alias("link"), F.length("body").cast("long").alias("size"),
    )


@query("""SELECT c_custkey AS id, c_name AS name, n_name AS country, coalesce(k, 0) AS items, coalesce(j, '[]') AS latest FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (
  SELECT o_custkey, count(*) AS k, to_json(list(struct_pack(id := o_orderkey, status := o_orderstatus) ORDER BY o_orderdate DESC, o_orderkey)[1:5])::VARCHAR AS j FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def person_detail(spark, sf_dir):
    """People with their five latest items, nested as JSON."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w))
    nested = o.groupBy("o_custkey").agg(F.count("*").alias("items"), F.sort_array(F.collect_list(F.when(F.col("n") <= 5, F.struct("n", F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))))).alias("x"))
    nested = nested.select("o_custkey", "items", F.to_json(F.transform("x", lambda r: F.struct(r["id"].alias("id"), r["status"].alias("status")))).alias("latest"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    out = c.join(nested, F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("country"), F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("latest", F.lit("[]")).alias("latest"))


@query(f"""{R}, {LOCATIONS_SQL}, {TOPICS_SQL}, a AS (SELECT * FROM res WHERE active)
SELECT 'topic' AS facet, slug AS value, count(*) AS n FROM topics JOIN a USING (id) GROUP BY slug UNION ALL SELECT 'continent', continent, count(*) FROM a JOIN loc USING (nation_key) GROUP BY 2
UNION ALL SELECT 'type', resource_type, count(*) FROM a GROUP BY 2 UNION ALL SELECT 'stage', maturity, count(*) FROM a GROUP BY 2""")
def category_facets(spark, sf_dir):
    """Counts of every facet value, over one narrow scan of the items."""
    a = resources(spark, sf_dir).where("active").select("id", "nation_key", "resource_type", "maturity")
    own = a.join(F.broadcast(locations(spark, sf_dir)), "nation_key", "left")
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(c).alias("value")) for f, c in (("continent", "continent"), ("type", "resource_type"), ("stage", "maturity"))])
    flat = own.select(F.inline(pairs)).where("value is not null")
    topic = topics(spark, sf_dir).join(a, "id", "left_semi").select(F.lit("topic").alias("facet"), F.col("slug").alias("value"))
    return flat.unionByName(topic).groupBy("facet", "value").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, c_name, last FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey
WHERE (c_name ILIKE '%2%' OR c_mktsegment ILIKE '%auto%') AND NOT regexp_matches(c_name, '(?i)^[a-z](\\s+[a-z]){0,2}$') ORDER BY last DESC NULLS LAST, c_name LIMIT 25""")
def people_by_activity(spark, sf_dir):
    """People by name or field, those with the latest items first; names that are none stay out."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    c = table(spark, sf_dir, "customer").where((F.col("c_name").ilike("%2%") | F.col("c_mktsegment").ilike("%auto%")) & ~flt.junk_person(F.col("c_name")))
    return c.join(last, F.col("o_custkey") == F.col("c_custkey"), "left").orderBy(F.desc_nulls_last("last"), "c_name").limit(25).select("c_custkey", "c_name", "last")


@query(f"{R} SELECT id, source FROM res WHERE review_status = 'NEEDS_REVIEW' AND source = 'src2' AND (length(trim(title)) < 4 OR length(trim(body)) < 4000) ORDER BY id DESC LIMIT 30")
def review_queue(spark, sf_dir):
    """Items in review of one source with one of some reasons, a page of them."""
    rows = resources(spark, sf_dir).where("review_status = 'NEEDS_REVIEW' AND source = 'src2'")
    reasons = F.array_compact(F.array(F.when(F.length(F.trim("title")) < 4, "short_title"), F.when(F.length(F.trim("body")) < 4000, "short_body")))
    return rows.where(F.arrays_overlap(reasons, F.array(F.lit("short_title"), F.lit("short_body")))).orderBy(F.desc("id")).limit(30).select("id", "source")


@query("SELECT page_id FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 4 = 1 THEN ' ' WHEN page_id % 4 = 2 THEN 'data:image/png' ELSE url END AS image FROM pages) WHERE image IS NULL OR trim(image) = '' OR starts_with(image, 'data:')")
def missing_images(spark, sf_dir):
    k = F.col("page_id") % 4
    image = F.when(k == 0, None).when(k == 1, " ").when(k == 2, "data:image/png").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").where(flt.missing_image(image)).select("page_id")


@query(f"{R} SELECT id FROM res WHERE active AND resource_type <> 'ARTICLE' AND (nation_key = 3 OR maturity = 'IDEA' OR (id NOT IN (SELECT conv_id FROM conversations) AND id NOT IN (SELECT vec_id FROM embeddings))) ORDER BY id LIMIT 100")
def enrichment_candidates(spark, sf_dir):
    """Items that lack a country or stage, or were never tried and have no organisation."""
    rows = resources(spark, sf_dir).where("active and resource_type <> 'ARTICLE'").select("id", "nation_key", "maturity")
    rows = flt.existence_flag(rows, table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")), "id", "tried")
    rows = flt.existence_flag(rows, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), "id", "owned")
    return rows.where((F.col("nation_key") == 3) | (F.col("maturity") == "IDEA") | (~F.col("tried") & ~F.col("owned"))).orderBy("id").limit(100).select("id")


@query(f"""{R} SELECT id, CASE source WHEN 'src1' THEN thin OR caps WHEN 'src2' THEN thin ELSE false END AS dropped FROM (SELECT id, source, length(trim(summary)) < 30 AS thin, length(trim(title)) > 60 AS caps FROM res)""")
def gate_drops(spark, sf_dir):
    """One source drops whatever is flagged, another only thin items."""
    reasons = F.array_compact(F.array(F.when(F.length(F.trim("summary")) < 30, "short_description"), F.when(F.length(F.trim("title")) > 60, "long_title")))
    return resources(spark, sf_dir).select("id", flt.dropped_at_gate(F.col("source"), reasons, {"src2": ["short_description"]}, ["src1"]).alias("dropped"))


_KINDS = ["an innovative product", "the grant agreement of an innovative startup", "a plain text", "", "work programme and project management", "market entry"]
_VETO = ", ".join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN 'admin_pattern:{p}' END" for p in flt.ADMIN_WORDS)


@query(f"""{R}, k AS (SELECT id, CASE WHEN id % 13 = 0 THEN ' ' ELSE left(body, 500) || ' ' || {_KINDS}[id % 6 + 1] || ' ' || substr(body, 501) END AS t FROM res),
v AS (SELECT *, list_filter([{_VETO}], lambda x: x IS NOT NULL) AS admin FROM k)
SELECT id, CASE WHEN trim(t) = '' THEN 'empty_text' WHEN len(admin) > 0 THEN array_to_string(admin, '|') WHEN regexp_matches(t, '{T.any_of(flt.INNOVATION_WORDS)}') THEN '' ELSE 'no_innovation_signal' END AS faults FROM v""")
def innovation_relevance(spark, sf_dir):
    """Why whole texts, into which telling words are put, are no innovations."""
    mark = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("id") % 6 + 1).cast("int"))
    text = F.when(F.col("id") % 13 == 0, " ").otherwise(F.concat(F.left("body", F.lit(500)), F.lit(" "), mark, F.lit(" "), F.expr("substring(body, 501)")))
    rows = resources(spark, sf_dir).select("id", text.alias("t"))
    return rows.select("id", F.array_join(flt.innovation_faults(F.col("t")), "|").alias("faults"))


@query(f"{R} SELECT source, count(*) AS n, CASE WHEN count(*) > 60 THEN 'large' ELSE 'small' END AS size FROM res WHERE active GROUP BY source ORDER BY (count(*) > 60) DESC, source LIMIT 12")
def sources_by_status(spark, sf_dir):
    """Sources in the order of a status, then by name."""
    n = resources(spark, sf_dir).where("active").groupBy("source").agg(F.count("*").alias("n"))
    return n.withColumn("size", F.when(F.col("n") > 60, "large").otherwise("small")).orderBy(F.desc(F.col("n") > 60), "source").limit(12)


#: Scopes in the order of a whole run; a source of none of them runs with the grants.
RUN_ORDER, SCOPES = ["global", "africa", "asia", "grants"], ["africa", "asia", "global", "grants", "unmapped"]


@query(f"""{R} SELECT row_number() OVER (ORDER BY list_position({RUN_ORDER}, CASE scope WHEN 'unmapped' THEN 'grants' ELSE scope END), source) AS place, source
FROM (SELECT source, {SCOPES}[CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 5 + 1] AS scope FROM (SELECT DISTINCT source FROM res WHERE active AND source IS NOT NULL))""")
def scope_order(spark, sf_dir):
    """Sources in the order of their scopes, then by name."""
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    sources = resources(spark, sf_dir).where("active and source is not null").select("source").distinct()
    scope = F.element_at(F.array(*map(F.lit, SCOPES)), number % 5 + 1)
    rank = F.array_position(F.array(*map(F.lit, RUN_ORDER)), F.when(scope == "unmapped", "grants").otherwise(scope))
    # a registry's sources are few, so one task numbers them
    return sources.select(F.row_number().over(Window.orderBy(rank, "source")).alias("place"), "source")


@query("""SELECT s_suppkey AS id, s_name AS name, n_name AS country, coalesce(k, 0) AS items, coalesce(j, '[]') AS latest FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN (
  SELECT l_suppkey, count(DISTINCT l_partkey) AS k, to_json(list_sort(list(DISTINCT p_name) FILTER (WHERE p_size > 25))[1:5])::VARCHAR AS j FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) ON l_suppkey = s_suppkey""")
def organisation_detail(spark, sf_dir):
    """Organisations with what they make: how many items, and the first titles of those that are shown."""
    links = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey")).distinct()
    rows = links.join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    titles = rows.where("p_size > 25").select("l_suppkey", "p_name").distinct().withColumn("n", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("p_name"))).where("n <= 5")
    nested = titles.groupBy("l_suppkey").agg(F.to_json(F.sort_array(F.collect_list("p_name"))).alias("latest"))
    counts = rows.groupBy("l_suppkey").agg(F.count("*").alias("items")).join(nested, "l_suppkey", "left")
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))
    out = s.join(counts, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return out.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("country"), F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("latest", F.lit("[]")).alias("latest"))


@query(f"WITH {RUNS_SQL} SELECT source_id, run_id FROM runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY CASE WHEN kind <> 'error' AND run_id % 3 > 0 THEN started_at END DESC NULLS LAST, run_id) = 1")
def latest_nulls_last(spark, sf_dir):
    """The latest row of each source by a time that some rows lack."""
    rows = runs(spark, sf_dir).withColumn("seen", F.when((F.col("kind") != "error") & (F.col("run_id") % 3 > 0), F.col("started_at")))
    return ranking.first_per_key(rows, ["source_id"], [F.desc_nulls_last("seen"), F.col("run_id")]).select("source_id", "run_id")


@query(f"{R} SELECT id FROM res WHERE active AND id NOT IN (1, 2, 3) ORDER BY md5('7:' || id), id LIMIT 1")
def random_item(spark, sf_dir):
    return ranking.random_pick(resources(spark, sf_dir).where("active"), "id", 7, [1, 2, 3]).select("id")


@query("""WITH u AS (SELECT s_suppkey AS k, 0 AS part, s_suppkey AS nth FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 1, -s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)
SELECT k, row_number() OVER (ORDER BY part, nth, k) AS place FROM (SELECT k, part, nth FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY part, nth) = 1)""")
def ordered_union(spark, sf_dir):
    """Two ordered lists one after another, each value once."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return ranking.distinct_in_order([s.where("k % 3 = 0").withColumn("place", F.col("k")), s.where("k % 2 = 0").withColumn("place", -F.col("k"))], "k")


@query("SELECT key, arg_min(origin, rank) AS origin FROM (SELECT n_nationkey AS key, 'registry' AS origin, 0 AS rank FROM nation WHERE n_nationkey < 15 UNION ALL SELECT n_nationkey, 'promoted', 1 FROM nation WHERE n_nationkey >= 10) GROUP BY key")
def registry_merge(spark, sf_dir):
    """Registered sources and promoted ones; where both have an id the registered one stands."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"))
    both = n.where("key < 15").select("key", F.lit("registry").alias("origin"), F.lit(0).alias("rank")).unionByName(n.where("key >= 10").select("key", F.lit("promoted").alias("origin"), F.lit(1).alias("rank")))
    return both.groupBy("key").agg(F.min(F.struct("rank", "origin"))["origin"].alias("origin"))


@query("SELECT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def resume_pending(spark, sf_dir):
    """Addresses that are not stored yet."""
    p = table(spark, sf_dir, "pages")
    return p.select("url").join(p.where("page_id % 3 = 0").select("url"), "url", "left_anti")


@query("SELECT a.s_suppkey AS id, b.c_custkey AS donor FROM supplier a JOIN (SELECT max(c_custkey) AS c_custkey, regexp_extract(c_name, '0*(\\d+)$', 1) AS k FROM customer GROUP BY 2) b ON regexp_extract(a.s_name, '0*(\\d+)$', 1) = b.k")
def normalised_name_join(spark, sf_dir):
    """A join on a key computed from names on both sides, the donor side cut to its latest row first."""
    key = lambda c: F.regexp_extract(F.lower(c), r"0*(\d+)$", 1)
    donors = table(spark, sf_dir, "customer").groupBy(key("c_name").alias("k")).agg(F.max("c_custkey").alias("donor"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), key("s_name").alias("k")).join(donors, "k").select("id", "donor")


@query("""SELECT p.page_id, coalesce(u.n, e.n) AS state FROM pages p LEFT JOIN (SELECT url, max(page_id) AS n FROM pages WHERE page_id % 2 = 0 GROUP BY 1) u ON u.url = p.url
LEFT JOIN (SELECT page_id + 1 AS k, page_id * 10 AS n FROM pages) e ON e.k = p.page_id""")
def listing_state(spark, sf_dir):
    """Stored state by address, else by external id: two joins and a coalesce."""
    p = table(spark, sf_dir, "pages")
    by_url = p.where("page_id % 2 = 0").groupBy("url").agg(F.max("page_id").alias("_u"))
    by_id = p.select((F.col("page_id") + 1).alias("page_id"), (F.col("page_id") * 10).alias("_e"))
    return p.join(by_url, "url", "left").join(by_id, "page_id", "left").select("page_id", F.coalesce("_u", "_e").alias("state"))


@query(f"WITH {RUNS_SQL} SELECT source_id, run_id, k FROM runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY (kind = 'purchase') DESC, k DESC NULLS LAST, run_id) = 1")
def latest_with_priority(spark, sf_dir):
    """The latest row of each source, those of one kind before all others, unknown places last."""
    return ranking.first_per_key(runs(spark, sf_dir), ["source_id"], [F.desc(F.col("kind") == "purchase"), F.desc_nulls_last("k"), F.col("run_id")]).select("source_id", "run_id", "k")


@query("SELECT host, arg_max(url, page_id) FILTER (WHERE image) AS image FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, page_id % 3 <> 0 AS image FROM pages) GROUP BY host")
def latest_image(spark, sf_dir):
    """The latest image of each group; rows without one are passed over before the choice."""
    p = table(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1))
    return p.groupBy("host").agg(F.max(F.when(F.col("page_id") % 3 != 0, F.struct("page_id", "url")))["url"].alias("image"))


@query("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders ORDER BY 1, 2 LIMIT 8")
def distinct_limit(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus").distinct().orderBy("o_orderpriority", "o_orderstatus").limit(8)


@query(f"{R} SELECT source, n FROM (SELECT source, count(t.conv_id) + count(*) FILTER (WHERE t.conv_id IS NULL) AS n FROM res LEFT JOIN conversations t ON t.conv_id = res.id WHERE review_status = 'NEEDS_REVIEW' GROUP BY 1) ORDER BY n DESC, source LIMIT 12")
def review_by_source(spark, sf_dir):
    """The twelve sources with most to review; an item counts once for each of its links."""
    links = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"))
    rows = resources(spark, sf_dir).where("review_status = 'NEEDS_REVIEW'").select("id", "source").join(links, "id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(12)


@query("SELECT o_custkey, count(*) AS n, to_json(list(struct_pack(id := o_orderkey, status := o_orderstatus) ORDER BY o_orderkey))::VARCHAR AS nested FROM orders GROUP BY 1")
def json_nested(spark, sf_dir):
    """Nested rows of each key as JSON."""
    x = F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.to_json(x).alias("nested"))


@query("SELECT user_id % 20 AS source_id, sum(k) AS attempted, sum(k) FILTER (WHERE event_type = 'error') AS failed, sum(k) - coalesce(sum(k) FILTER (WHERE event_type = 'error'), 0) AS kept, round(100.0 * coalesce(sum(k) FILTER (WHERE event_type = 'error'), 0) / nullif(sum(k), 0), 1) AS percent FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def loss_by_counters(spark, sf_dir):
    """What each source loses, from counters in JSON."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("source_id"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    failed, total = F.sum(F.when(F.col("event_type") == "error", F.col("k"))), F.sum("k")
    return e.groupBy("source_id").agg(total.alias("attempted"), failed.alias("failed"), (total - F.coalesce(failed, F.lit(0))).alias("kept"), F.round(100.0 * F.coalesce(failed, F.lit(0)) / F.nullif(total, F.lit(0)), 1).alias("percent"))


@query(f"""WITH {RUNS_SQL}, m AS (SELECT max(started_at) AS now FROM runs)
SELECT source_id, round(avg(items), 6) AS pace, ceil(100000 / least(1000, avg(items))) AS eta FROM (SELECT runs.* FROM runs, m WHERE items > 0 AND started_at >= now - INTERVAL 14 DAY QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id) <= 7) GROUP BY 1""")
def backfill_pace(spark, sf_dir):
    """The mean of the last seven positive runs of fourteen days, and how many more would clear a backlog."""
    r = runs(spark, sf_dir)
    now = r.agg(F.max("started_at")).first()[0]
    recent = r.where((F.col("items") > 0) & (F.col("started_at") >= F.lit(now) - F.expr("INTERVAL 14 DAYS")))
    w = Window.partitionBy("source_id").orderBy(F.desc("started_at"), "run_id")
    pace = recent.withColumn("n", F.row_number().over(w)).where("n <= 7").groupBy("source_id").agg(F.avg("items").alias("pace"))
    return pace.select("source_id", F.round("pace", 6).alias("pace"), F.ceil(100000 / F.least(F.lit(1000.0), F.col("pace"))).alias("eta"))


@query(f"""WITH {RUNS_SQL}, m AS (SELECT max(started_at) AS now FROM runs), s AS (SELECT s_suppkey AS source_id FROM supplier)
SELECT s.source_id, count(run_id) AS runs, count(run_id) FILTER (WHERE status = 'FAILED') AS failed, coalesce(sum(items), 0) AS items FROM s LEFT JOIN (SELECT runs.* FROM runs, m WHERE started_at >= now - INTERVAL 36 HOUR) r USING (source_id) GROUP BY 1""")
def overnight_report(spark, sf_dir):
    """Runs of the last night by source; sources without any count none."""
    r = runs(spark, sf_dir)
    now = r.agg(F.max("started_at")).first()[0]
    recent = r.where(F.col("started_at") >= F.lit(now) - F.expr("INTERVAL 36 HOURS"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"))
    joined = s.join(recent, "source_id", "left")
    return joined.groupBy("source_id").agg(F.count("run_id").alias("runs"), F.count(F.when(F.col("status") == "FAILED", F.col("run_id"))).alias("failed"), F.coalesce(F.sum("items"), F.lit(0.0)).alias("items"))


@query("SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN o_totalprice > 100000 THEN 'pass:large' WHEN o_orderstatus = 'F' THEN 'fail:closed' ELSE 'fail:small' END AS bucket FROM orders) GROUP BY 1 UNION ALL SELECT split_part(bucket, ':', 1) || ':*', count(*) FROM (SELECT CASE WHEN o_totalprice > 100000 THEN 'pass:large' WHEN o_orderstatus = 'F' THEN 'fail:closed' ELSE 'fail:small' END AS bucket FROM orders) GROUP BY 1")
def dry_run_buckets(spark, sf_dir):
    """Outcomes of a dry run and the sums of their kinds, in one pass."""
    b = F.when(F.col("o_totalprice") > 100000, "pass:large").when(F.col("o_orderstatus") == "F", "fail:closed").otherwise("fail:small")
    n = table(spark, sf_dir, "orders").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))
    return n.unionByName(n.groupBy(F.concat(F.split_part("bucket", F.lit(":"), F.lit(1)), F.lit(":*")).alias("bucket")).agg(F.sum("n").alias("n")))


@query(f"{R}, b AS (SELECT source, count(*) AS n FROM res WHERE review_status = 'NEEDS_REVIEW' GROUP BY 1), a AS (SELECT source, count(*) AS n FROM res WHERE review_status = 'NEEDS_REVIEW' AND length(trim(title)) < 40 GROUP BY 1) SELECT source, b.n AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) - b.n AS change FROM b LEFT JOIN a USING (source) ORDER BY b.n DESC, source LIMIT 10")
def backlog_change(spark, sf_dir):
    """Counts before and after a run, the ten largest sources."""
    rows = resources(spark, sf_dir).where("review_status = 'NEEDS_REVIEW'")
    n = rows.groupBy("source").agg(F.count("*").alias("before"), F.count_if(F.length(F.trim("title")) < 40).alias("after"))
    return n.withColumn("change", F.col("after") - F.col("before")).orderBy(F.desc("before"), "source").limit(10)


@query(f"{R}, f AS (SELECT id, sha256(title || chr(10) || summary) AS h FROM res), c AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'old' ELSE h END AS h FROM f WHERE id % 2 = 0) SELECT f.id, left(f.h, 32) AS fingerprint, coalesce(c.h = f.h, false) AS cached FROM f LEFT JOIN c ON c.id = f.id")
def translation_cache(spark, sf_dir):
    """Items whose translation is stored under the fingerprint of what they say now."""
    f = resources(spark, sf_dir).select("id", F.sha2(F.concat("title", F.lit("\n"), "summary"), 256).alias("h"))
    c = f.where("id % 2 = 0").select("id", F.when(F.col("id") % 5 == 0, "old").otherwise(F.col("h")).alias("_h"))
    return f.join(c, "id", "left").select("id", F.left("h", F.lit(32)).alias("fingerprint"), F.coalesce(F.col("_h") == F.col("h"), F.lit(False)).alias("cached"))


@query("SELECT kind, count(*) AS n, sum(cost) AS cost FROM (SELECT CASE WHEN running > 2000000 THEN 'skipped' WHEN event_type = 'error' THEN 'failed' WHEN k = 0 THEN 'no_data' ELSE 'applied' END AS kind, CASE WHEN running > 2000000 THEN 0 ELSE k END AS cost FROM (SELECT *, sum(k) OVER (ORDER BY event_id) AS running FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))) GROUP BY 1")
def enrichment_accounting(spark, sf_dir):
    """Outcomes of an enrichment run under a cost cap: prefix sums of blocks of ids, then of rows inside a block."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.floor(F.col("event_id") / 1000).alias("block"))
    sums = e.groupBy("block").agg(F.sum("k").alias("s")).withColumn("before", F.sum("s").over(Window.orderBy("block")) - F.col("s")).select("block", "before")
    inside = F.sum("k").over(Window.partitionBy("block").orderBy("event_id"))
    rows = e.join(sums, "block").withColumn("running", F.col("before") + inside)
    over = F.col("running") > 2000000
    kind = F.when(over, "skipped").when(F.col("event_type") == "error", "failed").when(F.col("k") == 0, "no_data").otherwise("applied")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.when(over, 0).otherwise(F.col("k"))).alias("cost"))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 OR NOT regexp_matches(u, '^https?://') THEN 'https://base.example/x/' || page_id ELSE u END AS url FROM (SELECT page_id, CASE WHEN page_id % 3 = 1 THEN replace(url, 'http', 'ftp') WHEN page_id % 5 = 0 THEN ': ' || url ELSE url END AS u FROM pages)")
def url_rewrite(spark, sf_dir):
    """Addresses of one source that are none are made from the external id."""
    k, n = F.col("page_id"), F.col("page_id").cast("string")
    url = F.when(k % 3 == 1, F.replace("url", F.lit("http"), F.lit("ftp"))).when(k % 5 == 0, F.concat(F.lit(": "), "url")).otherwise(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", url.alias("u"))
    return rows.select("page_id", F.when(F.col("u").rlike("^https?://"), F.col("u")).otherwise(F.concat(F.lit("https://base.example/x/"), n)).alias("url"))


@query("SELECT p.page_id, coalesce(c.url, CASE WHEN p.page_id % 2 = 0 THEN p.url END) AS image FROM (SELECT * FROM pages ORDER BY page_id DESC LIMIT 40) p LEFT JOIN (SELECT page_id, 'https://cards.example/' || page_id AS url FROM pages WHERE page_id % 3 = 0) c ON c.page_id = p.page_id")
def card_images(spark, sf_dir):
    """The newest items of a source take the images of its listing's cards."""
    p = table(spark, sf_dir, "pages")
    cards = p.where("page_id % 3 = 0").select("page_id", F.concat(F.lit("https://cards.example/"), F.col("page_id").cast("string")).alias("_card"))
    newest = p.orderBy(F.desc("page_id")).limit(40)
    return newest.join(cards, "page_id", "left").select("page_id", F.coalesce("_card", F.when(F.col("page_id") % 2 == 0, F.col("url"))).alias("image"))


@query(f"{R} SELECT count(*) AS items, count(DISTINCT source) AS sources, count(DISTINCT nation_key) AS places, count(DISTINCT org_key) AS organisations FROM res WHERE active AND nation_key < 10")
def index_spot_check(spark, sf_dir):
    return resources(spark, sf_dir).where("active and nation_key < 10").agg(F.count("*").alias("items"), *[F.countDistinct(c).alias(n) for c, n in (("source", "sources"), ("nation_key", "places"), ("org_key", "organisations"))])


@query("SELECT name, CASE WHEN n IS NULL THEN 'no_items' WHEN n < 15 THEN 'thin' WHEN name LIKE '%1%' THEN 'partial' ELSE 'covered' END AS state FROM (SELECT r_name || '-' || n_nationkey AS name, n FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey)")
def coverage_states(spark, sf_dir):
    """Every registered source with what it has; those without any stay."""
    n = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    r = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    rows = r.select(F.concat("r_name", F.lit("-"), F.col("n_nationkey").cast("string")).alias("name"), "n_nationkey").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("name", F.when(F.col("n").isNull(), "no_items").when(F.col("n") < 15, "thin").when(F.col("name").contains("1"), "partial").otherwise("covered").alias("state"))
