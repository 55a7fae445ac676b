"""Upserts, merges, repairs, review actions and enrichment as whole-table plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import repair as R, text as T
from tessera.operators import ranking, writes as W
from tessera.plans import rules  # noqa: F401  its SQL is part of some here
from tessera.plans.registry import ORACLE_SQL, query
from tessera.sources.tables import RESOURCES_SQL, resources, table

_RES = f"WITH {RESOURCES_SQL}"

# stored: customers of lower keys; drafts: customers under other keys and addresses
_STORED = """st AS (SELECT c_custkey AS id, 's' || c_nationkey % 3 AS source, 'e' || c_custkey AS external_id, 'http://h/' || c_custkey AS url, c_name AS title, c_mktsegment AS summary,
    CASE WHEN c_custkey % 4 = 0 THEN 'DEPLOYED' ELSE 'UNKNOWN' END AS stage, CASE WHEN c_custkey % 3 = 0 THEN 'Kenya' END AS country, 'NEEDS_REVIEW' AS status, CASE WHEN c_custkey % 5 = 0 THEN 'data:x' ELSE 'http://i/' || c_custkey END AS image,
    CASE WHEN c_custkey % 2 = 0 THEN 'old' END AS published_at, 'old' AS etag, 'en' AS language, repeat('stored words ', 12) AS body FROM customer WHERE c_custkey % 7 <> 0)"""
_DRAFTS = """dr AS (SELECT o_orderkey AS seq, k, 's' || CASE WHEN m = 2 THEN 9 ELSE n % 3 END AS source, CASE WHEN m = 0 THEN 'e' || k ELSE 'x' || k END AS external_id, 'http://h/' || k AS url, c_name AS title,
    CASE WHEN m = 1 AND k % 2 = 0 THEN c_mktsegment ELSE c_mktsegment || ' longer now' END AS summary, CASE WHEN m = 0 THEN 'UNKNOWN' ELSE 'PILOT' END AS stage, CASE WHEN k % 2 = 0 THEN 'Ghana' END AS country,
    CASE WHEN k % 6 = 0 THEN 'SOURCE_LIMITED' ELSE 'AUTO' END AS status, k % 6 = 0 OR k % 2 = 0 AS flagged, CASE WHEN k % 3 = 0 THEN 'data:y' WHEN k % 3 = 1 THEN ' http://j ' END AS image, 'new' AS etag, 'de' AS language,
    CASE WHEN m = 1 AND k % 2 = 0 THEN repeat('stored words ', 12) ELSE repeat('stored words ', 20) END AS body
  FROM (SELECT o_orderkey, o_custkey AS k, o_orderkey % 3 AS m FROM orders) JOIN (SELECT c_custkey, c_nationkey AS n, c_name, c_mktsegment FROM customer) ON k = c_custkey)"""


@query(f"""WITH {_STORED}, {_DRAFTS},
last AS (SELECT * FROM dr QUALIFY row_number() OVER (PARTITION BY source, external_id ORDER BY seq DESC) = 1),
m AS (SELECT l.*, a.id AS a, b.id AS b, c.id AS c FROM last l LEFT JOIN st a ON a.source = l.source AND a.external_id = l.external_id LEFT JOIN st b ON b.source = l.source AND b.url = l.url LEFT JOIN st c ON c.url = l.url),
n AS (SELECT *, coalesce(a, b, c) AS id, CASE WHEN a IS NOT NULL THEN 'external_id' WHEN b IS NOT NULL THEN 'url' WHEN c IS NOT NULL THEN 'other_source' ELSE 'new' END AS matched FROM m),
u AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY coalesce(CAST(id AS VARCHAR), 'new|' || source || '|' || external_id) ORDER BY seq DESC) = 1),
j AS (SELECT u.*, s.summary AS os, s.stage AS og, s.country AS oc, s.image AS oi, s.published_at AS op, s.etag AS oe, s.language AS ol, s.id IS NOT NULL AND trim(s.summary) = trim(u.summary) AND trim(s.body) = trim(u.body) AS same FROM u LEFT JOIN st s ON s.id = u.id)
SELECT id, seq, matched, CASE WHEN matched = 'new' THEN 'new' WHEN matched = 'other_source' THEN 'linked' WHEN same THEN 'unchanged' ELSE 'updated' END AS outcome,
  CASE WHEN same THEN os ELSE summary END AS summary, CASE WHEN same THEN og WHEN matched <> 'new' AND stage = 'UNKNOWN' THEN og ELSE stage END AS stage,
  CASE WHEN same THEN oc ELSE coalesce(country, oc) END AS country, CASE WHEN same THEN 'NEEDS_REVIEW' WHEN matched = 'new' OR status = 'SOURCE_LIMITED' OR NOT flagged THEN status ELSE 'NEEDS_REVIEW' END AS status,
  CASE WHEN matched = 'new' THEN image WHEN image IS NOT NULL AND NOT starts_with(trim(image), 'data:') THEN trim(image) WHEN starts_with(oi, 'data:') THEN NULL ELSE oi END AS image,
  op AS published_at, etag, CASE WHEN matched = 'new' THEN language ELSE ol END AS language FROM j""")
def draft_upsert(spark, sf_dir):
    """Drafts meet stored items by external id, then address, then an item of another source; fields merge by their own rules."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    s = lambda x: F.concat(F.lit("s"), x.cast("string"))
    stored = c.where(k % 7 != 0).select(
        k.alias("id"), s(F.col("c_nationkey") % 3).alias("source"), F.concat(F.lit("e"), k.cast("string")).alias("external_id"), F.concat(F.lit("http://h/"), k.cast("string")).alias("url"),
        F.col("c_name").alias("title"), F.col("c_mktsegment").alias("summary"), F.repeat(F.lit("stored words "), 12).alias("body"),
        F.when(k % 4 == 0, "DEPLOYED").otherwise("UNKNOWN").alias("stage"), F.when(k % 3 == 0, "Kenya").alias("country"), F.lit("NEEDS_REVIEW").alias("status"), F.array(F.lit("x")).alias("reasons"),
        F.when(k % 5 == 0, "data:x").otherwise(F.concat(F.lit("http://i/"), k.cast("string"))).alias("image"), F.when(k % 2 == 0, "old").alias("published_at"), F.lit("old").alias("etag"), F.lit("en").alias("language"),
    )
    m, equal = F.col("o_orderkey") % 3, (F.col("o_orderkey") % 3 == 1) & (k % 2 == 0)
    drafts = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == k).select(
        F.col("o_orderkey").alias("seq"), s(F.when(m == 2, 9).otherwise(F.col("c_nationkey") % 3)).alias("source"), F.concat(F.when(m == 0, "e").otherwise("x"), k.cast("string")).alias("external_id"),
        F.concat(F.lit("http://h/"), k.cast("string")).alias("url"), F.col("c_name").alias("title"), F.when(equal, F.col("c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit(" longer now"))).alias("summary"),
        F.repeat(F.lit("stored words "), F.when(equal, 12).otherwise(20)).alias("body"), F.when(m == 0, "UNKNOWN").otherwise("PILOT").alias("stage"), F.when(k % 2 == 0, "Ghana").alias("country"),
        F.when(k % 6 == 0, "SOURCE_LIMITED").otherwise("AUTO").alias("status"), F.when((k % 6 == 0) | (k % 2 == 0), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("reasons"),
        F.when(k % 3 == 0, "data:y").when(k % 3 == 1, " http://j ").alias("image"), F.lit(None).cast("string").alias("published_at"), F.lit("new").alias("etag"), F.lit("de").alias("language"),
    )
    out = W.upsert_drafts(stored, drafts)
    seq = W.match_drafts(stored, drafts).select("source", "external_id", "seq")
    return out.join(seq, ["source", "external_id"]).select("id", "seq", "matched", "outcome", "summary", "stage", "country", "status", "image", "published_at", "etag", "language")


_LONG = "a long and careful text about a pump that waters fields in dry places and that many people use every day of the year"
# (stored status, title, summary, body; incoming title, summary, body; merged title, summary; unchanged)
_MERGES = [
    ("AUTO", "Solar pump for dry fields", "s", _LONG, "Solar pump for dry fields", "s", "short", "Solar pump for dry fields", "s", True),
    ("SOURCE_LIMITED", "Solar pump", "s", "b", "Solar pump", "s", "b", "Solar pump", "s", True),
    ("SOURCE_LIMITED", "Solar pump", "summary", "body", "Solar pump", "s", "b", "Solar pump", "summary", True),
    ("NEEDS_REVIEW", "Solar pump for dry fields", "s", _LONG, "Solar pumps for dry fields", "other", "short", "Solar pumps for dry fields", "s", False),
    ("NEEDS_REVIEW", "Solar pump for dry fields", "s", _LONG, "Solar p", "t", _LONG + " and more", "Solar pump for dry fields", "t", False),
    ("AUTO", "Solar pump for dry fields", "s", _LONG, "Solar pump for dry fields", "s", _LONG, "Solar pump for dry fields", "s", True),
    ("AUTO", "Solar pump for dry fields", "s", _LONG, "Solar pump for dry fields", "t", _LONG + " and more", "Solar pump for dry fields", "t", False),
]


def _expected(values: list[tuple], columns: dict[str, int]) -> str:
    """A pick of hand-worked values by key."""
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"[{', '.join(lit(v[i]) for v in values)}][p_partkey % {len(values)} + 1] AS {name}" for name, i in columns.items())


def _cases(spark, sf_dir, values: list[tuple], names: list[str]):
    """(key, names…): parts, each with one of some cases in turn."""
    which = (F.col("p_partkey") % len(values)).cast("int")
    cases = spark.createDataFrame([(i, *v[: len(names)]) for i, v in enumerate(values)], "_case int, " + ", ".join(f"{n} {'boolean' if isinstance(next((v[j] for v in values if v[j] is not None), ''), bool) else 'string'}" for j, n in enumerate(names)))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), which.alias("_case")).join(F.broadcast(cases), "_case").drop("_case")


@query(f"SELECT p_partkey AS key, {_expected(_MERGES, {'title': 7, 'summary': 8, 'unchanged': 9})} FROM part")
def preserve_merge(spark, sf_dir):
    """The merge that keeps a stored item's quality; the SQL holds the outcome of each rule, worked out by hand."""
    rows = _cases(spark, sf_dir, _MERGES, ["status", "t0", "s0", "b0", "t1", "s1", "b1"])
    old, new = ({p: F.col(f"{p[0]}{i}") for p in ("title", "summary", "body")} for i in (0, 1))
    return rows.select("key", R.preserved(F.col("status"), old, new).alias("m")).select("key", "m.title", "m.summary", "m.unchanged")


_BODY = "This is the body of a project that brings clean water to many villages, with enough words to pass every gate of length."
# (source, title, summary, body, organisation, person, source_name, item_title, meta, url, external_id; action, title after)
_FIXES = [
    ("a", "", "s", _BODY, None, None, None, None, None, "u", "1", "hide", ""),
    ("a", "Advanced  Search", "s", _BODY, None, None, None, None, None, "u", "2", "hide", "Advanced Search"),
    ("a", "SOLAR PUMPS IN RURAL TOWNS", _BODY, _BODY, None, None, None, None, None, "u3", "3", "cleared", "Solar Pumps IN Rural Towns"),
    ("a", "Water for a", _BODY, _BODY, None, None, None, "Water for all villages", None, "u4", "4", "cleared", "Water for all villages"),
    ("b", "Site Brand", _BODY, _BODY, None, None, None, None, None, "http://x/project/blue-water-12", "5", "cleared", "Blue Water"),
    ("c", "Thin project name", "Too short", "", None, None, None, None, None, "u6", "6", "source_limited", "Thin project name"),
    ("a", "Named like its site", _BODY, _BODY, None, None, "Named Like its  site", None, None, "u7", "7", "hide", "Named like its site"),
    ("a", "Fine project title", _BODY, _BODY, "Non-profit", None, None, None, None, "u8", "8", "cleared", "Fine project title"),
    ("a", "Fine project name", _BODY, _BODY, None, "x y", None, None, None, "u9", "9", "unchanged", "Fine project name"),
]


@query(f"SELECT p_partkey AS key, {_expected(_FIXES, {'title': 12})}, CASE WHEN p_partkey % 9 IN (2, 3, 4, 5, 7, 8) AND p_partkey > 9 THEN 'hide' ELSE {_expected(_FIXES, {'action': 11}).replace(' AS action', '')} END AS action FROM part")
def bulk_fix(spark, sf_dir):
    """Proposals, junk, duplicates and outcomes of items in review; the SQL holds what each rule gives, worked out by hand,
    and that of equal items the first alone stays."""
    rows = _cases(spark, sf_dir, _FIXES, ["source", "title", "summary", "body", "organisation", "person", "source_name", "item_title", "meta", "url", "external_id"]).withColumnRenamed("key", "id")
    fixed = W.bulk_fix(rows, brands={"b": "site brand"})
    return fixed.select(F.col("id").alias("key"), "title", "action")


@query("""SELECT status, active, count(*) AS n, sum(len(reasons)) AS codes FROM (SELECT CASE WHEN NOT hit THEN status WHEN act = 'hide' THEN 'ARCHIVED' WHEN act = 'approve' THEN 'AUTO' ELSE 'SOURCE_LIMITED' END AS status, active AND NOT (hit AND act = 'hide') AS active,
  CASE WHEN NOT hit THEN reasons WHEN act = 'approve' THEN [] WHEN act = 'source_limited' THEN list_append(reasons, 'admin_source_limited') ELSE reasons END AS reasons
  FROM (SELECT *, status = 'NEEDS_REVIEW' AND (active OR act = 'hide') AS hit FROM (SELECT CASE WHEN o_orderstatus = 'O' THEN 'NEEDS_REVIEW' ELSE 'AUTO' END AS status, o_orderkey % 4 <> 0 AS active, [o_orderpriority] AS reasons, ['approve', 'source_limited', 'hide'][o_orderkey % 3 + 1] AS act FROM orders))) GROUP BY ALL""")
def review_actions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "NEEDS_REVIEW").otherwise("AUTO").alias("status"), F.array("o_orderpriority").alias("reasons"), (F.col("o_orderkey") % 4 != 0).alias("active"), F.lit(True).alias("embedded")
    )
    done = None
    for i, action in enumerate(("approve", "source_limited", "hide")):
        part = W.review_action(o.where(F.col("id") % 3 == i), action)
        done = part if done is None else done.unionByName(part)
    return done.groupBy("status", "active").agg(F.count("*").alias("n"), F.sum(F.size("reasons")).alias("codes"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderdate AS updated_at, o_orderkey % 4 = 0 AS active, o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 AS hidden FROM orders),
p AS (SELECT id FROM r WHERE hidden ORDER BY updated_at DESC, id LIMIT 25) SELECT id, CASE WHEN id IN (SELECT id FROM p) THEN 'NEEDS_REVIEW' ELSE 'ARCHIVED' END AS status, active OR id IN (SELECT id FROM p) AS active FROM r""")
def restore_hidden(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderdate").alias("updated_at"), (k % 4 == 0).alias("active"), F.lit("ARCHIVED").alias("status"), F.array(F.when(k % 3 == 0, W.JUNK).otherwise("other")).alias("reasons"))
    return W.restore_hidden(o, 25).select("id", "status", "active")


@query(f"""{_RES}, l AS (SELECT id, title, summary, body, CASE WHEN trim(body) <> '' AND trim(body) <> trim(summary) THEN greatest(length(trim(summary)), length(trim(body))) ELSE length(trim(summary)) END AS len FROM res),
n AS (SELECT *, CASE WHEN id % 3 = 0 THEN title || ' and on' ELSE title END AS t2, CASE WHEN id % 2 = 0 THEN body || repeat('x', 60) ELSE left(body, 70) END AS b2 FROM l),
m AS (SELECT *, CASE WHEN trim(b2) <> '' AND trim(b2) <> trim(summary) THEN greatest(length(trim(summary)), length(trim(b2))) ELSE length(trim(summary)) END AS l2 FROM n)
SELECT id, (length(trim(t2)) > length(trim(title)) + 4 AND trim(t2) <> trim(title)) OR l2 >= len + 40 OR (len < 80 AND l2 >= 80) AS better FROM m""")
def drain_improved(spark, sf_dir):
    r = resources(spark, sf_dir)
    new = {"title": F.when(F.col("id") % 3 == 0, F.concat("title", F.lit(" and on"))).otherwise(F.col("title")), "summary": F.col("summary"), "body": F.when(F.col("id") % 2 == 0, F.concat("body", F.repeat(F.lit("x"), 60))).otherwise(F.left("body", F.lit(70)))}
    return r.select("id", W.improved({p: F.col(p) for p in ("title", "summary", "body")}, new).alias("better"))


@query("SELECT p_partkey AS key, ['still_flagged', 'cleared', 'source_limited', 'still_flagged', 'unchanged'][p_partkey % 5 + 1] AS action, p_partkey % 5 <> 4 AND p_partkey % 2 = 0 AS repaired FROM part")
def drain_outcome(spark, sf_dir):
    action = F.element_at(F.array(*map(F.lit, ["hide", "cleared", "source_limited", "updated", "unchanged"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), W.drain_outcome(action, F.col("p_partkey") % 2 == 0).alias("o")).select("key", "o.action", "o.repaired")


# (source, text, country, stage, org_country, metadata, new_country, new_stage; country, stage, fields)
_ENRICH = [
    ("x", "text", None, "UNKNOWN", None, None, "usa", "pilot", "USA", "PILOT", "country,stage"),
    ("x", "text", " ", "IDEA", "Kenya", None, None, "pilot", "Kenya", "IDEA", "country"),
    ("x", "call +254 700", None, "UNKNOWN", None, '{"stage": "growth"}', None, "unknown", "Kenya", "SCALED", "country,stage"),
    ("gh", "a trial near Quito, Ecuador", None, "UNKNOWN", None, None, None, None, "Ghana", "PILOT", "country,stage"),
    ("x", "a text from Lyon, France", None, "UNKNOWN", None, "{}", "", "", "France", "UNKNOWN", "country"),
    ("x", "nothing", "Peru", "PILOT", "Kenya", None, "Chile", "scaled", "Peru", "PILOT", ""),
]


@query(f"SELECT p_partkey AS key, {_expected(_ENRICH, {'country': 8, 'stage': 9, 'fields': 10})} FROM part")
def enrichment_apply(spark, sf_dir):
    """Blank fields filled by the first evidence that has them; the SQL holds each case's result, worked out by hand."""
    rows = _cases(spark, sf_dir, _ENRICH, ["source", "body", "country", "stage", "org_country", "metadata", "new_country", "new_stage"]).withColumnRenamed("key", "id")
    rows = rows.withColumn("title", F.lit("t")).withColumn("summary", F.lit(""))
    return W.enrich(rows, {"gh": "Ghana"}).select(F.col("id").alias("key"), "country", "stage", F.array_join("fields", ",").alias("fields"))


@query("""WITH s AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'h' || s_suppkey ELSE '' END AS host, 'n' || s_suppkey AS slug, s_name AS name, 'Old' AS country, '' AS description FROM supplier WHERE s_suppkey % 3 <> 0),
f AS (SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 4 = 0 THEN 'h' || s_suppkey ELSE '' END AS host, 'n' || s_suppkey AS slug, s_name || ' and co' AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'New' END AS country, CASE WHEN s_suppkey % 2 = 0 THEN 'found' ELSE ' ' END AS description FROM supplier)
SELECT CASE WHEN h.id IS NOT NULL THEN 'host' WHEN n.id IS NOT NULL THEN 'slug' ELSE 'new' END AS matched, f.slug, CASE WHEN h.id IS NOT NULL OR n.id IS NULL THEN f.name ELSE n.name END AS name, coalesce(f.country, n.country) AS country, coalesce(nullif(trim(f.description), ''), n.description) AS description
FROM f LEFT JOIN s h ON h.host = f.host AND h.host <> '' LEFT JOIN s n ON n.slug = f.slug""")
def hub_upsert(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    host = lambda n: F.when(k % n == 0, F.concat(F.lit("h"), k.cast("string"))).otherwise("")
    slug, none = F.concat(F.lit("n"), k.cast("string")).alias("slug"), F.lit(None).cast("string")
    stored = s.where(k % 3 != 0).select(k.alias("id"), host(2).alias("host"), slug, F.col("s_name").alias("name"), F.lit("Old").alias("country"), none.alias("city"), F.lit("").alias("description"))
    found = s.select(k.alias("seq"), host(4).alias("host"), slug, F.concat("s_name", F.lit(" and co")).alias("name"), F.when(k % 5 == 0, "New").alias("country"), none.alias("city"), F.when(k % 2 == 0, "found").otherwise(" ").alias("description"))
    return W.upsert_hubs(stored, found).select("matched", "slug", "name", "country", "description")


_SLUG_BASES = "CASE WHEN s_suppkey % 3 = 0 THEN 'src-' || s_nationkey || '-2' ELSE 'src-' || s_nationkey END"
# one candidate after another, as the rule is told: each takes the first name that is free by then
_SLUGS = f"""WITH RECURSIVE c AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS n, s_suppkey AS id, {_SLUG_BASES} AS p FROM supplier),
walk AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS id, ['src-1', 'src-3', 'src-7-2'] AS used, NULL::VARCHAR AS slug UNION ALL
  SELECT n, id, list_append(used, slug), slug FROM (SELECT c.n, c.id, used, list_filter(list_prepend(p, list_transform(range(2, 400), lambda i: p || '-' || i)), lambda x: NOT list_contains(used, x))[1] AS slug FROM walk JOIN c ON c.n = walk.n + 1))
SELECT id, slug FROM walk WHERE n > 0"""


@query(_SLUGS)
def candidate_slugs(spark, sf_dir):
    """Names for promoted candidates, some of whom propose what another's numbered name would be."""
    k = F.col("s_nationkey").cast("string")
    base = F.concat(F.lit("src-"), k, F.when(F.col("s_suppkey") % 3 == 0, "-2").otherwise(""))
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), base.alias("proposed"))
    return W.unique_slugs(c, spark.createDataFrame([("src-1",), ("src-3",), ("src-7-2",)], "slug string"), "id").select("id", "slug")


@query("""WITH st AS (SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'old' END AS country FROM nation WHERE n_nationkey < 15), w AS (SELECT n_name AS name, min('c' || c_mktsegment) AS country FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT coalesce(st.name, w.name) AS name, coalesce(st.country, w.country) AS country FROM st FULL JOIN w ON st.name = w.name""")
def ensure_entities(spark, sf_dir):
    """Organisations that are not there yet are added; stored ones keep what they have."""
    n = table(spark, sf_dir, "nation")
    stored = n.where("n_nationkey < 15").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "old").alias("country"))
    wanted = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), F.concat(F.lit("c"), "c_mktsegment").alias("country"))
    return W.ensure(stored, wanted, ["name"], ["country"])


@query(f"WITH c AS ({ORACLE_SQL['url_canonical']}) SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://base.example/items/' || page_id ELSE canonical END AS url FROM c")
def malformed_urls(spark, sf_dir):
    """Addresses that are none are rebuilt: a stray colon goes, else the external id stands under a base."""
    k, n = F.col("page_id") % 3, F.col("page_id").cast("string")
    raw = F.when(k == 0, F.concat(F.lit(":"), n)).when(k == 1, F.concat(F.lit(" : "), "url", F.lit(" "))).otherwise(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", raw.alias("raw"))
    return rows.select("page_id", F.coalesce(T.public_url(F.col("raw"), F.lit(None).cast("string")), F.concat(F.lit("https://base.example/items/"), n)).alias("url"))


@query(f"""{_RES}, r AS (SELECT * FROM res WHERE active AND resource_type <> 'ARTICLE' AND review_status <> 'NEEDS_REVIEW'), g AS (SELECT id, CASE WHEN nation_key % 5 = 0 THEN NULL WHEN nation_key % 5 = 1 THEN ' ' ELSE 'x' END AS country, maturity, id IN (SELECT vec_id FROM embeddings) AS org FROM r)
SELECT count(*) FILTER (country IS NULL OR trim(country) = '') AS missing_country, count(*) FILTER (maturity = 'IDEA') AS missing_stage, count(*) FILTER (NOT org) AS missing_org, count(*) FILTER (country IS NULL OR country = '' OR maturity = 'IDEA' OR NOT org) AS pending FROM g""")
def enrichment_gaps(spark, sf_dir):
    """What enrichment still has to fill, in one pass."""
    r = resources(spark, sf_dir).where("active and resource_type <> 'ARTICLE' and review_status <> 'NEEDS_REVIEW'")
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(True).alias("org")).distinct()
    g = r.join(own, "id", "left").withColumn("org", F.coalesce("org", F.lit(False))).withColumn("country", F.when(F.col("nation_key") % 5 == 0, None).when(F.col("nation_key") % 5 == 1, " ").otherwise("x"))
    unknown = F.col("maturity") == "IDEA"
    return g.agg(
        F.count_if(W.blank(F.col("country")) == "").alias("missing_country"), F.count_if(unknown).alias("missing_stage"), F.count_if(~F.col("org")).alias("missing_org"),
        F.count_if((F.coalesce("country", F.lit("")) == "") | unknown | ~F.col("org")).alias("pending"),
    )


@query(f"""{_RES}, h AS (SELECT id, sha256({"trim(regexp_replace(title, '\\s+', ' ', 'g'))"} || chr(10) || {"trim(regexp_replace(summary, '\\s+', ' ', 'g'))"} || chr(10) || {"trim(regexp_replace(left(body, 1500), '\\s+', ' ', 'g'))"}) AS h FROM res),
cache AS (SELECT id, h FROM h WHERE id % 3 <> 0), stale AS (SELECT id, CASE WHEN id % 3 = 1 THEN h ELSE 'other' END AS h FROM cache)
SELECT h.id, CASE WHEN s.id IS NULL THEN 'new' WHEN s.h = h.h THEN 'cached' ELSE 'stale' END AS state FROM h LEFT JOIN stale s ON s.id = h.id""")
def enrichment_cache(spark, sf_dir):
    """Items whose inputs an earlier enrichment has seen: a join on the hash of the inputs."""
    h = resources(spark, sf_dir).select("id", T.content_hash(F.col("title"), F.col("summary"), F.left("body", F.lit(1500))).alias("h"))
    seen = h.where("id % 3 <> 0").select("id", F.when(F.col("id") % 3 == 1, F.col("h")).otherwise("other").alias("seen"))
    return h.join(seen, "id", "left").select("id", F.when(F.col("seen").isNull(), "new").when(F.col("seen") == F.col("h"), "cached").otherwise("stale").alias("state"))


@query("SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey % 5 = 0")
def portfolio_links(spark, sf_dir):
    """Distinct links of items to the hub whose portfolio lists them, those already stored left out first."""
    pairs = table(spark, sf_dir, "lineitem").where("l_suppkey % 5 = 0").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    stored = pairs.where("l_suppkey % 10 = 0")
    return stored.unionByName(pairs.join(stored, ["o_custkey", "l_suppkey"], "left_anti"))


@query(f"{_RES} SELECT id, CASE WHEN source IN ('src1', 'src3') AND resource_type = 'PROJECT' THEN 'ARTICLE' ELSE resource_type END AS resource_type FROM res")
def retype_by_source(spark, sf_dir):
    hit = F.col("source").isin("src1", "src3") & (F.col("resource_type") == "PROJECT")
    return resources(spark, sf_dir).select("id", F.when(hit, "ARTICLE").otherwise(F.col("resource_type")).alias("resource_type"))


@query(f"{_RES} SELECT id FROM res WHERE review_status <> 'NEEDS_REVIEW' AND (source IN ('src1') OR lower(language) LIKE '%d%' OR (lower(summary) LIKE '%the%' AND lower(title) LIKE '%and%'))")
def quarantine(spark, sf_dir):
    """Items of listed sources, or with a listed mark; of the last rule both parts must hold."""
    low = lambda c: F.lower(c)
    rule = F.col("source").isin("src1") | low("language").contains("d") | (low("summary").contains("the") & low("title").contains("and"))
    return resources(spark, sf_dir).where((F.col("review_status") != "NEEDS_REVIEW") & rule).select("id")


@query("WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Non-Profit' ELSE c_name END AS org, CASE WHEN c_custkey % 3 = 0 THEN 'legal form: ltd' ELSE c_name END AS person FROM customer) SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN person END AS person FROM k WHERE c_custkey % 4 <> 0")
def legal_form_removal(spark, sf_dir):
    """Links to organisations that are only a legal form go; such persons become null."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "Non-Profit").otherwise(F.col("c_name")).alias("org"), F.when(F.col("c_custkey") % 3 == 0, "legal form: ltd").otherwise(F.col("c_name")).alias("person"))
    return c.where(~T.legal_form(F.col("org"))).select("c_custkey", F.when(~T.legal_form(F.col("person")), F.col("person")).alias("person"))


@query(f"{_RES} SELECT id, row_number() OVER (ORDER BY CASE WHEN review_status = 'REVIEWED' THEN 0 WHEN review_status = 'AUTO' THEN 1 ELSE 2 END, id DESC) AS place FROM res WHERE active AND id % 4 <> 1 QUALIFY place <= 100")
def stale_embedding_queue(spark, sf_dir):
    """Active items without a current embedding, the most trusted and newest first."""
    rank = F.when(F.col("review_status") == "REVIEWED", 0).when(F.col("review_status") == "AUTO", 1).otherwise(2)
    stale = resources(spark, sf_dir).where("active").where("id % 4 <> 1").select("id", rank.alias("r"))
    return ranking.pool(stale, [F.col("r"), F.desc("id")], 100).select("id", F.col("rank").alias("place"))


@query(f"{_RES} SELECT id, md5(body) AS h FROM (SELECT id, CASE WHEN length(trim(summary)) < 80 AND length(trim(body)) < 400 THEN trim(body) || ' ' || trim(summary) ELSE body END AS body FROM res)")
def content_backfill(spark, sf_dir):
    """Thin items take what the cached page says."""
    thin = (F.length(F.trim("summary")) < 80) & (F.length(F.trim("body")) < 400)
    body = F.when(thin, F.concat(F.trim("body"), F.lit(" "), F.trim("summary"))).otherwise(F.col("body"))
    return resources(spark, sf_dir).select("id", F.md5(body.cast("binary")).alias("h"))


@query("SELECT source_id, max(last) AS last, sum(n) AS n FROM (SELECT user_id % 20 AS source_id, max(event_id) AS last, count(*) AS n FROM events GROUP BY 1, event_id % 2) GROUP BY 1")
def checkpoints(spark, sf_dir):
    """Each source's checkpoint after a run is the larger of the stored and the new place."""
    e = table(spark, sf_dir, "events").withColumn("source_id", F.col("user_id") % 20)
    part = lambda i: e.where(F.col("event_id") % 2 == i).groupBy("source_id").agg(F.max("event_id").alias("last"), F.count("*").alias("n"))
    both = part(0).unionByName(part(1))
    return both.groupBy("source_id").agg(F.max("last").alias("last"), F.sum("n").alias("n"))


@query("SELECT a.p_partkey AS id, a.p_brand AS name, CASE WHEN a.p_size > 10 THEN (SELECT min(b.p_partkey) FROM part b WHERE b.p_brand = a.p_brand AND b.p_size <= 10) END AS parent FROM part a")
def seed_parents(spark, sf_dir):
    """Taxonomy entries with the ids of their parents, who are seeded first."""
    p = table(spark, sf_dir, "part")
    parents = p.where("p_size <= 10").groupBy("p_brand").agg(F.min("p_partkey").alias("parent"))
    return p.join(parents, "p_brand", "left").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.when(F.col("p_size") > 10, F.col("parent")).alias("parent"))


_MARKS = ["betting by our team", "home about contact and skip to main content of this site", "Lorem  ipsum text", "RSVP by May", "", "all rights reserved"]
_JUNK_ROWS = f"""{_RES}, r AS (SELECT id, CASE id % 7 WHEN 0 THEN '/team/' || id WHEN 1 THEN '/x/events' ELSE '/items/' || id END AS path, title, trim(summary) || ' ' || {_MARKS}[id % 6 + 1] AS summary, coalesce(body, '') AS body FROM res)"""


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _nav(c: str) -> str:
    return f"(length({_squeeze(c)}) >= 40 AND regexp_matches({_squeeze(c)}, '{T.any_of(R.NAV_PATTERNS)}'))"


@query(f"""{_JUNK_ROWS}, f AS (SELECT id, regexp_matches(path, '{R.AUTHOR_PATH}') AS ap, regexp_matches(path, '{R.EVENT_PATH}') AS ep, lower(title || ' ' || body) AS t, lower(title || ' ' || summary) AS u, summary, body FROM r)
SELECT id, concat_ws(',', CASE WHEN ap OR ep THEN 'catalogue_non_innovation_path' END, CASE WHEN ap OR (regexp_matches(t, '{R.AUTHOR_WORDS}') AND regexp_matches(t, '{R.GAMBLING}')) THEN 'catalogue_author_bio' END, CASE WHEN ep OR regexp_matches(u, '{R.EVENT_WORDS}') THEN 'catalogue_event_page' END,
  CASE WHEN {_nav('summary')} OR {_nav('left(body, 2000)')} THEN 'catalogue_nav_boilerplate' END, CASE WHEN regexp_matches({_squeeze('summary')}, '{T.any_of(R.PLACEHOLDERS)}') THEN 'catalogue_placeholder_summary' END) AS reasons FROM f""")
def catalogue_junk(spark, sf_dir):
    """Why items are no catalogue items, by their path and real texts into which telling words are put."""
    k = F.col("id")
    path = F.when(k % 7 == 0, F.concat(F.lit("/team/"), k.cast("string"))).when(k % 7 == 1, "/x/events").otherwise(F.concat(F.lit("/items/"), k.cast("string")))
    mark = F.element_at(F.array(*map(F.lit, _MARKS)), (k % 6 + 1).cast("int"))
    rows = resources(spark, sf_dir).select("id", path.alias("path"), "title", F.concat(F.trim("summary"), F.lit(" "), mark).alias("summary"), F.coalesce("body", F.lit("")).alias("body"))
    return rows.select("id", F.array_join(R.catalogue_junk(F.col("path"), F.col("title"), F.col("summary"), F.col("body")), ",").alias("reasons"))


@query(r"""SELECT page_id, CASE WHEN length(m) <= 240 THEN m ELSE left(m, 237) || '...' END AS text FROM (SELECT page_id, regexp_replace('GET ' || url || ' failed (' || url || '?key=1): ' || html, '(?i)(https?://[^\s)''"?#]+)[?#][^\s)''"]*', '\1', 'g') AS m FROM pages)""")
def error_texts(spark, sf_dir):
    """Messages about pages without the query strings of their addresses."""
    p = table(spark, sf_dir, "pages")
    message = F.concat(F.lit("GET "), "url", F.lit(" failed ("), "url", F.lit("?key=1): "), "html")
    return p.select("page_id", R.error_text(message).alias("text"))


@query("SELECT page_id, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN 'data:' || url ELSE regexp_replace(trim(url || '?v=2#x'), '[?#].*$', '') END AS image FROM pages")
def image_keys(spark, sf_dir):
    """Addresses of images to compare by; embedded images stay as they are."""
    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    image = F.when(k % 7 == 0, " ").when(k % 5 == 0, F.concat(F.lit("data:"), "url")).otherwise(F.concat(F.lit(" "), "url", F.lit("?v=2#x ")))
    return p.select("page_id", R.image_key(image).alias("image"))


@query(r"""SELECT page_id, CASE WHEN len(p) = 0 THEN '^/[^/]+/[^/]+/?$' ELSE '^/' || array_to_string(CASE WHEN len(p) >= 2 THEN p[1:len(p) - 1] ELSE p END, '/') || '/[^/]+/?$' END AS pattern
FROM (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages)""")
def collection_patterns(spark, sf_dir):
    """Path patterns of the items beside each page."""
    return table(spark, sf_dir, "pages").select("page_id", R.collection_pattern(F.col("url")).alias("pattern"))


_SP_BODY = "trim(regexp_replace(left(text, 400), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, length(b) >= 150 AND len(list_filter(string_split_regex(b, '[.!?]+'), lambda s: length(trim(s)) > 12)) >= 2 AS passes FROM (SELECT doc_id, {_SP_BODY} AS b FROM documents)")
def description_gates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.description_gate(F.left("text", F.lit(400))).alias("passes"))


# summaries as they go wrong: the title again, its slug, a cut one; into every third body paragraphs are put
_POOR = f"""{_RES}, r AS (SELECT id, title, CASE id % 5 WHEN 0 THEN replace(lower(title), ' ', '  ') WHEN 1 THEN 'an-item-' || id WHEN 2 THEN left(summary, 12) ELSE summary END AS summary, CASE WHEN id % 3 = 0 THEN left(body, 30) || chr(10) || ' ' || chr(10) || substr(body, 31) ELSE body END AS body, CASE WHEN id % 10 = 0 THEN title WHEN id % 10 = 1 THEN 'What a page says of itself, ' || id END AS meta FROM res)"""


def _slugged(c: str) -> str:
    return f"(length({c}) >= 8 AND regexp_matches({c}, '(?i)^[a-z0-9]+(-[a-z0-9]+)+$'))"


def _poor(c: str) -> str:
    low = lambda x: f"lower({_squeeze(x)})"
    return f"(({low('t')} <> '' AND {low('t')} = {low(c)}) OR {_slugged(f'trim({c})')})"


def _lead(c: str) -> str:
    """SQL of a text's first sentence."""
    return f"trim(CASE WHEN regexp_matches({c}, '(?s)[.!?]\\s') THEN regexp_extract({c}, '(?s)^(.*?[.!?])\\s', 1) ELSE {c} END)"


@query(f"""{_POOR}, a AS (SELECT id, coalesce(trim(title), '') AS t, coalesce(trim(summary), '') AS s, coalesce(trim(meta), '') AS m, coalesce(trim(body), '') AS b FROM r),
p AS (SELECT *, {_squeeze('b')} AS flat, list_filter(list_transform(regexp_split_to_array(b, '\\n\\s*\\n'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) >= 40 AND NOT (length(x) >= 8 AND regexp_matches(x, '(?i)^[a-z0-9]+(-[a-z0-9]+)+$'))) AS ps FROM a),
f AS (SELECT *, CASE WHEN len(ps) > 0 THEN ps[1] WHEN length(flat) >= 40 THEN {_lead('flat')} ELSE '' END AS para FROM p),
k AS (SELECT id, t, CASE WHEN {_poor('s')} OR length(s) < 20 THEN CASE WHEN m = '' OR {_poor('m')} THEN para ELSE m END ELSE s END AS taken FROM f),
c AS (SELECT id, t, taken, {_squeeze('taken')} AS c FROM k), d AS (SELECT *, CASE WHEN instr(substr(c, 1, 499), ' ') > 0 THEN 500 - instr(reverse(substr(c, 1, 499)), ' ') ELSE 0 END AS place FROM c)
SELECT id, CASE WHEN {_poor('taken')} THEN '' WHEN length(c) <= 500 THEN c WHEN place > 250 THEN rtrim(substr(c, 1, place - 1)) || '…' ELSE rtrim(substr(c, 1, 499)) || '…' END AS summary FROM d""")
def summary_repair(spark, sf_dir):
    """Summaries that say nothing, repaired from a page's description or the item's own text."""
    k, r = F.col("id"), resources(spark, sf_dir)
    summary = F.when(k % 5 == 0, F.replace(F.lower("title"), F.lit(" "), F.lit("  "))).when(k % 5 == 1, F.concat(F.lit("an-item-"), k.cast("string"))).when(k % 5 == 2, F.left("summary", F.lit(12))).otherwise(F.col("summary"))
    body = F.when(k % 3 == 0, F.concat(F.left("body", F.lit(30)), F.lit("\n \n"), F.expr("substring(body, 31)"))).otherwise(F.col("body"))
    meta = F.when(k % 10 == 0, F.col("title")).when(k % 10 == 1, F.concat(F.lit("What a page says of itself, "), k.cast("string")))
    rows = r.select("id", "title", summary.alias("summary"), body.alias("body"), meta.alias("meta"))
    return rows.select("id", R.repaired_summary(F.col("title"), F.col("summary"), F.col("body"), F.col("meta")).alias("summary"))


@query(f"""{_RES}, a AS (SELECT id, coalesce(trim(CASE WHEN id % 2 = 0 THEN title || ': ' ELSE title END), '') AS t, coalesce(trim(left(body, 240)), '') AS s FROM res), f AS (SELECT *, {_lead('s')} AS first FROM a),
w AS (SELECT *, regexp_matches(t, ':\\s*$') AND s <> '' AND first <> '' AND len(string_split({_squeeze('first')}, ' ')) BETWEEN 1 AND 12 AS fits, regexp_replace(trim(substr(s, length(first) + 1)), '^[.!?]\\s*', '') AS rest FROM f)
SELECT id, CASE WHEN fits THEN {_squeeze("t || ' ' || first")} ELSE t END AS title, CASE WHEN fits AND rest <> '' THEN rest ELSE s END AS summary FROM w""")
def colon_merge(spark, sf_dir):
    """Titles cut at a colon take the short first sentence of their texts back."""
    title = F.when(F.col("id") % 2 == 0, F.concat("title", F.lit(": "))).otherwise(F.col("title"))
    rows = resources(spark, sf_dir).select("id", title.alias("title"), F.left("body", F.lit(240)).alias("summary"))
    return rows.select("id", R.merged_title(F.col("title"), F.col("summary")).alias("m")).select("id", "m.title", "m.summary")
