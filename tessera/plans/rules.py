"""Text, address, taxonomy and quality rules over whole tables, and set-at-a-time writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import taxonomy as X, text as T
from tessera.operators import merge
from tessera.plans.registry import query
from tessera.sources import pages as P
from tessera.sources.tables import RESOURCES_SQL, resources, table

R = f"WITH {RESOURCES_SQL}"
_SP = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query("""SELECT page_id, md5(t) AS h, length(t) AS n FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '(?i)&nbsp;', ' ', 'g'), '(?i)&amp;', '&', 'g'), '(?i)&lt;', '<', 'g'), '(?i)&gt;', '>', 'g'), '(?i)&#0?39;|&apos;', '''', 'g'), '(?i)&quot;', '"', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g')) AS t FROM pages)""")
def html_to_text(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("t"))
    return rows.select("page_id", F.md5(F.col("t").cast("binary")).alias("h"), F.length("t").cast("long").alias("n"))


@query(f"""SELECT doc_id, CASE WHEN length(c) <= 120 THEN c WHEN p > 60 THEN rtrim(substr(c, 1, p - 1)) || '…' ELSE rtrim(substr(c, 1, 119)) || '…' END AS short
FROM (SELECT doc_id, c, CASE WHEN instr(substr(c, 1, 119), ' ') > 0 THEN 120 - instr(reverse(substr(c, 1, 119)), ' ') ELSE 0 END AS p FROM (SELECT doc_id, {_SP.format('text')} AS c FROM documents))""")
def truncate_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_words(F.col("text"), 120).alias("short"))


@query(f"SELECT doc_id, sha256({_SP.format('lang')} || chr(10) || '' || chr(10) || {_SP.format('text')}) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("lang"), F.lit(None).cast("string"), F.col("text")).alias("hash"))


@query(f"{R} SELECT id, length(regexp_replace(title, '[^A-Za-z]', '', 'g')) > 6 AND length(regexp_replace(title, '[^A-Z]', '', 'g')) > 0.75 * length(regexp_replace(title, '[^A-Za-z]', '', 'g')) AS caps FROM res")
def all_caps(spark, sf_dir):
    return resources(spark, sf_dir).select("id", T.all_caps(F.col("title")).alias("caps"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(upper(p_name), ' '), lambda w: CASE WHEN length(w) <= 3 THEN w ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ') AS title FROM part")
def title_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.title_case(F.upper("p_name")).alias("title"))


@query(f"""{R}, w AS (SELECT id, trim(title) AS n, CASE WHEN trim(title) = '' THEN 0 ELSE len(string_split({_SP.format('title')}, ' ')) END AS words, source FROM res)
SELECT id, CASE WHEN n = '' THEN NULL WHEN length(n) < 2 THEN 'short' WHEN lower(n) = lower(source) THEN 'source_name' WHEN regexp_matches(n, '[.!?]$') AND words >= 4 THEN 'sentence' WHEN words > 8 THEN 'long'
  WHEN regexp_matches(n, '(?i){T.SENTENCE_START}') AND words >= 3 THEN 'pronoun_start' WHEN regexp_matches(n, '(?i){T.AUXILIARY}') AND words >= 5 THEN 'verb' END AS fault FROM w""")
def org_name_valid(spark, sf_dir):
    return resources(spark, sf_dir).select("id", T.org_name_fault(F.col("title"), F.col("source")).alias("fault"))


@query(f"SELECT c_custkey, regexp_matches(n, '(?i){'|'.join(f'(?:{p})' for p in T.LEGAL_FORMS)}') AS legal FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Non-Profit' WHEN 1 THEN 'For-profit, b2b' WHEN 2 THEN 'N/A' ELSE c_name END AS n FROM customer)")
def legal_form(spark, sf_dir):
    n = F.when(F.col("c_custkey") % 4 == 0, "Non-Profit").when(F.col("c_custkey") % 4 == 1, "For-profit, b2b").when(F.col("c_custkey") % 4 == 2, "N/A").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.legal_form(n).alias("legal"))


@query(f"{R} SELECT id, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 80) AS slug FROM res")
def slug(spark, sf_dir):
    return resources(spark, sf_dir).select("id", T.slug(F.col("title")).alias("slug"))


@query(f"{R} SELECT id, CASE WHEN length(t) >= 8 THEN t || '|' || source || '|' || upper(language) END AS k FROM (SELECT id, trim(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', ' ', 'g')) AS t, source, language FROM res)")
def near_key(spark, sf_dir):
    return resources(spark, sf_dir).select("id", T.near_key(F.col("title"), F.col("source"), F.col("language")).alias("k"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages")
def website_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.website_host(F.col("url")).alias("host"))


@query("""SELECT page_id, regexp_replace(regexp_replace(base, '(.)/+$', '\\1'), '^(https?://[^/]+)$', '\\1/') || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS canonical FROM (
  SELECT page_id, regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/$', '') AS base,
    array_to_string(list_sort(list_filter(string_split(split_part(split_part(url, '#', 1), '?', 2), '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ('ref', 'utm_source', 'utm_medium', 'utm_campaign'))), '&') AS kept FROM pages)""")
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


@query("""SELECT canonical, count(*) AS n, min(page_id) AS first FROM (SELECT page_id, regexp_replace(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^https?://(www\\.|m\\.|blog\\.)?', ''), '/$', '') AS canonical FROM pages) GROUP BY 1""")
def url_groups(spark, sf_dir):
    """Pages by address without scheme, common sub-domains, query and final slash."""
    bare = F.regexp_replace(F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)), r"^https?://(www\.|m\.|blog\.)?", "")
    return table(spark, sf_dir, "pages").groupBy(F.regexp_replace(bare, "/$", "").alias("canonical")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


@query(f"""{R}, s AS (SELECT id, lower(trim(coalesce(language, ''))) AS l, body, {_SP.format('body')} AS c FROM res)
SELECT id, (l <> '' AND l <> 'en' AND NOT starts_with(l, 'en-')) OR regexp_matches(body, '{T.SCRIPTS}') OR (length(c) >= 24 AND (regexp_matches(c, '{T.UMLAUTS}')
  OR (len(string_split(c, ' ')) >= 6 AND len(list_filter(string_split(c, ' '), lambda w: regexp_matches(w, '(?i)\\b(?:{T.HINT_WORDS})\\b'))) >= 3))) AS translate FROM s""")
def needs_translation(spark, sf_dir):
    return resources(spark, sf_dir).select("id", T.needs_translation(F.col("language"), F.col("body")).alias("translate"))


def _tag_sql(rules: dict[str, list[str]]) -> str:
    hits = ", ".join(f"CASE WHEN regexp_matches(low, '(?:^|[^a-z0-9])(?:{'|'.join(p)})(?:[^a-z0-9]|$)') THEN '{s}' END" for s, p in rules.items())
    return f"array_to_string(list_filter([{hits}], lambda x: x IS NOT NULL)[1:3], ',')"


_ITEM = "(SELECT p_partkey, lower('A ' || p_type || ' kit for ' || (['off-grid solar power', 'drip irrigation of smallholder farming', 'school learning', 'plastic waste recycling', 'clean water', 'iot sensor telemetry for health'])[p_partkey % 6 + 1]) AS low FROM part)"


@query(f"SELECT p_partkey, {_tag_sql(X.SECTORS)} AS sectors, {_tag_sql(X.PROBLEMS)} AS problems, {_tag_sql(X.TECHNOLOGIES)} AS technologies FROM {_ITEM}")
def taxonomy_keywords(spark, sf_dir):
    kinds = F.array(*map(F.lit, ["off-grid solar power", "drip irrigation of smallholder farming", "school learning", "plastic waste recycling", "clean water", "iot sensor telemetry for health"]))
    text = F.concat(F.lit("A "), F.col("p_type"), F.lit(" kit for "), F.element_at(kinds, (F.col("p_partkey") % 6 + 1).cast("int")))
    tag = lambda rules: F.array_join(X.tags(text, rules), ",")
    return table(spark, sf_dir, "part").select("p_partkey", tag(X.SECTORS).alias("sectors"), tag(X.PROBLEMS).alias("problems"), tag(X.TECHNOLOGIES).alias("technologies"))


@query("""SELECT n_nationkey, CASE WHEN r = 'GLOBAL' THEN 'Global' WHEN r LIKE '%MIDDLE EAST%' OR r = 'MENA' THEN 'Middle East and North Africa' WHEN r LIKE '%AFRICA%' THEN 'Africa' WHEN r LIKE '%ASIA%' OR r LIKE '%PACIFIC%' THEN 'Asia'
  WHEN r LIKE '%EUROPE%' THEN 'Europe' WHEN r LIKE '%LATIN%' OR r LIKE '%AMERICA%' OR r LIKE '%CARIBBEAN%' THEN 'Americas' END AS continent, n_name AS sector FROM (SELECT n_nationkey, upper(trim(r_name)) AS r, n_name FROM nation JOIN region ON r_regionkey = n_regionkey)""")
def region_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    label = F.concat_ws(" • ", "r_name", "n_name")
    return rows.select("n_nationkey", X.region_continent(label).alias("continent"), X.region_sector(label).alias("sector"))


@query("SELECT p_partkey, CASE WHEN p_size % 12 = 0 THEN 'UNKNOWN' WHEN p_size % 12 <= 3 THEN 'IDEA' WHEN p_size % 12 <= 6 THEN 'PROTOTYPE' WHEN p_size % 12 <= 8 THEN 'PILOT' ELSE 'DEPLOYED' END AS stage FROM part")
def stage_infer(spark, sf_dir):
    text = F.when(F.col("p_size") % 12 == 0, "no level").otherwise(F.concat(F.lit("at TRL "), (F.col("p_size") % 12).cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", X.stage_from_trl(text).alias("stage"))


_GATE = f"""{R}, g AS (SELECT *, trim(title) AS t, trim(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', ' ', 'g')) AS a, length(regexp_replace(title, '[^A-Za-z]', '', 'g')) AS nl, length(regexp_replace(title, '[^A-Z]', '', 'g')) AS nu,
  CASE WHEN trim(body) <> '' AND trim(body) <> trim(summary) THEN greatest(length(trim(summary)), length(trim(body))) ELSE length(trim(summary)) END AS len, list_last(string_split(trim(regexp_replace(title, '\\s+', ' ', 'g')), ' ')) AS last FROM res),
gate AS (SELECT id, review_status, active, list_filter([CASE WHEN len < 80 THEN 'short_description' END, CASE WHEN lower(t) IN ({', '.join(map(repr, T.BLOCKED_TITLES))}) OR a IN ({', '.join(map(repr, T.BLOCKED_TITLES))}) THEN 'blocklist_title' END,
  CASE WHEN nl > 0 AND nu > 0.75 * nl AND length(t) > 6 THEN 'all_caps_title' END, CASE WHEN length(t) < 4 OR (length(last) <= 3 AND NOT regexp_matches(t, '[.!?]$') AND length(t) < 25) OR regexp_matches(t, '(?i)websit$') THEN 'truncated_title' END], lambda x: x IS NOT NULL) AS reasons FROM g)"""


def _gated(spark, sf_dir):
    reasons = T.quality_reasons(F.col("title"), F.col("summary"), F.col("body"))
    return resources(spark, sf_dir).select("id", "review_status", "active", reasons.alias("reasons"))


@query(f"{_GATE} SELECT id, array_to_string(reasons, ',') AS reasons, len(reasons) > 0 AS needs_review FROM gate")
def quality_gate(spark, sf_dir):
    return _gated(spark, sf_dir).select("id", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") > 0).alias("needs_review"))


@query(f"{_GATE} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM gate) GROUP BY 1")
def reason_histogram(spark, sf_dir):
    return _gated(spark, sf_dir).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"{_GATE} SELECT source, reason, count(*) AS n FROM (SELECT source, unnest(CASE WHEN len(reasons) = 0 THEN ['needs_review'] ELSE reasons END) AS reason FROM gate JOIN res USING (id) WHERE gate.review_status = 'NEEDS_REVIEW') GROUP BY ALL")
def review_breakdown(spark, sf_dir):
    rows = resources(spark, sf_dir).where("review_status = 'NEEDS_REVIEW'")
    reasons = T.quality_reasons(F.col("title"), F.col("summary"), F.col("body"))
    rows = rows.select("source", F.explode(F.when(F.size(reasons) == 0, F.array(F.lit("needs_review"))).otherwise(reasons)).alias("reason"))
    return rows.groupBy("source", "reason").agg(F.count("*").alias("n"))


@query(f"{_GATE} SELECT id, CASE WHEN NOT active OR review_status = 'REVIEWED' THEN review_status WHEN len(reasons) > 0 THEN 'NEEDS_REVIEW' ELSE 'AUTO' END AS status FROM gate")
def audit_apply(spark, sf_dir):
    """The audit's new status of every row; reviewed and inactive rows are left."""
    keep = ~F.col("active") | (F.col("review_status") == "REVIEWED")
    return _gated(spark, sf_dir).select("id", F.when(keep, F.col("review_status")).when(F.size("reasons") > 0, "NEEDS_REVIEW").otherwise("AUTO").alias("status"))


_THIN = ", ".join(map(repr, T.THIN_REASONS))


@query(f"""{_GATE} SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN len(reasons) = 0 THEN 'cleared'
  WHEN len(list_filter(reasons, lambda r: r NOT IN ({_THIN}))) = 0 AND ((len < 80 AND list_has_any(reasons, [{_THIN}])) OR list_has_any(reasons, ['blocklist_title', 'cohort_boilerplate_title'])) THEN 'source_limited' ELSE 'still_flagged' END AS outcome
  FROM gate JOIN g USING (id) WHERE gate.review_status = 'NEEDS_REVIEW') GROUP BY 1""")
def reconcile(spark, sf_dir):
    """Items in review: cleared, as good as their source allows, or still flagged."""
    rows = resources(spark, sf_dir).where("review_status = 'NEEDS_REVIEW'")
    reasons = T.quality_reasons(F.col("title"), F.col("summary"), F.col("body"))
    outcome = F.when(F.size(reasons) == 0, "cleared").when(T.source_limited(reasons, F.col("summary"), F.col("body"), F.lit(None).cast("string")), "source_limited").otherwise("still_flagged")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


_CUR = "cur AS (SELECT c_custkey AS id, c_mktsegment AS title, md5(c_name) AS h FROM customer WHERE c_acctbal < 5000), new AS (SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN ' ' ELSE c_mktsegment || '!' END AS title, md5(CASE WHEN c_nationkey < 12 THEN c_name || 'x' ELSE c_name END) AS h FROM customer WHERE c_acctbal > 1000)"


@query(f"WITH {_CUR} SELECT coalesce(c.id, n.id) AS id, CASE WHEN n.id IS NULL OR (c.id IS NOT NULL AND c.h IS NOT DISTINCT FROM n.h) THEN c.title ELSE coalesce(nullif(trim(n.title), ''), c.title) END AS title, CASE WHEN n.id IS NULL THEN 'absent' WHEN c.id IS NULL THEN 'new' WHEN c.h = n.h THEN 'unchanged' ELSE 'updated' END AS outcome FROM cur c FULL JOIN new n ON c.id = n.id")
def upsert_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    md5 = lambda x: F.md5(x.cast("binary"))
    cur = c.where("c_acctbal < 5000").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("title"), md5(F.col("c_name")).alias("h"))
    new = c.where("c_acctbal > 1000").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") == 3, " ").otherwise(F.concat("c_mktsegment", F.lit("!"))).alias("title"), md5(F.when(F.col("c_nationkey") < 12, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name"))).alias("h"))
    return merge.upsert(cur, new, "id", "h", ["title"]).select("id", F.trim("title").alias("title"), "outcome")


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 0 ELSE c_nationkey % 3 + 1 END AS miss_count, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN true ELSE c_nationkey % 3 + 1 < 2 END AS active FROM customer")
def disappearance(spark, sf_dir):
    items = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 3).cast("int").alias("miss_count"), F.lit(True).alias("active"))
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return merge.disappear(items, seen, "c_custkey")


@query("SELECT s_suppkey AS id, min(s_suppkey) OVER (PARTITION BY trim(regexp_replace(lower('ACME  ' || s_nationkey || ' Ltd.'), '[^a-z0-9]+', ' ', 'g'))) AS canonical_id FROM supplier")
def org_merge(spark, sf_dir):
    orgs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("ACME  "), F.col("s_nationkey").cast("string"), F.lit(" Ltd.")).alias("name"))
    return merge.merge_names(orgs, T.ascii_name(F.col("name")), [F.col("id")])


@query("SELECT DISTINCT l_orderkey, c AS l_suppkey FROM lineitem JOIN (SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS c FROM supplier) ON s_suppkey = l_suppkey")
def org_relink(spark, sf_dir):
    """Links moved to the canonical organisation, each once."""
    mapping = merge.merge_names(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey"), F.col("s_nationkey"), [F.col("id")])
    return merge.relink(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), mapping, "l_suppkey", ["l_orderkey", "l_suppkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def orphan_delete(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' AND o_totalprice > 50000 AND age < 30 THEN 'listing_unchanged' WHEN o_orderstatus = 'P' AND age < 30 THEN 'bootstrap' END AS skip FROM (SELECT *, o_orderkey % 60 AS age FROM orders)")
def listing_skip(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    before = F.when(F.col("o_orderstatus") != "P", F.when(F.col("o_totalprice") > 50000, "h").otherwise("other"))
    return o.select("o_orderkey", merge.listing_skip(F.lit("h"), before, F.col("o_orderkey") % 60).alias("skip"))


@query(f"{R} SELECT id FROM res WHERE active AND id NOT IN (SELECT vec_id FROM embeddings)")
def reembed_queue(spark, sf_dir):
    return resources(spark, sf_dir).where("active").select("id").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_anti")


@query(f"""{R} SELECT id, md5(array_to_string(list_filter([trim(title), trim(summary), substr(trim(body), 1, 4000), 'Source: ' || source], lambda x: x IS NOT NULL AND x <> ''), chr(10))) AS h FROM res""")
def embedding_text(spark, sf_dir):
    rows = resources(spark, sf_dir).select("id", T.embedding_text(F.col("title"), F.col("summary"), F.col("body"), {"Source": F.col("source")}).alias("t"))
    return rows.select("id", F.md5(F.col("t").cast("binary")).alias("h"))


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1 UNION SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 45")
def link_taxonomy(spark, sf_dir):
    links, keys = table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"]
    return merge.link_absent(links.where("l_linenumber = 1").select(keys).distinct(), links.where("l_quantity > 45").select(keys), keys)


@query("SELECT o_custkey, list_sort(list(DISTINCT r)) AS reasons FROM (SELECT o_custkey, unnest([o_orderstatus, o_orderpriority]) AS r FROM orders) GROUP BY 1")
def reason_union(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("a"), F.collect_set("o_orderpriority").alias("b"))
    return rows.select("o_custkey", F.array_sort(F.array_union("a", "b")).alias("reasons"))


@query(f"{R} SELECT id, first_id AS duplicate_of FROM (SELECT id, min(id) OVER (PARTITION BY k) AS first_id FROM (SELECT id, CASE WHEN length(t) >= 8 THEN t || '|' || source || '|' || upper(language) END AS k FROM (SELECT id, trim(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', ' ', 'g')) AS t, source, language FROM res)) WHERE k IS NOT NULL) WHERE id <> first_id")
def near_title_duplicates(spark, sf_dir):
    """Rows that share a near-duplicate key with an earlier one: an aggregate and a join, no pairs."""
    keyed = resources(spark, sf_dir).select("id", T.near_key(F.col("title"), F.col("source"), F.col("language")).alias("k")).where("k is not null")
    first = keyed.groupBy("k").agg(F.min("id").alias("duplicate_of"))
    return keyed.join(first, "k").where("id <> duplicate_of").select("id", "duplicate_of")


@query("SELECT page_id, count(DISTINCT h) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"(/[^\"#?]*)', 1)) AS h FROM pages) GROUP BY 1")
def page_links(spark, sf_dir):
    """Links of pages to their own host."""
    return P.page_links(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count("*").alias("links"))


@query()
def page_details(spark, sf_dir):
    return P.page_details(table(spark, sf_dir, "pages"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') IS NOT NULL AS has FROM events")
def json_extract(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.missing").isNotNull().alias("has"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS path FROM conversations GROUP BY 1")
def ordered_turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return rows.select("conv_id", "turns", F.array_join(F.transform("x", lambda r: r["role"]), ">").alias("path"))
