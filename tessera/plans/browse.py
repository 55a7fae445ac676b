"""Facets, browse orders, top-1 families, caps and entity lookups."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tessera.functions import text as T
from tessera.operators import filters as flt, ranking
from tessera.plans.registry import query
from tessera.sources.tables import LOCATIONS_SQL, RESOURCES_SQL, RUNS_SQL, locations, resources, runs, table

R, L = f"WITH {RESOURCES_SQL}", f", {LOCATIONS_SQL}"


@query(f"{R} SELECT id, source FROM res WHERE active AND source IN ('src1', 'src3', 'src4')")
def facet_source(spark, sf_dir):
    return flt.apply(resources(spark, sf_dir), flt.SearchFilters(sources=["src1", "src3", "src4"])).select("id", "source")


@query(f"{R} SELECT id, resource_type, maturity FROM res WHERE active AND resource_type IN ('PROJECT', 'SOLUTION') AND maturity IN ('PILOT', 'SCALED')")
def facet_type_stage(spark, sf_dir):
    return flt.apply(resources(spark, sf_dir), flt.SearchFilters(types=["PROJECT", "SOLUTION"], stages=["PILOT", "SCALED"])).select("id", "resource_type", "maturity")


@query(f"{R}{L} SELECT id FROM res WHERE active AND (nation_key IN (SELECT nation_key FROM loc WHERE upper(country) = 'NATION_7') OR upper(source) = 'SRC7')")
def facet_country_or_primary(spark, sf_dir):
    """An existence test under OR, as a flag from one small join."""
    own = F.broadcast(locations(spark, sf_dir).where("upper(country) = 'NATION_7'"))  # at most 25 rows
    return flt.existence_flag(resources(spark, sf_dir).where("active"), own, "nation_key", "there").where("there or upper(source) = 'SRC7'").select("id")


@query(f"{R}{L} SELECT id FROM res WHERE active AND (nation_key IN (SELECT nation_key FROM loc WHERE continent = 'AFRICA') OR (source = 'src2' AND review_status = 'REVIEWED'))")
def facet_continent_fallback(spark, sf_dir):
    """Items of a continent, or of a source that stands for it: a union of id sets and one semi-join."""
    rows = resources(spark, sf_dir).where("active")
    ids = rows.join(locations(spark, sf_dir).where("continent = 'AFRICA'"), "nation_key", "left_semi").select("id").unionByName(rows.where("source = 'src2' AND review_status = 'REVIEWED'").select("id"))
    return ids.distinct()


@query(f"{R}{L} SELECT id FROM res WHERE active AND nation_key IN (SELECT nation_key FROM loc WHERE upper(continent) IN ('ASIA', 'EUROPE'))")
def facet_continent(spark, sf_dir):
    return flt.apply(resources(spark, sf_dir), flt.SearchFilters(continents=["Asia", "Europe"]), locations(spark, sf_dir)).select("id")


@query(f"{R} SELECT id FROM res WHERE active AND NOT EXISTS (SELECT 1 FROM events WHERE event_id = id AND json_extract_string(props, '$.k') IN ('1', '2', '3'))")
def anti_grant_flag(spark, sf_dir):
    flagged = table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").isin("1", "2", "3")).select(F.col("event_id").alias("id"))
    return resources(spark, sf_dir).where("active").join(flagged, "id", "left_anti").select("id")


_SAFE = f"NOT regexp_matches(coalesce({{}}, ''), '(?i){T.PANDEMIC}')"
_BROWSE = f"""resource_type <> 'ARTICLE' AND greatest(length(trim(summary)), length(trim(body))) >= {{least}} AND length(trim(title)) >= 4
  AND lower(trim(title)) NOT IN ({', '.join(repr(t) for t in T.BLOCKED_TITLES)}) AND NOT regexp_matches(title, '(?i)websit$') AND NOT regexp_matches(title, '^#+\\s')
  AND {_SAFE.format('title')} AND {_SAFE.format('summary')} AND {_SAFE.format('body')} AND lower(trim(summary)) <> lower(trim(title))"""


@query(f"{R} SELECT id, title FROM res WHERE active AND {_BROWSE.format(least=80)} AND NOT (length(regexp_replace(title, '[^A-Za-z]', '', 'g')) > 6 AND upper(title) = title AND regexp_matches(title, '[A-Z]'))")
def quality_browse_strict(spark, sf_dir):
    return flt.apply(resources(spark, sf_dir), flt.SearchFilters(quality="strict")).select("id", "title")


@query(f"{R} SELECT id, title FROM res WHERE active AND {_BROWSE.format(least=40)}")
def quality_browse_relaxed(spark, sf_dir):
    return flt.apply(resources(spark, sf_dir), flt.SearchFilters(quality="relaxed")).select("id", "title")


@query(f"{R} SELECT row_number() OVER (ORDER BY id DESC) AS rank, id FROM res WHERE active QUALIFY rank <= 50")
def browse_newest(spark, sf_dir):
    return ranking.pool(resources(spark, sf_dir).where("active").select("id"), [F.desc("id")], 50).select("rank", "id")


@query(f"{R} SELECT row_number() OVER (ORDER BY CASE maturity WHEN 'SCALED' THEN 0 WHEN 'DEPLOYED' THEN 1 WHEN 'PILOT' THEN 2 ELSE 3 END, id DESC) AS rank, id, maturity FROM res WHERE active QUALIFY rank <= 50")
def browse_maturity(spark, sf_dir):
    from tessera.functions.taxonomy import stage_rank

    rows = resources(spark, sf_dir).where("active").select("id", "maturity")
    return ranking.pool(rows, [stage_rank(F.col("maturity")), F.desc("id")], 50).select("rank", "id", "maturity")


@query(f"""{R} SELECT row_number() OVER (ORDER BY miss, thin, id DESC) AS rank, id, miss FROM (SELECT id,
  CASE WHEN id IN (SELECT page_id FROM pages) THEN 0 ELSE 1 END + CASE WHEN org_key IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) THEN 0 ELSE 1 END + CASE WHEN length(trim(summary)) < 120 THEN 1 ELSE 0 END AS miss,
  CASE WHEN lower(trim(summary)) = lower(trim(title)) OR length(trim(summary)) < 60 THEN 1 ELSE 0 END AS thin FROM res WHERE active) QUALIFY rank <= 50""")
def browse_completeness(spark, sf_dir):
    """Items with an image, an organisation and a long summary first."""
    from tessera.plans.search import completeness

    rows = completeness(spark, sf_dir, resources(spark, sf_dir).where("active"))
    return ranking.pool(rows, [F.col("miss"), *flt.quality_order()], 50).select("rank", "id", "miss")


@query("SELECT c_custkey, c_name, list_sort(list(o_orderkey)) AS orders FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_name ILIKE '%00001%' GROUP BY ALL")
def people_search(spark, sf_dir):
    """Substring search with nested rows."""
    people = table(spark, sf_dir, "customer").where(F.col("c_name").ilike("%00001%"))
    joined = people.join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_custkey", "c_name").agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"))


@query("SELECT s_suppkey, s_name, count(l_orderkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey WHERE s_name ILIKE '%1%' GROUP BY ALL")
def org_search(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "supplier").where(F.col("s_name").ilike("%1%")).join(n, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("s_suppkey", "s_name", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {RUNS_SQL} SELECT source_id, run_id, status FROM runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id) = 1")
def latest_run_distinct_on(spark, sf_dir):
    return ranking.first_per_key(runs(spark, sf_dir), ["source_id"], [F.desc("started_at"), F.col("run_id")]).select("source_id", "run_id", "status")


@query(f"WITH {RUNS_SQL}, src AS (SELECT s_suppkey AS source_id FROM supplier) SELECT source_id, run_id, items FROM src LEFT JOIN (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id) = 1) USING (source_id)")
def latest_run_lateral(spark, sf_dir):
    """Lateral top-1, sources without runs kept: one max_by aggregate and an outer join."""
    last = runs(spark, sf_dir).groupBy("source_id").agg(F.max_by(F.struct("run_id", "items"), F.struct("started_at", -F.col("run_id"))).alias("x"))
    src = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("source_id"))
    return src.join(last, "source_id", "left").select("source_id", "x.run_id", "x.items")


@query(f"WITH {RUNS_SQL}, src AS (SELECT s_suppkey AS source_id FROM supplier) SELECT source_id, run_id, items FROM src JOIN (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id) = 1) USING (source_id)")
def latest_run_inner_lateral(spark, sf_dir):
    return latest_run_lateral(spark, sf_dir).where("run_id is not null")


@query("SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 1) AS last_order, (SELECT o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 1) AS last_price FROM customer")
def scalar_top1(spark, sf_dir):
    """Correlated scalar subqueries over one order, as one aggregate."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", -F.col("o_orderkey"))).alias("x"))
    return table(spark, sf_dir, "customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.col("x.o_orderkey").alias("last_order"), F.col("x.o_totalprice").alias("last_price"))


@query("SELECT l_orderkey, coalesce(arg_min(p_type, p_name || p_type) FILTER (WHERE p_size > 25), arg_min(p_brand, p_name || p_brand), 'unknown') AS bucket FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def mechanism_bucket(spark, sf_dir):
    """First technology by name, else first sector by name, else unknown."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"), "left")
    first = F.min(F.when(F.col("p_size") > 25, F.struct(F.concat("p_name", "p_type").alias("n"), F.col("p_type").alias("v"))))["v"]
    other = F.min(F.when(F.col("p_name").isNotNull(), F.struct(F.concat("p_name", "p_brand").alias("n"), F.col("p_brand").alias("v"))))["v"]
    return rows.groupBy("l_orderkey").agg(F.coalesce(first, other, F.lit("unknown")).alias("bucket"))


@query("SELECT l_orderkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_linenumber = 1) DESC, s_name, l_linenumber) = 1")
def primary_org(spark, sf_dir):
    """The primary organisation of each item, else the first by name, unfit names left out."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").where("s_acctbal > 0"), F.col("s_suppkey") == F.col("l_suppkey"))
    best = F.min(F.struct((F.col("l_linenumber") != 1).alias("other"), "s_name", "l_linenumber"))
    return rows.groupBy("l_orderkey").agg(best.alias("x")).select("l_orderkey", "x.s_name")


@query(f"{R} SELECT id, source FROM res WHERE active QUALIFY row_number() OVER (PARTITION BY source ORDER BY id DESC) <= 3 ORDER BY id DESC LIMIT 20")
def cap_per_source(spark, sf_dir):
    return ranking.cap_per_key(resources(spark, sf_dir).where("active").select("id", "source"), "source", 3, [F.desc("id")], 20)


@query(f"{R} SELECT id, tech_key FROM res WHERE active QUALIFY row_number() OVER (PARTITION BY tech_key ORDER BY id DESC) <= 2 ORDER BY id DESC LIMIT 40")
def cap_per_bucket(spark, sf_dir):
    return ranking.cap_per_key(resources(spark, sf_dir).where("active").select("id", "tech_key"), "tech_key", 2, [F.desc("id")], 40)


@query(f"{R} SELECT id FROM (SELECT id, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) || '|' || source AS k FROM res) QUALIFY row_number() OVER (PARTITION BY k ORDER BY id) = 1 OR k = '|'")
def title_org_dedupe(spark, sf_dir):
    return ranking.dedupe_first_seen(resources(spark, sf_dir).select("id", "title", "source"), F.col("title"), F.col("source"), [F.col("id")]).select("id")


@query(f"{R} SELECT source, content_hash, id FROM (SELECT source, id, md5(title || summary) AS content_hash FROM res) QUALIFY row_number() OVER (PARTITION BY source, content_hash ORDER BY id) > 1")
def fingerprint_repeats(spark, sf_dir):
    """Rows whose content their source has shown before."""
    rows = resources(spark, sf_dir).select("source", "id", F.md5(F.concat("title", "summary").cast("binary")).alias("content_hash"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("source", "content_hash").orderBy("id"))).where("n > 1").drop("n")


@query(f"{R}{L} SELECT id, title, country, continent, list_sort(list(DISTINCT r2)) AS same_source FROM (SELECT res.id, title, country, continent, t.role AS r2 FROM res JOIN loc USING (nation_key) LEFT JOIN conversations t ON t.conv_id = res.id WHERE active) GROUP BY ALL")
def hydrate(spark, sf_dir):
    """Items with their location and the distinct roles of their notes; wide columns join after the aggregate."""
    notes = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_set("role")).alias("same_source"))
    rows = resources(spark, sf_dir).where("active").join(F.broadcast(locations(spark, sf_dir)), "nation_key").join(notes, "id", "left")
    return rows.select("id", "title", "country", "continent", F.coalesce("same_source", F.array(F.lit(None).cast("string"))).alias("same_source"))


@query("SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations")
def collection_in_order(spark, sf_dir):
    from tessera.operators.merge import next_positions

    return next_positions(table(spark, sf_dir, "conversations"), "conv_id", [F.col("turn")], F.lit(0)).select("conv_id", "turn", "role", "text", "position")


@query("SELECT kind, key, name FROM (SELECT 1 AS k, 'person' AS kind, c_custkey AS key, c_name AS name, row_number() OVER (ORDER BY c_custkey) AS n FROM customer WHERE c_name ILIKE '%9%' QUALIFY n <= 5 UNION ALL SELECT 2, 'organisation', s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier WHERE s_name ILIKE '%9%' QUALIFY n <= 4 UNION ALL SELECT 3, 'technology', p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) AS n FROM part WHERE p_name ILIKE '%ring%' QUALIFY n <= 4)")
def global_search_union(spark, sf_dir):
    """A few hits of each kind, in order of kind."""
    out = None
    for kind, name, key, label, pattern, n in (("person", "customer", "c_custkey", "c_name", "%9%", 5), ("organisation", "supplier", "s_suppkey", "s_name", "%9%", 4), ("technology", "part", "p_partkey", "p_name", "%ring%", 4)):
        rows = table(spark, sf_dir, name).where(F.col(label).ilike(pattern)).select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col(label).alias("name")).orderBy("key").limit(n)
        out = rows if out is None else out.unionByName(rows)
    return out
