"""Queries written in SQL alone over the registered functions, merges of JSON metadata, and a merge written back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.cluster import shared_dir
from tessera.functions import sql
from tessera.plans.registry import query
from tessera.sources.stored import StoredTable
from tessera.sources.tables import RESOURCES_SQL, RUNS_SQL, resources, runs, table

_SP = "trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g'))"


@query(f"""WITH {RESOURCES_SQL} SELECT id, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 80) AS slug,
  length(regexp_replace(title, '[^A-Za-z]', '', 'g')) > 6 AND length(regexp_replace(title, '[^A-Z]', '', 'g')) > 0.75 * length(regexp_replace(title, '[^A-Za-z]', '', 'g')) AS caps,
  CASE maturity WHEN 'SCALED' THEN 0 WHEN 'DEPLOYED' THEN 2 WHEN 'PILOT' THEN 3 ELSE 5 END AS stage, sha256({_SP.format('title')} || chr(10) || {_SP.format('summary')} || chr(10) || {_SP.format('source')}) AS digest FROM res WHERE active""")
def sql_item_rules(spark, sf_dir):
    """Rules of items in SQL."""
    sql.register(spark)
    return spark.sql("SELECT id, to_slug(title) AS slug, all_caps(title) AS caps, stage_rank(maturity) AS stage, content_digest(title, summary, source) AS digest FROM {items} WHERE active", items=resources(spark, sf_dir))


@query(f"WITH {RUNS_SQL} SELECT source_id, round(100.0 * count(*) FILTER (WHERE status = 'FAILED') / count(*), 1) AS failed_pct, floor(count(*) FILTER (WHERE status = 'SUCCEEDED')::DOUBLE / count(*) * 1000 + 0.5) / 10 AS succeeded_pct FROM runs GROUP BY 1")
def sql_source_report(spark, sf_dir):
    """Percentages of runs in SQL."""
    sql.register(spark)
    return spark.sql("SELECT source_id, percent_of(count_if(status = 'FAILED'), count(*)) AS failed_pct, half_up(count_if(status = 'SUCCEEDED') / count(*)) AS succeeded_pct FROM {runs} GROUP BY source_id", runs=runs(spark, sf_dir))


@query("SELECT page_id, count(DISTINCT h) AS links, min(h) AS first_path, max(h) AS last_path FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"(/[^\"#?]*)', 1)) AS h FROM pages) GROUP BY 1")
def sql_page_links(spark, sf_dir):
    """Links of pages to their own host, by a lateral join with the table function."""
    sql.register(spark)
    return spark.sql("SELECT page_id, count(*) AS links, min(l.path) AS first_path, max(l.path) AS last_path FROM {pages}, LATERAL extract_links(html, url) AS l WHERE l.own_host GROUP BY page_id", pages=table(spark, sf_dir, "pages"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN 'new' ELSE json_extract_string(props, '$.k') END AS k, CASE event_type WHEN 'error' THEN 'VOID' WHEN 'click' THEN 'STRING' ELSE 'BIGINT' END AS k_kind,
  CASE WHEN event_type = 'view' THEN '[1,null]' END AS list, event_type AS seen, CASE WHEN event_type IN ('error', 'click') THEN '1' END AS depth FROM events""")
def metadata_merge(spark, sf_dir):
    """Metadata merged field by field, a null of the later one counting, and a value put at a path that need not be there."""
    kind = F.col("event_type")
    new = F.when(kind == "error", F.lit('{"k": null, "o": {"d": 1}}')).when(kind == "click", F.lit('{"k": "new", "o": {"d": 1}}')).when(kind == "view", F.lit('{"list": [1, null]}')).otherwise(F.lit(None).cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", sql.put(sql.merged(F.col("props"), new), ["o", "seen"], sql.quoted(kind)).alias("m"))
    get = lambda path: F.get_json_object("m", path)
    return rows.select("event_id", get("$.k").alias("k"), F.schema_of_variant(F.variant_get(F.parse_json("m"), "$.k", "variant")).alias("k_kind"), get("$.list").alias("list"), get("$.o.seen").alias("seen"), get("$.o.d").alias("depth"))


@query("""WITH s AS (SELECT s_suppkey AS id, s_name AS name, 's' || s_nationkey AS summary, 'h' || s_nationkey AS hash FROM supplier)
SELECT id, CASE WHEN id % 3 = 0 AND id % 9 <> 0 AND id % 6 <> 0 THEN 'New ' || name ELSE name END AS name, CASE WHEN id % 3 = 0 AND id % 9 <> 0 THEN 'drafted' ELSE summary END AS summary, CASE WHEN id % 3 = 0 AND id % 9 <> 0 THEN 'x' ELSE hash END AS hash FROM s
UNION ALL SELECT id + 1000000, name, '', 'n' FROM s WHERE id % 5 = 0""")
def upsert_stored(spark, sf_dir):
    """A batch merged into a stored table and run again: the table is what one run leaves."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    own = F.concat(F.lit("h"), F.col("s_nationkey").cast("string"))
    stored = s.select(k.alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("summary"), own.alias("hash"))
    drafts = s.where(k % 3 == 0).select(k.alias("id"), F.when(k % 6 == 0, " ").otherwise(F.concat(F.lit("New "), "s_name")).alias("name"), F.lit("drafted").alias("summary"), F.when(k % 9 == 0, own).otherwise("x").alias("hash"))
    new = s.where(k % 5 == 0).select((k + 1000000).alias("id"), F.col("s_name").alias("name"), F.lit("").alias("summary"), F.lit("n").alias("hash"))
    kept = StoredTable.create(stored, f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}", "id")
    for _ in range(2):
        kept.upsert(drafts.unionByName(new), "hash", ["name"])
    return kept.read()
