"""Smaller operators: projections, predicates, keyed updates and checks over whole tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tessera.plans.registry import query
from tessera.sources.tables import RESOURCES_SQL, RUNS_SQL, resources, runs, table

R, N = f"WITH {RESOURCES_SQL}", f"WITH {RUNS_SQL}"


@query("SELECT doc_id, left(text, 700) AS excerpt FROM documents")
def excerpt(spark, sf_dir):
    """A text cut for display, the cut being the result."""
    return table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(700)).alias("excerpt"))


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING list_has_any(list(DISTINCT o_orderpriority), ['1-URGENT', '5-LOW']) AND NOT list_contains(list(DISTINCT o_orderstatus), 'P')")
def array_overlap(spark, sf_dir):
    sets = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"), F.collect_set("o_orderstatus").alias("s"))
    return sets.where(F.arrays_overlap("p", F.array(F.lit("1-URGENT"), F.lit("5-LOW"))) & ~F.array_contains("s", "P")).select("o_custkey")


@query(f"{R} SELECT id FROM res LEFT JOIN pages ON page_id = id WHERE url IS DISTINCT FROM NULL AND summary IS DISTINCT FROM title")
def distinct_from(spark, sf_dir):
    """Null-safe inequality."""
    rows = resources(spark, sf_dir).join(table(spark, sf_dir, "pages"), F.col("page_id") == F.col("id"), "left")
    return rows.where(~F.col("url").eqNullSafe(F.lit(None)) & ~F.col("summary").eqNullSafe(F.col("title"))).select("id")


@query("SELECT c_name, pos FROM customer JOIN (SELECT unnest(['BUILDING', 'MACHINERY', 'HOUSEHOLD']) AS seg, unnest([0, 1, 2]) AS pos) ON seg = c_mktsegment")
def list_order_join(spark, sf_dir):
    """Rows in the order of a given list."""
    wanted = spark.range(1).select(F.posexplode(F.array(*map(F.lit, ["BUILDING", "MACHINERY", "HOUSEHOLD"]))).alias("pos", "seg"))
    return table(spark, sf_dir, "customer").join(F.broadcast(wanted), F.col("seg") == F.col("c_mktsegment")).select("c_name", "pos")


@query("SELECT conv_id, max(turn) + 1 AS next_turn FROM conversations GROUP BY 1")
def next_position(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("next_turn"))


@query(f"{R} SELECT id FROM res WHERE active AND NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = id AND quality = 1) ORDER BY id DESC LIMIT 100")
def unclassified_batch(spark, sf_dir):
    """Newest rows without a record of the current version."""
    done = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return resources(spark, sf_dir).where("active").select("id").join(done, "id", "left_anti").orderBy(F.desc("id")).limit(100)


@query("SELECT c_custkey, coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END, (SELECT arg_max(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey = c_custkey), 'unknown') AS filled FROM customer")
def fill_if_empty(spark, sf_dir):
    """Empty fields from the latest item, then from a default; filled ones stay."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", "o_orderkey").alias("p"))
    rows = table(spark, sf_dir, "customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("c_custkey", F.coalesce(F.when(~(F.col("c_acctbal") < 0), F.col("c_mktsegment")), "p", F.lit("unknown")).alias("filled"))


@query("SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS address, left(md5(url), 12) AS fingerprint FROM pages")
def url_fingerprint(spark, sf_dir):
    bare = F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", bare.alias("address"), F.left(F.md5(F.col("url").cast("binary")), F.lit(12)).alias("fingerprint"))


@query(f"{N} SELECT source_id, 'runs=' || count(*) || '; failed=' || count(*) FILTER (WHERE status = 'FAILED') || CASE WHEN count(*) FILTER (WHERE status = 'FAILED') > 50 THEN '; circuit' ELSE '' END AS outcome FROM runs GROUP BY 1")
def run_outcome(spark, sf_dir):
    failed = F.count_if(F.col("status") == "FAILED")
    text = F.concat(F.format_string("runs=%d; failed=%d", F.count("*"), failed), F.when(failed > 50, "; circuit").otherwise(""))
    return runs(spark, sf_dir).groupBy("source_id").agg(text.alias("outcome"))


@query(f"{R}, top AS (SELECT id, body, source, row_number() OVER (PARTITION BY source ORDER BY id) AS rank FROM res QUALIFY rank <= 3) SELECT source, count(*) = 3 AND bool_and(regexp_matches(body, '(?i)\\b(the|die|la|el)\\b')) AS relevant FROM top GROUP BY 1")
def relevance_check(spark, sf_dir):
    """Whether the first three rows of each list all match a pattern; false for shorter lists."""
    w = Window.partitionBy("source").orderBy("id")
    rows = resources(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    return rows.groupBy("source").agg(((F.count("*") == 3) & F.bool_and(F.col("body").rlike(r"(?i)\b(the|die|la|el)\b"))).alias("relevant"))


@query("SELECT l_orderkey, l_suppkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 10)")
def drop_misassigned(spark, sf_dir):
    """Links whose other end no longer fits are dropped."""
    unfit = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").join(unfit, "l_partkey", "left_anti").select("l_orderkey", "l_suppkey")


@query("SELECT s_suppkey, CASE WHEN n IS NULL THEN 500 ELSE least(200, 10 * n) END AS item_limit FROM supplier LEFT JOIN (SELECT CAST(user_id % 20 AS BIGINT) AS k, count(DISTINCT user_id) AS n FROM events GROUP BY 1) ON k = s_suppkey")
def item_limits(spark, sf_dir):
    """A first run's limit, else one that follows what a source has."""
    n = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("k")).agg(F.countDistinct("user_id").alias("n"))
    rows = table(spark, sf_dir, "supplier").join(n, F.col("k") == F.col("s_suppkey"), "left")
    return rows.select("s_suppkey", F.when(F.col("n").isNull(), 500).otherwise(F.least(F.lit(200), 10 * F.col("n"))).alias("item_limit"))
