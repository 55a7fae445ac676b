"""Operational reports over run logs and links."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tessera.operators import runs as ops
from tessera.plans.registry import query
from tessera.sources.tables import RESOURCES_SQL, RUNS_SQL, resources, runs, table

R, N = f"WITH {RESOURCES_SQL}", f"WITH {RUNS_SQL}"


@query("SELECT (SELECT count(*) FROM documents) AS resources, (SELECT count(*) FROM supplier) AS organisations, (SELECT count(*) FROM customer) AS people, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, (SELECT count(*) FROM pages) AS items")
def library_stats(spark, sf_dir):
    """Counts of every table in one row: one small aggregate for each, their single rows joined on a constant."""
    out = None
    for name, t, where in (("resources", "documents", "true"), ("organisations", "supplier", "true"), ("people", "customer", "true"), ("errors", "events", "event_type = 'error'"), ("items", "pages", "true")):
        one = table(spark, sf_dir, t).where(where).agg(F.count("*").alias(name)).withColumn("_k", F.lit(1))
        out = one if out is None else out.join(one, "_k")
    return out.drop("_k")


@query(f"{R} SELECT count(*) FILTER (WHERE active) AS active, count(*) FILTER (WHERE review_status = 'REVIEWED') AS reviewed, count(*) AS total, count(*) FILTER (WHERE id IN (SELECT vec_id FROM embeddings)) AS embedded FROM res")
def coverage_filter(spark, sf_dir):
    rows = resources(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(True).alias("has")), "id", "left")
    return rows.agg(F.count_if("active").alias("active"), F.count_if(F.col("review_status") == "REVIEWED").alias("reviewed"), F.count("*").alias("total"), F.count("has").alias("embedded"))


@query("SELECT n_regionkey, count(DISTINCT c_custkey) AS people, count(DISTINCT c_custkey) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')) AS with_orders FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def distinct_filter_exists(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey")).join(done, "c_custkey", "left")
    return rows.groupBy("n_regionkey").agg(F.countDistinct("c_custkey").alias("people"), F.countDistinct(F.when(F.col("has"), F.col("c_custkey"))).alias("with_orders"))


@query(f"{N} SELECT source_id, count(*) AS runs, round(100.0 * count(*) FILTER (WHERE status = 'FAILED') / nullif(count(*), 0), 1) AS failed_pct, sum(k) AS k FROM runs GROUP BY 1")
def source_yield_pct(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("runs"), ops.percent(F.count_if(F.col("status") == "FAILED"), F.count("*")).alias("failed_pct"), F.sum("k").alias("k"))


@query(f"{N} SELECT kind, floor(avg(CASE WHEN k > 50 THEN 1.0 ELSE 0.0 END) * 1000 + 0.5) / 10 AS pct FROM runs GROUP BY 1")
def coverage_half_up(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("kind").agg(ops.coverage(F.avg(F.when(F.col("k") > 50, 1.0).otherwise(0.0))).alias("pct"))


@query(f"{N} SELECT kind, source_id, count(*) AS n FROM runs GROUP BY 1, 2")
def outcomes_by_source(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("kind", "source_id").agg(F.count("*").alias("n"))


@query(f"{N} SELECT source_id, count(*) FILTER (WHERE kind = 'click') AS click, count(*) FILTER (WHERE kind = 'error') AS error, count(*) FILTER (WHERE kind = 'view') AS view FROM runs GROUP BY 1")
def outcome_pivot(spark, sf_dir):
    p = runs(spark, sf_dir).groupBy("source_id").pivot("kind", ["click", "error", "view"]).agg(F.count(F.lit(1)))
    return p.na.fill(0)


@query("SELECT c_name AS name, list_sort(list(c_custkey)) AS ids FROM (SELECT c_mktsegment || '-' || c_nationkey AS c_name, c_custkey FROM customer) GROUP BY 1 HAVING count(*) > 1")
def dup_keys_having(spark, sf_dir):
    key = F.concat_ws("-", "c_mktsegment", "c_nationkey")
    return table(spark, sf_dir, "customer").groupBy(key.alias("name")).agg(F.array_sort(F.collect_list("c_custkey")).alias("ids")).where(F.size("ids") > 1)


@query("SELECT l_orderkey, list_sort(list(DISTINCT p_brand)) AS brands FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def array_agg_distinct(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("brands"))


@query("SELECT n_name, max(c_acctbal) AS best, arg_max(c_custkey, (c_acctbal, c_custkey)) AS who FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def last_error_max_by(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy("n_name").agg(F.max("c_acctbal").alias("best"), F.max(F.when(F.col("c_acctbal").isNotNull(), F.struct("c_acctbal", "c_custkey")))["c_custkey"].alias("who"))


@query("SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus, ';' ORDER BY o_orderkey) AS nested FROM orders GROUP BY 1")
def nested_json(spark, sf_dir):
    """Nested rows of each key, in order."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("x"))
    return rows.select("o_custkey", "n", F.array_join(F.transform("x", lambda r: F.concat(r["o_orderkey"].cast("string"), F.lit(":"), r["o_orderstatus"])), ";").alias("nested"))


@query(f"{N} SELECT source_id, avg(items) AS pace, ceil(100000 / least(1000, avg(items))) AS eta FROM (SELECT * FROM runs WHERE items > 0 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id) <= 7) GROUP BY 1")
def backfill_eta(spark, sf_dir):
    """Mean of the last seven positive runs, and how many more would clear a backlog."""
    w = Window.partitionBy("source_id").orderBy(F.desc("started_at"), "run_id")
    last = runs(spark, sf_dir).where("items > 0").withColumn("n", F.row_number().over(w)).where("n <= 7")
    return last.groupBy("source_id").agg(F.avg("items").alias("pace")).withColumn("eta", F.ceil(100000 / F.least(F.lit(1000.0), F.col("pace"))))


@query(f"""{R} SELECT step, remaining, CAST(coalesce(lag(remaining) OVER (ORDER BY step), total) - remaining AS BIGINT) AS removed FROM (
  SELECT unnest([1, 2, 3, 4]) AS step, unnest([count(*) FILTER (WHERE a), count(*) FILTER (WHERE a AND b), count(*) FILTER (WHERE a AND b AND c), count(*) FILTER (WHERE a AND b AND c AND d)]) AS remaining, count(*) AS total
  FROM (SELECT active AS a, resource_type <> 'ARTICLE' AS b, length(trim(title)) >= 20 AS c, review_status = 'REVIEWED' AS d FROM res))""")
def funnel(spark, sf_dir):
    """Counts after each added predicate in one scan."""
    steps = [F.col("active"), F.col("resource_type") != "ARTICLE", F.length(F.trim("title")) >= 20, F.col("review_status") == "REVIEWED"]
    counts, so_far = [F.count("*").alias("c0")], F.lit(True)
    for i, s in enumerate(steps, 1):
        so_far = so_far & s
        counts.append(F.count_if(so_far).alias(f"c{i}"))
    one = resources(spark, sf_dir).agg(*counts)
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"c{i}").alias("remaining"), (F.col(f"c{i - 1}") - F.col(f"c{i}")).alias("removed")) for i in range(1, len(steps) + 1)])
    return one.select(F.inline(rows))


@query(f"{N} SELECT source_id, sum(items) AS attempted, sum(items) FILTER (WHERE status = 'FAILED') AS lost, sum(items) - coalesce(sum(items) FILTER (WHERE status = 'FAILED'), 0) AS kept FROM runs GROUP BY 1")
def loss_report(spark, sf_dir):
    lost = F.sum(F.when(F.col("status") == "FAILED", F.col("items")))
    return runs(spark, sf_dir).groupBy("source_id").agg(F.sum("items").alias("attempted"), lost.alias("lost"), (F.sum("items") - F.coalesce(lost, F.lit(0.0))).alias("kept"))


@query(f"{N} SELECT run_id, CASE WHEN status = 'FAILED' AND started_at < TIMESTAMP '2024-01-10 00:00:00' THEN 'STALE' ELSE status END AS status FROM runs")
def stale_runs(spark, sf_dir):
    """Failed runs older than a given time are marked; the time is a parameter, never the clock."""
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    return runs(spark, sf_dir).select("run_id", F.when((F.col("status") == "FAILED") & (F.col("started_at") < now), "STALE").otherwise(F.col("status")).alias("status"))


@query(f"{N} SELECT source_id, count(*) AS n, min(started_at) AS first, max(started_at) AS last FROM runs WHERE started_at >= TIMESTAMP '2024-01-03' AND started_at < TIMESTAMP '2024-01-17' GROUP BY 1")
def runs_in_window(spark, sf_dir):
    lo, hi = (F.lit(x).cast("timestamp") for x in ("2024-01-03", "2024-01-17"))
    return runs(spark, sf_dir).where((F.col("started_at") >= lo) & (F.col("started_at") < hi)).groupBy("source_id").agg(F.count("*").alias("n"), F.min("started_at").alias("first"), F.max("started_at").alias("last"))


@query(f"""{N}, x AS (SELECT source_id, run_id, CAST(status = 'FAILED' AS INT) AS f, row_number() OVER w AS n, sum(CASE WHEN status = 'FAILED' THEN 0 ELSE 1 END) OVER w AS ok FROM runs WINDOW w AS (PARTITION BY source_id ORDER BY started_at, run_id)),
y AS (SELECT *, sum(f) OVER (PARTITION BY source_id, ok ORDER BY n) AS streak, sum(f) OVER (PARTITION BY source_id ORDER BY n) AS failed FROM x)
SELECT source_id, n AS tripped_at, CASE WHEN streak >= 3 THEN 'consecutive' ELSE 'rate' END AS reason FROM y WHERE f = 1 AND (streak >= 3 OR (n >= 50 AND failed > 0.5 * n)) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY n) = 1""")
def circuit_breaker(spark, sf_dir):
    """When each source's circuit opens; here three failures in a row are enough, the default is 25."""
    return ops.breaker(runs(spark, sf_dir), "source_id", [F.col("started_at"), F.col("run_id")], F.col("status") == "FAILED", streak=3)


@query(f"{N}, last AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id) = 1) SELECT source_id FROM last WHERE status = 'FAILED'")
def failed_only_sources(spark, sf_dir):
    from tessera.operators.ranking import first_per_key

    return first_per_key(runs(spark, sf_dir), ["source_id"], [F.desc("started_at"), F.col("run_id")]).where("status = 'FAILED'").select("source_id")


@query(f"{N}, last AS (SELECT source_id, max(started_at) AS t FROM runs GROUP BY 1) SELECT s_suppkey AS source_id, t IS NULL OR t < TIMESTAMP '2024-01-30' - CASE s_suppkey % 3 WHEN 0 THEN INTERVAL 1 DAY WHEN 1 THEN INTERVAL 7 DAY ELSE INTERVAL 30 DAY END AS due FROM supplier LEFT JOIN last ON source_id = s_suppkey")
def due_sources(spark, sf_dir):
    """Sources whose update class (daily, weekly, monthly) makes them due at a given time."""
    last = runs(spark, sf_dir).groupBy("source_id").agg(F.max("started_at").alias("t"))
    days = F.when(F.col("s_suppkey") % 3 == 0, 1).when(F.col("s_suppkey") % 3 == 1, 7).otherwise(30)
    rows = table(spark, sf_dir, "supplier").join(last, F.col("source_id") == F.col("s_suppkey"), "left")
    now = F.lit("2024-01-30").cast("timestamp_ntz")
    return rows.select(F.col("s_suppkey").alias("source_id"), (F.col("t").isNull() | (F.col("t").cast("timestamp_ntz") < now - F.make_dt_interval(days))).alias("due"))


#: A source of fewer items than this is covered thinly.
THIN = 15


@query(f"{N}, c AS (SELECT source_id, count(*) AS n FROM runs WHERE status = 'FAILED' AND k < 12 GROUP BY 1) SELECT s_suppkey AS source_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'zero' WHEN n < {THIN} THEN 'thin' ELSE 'covered' END AS bucket FROM supplier LEFT JOIN c ON source_id = s_suppkey")
def registry_coverage(spark, sf_dir):
    """How well sources are covered, by their items of one kind."""
    n = runs(spark, sf_dir).where("status = 'FAILED' and k < 12").groupBy("source_id").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "supplier").join(n, F.col("source_id") == F.col("s_suppkey"), "left")
    bucket = F.when(F.col("n").isNull(), "zero").when(F.col("n") < THIN, "thin").otherwise("covered")
    return rows.select(F.col("s_suppkey").alias("source_id"), F.coalesce("n", F.lit(0)).alias("n"), bucket.alias("bucket"))


@query(f"{N} SELECT kind, run_id FROM runs QUALIFY row_number() OVER (PARTITION BY kind ORDER BY run_id) <= 5")
def samples_per_class(spark, sf_dir):
    w = Window.partitionBy("kind").orderBy("run_id")
    return runs(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 5").select("kind", "run_id")


@query("SELECT greatest(0, after - before + cleared) AS newly_flagged FROM (SELECT count(*) FILTER (WHERE event_type = 'error') AS after, count(*) FILTER (WHERE event_type = 'view') AS before, count(*) FILTER (WHERE value > 50) AS cleared FROM events)")
def newly_flagged(spark, sf_dir):
    e = table(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") == "error").alias("a"), F.count_if(F.col("event_type") == "view").alias("b"), F.count_if(F.col("value") > 50).alias("c"))
    return e.select(F.greatest(F.lit(0), F.col("a") - F.col("b") + F.col("c")).alias("newly_flagged"))
