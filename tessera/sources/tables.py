"""The catalogue's tables over Parquet: items, provenance, run logs and the small dimensions they link to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators.columns import computed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items: title and summary are the first two sentences of a text, review status and activity come from its labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    # the text up to its first and second full stop; no more of it is taken apart
    docs = computed(docs, _one=F.substring_index("text", ".", 1), _two=F.substring_index("text", ".", 2))
    docs = computed(docs, _title=F.trim("_one"), _summary=F.trim(F.expr("substring(_two, length(_one) + 2)")))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("_title").alias("title"),
        F.col("_summary").alias("summary"),
        F.col("text").alias("body"),
        F.col("lang").alias("language"),
        "source",
        F.when(F.col("quality") == 0, "NEEDS_REVIEW").when(F.col("quality") == 1, "REVIEWED").otherwise("AUTO").alias("review_status"),
        (F.coalesce("toxic", F.lit(0)) == 0).alias("active"),
        F.when(F.col("n_chars") < 600, "ARTICLE").when(F.col("n_chars") < 3000, "PROJECT").otherwise("SOLUTION").alias("resource_type"),
        F.when(F.col("n_chars") < 1000, "IDEA").when(F.col("n_chars") < 2000, "PILOT").when(F.col("n_chars") < 4000, "DEPLOYED").otherwise("SCALED").alias("maturity"),
        (F.col("doc_id") % 25).cast("int").alias("nation_key"),
        (F.col("doc_id") % 10 + 1).alias("org_key"),
        (F.col("doc_id") % 200 + 1).alias("tech_key"),
    )


#: The same view for DuckDB, as a common table expression.
RESOURCES_SQL = """res AS (
  SELECT d.doc_id AS id, trim(split_part(text, '.', 1)) AS title, trim(split_part(text, '.', 2)) AS summary, text AS body, lang AS language, source,
    CASE WHEN quality = 0 THEN 'NEEDS_REVIEW' WHEN quality = 1 THEN 'REVIEWED' ELSE 'AUTO' END AS review_status,
    coalesce(toxic, 0) = 0 AS active,
    CASE WHEN n_chars < 600 THEN 'ARTICLE' WHEN n_chars < 3000 THEN 'PROJECT' ELSE 'SOLUTION' END AS resource_type,
    CASE WHEN n_chars < 1000 THEN 'IDEA' WHEN n_chars < 2000 THEN 'PILOT' WHEN n_chars < 4000 THEN 'DEPLOYED' ELSE 'SCALED' END AS maturity,
    CAST(d.doc_id % 25 AS INTEGER) AS nation_key, d.doc_id % 10 + 1 AS org_key, d.doc_id % 200 + 1 AS tech_key
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation_key, country, continent); 25 rows."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return joined.select(F.col("n_nationkey").cast("int").alias("nation_key"), F.col("n_name").alias("country"), F.col("r_name").alias("continent"))


LOCATIONS_SQL = "loc AS (SELECT CAST(n_nationkey AS INTEGER) AS nation_key, n_name AS country, r_name AS continent FROM nation JOIN region ON n_regionkey = r_regionkey)"


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, slug): the topics of items, one or two for each."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    slug = lambda n: F.concat(F.lit("topic-"), (F.col("id") % n).cast("string")).alias("slug")
    return d.select("id", slug(7)).unionByName(d.where("id % 3 = 0").select("id", slug(5))).distinct()


TOPICS_SQL = "topics AS (SELECT doc_id AS id, 'topic-' || doc_id % 7 AS slug FROM documents UNION SELECT doc_id, 'topic-' || doc_id % 5 FROM documents WHERE doc_id % 3 = 0)"


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id): items whose metadata says that they are grant records."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.where(F.get_json_object("props", "$.k").isin("1", "2")).select(F.col("event_id").alias("id"))


GRANTS_SQL = "grants AS (SELECT event_id AS id FROM events WHERE event_type = 'error' AND json_extract_string(props, '$.k') IN ('1', '2'))"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log: one row for each event, its source, start, status and counters."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("run_id"),
        (F.col("user_id") % 20).cast("int").alias("source_id"),
        F.col("ts").alias("started_at"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCEEDED").alias("status"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("items"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


RUNS_SQL = """runs AS (
  SELECT event_id AS run_id, CAST(user_id % 20 AS INTEGER) AS source_id, ts AS started_at, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
    event_type AS kind, value AS items, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""
