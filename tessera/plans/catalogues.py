"""Queries over stored answers of catalogues; here the answers are made of the documents, 75 numbers to a page."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.cluster import shared_dir
from tessera.operators import filters as flt
from tessera.operators.ranking import first_per_key
from tessera.plans.registry import query
from tessera.plans.search import data_version
from tessera.sources import catalogue
from tessera.sources.tables import table

PAGE = 75
STYLES = {"greens": {"style": "page", "method": "post"}, "grants": {"style": "offset"}, "feeds": {"style": "cursor"}}
_FOLDERS: dict[tuple, str] = {}


def _words() -> Column:
    """Some records speak of innovation, some of administration."""
    k = F.col("doc_id") % 4
    return F.when(k == 0, " An innovative product.").when(k == 1, " Work programme of a startup.").otherwise("")


def answers(spark: SparkSession, sf_dir: str) -> str:
    """A folder of stored answers of three catalogues; every 13th answer is cut short, and every record of the cursors'
    last answer comes twice."""
    key = (spark.sparkContext.applicationId, data_version(spark, f"{sf_dir}/documents.parquet"))
    if key in _FOLDERS:
        return _FOLDERS[key]
    d = table(spark, sf_dir, "documents").withColumn("page", F.floor(F.col("doc_id") / PAGE).cast("int") + 1)
    name = F.element_at(F.array(*map(F.lit, STYLES)), (F.col("doc_id") % 3 + 1).cast("int"))
    title = F.when(F.col("doc_id") % 17 == 0, " ").otherwise(F.substring_index("text", ".", 1))
    status = F.when(F.col("doc_id") % 11 == 0, 403).when(F.col("doc_id") % 19 == 0, 500)
    # a record comes again on the next page under the same number
    again = d.where("doc_id % 10 = 0").withColumn("page", F.col("page") + 1)
    d = d.unionByName(again).select(name.alias("catalogue"), "page", F.struct((F.col("doc_id") - F.col("doc_id") % 3).cast("string").alias("rcn"), F.col("doc_id").cast("string").alias("id"), title.alias("title"), F.concat(F.substring(F.translate("text", "\n", " "), 1, 200), _words()).alias("description"), F.col("source").alias("company"), status.alias("detail_status")).alias("item"))
    pages = d.groupBy("catalogue", "page").agg(F.sort_array(F.collect_list("item")).alias("items"))
    last = d.agg(F.max("page")).first()[0] or 0
    body = F.to_json(F.struct("items", F.when((F.col("catalogue") == "feeds") & (F.col("page") < last), F.col("page") + 1).alias("next")))
    body = F.when((F.col("page") % 13 == 0) & (F.col("catalogue") != "feeds"), F.substring(body, 1, 40)).otherwise(body)
    folder = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    pages.select("catalogue", "page", body.alias("value")).repartition("catalogue", "page").write.partitionBy("catalogue", "page").text(folder)
    _FOLDERS[key] = folder
    return folder


def records(spark: SparkSession, sf_dir: str, name: str, **more) -> DataFrame:
    return catalogue.read(spark, f"{answers(spark, sf_dir)}/catalogue={name}", catalogue=name, size=PAGE, **STYLES[name], **more)


_ITEM = f"""doc AS (SELECT doc_id, text, source, CAST(floor(doc_id / {PAGE}) AS INTEGER) + 1 AS page FROM documents UNION ALL SELECT doc_id, text, source, CAST(floor(doc_id / {PAGE}) AS INTEGER) + 2 FROM documents WHERE doc_id % 10 = 0),
item AS (SELECT doc_id, page, source, nullif(trim(regexp_replace(CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE split_part(text, '.', 1) END, '\\s+', ' ', 'g')), '') AS title,
  trim(regexp_replace(substr(translate(text, chr(10), ' '), 1, 200) || CASE doc_id % 4 WHEN 0 THEN ' An innovative product.' WHEN 1 THEN ' Work programme of a startup.' ELSE '' END, '\\s+', ' ', 'g')) AS summary,
  CASE WHEN doc_id % 11 = 0 THEN 403 WHEN doc_id % 19 = 0 THEN 500 ELSE 200 END AS status FROM doc)"""


@query(f"""WITH {_ITEM} SELECT page, CAST(doc_id AS VARCHAR) AS external_id, title, summary, status, status = 403 AS listing_only, CASE WHEN status = 500 THEN 'HTTP 500' WHEN title IS NULL THEN 'record has no title' END AS error FROM item WHERE doc_id % 3 = 0 AND page % 13 <> 0
UNION ALL SELECT DISTINCT page, NULL, NULL, NULL, NULL::INTEGER, false, 'unreadable page: JSONDecodeError' FROM item WHERE doc_id % 3 = 0 AND page % 13 = 0""")
def post_search_records(spark, sf_dir):
    """A catalogue asked by POST: every record, what was refused as its listing says it, and unreadable pages as errors."""
    return records(spark, sf_dir, "greens").select("page", "external_id", "title", "summary", "status", "listing_only", "error")


_SIGNS = "|".join(flt.INNOVATION_WORDS).replace("\\b", "\\b")
_VETOES = "|".join(flt.ADMIN_WORDS)


@query(f"""WITH {_ITEM}, ok AS (SELECT *, doc_id - doc_id % 3 AS project FROM item WHERE doc_id % 3 = 1 AND page % 13 <> 0 AND title IS NOT NULL AND status <> 500)
SELECT CAST(doc_id AS VARCHAR) AS external_id, min(page) AS page FROM ok WHERE regexp_matches(lower(title || ' ' || summary), '{_SIGNS}') AND NOT regexp_matches(lower(title || ' ' || summary), '{_VETOES}') GROUP BY doc_id""")
def grant_projects(spark, sf_dir):
    """An open-data catalogue by offsets: relevant projects, each once, from the first page that has it."""
    rows = records(spark, sf_dir, "grants").where("error is null")
    relevant = rows.where(F.size(flt.innovation_faults(F.concat_ws(" ", "title", "summary"))) == 0)
    return first_per_key(relevant, ["external_id"], [F.col("page")]).select("external_id", "page")


@query(f"WITH {_ITEM} SELECT page, count(*) AS records, count(title) AS titled, count(*) FILTER (WHERE status = 403) AS refused FROM item WHERE doc_id % 3 = 2 GROUP BY page")
def cursor_pages(spark, sf_dir):
    """A catalogue whose answers name the next one, followed to its end."""
    rows = records(spark, sf_dir, "feeds")
    return rows.groupBy("page").agg(F.count("*").alias("records"), F.count("title").alias("titled"), F.count_if("listing_only").alias("refused"))


@query(f"WITH {_ITEM} SELECT CAST(doc_id AS VARCHAR) AS external_id, page, 'https://grants.example/search?from=' || (page - 1) * {PAGE} || '&count={PAGE}' AS request FROM item WHERE doc_id % 3 = 1 AND page BETWEEN 2 AND 4 UNION ALL SELECT CAST(doc_id AS VARCHAR), page, 'https://grants.example/search?from=' || (page - 1) * {PAGE} || '&count={PAGE}' FROM item WHERE doc_id % 3 = 1 AND page = 9")
def catalogue_pages(spark, sf_dir):
    """Some pages of a catalogue: the reader opens these alone."""
    some = records(spark, sf_dir, "grants", first_page=2, last_page=4, pages_per_partition=2).unionByName(records(spark, sf_dir, "grants", first_page=9, last_page=9))
    return some.select("external_id", "page", "request")
