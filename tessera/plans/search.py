"""Hybrid search and browse: strict, any-term and semantic legs, fused, de-duplicated, capped, paged and shaped."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from tessera.cluster import shared_dir
from tessera.functions.stem import stem, stems, stems_sql
from tessera.functions.taxonomy import stage_rank
from tessera.operators import filters as flt, lexical, ranking, vectors
from tessera.operators.columns import computed
from tessera.operators.fulltext import FullTextIndex, Query
from tessera.operators.graph import GraphIndex
from tessera.plans.registry import query
from tessera.sources.tables import GRANTS_SQL, LOCATIONS_SQL, RESOURCES_SQL, TOPICS_SQL, grants, locations, resources, table, topics

SEMANTIC_POOL, BROWSE_POOL = 500, 500
RELAXED, STRICT = {"semantic": 3.5, "full_text": 1.0, "or_lexical": 0.2}, {"semantic": 1.25, "full_text": 1.0, "or_lexical": 0.65}
#: Weights of words in title, summary and body.
WEIGHTS = (1.0, 0.4, 0.2)


def lexical_pool(limit: int, sources: int = 0, diverse: bool = False) -> int:
    return min(200, max(8 * limit, 40, sources * (4 if diverse else 1)))


def browse_pool(limit: int) -> int:
    return min(BROWSE_POOL, max(5 * limit, 20))


def filtered(spark: SparkSession, sf_dir: str, filters: flt.SearchFilters | None) -> DataFrame:
    """Items that pass the filters; only the tables of facets that are set are read, and grants never show unasked."""
    f = filters or flt.SearchFilters()
    return flt.apply(resources(spark, sf_dir), f, locations(spark, sf_dir), topics(spark, sf_dir) if f.topics is not None else None, grants(spark, sf_dir))


def completeness(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """rows with ``miss``: how many of an image, an organisation and a long summary an item lacks."""
    rows = flt.existence_flag(rows, table(spark, sf_dir, "pages").select(F.col("page_id").alias("id")), "id", "image")
    rows = flt.existence_flag(rows, table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("org_key")), "org_key", "org")
    return rows.withColumn("miss", (~F.col("image")).cast("int") + (~F.col("org")).cast("int") + (F.length(F.trim("summary")) < 120).cast("int"))


def browse_order(filters: flt.SearchFilters, sort: str | None) -> list[Column]:
    if sort == "maturity":
        return [stage_rank(F.col("maturity")), F.desc("id")]
    if filters.quality == "relaxed":
        return [F.col("miss"), *flt.quality_order()]
    return flt.quality_order() if filters.quality else [F.desc("id")]


def browse(spark: SparkSession, sf_dir: str, filters: flt.SearchFilters | None = None, limit: int = 10, offset: int = 0, diverse: bool = False, sort: str | None = None) -> DataFrame:
    """(rank, id, score, lists, why, title, source): a search without words; with ``diverse`` one item of each source."""
    f = filters or flt.SearchFilters()
    rows = filtered(spark, sf_dir, f)
    rows = completeness(spark, sf_dir, rows) if f.quality == "relaxed" else rows.withColumn("miss", F.lit(0))
    top = ranking.pool(rows.select("id", "title", "summary", "source", "maturity", "miss"), browse_order(f, sort), browse_pool(limit))
    top = top.withColumn("score", 1.0 / F.col("rank")).withColumn("lists", F.array(F.lit("browse"))).withColumn("why", F.lit("browse"))
    kept = ranking.cap_per_key(top, "source", 1, [F.col("rank")]) if diverse else top
    page = ranking.pool(kept.drop("rank"), [F.desc("score")], offset + limit).where(F.col("rank") > offset)
    return page.select("rank", "id", "score", "lists", "why", "title", "source")


_INDEXES: dict[tuple, FullTextIndex] = {}


def data_version(spark: SparkSession, *paths: str) -> tuple:
    """Names, sizes and times of the files below some paths, by whatever file system holds them."""
    jvm, found = spark._jvm, []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def text_index(spark: SparkSession, sf_dir: str) -> FullTextIndex:
    """The index of the catalogue's texts; built once for each state of the tables that it is made of."""
    key = (spark.sparkContext.applicationId, data_version(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet"))
    if key not in _INDEXES:
        index = FullTextIndex(spark, f"{shared_dir(spark)}/text-index-{uuid.uuid4().hex}", dict(zip(("title", "summary", "body"), WEIGHTS)))
        _INDEXES[key] = index.add(resources(spark, sf_dir))
    return _INDEXES[key]


_GRAPHS: dict[tuple, GraphIndex] = {}


def vector_index(spark: SparkSession, sf_dir: str) -> GraphIndex:
    """The graphs of the catalogue's vectors of active items; built once for each state of the tables that they are made of."""
    key = (spark.sparkContext.applicationId, data_version(spark, f"{sf_dir}/embeddings.parquet", f"{sf_dir}/labels.parquet"))
    if key not in _GRAPHS:
        gone = table(spark, sf_dir, "labels").where("toxic <> 0").select(F.col("doc_id").alias("vec_id"))
        _GRAPHS[key] = GraphIndex.build(table(spark, sf_dir, "embeddings").join(gone, "vec_id", "left_anti"), f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}", "vec_id")
    return _GRAPHS[key]


def by_graph(spark: SparkSession, sf_dir: str) -> Callable[[Sequence[float], float, DataFrame], DataFrame]:
    """A semantic leg that walks the stored graphs, holding twice its pool."""
    return lambda v, bound, rows: vector_index(spark, sf_dir).nearest(v, SEMANTIC_POOL, bound, 2 * SEMANTIC_POOL, rows)


def indexed_rows(spark: SparkSession, sf_dir: str, index: FullTextIndex, f: flt.SearchFilters) -> DataFrame:
    """What the filters let through, from the index's own rows; the texts are read for a quality browse alone."""
    plain = replace(f, quality=None)
    rows = flt.apply(index.rows, plain, locations(spark, sf_dir), topics(spark, sf_dir) if f.topics is not None else None, grants(spark, sf_dir))
    return rows.join(filtered(spark, sf_dir, f).select("id"), "id", "left_semi") if f.quality else rows


def capped(hits: DataFrame, order: list[Column], limit: int, sources: list[str] | None, diversity: str | None, semantic: bool) -> DataFrame:
    """Hits under the cap that a search asks for: of a technology alone with ``mechanism``, one of a source with ``source``,
    and else a share of a source where there was no vector.  A choice of sources lifts every cap."""
    if sources:
        return hits
    if diversity == "mechanism":
        return ranking.cap_per_key(hits, "tech_key", ranking.bucket_cap(limit), order)
    if diversity == "source":
        return ranking.cap_per_key(hits, "source", 1, order)
    return hits if semantic else ranking.cap_per_key(hits, "source", ranking.source_cap(limit), order)


def search(
    spark: SparkSession,
    sf_dir: str,
    text: str = "",
    embedding: Sequence[float] | None = None,
    filters: flt.SearchFilters | None = None,
    limit: int = 10,
    offset: int = 0,
    max_distance: float = 0.42,
    diversity: str | None = None,
    sort: str | None = None,
    index: FullTextIndex | None = None,
    near: Callable[[Sequence[float], float, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(rank, id, score, lists, why, title, source): a page of the fused legs; without words a browse.

    The lexical legs read the stored index (the catalogue's own unless one is given) and no text.  ``diversity`` is
    ``source`` or ``mechanism``; ``sort`` orders the page by newest or maturity.  ``near(vector, bound, rows)`` may stand in
    for the exact search of the vectors, as (id, distance).
    """
    f = filters or flt.SearchFilters()
    if not text.strip():
        return browse(spark, sf_dir, f, limit, offset, bool(diversity), sort)
    index = index or text_index(spark, sf_dir)
    rows, size = indexed_rows(spark, sf_dir, index, f), lexical_pool(limit, len(f.sources or []), bool(diversity))
    hits = index.top(Query.parse(text), size, rows)
    relaxed = hits.where("strict").isEmpty()
    legs = lexical_legs(hits, size, least_terms(text, relaxed))
    if embedding:
        found = near(embedding, max_distance, rows) if near else vectors.nearest(table(spark, sf_dir, "embeddings"), embedding, SEMANTIC_POOL, max_distance, "vec_id", among=rows)
        legs["semantic"] = ranking.pool(found, [F.col("distance"), F.col("id")], SEMANTIC_POOL)
    fused = ranking.fuse(legs, RELAXED if relaxed else STRICT)
    shown = fused.join(rows.select("id", "title", "source", "org_key", "maturity", "tech_key"), "id")
    order = [F.desc("score"), F.col("id")]
    kept = ranking.dedupe_first_seen(shown, F.col("title"), F.col("org_key").cast("string"), order)
    page = ranking.pool(capped(kept, order, limit, f.sources, diversity, bool(embedding)), order, offset + limit).where(F.col("rank") > offset)
    if sort:
        page = page.withColumnRenamed("rank", "_fused")
        page = ranking.pool(page, [F.desc("id")] if sort == "newest" else [stage_rank(F.col("maturity")), F.col("_fused")], limit).withColumn("rank", F.col("rank") + offset)
    return page.select("rank", "id", "score", "lists", ranking.why_matched(F.col("lists")).alias("why"), "title", "source")


def least_terms(text: str, relaxed: bool) -> int:
    """How many words an any-term hit must hold."""
    return 2 if relaxed and len(lexical.or_words(text)) >= 4 else 1


def lexical_legs(hits: DataFrame, size: int, least: int) -> dict[str, DataFrame]:
    return {
        "full_text": ranking.pool(hits.where("strict"), [F.desc("density"), F.col("id")], size),
        "or_lexical": ranking.pool(hits.where(F.col("n") >= least), [F.desc("n"), F.col("id")], size),
    }


def search_total(spark: SparkSession, sf_dir: str, text: str, embedding: Sequence[float] | None = None, filters: flt.SearchFilters | None = None, max_distance: float = 0.42, index: FullTextIndex | None = None) -> dict[str, int]:
    """How many items a search matches at all: strictly, by enough words, or by distance.  The pass that makes the matches
    is observed; nothing is read a second time to count."""
    f, index = filters or flt.SearchFilters(), index or text_index(spark, sf_dir)
    rows = indexed_rows(spark, sf_dir, index, f)
    query = Query.parse(text)
    hits = index.hits(query, rows).select("id", "strict", "n") if query.stems else spark.createDataFrame([], "id long, strict boolean, n int")
    if embedding:
        near = vectors.within(table(spark, sf_dir, "embeddings"), embedding, max_distance, "vec_id").join(rows.select("id"), "id", "left_semi").select("id", F.lit(True).alias("near"))
        hits = hits.join(near, "id", "full")
    else:
        hits = hits.withColumn("near", F.lit(False))
    seen, is_ = Observation(), lambda c: F.coalesce(c, F.lit(False))
    strict, close = is_(F.col("strict")), is_(F.col("near"))
    counts = {"strict": F.count_if(strict), "semantic": F.count_if(close), **{f"any_{k}": F.count_if(is_(F.col("n") >= k)) for k in (1, 2)}, **{f"total_{k}": F.count_if(strict | close | is_(F.col("n") >= k)) for k in (1, 2)}}
    hits.observe(seen, *[c.alias(name) for name, c in counts.items()]).write.format("noop").mode("overwrite").save()
    got = seen.get
    least = least_terms(text, not got["strict"])
    return {"filtered_total": got[f"total_{least}"], "strict": got["strict"], "any_term": got[f"any_{least}"], "semantic": got["semantic"]}


def similar(spark: SparkSession, sf_dir: str, key: int, limit: int = 10, country: str | None = None) -> DataFrame:
    """(id, distance, rank, score): nearest other items, of one country if given."""
    origin = vectors.of(table(spark, sf_dir, "embeddings"), key)
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id") != key)
    if country:
        own = locations(spark, sf_dir).where(F.upper("country") == country.upper())
        rows = rows.withColumn("nation_key", (F.col("vec_id") % 25).cast("int")).join(F.broadcast(own), "nation_key", "left_semi")
    top = ranking.pool(vectors.nearest(rows, origin, limit, None, "vec_id"), [F.col("distance"), F.col("id")], limit)
    return top.withColumn("score", 1.0 / (60 + F.col("rank")))


def _terms_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda x: x <> '')"


_DIST = "1 - list_dot_product(e.embedding::DOUBLE[], q.v) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v)))"


def _search_sql(words: str, limit: int = 10, offset: int = 0, vector: bool = False, cap: str | None = None, where: str = "", order: str = "score DESC, id", pool: int | None = None, name: str = "page") -> str:
    """DuckDB SQL of a search for one or two words that are no stop words; of more, density is not told apart."""
    own, pool = words.split(), pool or lexical_pool(limit)
    n = len(own)
    cap = cap if cap is not None else "" if vector else _by_source(ranking.source_cap(limit))
    semantic = f"UNION ALL SELECT id, CASE WHEN relaxed THEN 3.5 ELSE 1.25 END / (60 + rank), 'semantic' FROM c, rel" if vector else ""
    density = "list_sum(list_transform(range(1, len(s)), lambda i: CASE WHEN s[i].k <> s[i + 1].k THEN 2 / (1 / s[i].w + 1 / s[i + 1].w) / (s[i + 1].p - s[i].p + 1) ELSE 0.0 END))" if n == 2 else "list_sum(list_transform(s, lambda v: v.w))"
    return f"""
WITH {RESOURCES_SQL}, {LOCATIONS_SQL}, {GRANTS_SQL}, {TOPICS_SQL}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7),
act AS (SELECT * FROM res WHERE active AND id NOT IN (SELECT id FROM grants) {where}),
tok AS (SELECT id, {_terms_sql('title')} AS t, {_terms_sql('summary')} AS u, {_terms_sql('body')} AS b FROM act),
pos AS (SELECT id, unnest(t || u || b) AS x, unnest(range(1, len(t || u || b) + 1)) AS p, len(t) AS n1, len(u) AS n2 FROM tok),
words AS (SELECT unnest([{', '.join(map(repr, own))}]) AS x, unnest(range({n})) AS k),
voc AS (SELECT x FROM pos UNION SELECT x FROM words),
{stems_sql('voc')},
forms AS (SELECT a.x, k FROM stemmed a JOIN (SELECT s, min(k) AS k FROM stemmed JOIN words USING (x) GROUP BY s) b ON a.s = b.s),
spotk AS (SELECT id, list(struct_pack(k := k, p := p, w := CASE WHEN p <= n1 THEN 1.0 WHEN p <= n1 + n2 THEN 0.4 ELSE 0.2 END::DOUBLE) ORDER BY p) AS s FROM pos JOIN forms USING (x) GROUP BY id),
hit AS (SELECT id, len(list_distinct(list_transform(s, lambda y: y.k))) AS n, round(coalesce({density}, 0.0), 9) AS density FROM spotk),
rel AS (SELECT NOT coalesce(bool_or(n = {n}), false) AS relaxed FROM hit),
a AS (SELECT id, row_number() OVER (ORDER BY density DESC, id) AS rank, density FROM hit WHERE n = {n} QUALIFY rank <= {pool}),
b AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) AS rank, n FROM hit, rel WHERE n >= CASE WHEN relaxed AND {n} >= 4 THEN 2 ELSE 1 END QUALIFY rank <= {pool}),
near AS (SELECT e.vec_id AS id, {_DIST} AS d FROM embeddings e, q WHERE {_DIST} <= 0.9 AND e.vec_id IN (SELECT id FROM act) ORDER BY d, id LIMIT 500),
c AS (SELECT id, row_number() OVER (ORDER BY d, id) AS rank FROM near),
fused AS (SELECT id, round(sum(w), 12) AS score, list_sort(list(DISTINCT leg)) AS lists FROM (
  SELECT id, 1.0 / (60 + rank) AS w, 'full_text' AS leg FROM a UNION ALL SELECT id, CASE WHEN relaxed THEN 0.2 ELSE 0.65 END / (60 + rank), 'or_lexical' FROM b, rel {semantic}) GROUP BY id),
shown AS (SELECT f.*, title, source, org_key, maturity, tech_key, concat_ws('|', trim(regexp_replace(lower(title), '\\s+', ' ', 'g')), CAST(org_key AS VARCHAR)) AS k FROM fused f JOIN act USING (id)),
uniq AS (SELECT * FROM shown QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, id) = 1),
capped AS (SELECT * FROM uniq {cap}),
page AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM capped QUALIFY rank > {offset} AND rank <= {offset + limit}),
legs AS (SELECT 'full_text' AS leg, rank, id, density AS score FROM a UNION ALL SELECT 'or_lexical', rank, id, n FROM b),
page_out AS (SELECT row_number() OVER (ORDER BY {order}) + {offset} AS rank, id, score, array_to_string(lists, ',') AS lists,
  CASE WHEN list_contains(lists, 'semantic') AND (list_contains(lists, 'full_text') OR list_contains(lists, 'or_lexical')) THEN 'full_text+semantic' WHEN list_contains(lists, 'semantic') THEN 'semantic' ELSE 'full_text' END AS why, title, source FROM page)
SELECT * FROM {'page_out' if name == 'page' else name}"""


def _by_source(most: int) -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, id) <= {most}"


def _flat(found: DataFrame) -> DataFrame:
    return found.withColumn("lists", F.array_join("lists", ","))


@query(_search_sql("thin thing", vector=True))
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: words and a vector together, both from stored indexes."""
    v = vectors.of(table(spark, sf_dir, "embeddings"), 7)
    return _flat(search(spark, sf_dir, "thin thing", v, max_distance=0.9, near=by_graph(spark, sf_dir)))


@query(_search_sql("thin thing zyzzyva quokka", vector=True))
def search_relaxed(spark, sf_dir):
    """No item holds all four words: two of them are asked for, and the vector weighs more."""
    v = vectors.of(table(spark, sf_dir, "embeddings"), 7)
    return _flat(search(spark, sf_dir, "thin thing zyzzyva quokka", v, max_distance=0.9))


@query(_search_sql("thin thing", limit=5, offset=5))
def search_page_2(spark, sf_dir):
    return _flat(search(spark, sf_dir, "thin thing", limit=5, offset=5))


@query(_search_sql("thin thing", order="id DESC"))
def search_newest(spark, sf_dir):
    """The page of a search, newest first."""
    return _flat(search(spark, sf_dir, "thin thing", sort="newest"))


@query(_search_sql("thin thing", cap=_by_source(1)))
def search_diverse(spark, sf_dir):
    """One item of a source."""
    return _flat(search(spark, sf_dir, "thin thing", diversity="source"))


@query(_search_sql("thin thing", limit=20, vector=True, cap="QUALIFY row_number() OVER (PARTITION BY tech_key ORDER BY score DESC, id) <= 4"))
def search_mechanisms(spark, sf_dir):
    """Of a technology a fifth of the page at most, sources being free, with a vector too."""
    v = vectors.of(table(spark, sf_dir, "embeddings"), 7)
    return _flat(search(spark, sf_dir, "thin thing", v, max_distance=0.9, limit=20, diversity="mechanism"))


@query(_search_sql("thin thing", cap="", where="AND source IN ('src1', 'src4')"))
def search_of_sources(spark, sf_dir):
    """A choice of sources lifts the caps, the asked diversity too."""
    return _flat(search(spark, sf_dir, "thin thing", filters=flt.SearchFilters(sources=["src1", "src4"]), diversity="source"))


@query(_search_sql("thin thing", where="AND id IN (SELECT id FROM topics WHERE slug IN ('topic-2', 'topic-4')) AND nation_key IN (SELECT nation_key FROM loc WHERE continent IN ('AFRICA', 'ASIA'))"))
def search_by_topic(spark, sf_dir):
    return _flat(search(spark, sf_dir, "thin thing", filters=flt.SearchFilters(topics=["topic-2", "topic-4"], continent_slugs=["africa", "asia"])))


@query(_search_sql("thin thing", name="legs"))
def index_search(spark, sf_dir):
    """The lexical legs of a search, from the stored index alone."""
    f, size = flt.SearchFilters(), lexical_pool(10)
    index = text_index(spark, sf_dir)
    legs = lexical_legs(index.top(Query.parse("thin thing"), size, indexed_rows(spark, sf_dir, index, f)), size, 1)
    return legs["full_text"].select(F.lit("full_text").alias("leg"), "rank", "id", F.col("density").alias("score")).unionByName(legs["or_lexical"].select(F.lit("or_lexical").alias("leg"), "rank", "id", F.col("n").cast("double").alias("score")))


_FORMS = ["ending", "ended", "ends", "Things", "generation", "generously"]


@query(f"""WITH {RESOURCES_SQL}, tok AS (SELECT id, {_terms_sql('body')} AS t FROM res), pos AS (SELECT id, unnest(t) AS x FROM tok), words AS (SELECT lower(w) AS x, w FROM (SELECT unnest([{', '.join(f"'{w}'" for w in _FORMS)}]) AS w)), voc AS (SELECT x FROM pos UNION SELECT x FROM words), {stems_sql('voc')}
SELECT w AS word, b.s AS stem, count(*) AS n, count(DISTINCT pos.id) AS docs FROM words JOIN stemmed b ON b.x = words.x JOIN stemmed a ON a.s = b.s JOIN pos ON pos.x = a.x GROUP BY ALL""")
def stemmed_search(spark, sf_dir):
    """How often forms of a word occur in bodies: both sides are stemmed."""
    words = spark.createDataFrame([(w,) for w in _FORMS], "word string").withColumn("stem", stems(F.lower("word")))
    found = text_index(spark, sf_dir).postings([stem(w.lower()) for w in _FORMS]).select("stem", F.explode("docs").alias("d"))
    body = found.select("stem", "d.id", F.size(F.filter("d.spots", lambda x: x["weight"] == WEIGHTS[2])).alias("n")).where("n > 0")
    return body.groupBy("stem").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).join(F.broadcast(words), "stem").select("word", "stem", "n", "docs")


@query(f"""WITH {RESOURCES_SQL}, {GRANTS_SQL}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7), act AS (SELECT * FROM res WHERE active AND id NOT IN (SELECT id FROM grants)),
tok AS (SELECT id, {_terms_sql("concat_ws(' ', title, summary, body)")} AS t FROM act), pos AS (SELECT id, unnest(t) AS x FROM tok), words AS (SELECT unnest(['thin', 'thing']) AS x), voc AS (SELECT x FROM pos UNION SELECT x FROM words), {stems_sql('voc')},
hit AS (SELECT id, count(DISTINCT a.s) AS n FROM pos JOIN stemmed a ON a.x = pos.x WHERE a.s IN (SELECT s FROM stemmed JOIN words USING (x)) GROUP BY id),
near AS (SELECT vec_id AS id FROM embeddings e, q WHERE {_DIST} <= 0.8 AND vec_id IN (SELECT id FROM act))
SELECT (SELECT count(*) FROM (SELECT id FROM hit UNION SELECT id FROM near)) AS filtered_total, (SELECT count(*) FROM hit WHERE n = 2) AS strict, (SELECT count(*) FROM hit) AS any_term, (SELECT count(*) FROM near) AS semantic""")
def search_totals(spark, sf_dir):
    """What a search matches in all, counted in the pass that makes its matches."""
    got = search_total(spark, sf_dir, "thin thing", vectors.of(table(spark, sf_dir, "embeddings"), 7), max_distance=0.8)
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{k} long" for k in got))


def _browse_sql(order: str, pool: int, limit: int, offset: int, cap: str, where: str = "") -> str:
    return f"""WITH {RESOURCES_SQL}, {GRANTS_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY {order}) AS r FROM res WHERE active AND id NOT IN (SELECT id FROM grants) {where} QUALIFY r <= {pool}),
k AS (SELECT * FROM p {cap}) SELECT row_number() OVER (ORDER BY r) AS rank, id, round(1.0 / r, 9) AS score, title, source FROM k QUALIFY rank > {offset} AND rank <= {offset + limit}"""


@query(_browse_sql("id DESC", 50, 10, 0, ""))
def browse_blank(spark, sf_dir):
    """A search without words is a browse, newest first."""
    return search(spark, sf_dir, " ").select("rank", "id", F.round("score", 9).alias("score"), "title", "source")


@query(_browse_sql("CASE maturity WHEN 'SCALED' THEN 0 WHEN 'DEPLOYED' THEN 1 WHEN 'PILOT' THEN 2 ELSE 3 END, id DESC", 100, 20, 0, "QUALIFY row_number() OVER (PARTITION BY source ORDER BY r) = 1"))
def browse_diverse(spark, sf_dir):
    """One item of each source, the most mature first."""
    return browse(spark, sf_dir, limit=20, diverse=True, sort="maturity").select("rank", "id", F.round("score", 9).alias("score"), "title", "source")


@query(f"WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 3) SELECT row_number() OVER (ORDER BY d, id) AS rank, id, round(d, 9) AS distance FROM (SELECT vec_id AS id, {_DIST} AS d FROM embeddings e, q WHERE vec_id <> 3) QUALIFY rank <= 10")
def similar_topk(spark, sf_dir):
    return similar(spark, sf_dir, 3).select("rank", "id", F.round("distance", 9).alias("distance"))


@query(f"WITH {LOCATIONS_SQL}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 3) SELECT row_number() OVER (ORDER BY d, id) AS rank, id, round(d, 9) AS distance FROM (SELECT vec_id AS id, {_DIST} AS d FROM embeddings e, q WHERE vec_id <> 3 AND vec_id % 25 IN (SELECT nation_key FROM loc WHERE country = 'NATION_4')) QUALIFY rank <= 10")
def similar_with_country(spark, sf_dir):
    return similar(spark, sf_dir, 3, country="nation_4").select("rank", "id", F.round("distance", 9).alias("distance"))


@query(f"""WITH {RESOURCES_SQL}, v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS id, 1 - list_dot_product(q.e, c.e) / (q.n * c.n) AS d FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 AND c.vec_id IN (SELECT id FROM res WHERE active))
SELECT query_id, id, round(d, 9) AS distance FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, id) <= 10""")
def graph_neighbours(spark, sf_dir):
    """The ten nearest active items of some items' vectors, by a beam that holds a thousand nodes of each graph."""
    e = table(spark, sf_dir, "embeddings")
    found = vector_index(spark, sf_dir).search(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")), 11, 1000, resources(spark, sf_dir).where("active").select("id"))
    others = found.where("id <> query_id").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    return others.where("n <= 10").select("query_id", "id", F.round("distance", 9).alias("distance"))


@query(f"WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 3) SELECT vec_id AS id, round({_DIST}, 9) AS distance FROM embeddings e, q WHERE {_DIST} <= 0.8")
def semantic_threshold(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    near = e.where(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("id"), vectors.cosine_distance(F.col("embedding"), F.array(*map(F.lit, vectors.of(e, 3)))).alias("distance"))
    return near.where("distance <= 0.8").select("id", F.round("distance", 9).alias("distance"))


@query("SELECT len(embedding) AS dims, count(*) AS n, count(embedding) AS present FROM embeddings GROUP BY 1")
def embedding_dims_check(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy(F.size("embedding").cast("long").alias("dims")).agg(F.count("*").alias("n"), F.count("embedding").alias("present"))


_TOK = f"WITH {RESOURCES_SQL}, tok AS (SELECT id, {_terms_sql('body')} AS t FROM res WHERE active)"


@query(f"{_TOK} SELECT id, CAST(list_contains(t, 'that') AS INT) + CAST(list_contains(t, 'der') AS INT) + CAST(list_contains(t, 'les') AS INT) AS n FROM tok WHERE n >= 1")
def or_term_match(spark, sf_dir):
    rows = resources(spark, sf_dir).where("active")
    return rows.select("id", lexical.or_count(lexical.terms(F.col("body")), lexical.or_words("that der les")).alias("n")).where("n >= 1")


@query(f"{_TOK} SELECT id, len(list_filter(t, lambda x: x IN ('that', 'with'))) AS tf FROM tok WHERE list_contains(t, 'that') AND list_contains(t, 'with')")
def strict_terms(spark, sf_dir):
    t = lexical.terms(F.col("body"))
    rows = resources(spark, sf_dir).where("active").where(lexical.matches(t, lexical.parse_query("that with")))
    return rows.select("id", lexical.occurrences(t, ["that", "with"]).cast("long").alias("tf"))


@query(f"""{_TOK} SELECT id FROM tok WHERE (contains(' ' || array_to_string(t, ' ') || ' ', ' of the ') AND NOT list_contains(t, 'with')) OR list_contains(t, 'der')""")
def phrase_or_not(spark, sf_dir):
    """The query grammar: a phrase without a word, or another word."""
    return resources(spark, sf_dir).where("active").where(lexical.matches(lexical.terms(F.col("body")), lexical.parse_query('"of the" -with or der'))).select("id")


@query(f"""{_TOK}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7), near AS (SELECT vec_id AS id FROM embeddings e, q WHERE {_DIST} <= 0.8)
SELECT count(*) AS total, count(*) FILTER (WHERE s) AS strict, count(*) FILTER (WHERE o) AS any_term, count(*) FILTER (WHERE v) AS semantic
FROM (SELECT list_contains(t, 'that') AND list_contains(t, 'with') AS s, list_contains(t, 'that') OR list_contains(t, 'with') AS o, id IN (SELECT id FROM near) AS v FROM tok) WHERE s OR o OR v""")
def match_total(spark, sf_dir):
    """One pass: rows that any leg matches, independent of pools and caps."""
    e, t = table(spark, sf_dir, "embeddings"), lexical.terms(F.col("body"))
    near = e.select(F.col("vec_id").alias("id"), (vectors.cosine_distance(F.col("embedding"), F.array(*map(F.lit, vectors.of(e, 7)))) <= 0.8).alias("v"))
    rows = resources(spark, sf_dir).where("active").join(near, "id", "left")
    flags = rows.select(lexical.matches(t, lexical.parse_query("that with")).alias("s"), (lexical.or_count(t, ["that", "with"]) >= 1).alias("o"), F.coalesce("v", F.lit(False)).alias("v"))
    return flags.agg(*[F.count_if(c).alias(n) for c, n in ((F.col("s") | F.col("o") | F.col("v"), "total"), (F.col("s"), "strict"), (F.col("o"), "any_term"), (F.col("v"), "semantic"))])


@query(f"""WITH {RESOURCES_SQL}, tok AS (SELECT id, {_terms_sql('body')} AS t FROM res WHERE active), s AS (SELECT id, list_filter(list_transform(range(1, len(t) + 1), lambda i: struct_pack(x := t[i], p := i)), lambda y: y.x IN ('that', 'with')) AS s FROM tok WHERE list_contains(t, 'that') AND list_contains(t, 'with'))
SELECT id, round(list_sum(list_transform(range(1, len(s)), lambda i: CASE WHEN s[i].x <> s[i + 1].x THEN 1.0 / (s[i + 1].p - s[i].p + 1) ELSE 0.0 END)), 9) AS density FROM s""")
def cover_density(spark, sf_dir):
    """Cover density of two words: their neighbouring places of different words are the shortest covers."""
    rows = resources(spark, sf_dir).where("active").select("id", lexical.terms(F.col("body")).alias("t"))
    found = computed(rows.where(F.array_contains("t", "that") & F.array_contains("t", "with")), spots=lexical.spots([(F.col("t"), 1.0)], [["that"], ["with"]]))
    return found.select("id", F.round(lexical.density(F.col("spots"), 2), 9).alias("density"))


@query(f"{_TOK} SELECT term, count(DISTINCT id) AS docs, count(*) AS n FROM (SELECT id, unnest(t) AS term FROM tok) GROUP BY term")
def inverted_index_totals(spark, sf_dir):
    return lexical.term_totals(resources(spark, sf_dir).where("active"), F.col("body"))


@query(f"""WITH {RESOURCES_SQL}, e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE vec_id IN (SELECT id FROM res WHERE active))
SELECT a.id AS a, b.id AS b, round(1 - list_dot_product(a.v, b.v) / (a.n * b.n), 9) AS distance FROM e a JOIN e b ON a.id < b.id WHERE 1 - list_dot_product(a.v, b.v) / (a.n * b.n) < 0.2""")
def semantic_duplicates(spark, sf_dir):
    """Pairs of active items nearer than a bound, by pivots; nothing is compared with everything."""
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id").join(resources(spark, sf_dir).where("active").select("id"), "id", "left_semi")
    return vectors.near_pairs(e, 0.2).select("a", "b", F.round("distance", 9).alias("distance"))


def approaches(spark: SparkSession, sf_dir: str, key: int, text: str, limit: int, embedding: Sequence[float] | None = None, max_distance: float = 0.42) -> DataFrame:
    """(rank, id, score, title): other items that a search for an item's text finds, few of one technology."""
    found = search(spark, sf_dir, text, embedding, limit=limit + 2, max_distance=max_distance, diversity="mechanism")
    return ranking.pool(found.where(F.col("id") != key).withColumnRenamed("rank", "_rank"), [F.col("_rank")], limit).select("rank", "id", "score", "title")


@query(_search_sql("thin thing", limit=8, cap="QUALIFY row_number() OVER (PARTITION BY tech_key ORDER BY score DESC, id) <= 2").replace("SELECT * FROM page_out", "SELECT n AS rank, id, score, title FROM (SELECT *, row_number() OVER (ORDER BY rank) AS n FROM page_out WHERE id <> (SELECT min(id) FROM page_out)) WHERE n <= 6"))
def different_approaches(spark, sf_dir):
    """Other approaches to what an item is about; here the item is one that its own search finds."""
    own = search(spark, sf_dir, "thin thing", limit=8, diversity="mechanism").agg(F.min("id")).first()[0]
    return approaches(spark, sf_dir, -1 if own is None else own, "thin thing", 6)
