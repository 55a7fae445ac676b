"""Audits, repairs and drafts over whole tables, and the library's named browses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import geography as G, repair as R, taxonomy as X, text as T
from tessera.functions.stem import stem, stems_sql
from tessera.operators import filters as flt, fulltext, lexical
from tessera.operators.columns import computed
from tessera.operators.merge import merge_names
from tessera.operators.ranking import pool
from tessera.plans.browse import _BROWSE
from tessera.plans.registry import query
from tessera.plans.search import _search_sql, _terms_sql, browse, filtered, search
from tessera.plans.writes import _cases, _expected
from tessera.sources.tables import GRANTS_SQL, LOCATIONS_SQL, RESOURCES_SQL, TOPICS_SQL, locations, resources, table, topics

_RES = f"WITH {RESOURCES_SQL}"
_CAPS = "(length(regexp_replace(title, '[^A-Za-z]', '', 'g')) > 6 AND upper(title) = title AND regexp_matches(title, '[A-Z]'))"

# Kinds of items, and states of a source, the best first.
TYPES = ["SOLUTION", "PROJECT", "PRODUCT", "ARTICLE", "ORGANISATION", "PROGRAMME"]
STATUSES = ["OK", "DEGRADED", "BLOCKED", "PAUSED", "UNKNOWN"]


def ordinal(value: Column, names: list[str]) -> Column:
    """The place of a value in an order, from 1; what is not in it comes last."""
    at = F.array_position(F.array(*map(F.lit, names)), value)
    return F.when(at > 0, at).otherwise(len(names)).cast("int")


def one_of(value: Column, names: list[str], default: str) -> Column:
    up = F.upper(value)
    return F.when(up.isin(names), up).otherwise(default)


def drafts(rows: DataFrame) -> DataFrame:
    """Normalised drafts of raw records (title, url, external_id, summary, body, type, stage, country, image, language);
    ``fault`` says why a record makes none."""
    c, text = F.col, lambda x, most: T.truncate_words(F.coalesce(x, F.lit("")), most)
    url = T.canonical_url(c("url"))
    return rows.select(
        "external_id", url.alias("url"), text(c("title"), 300).alias("title"), text(c("summary"), 500).alias("summary"),
        text(F.coalesce(F.nullif(c("body"), F.lit("")), T.truncate_words(F.coalesce(c("summary"), F.lit("")), 500)), 1500).alias("body"),
        one_of(c("type"), TYPES, "SOLUTION").alias("type"), one_of(c("stage"), X.STAGE_ORDER, "UNKNOWN").alias("stage"), "country", G.country_code(c("country")).alias("code"),
        T.canonical_url(c("image")).alias("image"), F.coalesce("language", F.lit("en")).alias("language"), F.when(url.isNull(), "bad_url").alias("fault"),
    )


_RAW = [
    ("A pump", "https://a.example/x/?utm_source=q", "s", "", "project", "pilot", "Kenya", "https://i.example/a.png#f", None, "https://a.example/x", "s", "PROJECT", "PILOT", "KE", "https://i.example/a.png", "en", None),
    ("A pump", "no address", None, "b", "thing", "done", "Atlantis", "data:x", "fr", None, "b", "SOLUTION", "UNKNOWN", None, None, "fr", "bad_url"),
]


@query(f"SELECT p_partkey AS key, {_expected(_RAW, {'url': 9, 'body': 10, 'type': 11, 'stage': 12, 'code': 13, 'image': 14, 'language': 15, 'fault': 16})} FROM part")
def draft_builder(spark, sf_dir):
    """Drafts of raw records; the SQL holds what each field becomes, worked out by hand."""
    rows = _cases(spark, sf_dir, _RAW, ["title", "url", "summary", "body", "type", "stage", "country", "image", "language"]).withColumnRenamed("key", "external_id")
    return drafts(rows).select(F.col("external_id").alias("key"), "url", "body", "type", "stage", "code", "image", "language", "fault")


@query("SELECT p_partkey AS key, [1, 2, 3, 4, 5, 6, 7, 7][p_partkey % 8 + 1] AS stage, [1, 2, 3, 4, 5, 5, 5, 5][p_partkey % 8 + 1] AS status FROM part")
def ordinals(spark, sf_dir):
    """Seven levels of maturity and five states of a source as numbers."""
    at = (F.col("p_partkey") % 8 + 1).cast("int")
    pick = lambda names: F.element_at(F.array(*map(F.lit, [*names, *["other"] * (8 - len(names))])), at)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), ordinal(pick(X.STAGE_ORDER), X.STAGE_ORDER).alias("stage"), ordinal(pick(STATUSES), STATUSES).alias("status"))


@query(f"""{_RES} SELECT id FROM res WHERE active AND review_status NOT IN ('NEEDS_REVIEW', 'ARCHIVED', 'SOURCE_LIMITED') AND length(trim(summary)) >= 40 AND {_BROWSE.format(least=80)} AND NOT {_CAPS}
  AND org_key NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 = 0)""")
def quality_browse_full(spark, sf_dir):
    """The strict public browse with its status rule, its least summary, and no item whose first organisation is a legal form."""
    rows = resources(spark, sf_dir).where("active and review_status not in ('NEEDS_REVIEW', 'ARCHIVED', 'SOURCE_LIMITED')").where(F.length(F.trim("summary")) >= 40)
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("org_key"), F.when(F.col("s_suppkey") % 4 == 0, "Non-profit").otherwise(F.col("s_name")).alias("name"))
    return rows.where(flt.quality_browse(relaxed=False)).join(names.where(T.legal_form(F.col("name"))), "org_key", "left_anti").select("id")


_ORGS = ["b-corp", "They sell pumps to farms.", "Water works", "", "A name of an organisation that goes on for nine words"]
_PEOPLE = ["J", "x y z", "A. Name", "", "Jane Roe"]
# real items, some of them with a title, a summary or a body as it goes wrong, and with people and organisations of all kinds
_GATED = f"""{_RES}, g AS (SELECT id, review_status, CASE id % 9 WHEN 0 THEN 'Contact' WHEN 1 THEN left(title, 14) WHEN 2 THEN 'HOME PAGE OF ' || id WHEN 3 THEN trim(left(body, 60)) ELSE title END AS title, CASE id % 5 WHEN 0 THEN left(summary, 30) WHEN 3 THEN trim(left(body, 60)) ELSE summary END AS summary, CASE WHEN id % 4 = 0 THEN '' ELSE body END AS body,
  {_PEOPLE}[id % 5 + 1] AS person, {_ORGS}[(id // 5) % 5 + 1] AS org, id % 3 = 0 AS cohort FROM res)"""


def _squeezed(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _gate_sql(person: bool) -> str:
    """The gate's codes as a list, said in SQL over title, summary, body, person, org and cohort."""
    last = f"string_split({_squeezed('trim(title)')}, ' ')[-1]"
    blocked = ", ".join(repr(t) for t in T.BLOCKED_TITLES)
    words = f"len(string_split({_squeezed('trim(org)')}, ' '))"
    rules = [
        ("thin", "short_description"),
        ("blocked", "blocklist_title"),
        ("length(regexp_replace(title, '[^A-Z]', '', 'g')) > 0.75 * length(regexp_replace(title, '[^A-Za-z]', '', 'g')) AND length(trim(title)) > 6", "all_caps_title"),
        (f"length(trim(title)) < 4 OR (length({last}) <= 3 AND NOT regexp_matches(trim(title), '[.!?]$') AND length(trim(title)) < 25) OR regexp_matches(trim(title), '(?i)websit$')", "truncated_title"),
    ]
    if person:
        rules += [
            ("trim(person) <> '' AND (length(trim(person)) < 3 OR regexp_matches(trim(person), '(?i)^[a-z](\\s+[a-z]){0,2}$'))", "suspicious_person_name"),
            (f"regexp_matches(org, '{T.any_of(T.GATE_LEGAL_FORMS)}')", "legal_form_org_name"),
            (f"trim(org) <> '' AND (length(trim(org)) < 2 OR (regexp_matches(trim(org), '[.!?]$') AND {words} >= 4) OR {words} > 8 OR (regexp_matches(trim(org), '(?i){T.SENTENCE_START}') AND {words} >= 3) OR (regexp_matches(trim(org), '(?i){T.AUXILIARY}') AND {words} >= 5))", "invalid_org_name"),
            ("cohort AND thin", "listing_only_thin"),
            ("cohort AND trim(title) <> '' AND trim(title) = trim(summary)", "cohort_title_equals_summary"),
            (f"cohort AND (blocked OR length({_squeezed('title')}) < 3 OR regexp_matches({_squeezed('title')}, '(?i){T.BOILERPLATE_TITLE}'))", "cohort_boilerplate_title"),
        ]
    listed = ", ".join(f"CASE WHEN {rule} THEN '{code}' END" for rule, code in rules)
    return f"""judged AS (SELECT *, (CASE WHEN trim(body) <> '' AND trim(body) <> trim(summary) THEN greatest(length(trim(summary)), length(trim(body))) ELSE length(trim(summary)) END) < 80 AS thin,
  lower(trim(title)) IN ({blocked}) OR trim(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', ' ', 'g')) IN ({blocked}) AS blocked FROM g),
gate AS (SELECT *, list_filter([{listed}], lambda x: x IS NOT NULL) AS reasons FROM judged)"""


def _gated(spark, sf_dir) -> DataFrame:
    k, lead = F.col("id"), F.trim(F.left("body", F.lit(60)))
    title = F.when(k % 9 == 0, "Contact").when(k % 9 == 1, F.left("title", F.lit(14))).when(k % 9 == 2, F.concat(F.lit("HOME PAGE OF "), k.cast("string"))).when(k % 9 == 3, lead).otherwise(F.col("title"))
    summary = F.when(k % 5 == 0, F.left("summary", F.lit(30))).when(k % 5 == 3, lead).otherwise(F.col("summary"))
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % 5 + 1).cast("int"))
    return resources(spark, sf_dir).select(
        "id", "review_status", title.alias("title"), summary.alias("summary"), F.when(k % 4 == 0, "").otherwise(F.col("body")).alias("body"),
        pick(_PEOPLE, k).alias("person"), pick(_ORGS, F.floor(k / 5)).alias("org"), (k % 3 == 0).alias("cohort"),
    )


@query(f"{_GATED}, {_gate_sql(True)} SELECT id, array_to_string(reasons, ',') AS reasons FROM gate")
def gate_all_codes(spark, sf_dir):
    """All ten reason codes in their order, of whole items."""
    c = F.col
    reasons = T.quality_reasons(c("title"), c("summary"), c("body"), c("person"), c("org"), c("cohort"))
    return _gated(spark, sf_dir).select("id", F.array_join(reasons, ",").alias("reasons"))


_THIN = "length(trim(summary)) < 80 AND NOT (trim(body) <> '' AND trim(body) <> trim(summary) AND length(trim(body)) >= 80)"


@query(f"""{_RES}, a AS (SELECT id, source, {_THIN} AS thin FROM res LEFT JOIN events ON event_id = id WHERE active AND review_status NOT IN ('REVIEWED') AND (ts IS NULL OR ts < TIMESTAMP '2024-01-30' - INTERVAL 28 DAY))
SELECT 'item' AS kind, CASE WHEN thin THEN 'thin' ELSE 'fine' END AS state, count(*) AS n FROM a GROUP BY 2
UNION ALL SELECT 'person', CASE WHEN c_custkey % 9 = 0 THEN 'junk' ELSE 'fine' END, count(*) FROM customer GROUP BY 2 UNION ALL SELECT 'organisation', CASE WHEN s_suppkey % 4 = 0 THEN 'legal_form' ELSE 'fine' END, count(*) FROM supplier GROUP BY 2""")
def audit_all(spark, sf_dir):
    """An audit of items (reviewed ones and those verified in the last weeks are left), people and organisations."""
    # an item was last verified when the event of its number happened
    verified = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("verified_at"))
    items = resources(spark, sf_dir).where("active and review_status <> 'REVIEWED'").join(verified, "id", "left")
    items = items.where(F.expr("verified_at is null or verified_at < timestamp_ntz'2024-01-30' - interval 28 days"))
    thin = T.body_length(F.col("summary"), F.col("body")) < 80
    person = F.when(F.col("c_custkey") % 9 == 0, "j k").otherwise(F.col("c_name"))
    org = F.when(F.col("s_suppkey") % 4 == 0, "N/A").otherwise(F.col("s_name"))
    every = items.select(F.lit("item").alias("kind"), F.when(thin, "thin").otherwise("fine").alias("state"))
    every = every.unionByName(table(spark, sf_dir, "customer").select(F.lit("person").alias("kind"), F.when(flt.junk_person(person), "junk").otherwise("fine").alias("state")))
    every = every.unionByName(table(spark, sf_dir, "supplier").select(F.lit("organisation").alias("kind"), F.when(T.legal_form(org), "legal_form").otherwise("fine").alias("state")))
    return every.groupBy("kind", "state").agg(F.count("*").alias("n"))


@query(f"{_GATED}, {_gate_sql(False)} SELECT id, CASE WHEN id % 3 = 0 THEN 'stored' ELSE array_to_string(reasons, ',') END AS reason FROM gate WHERE review_status = 'NEEDS_REVIEW'")
def reason_backfill(spark, sf_dir):
    """Items in review without reasons get those that the gate gives; stored ones stay."""
    rows = _gated(spark, sf_dir).where("review_status = 'NEEDS_REVIEW'")
    stored = F.when(F.col("id") % 3 == 0, F.array(F.lit("stored"))).otherwise(F.array().cast("array<string>"))
    found = T.quality_reasons(F.col("title"), F.col("summary"), F.col("body"))
    return rows.select("id", F.array_join(F.when(F.size(stored) > 0, stored).otherwise(found), ",").alias("reason"))


_REPAIRS = [
    ("River works:", "Filters that towns build. They last", "usa", "River works ltd", "River works: Filters that towns build.", "They last", "USA", "River works ltd"),
    ("A pump", "a-pump-for-dry-fields", "", "They sell pumps to farms.", "A pump", "The first paragraph of a body that is long enough to be one.", None, None),
]


@query(f"SELECT p_partkey AS key, {_expected(_REPAIRS, {'title': 4, 'country': 6, 'organisation': 7})}, [NULL, 'The first paragraph of a body that is long enough to be one.'][p_partkey % 2 + 1] AS summary FROM part WHERE p_partkey % 2 = 1 OR p_partkey % 2 = 0")
def repair_batch(spark, sf_dir):
    """Colon titles, summaries, country names and organisations in one pass; a changed row is given back."""
    rows = _cases(spark, sf_dir, _REPAIRS, ["title", "summary", "country", "organisation"])
    m = computed(rows, m=R.merged_title(F.col("title"), F.col("summary")))
    body = F.lit("The first paragraph of a body that is long enough to be one.\n\nMore")
    fixed = R.repaired_summary(F.col("m.title"), F.col("m.summary"), body)
    org = F.when(T.org_name_fault(F.col("organisation")).isNull(), F.col("organisation"))
    return m.select("key", F.col("m.title").alias("title"), R.country_name(F.col("country")).alias("country"), org.alias("organisation"), F.when(F.col("title") == "A pump", fixed).alias("summary"))


@query("SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN array_to_string(list_transform(string_split(upper(p_name), ' '), lambda w: CASE WHEN length(w) <= 3 THEN w ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ') ELSE p_name END AS title FROM part")
def capitals_repair(spark, sf_dir):
    """Titles in capitals become title case, others stay."""
    title = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.when(T.all_caps(title), T.title_case(title)).otherwise(title).alias("title"))


@query("WITH o AS (SELECT s_suppkey AS id, 'S-' || s_suppkey % 50 AS slug, 'Wörks ' || s_nationkey AS name FROM supplier), a AS (SELECT id, name, min(id) OVER (PARTITION BY slug) AS first FROM o) SELECT a.id, min(b.id) OVER (PARTITION BY b.name) AS canonical_id FROM a JOIN o b ON b.id = a.first")
def org_merge_passes(spark, sf_dir):
    """Organisations merged by slug, then those left by name without marks and punctuation."""
    o = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("S-"), (F.col("s_suppkey") % 50).cast("string")).alias("slug"), F.concat(F.when(F.col("s_suppkey") % 2 == 0, "Wörks  ").otherwise("WORKS "), F.col("s_nationkey").cast("string")).alias("name"))
    by_slug = merge_names(o, F.col("slug"), [F.col("id")])
    left = o.join(by_slug.select(F.col("canonical_id").alias("id")).distinct(), "id", "left_semi")
    return by_slug.select("id", F.col("canonical_id").alias("first")).join(_second(left), "first").select("id", "canonical_id")


def _second(left: DataFrame) -> DataFrame:
    """(first, canonical_id): organisations of one plain name go to the first of them."""
    return merge_names(left, T.ascii_name(F.col("name")), [F.col("id")]).withColumnRenamed("id", "first")


@query("SELECT user_id, coalesce(arg_max(k, (ts, event_id)) FILTER (WHERE k NOT IN ('1', '2')), '') AS organisation FROM (SELECT user_id, ts, event_id, json_extract_string(props, '$.k') AS k FROM events) GROUP BY 1")
def org_recovery(spark, sf_dir):
    """An organisation's name from the latest metadata that holds a fit one."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    fit = F.when(~F.col("k").isin("1", "2"), F.struct("ts", "event_id", "k"))
    return e.groupBy("user_id").agg(F.coalesce(F.max(fit)["k"], F.lit("")).alias("organisation"))


@query(f"{_RES} SELECT id, CASE source WHEN 'src1' THEN 'Ghana' WHEN 'src2' THEN 'Kenya' ELSE CASE WHEN nation_key % 2 = 0 THEN 'kept' END END AS country FROM res")
def geography_backfill(spark, sf_dir):
    """Countries by source, others as they are: a join with a small table."""
    by = spark.createDataFrame([("src1", "Ghana"), ("src2", "Kenya")], "source string, _country string")
    rows = resources(spark, sf_dir).select("id", "source", F.when(F.col("nation_key") % 2 == 0, "kept").alias("country")).join(F.broadcast(by), "source", "left")
    return rows.select("id", F.coalesce("_country", "country").alias("country"))


def _named(where: str, limit: int = 8) -> str:
    return f"(SELECT id, row_number() OVER (ORDER BY id DESC) AS rank FROM res WHERE active AND id NOT IN (SELECT id FROM grants) {where} QUALIFY rank <= {limit})"


@query(f"""{_RES}, {LOCATIONS_SQL}, {TOPICS_SQL}, {GRANTS_SQL} SELECT 'recent' AS list, * FROM {_named('')} UNION ALL SELECT 'topic', * FROM {_named("AND id IN (SELECT id FROM topics WHERE slug = 'topic-3')")}
UNION ALL SELECT 'source', * FROM {_named("AND source = 'src4'")} UNION ALL SELECT 'africa', * FROM {_named("AND nation_key IN (SELECT nation_key FROM loc WHERE continent = 'AFRICA')")} UNION ALL SELECT 'asia', * FROM {_named("AND nation_key IN (SELECT nation_key FROM loc WHERE continent = 'ASIA')")}""")
def canned_browses(spark, sf_dir):
    """The browses that a front page shows: each a preset of filters."""
    presets = {"recent": {}, "topic": {"topics": ["topic-3"]}, "source": {"sources": ["src4"]}, "africa": {"continents": ["Africa"]}, "asia": {"continents": ["Asia"]}}
    out = None
    for name, preset in presets.items():
        part = browse(spark, sf_dir, flt.SearchFilters(**preset), limit=8).select(F.lit(name).alias("list"), "id", "rank")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""{_RES}, {LOCATIONS_SQL}, {GRANTS_SQL} SELECT row_number() OVER (ORDER BY miss, thin, id DESC) AS rank, id FROM (SELECT id, CASE WHEN id IN (SELECT page_id FROM pages) THEN 0 ELSE 1 END + CASE WHEN org_key IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) THEN 0 ELSE 1 END + CASE WHEN length(trim(summary)) < 120 THEN 1 ELSE 0 END AS miss,
  CASE WHEN lower(trim(summary)) = lower(trim(title)) OR length(trim(summary)) < 60 THEN 1 ELSE 0 END AS thin FROM res
  WHERE active AND id NOT IN (SELECT id FROM grants) AND nation_key IN (SELECT nation_key FROM loc WHERE continent = 'EUROPE') AND {_BROWSE.format(least=40)}) QUALIFY rank <= 10""")
def continent_browse(spark, sf_dir):
    """A blank search of one continent alone shows the relaxed quality browse."""
    return web_search(spark, sf_dir, "", flt.SearchFilters(continents=["Europe"])).select("rank", "id")


def web_search(spark, sf_dir: str, text: str, filters: flt.SearchFilters, **more) -> DataFrame:
    """A search from a page: blank, and narrowed by continents alone, it turns the relaxed quality browse on."""
    f = filters
    others = (f.types, f.stages, f.sources, f.countries, f.statuses, f.topics, f.quality)
    if not text.strip() and f.wanted_continents() and all(x is None for x in others):
        f = flt.SearchFilters(continents=f.continents, continent_slugs=f.continent_slugs, quality="relaxed")
    return search(spark, sf_dir, text, filters=f, **more)


def explore(spark, sf_dir: str, problem: str, constraints: list[str] | None = None, country: str | None = None, **more) -> DataFrame:
    """A search for a problem under constraints, in one country if it is given."""
    text = " ".join([problem, *(constraints or [])]).strip()
    return search(spark, sf_dir, text, filters=flt.SearchFilters(countries=[country] if country else None), **more)


@query(_search_sql("thin", limit=40, where="AND nation_key IN (SELECT nation_key FROM loc WHERE country = 'NATION_4')"))
def explore_problem(spark, sf_dir):
    """A problem in one country: a search page of what holds the word and lies there."""
    return explore(spark, sf_dir, "thin", country="nation_4", limit=40).withColumn("lists", F.array_join("lists", ","))


#: Weights of words in a person's name, summary and role.
PERSON = {"name": 1.0, "summary": 0.4, "role": 0.2}
_PERSON_SQL = f"""person AS (SELECT c_custkey AS id, c_name AS name, coalesce(d.text, '') AS summary, c_mktsegment AS role FROM customer LEFT JOIN documents d ON d.doc_id = c_custkey),
ptok AS (SELECT id, {_terms_sql('name')} AS a, {_terms_sql('summary')} AS b, {_terms_sql('role')} AS c FROM person),
pos AS (SELECT id, unnest(a || b || c) AS x, unnest(range(0, len(a || b || c))) AS p, len(a) AS n1, len(b) AS n2 FROM ptok)"""


def people(spark, sf_dir) -> DataFrame:
    """(id, name, summary, role): here a person's summary is the document of the same number."""
    c, d = table(spark, sf_dir, "customer"), table(spark, sf_dir, "documents")
    return c.join(d, F.col("doc_id") == F.col("c_custkey"), "left").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("text").alias("summary"), F.col("c_mktsegment").alias("role"))


@query(f"""WITH {_PERSON_SQL}, {stems_sql('pos')}, stop AS (SELECT unnest({repr(sorted(lexical.STOP_WORDS))}) AS x)
SELECT s AS stem, count(DISTINCT id) AS people, count(*) AS n, round(sum(CASE WHEN p < n1 THEN 1.0 WHEN p < n1 + n2 THEN 0.4 ELSE 0.2 END), 6) AS mass, CAST(min(p) AS INT) AS first FROM pos JOIN stemmed USING (x) WHERE x NOT IN (SELECT x FROM stop) GROUP BY s""")
def people_vectors(spark, sf_dir):
    """Vectors of people, summed up by stem: who holds it, how often, with what weight, and its first place."""
    v = fulltext.vectors(people(spark, sf_dir), PERSON).select("id", "stem", F.size("spots").alias("n"), F.aggregate("spots", F.lit(0.0), lambda s, x: s + x["weight"]).alias("mass"), F.array_min("spots.place").alias("first"))
    return v.groupBy("stem").agg(F.count("id").alias("people"), F.sum("n").alias("n"), F.round(F.sum("mass"), 6).alias("mass"), F.min("first").alias("first"))


@query(f"""WITH {_PERSON_SQL}, words AS (SELECT unnest(['machineries', 'thing']) AS x), voc AS (SELECT x FROM pos UNION SELECT x FROM words), {stems_sql('voc')},
hit AS (SELECT id, count(DISTINCT a.s) AS n, sum(CASE WHEN p < n1 THEN 1.0 WHEN p < n1 + n2 THEN 0.4 ELSE 0.2 END) AS mass FROM pos JOIN stemmed a ON a.x = pos.x WHERE a.s IN (SELECT s FROM stemmed JOIN words USING (x)) GROUP BY id)
SELECT row_number() OVER (ORDER BY n DESC, mass DESC, id) AS rank, id, n, round(mass, 6) AS mass FROM (SELECT id, n, round(mass, 6) AS mass FROM hit) QUALIFY rank <= 20""")
def people_by_words(spark, sf_dir):
    """People by any form of some words: those of more words first, then of more weight."""
    wanted = [stem(w) for w in ("machineries", "thing")]
    found = fulltext.occurrences(people(spark, sf_dir), PERSON, wanted=wanted)
    hits = found.groupBy("id").agg(F.count_distinct("stem").alias("n"), F.round(F.sum("weight"), 6).alias("mass"))
    return pool(hits, [F.desc("n"), F.desc("mass"), F.col("id")], 20).select("rank", "id", "n", "mass")


@query("SELECT n_nationkey, 'https://cards.example/' || 'nation-' || n_nationkey AS url, CASE WHEN r_name = 'AFRICA' THEN 'Africa' WHEN r_name = 'ASIA' THEN 'Asia' WHEN r_name = 'EUROPE' THEN 'Europe' WHEN r_name = 'AMERICA' THEN 'Americas' ELSE 'Middle East and North Africa' END AS continent, 'HEALTH' AS sector FROM nation JOIN region ON r_regionkey = n_regionkey")
def listing_cards(spark, sf_dir):
    """Items of which there is a card only: an address is made for each, and its label is read."""
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    label = F.concat("r_name", F.lit(" • HEALTH"))
    url = F.concat(F.lit("https://cards.example/"), T.slug(F.translate(F.lower("n_name"), "_", "-")))
    return rows.select("n_nationkey", url.alias("url"), X.region_continent(label).alias("continent"), X.region_sector(label).alias("sector"))
