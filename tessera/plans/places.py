"""Countries, continents, stages and labels over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions import geography as G, taxonomy as X, text as T
from tessera.operators.columns import computed
from tessera.operators.ranking import first_per_key
from tessera.plans.registry import query
from tessera.sources.tables import table


def _literal(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _cycled(spark, sf_dir: str, texts: list[str | None]) -> DataFrame:
    """(key, text): parts, each with one of some texts in turn."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % len(texts) + 1).cast("int")).alias("text"))


def _cycled_sql(texts: list[str | None]) -> str:
    return f"t AS (SELECT p_partkey AS key, {_literal(texts)}[p_partkey % {len(texts)} + 1] AS text FROM part)"


def _prose(spark, sf_dir: str, texts: list[str]) -> DataFrame:
    """(key, text): whole documents; into three of four one of some phrases is put after its two hundredth character."""
    one = F.element_at(F.array(*map(F.lit, texts)), (F.col("doc_id") % len(texts) + 1).cast("int"))
    text = F.when(F.col("doc_id") % 4 == 3, F.col("text")).otherwise(F.concat(F.substring("text", 1, 200), F.lit(" \n"), one, F.lit("\n "), F.expr("substring(text, 201)")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), text.alias("text"))


def _prose_sql(texts: list[str]) -> str:
    return f"t AS (SELECT doc_id AS key, CASE WHEN doc_id % 4 = 3 THEN text ELSE substr(text, 1, 200) || ' ' || chr(10) || {_literal(texts)}[doc_id % {len(texts)} + 1] || chr(10) || ' ' || substr(text, 201) END AS text FROM documents)"


def _labels(spark, sf_dir: str, texts: list[str]) -> DataFrame:
    """(key, text): the words of each document's first line, and one of some labels."""
    own = F.split(F.substring_index("text", "\n", 1), " ")
    one = F.element_at(F.array(*map(F.lit, texts)), (F.col("doc_id") % len(texts) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.explode(F.array_append(own, one)).alias("text"))


def _labels_sql(texts: list[str]) -> str:
    return f"t AS (SELECT doc_id AS key, unnest(list_append(string_split(string_split(text, chr(10))[1], ' '), {_literal(texts)}[doc_id % {len(texts)} + 1])) AS text FROM documents)"


_COUNTRIES = "names AS (SELECT * FROM (VALUES " + ", ".join(f"('{n.replace(chr(39), chr(39) * 2)}', '{c}', {i})" for i, (n, c) in enumerate(G.COUNTRY_CODES.items())) + ") v(name, code, place))"
_CONTINENT = "CASE " + " ".join(f"WHEN code IN ({', '.join(map(repr, codes))}) THEN '{name}'" for name, codes in G.CONTINENT_CODES.items()) + " END"
_NAMES = ["Kenya", " BRAZIL ", "Côte d'Ivoire", "Atlantis", "south korea", "UK", "New Zealand", ""]


@query(f"WITH {_COUNTRIES}, {_labels_sql(_NAMES)} SELECT code, {_CONTINENT} AS continent, count(*) AS n, count(DISTINCT key) AS docs FROM t LEFT JOIN names ON name = lower(trim(text)) GROUP BY ALL")
def country_codes(spark, sf_dir):
    """Countries and continents that the words of documents name."""
    rows = _labels(spark, sf_dir, _NAMES).withColumn("code", G.country_code(F.col("text")))
    return rows.groupBy("code", G.continent_of(F.col("code")).alias("continent")).agg(F.count("*").alias("n"), F.count_distinct("key").alias("docs"))


_PROSE = [
    "A pump made near Quito, Ecuador. It spread", "workshops in South Sudan and in Chad", "no place at all", "we ship from Berlin, Atlantis and also to Mali", "from São Paulo, Brazil",
    "equatorial guinea, guinea and guinea-bissau", "an Indiana firm in nigerian towns", "kenya", "Peru;Niger!", "", "out of Lyon, France; then on to Dakar, Senegal",
]


@query(f"""WITH {_COUNTRIES}, {_prose_sql(_PROSE)},
pairs AS (SELECT key, unnest(regexp_extract_all(text, '{G.CITY_COUNTRY.replace("'", "''")}', 1)) AS city, unnest(regexp_extract_all(text, '{G.CITY_COUNTRY.replace("'", "''")}', 2)) AS c, generate_subscripts(regexp_extract_all(text, '{G.CITY_COUNTRY.replace("'", "''")}', 1), 1) AS i FROM t),
first AS (SELECT key, trim(city) AS city, name, code FROM pairs JOIN names ON name = lower(regexp_replace(trim(c), '[.,;:]+$', '')) QUALIFY row_number() OVER (PARTITION BY key ORDER BY i) = 1),
alone AS (SELECT key, name, code FROM t JOIN names ON regexp_matches(lower(text), '(?:^|[^a-z])' || name || '(?:[^a-z]|$)') QUALIFY row_number() OVER (PARTITION BY key ORDER BY length(name) DESC, place) = 1)
SELECT t.key, coalesce(f.name, a.name) AS country, coalesce(f.code, a.code) AS code, f.city FROM t LEFT JOIN first f ON f.key = t.key LEFT JOIN alone a ON a.key = t.key""")
def country_infer(spark, sf_dir):
    """Places in prose; the country's name in lower case."""
    rows = computed(_prose(spark, sf_dir, _PROSE), at=G.country_in_text(F.col("text")))
    return rows.select("key", F.lower("at.country").alias("country"), F.col("at.code").alias("code"), F.col("at.city").alias("city"))


_PHONES = ["call +27 82 555 0101", "tel:+254-700-000", "phone:+1 202 555", "+2547 00", "27 82 555", "write to +221.33"]
_DIAL = "CASE regexp_extract(text, '{}', 1) {} END".format(G.PHONE.replace("\\", "\\"), " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in G.DIAL_CODES.items()))


@query(f"WITH {_prose_sql(_PHONES)} SELECT key, {_DIAL} AS country FROM t")
def phone_country(spark, sf_dir):
    return _prose(spark, sf_dir, _PHONES).select("key", G.country_of_phone(F.col("text")).alias("country"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'Kenya' WHEN src = 'src1' THEN 'Ghana' END AS country, CASE WHEN s_suppkey % 5 = 0 THEN 'KE' WHEN src = 'src1' THEN 'GH' END AS code,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN 'Europe' WHEN src IN ('src1', 'src2') THEN 'Africa' WHEN cat = 'asia-innovation' THEN 'Asia' END AS continent
FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 1 THEN 'src9' ELSE 'src' || s_suppkey % 4 END AS src, CASE WHEN s_nationkey < 12 THEN 'asia-innovation' ELSE 'other' END AS cat FROM supplier)""")
def geography_defaults(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.when(k % 5 == 1, "src9").otherwise(F.concat(F.lit("src"), (k % 4).cast("string"))).alias("source"),
        F.when(F.col("s_nationkey") < 12, "asia-innovation").otherwise("other").alias("category"),
        F.when(k % 5 == 0, "Kenya").alias("country"),
        F.when(k % 5 == 0, "KE").alias("code"),
        F.when(k % 5 == 1, "Europe").alias("continent"),
    )
    defaults = spark.createDataFrame([("src1", "Ghana", "Africa"), ("src2", None, "Africa")], "source string, default_country string, default_continent string")
    return G.with_defaults(rows, defaults, {"asia-innovation": "Asia", "africa-innovation": "Africa"}).select("s_suppkey", "country", "code", "continent")


_METADATA = ['{"stage": " seed "}', '{"trl": 5}', '{"trl": 9}', '{"evidence_stage": "in trials now"}', '{"programme_stage": "GROWTH"}', '{"investment_stage": "Revenue, growth"}', '{"stage": "unknown", "company_stage": "MVP"}', "{}", None, '{"stage": "we sell across 9 countries"}']


@query(f"WITH {_cycled_sql(_METADATA)} SELECT key, ['IDEA', 'PROTOTYPE', 'DEPLOYED', 'PILOT', 'SCALED', 'DEPLOYED', 'PROTOTYPE', NULL, NULL, 'SCALED'][key % 10 + 1] AS stage FROM t")
def stage_metadata(spark, sf_dir):
    """Stages from JSON metadata; the values in the SQL are those worked out by hand for each text."""
    return _cycled(spark, sf_dir, _METADATA).select("key", X.stage_of_metadata(F.col("text")).alias("stage"))


_CLAIMS = ["a pilot in two towns", "our prototype won an award", "deployed, with paying customers", "now in 12+ countries", "an early-stage idea", "Series A round", "nothing", "trials of an MVP", "commercialised and scaled"]
_SIGNALS = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{s}'" for s, p in X.STAGE_SIGNALS) + " END"


@query(f"WITH {_prose_sql(_CLAIMS)} SELECT key, {_SIGNALS} AS stage FROM t")
def stage_signals(spark, sf_dir):
    return _prose(spark, sf_dir, _CLAIMS).select("key", X.first_signal(F.col("text"), X.STAGE_SIGNALS).alias("stage"))


_LABELS = ["pre_seed!", "trial", " Market ", "multiple deployments", "MVP", "other", "", "Growth!"]
_ALIASES = "CASE k " + " ".join(f"WHEN '{n}' THEN '{s}'" for s, names in X.STAGE_ALIASES.items() for n in names) + " END"


@query(f"WITH {_labels_sql(_LABELS)} SELECT stage, count(*) AS n, count(DISTINCT key) AS docs FROM (SELECT key, {_ALIASES} AS stage FROM (SELECT key, regexp_replace(regexp_replace(upper(trim(text)), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS k FROM t)) GROUP BY stage")
def stage_aliases(spark, sf_dir):
    """Stages that the words of documents name."""
    rows = _labels(spark, sf_dir, _LABELS).select("key", X.stage_of_label(F.col("text")).alias("stage"))
    return rows.groupBy("stage").agg(F.count("*").alias("n"), F.count_distinct("key").alias("docs"))


_TOPICS = ["Water|solar power off-grid", "Energy|solar power off-grid", "Water|clean water and sanitation", "Nonsense|school learning", "Health|nothing here", "|solar"]


@query(f"WITH {_cycled_sql(_TOPICS)} SELECT key, ['energy', 'energy', 'water', NULL, NULL, NULL][key % 6 + 1] AS sector, ['energy-access', 'energy-access', 'drinking-water', NULL, NULL, NULL][key % 6 + 1] AS problem FROM t")
def label_slugs(spark, sf_dir):
    """A label stands only where the text bears it out; else the text's own first topic does."""
    rows = _cycled(spark, sf_dir, _TOPICS).select("key", F.split_part("text", F.lit("|"), F.lit(1)).alias("label"), F.split_part("text", F.lit("|"), F.lit(2)).alias("own"))
    names = {"water": "water", "energy": "energy", "health": "health"}
    sector = X.slug_with_evidence(F.col("label"), X.tags(F.col("own"), X.SECTORS), names, X.SECTORS, False)
    problem = X.slug_with_evidence(F.when(F.col("label").isin("Water", "Energy"), F.col("label")), X.tags(F.col("own"), X.PROBLEMS), {"access": "energy-access"}, X.PROBLEMS, True)
    return rows.select("key", sector.alias("sector"), problem.alias("problem"))


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') END AS c FROM events)
SELECT user_id, coalesce(CASE WHEN user_id % 4 = 0 THEN 'Kenya' END, arg_max(coalesce(c, ''), (ts, event_id))) AS country FROM e GROUP BY user_id""")
def country_from_metadata(spark, sf_dir):
    """A blank country is filled from the latest item's metadata."""
    e = table(spark, sf_dir, "events")
    latest = first_per_key(e, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    found = F.coalesce(F.when(F.col("event_id") % 3 == 0, F.get_json_object("props", "$.k")), F.lit(""))
    return latest.select("user_id", F.coalesce(F.when(F.col("user_id") % 4 == 0, "Kenya"), found).alias("country"))


@query("""SELECT id, slug, count(*) OVER (PARTITION BY slug) AS n FROM (SELECT p_partkey AS id, left(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 80) || '-' || left(sha256(p_name), 8) AS slug FROM part)""")
def organisation_slugs(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.organisation_slug(F.col("p_name")).alias("slug"))
    counts = rows.groupBy("slug").agg(F.count("*").alias("n"))
    return rows.join(counts, "slug")
