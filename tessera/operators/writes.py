"""Set-at-a-time forms of the catalogue's writes: each takes the stored table and gives the new one; the caller writes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.cluster import checkpointed
from tessera.functions import geography as G, repair as R, taxonomy as X, text as T
from tessera.operators.columns import computed
from tessera.operators.ranking import first_per_key

JUNK, DUPLICATE = "junk_generic_title", "junk_duplicate_title_content"


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def filled(new: Column, old: Column) -> Column:
    """new unless it is blank, then old."""
    return F.coalesce(F.nullif(F.trim(new), F.lit("")), old)


def image_after(new: Column, old: Column) -> Column:
    """A stored image gives way to any real address, and an embedded one goes in any case."""
    return F.when((blank(new) != "") & ~F.trim(new).startswith("data:"), F.trim(new)).when(~F.coalesce(old.startswith("data:"), F.lit(False)), old)


def match_drafts(items: DataFrame, drafts: DataFrame) -> DataFrame:
    """drafts with ``id`` and ``matched``: by external id within the source, else by address within it, else an item of
    another source at that address.  Of drafts for one item the last (``seq``) is kept; so is every unmatched key's last.
    """
    last = first_per_key(drafts, ["source", "external_id"], [F.desc("seq")])
    by_id = items.groupBy("source", "external_id").agg(F.min("id").alias("_by_id"))
    by_url = items.groupBy("source", "url").agg(F.min("id").alias("_by_url"))
    anywhere = items.groupBy("url").agg(F.min("id").alias("_anywhere"))
    found = last.join(by_id, ["source", "external_id"], "left").join(by_url, ["source", "url"], "left").join(anywhere, "url", "left")
    own = F.coalesce("_by_id", "_by_url")
    how = F.when(F.col("_by_id").isNotNull(), "external_id").when(F.col("_by_url").isNotNull(), "url").when(F.col("_anywhere").isNotNull(), "other_source").otherwise("new")
    found = found.withColumn("id", F.coalesce(own, "_anywhere")).withColumn("matched", how).drop("_by_id", "_by_url", "_anywhere")
    key = F.coalesce(F.col("id").cast("string"), F.concat_ws("|", F.lit("new"), "source", "external_id"))
    return first_per_key(found.withColumn("_key", key), ["_key"], [F.desc("seq")]).drop("_key")


def upsert_drafts(items: DataFrame, drafts: DataFrame) -> DataFrame:
    """Stored items met by drafts, field by field, and new ones; ``outcome``: new, linked, unchanged or updated.

    Both have source, external_id, url, title, summary, body, stage, country, status, reasons, image, published_at, etag
    and language.  A draft with an equal content hash only touches its item.
    """
    new, old = match_drafts(items, drafts), items.select(F.col("id"), *[F.col(c).alias(f"_{c}") for c in items.columns if c != "id"])
    d, hashed = F.col, lambda p: T.content_hash(d(f"{p}title"), d(f"{p}summary"), d(f"{p}body"))
    j = new.join(old, "id", "left")
    have = d("matched") != "new"
    same = have & (hashed("") == hashed("_"))
    merged = R.preserved(d("_status"), {p: d(f"_{p}") for p in ("title", "summary", "body")}, {p: d(p) for p in ("title", "summary", "body")})
    status = F.when(d("status").isin("SOURCE_LIMITED", "NEEDS_REVIEW") | (F.size("reasons") == 0), d("status")).otherwise(d("_status"))
    j = j.withColumn("_same", same).withColumn("_m", F.when(have & ~same, merged)).withColumn("_image_after", image_after(d("image"), d("_image")))
    pick = lambda name, changed: F.when(~have, d(name)).when(d("_same"), d(f"_{name}")).otherwise(changed).alias(name)
    outcome = F.when(~have, "new").when(d("matched") == "other_source", "linked").when(d("_same") | d("_m.unchanged"), "unchanged").otherwise("updated")
    return j.select(
        "id", "source", "external_id", "url", "matched", outcome.alias("outcome"),
        *[pick(p, d(f"_m.{p}")) for p in ("title", "summary", "body")],
        pick("stage", F.when(d("stage") == "UNKNOWN", d("_stage")).otherwise(d("stage"))),
        pick("country", F.coalesce("country", "_country")),
        pick("status", status),
        F.when(have, d("_image_after")).otherwise(d("image")).alias("image"),
        F.coalesce("published_at", "_published_at").alias("published_at"),
        F.when(d("_same"), F.coalesce("etag", "_etag")).otherwise(d("etag")).alias("etag"),
        F.when(have, d("_language")).otherwise(d("language")).alias("language"),
    )


def ensure(stored: DataFrame, wanted: DataFrame, keys: list[str], keep_first: list[str]) -> DataFrame:
    """stored and the wanted rows whose keys it lacks (nulls are equal), each key once; blank fields of ``keep_first``
    are filled from what is wanted."""
    first = wanted.groupBy(*keys).agg(*[F.min(c).alias(f"_{c}") for c in keep_first])
    s, w = stored.alias("s"), first.alias("w")
    same = None
    for k in keys:
        one = F.col(f"s.{k}").eqNullSafe(F.col(f"w.{k}"))
        same = one if same is None else same & one
    return s.join(w, same, "full").select(*[F.coalesce(f"s.{k}", f"w.{k}").alias(k) for k in keys], *[filled(F.col(f"s.{c}"), F.col(f"w._{c}")).alias(c) for c in keep_first])


# Titles of navigation, and patterns of portals and of one-word names of products and organisations.
NAVIGATION = ["advance search", "advanced search", "search", "home", "about", "contact", "menu", "read more", "portfolio", "insights", "news", "blog", "subscribe", "share", "login", "sign in"]
PORTAL = "政府门户网站|教育部政府门户|中华人民共和国教育部"
PRODUCT_HINT = r"(?i)(?:solar|water|energy|power|grid|tech|bio|farm|irrigation|filter|pump|cell|battery|carbon|climate|health|med|care|ai\b|led\b|hub|lab|co-?op|systems?|solutions?|ventures?)"


def title_key(title: Column) -> Column:
    return F.lower(T.spaces(title))


def obvious_name(title: Column) -> Column:
    """One word that looks like a product or an organisation."""
    t = F.trim(title)
    return (t != "") & ~t.contains(" ") & (t.rlike(PRODUCT_HINT) | t.rlike("[A-Z]{2,}") | t.rlike(r"\d") | (F.length(t) >= 9))


def fingerprint(title: Column, body: Column, url: Column, external_id: Column) -> Column:
    return F.concat_ws("|", title_key(title), F.lower(blank(url)), blank(external_id), F.left(F.lower(T.spaces(F.coalesce(body, F.lit("")))), F.lit(400)))


def junk_rule(title: Column, source: Column, source_name: Column, person: Column, body: Column, site_titles: dict[str, list[str]], brands: dict[str, str], person_source: str) -> Column:
    """The first rule by which a title is junk, or null; site_titles and brands by source."""
    t, key = F.trim(title), title_key(title)
    site, brand = F.lit(False), F.lit(False)
    for s, names in site_titles.items():
        site = site | ((source == s) & key.isin(names))
    for s, name in brands.items():
        brand = brand | ((source == s) & (key == name))
    stub = (source == person_source) & ~t.contains(" ") & (F.length(t) >= 3) & (F.length(blank(body)) < 120) & ~obvious_name(t) & (blank(person) != "") & (F.lower(F.trim(person)) == F.lower(t))
    return (
        F.when(blank(title) == "", "empty_title")
        .when(F.length(t) == 1, "single_letter_title")
        .when(key.isin(NAVIGATION), "navigation_title")
        .when(site, "site_chrome_title")
        .when(t.rlike(PORTAL), "government_portal_title")
        .when((blank(source_name) != "") & (title_key(source_name) == key), "source_name_equals_title")
        .when(F.coalesce(stub, F.lit(False)), "person_name_stub")
        .when(brand, "site_brand_title_unrepaired")
    )


def bulk_fix(rows: DataFrame, site_titles: dict[str, list[str]] | None = None, brands: dict[str, str] | None = None, person_source: str = "") -> DataFrame:
    """(id, title, summary, clear_org, action, reasons) of items in review.

    rows: id, source, title, summary, body, organisation, person, source_name, item_title, meta, url, external_id.
    Proposed: the longest fuller title, capitals as title case, a colon title with its sentence, a repaired summary, a bad
    organisation cleared.  Then junk is hidden (the first of equal fingerprints of a source stays), clean items are
    cleared, those as good as their source allows are source_limited, others updated or unchanged.
    """
    site_titles, brands = site_titles or {}, brands or {}
    c = F.col
    p = computed(rows, _t0=R.fuller_title(c("title"), F.array(c("item_title")), c("summary"), c("body")))
    named = c("_t0")
    for s, name in brands.items():
        named = F.when((c("source") == s) & (title_key(c("title")) == name), R.unbranded_title(c("title"), F.lit(name), F.array(c("item_title")), c("url"))).otherwise(named)
    p = computed(p, _t1=T.let(named, lambda t: F.when(T.all_caps(t), T.title_case(t)).otherwise(t)))
    p = computed(p, _c=R.merged_title(c("_t1"), c("summary")))
    p = computed(p, _t=T.truncate_words(F.when(F.length(blank(c("item_title"))) > F.length(c("_c.title")) + 4, F.trim("item_title")).otherwise(c("_c.title")), 300))
    repaired = R.repaired_summary(c("_t"), c("_c.summary"), c("body"), c("meta"))
    p = computed(p, _s=T.let(repaired, lambda s: F.when((F.length(s) < 80) & (F.length(blank(c("body"))) >= 80), T.truncate_words(c("body"), 500)).otherwise(s)))
    bad = T.org_name_fault(c("organisation"), c("source_name")).isNotNull() | c("organisation").rlike("(?i)for-profit|non-profit|legal form|b-corp|sole proprietorship")
    p = computed(
        p,
        clear_org=F.coalesce(bad, F.lit(False)),
        _junk=junk_rule(c("_t"), c("source"), c("source_name"), c("person"), c("body"), site_titles, brands, person_source),
        _print=F.xxhash64(fingerprint(c("_t"), c("body"), c("url"), c("external_id"))),
    )
    org = F.when(~c("clear_org"), c("organisation"))
    p = computed(p, _reasons=T.quality_reasons(c("_t"), c("_s"), c("body"), c("person"), org, None, c("source_name")))
    firsts = p.where("_junk is null").groupBy("source", "_print").agg(F.min("id").alias("_first"))
    p = p.join(firsts, ["source", "_print"], "left").withColumn("_duplicate", F.coalesce(c("_first") < c("id"), F.lit(False)) & c("_junk").isNull())
    action = (
        F.when(c("_junk").isNotNull() | c("_duplicate"), "hide")
        .when(F.size("_reasons") == 0, "cleared")
        .when(T.source_limited(c("_reasons"), c("_s"), c("body"), org), "source_limited")
        .when((c("_t") == c("title")) & (c("_s") == c("summary")) & ~c("clear_org"), "unchanged")
        .otherwise("updated")
    )
    reasons = F.when(c("_junk").isNotNull(), F.array(F.lit(JUNK))).when(c("_duplicate"), F.array(F.lit(DUPLICATE))).otherwise(c("_reasons"))
    return p.select("id", c("_t").alias("title"), c("_s").alias("summary"), "clear_org", action.alias("action"), reasons.alias("reasons"))


def applied(stored: DataFrame, fixes: DataFrame, mode: str) -> DataFrame:
    """stored (id, title, summary, status, reasons, active) after a bulk fix in a mode: dry_run, apply_cleared_only or apply_all."""
    if mode == "dry_run":
        return stored
    f = fixes if mode == "apply_all" else fixes.where(F.col("action") == "cleared")
    f = f.select("id", "action", F.col("title").alias("_t"), F.col("summary").alias("_s"), F.col("reasons").alias("_r"))
    j, hit, hide = stored.join(f, "id", "left"), F.col("action").isNotNull(), F.coalesce(F.col("action") == "hide", F.lit(False))
    status = F.when(hide, "ARCHIVED").when(F.col("action") == "cleared", "AUTO").when(F.col("action") == "source_limited", "SOURCE_LIMITED").otherwise(F.col("status"))
    return j.select(
        "id",
        F.when(hit & ~hide, F.col("_t")).otherwise(F.col("title")).alias("title"),
        F.when(hit & ~hide, F.col("_s")).otherwise(F.col("summary")).alias("summary"),
        status.alias("status"),
        F.when(hide, F.array_union("reasons", "_r")).when(hit, F.col("_r")).otherwise(F.col("reasons")).alias("reasons"),
        (F.col("active") & ~hide).alias("active"),
    )


def improved(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """A fetched page made a title or body materially better; both hold title, summary and body."""
    a, b = F.length(blank(old["title"])), F.length(blank(new["title"]))
    before, after = T.body_length(old["summary"], old["body"]), T.body_length(new["summary"], new["body"])
    return ((b > a + 4) & (blank(new["title"]) != blank(old["title"]))) | (after >= before + 40) | ((before < 80) & (after >= 80))


def drain_outcome(action: Column, better: Column) -> Column:
    """(action, repaired) of a drained item from its bulk-fix action."""
    return F.struct(F.when(action.isin("hide", "updated"), "still_flagged").otherwise(action).alias("action"), F.when(action == "unchanged", False).otherwise(better).alias("repaired"))


def review_action(rows: DataFrame, action: str) -> DataFrame:
    """rows (id, status, reasons, active, embedded) after approve, source_limited or hide of those in review."""
    hit = F.col("status") == "NEEDS_REVIEW"
    hit = hit if action == "hide" else hit & F.col("active")
    status = {"approve": "AUTO", "source_limited": "SOURCE_LIMITED", "hide": "ARCHIVED"}[action]
    reasons = {"approve": F.array().cast("array<string>"), "source_limited": F.array_append("reasons", F.lit("admin_source_limited")), "hide": F.col("reasons")}[action]
    return (
        rows.withColumn("_hit", hit)
        .withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status")))
        .withColumn("reasons", F.when(F.col("_hit"), reasons).otherwise(F.col("reasons")))
        .withColumn("active", F.col("active") & ~(F.col("_hit") & F.lit(action == "hide")))
        .withColumn("embedded", F.col("embedded") & ~(F.col("_hit") & F.lit(action != "hide")))
        .drop("_hit")
    )


def restore_hidden(rows: DataFrame, limit: int) -> DataFrame:
    """rows (id, status, reasons, active, updated_at): the latest ``limit`` items that a bulk fix hid are shown again."""
    hidden = ~F.col("active") & (F.col("status") == "ARCHIVED") & F.arrays_overlap("reasons", F.array(F.lit(JUNK), F.lit(DUPLICATE)))
    picked = rows.where(hidden).orderBy(F.desc("updated_at"), "id").limit(limit).select("id", F.lit(True).alias("_picked"))
    j = rows.join(F.broadcast(picked), "id", "left").withColumn("_picked", F.coalesce("_picked", F.lit(False)))  # limit rows
    return j.withColumn("active", F.col("active") | F.col("_picked")).withColumn("status", F.when(F.col("_picked"), "NEEDS_REVIEW").otherwise(F.col("status"))).drop("_picked")


def enrich(rows: DataFrame, by_source: dict[str, str]) -> DataFrame:
    """(id, country, code, stage, fields) of rows filled where they are blank.

    rows: id, source, title, summary, body, country, stage, org_country, metadata, and new_country and new_stage, what an
    enrichment found.  Country: found, the organisation's, a phone's, the source's, the text's; stage: found, the
    metadata's, the text's.  ``fields`` names what changed; a change makes the item's embedding stale.
    """
    c, own = F.col, lambda x: F.nullif(F.trim(x), F.lit(""))
    hay = F.concat_ws("\n", *[F.coalesce(x, F.lit("")) for x in (c("title"), c("summary"), c("body"), c("org_country"), F.get_json_object("metadata", "$.headquarters"))])
    source = G.mapped(c("source"), by_source) if by_source else F.lit(None).cast("string")
    place = R.country_name(F.coalesce(own(c("new_country")), own(c("org_country")), G.country_of_phone(hay), source, G.country_in_text(hay)["country"]))
    told = F.upper(F.regexp_replace(own(c("new_stage")), r"\s+", "_"))
    stage = F.coalesce(F.nullif(told, F.lit("UNKNOWN")), F.nullif(X.stage_of_metadata(c("metadata")), F.lit("UNKNOWN")), X.first_signal(hay, X.STAGE_SIGNALS))
    stage = F.when(stage.isin(list(X.STAGE_ALIASES)), stage)
    set_country, set_stage = (blank(c("country")) == "") & place.isNotNull(), (c("stage") == "UNKNOWN") & stage.isNotNull()
    return rows.select(
        "id",
        F.when(set_country, place).otherwise(c("country")).alias("country"),
        F.when(set_country, G.country_code(place)).alias("code"),
        F.when(set_stage, stage).otherwise(c("stage")).alias("stage"),
        F.array_compact(F.array(F.when(set_country, "country"), F.when(set_stage, "stage"))).alias("fields"),
    )


def upsert_hubs(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Hubs met by found ones: by website host, else by slug; the longer name stays, found fields win, new hubs are added.

    Both have host, slug, name, country, city and description, stored ones an id; of several found for one hub the last
    (``seq``) counts.
    """
    s = stored.withColumn("_id", F.col("id"))
    by_host = s.where("host <> ''").groupBy("host").agg(F.min("_id").alias("_h"))
    by_slug = s.groupBy("slug").agg(F.min("_id").alias("_s"))
    f = found.join(by_host, "host", "left").join(by_slug, "slug", "left").withColumn("_id", F.coalesce("_h", "_s"))
    by = F.when(F.col("_h").isNotNull(), "host").when(F.col("_s").isNotNull(), "slug").otherwise("new")
    f = f.withColumn("matched", by).withColumn("_key", F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("new|"), F.when(F.col("host") != "", F.col("host")).otherwise(F.col("slug")))))
    f = first_per_key(f, ["_key"], [F.desc("seq")])
    new = f.select(F.col("_id").alias("_fid"), "matched", *[F.col(c).alias(f"_{c}") for c in ("host", "slug", "name", "country", "city", "description")])
    j = s.join(new, F.col("_id") == F.col("_fid"), "full")
    longer = (F.col("matched") == "host") & (F.length("_name") > F.length("name"))
    return j.select(
        F.coalesce("matched", F.lit("kept")).alias("matched"),
        F.coalesce("slug", "_slug").alias("slug"),
        F.when(F.col("_id").isNull() | longer, F.col("_name")).otherwise(F.col("name")).alias("name"),
        F.coalesce("_country", "country").alias("country"),
        F.coalesce("_city", "city").alias("city"),
        filled(F.col("_description"), F.col("description")).alias("description"),
    )


def unique_slugs(candidates: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """candidates with ``slug``: the proposed one, or the first of -2, -3, … that neither a stored source (``taken``: slug)
    nor a candidate before it by ``key`` has, as if they were named one after another.

    All are named at once: the j-th of those that propose one slug begins at its j-th name.  Who finds a name taken or held
    by someone before them goes on to the next, and those behind them of the same proposal with them, until nobody moves;
    a name that is given up always stays with someone earlier, so nobody has to go back.
    """
    own = Window.partitionBy("proposed").orderBy(key)
    used = taken.select(F.col("slug").alias("_name")).distinct().withColumn("_used", F.lit(True))
    state = checkpointed(candidates.select(key, "proposed").withColumn("_j", F.row_number().over(own)).withColumn("_at", F.col("_j")))
    name = F.when(F.col("_at") == 1, F.col("proposed")).otherwise(F.concat("proposed", F.lit("-"), F.col("_at").cast("string")))
    while True:
        named = state.withColumn("_name", name)
        first = named.groupBy("_name").agg(F.min(key).alias("_first"))
        clash = F.coalesce("_used", F.lit(False)) | (F.col("_first") < F.col(key))
        held = named.join(first, "_name").join(used, "_name", "left").withColumn("_clash", clash)
        moved = held.withColumn("_at", F.col("_at") + F.col("_clash").cast("int"))
        behind = (F.col("_j") + F.max(F.col("_at") - F.col("_j")).over(own.rowsBetween(Window.unboundedPreceding, 0))).alias("_at")
        after = checkpointed(moved.select(key, "proposed", "_j", behind, "_clash"))
        if after.where("_clash").isEmpty():
            return candidates.join(named.select(key, F.col("_name").alias("slug")), key)
        state = after.drop("_clash")
