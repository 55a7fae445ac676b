"""Discovery over stored payloads: sitemaps, listings, feeds and cards, paged JSON, robots rules, embedded state, images."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.cluster import checkpointed
from tessera.functions import text as T
from tessera.operators.ranking import first_per_key


def walk(start: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """(url, depth) reached from ``start`` (url) over ``links`` (from_url, url) in at most ``depth`` steps.

    Each round joins the last round's addresses and leaves out all that are known; rounds are written, so the plan of a
    deep walk stays as small as that of a shallow one.
    """
    seen = checkpointed(start.select("url").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for d in range(1, depth + 1):
        step = links.join(frontier.select(F.col("url").alias("from_url")), "from_url").select("url").distinct()
        frontier = checkpointed(step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = checkpointed(seen.unionByName(frontier))
    return seen


def sitemap_pages(files: DataFrame, roots: DataFrame, depth: int = 3, include: str | None = None) -> DataFrame:
    """(url): pages that sitemaps list, indexes followed; files: (url, xml), roots: (url).  A listed address that is itself
    a stored file is an index's; the others are pages, each once."""
    listed = files.select(F.col("url").alias("from_url"), F.explode(F.regexp_extract_all("xml", F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url"))
    met = walk(roots, listed, depth).select("url").join(files.select("url"), "url", "left_anti")
    return met.where(F.col("url").rlike(include)) if include else met


def merged_listing(feed: DataFrame, cards: DataFrame, key: str) -> DataFrame:
    """Rows of a feed and of listing cards, one for each key; where both have it the cards' row, which comes later, stands."""
    both = feed.withColumn("_place", F.lit(0)).unionByName(cards.withColumn("_place", F.lit(1)), allowMissingColumns=True)
    return first_per_key(both, [key], [F.desc("_place"), *[F.col(c) for c in feed.columns if c != key]]).drop("_place")


def paged_records(payloads: DataFrame, schema: str, size: int, path: str = "$.items", by: str = "listing", required: tuple[str, ...] = ("id", "title")) -> DataFrame:
    """Records of paged JSON listings, each once: pages up to the first short one, records without a required field left out.

    payloads: (listing, page, payload), page from 1; a malformed payload has no records and so ends its listing.
    """
    rows = payloads.withColumn("_r", F.coalesce(F.from_json(F.get_json_object("payload", path), f"array<{schema}>"), F.array()))
    short = rows.where(F.size("_r") < size).groupBy(by).agg(F.min("page").alias("_last"))
    read = rows.join(short, by, "left").where(F.col("_last").isNull() | (F.col("page") <= F.col("_last")))
    flat = read.select(by, "page", F.inline("_r"))
    for c in required:
        flat = flat.where(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    return first_per_key(flat, [by, required[0]], [F.col("page")])


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, agent, allow, pattern, delay) of robots files (host, rules); a rule stands once for each agent of its group.

    A row with a null pattern says that a group is there, and its crawl delay if that is a number.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out: list[tuple] = []
            for host, text in zip(rows["host"], rows["rules"]):
                names: list[str] = []
                fresh = False
                for line in (text or "").splitlines():
                    key, _, value = (x.strip() for x in line.split("#")[0].partition(":"))
                    if key.lower() == "user-agent":
                        names = [*names, value.lower()] if fresh else [value.lower()]
                        fresh = True
                        out.append((host, value.lower(), None, None, None))
                    elif key.lower() in ("allow", "disallow") and names:
                        fresh = False
                        out += [(host, n, key.lower() == "allow", value, None) for n in names if value]
                    elif key.lower() == "crawl-delay" and names:
                        fresh = False
                        out += [(host, n, None, None, float(value)) for n in names if value.replace(".", "", 1).isdigit()]
            yield pd.DataFrame(out, columns=["host", "agent", "allow", "pattern", "delay"])

    return files.select("host", "rules").mapInPandas(run, "host string, agent string, allow boolean, pattern string, delay double")


def robots_decisions(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """requests (id, host, agent, path) with ``allowed`` and ``delay``: of the longest group name that the agent holds, or of
    ``*``, the longest matching pattern decides, and allow wins ties; without any the path is allowed."""
    named = requests.join(rules.select("host", F.col("agent").alias("_group")).distinct(), "host", "left")
    fits = (F.col("_group") != "*") & F.lower("agent").contains(F.col("_group"))
    best = F.max(F.when(fits, F.struct(F.length("_group").alias("n"), F.col("_group").alias("g"))))
    chosen = named.groupBy("id", "host", "agent", "path").agg(F.coalesce(best["g"], F.max(F.when(F.col("_group") == "*", F.col("_group")))).alias("_group"))
    joined = chosen.join(rules.withColumnRenamed("agent", "_group"), ["host", "_group"], "left")
    quoted = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.col("pattern"), r"([.+?^{}()|\[\]\\])", r"\\$1"), r"\*", ".*"))
    hit = F.when(F.rlike(F.col("path"), quoted), F.struct(F.length("pattern").alias("n"), F.col("allow").alias("ok")))
    return joined.groupBy("id", "host", "agent", "path").agg(F.coalesce(F.max(hit)["ok"], F.lit(True)).alias("allowed"), F.max("delay").alias("delay"))


# Titles of pages that are no items, and parts of images' names that only decorate.
BOILERPLATE = "^(home|about|contact|menu|search|privacy|terms|subscribe|read more|share|portfolio|insights|news|blog)$"
DECORATIVE = r"(?i)(logo|icon|sprite|placeholder|avatar|favicon|blank|pixel|spacer)"


def _meta(html: Column, name: str) -> Column:
    """The content of a meta tag by property or name, in either order of its attributes."""
    one = F.regexp_extract(html, rf"(?is)<meta\b[^>]*(?:property|name)=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)", 1)
    two = F.regexp_extract(html, rf"(?is)<meta\b[^>]*content=[\"']([^\"']*)[\"'][^>]*(?:property|name)=[\"']{name}[\"']", 1)
    return F.coalesce(F.nullif(F.trim(one), F.lit("")), F.nullif(F.trim(two), F.lit("")))


def linked_data(html: Column) -> Column:
    """The first embedded linked-data object, as JSON text."""
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", 1)), F.lit(""))


def embedded_state(html: Column, name: str) -> Column:
    """The JSON object of a script tag with an id, as text."""
    return F.nullif(F.trim(F.regexp_extract(html, rf"(?is)<script[^>]*id=[\"']{name}[\"'][^>]*>(.*?)</script>", 1)), F.lit(""))


def page_title(html: Column) -> Column:
    """A page's title: its heading, linked data's name, og:title, the title tag; boilerplate is passed over."""
    tag = lambda t: F.nullif(T.html_to_text(F.regexp_extract(html, rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1)), F.lit(""))
    fine = lambda c: F.when(~F.lower(c).rlike(BOILERPLATE), c)
    return F.coalesce(fine(tag("h1")), fine(F.get_json_object(linked_data(html), "$.name")), fine(_meta(html, "og:title")), fine(tag("title")))


def page_image(html: Column) -> Column:
    """A page's image: its meta tag, linked data's image, the first image of the article; images that decorate are none."""
    article = F.regexp_extract(F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*?)</article>", 1), r"(?is)<img\b[^>]*src=[\"']([^\"']+)", 1)
    data = linked_data(html)
    fine = lambda c: F.when((F.trim(c) != "") & ~c.rlike(DECORATIVE) & ~c.startswith("data:"), F.trim(c))
    return F.coalesce(fine(_meta(html, "og:image")), fine(F.coalesce(F.get_json_object(data, "$.image.url"), F.get_json_object(data, "$.image"))), fine(article))


def hub_rows(readers: list[DataFrame]) -> DataFrame:
    """(host, name, url) of several directories (name, url), one row for each host: that of the first directory."""
    union = None
    for i, r in enumerate(readers):
        rows = r.select(F.lit(i).alias("_from"), "name", T.canonical_url(F.col("url")).alias("url")).withColumn("host", T.website_host(F.col("url")))
        union = rows if union is None else union.unionByName(rows)
    return first_per_key(union.where("host <> ''"), ["host"], [F.col("_from"), F.col("name")]).select("host", "name", "url")


def retryable(status: Column) -> Column:
    """HTTP statuses after which a fetch is tried again."""
    return status.isin(408, 425, 429) | status.between(500, 599)
