"""Readers of raw pages: links, details, sitemaps, feeds, paged JSON, robots rules; and plain sinks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions import text as T

_HIDDEN = {"script", "style", "noscript"}


class _Page(HTMLParser):
    """Links, title, first heading, meta values and visible text of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links: list[str] = []
        self.meta: dict[str, str] = {}
        self.parts: dict[str, list[str]] = {"title": [], "h1": [], "text": []}
        self._open: list[str] = []
        self._hidden = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif tag == "meta" and a.get("content"):
            self.meta.setdefault((a.get("property") or a.get("name") or "").lower(), a["content"])
        if tag in _HIDDEN:
            self._hidden += 1
        elif tag in ("title", "h1"):
            self._open.append(tag)

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self._hidden = max(0, self._hidden - 1)
        elif tag in self._open:
            self._open.remove(tag)

    def handle_data(self, data):
        if self._hidden:
            return
        for tag in self._open:
            self.parts[tag].append(data)
        if "title" not in self._open:
            self.parts["text"].append(data)

    def get(self, part: str) -> str:
        return " ".join(" ".join(self.parts[part]).split())


def _parse(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def page_links(pages: DataFrame, include: str | None = None, exclude: str | None = None, same_host: bool = True, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url): distinct links of each page, resolved, without query or fragment, of its own host and wanted paths."""
    want, avoid = re.compile(include) if include else None, re.compile(exclude) if exclude else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out: list[tuple] = []
            for key, url, html in zip(rows["id"], rows["url"], rows["html"]):
                host, seen = urlsplit(url or "").hostname, {}
                for href in _parse(html).links:
                    to = urlsplit(urljoin(url or "", href))
                    fine = to.scheme in ("http", "https") and (not same_host or to.hostname == host)
                    if fine and (not want or want.search(to.path)) and not (avoid and avoid.search(to.path)):
                        seen[f"{to.scheme}://{to.netloc}{to.path}"] = None
                out += [(key, u) for u in seen]
            yield pd.DataFrame(out, columns=["page_id", "url"])

    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return src.mapInPandas(run, f"page_id {src.schema['id'].dataType.simpleString()}, url string")


def page_details(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = 4000) -> DataFrame:
    """(page_id, title, summary, body, junk): the heading wins over og:title and title; junk says why a page is no item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, html in zip(rows["id"], rows["html"]):
                p = _parse(html)
                title = p.get("h1") or p.meta.get("og:title", "") or p.get("title")
                summary, body = p.meta.get("og:description") or p.meta.get("description", ""), p.get("text")[:most]
                junk = "no_title" if not title else "blocked_title" if title.strip().lower() in T.BLOCKED_TITLES else "empty_body" if not body else None
                out.append((key, title, summary, body, junk))
            yield pd.DataFrame(out, columns=["page_id", "title", "summary", "body", "junk"])

    src = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return src.mapInPandas(run, f"page_id {src.schema['id'].dataType.simpleString()}, title string, summary string, body string, junk string")


def sitemap_locations(xml: Column) -> Column:
    """Addresses of a sitemap or sitemap index."""
    return F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))


def feed_items(xml: Column) -> Column:
    """(title, link) of each item of a feed."""
    items = F.regexp_extract_all(xml, F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1))
    part = lambda x, tag: F.trim(F.regexp_replace(F.regexp_extract(x, rf"(?is)<{tag}>(.*?)</{tag}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
    return F.transform(items, lambda x: F.struct(part(x, "title").alias("title"), part(x, "link").alias("link")))


def json_records(payload: Column, schema: str, path: str = "$.items") -> Column:
    """Records of a listing payload; malformed payloads have none."""
    return F.coalesce(F.from_json(F.get_json_object(payload, path), f"array<{schema}>"), F.array())


def load_registry(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Source records checked for required fields, repeated ids and schemes; a small table."""
    seen = set()
    for r in records:
        missing = [f for f in ("id", "name", "url") if not r.get(f)]
        if missing or r["id"] in seen or not str(r.get("url", "")).startswith(("http://", "https://")):
            raise ValueError(f"bad source record: {json.dumps(r, default=str)[:200]}")
        seen.add(r["id"])
    return spark.createDataFrame([(r["id"], r["name"], r["url"], bool(r.get("enabled", True))) for r in records], "id string, name string, url string, enabled boolean")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(id, homepage, adapter, collection_url, enabled, record) of a registry file, YAML or JSON with a list ``sources``: each
    entry has an id of its own, a homepage and an adapter, and addresses are of the web.  A registry is small and is read on
    the driver, through Spark's own file systems."""
    raw = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("reading a YAML registry needs the yaml package; a JSON file needs none") from e
        document = yaml.safe_load(raw)
    else:
        document = json.loads(raw)
    sources = document.get("sources") if isinstance(document, dict) else None
    if not isinstance(sources, list):
        raise ValueError(f"source registry {path} has no list of sources")
    ids: set[str] = set()
    for s in sources:
        if not all(s.get(f) for f in ("id", "homepage", "adapter")):
            raise ValueError(f"registry entry without id, homepage or adapter: {json.dumps(s, default=str)[:200]}")
        if s["id"] in ids:
            raise ValueError(f"source id {s['id']} occurs twice")
        ids.add(s["id"])
        if s.get("collection_url") is not None and urlsplit(s["collection_url"]).scheme not in ("http", "https"):
            raise ValueError(f"collection address of {s['id']} is not http(s)")
        if not (urlsplit(s["homepage"]).scheme and urlsplit(s["homepage"]).netloc):
            raise ValueError(f"homepage of {s['id']} is no address")
    rows = [(s["id"], s["homepage"], s["adapter"], s.get("collection_url"), bool(s.get("enabled", True)), json.dumps(s, default=str, sort_keys=True)) for s in sources]
    return spark.createDataFrame(rows, "id string, homepage string, adapter string, collection_url string, enabled boolean, record string")


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A report as csv (with header), json or parquet; arrays joined by bars in csv."""
    if kind == "csv":
        df = df.select(*[F.concat_ws("|", c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        getattr(df.write.mode("overwrite"), kind)(path)
