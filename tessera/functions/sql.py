"""The rules as SQL: temporary functions of the session, and a table function for the links of a page.

``register(spark)`` makes them known; after that a query can be written in SQL alone.  The functions are SQL expressions, so
they are inlined and stay in generated code; only ``extract_links`` runs Python, on the pages that a query hands to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType

FUNCTIONS = {
    "collapse_spaces(x STRING) RETURNS STRING": r"trim(regexp_replace(x, '\\s+', ' '))",
    "letters_of(x STRING) RETURNS STRING": "regexp_replace(x, '[^A-Za-z]', '')",
    "all_caps(title STRING) RETURNS BOOLEAN": "coalesce(length(letters_of(title)) > 6 AND length(regexp_replace(title, '[^A-Z]', '')) > 0.75D * length(letters_of(title)), false)",
    "url_host(url STRING) RETURNS STRING": r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\\.', '')",
    "to_slug(x STRING) RETURNS STRING": "substring(regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '-'), '^-|-$', ''), 1, 80)",
    "percent_of(part DOUBLE, whole DOUBLE) RETURNS DOUBLE": "round(100 * part / nullif(whole, 0), 1)",
    "half_up(share DOUBLE) RETURNS DOUBLE": "floor(share * 1000 + 0.5) / 10",
    "stage_rank(stage STRING) RETURNS INT": "CASE stage WHEN 'SCALED' THEN 0 WHEN 'MULTIPLE_DEPLOYMENTS' THEN 1 WHEN 'DEPLOYED' THEN 2 WHEN 'PILOT' THEN 3 WHEN 'PROTOTYPE' THEN 4 WHEN 'IDEA' THEN 5 ELSE 6 END",
    "content_digest(a STRING, b STRING, c STRING) RETURNS STRING": "sha2(concat_ws('\\n', collapse_spaces(coalesce(a, '')), collapse_spaces(coalesce(b, '')), collapse_spaces(coalesce(c, ''))), 256)",
}


class ExtractLinks:
    """Rows (place, url, path, own_host) of the links of a page: resolved, without query or fragment, each once."""

    def eval(self, html: str, base: str) -> Iterator[tuple]:
        from tessera.sources.pages import _parse

        host, seen = urlsplit(base or "").hostname, {}
        for href in _parse(html).links:
            to = urlsplit(urljoin(base or "", href))
            if to.scheme in ("http", "https"):
                seen.setdefault(f"{to.scheme}://{to.netloc}{to.path}", (to.path, to.hostname == host))
        for place, (url, (path, own)) in enumerate(seen.items()):
            yield place, url, path, own


LINKS = StructType().add("place", IntegerType()).add("url", StringType()).add("path", StringType()).add("own_host", "boolean")


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session; again does no harm."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("extract_links", udtf(ExtractLinks, returnType=LINKS))


def as_map(json: Column) -> Column:
    """The fields of a JSON object as variants; of anything else none."""
    v = F.try_parse_json(json)
    return F.coalesce(F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>")), F.expr("cast(map() as map<string,variant>)"))


def merged(old: Column, new: Column) -> Column:
    """Two JSON objects as one, as text: the later value of a field wins, also where it is null."""
    a, b = as_map(old), as_map(new)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))


def put(target: Column, path: list[str], value: Column) -> Column:
    """A JSON object with a value (JSON text) at a path; a field that is missing is made, and so are objects on the way to it.
    A list or a single value on the way gives way to an object."""
    if len(path) > 1:
        value = put(F.get_json_object(target, "$['" + path[0] + "']"), path[1:], value)
    return merged(target, F.concat(F.lit("{"), quoted(F.lit(path[0])), F.lit(":"), value, F.lit("}")))


def quoted(text: Column) -> Column:
    """A string as JSON text."""
    listed = F.to_json(F.array(text))
    return listed.substr(F.lit(2), F.length(listed) - 2)
