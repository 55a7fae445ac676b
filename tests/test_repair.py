"""Repairs against exact values."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import repair as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_slug_like(spark):
    assert one(spark, P.slug_like(F.lit("a-pump-for-dry-2"))) and not one(spark, P.slug_like(F.lit("A pump for dry")))


LONG = "A long enough first paragraph that tells what the thing is about. More."


@pytest.mark.parametrize(
    "title,summary,body,meta,want",
    [
        ("Pump", "A solar pump for small farms", "x", None, "A solar pump for small farms"),
        ("Pump", "pump", "short\n\n" + LONG, None, LONG),
        ("Pump", "pump-solar-farm", LONG, "A description of the page", "A description of the page"),
        ("Pump", "tiny", "x", "Pump", ""),
        ("Pump", None, None, None, ""),
    ],
)
def test_summaries(spark, title, summary, body, meta, want):
    s = lambda x: F.lit(x).cast("string")
    assert one(spark, P.repaired_summary(s(title), s(summary), s(body), s(meta))) == want


def test_colon_titles(spark):
    got = one(spark, P.merged_title(F.lit("River works:"), F.lit("Filters that towns build. They last.")))
    assert tuple(got) == ("River works: Filters that towns build.", "They last.")
    assert tuple(one(spark, P.merged_title(F.lit("No colon"), F.lit("S.")))) == ("No colon", "S.")
    assert one(spark, P.country_name(F.lit(" usa "))) == "USA" and one(spark, P.country_name(F.lit(" "))) is None


GOOD = {"title": "A fine and whole title", "summary": "s" * 90, "body": "b" * 200}


@pytest.mark.parametrize(
    "status,old,new,want",
    [
        ("AUTO", GOOD, GOOD | {"body": "b" * 100}, ("A fine and whole title", True)),
        ("AUTO", GOOD, GOOD | {"title": "HOME"}, ("A fine and whole title", True)),
        ("AUTO", GOOD, GOOD | {"title": "Another fine whole title", "body": "c" * 300}, ("Another fine whole title", False)),
        ("AUTO", GOOD, GOOD, ("A fine and whole title", True)),
        ("NEEDS_REVIEW", GOOD, GOOD | {"title": "A fine an"}, ("A fine and whole title", False)),
        ("SOURCE_LIMITED", GOOD | {"summary": "s", "body": "b"}, GOOD | {"summary": "s", "body": "b"}, ("A fine and whole title", True)),
        ("SOURCE_LIMITED", GOOD | {"summary": "s", "body": "b"}, GOOD, ("A fine and whole title", False)),
    ],
)
def test_preserving_merge(spark, status, old, new, want):
    lit = lambda d: {k: F.lit(v) for k, v in d.items()}
    got = one(spark, P.preserved(F.lit(status), lit(old), lit(new)))
    assert (got.title, got.unchanged) == want
    assert len(got.body) >= len(old["body"])
