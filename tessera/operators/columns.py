"""Columns that are worked out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with new columns that later filters and projections read instead of repeating their expressions.

    Spark moves filters and expressions through projections by substitution; a generator of one row stops it.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
