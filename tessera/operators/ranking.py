"""Top-1 and top-k per key, caps, de-duplication and rank fusion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; ``order`` should end with a unique column."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def cap_per_key(df: DataFrame, key: str, most: int, order: list[Column], limit: int | None = None) -> DataFrame:
    """At most ``most`` rows of each key in rank order, then the first ``limit``; blank keys count as one key."""
    k = F.coalesce(F.nullif(F.trim(F.col(key).cast("string")), F.lit("")), F.lit("unknown"))
    kept = df.withColumn("_n", F.row_number().over(Window.partitionBy(k).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
    return kept.orderBy(*order).limit(limit) if limit is not None else kept


def source_cap(limit: int) -> int:
    return max(2, math.ceil(limit / 4))


def bucket_cap(limit: int) -> int:
    return max(1, math.ceil(limit / 5))


def dedupe_first_seen(df: DataFrame, title: Column, organisation: Column, order: list[Column]) -> DataFrame:
    """The best-ranked row of each normalised title and organisation; rows with neither are all kept."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    keyed = df.withColumn("_key", F.concat_ws("|", norm(title), norm(organisation)))
    w = Window.partitionBy("_key").orderBy(*order)
    # rows without a key never meet in one window
    best = keyed.where(F.col("_key") != "|").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return best.unionByName(keyed.where(F.col("_key") == "|")).drop("_key")


def distinct_in_order(lists: list[DataFrame], column: str) -> DataFrame:
    """(column, place): values of several lists (column, place), each once, where it comes first, in the lists' order.

    For lists of a page's or a pool's size: places are numbered in one task.
    """
    union = None
    for i, part in enumerate(lists):
        rows = part.select(column, F.lit(i).alias("_list"), F.col("place").alias("_at"))
        union = rows if union is None else union.unionByName(rows)
    first = union.groupBy(column).agg(F.min(F.struct("_list", "_at")).alias("_first"))
    return first.select(column, F.row_number().over(Window.orderBy("_first", column)).alias("place"))


def random_pick(df: DataFrame, key: str, seed: int, exclude: list[int] | None = None) -> DataFrame:
    """One row that looks random and is the same for a seed: the least hash of the seed and the key."""
    rows = df.where(~F.col(key).isin(exclude)) if exclude else df
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(1)


def fuse(lists: dict[str, DataFrame], weights: dict[str, float], k: int = 60) -> DataFrame:
    """(id, score, lists): weighted reciprocal-rank fusion of (id, rank) frames, each already cut to its pool."""
    union = None
    for name, ranked in lists.items():
        part = ranked.select("id", (F.lit(float(weights.get(name, 1.0))) / (k + F.col("rank"))).alias("part"), F.lit(name).alias("list"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("id").agg(F.round(F.sum("part"), 12).alias("score"), F.array_sort(F.collect_set("list")).alias("lists"))


def pool(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """(…, rank): the first ``size`` rows by order; the limit comes first, so only those rows meet in one task."""
    top = df.orderBy(*order).limit(size)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def why_matched(lists: Column) -> Column:
    """A label for the legs that found a row."""
    has = lambda name: F.array_contains(lists, name)
    lexical = has("full_text") | has("or_lexical")
    return F.when(has("semantic") & lexical, "full_text+semantic").when(has("semantic"), "semantic").otherwise("full_text")
