"""Set-at-a-time writes: keyed merge, disappearance, organisation merge, links; the caller writes the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.ranking import first_per_key


def upsert(current: DataFrame, drafts: DataFrame, key: str, hash_col: str, keep_if_blank: list[str]) -> DataFrame:
    """current merged with drafts: new keys inserted, equal hashes only touched, others updated.

    A blank draft value of ``keep_if_blank`` keeps the stored one.  Adds ``outcome``: new, unchanged, updated or absent.
    """
    c, d = current.alias("c"), drafts.alias("d")
    names = [x for x in current.columns if x != key]
    have, come = F.col(f"c.{key}").isNotNull(), F.col(f"d.{key}").isNotNull()
    same = F.col(f"c.{hash_col}").eqNullSafe(F.col(f"d.{hash_col}"))
    outcome = F.when(~come, "absent").when(~have, "new").when(same, "unchanged").otherwise("updated")

    def value(name: str) -> Column:
        old, new = F.col(f"c.{name}"), F.col(f"d.{name}")
        fresh = F.coalesce(F.nullif(F.trim(new.cast("string")), F.lit("")).cast(current.schema[name].dataType), old) if name in keep_if_blank else new
        return F.when(~come | (have & same), old).otherwise(fresh).alias(name)

    joined = c.join(d, F.col(f"c.{key}") == F.col(f"d.{key}"), "full")
    return joined.select(F.coalesce(f"c.{key}", f"d.{key}").alias(key), *map(value, names), outcome.alias("outcome"))


def disappear(items: DataFrame, seen: DataFrame, key: str, limit: int = 2) -> DataFrame:
    """miss_count of items that were not seen grows by one, and at ``limit`` they become inactive; the others reset."""
    flagged = items.join(seen.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left")
    misses = F.when(F.col("_seen"), 0).otherwise(F.col("miss_count") + 1)
    return flagged.withColumn("active", F.col("active") & (misses < limit)).withColumn("miss_count", misses).drop("_seen")


def merge_names(orgs: DataFrame, name_key: Column, order: list[Column], id_col: str = "id") -> DataFrame:
    """(id, canonical_id): rows with one normalised name go to the first of them."""
    keyed = orgs.withColumn("_key", name_key)
    first = first_per_key(keyed, ["_key"], order).select("_key", F.col(id_col).alias("canonical_id"))
    return keyed.join(first, "_key").select(id_col, "canonical_id")


def relink(links: DataFrame, mapping: DataFrame, on: str, keys: list[str]) -> DataFrame:
    """Links pointed at canonical ids, still unique in ``keys``."""
    moved = links.join(mapping.withColumnRenamed("id", on), on, "left").withColumn(on, F.coalesce("canonical_id", on)).drop("canonical_id")
    return moved.dropDuplicates(keys)


def link_absent(links: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """links and those wanted ones that they lack."""
    return links.unionByName(wanted.dropDuplicates(keys).join(links.select(*keys).distinct(), keys, "left_anti"))


def next_positions(items: DataFrame, collection: str, order: list[Column], start: Column) -> DataFrame:
    """Positions after ``start`` for appended items."""
    return items.withColumn("position", start + F.row_number().over(Window.partitionBy(collection).orderBy(*order)))


def listing_skip(hash_now: Column, hash_before: Column, age_days: Column) -> Column:
    """Why a detail page need not be fetched again; null to fetch it."""
    return F.when(hash_before.isNotNull() & (hash_now == hash_before) & (age_days < 30), "listing_unchanged").when(hash_before.isNull() & (age_days < 30), "bootstrap")
