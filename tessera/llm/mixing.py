"""Mixing sources to target weights, with DataFrame functions only.

A source's target is water-filled: weights share a multiple of all sizes, no target exceeds ``max_epochs`` times its
source's size, and what is cut off is reshared by weight.  Complete epochs come first; the rest of a target is an
Efraimidis-Spirakis sample: each document has the key ``-ln(u) / quality``, and documents are taken in order of their
keys until their prefix sum reaches the rest.

No source is sorted as one group.  Keys fall into about ``bucket_rows`` rows wide buckets; buckets below the one that
holds the end of the rest are taken as wholes, and only the rows of that one bucket are sorted.

Null texts have size 0; a very long text counts whole, and a source's rest ends at the row that brings it nearest.  A
null source is a source of its own and comes last.  Equal rows have equal keys and are counted one by one.  A source of size 0 has target 0.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.textbatch import checkpointed, pick

WORD = r"[^\x20\x09-\x0D]+"


def quality_weight(text: Column, size: Column) -> Column:
    """1 where the mean word has 3 to 12 characters, else 0.5."""
    return F.when((F.length(text) / F.greatest(size, F.lit(1))).between(4, 13), 1.0).otherwise(0.5)


def targets(sources: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, n, target, number) from (source, source_size, n); the table of sources is small."""
    in_order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("ratio", "number")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("number") % len(weights) + 1).cast("int"))
    s = sources.withColumn("number", F.row_number().over(in_order) - 1).withColumn("weight", weight)
    s = s.withColumn("cap", max_epochs * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    s = s.withColumn("total", share * F.sum("source_size").over(every)).withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.sum("weight").over(after)).withColumn("capped", F.col("ratio") <= F.col("level"))
    level = F.min(F.when(~F.col("capped"), F.struct("ratio", "number", "level"))).over(every)["level"]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return s.select("source", "source_size", "n", target.cast("double").alias("target"), F.col("number").cast("int").alias("number"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: int = 2,
    quality=quality_weight,
    seed: int = 0,
    bucket_rows: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, row, size, source_size, target, copies, taken) for each row, and the columns to carry.

    ``row`` is an xxhash64 of id and text; a row's key is drawn from it, so null or repeated ids with different texts
    are drawn apart.
    """
    src = pick(docs, doc_id=id_col, text=text_col, source=source_col, **{c: c for c in carry})
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    row = F.xxhash64("doc_id", F.lit(1), "text")
    u = ((F.xxhash64(F.lit(seed), row).bitwiseAND((1 << 52) - 1)) + 0.5) / float(1 << 52)
    sized = checkpointed(
        src.withColumn("size", size)
        .select("doc_id", "source", "size", *carry, row.alias("row"), (-F.log(u) / quality(F.col("text"), F.col("size"))).alias("key"))
    )
    by_source = checkpointed(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, max_epochs))
    small = by_source.count() <= 100_000
    own = F.broadcast(by_source.withColumnRenamed("source", "s")) if small else by_source.withColumnRenamed("source", "s")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    n_buckets = F.ceil(F.col("n") / bucket_rows)
    rows = (
        sized.join(own, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("epochs", epochs)
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * n_buckets), n_buckets - 1).cast("long"))
        .drop("s", "source", "n")
    )
    # bucket sums: a few rows for each source
    sums = rows.groupBy("number", "bucket").agg(F.sum("size").alias("in_bucket"), F.first("rest").alias("rest"))
    upto = F.sum("in_bucket").over(Window.partitionBy("number").orderBy("bucket"))
    sums = sums.withColumn("before", upto - F.col("in_bucket"))
    cut = sums.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("in_bucket") > F.col("rest")))
    cut = checkpointed(cut.select(F.col("number").alias("cut_number"), F.col("bucket").alias("cut"), "before"))
    cut = F.broadcast(cut) if small else cut  # one row for each source at most
    rows = rows.join(cut, F.col("number") == F.col("cut_number"), "left")
    # no cut: the rest holds the whole source (only where it is 0 in size)
    at_cut = F.col("bucket") == F.col("cut")
    cum = F.sum("size").over(Window.partitionBy("number").orderBy("key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    over, under = cum - F.col("rest"), F.col("rest") - (cum - F.col("size"))
    chosen = rows.where(at_cut).withColumn("chosen", (over <= 0) | ((under > 0) & (over < under)))
    whole = rows.where(F.coalesce(~at_cut, F.lit(True))).withColumn("chosen", F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False)))
    copies = F.col("epochs") + F.col("chosen").cast("long")
    out = chosen.unionByName(whole).withColumn("copies", copies)
    return out.select("doc_id", "row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carry)
