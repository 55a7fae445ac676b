"""Operators over run logs: breaker, yield, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.cluster import checkpointed


def breaker(attempts: DataFrame, key: str, order: list[Column], failed: Column, streak: int = 25, least: int = 50, share: float = 0.5) -> DataFrame:
    """(key, tripped_at, reason): the first failure at which a key's circuit opens.

    A failure opens it that is the ``streak``-th in a row, or with which over ``share`` of at least ``least`` attempts have
    failed; a success never does.  Attempts are sorted by ranges and a key's log is cut where a range ends: each piece is
    summed up (length, failures, failures at its end), the sums of a key's pieces before each are added up, and the
    attempts of a piece count on from there, so no task holds a whole log.
    """
    cols = [f"_o{i}" for i in range(len(order))]
    rows = attempts.select(key, failed.cast("int").alias("_f"), *[c.alias(n) for c, n in zip(order, cols)]).repartitionByRange(key, *cols).sortWithinPartitions(key, *cols)
    rows = checkpointed(rows.select(key, "_f", F.monotonically_increasing_id().alias("_seq"))).withColumn("_block", F.shiftright("_seq", 33))
    inside = Window.partitionBy(key, "_block").orderBy("_seq")
    rows = rows.withColumn("_i", F.row_number().over(inside)).withColumn("_bad", F.sum("_f").over(inside)).withColumn("_ok", F.max(F.when(F.col("_f") == 0, F.col("_i"))).over(inside))
    pieces = rows.groupBy(key, "_block").agg(F.count("*").alias("n"), F.max("_bad").alias("bad"), F.max("_ok").alias("ok"))
    upto, before = (Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    pieces = pieces.withColumn("all", F.sum("n").over(upto))
    last = F.max(F.when(F.col("ok").isNotNull(), F.struct("_block", "all", (F.col("n") - F.col("ok")).alias("tail")))).over(before)
    pieces = pieces.withColumn("last", last).select(key, "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("bad").over(before), F.lit(0)).alias("_bad0"), "last")
    pieces = pieces.withColumn("_run0", F.col("_n0") - F.coalesce(F.col("last.all") - F.col("last.tail"), F.lit(0))).drop("last")
    rows = rows.join(pieces, [key, "_block"]).withColumn("_n", F.col("_n0") + F.col("_i")).withColumn("_failed", F.col("_bad0") + F.col("_bad"))
    run = F.when(F.col("_ok").isNull(), F.col("_run0") + F.col("_i")).otherwise(F.col("_i") - F.col("_ok"))
    reason = F.when(run >= streak, "consecutive").when((F.col("_n") >= least) & (F.col("_failed") > share * F.col("_n")), "rate")
    hit = rows.where("_f = 1").withColumn("reason", reason).where("reason is not null")
    return hit.groupBy(key).agg(F.min_by(F.struct("_n", "reason"), "_n").alias("first")).select(key, F.col("first._n").cast("long").alias("tripped_at"), F.col("first.reason").alias("reason"))


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole to one decimal, null where whole is 0."""
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), 1)


def coverage(share: Column) -> Column:
    """A share as a percentage, rounded half up to one decimal."""
    return F.floor(share * 1000 + 0.5) / 10

