"""The bounded sample of labelled rows that the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.textbatch import checkpointed, pick

#: Labelled rows that a classifier sees at most: those with the least hashes of their ids.
SAMPLE = 20_000


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", unlabelled: int = 0) -> DataFrame:
    """(text, y) of at most ``rows`` labelled documents outside the held-out fold; contrary labels of one id count as 1.

    With ``unlabelled``, as many documents without a label follow, outside that fold too, their y null.  An id stands for
    one of its texts, that of the least hash, however often it is repeated.  Null ids and null labels are left out.
    """
    known = pick(labels, id=label_id_col, y=label).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    src = pick(docs, doc_id=id_col, text=text_col)
    if unlabelled:
        other = src.select(F.col("doc_id").alias("id")).where(F.col("id").isNotNull() & ~held_out(F.col("id")))
        other = other.join(pick(labels, id=label_id_col), "id", "left_anti").distinct().orderBy(F.xxhash64("id"), "id").limit(unlabelled)
        known = known.unionByName(other.withColumn("y", F.lit(None).cast("int")))
    found = src.join(F.broadcast(known), F.col("doc_id") == F.col("id")).withColumn("text", F.coalesce("text", F.lit("")))
    return checkpointed(found.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"), F.max("y").alias("y")).select("text", "y"))
