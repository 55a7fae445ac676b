"""A corpus pipeline of five operators, each stage written as Parquet and read again.

Toxic documents go; of each group of near duplicates one document stays (the one of the smallest id); secrets are
replaced by a mark; sources are mixed to their targets, a document standing in the result once for each time it is
taken; the last stage encodes and decodes what is left.

Every stage takes rows as they come: null ids, texts and sources, empty texts, texts of any length (read whole), repeated
rows and repeated ids, and empty tables, which stay empty.  A null or empty text is never toxic by its words, has no
near duplicates and no secrets, counts no words in the mix (so it is not taken) and encodes to no ids.  Of equal rows in
a group of near duplicates one stays; the mix counts equal rows one by one.  Extra columns are carried along whatever
their names: inside a stage all but doc_id, text and source are named by their places.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import bpe, jaccard, mixing, secret_scan, toxicity
from tessera.llm.textbatch import checkpointed, row_key, row_keys, shared_dir, table

#: Keys that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_ROWS = 500_000
OWN = ("doc_id", "text", "source")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def by_place(stage: Stage) -> Stage:
    """The stage over columns that cannot clash; its result has the names of its input."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        flat = docs.toDF(*[c if c in OWN and names.index(c) == i else f"__{i}" for i, c in enumerate(names)])
        return stage(spark, flat, sf_dir).toDF(*names)

    return run


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


@by_place
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), carry=True)
    return scored.where("predicted = 0").select(docs.columns)


@by_place
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, and one row of it; rows with a null id stay."""
    found = checkpointed(jaccard.groups(docs, count_links=False).where("doc_id is not null").select("component_id", "doc_id", F.col("key").alias("__key")))
    best = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "__key")).alias("best"), F.count("*").alias("n"))
    best = checkpointed(best.where("n > 1").select("component_id", "best"))
    stays = F.col("best") == F.struct("doc_id", "__key")
    marked = checkpointed(found.join(_few(best), "component_id").groupBy("doc_id", "__key").agg(F.max(stays).alias("stays"), F.count("*").alias("n")))
    row, keyed = ["doc_id", "__key"], docs.withColumn("__key", row_key(F.col("doc_id"), F.col("text")))
    whole = keyed.join(_few(marked.where("not stays or n > 1").select(row)), row, "left_anti")
    # rows of one id and text: that of the least hash over all columns
    several = keyed.join(_few(marked.where("stays and n > 1").select(row)), row, "left_semi").withColumn("__row", F.struct(*row_keys(docs)))
    one = several.groupBy(*row).agg(F.min_by(F.struct(docs.columns), "__row").alias("__one")).select("__one.*")
    return whole.select(docs.columns).unionByName(one)


@by_place
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept finding is replaced by a mark."""
    return secret_scan.redact(docs, vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"))


@by_place
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows that are equal in every column share what they are taken."""
    one, two = row_keys(docs)
    keyed = docs.withColumn("__one", one).withColumn("__two", two)
    taken = mixing.mix(keyed, carry=["__one", "__two"]).groupBy("__one", "__two").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__n"))
    kept = keyed.join(taken.where("__copies > 0"), ["__one", "__two"])
    once = kept.where("__n = 1").unionByName(kept.where("__n > 1").dropDuplicates(["__one", "__two"]))
    return once.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL expresses neither the classifiers nor the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder, docs = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
