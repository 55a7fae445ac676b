"""A stored inverted index of stemmed texts with block maxima, and searches that skip blocks (block-max WAND).

Layout, below one folder: ``rows`` holds what a hit shows, sorted by block; ``postings`` holds one row for each stem and
block of ``BLOCK`` neighbouring ids: its documents with the places and weights of the stem, and in columns of their own the
most places and the largest sum of weights of a document, and the largest weight.  Postings are partitioned by segment and bucket of the stem and sorted
by stem and block, so a search reads the buckets of its words, and of these the row groups that it needs.

Texts are cut at everything but letters and digits, lower-cased, and stemmed; stop words have places but no postings.
New documents are a new segment; removed ones are kept in a list that every search leaves out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.cluster import checkpointed
from tessera.functions.stem import stem
from tessera.operators import lexical

#: Neighbouring ids of a block, buckets of stems, and blocks that a search looks into before it knows a bound.
BLOCK, BUCKETS, FIRST = 256, 16, 16
#: Blocks that are named in a predicate, for the scan to skip the others; more of them are joined.
NAMED = 1000
#: Characters of text that are taken apart at once for vectors, and rows that become Python objects at once.
SLICE_CHARS, SLICE_ROWS = 4 << 20, 64
SPOT = "struct<place:int,weight:double>"
POSTINGS = f"stem string, block long, n int, most int, mass double, weight double, docs array<struct<id:long,spots:array<{SPOT}>>>, segment int, bucket int"


@dataclass
class Query:
    """Stems of a query: distinct ones in order, and alternatives of phrases as (stem, place) lists where it has a grammar."""

    stems: list[str]
    grammar: list[tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]] | None

    @classmethod
    def parse(cls, text: str) -> Query:
        kept = lambda t: t not in lexical.STOP_WORDS
        own = list(dict.fromkeys(stem(t) for t in lexical.query_terms(" ".join(lexical.or_words(text))) if kept(t)))
        if not ('"' in text or any(w == "or" or w.startswith("-") for w in text.lower().split())):
            return cls(own, None)
        found: dict[str, int] = {}
        alternatives = []
        for must, never in lexical.parse_query(text).alternatives:
            placed = [[[(found.setdefault(stem(t), len(found)), i) for i, t in enumerate(p) if kept(t)] for p in side] for side in (must, never)]
            must, never = ([p for p in side if p] for side in placed)
            if must or never:
                alternatives.append((must, never))
        return cls(list(found), alternatives)


def _spots(fields: int, weights: Iterable[float], wanted: Iterable[str] | None):
    """(id, stem, spots) of rows (id, n, a text for each field) that come sorted by id, where an n of 1 begins an id.  Texts
    are taken apart in slices of bounded size, each distinct word of which is stemmed once."""
    weights, stop, wanted = np.array(list(weights), float), lexical.STOP_WORDS, None if wanted is None else set(wanted)
    firsts = {w[:1] for w in wanted or ()}  # a stem begins as its words do

    def made(ids: list, rows: list[tuple[int, tuple[str | None, ...]]], kind: pa.DataType) -> pa.RecordBatch:
        terms, lengths = [], []
        for _, texts in rows:
            for text in texts:
                before = len(terms)
                terms += re.findall("[a-z0-9]+", (text or "").lower())
                lengths.append(len(terms) - before)
        size = np.array(lengths, np.int64).reshape(-1, fields)
        each = size.sum(axis=1)
        codes, found = pd.factorize(np.array(terms, dtype=object))
        numbers: dict[str, int] = {}
        number = np.full(len(found) + 1, -1, np.int64)
        for i, t in enumerate(found):
            if t in stop or (wanted is not None and t[0] not in firsts):
                continue
            own = stem(t)
            if wanted is None or own in wanted:
                number[i] = numbers.setdefault(own, len(numbers))
        k = number[codes]
        at = np.flatnonzero(k >= 0)
        key = np.repeat(np.array([i for i, _ in rows], np.int64), each)[at] * (len(numbers) + 1) + k[at]
        place = (np.arange(len(k)) - np.repeat(np.cumsum(each) - each, each))[at]
        weight = np.repeat(np.tile(weights, len(rows)), size.ravel())[at]
        # places rise in a row, so only an id of several rows needs them sorted
        order = np.argsort(key, kind="stable") if len(rows) == len(ids) else np.lexsort((weight, place, key))
        key, place, weight = key[order], place[order], weight[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        spots = pa.ListArray.from_arrays(pa.array(np.r_[new, len(key)], pa.int32()), pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(weight)], ["place", "weight"]))
        stems_ = pa.array(list(numbers), pa.string()).take(pa.array(key[new] % (len(numbers) + 1)))
        return pa.RecordBatch.from_arrays([pa.array(ids, kind).take(pa.array(key[new] // (len(numbers) + 1))), stems_, spots], names=["id", "stem", "spots"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held, kind = [], [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for start in range(0, batch.num_rows, SLICE_ROWS):
                for key, n, *texts in zip(*[c.to_pylist() for c in batch.slice(start, SLICE_ROWS).columns]):
                    if n == 1:
                        if held >= SLICE_CHARS:
                            yield made(ids, rows, kind)
                            ids, rows, held = [], [], 0
                        ids.append(key)
                    rows.append((len(ids) - 1, tuple(texts)))
                    held += sum(len(t) for t in texts if t)
        if rows:
            yield made(ids, rows, kind)

    return run


def vectors(rows: DataFrame, fields: dict[str, float], id_col: str = "id", wanted: Iterable[str] | None = None) -> DataFrame:
    """(id, stem, spots): document vectors, a stem's places and weights in each document, of ``wanted`` stems or all.

    Fields follow one another, and stop words have places alone.  Rows of an id are brought together once, as whole texts,
    so that words are never shuffled; rows that already lie by id stay where they are.
    """
    own = rows.select(F.col(id_col).alias("id"), *[F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(fields)])
    n = F.row_number().over(Window.partitionBy("id").orderBy("id"))
    run = _spots(len(fields), fields.values(), wanted)
    return own.select("id", n.alias("n"), *own.columns[1:]).mapInArrow(run, f"id {own.dtypes[0][1]}, stem string, spots array<{SPOT}>")


def occurrences(rows: DataFrame, fields: dict[str, float], id_col: str = "id", wanted: Iterable[str] | None = None) -> DataFrame:
    """(id, stem, place, weight) of every word but stop words, of ``wanted`` stems or all."""
    return vectors(rows, fields, id_col, wanted).select("id", "stem", F.inline("spots"))


def _postings(fields: dict[str, float]):
    """The postings of the documents of a block: stems in order, of each its documents, of each document its places."""
    names, weights, stop = list(fields), np.array(list(fields.values())), lexical.STOP_WORDS

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        terms, field, counts = [], [], []
        for texts in zip(*[rows[c].to_pylist() for c in names]):
            before = len(terms)
            for f, text in enumerate(texts):
                own = re.findall("[a-z0-9]+", (text or "").lower())
                terms += own
                field.append((f, len(own)))
            counts.append(len(terms) - before)
        codes, found = pd.factorize(np.array(terms, dtype=object))
        numbers: dict[str, int] = {}
        number = np.array([-1 if t in stop else numbers.setdefault(stem(t), len(numbers)) for t in found], np.int64)
        order = sorted(numbers)
        rank = np.zeros(len(order) + 1, np.int64)  # the last place is that of stop words
        rank[[numbers[s] for s in order]] = np.arange(len(order))
        rank[-1] = -1
        k = rank[number[codes]] if len(codes) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(k)) - np.repeat(np.cumsum([0, *counts])[:-1], counts)
        weight = weights[np.repeat([f for f, _ in field], [n for _, n in field])] if field else np.zeros(0)
        at = np.flatnonzero(k >= 0)
        at = at[np.lexsort((place[at], doc[at], k[at]))]
        k, doc, place, weight = k[at], doc[at], place[at], weight[at]
        new_doc = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (doc[1:] != doc[:-1])][: len(k)])
        new_stem = np.flatnonzero(np.r_[True, k[new_doc][1:] != k[new_doc][:-1]][: len(new_doc)])
        spots = pa.ListArray.from_arrays(pa.array(np.r_[new_doc, len(k)], pa.int32()), pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(weight)], ["place", "weight"]))
        docs = pa.StructArray.from_arrays([rows["id"].combine_chunks().take(pa.array(doc[new_doc])), spots], ["id", "spots"])
        most = lambda x: np.maximum.reduceat(x, new_stem) if len(x) else x
        mass = np.add.reduceat(weight, new_doc) if len(k) else weight
        heaviest = np.maximum.reduceat(weight, new_doc) if len(k) else weight
        n = len(new_stem)
        columns = [
            pa.array([order[i] for i in k[new_doc][new_stem]], pa.string()), pa.array([key[0].as_py()] * n, pa.int64()), pa.array(np.diff(np.r_[new_stem, len(new_doc)]), pa.int32()),
            pa.array(most(np.diff(np.r_[new_doc, len(k)])), pa.int32()), pa.array(most(mass), pa.float64()), pa.array(most(heaviest), pa.float64()),
            pa.ListArray.from_arrays(pa.array(np.r_[new_stem, len(new_doc)], pa.int32()), docs),
        ]
        return pa.table(columns, names=["stem", "block", "n", "most", "mass", "weight", "docs"])

    return run


class FullTextIndex:
    """Postings of documents of one integer id, below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, fields: dict[str, float]):
        self.spark, self.folder, self.fields = spark, folder, fields
        self.segments: list[int] = []

    def add(self, rows: DataFrame) -> FullTextIndex:
        """Files documents as a segment; their ids are new.  Columns of texts that are not ``kept`` are not stored."""
        segment = max(self.segments, default=-1) + 1
        texts = rows.select(F.col("id").cast("long").alias("id"), *self.fields).withColumn("block", F.floor(F.col("id") / BLOCK))
        blocks = texts.groupBy("block").applyInArrow(_postings(self.fields), POSTINGS.partition(", segment")[0])
        blocks = blocks.withColumn("bucket", (F.crc32(F.col("stem").cast("binary")) % BUCKETS).cast("int"))
        blocks.repartitionByRange("bucket", "stem", "block").sortWithinPartitions("bucket", "stem", "block").write.partitionBy("bucket").parquet(f"{self.folder}/postings/segment={segment}")
        shown = rows.drop(*[c for c in self.fields if c not in self.kept]).withColumn("block", F.floor(F.col("id") / BLOCK))
        shown.repartitionByRange("block", "id").sortWithinPartitions("block", "id").write.parquet(f"{self.folder}/rows/segment={segment}")
        self.segments.append(segment)
        return self

    #: Fields of text that ``rows`` keeps.
    kept: tuple[str, ...] = ("title", "summary")

    def remove(self, ids: DataFrame) -> FullTextIndex:
        """Documents (id) that no search shows any more."""
        ids.select(F.col("id").cast("long").alias("id")).write.mode("append").parquet(f"{self.folder}/removed")
        self._removed = self.spark.read.schema("id long").parquet(f"{self.folder}/removed")
        return self

    _removed: DataFrame | None = None

    @property
    def rows(self) -> DataFrame:
        """What hits show, of documents that are not removed."""
        found = self.spark.read.option("basePath", f"{self.folder}/rows").parquet(*[f"{self.folder}/rows/segment={s}" for s in self.segments]).drop("segment")
        return found.join(self._removed.distinct(), "id", "left_anti") if self._removed is not None else found

    def postings(self, words: Iterable[str]) -> DataFrame:
        """Postings of stems; only their buckets are read."""
        words = sorted(set(words))
        buckets = sorted({zlib.crc32(w.encode()) % BUCKETS for w in words})
        found = self.spark.read.schema(POSTINGS).option("basePath", f"{self.folder}/postings").parquet(*[f"{self.folder}/postings/segment={s}" for s in self.segments])
        return found.where(F.col("bucket").isin(buckets) & F.col("stem").isin(words))

    def hits(self, query: Query, allowed: DataFrame | None = None, blocks: list[int] | DataFrame | None = None) -> DataFrame:
        """(id, strict, n, density) of the documents that hold any of the query's stems, in the blocks given or all."""
        number = F.coalesce(*[F.when(F.col("stem") == s, F.lit(i)) for i, s in enumerate(query.stems)])
        found, allowed = self.postings(query.stems), self.rows.select("block", "id") if allowed is None else allowed.select("block", "id")
        if isinstance(blocks, list):
            found, allowed = found.where(F.col("block").isin(blocks)), allowed.where(F.col("block").isin(blocks))
        elif blocks is not None:
            found = found.join(blocks, "block", "left_semi")
        spots = found.select("block", number.alias("k"), F.explode("docs").alias("d")).select("block", "d.id", "k", "d.spots").join(allowed, ["block", "id"], "left_semi")
        own = F.flatten(F.collect_list(F.transform("spots", lambda x: F.struct(x["place"].alias("place"), F.col("k").alias("k"), x["weight"].alias("weight")))))
        spots = spots.groupBy("id").agg(F.sort_array(own).alias("spots"), F.count("*").cast("int").alias("n"))
        strict = F.col("n") == len(query.stems) if query.grammar is None else self._grammar(query)
        return spots.select("id", strict.alias("strict"), "n", F.round(lexical.density(F.col("spots"), max(1, len(query.stems))), 9).alias("density"))

    @staticmethod
    def _grammar(query: Query) -> Column:
        at = lambda k, place: F.exists("spots", lambda x: (x["k"] == k) & (x["place"] == place))

        def phrase(parts: list[tuple[int, int]]) -> Column:
            (first, start), more = parts[0], parts[1:]

            def here(x: Column) -> Column:
                out = x["k"] == first
                for k, i in more:
                    out = out & at(k, x["place"] + (i - start))
                return out

            return F.exists("spots", here)

        out = F.lit(False)
        for must, never in query.grammar:
            one = F.lit(True)
            for p in must:
                one = one & phrase(p)
            for p in never:
                one = one & ~phrase(p)
            out = out | one
        return out

    def bounds(self, query: Query) -> DataFrame:
        """(block, present, best): how many of the stems a block has, and a bound of any density in it.  A cover begins at a
        place of its own and is worth at most that place's weight, and at most the largest weight over the number of stems."""
        slim = self.postings(query.stems).groupBy("block").agg(F.count_distinct("stem").cast("int").alias("present"), F.sum("most").alias("most"), F.sum("mass").alias("mass"), F.max("weight").alias("weight"))
        can = F.lit(True) if query.grammar is not None else F.col("present") == len(query.stems)
        return slim.select("block", "present", F.when(can, F.least("mass", F.col("most") * F.col("weight") / max(1, len(query.stems))) + 1e-9).alias("best"))

    def top(self, query: Query, size: int, allowed: DataFrame | None = None) -> DataFrame:
        """(id, strict, n, density): hits among which are the first ``size`` by density of the strict ones, and the first
        ``size`` of all by n; ties go to smaller ids.

        A few blocks of the highest bounds are looked into first; of the others those alone that can still change a pool.
        """
        if not query.stems or not self.segments:
            return self.spark.createDataFrame([], "id long, strict boolean, n int, density double")
        bounds = checkpointed(self.bounds(query))
        first = [r.block for r in bounds.orderBy(F.desc("present"), F.desc_nulls_last("best"), "block").limit(FIRST).collect()]
        found = checkpointed(self.hits(query, allowed, first))

        def last(rows: DataFrame, order: list[Column]):  # of a full pool, which holds ``size`` rows at most
            pool = rows.orderBy(*order).limit(size).select("id", "n", "density").collect()
            return pool[-1] if len(pool) == size else None

        strict, any_ = last(found.where("strict"), [F.desc("density"), F.col("id")]), last(found, [F.desc("n"), F.col("id")])
        wanted = F.col("best").isNotNull() if strict is None else F.col("best") >= strict.density
        if any_ is None:
            wanted = F.lit(True)
        else:
            wanted = wanted | (F.col("present") > any_.n) | ((F.col("present") == any_.n) & (F.col("block") * BLOCK <= any_.id))
        rest = bounds.where(~F.col("block").isin(first) & F.coalesce(wanted, F.lit(False))).select("block")
        named = [r.block for r in rest.limit(NAMED + 1).collect()]
        self.visited = len(first) + len(named)
        if not named:
            return found
        return checkpointed(found.unionByName(self.hits(query, allowed, named if len(named) <= NAMED else rest)))

    #: Blocks that the last search looked into, at least.
    visited = 0
