"""Approximate nearest neighbours by largest cosine: an inverted multi-index.

The two halves of each unit vector are quantised separately (k-means on a bounded sample, with more centroids for larger
tables), and every row is filed under its pair of centroids.  A query walks the pairs by summed squared distance with a
heap until the pairs hold ``visit`` of all rows, and at least ``LEAST_VISIT``; their entries are reranked by the exact
cosine of the original vectors.

How much to visit is measured unless it is given: up to ``PROBES`` of the queries are answered exactly, in one pass
over all rows, and ``visit`` becomes the share of rows after which their walks have met ``recall`` of those answers.

Queries and entries meet in (query block, shard) pairs: a group holds about ``QUERY_ROWS`` queries at most, however many
there are, and ``QUERY_STEP`` of them at a time are scored against a cell.  Cells are dealt to shards of about
``SHARD_ROWS`` rows; a cell with more is split over several shards by a hash of the ids, all of which its queries visit,
so no cell is capped.  Equal vectors of a shard are scored once and keep the smallest ids a query can return of them,
whichever id it has to leave out.

Vectors that are null, zero, empty, of another dimension than most, or hold null or non-finite components take no part.
Repeated ids are separate candidates; a query never meets its own id, and a repeated query id asks once, with its least
packed vector.  Fewer than k candidates: all of them.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.textbatch import checkpointed
from tessera.llm.vectors import best, fit_sample, matrix, packed, ranked, unpack, usable

LEAST_CENTROIDS, MOST_CENTROIDS, ROUNDS, SHARD_ROWS, LEAST_SHARDS, LEAST_VISIT = 64, 512, 10, 8192, 16, 2000
QUERY_ROWS, QUERY_STEP, WALK_ROWS, PROBES = 16_384, 256, 64, 64


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * (x @ centroids.T)).argmin(axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from distinct starting rows; at most k centroids."""
    rows = np.unique(x, axis=0)
    centroids = rows[np.random.default_rng(0).permutation(len(rows))[:k]]
    for _ in range(rounds):
        own = nearest(x, centroids)
        for c in range(len(centroids)):
            if (mine := own == c).any():
                centroids[c] = x[mine].mean(axis=0)
    return centroids


def walk(near: np.ndarray, far: np.ndarray, counts: np.ndarray, want: int) -> list[int]:
    """Cells by summed distance, until they hold ``want`` rows; counts: rows of each cell, by first then second half."""
    a, b = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
    heap, seen, cells, rows = [(near[a[0]] + far[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and rows < want:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(far) + int(b[j])
        if counts[cell]:
            cells.append(cell)
            rows += int(counts[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (near[a[x]] + far[b[y]], x, y))
    return cells


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of each pair of rows, in double precision; one row's result does not depend on the others."""
    return (q * v).sum(axis=-1) / (np.sqrt((q * q).sum(axis=-1)) * np.sqrt((v * v).sum(axis=-1)))


def deal(counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first shard, number of shards) of each cell, and the number of shards: small cells share, large ones split."""
    first, number, shard, held = np.zeros(len(counts), int), np.ones(len(counts), int), 0, 0
    for cell in np.flatnonzero(counts):
        if counts[cell] > rows:
            shard += held > 0
            first[cell], number[cell] = shard, math.ceil(counts[cell] / rows)
            shard, held = shard + number[cell], 0
            continue
        if held + counts[cell] > rows:
            shard, held = shard + 1, 0
        first[cell], held = shard, held + counts[cell]
    return first, number, shard + 1


def rerank(q_ids, q, q_cells, ids, v, cells, k: int) -> pd.DataFrame:
    """The k nearest entries of a shard for each query, among those of the cells that it visits."""
    order = np.lexsort((ids, cells))
    ids, v, cells = ids[order], v[order], cells[order]
    visits: dict[int, list[int]] = {}
    for row, own in enumerate(q_cells):
        for c in own:
            visits.setdefault(c, []).append(row)
    got_i = [np.zeros(0, np.int64)] * len(q)
    got_s = [np.zeros(0)] * len(q)
    floor = np.full(len(q), -2.0)  # of each query, its k-th cosine so far
    qu, vu = unit(q), unit(v)
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    for a, b in zip(starts, [*starts[1:], len(cells)]):
        rows = np.array(visits.get(int(cells[a]), []), np.int64)
        if not len(rows):
            continue
        own = np.arange(a, b)
        if b - a > k:  # equal vectors: k rows of an id, then 2 k rows, of which k remain without any one id
            _, group = np.unique(v[a:b], axis=0, return_inverse=True)
            group = group.ravel()
            place = lambda *keys: np.arange(len(keys[0])) - np.maximum.accumulate(np.where(np.r_[True, np.any([x[1:] != x[:-1] for x in keys], axis=0)], np.arange(len(keys[0])), 0))
            by = np.argsort(group, kind="stable")  # ids ascend in a cell
            by = by[place(group[by], ids[a:b][by]) < k]
            own = a + np.sort(by[place(group[by]) < 2 * k])
        for some in (rows[i : i + QUERY_STEP] for i in range(0, len(rows), QUERY_STEP)):
            near = qu[some] @ vu[own].T
            near[ids[own][None, :] == q_ids[some][:, None]] = -3.0
            # a vector that cannot be among the k best of its query so far is left; the slack is for rounding
            for r in np.flatnonzero(near.max(axis=1) >= floor[some] - 1e-9):
                row, s = some[r], near[r]
                cut = max(floor[row], np.partition(s, -k)[-k] if len(s) > k else -2.0)
                cols = own[s >= cut - 1e-9]
                all_i = np.append(got_i[row], ids[cols])
                all_s = np.append(got_s[row], cosines(q[row][None, :], v[cols]))
                top = best(all_i, all_s, k)
                got_i[row], got_s[row] = all_i[top], all_s[top]
                if len(top) == k:
                    floor[row] = all_s[top[-1]]
    n = [len(x) for x in got_i]
    return pd.DataFrame({"query_id": np.repeat(q_ids, n), "vec_id": np.concatenate([*got_i, np.zeros(0, np.int64)]), "score": np.concatenate([*got_s, np.zeros(0)])})


def needed(near: np.ndarray, far: np.ndarray, counts: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The rows that a walk has met after each of some cells."""
    order = np.argsort((near[:, None] + far[None, :]).ravel(), kind="stable")
    met, place = np.cumsum(counts[order]), np.empty(len(order), int)
    place[order] = np.arange(len(order))
    return met[place[cells]]


def exact(index: DataFrame, probes: list[tuple[int, bytes]], dims: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score, cell): the k nearest rows of a few queries, by one pass over all rows."""
    q_ids, q = np.array([i for i, _ in probes]), unpack([b for _, b in probes], dims)
    schema = "query_id long, vec_id long, score double, cell int"

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32))] * len(q)
        for batch in batches:
            if not len(batch):
                continue
            ids, cells, near = batch["vec_id"].to_numpy(), batch["cell"].to_numpy(), unit(q) @ unit(unpack(batch["blob"].to_pylist(), dims)).T
            near[ids[None, :] == q_ids[:, None]] = -3.0
            for i, s in enumerate(near):
                some = np.argpartition(-s, k - 1)[:k] if len(s) > k else np.arange(len(s))
                some = some[s[some] > -2]
                own = [np.append(old, new) for old, new in zip(held[i], (ids[some], s[some], cells[some]))]
                top = best(own[0], own[1], k)
                held[i] = tuple(x[top] for x in own)
        n = [len(x[0]) for x in held]
        columns = [np.repeat(q_ids, n), *(np.concatenate(x) for x in zip(*held))]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["query_id", "vec_id", "score", "cell"])

    found = index.select("vec_id", "cell", "blob").mapInArrow(best_of, schema)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    visit: float | None = None,
    recall: float = 0.95,
    centroids: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query; ``is_query``: a condition on ``vec_id``.

    visit: share of all rows that a query meets, measured for ``recall`` if it is not given; centroids: of each half.
    """
    v, dims = usable(vectors, id_col, vector_col, nonzero=True)
    spark, schema = v.sparkSession, "query_id long, vec_id long, score double"
    if not dims:
        return ranked(spark.createDataFrame([], schema), k)
    half = max(1, dims // 2)
    centroids = centroids or min(MOST_CENTROIDS, max(LEAST_CENTROIDS, math.ceil(4 * v.count() ** 0.25)))
    sample = unit(fit_sample(v, 128 * centroids))
    first, second = k_means(sample[:, :half], centroids), k_means(sample[:, half:], centroids) if dims > 1 else np.zeros((1, 0))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch["v"]) if len(batch) else np.ones((0, dims))
            x = unit(m)
            cell = nearest(x[:, :half], first) * len(second) + nearest(x[:, half:], second)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(cell, pa.int32()), packed(m)], names=["vec_id", "cell", "blob"])

    index = checkpointed(v.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(file, "vec_id long, cell int, blob binary"))
    counts = np.zeros(len(first) * len(second), np.int64)
    for r in index.groupBy("cell").count().collect():  # no more rows than pairs of centroids
        counts[r["cell"]] = r["count"]
    n = int(counts.sum())
    start, number, n_shards = deal(counts, max(256, min(SHARD_ROWS, math.ceil(n / LEAST_SHARDS))))
    asked = checkpointed(index.where(is_query).groupBy("vec_id").agg(F.min("blob").alias("blob")))
    n_queries = asked.count()
    if visit is None and n > LEAST_VISIT:
        probes = [(r["vec_id"], bytes(r["blob"])) for r in asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES).collect()]
        asked_of = {i: unit(unpack([b], dims))[0] for i, b in probes}
        nearest_of: dict[int, list[int]] = {}
        for r in exact(index, probes, dims, k).collect() if probes else ():  # PROBES times k rows
            nearest_of.setdefault(r["query_id"], []).append(r["cell"])
        met = [needed(((first - (x := asked_of[i])[:half]) ** 2).sum(axis=1), ((second - x[half:]) ** 2).sum(axis=1), counts, np.array(c)) for i, c in nearest_of.items()]
        visit = float(np.quantile(np.concatenate(met), recall, method="higher")) / n if met else 1.0
    want = max(math.ceil((1.0 if visit is None else visit) * n), LEAST_VISIT)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, ids = batch["cell"].to_numpy(), batch["vec_id"].to_numpy()
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(start[cell] + spread % number[cell], pa.int32()), *batch.columns], names=["shard", *batch.schema.names])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vec_id, blob in zip(batch["vec_id"].to_pylist(), batch["blob"].to_pylist()):
                x = unit(unpack([blob], dims))[0]
                cells = walk(((first - x[:half]) ** 2).sum(axis=1), ((second - x[half:]) ** 2).sum(axis=1), counts, want)
                by: dict[int, list[int]] = {}
                for c in cells:
                    for s in range(start[c], start[c] + number[c]):
                        by.setdefault(s, []).append(c)
                yield pa.RecordBatch.from_pydict({"query_id": [vec_id] * len(by), "blob": [blob] * len(by), "shard": list(by), "cells": list(by.values())}, schema=pa.schema([("query_id", pa.int64()), ("blob", pa.binary()), ("shard", pa.int32()), ("cells", pa.list_(pa.int32()))]))

    def meet(key, q: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(own):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        return rerank(q["query_id"].to_numpy(), unpack(q["blob"], dims), q["cells"].tolist(), own["vec_id"].to_numpy(), unpack(own["blob"], dims), own["cell"].to_numpy(), k)

    blocks = max(1, math.ceil(n_queries / QUERY_ROWS))
    queries = asked.repartition(max(1, min(10_000, math.ceil(n_queries / WALK_ROWS))), "vec_id").mapInArrow(visits, "query_id long, blob binary, shard int, cells array<int>")
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(7)), F.lit(blocks)).cast("int"))
    entries = index.mapInArrow(shard, "shard int, vec_id long, cell int, blob binary").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["block", "shard"]
    return ranked(queries.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInPandas(meet, schema), k)
