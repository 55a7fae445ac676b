"""Nearest vectors by navigable small-world graphs: one graph for each hash partition, stored, searched by a greedy beam.

A graph's nodes are the vectors of its partition, so its size is bounded whatever the table's.  Each node keeps links to
near nodes of which none stands much nearer to another link than to the node itself, links back, and a place in a ring
through all nodes, so that every node can be reached.  A search walks each graph from a few entries, always on from the
nearest node seen, until none can better what it holds; the partitions' finds are merged.  Only allowed nodes are held, the
others are walked through, so a narrow choice is found whole.  Many queries at once scan graphs that a walk would hold a
good share of, which is exact and takes less time.  Null vectors, zero ones and those with components that are
null or not finite are left out, as are those of another dimension than most.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Vectors of a partition, links of a node, nodes looked at for its links, and nodes a search holds at least.
PART_ROWS, LINKS, LOOKED_AT, HELD, ENTRIES = 5000, 24, 64, 160, 4
#: Queries that meet a graph in one task.
QUERY_ROWS = 16_384
SCHEMA = "part int, n int, ids binary, vectors binary, links binary"
#: Many queries scan a graph's vectors together where a walk of each would hold one of so many nodes or more: measured, a
#: walk takes as long for a node it holds as such a scan for some hundred vectors.  Distances of a scan worked out at once.
SCANNED, SCAN_CELLS = 100, 1 << 20
_CHUNK = 256


def usable(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def links_of(x: np.ndarray, links: int, looked_at: int, seed: int = 0) -> np.ndarray:
    """The links of each unit vector, -1 where it has fewer."""
    n = len(x)
    out = [list() for _ in range(n)]
    k = min(looked_at, n - 1)
    for at in range(0, n, _CHUNK):
        own = x[at : at + _CHUNK]
        near = -(own @ x.T)
        near[np.arange(len(own)), np.arange(at, at + len(own))] = np.inf
        some = np.argpartition(near, k - 1, axis=1)[:, :k] if k else np.zeros((len(own), 0), int)
        some = np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)
        dist = np.take_along_axis(near, some, 1)
        between = -np.einsum("nid,njd->nij", x[some], x[some])
        kept = np.zeros(some.shape, bool)
        for j in range(k):
            # nearer to the node than to any link it has
            clear = ~((between[:, j, :] < dist[:, j : j + 1]) & kept).any(axis=1)
            kept[:, j] = clear & (kept.sum(axis=1) < links // 2)
        for i in range(len(own)):
            chosen = some[i][kept[i]].tolist()
            out[at + i] = chosen + [c for c in some[i].tolist() if c not in chosen][: links // 2 - len(chosen)]
    for i, own in enumerate([list(o) for o in out]):
        for c in own:
            if i not in out[c] and len(out[c]) < links - 1:
                out[c].append(i)
    ring = np.random.default_rng(seed).permutation(n)
    for a, b in zip(ring, np.roll(ring, -1)):
        if a != b and b not in out[a]:
            out[a].append(int(b))
    made = np.full((n, links), -1, "<i4")
    for i, own in enumerate(out):
        made[i, : len(own)] = own
    return made


def walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, held: int, allowed: np.ndarray | None = None) -> list[tuple[float, int]]:
    """(distance, node) of the nearest nodes that a beam of ``held`` finds, nearest first."""
    n = len(x)
    seen = np.zeros(n, bool)
    start = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(int))
    seen[start] = True
    dist = 1 - x[start] @ q
    queue = list(zip(dist.tolist(), start.tolist()))
    heapq.heapify(queue)
    best: list[tuple[float, int]] = []

    def hold(d: float, i: int) -> None:
        if allowed is None or allowed[i]:
            heapq.heappush(best, (-d, i))
            if len(best) > held:
                heapq.heappop(best)

    for d, i in queue:
        hold(d, i)
    while queue:
        d, i = heapq.heappop(queue)
        if len(best) >= held and d > -best[0][0]:
            break
        new = links[i]
        new = new[new >= 0]
        new = new[~seen[new]]
        seen[new] = True
        for e, j in zip((1 - x[new] @ q).tolist(), new.tolist()):
            if len(best) < held or e < -best[0][0]:
                heapq.heappush(queue, (e, j))
                hold(e, j)
    return sorted((-d, i) for d, i in best)


class GraphIndex:
    """Graphs of (id, vector) rows, below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, parts: int, dims: int):
        self.spark, self.folder, self.parts, self.dims = spark, folder, parts, dims

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, id_col: str = "id", vector_col: str = "embedding", part_rows: int = PART_ROWS, links: int = LINKS, looked_at: int = LOOKED_AT) -> GraphIndex:
        v = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        sizes = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
        dims, n = (sizes.d, sizes.n) if sizes else (0, 0)
        parts = max(1, math.ceil(n / part_rows))

        def make(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("id")
            x = rows["v"].combine_chunks().values.to_numpy().reshape(-1, dims)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            blobs = [rows["id"].to_numpy().astype("<i8").tobytes(), unit.astype("<f8").tobytes(), links_of(unit, links, looked_at).tobytes()]
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([len(x)], pa.int32()), *[pa.array([b], pa.binary()) for b in blobs]], names=["part", "n", "ids", "vectors", "links"])

        part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")
        v.where(F.size("v") == dims).select(part, "id", "v").groupBy("part").applyInArrow(make, SCHEMA).write.parquet(folder)
        return cls(vectors.sparkSession, folder, parts, dims)

    def graphs(self, allowed: DataFrame | None) -> DataFrame:
        """The stored graphs, each with those of its ids that are allowed (null: all); graphs without any are left out."""
        graphs = self.spark.read.schema(SCHEMA).parquet(self.folder)
        if allowed is None:
            return graphs.withColumn("allowed", F.lit(None).cast("array<long>"))
        part = F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int").alias("part")
        own = allowed.select(F.col("id").cast("long").alias("id")).select(part, "id").groupBy("part").agg(F.collect_set("id").alias("allowed"))
        return graphs.join(own, "part")  # a partition's share of ids is as bounded as the partition

    def search(self, queries: DataFrame, k: int, held: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, id, distance): the k nearest that are found for each query (query_id, v), of those ``allowed`` (id)."""
        held, dims = max(held or HELD, k), self.dims
        asked = queries.where(usable(F.col("v")) & (F.size("v") == dims)).select(F.col("query_id").cast("long"), F.col("v").cast("array<double>"))
        blocks = max(1, math.ceil(asked.count() / QUERY_ROWS))
        # a block of queries goes to every graph, and a graph to every block of queries
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1)))).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        graphs = self.graphs(allowed).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def meet(graph: pa.Table, queries: pa.Table) -> pa.Table:
            keys, q = queries["query_id"].to_numpy(), queries["v"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for row in graph.to_pylist():
                if row["n"] <= SCANNED * held:
                    found += [(keys[at], i, d) for at, i, d in _scanned(row, q, k)]
                else:
                    walked = [(key, i, d) for key, v in zip(keys, q) for i, d in _found(row, v, k, held)]
                    found += [tuple(map(np.array, zip(*walked)))] if walked else []
            return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], names=["query_id", "id", "distance"])

        met = graphs.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(meet, "query_id long, id long, distance double")
        return met.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("_n") <= k).drop("_n")

    def nearest(self, query: Sequence[float], k: int, bound: float | None = None, held: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """(id, distance): the k nearest to one vector within a bound, nearest first."""
        q, most = np.array(query, float), max(held or HELD, k)
        if len(q) != self.dims or not np.isfinite(q).all() or not q.any():
            return self.spark.createDataFrame([], "id long, distance double")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    found = list(zip(*_found(row, q, k, most))) or ([], [])
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.float64())], names=["id", "distance"])

        found = self.graphs(allowed).mapInArrow(run, "id long, distance double")
        return (found if bound is None else found.where(F.col("distance") <= bound)).orderBy("distance", "id").limit(k)


def _scanned(row: dict, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of queries, ids, distances): the k nearest of a stored graph's vectors to each query, ties by id."""
    ids = np.frombuffer(row["ids"], "<i8")
    x = np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1)
    if row["allowed"] is not None:
        own = np.isin(ids, np.array(row["allowed"], np.int64))
        ids, x = ids[own], x[own]
    k = min(k, len(ids))
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    step = max(1, SCAN_CELLS // max(1, len(ids)))
    for start in range(0, len(q) if k else 0, step):
        some = q[start : start + step]
        near = 1 - some @ x.T
        least = np.partition(near, k - 1, axis=1)[:, k - 1 : k] + 1e-9
        i, j = np.divmod(np.flatnonzero((near <= least).ravel()), len(ids))
        # equal vectors get equal distances only if each is summed up alone
        d = np.concatenate([1 - (some[i[at : at + 16_384]] * x[j[at : at + 16_384]]).sum(axis=1) for at in range(0, len(i), 16_384)])
        order = np.lexsort((ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield start + i[first], ids[j[first]], d[first]


def _found(row: dict, q: np.ndarray, k: int, held: int) -> list[tuple[int, float]]:
    """(id, distance) of what a walk through a stored graph finds."""
    ids = np.frombuffer(row["ids"], "<i8")
    x, links = np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1), np.frombuffer(row["links"], "<i4").reshape(len(ids), -1)
    allowed = None if row["allowed"] is None else np.isin(ids, np.array(row["allowed"], np.int64))
    return [(int(ids[i]), d) for d, i in walk(x, links, q / np.linalg.norm(q), held, allowed)[:k]]
