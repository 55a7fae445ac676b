"""Vector distance as Column expressions: cosine distance, bounded nearest rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import FloatType

from tessera.cluster import checkpointed
from tessera.operators.graph import usable

#: Rows of a block and of a cell of a near-pair search, rows compared with a run at once, pairs worked out exactly at once,
#: and pivots at most.
BLOCK_ROWS, CELL_ROWS, CHUNK_ROWS, EXACT_PAIRS, PIVOTS = 8192, 2048, 1024, 1 << 14, 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def within(vectors: DataFrame, query: Sequence[float], bound: float | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, distance): all rows within ``bound``, if one is given; vectors of another dimension take no part."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) == len(query)))
    rows = rows.select(F.col(id_col).alias("id"), cosine_distance(F.col(vector_col), q).alias("distance"))
    return rows if bound is None else rows.where(F.col("distance") <= bound)


def nearest(vectors: DataFrame, query: Sequence[float], k: int, bound: float | None = None, id_col: str = "id", vector_col: str = "embedding", among: DataFrame | None = None) -> DataFrame:
    """(id, distance): the k nearest rows, within ``bound`` and of those of ``among`` (id) if they are given."""
    rows = within(vectors, query, bound, id_col, vector_col)
    rows = rows if among is None else rows.join(among.select("id"), "id", "left_semi")
    return rows.orderBy("distance", "id").limit(k)


def of(vectors: DataFrame, key: int, id_col: str = "vec_id", vector_col: str = "embedding") -> list[float]:
    """One row's vector, to be a literal; an unknown key has none."""
    row = vectors.where(F.col(id_col) == key).select(vector_col).first()
    return list(row[0]) if row and row[0] else []


def near_pairs(vectors: DataFrame, bound: float, id_col: str = "id", vector_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """(a, b, distance), a < b: all pairs of rows of different ids at a cosine distance below ``bound``.

    On unit vectors that is an angle below a bound, and angles obey the triangle inequality.  A row belongs to the cell of
    its nearest of a few sampled pivots.  Rows are sorted by cell and angle to its pivot and packed into stored blocks of
    bounded size, and every block meets every other one once.  Of two runs of a cell in them, rows whose angle to the other
    run's pivot lies further than the bound outside that run's angles are left out; the others are compared in single
    precision, with a margin, and what passes exactly.  So no row is copied for the cells it may have to visit: a task
    holds two blocks, whatever the table's size, and only the blocks are stored.  Rows of another dimension than most,
    null and zero vectors, and those with components that are null or not finite have no pairs.
    """
    spark, schema = vectors.sparkSession, "a long, b long, distance double"
    v = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    kind = "<f4" if v.schema["v"].dataType.elementType == FloatType() else "<f8"
    v = v.withColumn("v", F.col("v").cast("array<float>" if kind == "<f4" else "array<double>"))
    most = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if not most:
        return spark.createDataFrame([], schema)
    dims, n = most["d"], most["n"]
    v = v.where(F.size("v") == dims)
    k = pivots or min(PIVOTS, max(1, math.ceil(n / CELL_ROWS)))
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    centres = unit(np.stack(v.orderBy(F.xxhash64("id"), "id").limit(k).toPandas()["v"].to_numpy()).astype(float))  # k rows
    angle, slack, margin = math.acos(max(-1.0, 1 - bound)), 2e-3, 1e-6 + 2e-7 * dims

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cell of each row, and its angle to the cell's pivot."""
        for batch in batches:
            for rows in (batch.slice(at, CHUNK_ROWS) for at in range(0, batch.num_rows, CHUNK_ROWS)):
                x = rows["v"].flatten().to_numpy().reshape(-1, dims)
                theta = np.arccos(np.clip(unit(x.astype(float)) @ centres.T, -1, 1))
                own = theta.argmin(axis=1)
                blobs = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * x[:1].nbytes), pa.py_buffer(np.ascontiguousarray(x, kind))])
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(theta[np.arange(len(x)), own]), rows["id"], blobs], names=["cell", "theta", "id", "blob"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            made = [t["cell"].to_numpy().astype("<i4"), t["theta"].to_numpy().astype("<f8"), t["id"].to_numpy().astype("<i8")]
            return pa.RecordBatch.from_arrays([pa.array([number]), *[pa.array([m.tobytes()], pa.binary()) for m in made], pa.array([b"".join(t["blob"].to_pylist())], pa.binary())], names=["block", "cells", "thetas", "ids", "blobs"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, BLOCK_ROWS - size))
                at, size = at + held[-1].num_rows, size + held[-1].num_rows
                if size == BLOCK_ROWS:
                    yield block()
                    held, size, number = [], 0, number + 1
        if size:
            yield block()

    parts = max(1, math.ceil(n / (2 * BLOCK_ROWS)))
    filed = v.mapInArrow(file, "cell int, theta double, id long, blob binary").repartitionByRange(parts, "cell", "theta", "id").sortWithinPartitions("cell", "theta", "id")
    blocks = checkpointed(filed.coalesce(parts).mapInArrow(pack, "block long, cells binary, thetas binary, ids binary, blobs binary"))
    sides = [blocks.select(*[F.col(c).alias(f"{c}_{side}") for c in blocks.columns]) for side in "xy"]
    own = centres.astype(np.float32)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                read = lambda name, kind: np.frombuffer(batch[name][r].as_buffer(), kind)  # noqa: E731, B023
                same = batch["block_x"][r].as_py() == batch["block_y"][r].as_py()
                x, y = (_Block(read(f"cells_{s}", "<i4"), read(f"thetas_{s}", "<f8"), read(f"ids_{s}", "<i8"), read(f"blobs_{s}", kind).reshape(-1, dims)) for s in "xy")
                for i, j, d in _met(x, y, same, own, bound, angle + slack, margin):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(d)], names=["a", "b", "distance"])

    return sides[0].crossJoin(sides[1]).where("block_x <= block_y").mapInArrow(meet, schema)


class _Block:
    """Rows sorted by cell and angle, their unit vectors in single precision, and where a run of a cell begins and ends."""

    def __init__(self, cells: np.ndarray, thetas: np.ndarray, ids: np.ndarray, x: np.ndarray):
        self.thetas, self.ids, self.x = thetas, ids, x
        long = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=float))
        self.unit = (x / long[:, None]).astype(np.float32)
        edges = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True])
        self.runs = [(int(cells[a]), int(a), int(b), thetas[a:b].min(), thetas[a:b].max()) for a, b in zip(edges[:-1], edges[1:])]


def _met(x: _Block, y: _Block, same: bool, centres: np.ndarray, bound: float, angle: float, margin: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, ids, distances) of the near pairs of two blocks, or of one with itself, some at a time."""
    to = lambda b, other: np.arccos(np.clip(b.unit @ centres[[r[0] for r in other.runs]].T, -1, 1))
    x_to, y_to = to(x, y), to(y, x)
    for a, (_, x0, x1, x_low, x_high) in enumerate(x.runs):
        for b, (_, y0, y1, y_low, y_high) in enumerate(y.runs):
            if same and b < a:
                continue
            p = x0 + np.flatnonzero((x_to[x0:x1, b] >= y_low - angle) & (x_to[x0:x1, b] <= y_high + angle))
            q = y0 + np.flatnonzero((y_to[y0:y1, a] >= x_low - angle) & (y_to[y0:y1, a] <= x_high + angle))
            if not len(p) or not len(q):
                continue
            right = y.unit[q].T
            for at in range(0, len(p), CHUNK_ROWS):
                some = p[at : at + CHUNK_ROWS]
                i, j = np.divmod(np.flatnonzero((x.unit[some] @ right > 1 - bound - margin).ravel()), len(q))
                for start in range(0, len(i), EXACT_PAIRS):
                    u, w = some[i[start : start + EXACT_PAIRS]], q[j[start : start + EXACT_PAIRS]]
                    keep = (x.ids[u] != y.ids[w]) & ((u < w) | (not same))
                    u, w = u[keep], w[keep]
                    left, other = x.x[u].astype(float), y.x[w].astype(float)
                    dot = lambda s, t: np.einsum("ij,ij->i", s, t)
                    d = 1 - dot(left, other) / (np.sqrt(dot(left, left)) * np.sqrt(dot(other, other)))
                    near = d < bound
                    if near.any():
                        yield x.ids[u[near]], y.ids[w[near]], d[near]
