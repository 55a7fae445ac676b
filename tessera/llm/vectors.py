"""Shared parts of the vector searches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.textbatch import pick

#: Rows that a fitted rotation or quantiser sees; the rows with the least hashes of their ids.
SAMPLE = 8192


def finite(column: str) -> Column:
    """Not null, not empty, and every component a finite number."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~F.coalesce(bad, F.lit(True))


def usable(vectors: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> tuple[DataFrame, int]:
    """(vec_id, v array<double>) of the rows that take part, and their dimension: that of most rows (0: no rows)."""
    v = pick(vectors, vec_id=id_col, v=vector_col).where(F.col("vec_id").isNotNull() & finite("v"))
    v = v.select("vec_id", F.col("v").cast("array<double>").alias("v"))
    if nonzero:
        v = v.where(F.exists("v", lambda x: x != 0))
    most = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return (v.where(F.size("v") == most["d"]), most["d"]) if most else (v, 0)


def fit_sample(v: DataFrame, rows: int = SAMPLE) -> np.ndarray:
    """The vectors of a bounded sample that does not depend on partitioning."""
    got = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).toPandas()
    return np.stack(got["v"].to_numpy()).astype(float)


def elementwise(f: Callable[[np.ndarray], np.ndarray], kind: str = "int") -> Callable[[str | Column], Column]:
    """A function of a column's values as an expression."""

    def run(x: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy()))

    return F.pandas_udf(run, kind)


def looked_up(values: dict[int, int]) -> Callable[[str | Column], Column]:
    """The value of each small non-negative number; -1 where it has none."""
    at = np.full(max(values, default=-1) + 2, -1)
    at[list(values)] = list(values.values())
    return elementwise(lambda x: at[np.clip(x, -1, len(at) - 1)])


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists are of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def unpack(blobs, dims: int) -> np.ndarray:
    """Rows of packed doubles."""
    return np.frombuffer(b"".join(blobs), "<f8").reshape(-1, dims)


def packed(v: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.ascontiguousarray(v, "<f8")], pa.binary())


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query; found holds a few for each part of the table."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
