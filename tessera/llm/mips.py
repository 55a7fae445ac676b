"""Exact top-k inner products over integer vectors.

Vectors are banded by descending length.  Every query first meets the longest band, which bounds its k-th score from
below; it goes on only to bands whose longest vector could still reach that bound by Cauchy-Schwarz.  In a band,
vectors are met in order of length.  An SVD rotation (fitted on a bounded sample, and exact as a bound for any
orthogonal matrix) gathers most of a product in its first components: their partial sum plus the product of the two
residual lengths bounds the score, and only vectors whose bound reaches the k-th score get an exact integer product.

Queries and vectors meet in blocks: (query block, band) pairs, none larger than ``QUERY_ROWS`` times about
``BAND_ROWS``.  A query's bound divided by its length is the length that a vector needs, so queries are blocked in the
order of that length: a block needs the bands down to some place, and a band goes to the blocks that need it and to no
other.  Vectors that are null, empty, of another dimension than most, or hold null or non-finite components
take no part.  Repeated ids are separate candidates, but a query never meets rows of its own id, and a query id
that is repeated asks once, with its least packed vector.  Products must fit in
64 bits.  Fewer than k candidates: all of them.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.textbatch import checkpointed
from tessera.llm.vectors import elementwise, fit_sample, looked_up, matrix, packed, ranked, unpack, usable

BAND_ROWS, QUERY_ROWS, QUERY_STEP, LEAST_BANDS, HEAD, STEP = 16384, 16384, 2048, 16, 16, 512
#: Room for rounding in a bound, relative to the product of the lengths.
SLACK = 1e-9


def scan(q_ids, q, q_floor, v_ids, v, rotation, k: int) -> pd.DataFrame:
    """Of each query, the k best of v that may still reach its floor; v comes by descending length."""
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1] < 2**52
    qn, vn = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
    qr, vr = q @ rotation, v @ rotation
    q_rest, v_rest = np.linalg.norm(qr[:, HEAD:], axis=1), np.linalg.norm(vr[:, HEAD:], axis=1)
    floor = q_floor.astype(float).copy()
    kept_i = [np.zeros(0, np.int64)] * len(q)
    kept_s = [np.zeros(0, np.int64)] * len(q)
    for a in range(0, len(v), STEP):
        part = slice(a, a + STEP)
        slack = SLACK * qn * vn[a] + 1e-6
        live = np.flatnonzero(qn * vn[a] + slack >= floor)
        if not len(live):
            break
        bound = qr[live, :HEAD] @ vr[part, :HEAD].T + q_rest[live, None] * v_rest[None, part] + slack[live, None]
        hit = (bound >= floor[live, None]) & (q_ids[live, None] != v_ids[None, part])
        for row in np.flatnonzero(hit.any(axis=1)):
            i, cols = live[row], a + np.flatnonzero(hit[row])
            s = (v[cols] @ q[i]).astype(np.int64) if exact else v[cols].astype(np.int64) @ q[i].astype(np.int64)
            ids, s = np.append(kept_i[i], v_ids[cols]), np.append(kept_s[i], s)
            top = np.lexsort((ids, -s))[:k]
            kept_i[i], kept_s[i] = ids[top], s[top]
            if len(top) == k:
                floor[i] = max(floor[i], float(s[top[-1]]))
    n = [len(x) for x in kept_i]
    return pd.DataFrame({"query_id": np.repeat(q_ids, n), "vec_id": np.concatenate([*kept_i, np.zeros(0, np.int64)]), "score": np.concatenate([*kept_s, np.zeros(0, np.int64)])})


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer products of floor(scale * component) vectors.

    ``is_query`` is a condition on the column ``vec_id``.
    """
    v, dims = usable(vectors, id_col, vector_col, nonzero=False)
    schema = "query_id long, vec_id long, score long"
    if not dims:
        return ranked(v.sparkSession.createDataFrame([], schema), k)
    sample = np.floor(scale * fit_sample(v))
    rotation = np.linalg.eigh(sample.T @ sample)[1][:, ::-1].copy()

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.floor(scale * matrix(batch["v"])) if len(batch) else np.zeros((0, dims))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(np.linalg.norm(m, axis=1)), packed(m)], names=["vec_id", "length", "blob"])

    made = checkpointed(v.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(integers, "vec_id long, length double, blob binary"))
    n, n_queries = made.agg(F.count("*"), F.count_if(is_query)).first()
    n_bands = max(LEAST_BANDS, math.ceil(n / BAND_ROWS))
    cuts = sorted(set(made.agg(F.percentile_approx("length", [i / n_bands for i in range(1, n_bands)], 10_000)).first()[0] or []), reverse=True)
    at = np.array(cuts[::-1])

    # lengths may tie in any number, so a band is dealt on to as many slices as its rows need
    band = elementwise(lambda length: len(at) - np.searchsorted(at, length, "right"))
    banded = made.withColumn("band", band("length"))
    sizes = {r["band"]: (r["n"], r["longest"]) for r in banded.groupBy("band").agg(F.count("*").alias("n"), F.max("length").alias("longest")).collect()}
    slices = {b: max(1, math.ceil(rows / BAND_ROWS), math.ceil(rows * LEAST_BANDS / max(1, n))) for b, (rows, _) in sizes.items()}
    blocks = max(1, math.ceil(n_queries / QUERY_ROWS))
    slices_of = looked_up(slices)
    sliced = banded.withColumn("slice", F.pmod(F.xxhash64("vec_id"), slices_of("band")).cast("int"))
    # of rows with one id, the query is the least vector
    queries = made.where(is_query).groupBy("vec_id").agg(F.min(F.struct("blob", "length")).alias("q")).select("vec_id", "q.*")

    def meet(key, q: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["length", "vec_id"], ascending=[False, True], kind="stable")
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(q) or not len(own):
            return none
        ids, v = own["vec_id"].to_numpy(), unpack(own["blob"], dims)
        steps = (q.iloc[i : i + QUERY_STEP] for i in range(0, len(q), QUERY_STEP))
        return pd.concat([none, *(scan(x["vec_id"].to_numpy(), unpack(x["blob"], dims), x["floor"].to_numpy(), ids, v, rotation, k) for x in steps)])

    def met(queries: DataFrame, last: Column, own: DataFrame) -> DataFrame:
        """queries: vec_id, blob, floor, block, band; own rows go to the blocks from 0 to ``last``, queries to all slices."""
        q = queries.withColumn("slice", F.explode(F.sequence(F.lit(0), (slices_of("band") - 1).cast("int"))))
        keys = ["block", "band", "slice"]
        own = own.withColumn("block", F.explode(F.sequence(F.lit(0), last))).select("vec_id", "length", "blob", *keys)
        own = own.toDF(*own.columns)  # both sides come from one table; new names keep their columns apart
        return q.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInPandas(meet, schema)

    bands = sorted(sizes)
    low = float(np.finfo(float).min)
    hashed = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int")
    first = checkpointed(met(queries.select("vec_id", "blob", hashed.alias("block"), F.lit(low).alias("floor"), F.lit(bands[0]).alias("band")), F.lit(blocks - 1), sliced.where(F.col("band") == bands[0])))
    if len(bands) == 1:
        return ranked(first, k)
    floors = ranked(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    # the length a vector needs to reach a query's bound; a query without a bound, or whose bound is not positive, needs none
    wants = F.when((F.col("length") > 0) & (F.col("floor") > 1e-6), (F.col("floor") - 1e-6) / (F.col("length") * (1 + SLACK))).otherwise(F.lit(0.0))
    longest = np.array([sizes[b][1] for b in bands])  # by band, descending
    bounded = queries.join(floors.dropDuplicates(["vec_id"]), "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(low))).withColumn("needs", wants)
    bounded = checkpointed(bounded)
    edges = np.array(sorted(set(bounded.agg(F.percentile_approx("needs", [i / blocks for i in range(1, blocks)], 10_000)).first()[0] or []))) if blocks > 1 else np.zeros(0)
    number = np.array(bands)

    # needs may tie in any number, so a range of them is dealt on to as many blocks as its queries need
    ranges = elementwise(lambda needs: np.searchsorted(edges, needs, "right"))
    to_band = elementwise(lambda needs: number[np.maximum(0, np.searchsorted(-longest, -needs, "right") - 1)])
    bounded = bounded.withColumn("range", ranges("needs")).withColumn("last_band", to_band("needs"))
    held = {r["range"]: (r["n"], r["last"]) for r in bounded.groupBy("range").agg(F.count("*").alias("n"), F.max("last_band").alias("last")).collect()}
    parts = {r: max(1, math.ceil(n / QUERY_ROWS)) for r, (n, _) in held.items()}
    start = dict(zip(sorted(parts), np.r_[0, np.cumsum([parts[r] for r in sorted(parts)])[:-1]].tolist())) if parts else {}
    if not held:
        return ranked(first, k)
    block = (looked_up(start)("range") + F.pmod(F.xxhash64("vec_id", F.lit(7)), looked_up(parts)("range"))).cast("int")
    blocked = bounded.withColumn("block", block)
    wanted = blocked.where(F.col("last_band") > bands[0]).select("vec_id", "blob", "block", "floor", F.explode(F.sequence(F.lit(bands[0] + 1), F.col("last_band"))).alias("band")).where(F.col("band").isin(bands))
    # ranges ascend by need, so the blocks that want a band are the first ones
    last = {b: max((start[r] + parts[r] - 1 for r, (_, most) in held.items() if most >= b), default=-1) for b in bands[1:]}
    reached = [b for b in bands[1:] if last[b] >= 0]
    if not reached:
        return ranked(first, k)
    return ranked(first.unionByName(met(wanted, looked_up(last)("band"), sliced.where(F.col("band").isin(reached)))), k)
