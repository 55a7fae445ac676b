import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, mips

SCHEMA = "vec_id long, embedding array<float>, label int, `Embedding` string"


def vectors(seed=0, n=700, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    v = (centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dims)) * 0.7).astype(np.float32)
    v[100:250] = v[0]  # one very common vector
    rows = [(i, x.tolist(), 0, "x") for i, x in enumerate(v)]
    rows += [(n, None, 0, None), (n + 1, [], 0, None), (n + 2, [0.0] * dims, 0, None), (n + 3, [float("nan")] + [1.0] * (dims - 1), 0, None), (n + 4, [float("inf")] * dims, 0, None), (n + 5, [None] + [1.0] * (dims - 1), 0, None), (n + 6, [1.0], 0, None), (None, v[1].tolist(), 0, None)]
    rows.append(rows[3])
    random.Random(seed).shuffle(rows)
    return rows


def good(rows, dims, zero):
    return [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]


def brute(pool, score, k=5):
    out = {}
    for q, x in {i: x for i, x in pool if i % 50 == 0}.items():
        out[q] = sorted(((-score(x, y), i) for i, y in pool if i != q))[:k]
    return out


def test_mips_is_exact(spark):
    rows = vectors()
    got = mips.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    pool = [(i, np.floor(256 * x).astype(np.int64)) for i, x in good(rows, 16, True)]
    want = {(q, r + 1, i, int(-s)) for q, top in brute(pool, lambda a, b: int(a @ b)).items() for r, (s, i) in enumerate(top)}
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


@pytest.mark.parametrize("rotate", [True, False])
def test_scan_prunes_nothing_it_needs(rotate):
    rng = np.random.default_rng(3)
    v = np.floor(rng.normal(size=(900, 24)) * 100 * rng.uniform(0.1, 3, size=(900, 1)))
    v = v[np.argsort(-np.linalg.norm(v, axis=1))]
    q, ids = v[::40].copy(), np.arange(900)
    rotation = np.linalg.eigh(v.T @ v)[1][:, ::-1] if rotate else np.eye(24)
    got = mips.scan(ids[::40], q, np.full(len(q), -1e300), ids, v, rotation, 5)
    for i, x in zip(ids[::40], q):
        s = sorted(((-int(x @ y), j) for j, y in zip(ids, v) if j != i))[:5]
        assert [(-a, b) for a, b in s] == [(r.score, r.vec_id) for r in got[got.query_id == i].itertuples()]


def test_ann_recall_and_exact_scores(spark):
    rows = vectors(1)
    got = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    pool = good(rows, 16, False)
    cosine = lambda a, b: float((a * b).sum() / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum())))
    want = brute(pool, cosine)
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(found) == set(want)
    hits = 0
    by_id = dict(pool)
    for q, top in want.items():
        assert sorted(found[q]) == [1, 2, 3, 4, 5]
        for i, s in found[q].values():
            assert abs(s - cosine(by_id[q], by_id[i])) < 1e-12
        ranked = [(-s, i) for i, s in (found[q][k] for k in range(1, 6))]
        assert ranked == sorted(ranked)
        hits += len({i for _, i in top} & {i for i, _ in found[q].values()})
    assert hits >= 0.9 * 5 * len(want)


def test_ann_recall_of_half_a_table(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_VISIT", 0)  # else all 2000 rows are visited
    test_ann_recall_on_embeddings(spark)


def test_ann_recall_on_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.toPandas()
    x = np.stack(rows["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rows["vec_id"].to_numpy()
    q = np.flatnonzero(ids % 50 == 0)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -9
    want = {ids[a]: set(ids[np.argsort(-s[i])[:5]]) for i, a in enumerate(q)}
    got = ann.search(df, F.col("vec_id") % 50 == 0).collect()
    assert sum(r.vec_id in want[r.query_id] for r in got) >= 0.9 * 5 * len(q)


def test_ann_groups_and_matrices_hold_bounded_queries(spark, monkeypatch, tmp_path):
    rows, real, seen = vectors(4), ann.rerank, str(tmp_path / "seen")

    def noting(q_ids, *rest):
        with open(seen, "a") as f:
            f.write(f"{len(q_ids)}\n")
        return real(q_ids, *rest)

    df, every = spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 2 == 0
    monkeypatch.setattr(ann, "rerank", noting)
    want = sorted(map(tuple, ann.search(df, every).collect()))
    assert max(map(int, open(seen))) > 200  # one block of all queries
    open(seen, "w").close()
    monkeypatch.setattr(ann, "QUERY_ROWS", 40)
    assert sorted(map(tuple, ann.search(df, every).collect())) == want
    assert max(map(int, open(seen))) < 90


def test_a_cell_is_scored_for_slices_of_its_queries(monkeypatch):
    rng, shapes = np.random.default_rng(5), []
    v, q = rng.normal(size=(300, 8)), rng.normal(size=(100, 8))
    ask = lambda: ann.rerank(np.arange(1000, 1100), q, [[0]] * 100, np.arange(300), v, np.zeros(300, int), 5)
    want, real = ask(), np.flatnonzero
    monkeypatch.setattr(ann, "QUERY_STEP", 7)
    monkeypatch.setattr(ann.np, "flatnonzero", lambda x: shapes.append(len(x)) or real(x))
    got = ask()
    monkeypatch.undo()
    assert got.equals(want) and max(shapes[1:]) == 7


def test_hot_cells_are_split():
    counts = np.array([5, 0, 1000, 7, 90])
    first, number, shards = ann.deal(counts, 100)
    assert number[2] == 10 and shards == first.max() + number[first.argmax()]
    assert set(range(first[2], first[2] + 10)).isdisjoint({first[0], first[3], first[4]})


def test_walk_is_in_order_of_distance():
    rng = np.random.default_rng(0)
    a, b, counts = rng.random(6), rng.random(5), rng.integers(0, 4, 30)
    cells = ann.walk(a, b, counts, int(counts.sum()))
    d = [a[c // 5] + b[c % 5] for c in cells]
    assert d == sorted(d) and set(cells) == set(np.flatnonzero(counts))


def test_a_repeated_query_row_takes_no_place_of_others(spark):
    """The query's own row eight times, twelve equal vectors of other ids, and three far ones."""
    rows = [(50, [1.0, 0.5], 0, "")] * 8 + [(i, [1.0, 0.5], 0, "") for i in range(51, 63)] + [(i, [-1.0, 0.1 * i], 0, "") for i in (1, 2, 3)]
    for search in (ann.search, mips.top_k):
        got = search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).orderBy("rank").collect()
        assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(50, k, 50 + k) for k in range(1, 6)]
    ids = np.array([r[0] for r in rows])
    v = np.array([r[1] for r in rows])
    order = np.argsort(ids, kind="stable")
    got = ann.rerank(np.array([50]), v[:1], [[0]], ids[order], v[order], np.zeros(len(ids), int), 5)
    assert got["vec_id"].tolist() == [51, 52, 53, 54, 55]
    # and seen from another query, repeated rows are candidates of their own
    got = ann.rerank(np.array([7]), v[:1], [[0]], ids[order], v[order], np.zeros(len(ids), int), 5)
    assert got["vec_id"].tolist() == [50] * 5


def test_visit_is_measured(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_VISIT", 0)
    seen, real = [], ann.walk
    monkeypatch.setattr(ann, "needed", lambda *a: seen.append(real) or np.full(len(a[3]), 7))
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.search(df, F.col("vec_id") % 50 == 0, recall=0.9)
    assert len(seen) == 40 and got.count() <= 200  # 7 rows a query are visited


def test_needed_is_what_a_walk_has_met():
    rng = np.random.default_rng(1)
    a, b, counts = rng.random(6), rng.random(5), rng.integers(1, 4, 30)
    for cell, rows in enumerate(ann.needed(a, b, counts, np.arange(30))):
        cells = ann.walk(a, b, counts, int(rows))
        assert cells[-1] == cell and counts[cells].sum() == rows


def test_mips_over_many_blocks_and_bands(spark, monkeypatch):
    monkeypatch.setattr(mips, "QUERY_ROWS", 3)
    monkeypatch.setattr(mips, "BAND_ROWS", 20)
    rng = np.random.default_rng(7)
    v = rng.normal(size=(300, 6)) * rng.choice([0.05, 1, 4], size=(300, 1)) * np.array([3, 1, 1, 1, 1, 1])
    v[290:] = 0
    v[0] = 0  # a query without length
    v[50] = -np.abs(v[50])
    rows = [(i, x.tolist(), 0, "") for i, x in enumerate(v)]
    got = mips.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, x string"), F.col("vec_id") % 10 == 0).collect()
    pool = [(i, np.floor(256 * x).astype(np.int64)) for i, x in enumerate(v)]
    want = {}
    for q, x in pool:
        if q % 10 == 0:
            want[q] = sorted(((-int(x @ y), i) for i, y in pool if i != q))[:5]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted((q, k + 1, i, -s) for q, top in want.items() for k, (s, i) in enumerate(top))


@pytest.mark.parametrize("search", [ann.search, mips.top_k])
def test_few_and_none(spark, search):
    assert search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    few = [(0, [1.0, 0.5], 0, ""), (1, [1.0, 0.4], 0, ""), (2, [-1.0, 0.0], 0, "")]
    got = search(spark.createDataFrame(few, SCHEMA), F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2)]
