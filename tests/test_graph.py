"""Graphs of vectors against exact search."""

import numpy as np
import pytest

from tessera.operators import graph
from tessera.operators.graph import GraphIndex, links_of, walk

DIMS = 64


def made(n, seed, clustered=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, DIMS))
    return x + 3 * rng.normal(size=(40, DIMS))[rng.integers(0, 40, n)] if clustered else x


def exact(x, q, k, allowed=None):
    d = 1 - (x @ q) / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
    d = d if allowed is None else np.where(allowed, d, np.inf)
    return np.lexsort((np.arange(len(x)), d))[:k]


def frame(spark, x, extra=()):
    return spark.createDataFrame([*[(i, v.tolist()) for i, v in enumerate(x)], *extra], "id long, embedding array<double>")


@pytest.mark.parametrize("n,clustered,held", [(2000, False, 600), (12000, True, 160)])
def test_recall_at_two_sizes(spark, tmp_path, n, clustered, held):
    x = made(n, n, clustered)
    index = GraphIndex.build(frame(spark, x), str(tmp_path / "g"))
    assert index.parts == -(-n // 5000)
    asked = list(range(0, n, n // 60))
    found = {}
    for r in index.search(spark.createDataFrame([(i, x[i].tolist()) for i in asked], "query_id long, v array<double>"), 10, held).collect():
        found.setdefault(r.query_id, set()).add(r.id)
    hit = sum(len(found[i] & set(exact(x, x[i], 10).tolist())) for i in asked)
    assert all(len(v) == 10 for v in found.values()) and hit / (10 * len(asked)) >= 0.95


def test_only_allowed_rows_are_found_and_all_of_a_narrow_choice(spark, tmp_path):
    x = made(1500, 3)
    index = GraphIndex.build(frame(spark, x), str(tmp_path / "g"), part_rows=400)
    few = spark.createDataFrame([(i,) for i in range(0, 1500, 50)], "id long")
    got = [r.id for r in index.nearest(x[1].tolist(), 10, allowed=few).collect()]
    assert got == exact(x, x[1], 10, np.arange(1500) % 50 == 0).tolist()
    assert index.nearest(x[1].tolist(), 10, bound=-1).isEmpty()


def test_a_wide_beam_is_exact(spark, tmp_path):
    x = made(900, 5)
    index = GraphIndex.build(frame(spark, x), str(tmp_path / "g"), part_rows=300)
    rows = index.nearest(x[7].tolist(), 50, held=900).collect()
    assert [r.id for r in rows] == exact(x, x[7], 50).tolist() and rows[0].id == 7 and abs(rows[0].distance) < 1e-12


def test_awkward_rows(spark, tmp_path):
    x = made(30, 1)
    x[5] = x[6]
    bad = [(100, None), (101, [0.0] * DIMS), (102, [float("nan")] * DIMS), (103, [None] * DIMS), (104, [1.0]), (105, [float("inf")] * DIMS), (106, x[5].tolist())]
    index = GraphIndex.build(frame(spark, x, bad), str(tmp_path / "g"))
    assert [r.id for r in index.nearest(x[6].tolist(), 3).collect()] == [5, 6, 106]
    assert index.nearest([1.0], 3).isEmpty() and index.nearest([0.0] * DIMS, 3).isEmpty()
    nothing = GraphIndex.build(frame(spark, x[:0]), str(tmp_path / "none"))
    assert nothing.nearest([1.0], 3).isEmpty()


@pytest.mark.parametrize("n", [1, 2, 3, 300])
def test_every_node_can_be_reached(n):
    x = made(n, n)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = links_of(x, 8, 16)
    assert len(walk(x, links, x[0], n)) == n and (links < n).all()


def test_many_queries_scan_small_graphs_and_are_exact(spark, tmp_path):
    x = made(700, 8)
    x[300:340] = x[11]  # more equal vectors than are asked for: ties go to smaller ids
    index = GraphIndex.build(frame(spark, x), str(tmp_path / "g"), part_rows=200)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 700, 9)] + [(11, x[11].tolist())], "query_id long, v array<double>")
    even = spark.createDataFrame([(i,) for i in range(0, 700, 2)], "id long")
    for allowed, mask in ((None, None), (even, np.arange(700) % 2 == 0)):
        found = {}
        for r in index.search(asked, 10, 20, allowed).collect():
            found.setdefault(r.query_id, []).append((round(r.distance, 12), r.id))
        assert all([i for _, i in sorted(found[k])] == exact(x, x[k], 10, mask).tolist() for k in {*range(0, 700, 9), 11})
    row = {"n": 700, "ids": np.arange(700).tobytes(), "vectors": (x / np.linalg.norm(x, axis=1, keepdims=True)).tobytes(), "allowed": [3, 5]}
    assert [i.tolist() for _, i, _ in graph._scanned(row, x[5:6], 10)] == [[5, 3]] and not list(graph._scanned(row | {"allowed": []}, x[5:6], 10))
