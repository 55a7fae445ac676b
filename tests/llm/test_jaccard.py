import random
import re

import numpy as np
import pytest

from tessera.llm import jaccard
from tessera.llm.graph import components
from tests.llm.fixtures import SCHEMA, documents

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    s = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    parent = {i: i for i, _ in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            k = len(s[a][1] & s[b][1])
            if s[a][1] and s[b][1] and 100 * k >= 75 * len(s[a][1] | s[b][1]):
                x, y = find(s[a][0]), find(s[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(x), find(i)) for i, x in s)


@pytest.mark.parametrize("chunk", [256, 3])
def test_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = [r for r in documents(chunk) if r[:2] != (5, "another text of a repeated id that has some six words")]
    got = jaccard.groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute(rows)
    assert [r.component_id for r in got if r.doc_id is None] == [None]


@pytest.mark.parametrize("chunk", [256, 3])
def test_every_link_is_counted(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = [r for r in documents(chunk) if r[0] is not None and r[:2] != (5, "another text of a repeated id that has some six words")]
    base = [f"b{i}" for i in range(100)]
    rows += [(900 + i, " ".join([*base[: 100 - i % 4], *(f"c{i}x{j}" for j in range(i % 5))]), "en", "s", 1, "", "") for i in range(30)]
    sets = {r[0]: shingles(r[1]) for r in rows}
    different = set(sets.values())
    links = {s: sum(100 * len(s & t) >= 75 * len(s | t) for t in different if t != s) if s else 0 for s in different}
    assert max(links.values()) > 20
    got = jaccard.groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.n_links for r in got} == {i: links[s] for i, s in sets.items()}


def test_links_of_a_table_equal_sql(spark):
    from tessera.llm.queries import ORACLE_SQL, QUERIES
    from tests.oracle import connect, differences

    sf = "/root/testdata/sf0.001"
    assert differences(QUERIES["op4_jaccard_links"](spark, sf), connect(sf), ORACLE_SQL["op4_jaccard_links"]) == []


def test_texts_of_one_template_do_not_all_meet(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    rows, sizes, real = [], [], jaccard._links
    for i in range(60):  # pairs of copies share nine tenths; two texts of different pairs share less than 0.75
        own = [f"p{i // 2}x{j}" for j in range(24)]
        own[i % 2] += "y" * (i % 2)
        rows.append((i, " ".join([*(f"t{j}" for j in range(100)), *own])))

    def noting(tree, probes, *rest):
        sizes.append(tree.count() + probes.count())
        return real(tree, probes, *rest)

    monkeypatch.setattr(jaccard, "_links", noting)
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert len({r.component_id for r in got}) == 30
    assert sizes[-1] <= 2 * len(rows)


def test_repeated_id_with_two_texts_keeps_both_rows(spark):
    rows = documents()
    assert jaccard.groups(spark.createDataFrame(rows, SCHEMA)).count() == len(rows)


def test_empty_table(spark):
    assert jaccard.groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_walk_finds_every_link_and_no_other():
    rng = random.Random(1)
    for _ in range(60):
        base = [frozenset(rng.randrange(60) for _ in range(rng.randrange(1, 40))) for _ in range(4)]
        sets = [frozenset(x for x in rng.choice(base) if rng.random() > 0.1) | {rng.randrange(60)} for _ in range(rng.randrange(1, 14))]
        probes = [frozenset(x for x in rng.choice(base) if rng.random() > 0.1) | {rng.randrange(60)} for _ in range(rng.randrange(1, 9))]
        as_arrays = lambda group: [np.array(sorted(s), np.uint64) for s in group]
        got = jaccard.walk(as_arrays(sets), np.array(list(map(len, sets))), as_arrays(probes), np.array(list(map(len, probes))), 75)
        want = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(probes) if 100 * len(a & b) >= 75 * len(a | b)]
        assert sorted(got) == sorted(want)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
