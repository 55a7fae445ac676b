import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import line_dedup, queries
from tests.llm.fixtures import SCHEMA, documents
from tests.oracle import connect, differences


def brute(texts, min_docs=10, min_chars=1):
    """(lines, dropped lines, kept text) of each text."""
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    lines = [(t or "").split("\n") for t in texts]
    n = Counter(k for own in lines for k in {key(x) for x in own} if len(k) >= min_chars)
    kept = [[x for x in own if n[key(x)] < min_docs] for own in lines]
    return [(len(a), len(a) - len(b), "\n".join(b)) for a, b in zip(lines, kept)]


def rows():
    made = documents()
    shared = ["Common line.", "  common LINE.\t", "Ärger", "ärger", "\x0bx\x0c", "x", " x", "", "\r"]
    for i in range(40):
        own = [shared[(i + k) % len(shared)] for k in range(i % 7)] + [f"own {i}"] * (i % 3) + ["rare"] * (i < 9) + ["ten"] * (i < 10)
        made.append((1000 + i, "\n".join(own), "en", "s", 1, None, None))
    made += [(2000, "\n".join(["ten"] * 5000), "en", "s", 1, None, None), (2001, "ten\n", "en", "s", 1, None, None), (None, "ten\nstays", "en", "s", 1, None, None), (None, None, None, None, None, None, None)]
    return made


@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (2, 1), (3, 5)])
def test_against_brute_force(spark, monkeypatch, min_docs, min_chars):
    monkeypatch.setattr(line_dedup, "UNIT_DOCS", 17)
    monkeypatch.setattr(line_dedup, "LEAST_KEYS", 100)  # several shards
    made = rows()
    cut, whole = line_dedup.deduplicate(spark.createDataFrame(made, SCHEMA).repartition(3), min_docs, min_chars)
    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in cut.collect()] + [(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in whole.collect()]
    want = [(row[0], n, gone, hashlib.sha256(kept.encode()).hexdigest()) for row, (n, gone, kept) in zip(made, brute([x[1] for x in made], min_docs, min_chars))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(x[2] for x in want)


def test_empty_table(spark):
    cut, whole = line_dedup.deduplicate(spark.createDataFrame([], SCHEMA))
    assert cut.count() == whole.count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 70_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, 2**64, (2, n), np.uint64)
    made = line_dedup.PerfectHash.unpack(line_dedup.PerfectHash.build(a, b).pack())
    assert sorted(made.place(a, b).tolist()) == list(range(n))
    other = made.place(b, a)
    assert ((other >= -1) & (other < max(n, 1))).all()
    assert sum(8 * 8 * len(x) for x in made.levels) <= 4.5 * n + 2000  # bits


def test_perfect_hash_of_keys_that_share_a_half():
    a, b = np.repeat(np.arange(500, dtype=np.uint64), 3), np.tile(np.arange(3, dtype=np.uint64), 500)
    assert sorted(line_dedup.PerfectHash.build(a, b).place(a, b).tolist()) == list(range(1500))


def test_index_refuses_keys_that_it_does_not_hold(spark):
    rng = np.random.default_rng(1)
    keys, others = rng.integers(-(2**63), 2**63, (2, 4000, 2), np.int64)
    counts = spark.createDataFrame([(int(a), int(b), i % 20) for i, (a, b) in enumerate(keys)], "a long, b long, n long")
    index = line_dedup.LineIndex.build(spark, counts)
    asked = spark.createDataFrame([(0, 7, bytearray(np.concatenate([keys, others]).tobytes()))], "shard long, unit long, digests binary")
    found = [r for r in index.frequent(asked, 10).collect()]
    want = {tuple(k) for i, k in enumerate(keys.view(np.uint64).tolist()) if i % 20 >= 10}
    assert [r.unit for r in found] == [7] and set(zip(*(x.tolist() for x in line_dedup.lanes(found[0].digests)))) == want


def test_oracle(spark, sf):
    assert differences(queries.QUERIES["op11_line_dedup"](spark, sf), connect(sf), queries.ORACLE_SQL["op11_line_dedup"]) == []
