import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import collocations, queries
from tests.llm.fixtures import SCHEMA, documents
from tests.oracle import connect, differences


def brute(rows, least=30, limit=2000):
    """(lang, rank, phrase, a, l, r, n, score) of rows whose second and third values are text and lang."""
    f, n = Counter(), Counter()
    low = {c: c + 32 for c in range(65, 91)}
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    made = {}
    some = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    for p, a in some.items():
        lang, w = p[0], p[1:]
        if any(q[0] == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(w)] == w for i in range(1, len(q))) for q, b in some.items()):
            continue
        l, r = min(((f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))), key=lambda x: 2_000_000 * a // sum(x))
        made.setdefault(lang, []).append((-(2_000_000 * a // (l + r)), -a, " ".join(w).encode(), l, r))
    return [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, v in made.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:limit])]


def rows():
    rng = random.Random(3)
    made = documents()
    common = ["The cat", "sat ON the mat", "mat", "a a a a a", "ÉTÉ", "été", "the the cat", "new york city", "york", "x\ty", "b. b", "c,c;c"]
    for i in range(700):
        text = rng.choice([" ", "  ", ", ", "\n", "\t"]).join(rng.choice(common) for _ in range(rng.randrange(9)))
        made.append((i, text, rng.choice(["en", "en", "fr", None, "und", ""]), "s", 1, None, None))
    made += [(9000, "solo pair " * 40, "de", "s", 1, None, None), (None, None, None, None, None, None, None), (1, "", "en", None, None, None, None), (2, "solo pair " * 3000, "en", None, None, None, None)]
    return made


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # many units, hot words over several buckets, narrow limits
        for name, value in (("UNIT_BYTES", 4000), ("HOT_WORDS", 200), ("LEAST_BUCKETS", 5), ("BUCKET_WORDS", 1000)):
            monkeypatch.setattr(collocations, name, value)
    made = rows()
    want = brute(made)
    found = collocations.top(spark.createDataFrame(made, SCHEMA).repartition(4))
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert got(found) == sorted(want) and len(want) > 30 and {x[0] for x in want} == {"en", "fr", "und", "de", ""}


def test_limit_and_ties(spark):
    made = rows()
    assert got(collocations.top(spark.createDataFrame(made, SCHEMA), limit=3, min_count=5)) == sorted(brute(made, 5, 3))


def test_empty_tables(spark):
    assert not got(collocations.top(spark.createDataFrame([], SCHEMA)))
    assert not got(collocations.top(spark.createDataFrame([(1, None, None, None, None, None, None), (2, " .", "en", None, None, None, None)], SCHEMA)))


def test_each_phrase_belongs_to_one_pivot():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 6, 5000)
    left, right = collocations.extents(ids)
    for k in (2, 3, 4):
        want = sum((ids[i : i + k] > 0).all() for i in range(len(ids) - k + 1))
        seen = sum(1 for i in range(len(ids)) for s in range(max(0, left[i] - k + 1), min(left[i], left[i] + right[i] + 1 - k) + 1) if left[i] + right[i] + 1 >= k)
        assert want == seen


def test_counts_of_rows():
    rng = np.random.default_rng(0)
    rows, counts = rng.integers(0, 7, (3000, 3)).astype("<u4"), rng.integers(1, 4, 3000)
    want = Counter()
    for row, n in zip(rows.tolist(), counts.tolist()):
        want[tuple(row)] += n
    as_dict = lambda x: dict(zip(map(tuple, x[0].tolist()), x[1].tolist()))
    assert as_dict(collocations.exactly(rows, counts)) == as_dict(collocations.gathered(rows, counts)) == want
    assert as_dict(collocations.frequent(rows, counts, 20)) == {k: n for k, n in want.items() if n >= 20}


def test_score_is_exact_beyond_64_bits(spark):
    n = 4 * 10**18
    row = spark.createDataFrame([(n, n + 1, 3)], "a long, l long, r long").selectExpr("cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as s").first()
    assert row.s == 2_000_000 * n // (n + 4)


def test_oracle(spark, sf):
    assert differences(queries.QUERIES["op13_collocations"](spark, sf), connect(sf), queries.ORACLE_SQL["op13_collocations"]) == []


def test_a_bucket_is_mined_some_pivots_at_a_time(monkeypatch):
    rng = np.random.default_rng(0)
    tokens = rng.zipf(1.3, 4000).clip(0, 40) % 40
    ids, parts = np.arange(39, 0, -1), np.arange(39) % 5 // 4 + 1
    row = [[7], [tokens.astype("<u4").tobytes()], [39], [list(range(39))], [ids.tolist()], [parts.tolist()]]
    batch = pa.RecordBatch.from_arrays([pa.array(row[0]), pa.array(row[1], pa.binary()), pa.array(row[2]), *[pa.array(x, pa.list_(pa.int64())) for x in row[3:]]], names=["unit", "tokens", "n", "at", "ids", "parts"])
    table = pa.Table.from_batches(collocations._fragments(1, "<u4")([batch]))
    mined = lambda: sorted((r["partial"], r["gram"], r["a"]) for r in collocations._mine(3, "<u4")((pa.scalar(0),), table).to_pylist())
    whole, sizes = mined(), []
    inner = {k: getattr(collocations, k) for k in ("exactly", "frequent")}
    for k, f in inner.items():
        monkeypatch.setattr(collocations, k, lambda rows, *more, f=f: (sizes.append(len(rows)), f(rows, *more))[1])
    mined()
    most = max(sizes)
    monkeypatch.setattr(collocations, "MINED_ROWS", 50)
    sizes.clear()
    assert mined() == whole and len({p for p, _, _ in whole}) == 2 and len(whole) > 100
    assert max(sizes) < most  # no more than the phrases of one pivot
