import re
from collections import defaultdict

import pytest

from tessera.llm import mixing
from tests.llm.fixtures import SCHEMA, documents


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total >= cap * sizes[s]}
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        out |= {s: float(cap * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


@pytest.mark.parametrize("bucket_rows", [4096, 5])
def test_targets_and_takings(spark, bucket_rows):
    rows = documents(4, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, bucket_rows=bucket_rows).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, largest = defaultdict(int), defaultdict(int)
    source = {(r[0], r[1]): r[3] for r in rows}
    for r in rows:
        sizes[r[3]] += size(r[1])
        largest[r[3]] = max(largest[r[3]], size(r[1]))
    want, taken = brute_targets(sizes), defaultdict(int)
    by_key = {(r[0], size(r[1])): r[3] for r in rows}
    for r in got:
        s = by_key[(r.doc_id, r.size)]
        assert r.source_size == sizes[s] and r.taken <= 2 * r.size and abs(r.target - want[s]) < 1e-6
        taken[s] += r.taken
        assert r.copies >= want[s] // max(1, sizes[s])
    assert source
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    again = mixing.mix(df.repartition(7), bucket_rows=bucket_rows).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in again) == sorted((str(r.doc_id), r.size, r.taken) for r in got)


def test_quality_weight_raises_the_share(spark):
    from pyspark.sql import functions as F

    rows = [(i, ("good " if i % 2 else "bad ") * 5, "en", f"s{i % 3 == 0}", 1, "", "") for i in range(6000)]
    weight = lambda text, size: F.when(text.startswith("good"), 3.0).otherwise(1.0)
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), weights=(1, 9), share=0.6, quality=weight).where("size > 0").collect()
    some = [r for r in got if r.source_size == 20000 or True]
    share = lambda odd: sum(r.copies for r in some if r.doc_id % 2 == odd) / 3000
    assert share(1) > share(0)


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(spark.createDataFrame(documents(), SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
