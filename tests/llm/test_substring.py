import hashlib

import pytest

from tessera.llm import substring
from tests.llm.fixtures import SCHEMA, documents


def brute(rows, window):
    first = {}
    for r in rows:
        w = (r[1] or "").encode().split()
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            if r[0] is not None:
                first[k] = min(first.get(k, r[0]), r[0])
    out = []
    for r in rows:
        w = (r[1] or "").encode().split()
        keep = [True] * len(w)
        for a in range(len(w) - window + 1):
            if r[0] is not None and first[tuple(w[a : a + window])] < r[0]:
                keep[a : a + window] = [False] * window
        kept = b" ".join(x for x, k in zip(w, keep) if k)
        out.append((str(r[0]), len(w), keep.count(False), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window,gram,batches,fan_in", [(50, 25, 4, 3), (20, 8, 1, 9), (7, 7, 5, 2)])
def test_brute_force(spark, window, gram, batches, fan_in):
    rows = documents(window)
    cut, whole = substring.deduplicate(spark.createDataFrame(rows, SCHEMA), window, gram, batches, substring.Index(spark, fan_in=fan_in))
    got = [(str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in cut.collect()]
    got += [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in whole.collect()]
    assert sorted(got) == brute(rows, window)


def test_index_finds_what_earlier_batches_hold_and_compacts(spark):
    index = substring.Index(spark, fan_in=2)
    frame = lambda rows: spark.createDataFrame(rows, "fp long, doc_id long")
    assert [r.fp for r in index.add(frame([(1, 1), (2, 1), (2, 2)])).collect()] == [2]
    assert [r.fp for r in index.add(frame([(1, 3), (5, 3)])).collect()] == [1]
    assert len(index.runs) == 1
    assert sorted((r.fp, r.doc_id) for r in spark.read.parquet(index.runs[0]).collect()) == [(1, 1), (2, 1), (5, 3)]
    assert sorted(r.fp for r in index.add(frame([(5, 4), (9, 4)])).collect()) == [5]


def test_empty_table(spark):
    cut, whole = substring.deduplicate(spark.createDataFrame([], SCHEMA))
    assert cut.count() == whole.count() == 0
