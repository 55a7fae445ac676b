"""Every query of the library against its DuckDB SQL."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import tessera.plans as plans
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_oracle(spark, sf, con, name):
    assert differences(plans.QUERIES[name](spark, sf), con, plans.ORACLE_SQL[name]) == []


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["rank", "id", "score", "lists", "why", "title", "source"]
    assert set(e.oracle_sql()) <= set(e.queries()) and set(plans.QUERIES) <= set(e.queries())


def test_the_rest_stands_without_the_llm_folders(tmp_path):
    root = Path(__file__).resolve().parent.parent
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not [k for k in q if k.startswith('op')]; e.oracle_sql()"
    for left_out in ({"llm"}, {"llm", "corpus_pipeline.py"}):
        copy = tmp_path / str(len(left_out))
        shutil.copytree(root, copy, ignore=lambda _, names: {n for n in names if n in left_out | {".git", "__pycache__"}})
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})


def test_rate_limit_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts").collect()
    want = {}
    by = {}
    for r in sorted(rows, key=lambda r: r.ts):
        by.setdefault(r.user_id, []).append(r.ts)
    for user, times in by.items():
        tokens, last, ok = 2.0, None, 0
        for t in times:
            tokens = tokens if last is None else min(2.0, tokens + (t - last).total_seconds() / 86400)
            last = t
            if tokens >= 1:
                tokens, ok = tokens - 1, ok + 1
        want[user] = (ok, len(times))
    assert {r.user_id: (r.allowed, r.n) for r in plans.QUERIES["stream_rate_limit"](spark, sf).collect()} == want


def test_cover_density_against_brute_force(spark, sf):
    import re

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in plans.QUERIES["cover_density"](spark, sf).collect():
        tokens = [t for t in re.split("[^a-z0-9]+", texts[r.id].lower()) if t]
        spots = [(i, t) for i, t in enumerate(tokens) if t in ("that", "with")]
        # shortest covers: neighbouring spots of different terms
        want = sum(1 / (b[0] - a[0] + 1) for a, b in zip(spots, spots[1:]) if a[1] != b[1])
        assert abs(r.density - want) < 1e-9
