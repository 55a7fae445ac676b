"""Rules over logs and names, told step by step and held against their set-at-a-time forms."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import runs
from tessera.operators.writes import unique_slugs


def replayed(log, streak=25, least=50, share=0.5):
    """(attempt, reason) at which a circuit opens."""
    failed = run = 0
    for n, bad in enumerate(log, 1):
        run = run + 1 if bad else 0
        failed += bad
        if bad and run >= streak:
            return n, "consecutive"
        if bad and n >= least and failed > share * n:
            return n, "rate"
    return None


@pytest.mark.parametrize("streak", [3, 25])
def test_breaker_against_a_replay(spark, streak):
    rng = random.Random(streak)
    logs = {k: [rng.random() < p for _ in range(n)] for k, (p, n) in enumerate([(0.5, 400), (0.52, 900), (0.1, 30), (0.9, 300), (1, 24), (1, 26), (0, 10), (0.45, 2000), (0.6, 60)])}
    logs[20] = [True] * 26 + [False] * 24 + [False] * 100  # over half failed by the fiftieth, which is a success
    logs[21] = [True, False] * 24 + [True] * 2 + [False] * 9
    logs[22] = [False] * 3000 + [True] * 30
    df = spark.createDataFrame([(k, i, bad) for k, v in logs.items() for i, bad in enumerate(v)], "k int, i int, bad boolean").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that logs are cut
    try:
        got = {r.k: (r.tripped_at, r.reason) for r in runs.breaker(df, "k", [F.col("i")], F.col("bad"), streak=streak).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k: hit for k, v in logs.items() if (hit := replayed(v, streak))}
    assert streak == 3 or 20 not in got or got[20][1] == "consecutive"


def test_a_success_never_trips(spark):
    log = [True, False] * 10 + [True] * 16 + [False] * 13 + [False] * 40  # 26 failures of 49, then successes
    df = spark.createDataFrame([(1, i, bad) for i, bad in enumerate(log)], "k int, i int, bad boolean")
    assert replayed(log) is None and runs.breaker(df, "k", [F.col("i")], F.col("bad")).isEmpty()


def named(proposed, taken):
    used, out = set(taken), []
    for p in proposed:
        n, slug = 1, p
        while slug in used:
            n += 1
            slug = f"{p}-{n}"
        used.add(slug)
        out.append(slug)
    return out


@pytest.mark.parametrize("proposed,taken", [(["x", "x-2"], ["x"]), (["y", "y", "y-2"], []), (["y-2", "y", "y"], []), (["z"] * 9 + ["z-3", "z-3-2", "z"], ["z-2", "z-5"]), ([], ["a"])])
def test_slugs_one_after_another(spark, proposed, taken):
    c = spark.createDataFrame(list(enumerate(proposed)), "id long, proposed string")
    got = {r.id: r.slug for r in unique_slugs(c, spark.createDataFrame([(t,) for t in taken], "slug string"), "id").collect()}
    assert [got[i] for i in range(len(proposed))] == named(proposed, taken)


def test_slugs_of_many(spark):
    rng = random.Random(1)
    proposed, taken = [rng.choice(["a", "a-2", "a-2-2", "b", "b-3", "a-4"]) for _ in range(120)], ["a-3", "b", "b-2"]
    got = unique_slugs(spark.createDataFrame(list(enumerate(proposed)), "id long, proposed string"), spark.createDataFrame([(t,) for t in taken], "slug string"), "id").collect()
    assert [r.slug for r in sorted(got, key=lambda r: r.id)] == named(proposed, taken) and len({r.slug for r in got}) == 120
