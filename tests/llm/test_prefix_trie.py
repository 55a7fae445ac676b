import hashlib
import random
import zlib

import pytest

from tessera.llm import prefix_trie, queries
from tests.oracle import connect, differences

PLAIN = "conv_id long, turn long, role string, text string, text2 string, owner long, depth int"  # as Parquet can hold
SCHEMA = "conv_id long, turn long, role string, text string, `Text` string, owner long, depth int"


def brute(turns, rebuild=True):
    """The nodes of rows (conv_id, turn, role, text, ...)."""
    own = {}
    for c, turn, role, text, *_ in turns:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + v[h:] if rebuild else v
    members, ends = {}, {}
    for c, v in sorted(full.items()):
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
        ends.setdefault(tuple(v), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    below = {}
    for p in sorted(members, key=len, reverse=True):
        leaves, saved = (1 if p not in kids else 0), (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        for k in kids.get(p, []):
            leaves, saved = leaves + below[k][0], saved + below[k][1]
        below[p] = leaves, saved
    return [(m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids.get(p, [])), *below[p], hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()) for p, m in members.items()]


def rows(seed=0, n=150):
    rng = random.Random(seed)
    made = []
    for c in [*range(n), *range(400, 420), -5, -100, -103, 7777]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 8, 12])):
            made.append((c, t, rng.choice(["user", "assistant"]), rng.choice("abcdé") * rng.randrange(3)))
    made += [(c, t, "user", "same") for c in range(200, 260) for t in range(4)]  # copies
    made += [(100, t, "user", f"long {t // 3}") for t in range(700)]  # base of 101 and the like, with repeats
    made += [(101, t, "user", f"long {t // 3}") for t in range(690)]
    made += [(5, None, None, None), (5, None, "x", None), (5, 0, "z", "a"), (5, 0, "a", "z"), (5, 0, "a", "z"), (None, 1, "user", "lost"), (300, 1, None, "alone")]
    made = [(*r, "extra", 1, 2) for r in made]
    rng.shuffle(made)
    return made


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("chunk,seed", [(256, 0), (3, 1)])
def test_against_brute_force(spark, tmp_path, monkeypatch, chunk, seed):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "ENDS_BITS", 3)
    made = rows(seed)
    spark.createDataFrame(made, PLAIN).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.QUERIES["op12_prefix_trie"](spark, str(tmp_path))
    assert found.columns == COLUMNS
    assert got(found) == sorted(brute(made), key=str)


def test_as_they_are(spark):
    made = [(c, t, "u", x) for c, v in {1: "abc", 2: "ab", 3: "abd", 4: "ab", 9: "abcde", 12: "abcdf", 13: "x"}.items() for t, x in enumerate(v)]
    numbered = prefix_trie.number(spark.createDataFrame([(*r, None, None, None) for r in made], SCHEMA))
    assert got(prefix_trie.trie(numbered, numbered.select("conv_id"))) == sorted(brute(made, rebuild=False), key=str)


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], PLAIN).write.parquet(f"{tmp_path}/a/conversations.parquet")
    spark.createDataFrame([(None, 1, "u", "t", None, None, None)], PLAIN).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert not queries.QUERIES["op12_prefix_trie"](spark, f"{tmp_path}/a").collect() and not queries.QUERIES["op12_prefix_trie"](spark, f"{tmp_path}/b").collect()


def test_conversations_of_several_blocks(spark):
    made = [(c, t, "u", str(t), None, None, None) for c in (1, 2) for t in range(1000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = prefix_trie.number(spark.createDataFrame(made, SCHEMA)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.conv_id, r.pos, r.text) for r in numbered) == [(c, t + 1, str(t)) for c in (1, 2) for t in range(1000)]


def test_oracle(spark, sf):
    assert differences(queries.QUERIES["op12_prefix_trie"](spark, sf), connect(sf), queries.ORACLE_SQL["op12_prefix_trie"]) == []
