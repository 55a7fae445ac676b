import numpy as np
import pytest

from tessera.llm import jaccard, substring
from tessera.llm.textbatch import Words


def words(*texts, lower=False):
    data = [t.encode() for t in texts]
    return Words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), lower)


def thue_morse(n, a, b):
    """A word over two letters and its complement, which collide under any polynomial modulo a power of two."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


def test_words_and_runs_that_collide_under_polynomials():
    p, q = thue_morse(1024, "a", "b")
    assert words(p).hashes[0] != words(q).hashes[0]
    p, q = thue_morse(1024, "a ", "b ")
    for k in (64, 512, 1024):
        assert words(p).runs(k)[0] != words(q).runs(k)[0]


@pytest.mark.parametrize("size", [1, 7, 8, 9, 16, 17, 63, 64, 65, 200])
def test_words_of_every_length(size):
    texts = ["x" * size, "x" * (size - 1) + "y", "y" + "x" * (size - 1), "x" * (size + 1), "x" * size + "\0", "\0" + "x" * size]
    h = words(*[t + " " for t in texts], texts[0]).hashes
    assert len(set(h.tolist())) == len(set(texts)) and h[0] == h[-1]


def test_a_run_does_not_depend_on_what_stands_around_it():
    rng = np.random.default_rng(0)
    w = [f"w{i}" for i in rng.integers(0, 50, 300)]
    for k in (1, 2, 5, 25, 50):
        alone = words(" ".join(w[20 : 20 + k])).runs(k)[0]
        assert words(" ".join(w)).runs(k)[20] == alone == words("x", "  " + "\t".join(w[20 : 20 + k]), "y").runs(k)[1]


def test_colliding_texts_are_neither_linked_nor_cut(spark):
    p, q = thue_morse(1024, "a ", "b ")
    long_p, long_q = thue_morse(1024, "a", "b")
    tail = " ".join(f"w{i}" for i in range(60))
    rows = [(1, p), (2, q), (3, f"{long_p} one two three"), (4, f"{long_q} one two three"), (5, f"{long_p} {tail}"), (6, f"{long_q} {tail}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.groups(df).collect()}
    assert got[3] != got[4]
    cut, whole = substring.deduplicate(df)
    gone = {r.doc_id: r.n_removed for r in cut.select("doc_id", "n_removed").unionByName(whole.select("doc_id", "n_removed")).collect()}
    w = [r[1].split() for r in rows]
    seen = {tuple(w[0][i : i + 50]) for i in range(len(w[0]) - 49)}
    want = set()
    for i in range(len(w[1]) - 49):
        if tuple(w[1][i : i + 50]) in seen:
            want |= set(range(i, i + 50))
    assert gone[2] == len(want) and gone[6] == 60


def test_empty_slices():
    assert len(words("").hashes) == 0 and words("", " ").shingles(5)[1].tolist() == [] and len(words("a").runs(5)) == 0
