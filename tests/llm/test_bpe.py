import hashlib
import random

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken

from tessera.llm import bpe
from tests.llm.fixtures import SCHEMA, documents

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "\n\n  a", "a\x1cb \x85c d  e  ", "x" * 3000, "日本語テキスト " * 50, "🙂🙃" * 20, "'s't''s don't I'LL", "a b  c   d\n e \nf", "٣ ²½ ǅ", "<|endoftext|> x", "\x1f\x1e \x1d", "é ́a"]


@pytest.fixture(scope="module")
def reference():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(PATH)) if t}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(coder, text):
    return np.frombuffer(coder.encode([text])[0], "<u4").tolist()


def test_usual_pattern_is_the_public_one():
    assert bpe.USUAL == P.PATTERN


def test_matches_the_library_and_round_trips(reference):
    coder, rng = bpe.bpe(PATH, P.PATTERN), random.Random(0)
    near = [chr(i) for i in range(0x250)]
    texts = ODD + ["".join(rng.choice(near) for _ in range(80)) for _ in range(150)] + ["".join(chr(rng.choice([32, 10, 97, 0x4E00, 0x301, 0x2028, 0x1F600, 48])) for _ in range(40)) for _ in range(150)]
    for t in texts:
        assert ids(coder, t) == reference.encode_ordinary(t), repr(t)
        assert coder.decode(coder.encode([t])[0]) == t.encode()


def test_other_patterns_use_the_general_path():
    coder = bpe.Bpe(bpe.read_ranks(PATH), r"\S+|\s+")
    assert coder.decode(coder.encode(["ab  cd"])[0]) == b"ab  cd"


def test_memo_may_overflow(monkeypatch):
    coder = bpe.Bpe(bpe.read_ranks(PATH), P.PATTERN)
    coder.chunks.size = 3
    assert [coder.decode(x) for x in coder.encode(["a b c d e f", "g h i"])] == [b"a b c d e f", b"g h i"]
    assert coder.decode(coder.encode(["a g " + "z" * 200])[0]) == b"a g " + b"z" * 200


def test_table(spark, reference):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df, PATH, P.PATTERN).collect())
    want = []
    for r in rows:
        i = reference.encode_ordinary(r[1] or "")
        want.append((str(r[0]), len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(want)
    both = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in both) == sorted((str(r[0]), (r[1] or "").encode()) for r in rows)


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA), PATH, P.PATTERN).count() == 0
