import itertools
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import sstable
from tessera.llm.textbatch import text_slices
from tests.llm.fixtures import SCHEMA, documents

PATH = P.path("byte_bpe_50k.json")


def library(texts, special=True):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = not special
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("shard_bytes,special", [(10**9, True), (2000, True), (2000, False)])
def test_round_trip(spark, shard_bytes, special, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 400)
    rows = documents() + [(2000 + i, t, "en", "s", 1, "", "") for i, t in enumerate(["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "end <|endoftext|>"])] + [(1000 + i, f"tail {i} <|endoftext|>   x  y \n z", "en", "s", 1, "", "") for i in range(30)]
    shards = sstable.write(spark.createDataFrame(rows, SCHEMA), PATH, shard_bytes=shard_bytes, special=special)
    got = sstable.read(spark, shards).collect()
    want = {}
    for r, ids in zip(rows, library([r[1] for r in rows], special)):
        want.setdefault(r[0], []).append(np.array(ids, "<u4").tobytes())
    assert len(got) == len(rows)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and bytes(r.ids) in want[r.doc_id]
        start += len(r.ids) // 4
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is None, i))
    reader = sstable.open_reader(next(s["uri"] for s in shards if s["n_docs"]))
    for key, _, ids in list(reader)[:5]:
        i = sstable.id_of(key)
        assert ids in [x.astype(f"<u{reader.width}").tobytes() for x in reader.lookup(i)]
    assert reader.lookup(10**12) == []


def test_one_id_that_holds_a_third_of_the_rows(spark):
    rows = [(7, f"text number {i} of the same id", "en", "s", 1, "", "") for i in range(200)] + [(i, f"other {i}", "en", "s", 1, "", "") for i in range(300)]
    shards = sstable.write(spark.createDataFrame(rows, SCHEMA), PATH, shard_bytes=1200)
    assert max(s["n_docs"] for s in shards) < 200
    got = sorted(sstable.read(spark, shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)


def test_query_digests(spark, sf):
    from tessera.llm.queries import op5_sstable

    got = {r.doc_id: r for r in op5_sstable(spark, sf).collect()}
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    start = 0
    for (doc_id, _), ids in zip(docs, library([d.text for d in docs])):
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_empty_table(spark):
    assert sstable.write(spark.createDataFrame([], SCHEMA), PATH) == []
    assert sstable.read(spark, []).agg(F.count("*")).first()[0] == 0


def by_slices(memo, texts, size=1 << 14):
    """The ids of each text by the memo."""
    out = []
    for _, _, data, offs in text_slices(pa.array(texts, pa.string()), size):
        flat, ends = memo.encode_slice(data, offs)
        out += [np.frombuffer(flat[a:b], "<u2").tolist() for a, b in zip(ends, ends[1:])]
    return out


@pytest.mark.parametrize("special", [True, False])
def test_cuts_at_any_white_space_and_sign_equal_the_library(special):
    rng = random.Random(5)
    white = [chr(i) for i in range(0x3001) if chr(i).isspace()] + ["\u180e", "\u200b", "\ufeff"]
    letters = [*"abXY09.,;:!?'-|%<éàßñ×÷ÿłЖ中😀\u0301ªº²", "'s", "'ll", "d'", "The", "<|endoftext|>", "<|"]
    pools = [letters + [" "] * 20 + ["\n"] * 9 + ["  ", "\n\n", "\r\n", "\t"], letters + white, white + [" ", "a", "é", "."], [*"ab. \n"]]
    texts = ["".join(rng.choices(rng.choice(pools), k=rng.randrange(25))) for _ in range(20_000)] + [None, "", "\n", " ", "x" * 50_000]
    rng.shuffle(texts)
    assert by_slices(sstable._encoder(PATH, 2, special), texts) == [ids[:-1] for ids in library(texts, special)]
    assert by_slices(sstable._encoder(PATH, 2, special), [None, ""]) == [[], []]


def test_known_words_with_new_signs_are_not_encoded_again(monkeypatch):
    words, signs = [f"{a}{b}" for a, b in itertools.product(("stone", "wåter", "café", "Tree"), ("mill", "fäll", "é", "s"))], [",", ".", ";", "!", ".\n", ",\n", ":\n", "\n"]
    texts = [f"{a}{x}{b} {c}{y}" for a, b, c in itertools.product(words, words, words[:4]) for x, y in zip(signs, signs[::-1])]
    memo, handed = sstable._encoder(PATH, 2, True), []
    memo.forget()
    for name in ("encode_many", "together"):
        monkeypatch.setattr(memo, name, lambda chunks, f=getattr(memo, name): handed.extend(chunks) or f(chunks))
    assert by_slices(memo, texts) == [ids[:-1] for ids in library(texts)]
    assert sum(map(len, handed)) < 1000 < sum(map(len, texts)) / 100


@pytest.mark.parametrize("change", [{"add_prefix_space": True}, {"use_regex": False}])
def test_tokenizer_without_the_usual_pattern_gets_whole_texts(change, tmp_path):
    made = json.load(open(PATH))
    made["pre_tokenizer"] |= change
    path = tmp_path / "other.json"
    path.write_text(json.dumps(made))
    texts = ["a,b c.\nd", "the stone, the  mill", "", "x"]
    t = Tokenizer.from_file(str(path))
    assert by_slices(sstable._encoder(str(path), 2, True), texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]
