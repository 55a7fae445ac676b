"""Token ids as sorted-string-table shards.

A shard holds the documents of a range of ids, in ascending order, in blocks of about ``BLOCK_BYTES``: each entry is its
key without the bytes it shares with the key before it, and its token ids.  After the blocks come a sparse index (the
first key, place and earlier ids of each block), a Bloom filter of the keys and a footer, so that a lookup reads the
footer, index and filter of one shard and one block.

Layout, integers little-endian: blocks (zstd frames) | index (zstd) | filter | footer.
Entry: varint shared, varint unshared, varint ids, key bytes, ids of ``width`` bytes each (2 where all fit, else 4).
Key: 0x00 and the id as big-endian with its sign bit turned, or 0x01 for a null id, which so comes last.

Rows are cut into shards by quantiles of their ids, so a shard has about ``SHARD_BYTES`` of text, and more in a corpus
of over ``SHARDS`` times that, up to ``MOST_SHARD_BYTES``.  A row finds its shard by binary search; an id that holds
several quantiles is dealt over their shards by a hash of its texts.  Texts are shuffled once, encoded where they are
written, and never meet the driver.  A file is written beside its place and moved there, so a repeated task leaves the
same shard.  Null texts count as empty; a very long text is encoded whole and may make a block of its own; every document ends with the end id.  Rows of one id follow each other in an
arbitrary order.  An empty table gives no shards.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import json
import math
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tessera.llm.chunks import ArrowMemo
from tessera.llm.textbatch import pick, shared_dir, text_slices

MAGIC, FOOTER = b"tessera1", struct.Struct("<QQQQQQIB3x8s")
#: Bytes of each of the two generations of a worker's memo; a worker keeps it from shard to shard.
MEMO_BYTES = 96 << 20
#: Chunks that are encoded as one text; bytes of text whose different chunks are looked up at once.
RUN, SLICE_BYTES = 8192, 4 << 20
BLOCK_BYTES, SHARD_BYTES, MOST_SHARD_BYTES, SHARDS, BITS_A_KEY, PROBES = 1 << 18, 24 << 20, 256 << 20, 4096, 10, 7


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n, at, shift = n | (b & 127) << shift, at + 1, shift + 7
        if b < 128:
            return n, at


def key_of(doc_id: int | None) -> bytes:
    return b"\x01" if doc_id is None else b"\x00" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key[0] else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Writes one shard to an open stream; keys come in ascending order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.zip = out, width, zstandard.ZstdCompressor(level=1)
        self.at = self.n_docs = self.n_ids = 0
        self.keys: list[bytes] = []
        self.index: list[tuple[bytes, int, int, int]] = []
        self._open()

    def _open(self) -> None:
        self.block, self.size, self.last, self.first, self.before = [], 0, b"", None, self.n_ids

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: of ``width`` bytes each."""
        shared = len(os.path.commonprefix([key, self.last]))
        n = len(ids) // self.width
        self.block += [varint(shared), varint(len(key) - shared), varint(n), key[shared:], ids]
        self.size += len(ids) + 16
        self.first = self.first or key
        self.last, self.n_docs, self.n_ids = key, self.n_docs + 1, self.n_ids + n
        self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self._close()

    def _close(self) -> None:
        if self.first is not None:
            data = self.zip.compress(b"".join(self.block))
            self.index.append((self.first, self.at, len(data), self.before))
            self._put(data)
            self._open()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self._close()
        index_at = self.at
        self._put(self.zip.compress(b"".join(varint(len(k)) + k + varint(a) + varint(n) + varint(b) for k, a, n, b in self.index)))
        filter_at, bits = self.at, max(64, BITS_A_KEY * len(self.keys))
        field = np.zeros(bits, bool)
        for key in self.keys:
            field[_probes(key, bits)] = True
        self._put(np.packbits(field).tobytes())
        self._put(FOOTER.pack(index_at, filter_at - index_at, filter_at, bits, self.n_docs, self.n_ids, len(self.index), self.width, MAGIC))


class Reader:
    """Reads a shard from a seekable file."""

    def __init__(self, file):
        self.file = file
        self.file.seek(self.file.size() - FOOTER.size)
        index_at, index_size, self.filter_at, self.bits, self.n_docs, self.n_ids, _, self.width, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        data, at, self.index = self._unzip(index_at, index_size), 0, []
        while at < len(data):
            n, at = read_varint(data, at)
            key, at = data[at : at + n], at + n
            place, at = read_varint(data, at)
            size, at = read_varint(data, at)
            before, at = read_varint(data, at)
            self.index.append((key, place, size, before))

    def _unzip(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(size))

    def block(self, i: int) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, ids of the shard before it, its ids) of each entry of a block."""
        _, place, size, start = self.index[i]
        data, at, key = self._unzip(place, size), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            own, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key, at = key[:shared] + data[at : at + own], at + own
            yield key, start, data[at : at + n * self.width]
            at, start = at + n * self.width, start + n

    def __iter__(self) -> Iterator[tuple[bytes, int, bytes]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        self.file.seek(self.filter_at)
        field = self.file.read((self.bits + 7) // 8)
        return all(field[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key, self.bits))

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of each row of that id; binary search over the sparse index."""
        key, out = key_of(doc_id), []
        if not self.index or not self.may_hold(key):
            return out
        i = max(0, bisect.bisect_left([k for k, *_ in self.index], key) - 1)
        while i < len(self.index) and self.index[i][0] <= key:
            out += [np.frombuffer(ids, f"<u{self.width}").astype("<u4") for k, _, ids in self.block(i) if k == key]
            i += 1
        return out


def open_reader(uri: str) -> Reader:
    fs, path = pafs.FileSystem.from_uri(uri)
    return Reader(fs.open_input_file(path))


@functools.lru_cache(2)
def _encoder(path: str, width: int, special: bool) -> ArrowMemo:
    """The tokenizers library behind a memo of chunks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not special

    def encode(texts: list[str]) -> list[bytes]:
        ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ends = (np.cumsum([0, *map(len, ids)]) * width).tolist()
        flat = np.fromiter((i for own in ids for i in own), f"<u{width}", ends[-1] // width).tobytes()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    line = tokenizer.encode("\n", add_special_tokens=False).ids

    def together(chunks: list[str]) -> list[bytes]:
        """Chunks as the lines of one text: a line feed between visible characters is a piece, and no chunk holds one."""
        out: list[bytes] = []
        for at in range(0, len(chunks), RUN):
            some = chunks[at : at + RUN]
            ids = np.array(tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids)
            cut = np.flatnonzero(ids == line[0]) if len(line) == 1 else []
            if len(cut) == len(some) - 1:
                ids, cut = np.delete(ids, cut), cut - np.arange(len(cut))
                flat, ends = ids.astype(f"<u{width}").tobytes(), [0, *(cut * width).tolist(), len(ids) * width]
                out += [flat[a:b] for a, b in zip(ends, ends[1:])]
            else:
                out += encode(some)
        return out

    made = json.loads(tokenizer.to_str())
    split, model = made["pre_tokenizer"] or {}, made["model"]
    usual = made["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] and model["type"] == "BPE" and not model.get("dropout")
    return ArrowMemo(encode, together, MEMO_BYTES, tuple(t.content for t in tokenizer.get_added_tokens_decoder().values()), usual)


def _width(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


def write(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0, shard_bytes: int | None = None, special: bool = True, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Writes the shards; (shard, uri, n_docs, n_ids) of each, in order.  One row a shard comes to the driver.

    special: a special token's string in a text is that token, as the library has it by default; else ordinary text.
    """
    src = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    folder = folder or f"{shared_dir(docs.sparkSession)}/sst-{uuid.uuid4().hex}"
    n, size = src.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not n:
        return []
    shards = max(1, math.ceil(size / (shard_bytes or max(SHARD_BYTES, min(MOST_SHARD_BYTES, size // SHARDS)))))
    cuts = src.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], max(100_000, 4 * shards))).first()[0] if shards > 1 else []
    cuts, width = np.array(cuts or [], np.int64), _width(tokenizer_path)

    def number(ids: pd.Series, null: pd.Series, row: pd.Series) -> pd.Series:
        low, high = np.searchsorted(cuts, ids.to_numpy(), "left"), np.searchsorted(cuts, ids.to_numpy(), "right")
        part = (row.to_numpy().astype(np.uint64) >> np.uint64(11)).astype(float) / 2**53
        shard = np.where(high - low > 1, low + (part * (high - low + 1)).astype(int), high)
        return pd.Series(np.where(null.to_numpy(), len(cuts), np.minimum(shard, len(cuts))).astype(np.int32))

    # ids alone go through the search; a null one comes last
    shard = F.pandas_udf(number, "int")(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.col("row")) if len(cuts) else F.lit(0)
    numbered = src.withColumn("row", F.xxhash64("text")).select(shard.alias("shard"), "doc_id", "row", "text")
    dealt = numbered.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_last("doc_id"), "row").select("shard", "doc_id", "text")
    end = end_id.to_bytes(width, "little")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        memo, writer, own = _encoder(tokenizer_path, width, special), None, None
        for batch in batches:
            for i, j, data, offs in text_slices(batch["text"], SLICE_BYTES):
                part = batch.slice(i, j - i)
                if writer is None:
                    own = part["shard"][0].as_py()
                    place = f"{path}/{own:06d}.sst"
                    beside = f"{place}.{TaskContext.get().taskAttemptId()}"
                    out = fs.open_output_stream(beside)
                    writer = Writer(out, width)
                ids, ends = memo.encode_slice(data, offs)
                for doc_id, a, b in zip(part["doc_id"].to_pylist(), ends, ends[1:]):
                    writer.add(key_of(doc_id), bytes(ids[a:b]) + end)
        if writer:
            writer.close()
            out.close()
            fs.move(beside, place)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([own], pa.int32()), "uri": [f"{folder}/{own:06d}.sst"], "n_docs": [writer.n_docs], "n_ids": [writer.n_ids]})

    rows = dealt.mapInArrow(put, "shard int, uri string, n_docs long, n_ids long").collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["shard"])


def read(spark, shards: list[dict]) -> DataFrame:
    """(doc_id, start, ids) from the files: ids as unsigned 32-bit, start the number of ids of all documents before."""
    before, rows = 0, []
    for s in shards:
        rows.append((s["uri"], before))
        before += s["n_ids"]
    schema = "doc_id long, start long, ids binary"
    if not rows:
        return spark.createDataFrame([], schema)

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch["uri"].to_pylist(), batch["base"].to_pylist()):
                reader = open_reader(uri)
                for i in range(len(reader.index)):
                    entries = list(reader.block(i))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([id_of(k) for k, _, _ in entries], pa.int64()),
                            pa.array([base + s for _, s, _ in entries], pa.int64()),
                            pa.array([np.frombuffer(x, f"<u{reader.width}").astype("<u4").tobytes() for _, _, x in entries], pa.binary()),
                        ],
                        names=["doc_id", "start", "ids"],
                    )

    return spark.createDataFrame(rows, "uri string, base long").repartition(len(rows)).mapInArrow(get, schema)
