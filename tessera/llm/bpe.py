"""Byte-level BPE encoding and decoding.

Each distinct piece of text gets a segment tree over its byte positions.  A leaf holds ``rank * leaves + position`` of
the pair that starts there, so the root is the leftmost pair of least rank; a merge changes the leaves of the merged
pair and of its live neighbours, each a climb of log2(leaves) nodes.  Trees of one size form a NumPy array and take
their next merges together; where only a few have a size, each is walked alone.  Chunks already seen are kept in a memo
of bounded bytes.

Texts: null counts as empty; an empty text has no ids and decodes to no bytes.  A very long text is encoded whole, and
one piece of n bytes takes n log n steps (a megabyte without any break: about half a minute).  Repeated rows and repeated
ids are encoded row by row.  An empty table gives an empty result.  Other columns of the input are not touched.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.chunks import ChunkMemo
from tessera.llm.textbatch import pick, release, text_slices

INF = np.int64(1) << 62
#: Of fewer trees of a size than this, each is walked alone.
FEW = 16
#: The split pattern of the public byte-level vocabularies, which has a faster form for texts below U+0250.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
_NEAR = re.compile("[\0-ɏ]*").fullmatch
_NEAR_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall


def splitter(pattern: str):
    """Text to its pieces, as findall of the pattern gives them."""
    general = regex.compile(pattern).findall
    return (lambda t: (_NEAR_SPLIT if _NEAR(t) else general)(t)) if pattern == USUAL else general


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, from lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Bpe:
    """Encoder and decoder of one rank table and split pattern."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = np.array(tokens, dtype=object)
        self.ranks = ranks = {t: i for i, t in enumerate(tokens) if t}
        self.split = splitter(pattern)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        found = {
            (ranks[t[:k]] << 32) | ranks[t[k:]]: r
            for t, r in ranks.items()
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        }
        keys = np.fromiter(found, np.int64, len(found))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.fromiter(found.values(), np.int64, len(found))[order]
        self.pairs = found
        self.chunks = ChunkMemo(self.encode_pieced) if pattern == USUAL else None

    def _keys(self, left: np.ndarray, right: np.ndarray, pos: np.ndarray, m: int) -> np.ndarray:
        """Leaf values of pairs; INF where the pair has no rank."""
        want = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, want), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == want, self.pair_ranks[at] * m + pos, INF)

    def _forest(self, pieces: list[bytes], m: int) -> list[bytes]:
        """Ids of pieces of at most m + 1 bytes; m, the leaves of a tree, is a power of two."""
        n, width = len(pieces), m + 2
        length = np.fromiter(map(len, pieces), np.int64, n)
        at = np.arange(width)
        raw = np.zeros((n, width), np.uint8)
        raw[at < length[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        tok = self.byte[raw]
        nxt = np.broadcast_to(at + 1, (n, width)).copy()
        prv = np.broadcast_to(at - 1, (n, width)).copy()
        live = at < length[:, None]
        tree = np.full((n, 2 * m), INF)
        r, p = np.nonzero(at[None, :m] + 1 < length[:, None])
        tree[r, m + p] = self._keys(tok[r, p], tok[r, p + 1], p, m)
        k = m
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray | np.int64) -> None:
            node = leaf + m
            tree[rows, node] = value
            while m > 1 and len(node) and node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] < INF)
        while len(rows):
            top = tree[rows, 1]
            rank, p = top // m, top % m
            q = nxt[rows, p]
            s = nxt[rows, q]
            tok[rows, p] = rank
            nxt[rows, p] = s
            live[rows, q] = False
            put(rows[q < m], q[q < m], INF)
            more = s < length[rows]
            prv[rows[more], s[more]] = p[more]
            value = np.full(len(rows), INF)
            value[more] = self._keys(rank[more], tok[rows[more], s[more]], p[more], m)
            put(rows, p, value)
            back = p > 0
            b, o = rows[back], prv[rows[back], p[back]]
            put(b, o, self._keys(tok[b, o], rank[back], o, m))
            rows = rows[tree[rows, 1] < INF]
        ids, ends = tok[live].astype("<u4").tobytes(), np.cumsum(live.sum(axis=1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _alone(self, piece: bytes, m: int) -> bytes:
        """Ids of one piece of at most m + 1 bytes; m is a power of two."""
        n, rank_of, none = len(piece), self.pairs.get, int(INF)
        tok, nxt, prv, live = [int(self.byte[b]) for b in piece], list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n

        def key(a: int, b: int, place: int) -> int:
            rank = rank_of(a << 32 | b)
            return none if rank is None else rank * m + place

        tree = [none] * (2 * m)
        for i in range(n - 1):
            tree[m + i] = key(tok[i], tok[i + 1], i)
        for i in range(m - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(leaf: int, value: int) -> None:
            node = leaf + m
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    return
                tree[node] = least

        while n > 1 and tree[1] < none:
            rank, p = divmod(tree[1], m)
            q = nxt[p]
            s = nxt[q]
            tok[p], nxt[p], live[q] = rank, s, 0
            if q < m:
                put(q, none)
            put(p, key(rank, tok[s], p) if s < n else none)
            if s < n:
                prv[s] = p
            if p:
                put(prv[p], key(tok[prv[p]], rank, prv[p]))
        return np.array([t for t, on in zip(tok, live) if on], "<u4").tobytes()

    def encode_pieces(self, pieces: Iterable[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers; a piece that is a token is that token."""
        pieces = list(pieces)
        out: list[bytes] = [b""] * len(pieces)
        sizes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = r.to_bytes(4, "little")
            else:
                sizes.setdefault(1 << max(0, (len(p) - 2).bit_length()), []).append(i)
        for m, own in sizes.items():
            if len(own) < FEW:
                for i in own:
                    out[i] = self._alone(pieces[i], m)
                continue
            step = max(1, (1 << 17) // m)
            for k in range(0, len(own), step):
                part = own[k : k + step]
                for i, ids in zip(part, self._forest([pieces[i] for i in part], m)):
                    out[i] = ids
        return out

    def encode_pieced(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, its distinct pieces encoded once."""
        split = list(map(self.split, texts))
        pieces = list(set().union(*split))
        get = dict(zip(pieces, self.encode_pieces([p.encode() for p in pieces]))).__getitem__
        return [b"".join(map(get, own)) for own in split]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.chunks.encode(texts) if self.chunks else self.encode_pieced([t or "" for t in texts])

    def forget(self) -> None:
        """Empties the memo, at the end of a task."""
        if self.chunks:
            self.chunks.forget()
        release()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.tokens[np.frombuffer(ids, "<u4")].tolist())


@functools.lru_cache(2)
def bpe(path: str, pattern: str) -> Bpe:
    """One per worker."""
    return Bpe(read_ranks(path), pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text as little-endian unsigned 32-bit integers."""
    src = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(ranks_path, pattern)
        for batch in batches:
            for i, j, *_ in text_slices(batch["text"]):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(coder.encode(part["text"].to_pylist()), pa.binary())], names=["doc_id", "ids"])
        coder.forget()

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): the bytes that ids stand for; null ids count as none."""
    src = pick(encoded, doc_id=id_col, ids=ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(ranks_path, pattern)
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([coder.decode(x or b"") for x in part["ids"].to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids and of what they decode to.

    Encodes and decodes in one pass, so the ids of the corpus never travel between stages.
    """
    src = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(ranks_path, pattern)
        for batch in batches:
            for i, j, *_ in text_slices(batch["text"]):
                part = batch.slice(i, j - i)
                coded = coder.encode(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        pa.array([len(x) // 4 for x in coded], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()),
                        pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in coded], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        coder.forget()

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
