"""Line deduplication by a sharded minimal perfect hash over the distinct lines of a corpus.

A line's key is the line without blanks ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased, as 128 bits of a
cryptographic digest.  Keys found in ``min_docs`` documents lose all their lines in every document.

* Documents of a task form units of bounded size.  A unit counts a key once for each of its documents; Spark sums units.
* The distinct keys are dealt to shards by their digest.  A shard is one row of a written table: the bit levels of a
  minimal perfect hash (a key lies in the first level where no other key left over shares its bit, and its place is the
  number of bits before it), and at each key's place a 64-bit fingerprint and its number of documents.  A key that is not
  in the index is told by its fingerprint.
* Lines are never joined with lines: a unit sends the packed digests of its distinct keys to each shard once, the shard
  looks them up in its arrays, and answers with those to drop, so that a line in every document costs a digest a unit.

A row is a document: repeated rows count one by one, and so do rows of a null id.  A null or empty text is one empty
line, which stays.  Lines end at \\n alone; one at the end of a text makes an empty last line.  A text of any length is
read whole and is a unit of its own when it is longer than one.  An empty table gives an empty result.  Extra columns
are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.textbatch import U, checkpointed, mix, pick, row_key, shared_dir

MIN_DOCS, MIN_CHARS = 10, 1
#: Documents and lines of a unit; a longer document is a unit of its own.
UNIT_DOCS, UNIT_LINES = 20_000, 200_000
#: Keys of a shard: the table is cut into about SHARDS of them while a shard stays between these sizes.
SHARDS, LEAST_KEYS, MOST_KEYS = 4096, 1 << 15, 1 << 21
#: Bits of a level for each key that is left.
GAMMA = 2
DIGEST = 16
_STEP = U(0x9E3779B97F4A7C15)


def line_key(line: bytes) -> bytes:
    """A line as it is compared."""
    return line.strip(b" \t\n\v\f\r").lower()


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=DIGEST).digest()


def _long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (chars < 2 or len(key.decode()) >= chars)


def lanes(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The two 64-bit halves of packed digests."""
    both = np.frombuffer(packed, "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def distinct(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(digests in order, one row each, and how often each occurs)."""
    a, b = lanes(packed)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
    return np.column_stack([a[new], b[new]]), np.diff(np.r_[new, len(a)])


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys: levels of bits, a key's place the number of bits before its own."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # of 64-bit words
        self.before = [np.r_[0, np.cumsum(np.bitwise_count(x).astype(np.int64))] for x in levels]

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (mix(a ^ mix(b + U(int(_STEP) * (level + 1) % 2**64))) >> U(32)) * U(bits) >> U(32)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels = []
        while len(a):
            words = (GAMMA * len(a) + 63) // 64
            slot = cls._slot(a, b, len(levels), 64 * words).astype(np.int64)
            alone = np.bincount(slot, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = ~alone[slot]
            a, b = a[left], b[left]
        return cls(levels)

    def place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each key; of keys that were not built in, that of another key or -1."""
        place, left, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, (words, before) in enumerate(zip(self.levels, self.before)):
            slot = self._slot(a[left], b[left], level, 64 * len(words))
            word, bit = (slot >> U(6)).astype(np.int64), slot & U(63)
            found = (words[word] >> bit & U(1)).astype(bool)
            under = np.bitwise_count(words[word] & ((U(1) << bit) - U(1))).astype(np.int64)
            place[left[found]] = (base + before[word] + under)[found]
            left, base = left[~found], base + int(before[-1])
        return place

    def pack(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], "<u4")
        return head.tobytes() + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def unpack(cls, packed: bytes) -> PerfectHash:
        n = int(np.frombuffer(packed, "<u4", 1)[0])
        sizes, at, levels = np.frombuffer(packed, "<u4", n, 4).tolist(), 4 + 4 * n, []
        for size in sizes:
            levels.append(np.frombuffer(packed, "<u8", size, at))
            at += 8 * size
        return cls(levels)


def _fingerprint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(b ^ mix(a + _STEP))


def _shard(a: np.ndarray, shards: int) -> np.ndarray:
    return ((a >> U(32)) * U(shards) >> U(32)).astype(np.int64)


class LineIndex:
    """How many documents each distinct line has, as shards of a written table (shard, n, hash, fingerprints, counts)."""

    def __init__(self, shards: DataFrame, n_shards: int):
        self.table, self.n_shards = shards, n_shards

    @classmethod
    def build(cls, spark: SparkSession, counts: DataFrame, folder: str | None = None) -> LineIndex:
        """Of (a, b, n): a key's halves and its documents; keys are distinct."""
        folder = folder or f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
        n = counts.count()
        n_shards = max(1, -(-n // min(MOST_KEYS, max(LEAST_KEYS, n // SHARDS))))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                shard = _shard(x["a"].to_numpy().view("<u8"), n_shards)
                yield pa.RecordBatch.from_arrays([pa.array(shard), x["a"], x["b"], x["n"]], names=["shard", "a", "b", "n"])

        def make(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            a, b = (rows[c].to_numpy().view("<u8") for c in ("a", "b"))
            perfect = PerfectHash.build(a, b)
            place = perfect.place(a, b)
            prints, counts = np.zeros(len(a), "<u8"), np.zeros(len(a), "<u4")
            prints[place], counts[place] = _fingerprint(a, b), np.minimum(rows["n"].to_numpy(), 2**32 - 1)
            return pa.table({"shard": [key[0].as_py()], "n": [len(a)], "hash": [perfect.pack()], "fingerprints": [prints.tobytes()], "counts": [counts.tobytes()]}, schema=pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("hash", pa.binary()), ("fingerprints", pa.binary()), ("counts", pa.binary())]))

        dealt = counts.mapInArrow(deal, "shard long, a long, b long, n long")
        dealt.groupBy("shard").applyInArrow(make, "shard long, n long, hash binary, fingerprints binary, counts binary").write.parquet(folder)
        return cls(spark.read.schema("shard long, n long, hash binary, fingerprints binary, counts binary").parquet(folder), n_shards)

    def frequent(self, asked: DataFrame, min_docs: int) -> DataFrame:
        """(unit, digests) of the keys that units ask for, (shard, unit, digests), and that have min_docs documents."""

        def probe(asked: pa.Table, index: pa.Table) -> pa.Table:
            units, found = [], []
            if index.num_rows:
                perfect = PerfectHash.unpack(index["hash"][0].as_py())
                prints, counts = np.frombuffer(index["fingerprints"][0].as_py(), "<u8"), np.frombuffer(index["counts"][0].as_py(), "<u4")
                for unit, packed in zip(asked["unit"].to_pylist(), asked["digests"]):
                    a, b = lanes(packed.as_py())
                    place = perfect.place(a, b)
                    hit = (place >= 0) & (prints[place] == _fingerprint(a, b)) & (counts[place] >= min_docs)
                    if hit.any():
                        units.append(unit)
                        found.append(np.column_stack([a[hit], b[hit]]).tobytes())
            return pa.table([pa.array(units, pa.int64()), pa.array(found, pa.binary())], names=["unit", "digests"])

        return asked.groupBy("shard").cogroup(self.table.groupBy("shard")).applyInArrow(probe, "unit long, digests binary")


def _describe(min_chars: int, unit_docs: int, unit_lines: int):
    """Of each row: its unit, its number of lines, the digest of its text, and the digests of its distinct keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, docs, lines = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [])
            for text in batch["text"]:
                raw = (text.as_py() or "").encode()
                own = raw.split(b"\n")
                keys = {k for k in map(line_key, own) if _long_enough(k, min_chars)}
                if docs and (docs >= unit_docs or lines + len(keys) > unit_lines):
                    unit, docs, lines = unit + 1, 0, 0
                docs, lines = docs + 1, lines + len(keys)
                for column, x in zip(columns, (unit, len(own), hashlib.sha256(raw).hexdigest(), b"".join(map(_digest, keys)))):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], *map(pa.array, columns, kinds)], names=["doc_id", "key", "unit", "n_lines", "sha", "digests"])

    return run


def _by_unit(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(unit, distinct digests, their documents) of the units of a batch, whose rows lie together."""
    units, packed = batch["unit"].to_numpy(), batch["digests"].to_pylist()
    edge = np.flatnonzero(np.r_[True, units[1:] != units[:-1]][: len(units)])
    for i, j in zip(edge, [*edge[1:], len(units)]):
        yield (int(units[i]), *distinct(b"".join(packed[i:j])))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, keys, n in _by_unit(batch):
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].view("<i8")), pa.array(keys[:, 1].view("<i8")), pa.array(n.astype("<i8"))], names=["a", "b", "n"])


def _ask(shards: int):
    """(shard, unit, digests): what each unit wants to know of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, keys, _ in _by_unit(batch):  # in order, so a shard's keys lie together
                shard = _shard(keys[:, 0], shards)
                edge = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]][: len(shard)])
                parts = [keys[i:j].tobytes() for i, j in zip(edge, [*edge[1:], len(shard)])]
                yield pa.RecordBatch.from_arrays([pa.array(shard[edge], pa.int64()), pa.array([unit] * len(edge), pa.int64()), pa.array(parts, pa.binary())], names=["shard", "unit", "digests"])

    return run


def _mark(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """(doc_id, key, drop) of the documents of a unit that hold keys to drop; drop has their digests."""
    a, b = lanes(b"".join(answers["digests"].to_pylist()))
    hot = set(zip(a.tolist(), b.tolist()))
    at, drop = [], []
    for i, packed in enumerate(rows["digests"].to_pylist() if hot else []):
        a, b = lanes(packed)
        own = [k for k, pair in enumerate(zip(a.tolist(), b.tolist())) if pair in hot]
        if own:
            at.append(i)
            drop.append(b"".join(packed[DIGEST * k : DIGEST * (k + 1)] for k in own))
    return pa.table([rows["doc_id"].take(pa.array(at, pa.int64())), rows["key"].take(pa.array(at, pa.int64())), pa.array(drop, pa.binary())], names=["doc_id", "key", "drop"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, n_lines, n_dropped, kept) of texts and the digests of the keys that they lose."""
    for batch in batches:
        total, gone, kept = [], [], []
        for text, packed in zip(batch["text"], batch["drop"]):
            lines, packed = (text.as_py() or "").encode().split(b"\n"), packed.as_py()
            drop = {packed[i : i + DIGEST] for i in range(0, len(packed), DIGEST)}
            stay = [x for x in lines if _digest(line_key(x)) not in drop]
            total.append(len(lines))
            gone.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay).decode())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "key", "n_lines", "n_dropped", "kept"])


def deduplicate(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(cut, whole): cut has (doc_id, key, n_lines, n_dropped, kept text) of documents that lose lines, whole has (doc_id,
    key, n_lines, n_dropped, kept_sha256) of those that lose none, whose text stays as it is.  Rows are told apart by
    doc_id and key, an xxhash64 of id and text."""
    spark = docs.sparkSession
    src = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    rows = checkpointed(src.mapInArrow(_describe(min_chars, UNIT_DOCS, UNIT_LINES), "doc_id long, key long, unit long, n_lines long, sha string, digests binary"))
    lined = rows.where(F.length("digests") > 0)
    counts = checkpointed(lined.select("unit", "digests").mapInArrow(_counts, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    index = LineIndex.build(spark, counts)
    asked = lined.select("unit", "digests").mapInArrow(_ask(index.n_shards), "shard long, unit long, digests binary")
    answers = index.frequent(asked, min_docs)
    marked = lined.select("doc_id", "key", "unit", "digests").groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(_mark, "doc_id long, key long, drop binary")
    # equal rows have equal lines, and so does each of them here
    gone = checkpointed(marked.dropDuplicates(["doc_id", "key"])).alias("g")
    same = F.expr("g.key = r.key and g.doc_id <=> r.doc_id")
    cut = src.alias("r").join(gone, same).select("r.doc_id", "r.key", "r.text", "g.drop").mapInArrow(_cut, "doc_id long, key long, n_lines long, n_dropped long, kept string")
    whole = rows.alias("r").join(gone, same, "left_anti").select("doc_id", "key", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.col("sha").alias("kept_sha256"))
    return cut, whole
