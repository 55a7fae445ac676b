"""Phrase collocations by pivot partitioning, as in MG-FSM.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``.  Phrases
are runs of 2 to ``LONGEST`` words of a piece that occur ``min_count`` times in one language.

* Documents of a task form units of bounded size, each with a dictionary of its words.  Words are counted over all
  units; the frequent ones are numbered by falling frequency, and each unit learns the numbers of its own.
* Every phrase belongs to its pivot, the rarest of its words (at ties of equal words the first).  A text is rewritten for
  each word in it as a pivot: the words around it as far as they are frequent and not rarer than it, three to a side.
  Equal fragments of a unit become one with a count.  Fragments go to the bucket of their pivot, which counts the phrases
  that hold the pivot, and no others, so that nearly every phrase is counted in one place and leaves it only if frequent.
* A word so frequent that its fragments would crowd a bucket is dealt over several by unit; what these count is partial
  and is summed.

A candidate's score is the least over its cuts in two parts, floor(2000000 a / (l + r)) in exact decimals.  Candidates
that a longer one holds with nearly their own frequency are dropped.  A null lang is ``und``; null and empty texts have
no words; every row counts, repeated ones and those of null ids too.  A text of any length is read whole; one longer than
a unit is a unit of its own.  An empty table gives an empty result.  Extra columns are ignored whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.textbatch import _LOWER, U, checkpointed, mix, pick, shared_dir, text_slices

LONGEST, MIN_COUNT, COVER, SCALE, TOP = 4, 30, 80, 2_000_000, 2000
#: Bytes of text of a unit, words of a bucket's share, and occurrences beyond which a pivot is dealt over several buckets.
UNIT_BYTES, BUCKET_WORDS, HOT_WORDS, LEAST_BUCKETS = 8 << 20, 1 << 20, 1 << 18, 64
#: Fragments of a bucket that are mined at once; more only if they have one pivot.
MINED_ROWS = 1 << 18
#: Candidates of a language are ranked in so many parts before their best are ranked together.
RANK_PARTS = 64
_KIND = np.zeros(256, np.uint8)  # 0 in words, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_SIDE = LONGEST - 1
#: Words to the left and right of a fragment's pivot.
SHAPES = [(left, right) for left in range(LONGEST) for right in range(LONGEST) if left + right]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """(words of a slice of texts, whether a new piece begins with each)."""
    kind = _KIND[data]
    other = np.ones(len(data) + 2, bool)
    other[1:-1] = kind > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(~other[1:-1] & (other[:-2] | edge[:-1]))
    ends = np.flatnonzero(~other[1:-1] & (other[2:] | edge[1:])) + 1
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, bool)
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts] + np.searchsorted(offs, starts, "right")
    values = _LOWER[data[kind == 0]]
    places = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(values)), np.r_[True, piece[1:] != piece[:-1]]


def _tokenise(unit_bytes: int):
    """(unit, tokens, langs, words, counts): tokens are places in the unit's words from 1, 0 where a piece begins."""

    def flush(unit: int, held: dict[str, list]) -> pa.RecordBatch | None:
        tokens, langs, found, counts, base = [], [], [], [], 0
        for lang, parts in held.items():
            new = np.concatenate([x for _, x in parts])
            if not len(new):
                continue
            coded = pa.concat_arrays([x for x, _ in parts]).dictionary_encode()
            codes = coded.indices.to_numpy()
            at = np.arange(len(codes)) + np.cumsum(new)
            own = np.zeros(at[-1] + 1, "<u4")
            own[at] = codes + np.uint32(base + 1)
            tokens.append(own)
            found.append(coded.dictionary)
            langs.append(pa.array([lang] * len(coded.dictionary), pa.string()))
            counts.append(np.bincount(codes, minlength=len(coded.dictionary)))
            base += len(coded.dictionary)
        if not tokens:
            return None
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, base], pa.int32()), x)
        arrays = [pa.array([unit], pa.int64()), pa.array([np.concatenate(tokens).tobytes()], pa.binary()), whole(pa.concat_arrays(langs)), whole(pa.concat_arrays(found)), whole(pa.array(np.concatenate(counts), pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, names=["unit", "tokens", "langs", "words", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, size = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            lang = batch["lang"].dictionary_encode()
            for k, name in enumerate(lang.dictionary.to_pylist()):
                for _, _, data, offs in text_slices(batch["text"].filter(pc.equal(lang.indices, k))):
                    if size and size + len(data) > unit_bytes:
                        if (made := flush(unit, held)) is not None:
                            yield made
                        unit, held, size = unit + 1, {}, 0
                    held.setdefault(name, []).append(words(data, offs))
                    size += len(data)
        if held and (made := flush(unit, held)) is not None:
            yield made

    return run


def extents(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) of each place as a pivot: how far the words around it are frequent (above 0) and not rarer (larger).
    To the left equal words stop it too, so that a phrase belongs to its first rarest word alone."""
    n = len(ids)
    around = np.zeros(n + 2 * _SIDE, ids.dtype)
    around[_SIDE : _SIDE + n] = ids
    left, right, to_left, to_right = np.zeros(n, np.int8), np.zeros(n, np.int8), ids > 0, ids > 0
    for k in range(1, _SIDE + 1):
        x, y = around[_SIDE - k : _SIDE - k + n], around[_SIDE + k : _SIDE + k + n]
        to_left, to_right = to_left & (x > 0) & (x < ids), to_right & (y > 0) & (y <= ids)
        left, right = left + to_left, right + to_right
    return left, right


def _hashed(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), U)
    for k in range(rows.shape[1]):
        h = mix(h + rows[:, k].astype(U) + U(0x9E3779B97F4A7C15))
    return h


def gathered(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of equal rows and the sums of their counts, after a sort by hash: equal rows are one but for collisions."""
    order = np.argsort(_hashed(rows))
    rows = rows[order]
    new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)][: len(rows)])
    return rows[new], np.add.reduceat(counts[order], new) if len(new) else counts[:0]


def exactly(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and the sums of their counts."""
    order = np.lexsort(rows.T)
    rows = rows[order]
    new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)][: len(rows)])
    return rows[new], np.add.reduceat(counts[order], new) if len(new) else counts[:0]


def frequent(rows: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows whose counts sum to ``least``: those of hashes whose counts do, counted exactly."""
    h = _hashed(rows)
    order = np.argsort(h)
    h = h[order]
    new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
    enough = np.add.reduceat(counts[order], new) >= least if len(new) else np.zeros(0, bool)
    rows, counts = exactly(*(x[order[np.repeat(enough, np.diff(np.r_[new, len(h)]))]] for x in (rows, counts)))
    return rows[counts >= least], counts[counts >= least]


def _fragments(buckets: int, kind: str):
    """(bucket, partial, sizes, rows, counts): of each unit and bucket its fragments shape by shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, tokens, n, at, ids, parts in zip(batch["unit"].to_pylist(), batch["tokens"], batch["n"].to_pylist(), batch["at"], batch["ids"], batch["parts"]):
                number, share = np.zeros(n + 1, kind), np.ones(n + 1, np.int32)
                place = at.values.to_numpy() + 1
                number[place], share[place] = ids.values.to_numpy(), parts.values.to_numpy()
                tokens = np.frombuffer(tokens.as_py(), "<u4")
                share, ids = share[tokens], number[tokens]
                left, right = extents(ids)
                blocks = []
                for a, b in SHAPES:
                    pivot = np.flatnonzero((left == a) & (right == b))
                    rows = np.lib.stride_tricks.sliding_window_view(ids, a + b + 1)[pivot - a] if len(pivot) else np.zeros((0, a + b + 1), kind)
                    rows, counts = gathered(np.c_[rows, share[pivot].astype(kind)], np.ones(len(pivot), np.int64))
                    many = rows[:, -1] > 1
                    part = np.where(many, mix(np.array([unit], U)) % np.maximum(rows[:, -1], 1).astype(U), U(0))
                    bucket = (mix(mix(rows[:, a].astype(U)) + part) % U(buckets)).astype(np.int64) * 2 + many
                    order = np.argsort(bucket, kind="stable")
                    blocks.append((bucket[order], rows[order, :-1], counts[order].astype("<u4")))
                used = np.unique(np.concatenate([b for b, _, _ in blocks]))
                cuts = [(np.searchsorted(b, used), np.searchsorted(b, used, "right")) for b, _, _ in blocks]
                sizes = np.column_stack([hi - lo for lo, hi in cuts]).astype("<u4")
                made = [[b"".join(x[2 - (i == 0)][lo[k] : hi[k]].tobytes() for x, (lo, hi) in zip(blocks, cuts)) for k in range(len(used))] for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used // 2), pa.array(used % 2 == 1), pa.array([x.tobytes() for x in sizes], pa.binary()), pa.array(made[0], pa.binary()), pa.array(made[1], pa.binary())],
                    names=["bucket", "partial", "sizes", "rows", "counts"],
                )

    return run


def _blobs(rows: np.ndarray) -> pa.Array:
    """Each row's numbers as big-endian bytes, made at once: an object for each would take several times their size."""
    big = np.ascontiguousarray(rows, rows.dtype.newbyteorder(">"))
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(big)])


def _mine(least: int, kind: str):
    """(gram, a, partial): the phrases of a bucket's fragments that hold their pivot, words as big-endian numbers.  Pivots are
    taken some at a time, as a phrase belongs to one of them."""
    width = np.dtype(kind).itemsize

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        grams, total, flags = [pa.array([], pa.binary())], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for partial in (False, True):
            own = table.filter(pc.equal(table["partial"], partial))
            found: list[list] = [[[np.zeros((0, a + b + 1), kind)], [np.zeros(0, "<u4")]] for a, b in SHAPES]
            for sizes, rows, counts in zip(own["sizes"], own["rows"], own["counts"]):
                rows, counts, at, first = rows.as_buffer(), np.frombuffer(counts.as_buffer(), "<u4"), 0, 0
                for (a, b), (some, n), size in zip(SHAPES, found, np.frombuffer(sizes.as_buffer(), "<u4").tolist()):
                    if size:
                        cells = size * (a + b + 1)
                        some.append(np.frombuffer(rows, kind, cells, at * width).reshape(size, -1))
                        n.append(counts[first : first + size])
                        at, first = at + cells, first + size
            whole = [(a, b, np.concatenate(some), np.concatenate(n)) for (a, b), (some, n) in zip(SHAPES, found)]
            found.clear()
            groups = max(1, -(-sum(len(rows) for _, _, rows, _ in whole) // MINED_ROWS))
            group = [mix(rows[:, a].astype(U) + U(0x9E3779B97F4A7C15)) % U(groups) if groups > 1 else np.zeros(len(rows), np.uint8) for a, _, rows, _ in whole]
            for g in range(groups):
                picked = [(a, b, rows[at == g], n[at == g]) for (a, b, rows, n), at in zip(whole, group)]
                for k in range(2, LONGEST + 1):
                    runs, n = [np.zeros((0, k), kind)], [np.zeros(0, np.int64)]
                    for a, b, rows, count in picked:
                        if a + b + 1 >= k:
                            for s in range(max(0, a - k + 1), min(a, a + b + 1 - k) + 1):
                                runs.append(rows[:, s : s + k])
                                n.append(count)
                    runs, n = np.concatenate(runs), np.concatenate(n).astype(np.int64)
                    rows, n = exactly(runs, n) if partial else frequent(runs, n, least)
                    grams.append(_blobs(rows))
                    total.append(n)
                    flags.append(np.full(len(n), partial))
        return pa.table([pa.chunked_array(grams, pa.binary()), pa.array(np.concatenate(total), pa.int64()), pa.array(np.concatenate(flags), pa.bool_())], names=["gram", "a", "partial"])

    return run


def vocabulary(counts: DataFrame, min_count: int) -> DataFrame:
    """(lang, word, n, id) of the frequent words, numbered from 1 by falling n."""
    most = counts.where(F.col("n") >= min_count).repartitionByRange(F.col("n").desc(), "lang", "word").sortWithinPartitions(F.col("n").desc(), "lang", "word")
    most = checkpointed(most.withColumn("seq", F.monotonically_increasing_id())).withColumn("block", F.shiftright("seq", 33))
    blocks = most.groupBy("block").agg(F.count("*").alias("m"))  # a row for each partition
    shift = blocks.select("block", (F.coalesce(F.sum("m").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).alias("shift"))
    return checkpointed(most.join(F.broadcast(shift), "block").select("lang", "word", "n", (F.col("seq") - F.shiftleft("block", 33) + F.col("shift")).alias("id")))


def mine(docs: DataFrame, min_count: int = MIN_COUNT, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(phrases (gram, a), words (lang, word, n, id, gram), languages (lang, n), bytes of a word in a gram)."""
    spark = docs.sparkSession
    src = pick(docs, lang=lang_col, text=text_col).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where("text is not null")
    folder, schema = f"{shared_dir(spark)}/collocations-{uuid.uuid4().hex}", "unit long, tokens binary, langs array<string>, words array<string>, counts array<long>"
    src.mapInArrow(_tokenise(UNIT_BYTES), schema).write.option("compression", "zstd").parquet(folder)
    units = spark.read.schema(schema).parquet(folder)

    every = units.select(F.explode(F.arrays_zip("langs", "words", "counts")).alias("w")).select(F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    counts = checkpointed(every.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = checkpointed(counts.groupBy("lang").agg(F.sum("n").alias("n")))
    vocab = vocabulary(counts, min_count)
    n_ids, n_words = (vocab.count(), languages.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    kind = "<u4" if n_ids < 2**32 else "<u8"
    width = np.dtype(kind).itemsize
    buckets = max(LEAST_BUCKETS, -(-n_words // BUCKET_WORDS))

    own = units.select("unit", F.posexplode(F.arrays_zip("langs", "words")).alias("at", "w")).select("unit", "at", F.col("w.langs").alias("lang"), F.col("w.words").alias("word"))
    known = own.join(vocab.select("lang", "word", "id", F.ceil(F.col("n") / HOT_WORDS).cast("int").alias("parts")), ["lang", "word"])
    known = known.groupBy("unit").agg(F.collect_list(F.struct("at", "id", "parts")).alias("w")).select("unit", *[F.col(f"w.{c}").alias(x) for c, x in (("at", "at"), ("id", "ids"), ("parts", "parts"))])
    told = units.select("unit", "tokens", F.size("words").alias("n")).join(known, "unit")
    pieces = told.mapInArrow(_fragments(buckets, kind), "bucket long, partial boolean, sizes binary, rows binary, counts binary")
    mined = checkpointed(pieces.groupBy("bucket").applyInArrow(_mine(min_count, kind), "gram binary, a long, partial boolean"))
    summed = mined.where("partial").groupBy("gram").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)
    phrases = mined.where("not partial").select("gram", "a").unionByName(summed)
    return phrases, vocab.withColumn("gram", F.unhex(F.lpad(F.hex("id"), 2 * width, "0"))), languages, width


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, cover: int = COVER, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate that is not dropped."""
    found, vocab, languages, width = mine(docs, min_count, lang_col, text_col)
    phrases = checkpointed(found)
    size = F.expr(f"cast(octet_length(gram) / {width} as int)")
    part = lambda start, n: F.substring("gram", start * width + 1, n * width)
    known = phrases.select("gram", F.col("a").alias("f"), F.lit(None).cast("string").alias("lang")).unionByName(vocab.select("gram", F.col("n").alias("f"), "lang"))
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("gram", "a", "cut", part(F.lit(0), F.col("cut")).alias("first"), part(F.col("cut"), size - F.col("cut")).alias("rest"))
    cuts = cuts.join(known.select(F.col("gram").alias("first"), F.col("f").alias("l"), "lang"), "first").join(known.select(F.col("gram").alias("rest"), F.col("f").alias("r")), "rest")
    big = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("_a", F.lit(SCALE).cast("decimal(10,0)") * big("a")).withColumn("_b", big("l") + big("r")).withColumn("score", F.expr("_a div _b"))
    scored = cuts.groupBy("gram").agg(F.max("a").alias("a"), F.max("lang").alias("lang"), F.min(F.struct("score", "cut", "l", "r")).alias("s"))

    inner = [F.struct(F.lit(k).alias("k"), F.lit(at).alias("at"), F.lit(n).alias("n")) for k in range(3, LONGEST + 1) for n in range(2, k) for at in range(k - n + 1)]
    held = phrases.withColumn("k", size).where("k > 2").withColumn("i", F.explode(F.filter(F.array(*inner), lambda x: x["k"] == F.col("k"))))
    held = held.select(part(F.col("i.at"), F.col("i.n")).alias("gram"), "a").groupBy("gram").agg(F.max("a").alias("longer"))
    kept = scored.join(held, "gram", "left").where(F.col("longer").isNull() | (100 * big("longer") < cover * big("a")))

    each = kept.select("gram", F.posexplode(F.transform(F.sequence(F.lit(0), size - 1), lambda i: part(i, F.lit(1)))).alias("at", "word_id"))
    spelled = each.join(vocab.select(F.col("gram").alias("word_id"), "word"), "word_id").groupBy("gram").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return kept.join(spelled, "gram").join(languages, "lang").select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")


def top(docs: DataFrame, limit: int = TOP, **how) -> DataFrame:
    """The first ``limit`` of each language by score, frequency and phrase, with their rank."""
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    found = collocations(docs, **how).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    found = found.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*best))).where(F.col("_rank") <= limit)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= limit)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
