"""Substring deduplication with a log-structured fingerprint index.

A window is ``window`` consecutive words.  Its fingerprint is the least hash of the ``gram``-word runs inside it, so equal
windows have equal fingerprints, and a document has far fewer distinct fingerprints than windows.

* The index is a list of immutable runs: tables of (fingerprint, smallest document), bucketed and sorted by fingerprint,
  which Spark knows of.  Documents come in batches of ascending ids.  A batch becomes a run and is merge-joined with
  every earlier run, bucket by bucket, so history is read in order and neither shuffled nor sorted again.  When
  ``FAN_IN`` runs have gathered, merges of their buckets compact them into one.
* A fingerprint found twice only makes its windows candidates.  They are verified on their words: each candidate window
  is digested (128 bits of a cryptographic hash of its words), each unit of documents keeps the smallest document of a
  digest, and buckets of digests find the smallest of all.
* Words covered by a window that starts in a document with a smaller id too are removed.  Whole copies of a document need
  no windows: all their words go.

Null texts have no words.  Documents shorter than a window lose nothing.  A very long text is read whole; its windows
stay in one unit.  Rows with a null id lose nothing and remove nothing; rows that repeat an id do not remove each
other's words.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.textbatch import U, Words, checkpointed, pick, row_key, shared_dir, text_slices

WINDOW, GRAM, BATCHES, FAN_IN, BUCKET_WINDOWS, BROADCAST_ROWS = 50, 25, 4, 3, 500_000, 500_000
#: Documents and windows that a unit of a task holds before its postings leave.
UNIT_DOCS, UNIT_WINDOWS = 60_000, 1_500_000
#: The setting under which Spark trusts the order of sorted buckets.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
EMPTY = hashlib.sha256(b"").hexdigest()


def fingerprints(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, fingerprint) of each window of a slice."""
    at = w.inside(window)
    if not len(at):
        return at, np.zeros(0, U)
    g = w.runs(gram)  # runs over two documents are in no window
    span, need = 1, window - gram + 1
    while 2 * span <= need:
        g, span = np.minimum(g[: len(g) - span], g[span:]), 2 * span
    rest = need - span
    g = np.minimum(g[: len(g) - rest], g[rest:]) if rest else g
    return at, g[at]


def digests(w: Words, at: np.ndarray, window: int) -> np.ndarray:
    """128 bits of a cryptographic hash of the words of the windows that start at ``at`` (ascending), one row each."""
    raw, made, doc = w.data.tobytes(), [], w.doc[at]
    for d in np.unique(doc):
        joined = memoryview(b" ".join(raw[w.offs[d] : w.offs[d + 1]].split()))
        own = slice(w.first[d], w.first[d + 1])
        place = np.r_[0, np.cumsum(w.ends[own] - w.starts[own] + 1)]
        first = at[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")] - w.first[d]
        for a, b in zip(place[first].tolist(), (place[first + window] - 1).tolist()):
            made.append(hashlib.blake2b(joined[a:b], digest_size=16).digest())
    return np.frombuffer(b"".join(made), "<u8").reshape(-1, 2)


def _describe(window: int, gram: int):
    """Of each row: the number of its words, the digest of all of them, its distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in text_slices(batch["text"]):
                w = Words(data, offs)
                at, fp = fingerprints(w, window, gram)
                cut = np.searchsorted(at, w.first)
                fps = [np.unique(fp[a:b]).view("<i8") for a, b in zip(cut, cut[1:])]
                raw = data.tobytes()
                sha = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(offs, offs[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(i, j - i), batch["key"].slice(i, j - i), pa.array(w.counts, pa.int64()), pa.array(sha),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in fps])], pa.int32()), pa.array(np.concatenate([*fps, np.zeros(0, "<i8")]))),
                    ],
                    names=["doc_id", "key", "n_words", "sha", "fps"],
                )

    return run


class Index:
    """Runs of (fp, doc_id), bucketed and sorted by fp, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fan_in: int = FAN_IN):
        self.spark, self.fan_in, self.made, self.name = spark, fan_in, 0, f"tessera_index_{uuid.uuid4().hex}"
        self.folder = folder or f"{shared_dir(spark)}/{self.name}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []  # the folder of each; its last part is the table's name

    def _run(self, rows: DataFrame) -> str:
        """rows written as a run; one task writes a bucket, so that its file is in order."""
        name, self.made = f"{self.name}_{self.made:05d}", self.made + 1
        rows.write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return f"{self.folder}/{name}"

    def table(self, run: str) -> DataFrame:
        return self.spark.table(run.rsplit("/", 1)[1])

    def forget(self, runs: list[str]) -> None:
        """Takes runs out of the session's catalogue; their files stay."""
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run.rsplit('/', 1)[1]}")

    @contextmanager
    def _in_order(self) -> Iterator[None]:
        """Inside, Spark takes a bucket that is one sorted file for sorted."""
        before = self.spark.conf.get(ORDERED, None)
        self.spark.conf.set(ORDERED, "true")
        try:
            yield
        finally:
            self.spark.conf.set(ORDERED, before) if before is not None else self.spark.conf.unset(ORDERED)

    def met(self, new: str, old: str) -> DataFrame:
        """(fp) that two runs hold: a merge join of their buckets."""
        return self.table(new).select("fp").join(self.table(old).select("fp").hint("merge"), "fp", "left_semi")

    def add(self, postings: DataFrame) -> DataFrame:
        """Files a batch of (fp, doc_id), whose ids are above those of earlier batches; (fp) found in two documents."""
        least = postings.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), (F.max("doc_id") > F.min("doc_id")).alias("twice"))
        new = self._run(least.repartition(self.buckets, "fp"))
        with self._in_order():
            found = self.table(new).where("twice").select("fp")
            for old in self.runs:
                found = found.unionByName(self.met(new, old))
            found = checkpointed(found)
        self.runs.append(new)
        if len(self.runs) >= self.fan_in:
            self.compact()
        return found

    def merged(self, one: str, two: str) -> DataFrame:
        """The smallest document of each fingerprint of two runs: a merge of their buckets."""
        other = self.table(two).select("fp", F.col("doc_id").alias("other")).hint("merge")
        return self.table(one).select("fp", "doc_id").join(other, "fp", "full_outer").select("fp", F.least("doc_id", "other").alias("doc_id"))

    def compact(self) -> None:
        """All runs become one, the newest first, so that the oldest and largest is written once."""
        while len(self.runs) > 1:
            *others, one, two = self.runs
            with self._in_order():
                self.runs = [*others, self._run(self.merged(one, two).withColumn("twice", F.lit(False)))]
            self.forget([one, two])


def _windows_map(window: int, gram: int, buckets: int):
    """Candidate windows of units, runs of a task's documents: postings for buckets, and what a unit settles itself."""

    def flush(unit: int, ids: np.ndarray, keys: np.ndarray, h: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        own = ids[doc]
        order = np.lexsort((own, h[:, 1], h[:, 0]))
        h, doc, place, own = h[order], doc[order], place[order], own[order]
        new = np.r_[True, (h[1:] != h[:-1]).any(axis=1)]
        repeat = own > own[np.flatnonzero(new)][np.cumsum(new) - 1]
        # a digest's smallest document of the unit speaks for it
        rows = [(buckets + unit % buckets, ids.astype("<i8").tobytes(), doc[repeat].astype("<u2").tobytes(), place[repeat].tobytes(), None, keys.astype("<i8").tobytes())]
        h, doc, place = h[~repeat], doc[~repeat], place[~repeat]
        edge = np.searchsorted((h[:, 0] >> U(32)) * U(buckets) >> U(32), np.arange(buckets + 1).astype(U))
        for r in np.flatnonzero(np.diff(edge)):
            part = slice(edge[r], edge[r + 1])
            refs, local = np.unique(doc[part], return_inverse=True)
            rows.append((r, h[part].tobytes(), local.astype("<u2").tobytes(), place[part].tobytes(), refs.astype("<u2").tobytes(), ids[refs].astype("<i8").tobytes()))
        columns = list(zip(*rows))
        kinds = [pa.int32(), *[pa.binary()] * 5]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays([arrays[0], pa.array([unit] * len(rows), pa.int64()), *arrays[1:]], names=["bucket", "unit", "hashes", "docs", "places", "refs", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, n_docs, n = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            fps, keys, ids = batch["fps"], batch["key"].to_numpy(), batch["doc_id"].to_numpy()
            for i, j, data, offs in text_slices(batch["text"]):
                if held and (n_docs + j - i > UNIT_DOCS or n > UNIT_WINDOWS):
                    yield flush(unit, *map(np.concatenate, zip(*held)))
                    unit, held, n_docs, n = unit + 1, [], 0, 0
                w = Words(data, offs)
                at, fp = fingerprints(w, window, gram)
                cut = np.searchsorted(at, w.first)
                some = [at[a:b][np.isin(fp[a:b].view("<i8"), fps[i + d].values.to_numpy())] for d, (a, b) in enumerate(zip(cut, cut[1:]))]
                at = np.concatenate([*some, np.zeros(0, np.int64)])
                doc = w.doc[at]
                held.append((ids[i:j], keys[i:j], digests(w, at, window), (doc + n_docs).astype(np.int32), (at - w.first[doc]).astype("<i4")))
                n_docs, n = n_docs + j - i, n + len(at)
        if n:
            yield flush(unit, *map(np.concatenate, zip(*held)))

    return run


def _windows_bucket(buckets: int):
    """(unit, docs, places) of the windows of a bucket that start in a smaller document too; what units settled passes."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] >= buckets:
            return pd.DataFrame({"unit": rows["unit"], "docs": rows["docs"], "places": rows["places"], "ids": rows["hashes"], "keys": rows["ids"]})
        h, place = np.frombuffer(b"".join(rows["hashes"]), "<u8").reshape(-1, 2), np.frombuffer(b"".join(rows["places"]), "<i4")
        local = [np.frombuffer(x, "<u2") for x in rows["docs"]]
        ids = np.concatenate([np.frombuffer(x, "<i8")[d] for x, d in zip(rows["ids"], local)])
        doc = np.concatenate([np.frombuffer(x, "<u2")[d] for x, d in zip(rows["refs"], local)])
        part = np.repeat(np.arange(len(rows)), list(map(len, local)))
        order = np.lexsort((ids, h[:, 1], h[:, 0]))
        s, own = h[order], ids[order]
        new = np.r_[True, (s[1:] != s[:-1]).any(axis=1)]
        found = order[own > own[np.flatnonzero(new)][np.cumsum(new) - 1]]
        found = found[np.argsort(part[found], kind="stable")]
        edge = np.flatnonzero(np.r_[True, np.diff(part[found]) != 0][: len(found)])
        cuts = list(zip(edge, [*edge[1:], len(found)]))
        units = rows["unit"].to_numpy()
        return pd.DataFrame({"unit": [units[part[found[a]]] for a, _ in cuts], "docs": [doc[found[a:b]].tobytes() for a, b in cuts], "places": [place[found[a:b]].tobytes() for a, b in cuts], "ids": [None] * len(cuts), "keys": [None] * len(cuts)})

    return run


def _windows_unit(rows: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, key, places) of the removed windows of each document of a unit."""
    ids, keys = (np.frombuffer(next(k for k in rows[c] if k is not None), "<i8") for c in ("ids", "keys"))
    doc, place = np.frombuffer(b"".join(rows["docs"]), "<u2"), np.frombuffer(b"".join(rows["places"]), "<i4")
    order = np.argsort(doc, kind="stable")
    doc, place = doc[order], place[order]
    edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]][: len(doc)])
    return pd.DataFrame({"doc_id": ids[doc[edge]], "key": keys[doc[edge]], "places": [place[a:b].tobytes() for a, b in zip(edge, [*edge[1:], len(doc)])]})


def _cut(window: int):
    """(doc_id, key, n_words, n_removed, kept) of texts and the places of their removed windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, *_ in text_slices(batch["text"]):
                part = batch.slice(i, j - i)
                total, gone, kept = [], [], []
                for text, places in zip(part["text"].to_pylist(), part["places"].to_pylist()):  # of whole windows
                    words = text.encode().split()
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(np.frombuffer(places, "<i4"))
                    edge[at] += 1
                    edge[at + window] -= 1
                    keep = np.cumsum(edge[:-1]) == 0
                    total.append(len(words))
                    gone.append(int((~keep).sum()))
                    kept.append(b" ".join([words[k] for k in np.flatnonzero(keep)]).decode())
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["key"], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "key", "n_words", "n_removed", "kept"])

    return run


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, index: Index | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(cut, whole): cut has (doc_id, key, n_words, n_removed, kept text) of documents that lose some of their words, and
    whole has (doc_id, key, n_words, n_removed, kept_sha256) of those that lose none or all.  Rows are told apart by
    doc_id and key, an xxhash64 of id and text."""
    spark, row = docs.sparkSession, ["doc_id", "key"]
    src = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    rows = checkpointed(src.mapInArrow(_describe(window, gram), "doc_id long, key long, n_words long, sha string, fps array<long>"))
    long_ = rows.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    # texts that occur in several documents; those of larger ids are copies
    least = checkpointed(long_.groupBy("sha").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").select("sha", "least"))
    least = F.broadcast(least) if least.count() <= BROADCAST_ROWS else least
    copy = F.coalesce((F.col("n_words") >= window) & (F.col("doc_id") > F.col("least")), F.lit(False))
    marked = rows.join(least, "sha", "left").withColumn("copy", copy)
    postings = checkpointed(marked.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window) & ~F.col("copy")).select(F.explode("fps").alias("fp"), *row))

    index, own, found = index or Index(spark), index is None, None
    cuts = sorted(set(postings.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or [])) if batches > 1 else []
    for low, high in zip([None, *cuts], [*cuts, None]):
        batch = postings.where((F.lit(True) if low is None else F.col("doc_id") >= low) & (F.lit(True) if high is None else F.col("doc_id") < high))
        more = index.add(batch.select("fp", "doc_id"))
        found = more if found is None else found.unionByName(more)
    if own:
        index.forget(index.runs)
    wanted = checkpointed(postings.join(found.distinct(), "fp", "left_semi").groupBy(*row).agg(F.collect_set("fp").alias("fps")))
    few = wanted.count() <= BROADCAST_ROWS
    only = wanted.select(*row)
    texts = src.join(F.broadcast(only) if few else only, row, "left_semi").dropDuplicates(row)
    buckets = max(16, math.ceil((rows.join(only, row, "left_semi").agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]) / BUCKET_WINDOWS))
    posted = texts.join(wanted, row).select("doc_id", "key", "text", "fps")
    # in a fixed order, so that a repeated task makes the same units
    posted = posted.sortWithinPartitions("doc_id", "key").mapInArrow(_windows_map(window, gram, buckets), "bucket int, unit long, hashes binary, docs binary, places binary, refs binary, ids binary")
    found = posted.groupBy("bucket").applyInPandas(_windows_bucket(buckets), "unit long, docs binary, places binary, ids binary, keys binary")
    flagged = checkpointed(found.groupBy("unit").applyInPandas(_windows_unit, "doc_id long, key long, places binary"))

    gone = flagged.select(*row)
    again = src.join(F.broadcast(gone) if few else gone, row, "left_semi").join(flagged, row).select("doc_id", "key", "text", "places")
    cut = again.mapInArrow(_cut(window), "doc_id long, key long, n_words long, n_removed long, kept string")
    whole = marked.join(gone, row, "left_anti")
    return cut, whole.select(
        "doc_id", "key", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.lit(0)).alias("n_removed"),
        F.when(F.col("copy"), F.lit(EMPTY)).otherwise(F.col("sha")).alias("kept_sha256"),
    )
