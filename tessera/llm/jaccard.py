"""N-gram Jaccard join of whole documents by prefix trees, and the groups it makes.

Two sets of word shingles link when their Jaccard similarity reaches a percentage.  No pair of unrelated documents is
ever formed:

1. *Filter.*  A set that links keeps at least that percentage of its own shingles in common with another document.  Each
   unit of documents sorts its shingle hashes, resolves those that it holds twice itself, and sends one posting for each
   hash to the bucket of the hash; buckets answer with how many shingles of each document are shared.
2. *Classes.*  Documents with equal sets form a class; its smallest id stands for it.
3. *Pivots.*  Of globally ordered (hash order) sets, linked ones share a token among their first n - ceil(p n) + 1.  All
   holders of such a token meet only its smallest holder: a prefix tree over up to ``CHUNK`` holders, probed by the pivot.
4. *Rest.*  Shingles that occur in one component so far prove nothing new, so the filter is repeated with components in
   place of documents.  Sets that are left are ordered with their rarest shingle first.  Two of them are a candidate only
   if they share a shingle that stands so early in both that what is left after it can still reach what their lengths
   require; candidates are dealt to blocks and probed as in step 3.
5. *Count.*  Steps 3 and 4 find the components, not every link.  All links of a set lie inside its component, so the
   components are cut by length and hash into chunks, and every two chunks whose lengths fit are probed once more, now
   for all links.  Only their number for each set leaves a task: a family of m sets has up to m (m - 1) / 2 of them, and
   a set goes to as many tasks as there are chunks that fit it.

A prefix tree holds sets in the order of (holders in the chunk, hash), so near copies share long paths.  It is walked
once for all probes: a node adds its tokens' row of the probe matrix to its parent's overlaps, and a subtree is left when
no probe's overlap plus the subtree's remaining length can reach what the lengths require.

A shingle is a 64-bit hash of its words, chained without algebra; equal sets are told by a 128-bit digest of the whole
set (the filter, which may only err towards keeping, uses fewer bits).  Null and empty texts have no shingles and link
with nothing.  A very long text is one set, however many shingles it has.  Rows with a null id take no part: their
component is null.  Repeated rows get equal results, and two texts of one id are two sets.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tessera.llm.graph import components
from tessera.llm.textbatch import U, Words, checkpointed, pick, release, text_slices

BUCKET_POSTINGS, CHUNK, BROADCAST_ROWS, NONE = 1_000_000, 128, 500_000, 65535
#: Documents and postings that a unit of a task holds before its postings leave.
UNIT_DOCS, UNIT_POSTINGS = 60_000, 700_000
_DOC = np.dtype([("doc_id", "<i8"), ("known", "<i4"), ("n", "<i4"), ("key", "<i8"), ("d1", "<u8"), ("d2", "<u8"), ("shared", "<i8")])
#: What names a pair of chunks of a component.
_CHUNKS = ["band", "chunk", "band2", "chunk2"]
_PER_DOC = "doc_id long, key long, n int, d1 long, d2 long, shared long"


def _filter_map(k: int, buckets: int):
    """Units, runs of a task's documents, to postings (bucket, unit, hashes, documents) and a row on their documents."""

    def describe(keys: np.ndarray, ids: np.ndarray, known: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        info, flat = np.zeros(len(sets), _DOC), np.concatenate([*sets, np.zeros(0, U)])
        info["doc_id"], info["known"], info["key"], info["n"] = ids, known, keys, [len(s) for s in sets]
        digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), "<u8").reshape(-1, 2)
        info["d1"], info["d2"] = digests[:, 0], digests[:, 1]
        return info, flat

    def flush(unit: int, info: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
        info, doc = info.copy(), np.repeat(np.arange(len(info), dtype=np.int32), info["n"])
        live = info["known"][doc] == 1
        flat, doc = (flat, doc) if live.all() else (flat[live], doc[live])
        order = np.argsort(flat, kind="stable")
        flat, doc = flat[order], doc[order]
        start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]][: len(flat)])
        held = np.diff(np.r_[start, len(flat)])
        info["shared"] = np.bincount(doc[np.repeat(held > 1, held)], minlength=len(info))
        one, h = np.where(held > 1, NONE, doc[start]).astype("<u2"), flat[start]
        cut = np.searchsorted((h >> U(32)) * U(buckets) >> U(32), np.arange(buckets + 1).astype(U))
        rows, low = np.flatnonzero(np.diff(cut)), h.astype("<u4")
        bucket = [*rows.tolist(), buckets + unit % buckets]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket, pa.int32()),
                pa.array([unit] * len(bucket), pa.int64()),
                pa.array([*(low[cut[r] : cut[r + 1]].tobytes() for r in rows), info.tobytes()], pa.binary()),
                pa.array([*(one[cut[r] : cut[r + 1]].tobytes() for r in rows), b""], pa.binary()),
            ],
            names=["bucket", "slice", "hashes", "docs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, n_docs, n = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            keys = batch["key"].to_numpy()
            ids, known = batch["doc_id"].fill_null(0).to_numpy(), batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            for i, j, data, offs in text_slices(batch["text"]):
                if held and (n_docs + j - i > UNIT_DOCS or n > UNIT_POSTINGS):
                    yield flush(unit, *map(np.concatenate, zip(*held)))
                    unit, held, n_docs, n = unit + 1, [], 0, 0
                info, flat = describe(keys[i:j], ids[i:j], known[i:j], Words(data, offs, lower=True).shingles(k))
                held.append((info, flat))
                n_docs, n = n_docs + j - i, n + len(flat)
        if held:
            yield flush(unit, *map(np.concatenate, zip(*held)))
            held = []
        release()

    return run


def _filter_bucket(buckets: int):
    """(slice, documents, counts) of the postings of a bucket that another unit holds too; other rows pass."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] >= buckets:
            return pd.DataFrame({"slice": rows["slice"], "docs": rows["hashes"], "counts": b""})
        h, doc = np.frombuffer(b"".join(rows["hashes"]), "<u4"), np.frombuffer(b"".join(rows["docs"]), "<u2")
        part = np.repeat(np.arange(len(rows)), [len(x) // 4 for x in rows["hashes"]])
        order = np.argsort(h, kind="stable")
        s = h[order]
        twice = np.zeros(len(s), bool)
        twice[1:] = s[1:] == s[:-1]
        twice[:-1] |= twice[1:]
        at = order[twice]
        at = at[doc[at] != NONE]
        pair, n = np.unique(part[at] * 65536 + doc[at].astype(np.int64), return_counts=True)
        start = np.flatnonzero(np.r_[True, pair[1:] // 65536 != pair[:-1] // 65536][: len(pair)])
        end = np.r_[start[1:], len(pair)]
        slices = rows["slice"].to_numpy()
        return pd.DataFrame(
            {
                "slice": [slices[pair[a] // 65536] for a in start],
                "docs": [(pair[a:b] % 65536).astype("<u2").tobytes() for a, b in zip(start, end)],
                "counts": [n[a:b].astype("<u4").tobytes() for a, b in zip(start, end)],
            }
        )

    return run


def _filter_slice(rows: pd.DataFrame) -> pd.DataFrame:
    """What is known of each document of a unit, with its number of shared shingles."""
    info = np.frombuffer(next(d for d, c in zip(rows["docs"], rows["counts"]) if not c), _DOC).copy()
    for d, c in zip(rows["docs"], rows["counts"]):
        if c:
            info["shared"][np.frombuffer(d, "<u2")] += np.frombuffer(c, "<u4")
    out = pd.DataFrame({c: info[c].astype(np.int64) for c in ("doc_id", "key", "n", "d1", "d2", "shared")})
    out["doc_id"] = out["doc_id"].astype("Int64").where(info["known"] == 1)
    return out


def need(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least common size at which sets of n and m elements link."""
    return -(-percent * (n + m) // (100 + percent))


def walk(tree: list[np.ndarray], sizes: np.ndarray, probes: list[np.ndarray], p_sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(set of the tree, probe) pairs that link; sets are sorted hash arrays, sizes their numbers of elements."""
    any_probe = np.unique(np.concatenate([*probes, np.zeros(0, U)]))
    kept = []
    for s in tree:
        at = np.minimum(np.searchsorted(any_probe, s), max(0, len(any_probe) - 1))
        kept.append(at[any_probe[at] == s] if len(any_probe) else at[:0])
    # the global order of the tree: tokens of most sets first
    holders = np.bincount(np.concatenate([*kept, np.zeros(0, np.int64)]), minlength=len(any_probe))
    rank = np.empty(len(any_probe), np.int64)
    rank[np.lexsort((np.arange(len(any_probe)), -holders))] = np.arange(len(any_probe))
    used = int((holders > 0).sum())
    paths = [np.sort(rank[k]) for k in kept]
    held = np.zeros((used, len(probes)), np.uint8)
    for j, p in enumerate(probes):
        r = rank[np.searchsorted(any_probe, p)]
        held[r[r < used], j] = 1
    order = sorted(range(len(tree)), key=lambda i: paths[i].astype(">u4").tobytes())
    paths, sizes = [paths[i] for i in order], np.asarray(sizes)[order]
    total = held.sum(axis=0, dtype=np.int64)

    def common(a: np.ndarray, b: np.ndarray) -> int:
        m = min(len(a), len(b))
        return int((np.r_[a[:m] != b[:m], True]).argmax())

    n = len(order)
    shared = [common(paths[i], paths[i + 1]) if i + 1 < n else 0 for i in range(n)]  # with the next path
    stack: list[tuple[int, np.ndarray]] = [(0, np.zeros(len(probes), np.int64))]
    out, i = [], 0
    while i < n:
        path, depth_next = paths[i], shared[i]
        depth, overlap = stack[-1]
        if depth_next > depth:  # a node that the next path shares
            overlap = overlap + held[path[depth:depth_next]].sum(axis=0, dtype=np.int64)
            last = i + 1
            while last < n and shared[last - 1] >= depth_next:
                last += 1
            below = range(i, last)
            rest = max(len(paths[x]) for x in below) - depth_next
            least = need(int(sizes[i:last].min()), p_sizes, percent)
            if not ((overlap + rest >= least) & (total >= least)).any():
                i = last  # the whole subtree
                depth_next = shared[i - 1] if i else 0
                while stack[-1][0] > depth_next:
                    stack.pop()
                continue
            stack.append((depth_next, overlap))
            depth = depth_next
        full = overlap + held[path[depth:]].sum(axis=0, dtype=np.int64)
        for j in np.flatnonzero(full >= need(int(sizes[i]), p_sizes, percent)):
            out.append((order[i], int(j)))
        while stack[-1][0] > depth_next:
            stack.pop()
        i += 1
    return out


def _meet(percent: int):
    """Links (a, b) of the tree rows and probe rows of each block of a group."""

    def run(key, tree: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        by = {k: g for k, g in probes.groupby("block")}
        for block, own in tree.groupby("block"):
            if (other := by.get(block)) is None:
                continue
            own, other = own.drop_duplicates("id"), other.drop_duplicates("id")
            t, p = [np.frombuffer(x, U) for x in own["set"]], [np.frombuffer(x, U) for x in other["set"]]
            ids, others = own["id"].to_numpy(), other["id"].to_numpy()
            comp, comps = own["comp"].to_numpy(), other["comp"].to_numpy()
            for i, j in walk(t, own["n"].to_numpy(), p, other["n"].to_numpy().astype(np.int64), percent):
                if comp[i] != comps[j]:
                    a.append(ids[i])
                    b.append(others[j])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def _links(tree: DataFrame, probes: DataFrame, rows: int, percent: int) -> DataFrame:
    """Meets (block, id, n, comp, set) rows by block; several blocks share a task's group.

    A block is the hash of what names it: two that clash meet each other too, which adds no link that is not one.
    """
    groups = max(64, math.ceil(rows / 64))
    tree, probes = (x.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups))) for x in (tree, probes))
    probes = probes.toDF(*probes.columns)
    return checkpointed(tree.groupBy("g").cogroup(probes.groupBy("g")).applyInPandas(_meet(percent), "a long, b long"))


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(h, doc, id, n) of the first n - ceil(percent n) + 1 tokens of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                n = part["n"].to_numpy().astype(np.int64)
                p = n - (-(-percent * n // 100)) + 1
                h = [np.frombuffer(s, "<i8")[:m] for s, m in zip(part["set"].to_pylist(), p)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h)), *(pa.array(np.repeat(part[c].to_numpy(), p)) for c in ("doc", "id")), pa.array(np.repeat(n, p).astype(np.int32))], names=["h", "doc", "id", "n"])

    return sets.select("doc", "id", "n", "set").mapInArrow(run, "h long, doc long, id long, n int")


def _fits(a, b, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _star_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links of the holders of each prefix token with the holder of the smallest document, often what they were copied from."""
    posts = _prefixes(sets, percent)
    pivot = posts.groupBy("h").agg(F.min(F.struct("doc", "id", "n")).alias("p"), F.count("*").alias("c")).where("c > 1").select("h", "p")
    edges = posts.join(pivot, "h").where((F.col("p.id") != F.col("id")) & _fits(F.col("p.n"), F.col("n"), percent))
    edges = edges.select(F.col("p.id").alias("pivot"), "id").distinct()
    return _probe(edges, sets.select("id", "n", F.col("id").alias("comp"), "set"), percent)


def _probe(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the edges (pivot, id) whose ends differ in comp; sets: (id, n, comp, set)."""
    edges = checkpointed(edges)
    held = edges.groupBy("pivot").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = edges.join(held, "pivot").withColumn("block", F.xxhash64("pivot", F.pmod(F.xxhash64("id"), F.col("chunks"))))
    tree = dealt.join(sets, "id").select("block", "id", "n", "comp", "set")
    asked = dealt.select("pivot", "block").distinct().join(sets.withColumnRenamed("id", "pivot"), "pivot")
    return _links(tree, asked.select("block", F.col("pivot").alias("id"), "n", "comp", "set"), edges.count(), percent)


def _rest_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that the pivots have not found; sets: (id, n, comp, set)."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                h = [np.frombuffer(s, "<i8") for s in part["set"].to_pylist()]
                n = [len(x) for x in h]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h)), pa.array(np.repeat(part["id"].to_numpy(), n)), pa.array(np.repeat(part["comp"].to_numpy(), n))], names=["h", "id", "comp"])

    flat = sets.select("id", "comp", "set").mapInArrow(tokens, "h long, id long, comp long")
    common = flat.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("c")).where("x != y").select("h", "c")
    held = flat.select("h", "id").join(common, "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("t"))
    left = checkpointed(sets.select("id", "n", "comp").join(held, "id").where(100 * F.size("t") >= percent * F.col("n")))
    posts = left.select("id", "n", "comp", F.size("t").alias("size"), F.posexplode("t.h").alias("at", "h"))
    posts = posts.withColumn("rest", F.col("size") - F.col("at")).where(100 * F.col("rest") >= percent * F.col("n")).select("h", "id", "n", "comp", "rest")
    # of a candidate, the pivot is the shorter set; its shingle stands still earlier, as the other is no shorter
    first = posts.where((100 + percent) * F.col("rest") >= 2 * percent * F.col("n")).toDF("h", "pivot", "m", "comp2", "rest2")
    shorter = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("pivot") < F.col("id")))
    enough = (100 + percent) * F.least("rest", "rest2") >= percent * (F.col("n") + F.col("m"))
    edges = first.join(posts, "h").where(shorter & enough & _fits(F.col("m"), F.col("n"), percent) & (F.col("comp") != F.col("comp2")))
    return _probe(edges.select("pivot", "id").distinct(), sets, percent)


def _count(percent: int):
    """(id, n): links of each set in each block of a group; a block without side 1 meets itself."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, block in rows.groupby(["comp", *_CHUNKS]):
            own, other = block[block["side"] == 0], block[block["side"] == 1]
            alone = not len(other)
            met = [(side["id"].to_numpy(), side["n"].to_numpy().astype(np.int64), [np.frombuffer(x, U) for x in side["set"]]) for side in (own, own if alone else other)]
            (a, n, t), (b, m, p) = met
            hits = np.array(walk(t, n, p, m, percent), np.int64).reshape(-1, 2)
            if alone:  # each link is met from both of its ends
                hits = hits[hits[:, 0] != hits[:, 1]]
            else:
                ids.append(b)
                counts.append(np.bincount(hits[:, 1], minlength=len(b)))
            ids.append(a)
            counts.append(np.bincount(hits[:, 0], minlength=len(a)))
        found = pd.DataFrame({"id": np.concatenate(ids), "n": np.concatenate(counts)})
        return found[found["n"] > 0].groupby("id", as_index=False).sum()

    return run


def _degrees(sets: DataFrame, percent: int) -> DataFrame:
    """(id, n_links): links of each set; sets: (id, n, comp, set), every link inside one comp."""
    members = sets.groupBy("comp").agg(F.count("*").alias("members")).where("members > 1")
    # a component that fits one chunk is not cut by length
    band = F.when(F.col("members") <= CHUNK, 0).otherwise(F.floor(F.log(F.col("n").cast("double")) / math.log(1.1))).cast("int")
    placed = checkpointed(sets.join(members, "comp").withColumn("band", band))
    reach = math.ceil(math.log(100 / percent) / math.log(1.1)) + 1
    held = placed.groupBy("comp", "band").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = placed.join(held, ["comp", "band"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    dealt = dealt.select("comp", "band", "chunk", "id", "n", "set")
    chunks = dealt.groupBy("comp", "band", "chunk").agg(F.count("*").alias("rows"))
    other = chunks.toDF("comp", "band2", "chunk2", "rows2")
    alone = (F.col("band2") == F.col("band")) & (F.col("chunk2") == F.col("chunk"))
    later = (F.col("band2") > F.col("band")) | ((F.col("band2") == F.col("band")) & (F.col("chunk2") >= F.col("chunk")))
    pairs = checkpointed(chunks.join(other, "comp").where(later & (F.col("band2") - F.col("band") <= reach)).withColumn("alone", alone))
    rows = pairs.agg(F.sum(F.col("rows") + F.when(F.col("alone"), 0).otherwise(F.col("rows2")))).first()[0] or 0
    columns = ["comp", *_CHUNKS, "side", "id", "n", "set"]
    one = dealt.join(pairs, ["comp", "band", "chunk"]).withColumn("side", F.lit(0)).select(columns)
    two = dealt.withColumnsRenamed({"band": "band2", "chunk": "chunk2"}).join(pairs.where("not alone"), ["comp", "band2", "chunk2"]).withColumn("side", F.lit(1)).select(columns)
    met = one.unionByName(two).withColumn("g", F.pmod(F.xxhash64("comp", *_CHUNKS), F.lit(max(64, math.ceil(rows / 128)))))
    return checkpointed(met.groupBy("g").applyInPandas(_count(percent), "id long, n long")).groupBy("id").agg(F.sum("n").alias("n_links"))


def groups(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """(doc_id, key, n_shingles, class_id, component_id, n_links) of each row.

    class_id: the smallest id with an equal set; n_links: links of the class's set with other sets, every one counted
    (null if not ``count_links``); key: an xxhash64 of id and text, to join back on.
    """
    src = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    src = src.withColumn("key", F.xxhash64("doc_id", F.lit(1), "text"))
    size = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(16, math.ceil(size / 6 / BUCKET_POSTINGS))
    posted = src.mapInArrow(_filter_map(k, buckets), "bucket int, slice long, hashes binary, docs binary")
    counted = posted.groupBy("bucket").applyInPandas(_filter_bucket(buckets), "slice long, docs binary, counts binary")
    every = checkpointed(counted.groupBy("slice").applyInPandas(_filter_slice, _PER_DOC))
    likely = every.where(F.col("doc_id").isNotNull() & (F.col("n") > 0) & (100 * F.col("shared") >= percent * F.col("n")))
    classes = likely.groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "key")).alias("rep"))
    classes = checkpointed(classes.select("d1", "d2", "n", F.col("rep.doc_id").alias("class_id"), F.col("rep.key").alias("rep_key")))
    # classes are numbered by a hash, salted until no two share one
    n_classes, salt = classes.count(), 0
    node = F.xxhash64(F.lit(salt), "d1", "d2", "n")
    while classes.select(node).distinct().count() < n_classes:
        salt += 1
        node = F.xxhash64(F.lit(salt), "d1", "d2", "n")
    classes = classes.withColumn("node", node)
    wanted = classes.select(F.col("node").alias("id"), F.col("class_id").alias("doc_id"), F.col("rep_key").alias("key"))
    wanted = F.broadcast(wanted) if n_classes <= BROADCAST_ROWS else wanted

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in text_slices(batch["text"]):
                s = Words(data, offs, lower=True).shingles(k)
                yield pa.RecordBatch.from_arrays([batch["id"].slice(i, j - i), batch["doc"].slice(i, j - i), pa.array([len(x) for x in s], pa.int32()), pa.array([x.view("<i8")[np.argsort(x.view("<i8"))].tobytes() for x in s], pa.binary())], names=["id", "doc", "n", "set"])

    texts = src.join(wanted, ["doc_id", "key"]).select("id", F.col("doc_id").alias("doc"), "text")
    sets = checkpointed(texts.mapInArrow(to_sets, "id long, doc long, n int, set binary").dropDuplicates(["id"]))
    first = _star_links(sets, percent)
    met = components(first)
    with_comp = sets.join(met, "id", "left").select("id", "n", F.coalesce("component", "id").alias("comp"), "set")
    links = first.unionByName(_rest_links(with_comp, percent))
    joined = components(links)
    linked = checkpointed(joined.join(classes.select(F.col("node").alias("id"), "class_id"), "id"))
    roots = linked.groupBy("component").agg(F.min("class_id").alias("root"))
    roots = F.broadcast(roots) if roots.count() <= BROADCAST_ROWS else roots
    by_class = classes.join(linked.join(roots, "component").select(F.col("id").alias("node"), "root"), "node", "left")
    if count_links:
        degree = _degrees(sets.join(joined.withColumnRenamed("component", "comp"), "id"), percent).withColumnRenamed("id", "node")
        by_class = by_class.join(degree, "node", "left")
    else:
        by_class = by_class.withColumn("n_links", F.lit(None).cast("long"))
    by_class = by_class.select("d1", "d2", "n", "class_id", "root", "n_links")
    every = every.join(by_class, ["d1", "d2", "n"], "left").withColumn("mine", F.col("doc_id").isNotNull() & F.col("class_id").isNotNull())
    return every.select(
        "doc_id",
        "key",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("mine"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("mine"), F.coalesce("root", "class_id")).otherwise(F.col("doc_id")).alias("component_id"),
        (F.coalesce(F.when(F.col("mine"), F.col("n_links")), F.lit(0)) if count_links else F.col("n_links")).cast("long").alias("n_links"),
    )
