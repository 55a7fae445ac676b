"""Quality scores from random Fourier features of document statistics.

Sixteen statistics of a text are standardised and mapped to random Fourier features, which approximate a Gaussian
kernel.  Each partition of the training sample sums its part of the normal equations, one sum for each of ``FOLDS``
folds; the sums give ridge regression scores.  Isotonic regression (pool adjacent violators, equal scores pooled first)
turns scores into probabilities; it is fitted on scores that the other folds' sums give a row.

The fit sees a bounded sample of labelled rows outside the held-out fold; scoring is one pass without a shuffle over
whole texts, very long ones too.  Null and empty texts have statistics of 0 and get a score like any other.  Without any
training row every score is 0.  Repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.labelled import SAMPLE, held_out, training
from tessera.llm.textbatch import Words, checkpointed, pick, text_slices

FEATURES, WIDTH, RIDGE, PARTS, FOLDS = 256, 3.0, 1e-3, 8, 4
_KIND = np.zeros((256, 6))
for _k, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), map(ord, ".,;:!?"), map(ord, "#$%&*@^|~<>{}[]\\_=+/"), range(128, 256))):
    _KIND[list(_chars), _k] = 1
N_STATS = 16


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each document."""
    total = np.r_[np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=float)]
    return total[first[1:]] - total[first[:-1]]


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The statistics of each document of a slice."""
    w = Words(data, offs)
    size, n = np.maximum(1, np.diff(offs)).astype(float), np.maximum(1, w.counts).astype(float)
    out = np.zeros((w.n_docs, N_STATS))
    out[:, 0], out[:, 1] = np.log1p(w.counts), np.log1p(np.diff(offs))
    length = (w.ends - w.starts).astype(float)
    out[:, 2] = _sums(length, w.first) / n
    out[:, 3] = np.sqrt(np.maximum(0, _sums(length**2, w.first) / n - out[:, 2] ** 2))
    for k in range(6):
        out[:, 4 + k] = _sums(_KIND[data, k], offs) / size
    h = w.hashes
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    out[:, 10] = _sums(same, w.first) / n
    back = np.zeros(len(h))
    back[2:] = (h[2:] == h[:-2]) & (w.doc[2:] == w.doc[:-2])
    out[:, 11] = _sums(back, w.first) / n
    for d in range(w.n_docs):
        own = h[w.first[d] : w.first[d + 1]]
        out[d, 12] = len(np.unique(own)) / max(1, len(own))
    last = w.ends - 1
    stop = np.isin(data[last], np.frombuffer(b".!?", np.uint8)).astype(float) if len(last) else np.zeros(0)
    out[:, 13] = _sums(stop, w.first) / n
    out[:, 14] = _sums((data == 10).astype(float), offs) / n
    short = (length <= 3).astype(float)
    out[:, 15] = _sums(short, w.first) / n
    return out


class Model:
    """Random features, ridge weights and the steps of the calibration."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, features: int = FEATURES, width: float = WIDTH):
        rng = np.random.default_rng(0)
        self.mean, self.sd = mean, sd
        self.w, self.b = rng.normal(size=(N_STATS, features)) / width, rng.uniform(0, 2 * np.pi, features)
        self.weights, self.knots, self.levels = np.zeros(features + 1), np.zeros(1), np.zeros(1)

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.sd, -6, 6)
        return np.c_[np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones(len(stats))]

    def raw(self, stats: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Scores before calibration, rounded so that equal statistics have equal ones whatever stands beside them."""
        return np.round(self.features(stats) @ (self.weights if weights is None else weights), 9)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(knots, levels) of the non-decreasing step means of y along x; equal x are one step, in whatever order they come."""
    places, at = np.unique(x, return_inverse=True)
    rows, sums = np.bincount(at), np.bincount(at, y)
    blocks: list[list[float]] = []  # sum of y, rows, sum of x
    for a, b, n in zip(places, sums, rows):
        blocks.append([b, n, a * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + t]
    return np.array([t / n for _, n, t in blocks]), np.array([s / n for s, n, _ in blocks])


def fold(stats: bytes) -> int:
    """Equal texts are in one fold."""
    return zlib.crc32(stats) % FOLDS


def fit(train: DataFrame) -> Model | None:
    """A model from (text, y); None without rows."""

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in text_slices(batch["text"]):
                yield pa.RecordBatch.from_arrays([batch["y"].slice(i, j - i), pa.array([s.tobytes() for s in statistics(data, offs)], pa.binary())], names=["y", "stats"])

    rows = checkpointed(train.mapInArrow(stats, "y int, stats binary").repartition(PARTS))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(N_STATS), np.zeros(N_STATS)
        for batch in batches:
            x = np.frombuffer(b"".join(batch["stats"].to_pylist())).reshape(-1, N_STATS)
            n, s, q = n + len(x), s + x.sum(axis=0), q + (x**2).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"n": [n], "s": [s.tobytes()], "q": [q.tobytes()]})

    parts = rows.mapInArrow(moments, "n long, s binary, q binary").collect()  # PARTS rows
    n = sum(p["n"] for p in parts)
    if not n:
        return None
    mean = sum(np.frombuffer(p["s"]) for p in parts) / n
    sd = np.sqrt(np.maximum(sum(np.frombuffer(p["q"]) for p in parts) / n - mean**2, 1e-12)) + 1e-6
    model = Model(mean, sd)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(model.weights)
        a, b, n = np.zeros((FOLDS, d, d)), np.zeros((FOLDS, d)), np.zeros(FOLDS)
        for batch in batches:
            packed = batch["stats"].to_pylist()
            x, y, own = model.features(np.frombuffer(b"".join(packed)).reshape(-1, N_STATS)), batch["y"].to_numpy().astype(float), np.array(list(map(fold, packed)), int)
            for f in range(FOLDS):
                mine = own == f
                a[f], b[f], n[f] = a[f] + x[mine].T @ x[mine], b[f] + x[mine].T @ y[mine], n[f] + mine.sum()
        yield pa.RecordBatch.from_pydict({"a": [a.tobytes()], "b": [b.tobytes()], "n": [n.tobytes()]})

    parts = rows.mapInArrow(normal, "a binary, b binary, n binary").collect()  # PARTS sums of a fixed size
    d = len(model.weights)
    a, b, n = (sum(np.frombuffer(p[c]) for p in parts).reshape(FOLDS, *shape) for c, shape in (("a", (d, d)), ("b", (d,)), ("n", ())))
    ridge = lambda a, b, n: np.linalg.solve(a + RIDGE * max(1.0, n) * np.eye(d) / d, b)
    model.weights = ridge(a.sum(axis=0), b.sum(axis=0), n.sum())
    sample = rows.toPandas()  # at most labelled.SAMPLE rows of statistics
    x, own = np.frombuffer(b"".join(sample["stats"])).reshape(-1, N_STATS), np.array(list(map(fold, sample["stats"])))
    raw = np.zeros(len(x))
    for f in np.unique(own):  # the other folds' weights; all weights where there is no other row
        others = n.sum() - n[f]
        w = ridge(a.sum(axis=0) - a[f], b.sum(axis=0) - b[f], others) if others else model.weights
        raw[own == f] = model.raw(x[own == f], w)
    model.knots, model.levels = isotonic(raw, sample["y"].to_numpy(float))
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit(training(docs, labels, label, sample, id_col, text_col))
    src = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in text_slices(batch["text"]):
                p = model.score(statistics(data, offs)) if model else np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array(p)], names=["doc_id", "score"])

    scored = src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
