"""Toxicity by weak supervision.

1. Lexicon: words and 4 or 5-letter word beginnings whose share of toxic documents is certainly high among the labelled
   training rows.
2. Voters: every lexicon entry, and patterns over a whole document (several entries, their density, shouting, insults with
   exclamation marks).
3. Label model: a two-class generative model of the voters, fitted by EM.  It estimates each voter's rate of firing in
   either class and the correlations between voters within a class; the evidence of a voter is divided by the sum of its
   absolute correlations, so a clique of voters that fire together counts about once.  Rows with and without a label are
   modelled together: a label is one more voter, which abstains where there is none, and whose rates of saying toxic in
   either class are estimated like those of the others (from a prior of ``LABEL_ACCURACY`` worth ``LABEL_ROWS`` rows).
4. A linear classifier (ridge-penalised logistic regression) learns the posterior labels of all these rows from voters
   and densities.

Everything is fitted on a bounded sample outside the held-out fold: at most ``sample`` labelled rows and as many
unlabelled ones; lexicon counts are taken by Spark over it.  Scoring is one pass without a shuffle over whole texts, in
slices of bounded bytes; a very long text is a slice of its own.  Null and empty texts get the score of a document
without words.  Without any training row of both classes every score is the share of toxic rows, or 0.  Repeated rows
get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.labelled import SAMPLE, held_out, training
from tessera.llm.textbatch import pick, release, text_slices

WORD = re.compile(r"[^\W\d_]+")
LEXICON, LEAST_DOCS, BEGINNINGS, ROUNDS, LABEL_ACCURACY, LABEL_ROWS, PENALTY = 256, 3, (4, 5), 15, 0.9, 200, 1e-3
#: Words whose places a task keeps, about 12 MB of them, and the places of a word in no entry.
MEMO, NO_HITS = 100_000, ()
#: Rows of a step of the fit.
STEP = 4096
PATTERNS = ("hits_1", "hits_2", "hits_3", "dense", "shouting", "bangs")


def terms(text: str) -> set[str]:
    """Distinct lower-case words, and marked beginnings of those longer than a beginning."""
    words = set(WORD.findall(text.lower()))
    return words.union(*({f"^{w[:k]}" for w in words if len(w) > k} for k in BEGINNINGS))


def lexicon(train: DataFrame, size: int = LEXICON) -> list[str]:
    """Terms by the lower bound of their log odds of standing in a toxic rather than a clean document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, toxic = Counter(), Counter()
            for i, j, *_ in text_slices(batch["text"]):
                for text, y in zip(batch["text"].slice(i, j - i).to_pylist(), batch["y"].slice(i, j - i).to_pylist()):
                    own = terms(text)
                    seen.update(own)
                    if y:
                        toxic.update(own)
            yield pa.RecordBatch.from_pydict({"term": list(seen), "n": list(seen.values()), "pos": [toxic[t] for t in seen]})

    train = train.where("y is not null")
    n, pos = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    counts = train.mapInArrow(count, "term string, n long, pos long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    a, b = F.col("pos") + 0.5, F.col("n") - F.col("pos") + 0.5
    odds = F.log(a / (pos + 1)) - F.log(b / (n - pos + 1)) - 1.64 * F.sqrt(1 / a + 1 / b)
    top = counts.where(F.col("pos") >= LEAST_DOCS).select("term", odds.alias("odds")).where("odds > 0.7").orderBy(F.desc("odds"), "term").limit(size)
    return [r["term"] for r in top.collect()]


def signals(texts: list[str], at: dict[str, int], known: dict[str, tuple[int, ...]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(voters, densities) of each text; voters: 0 or 1 for each lexicon entry, then for each pattern.

    known: places of words seen before, kept by the caller and emptied here when it is full.
    """
    known = {} if known is None else known
    votes, dense = np.zeros((len(texts), len(at) + len(PATTERNS)), np.uint8), np.zeros((len(texts), 4))
    for i, t in enumerate(texts):
        words = WORD.findall(t.lower())
        n_hits, kinds = 0, set()
        for w in words:
            if (own := known.get(w)) is None:
                own = [at[t] for t in (w, *(f"^{w[:k]}" for k in BEGINNINGS if len(w) > k)) if t in at]
                if len(known) >= MEMO:
                    known.clear()
                known[w] = own = tuple(own) or NO_HITS
            if own:
                n_hits += 1
                kinds.add(w)
                votes[i, list(own)] = 1
        n = max(1, len(words))
        upper = sum(map(str.isupper, t)) / max(1, len(t)) if n_hits else 0.0
        share = n_hits / n
        votes[i, len(at) :] = (n_hits >= 1, n_hits >= 2, n_hits >= 3, share >= 0.005, upper > 0.3, n_hits > 0 and t.count("!") > 3)
        dense[i] = (np.log1p(n_hits), np.log1p(len(kinds)), np.log1p(1000 * share), n_hits > 0)
    return votes, dense


def posterior(votes: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, accuracy: float = LABEL_ACCURACY) -> np.ndarray:
    """The label model's probability of class 1 for each row; y: its label, or nan where it has none.

    The first round learns the voters from labelled rows alone; the others from all rows.
    """
    x, labelled, told = votes.astype(np.float32), ~np.isnan(y), np.nan_to_num(y)
    p, weight = np.where(told == 1, accuracy, 1 - accuracy), labelled.astype(float)
    # sums of products of votes, of labelled rows and of all: no other table of rows by voters is made
    pairs = {True: (x[labelled].T @ x[labelled]).astype(float), False: (x.T @ x).astype(float)}
    outer = np.multiply.outer
    for first in [True, *[False] * (rounds - 1)]:
        one, zero, n = p * weight, (1 - p) * weight, weight.sum()
        prior = np.clip(one.sum() / n, 1e-3, 1 - 1e-3)
        in1, in0 = (one.astype(np.float32) @ x).astype(float), (zero.astype(np.float32) @ x).astype(float)
        fire1, fire0 = (in1 + 0.5) / (one.sum() + 1), (in0 + 0.5) / (zero.sum() + 1)
        # the label's rates of saying 1 in either class
        says1 = (one[labelled] @ told[labelled] + accuracy * LABEL_ROWS) / (one[labelled].sum() + LABEL_ROWS)
        says0 = (zero[labelled] @ told[labelled] + (1 - accuracy) * LABEL_ROWS) / (zero[labelled].sum() + LABEL_ROWS)
        label = np.where(labelled, np.where(told == 1, np.log(says1 / says0), np.log((1 - says1) / (1 - says0))), 0.0)
        # covariance of the votes around what their row's classes expect
        cross = outer(in1, fire1) + outer(in0, fire0)
        mixed = outer(fire1, fire0)
        cov = (pairs[first] - cross - cross.T + (one @ p) * outer(fire1, fire1) + (one @ (1 - p)) * (mixed + mixed.T) + (zero @ (1 - p)) * outer(fire0, fire0)) / n
        sd = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-9
        together = np.abs(cov / sd[:, None] / sd[None, :])
        own = np.where(together > 0.05, together, 0).sum(axis=1).clip(1)
        fired, silent = np.log(fire1 / fire0) / own, np.log((1 - fire1) / (1 - fire0)) / own
        z = np.log(prior / (1 - prior)) + x @ (fired - silent).astype(np.float32) + silent.sum() + label
        p, weight = 1 / (1 + np.exp(-np.clip(z, -30, 30))), np.ones(len(x))
    return p


def logistic(x: np.ndarray, p: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Weights, the last of them the intercept, by Newton's method."""
    width = x.shape[1] + 1
    w, ridge = np.zeros(width), np.diag(np.r_[np.full(width - 1, penalty * len(x)), 1e-6])
    for _ in range(25):
        hessian, slope = ridge.copy(), -ridge @ w
        for at in range(0, len(x), STEP):
            part = np.c_[x[at : at + STEP], np.ones(len(x[at : at + STEP]))].astype(float)
            q = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            hessian += (part * (q * (1 - q) + 1e-9)[:, None]).T @ part
            slope += part.T @ (p[at : at + STEP] - q)
        step = np.linalg.solve(hessian, slope)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(train: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """(lexicon with places, weights) from (text, y)."""
    at = {t: i for i, t in enumerate(lexicon(train))}
    width = len(at) + len(PATTERNS)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, j in ((b, i, j) for b in batches for i, j, *_ in text_slices(b["text"])):
            votes, dense = signals(batch["text"].slice(i, j - i).to_pylist(), at)
            yield pa.RecordBatch.from_arrays([batch["y"].slice(i, j - i), pa.array([v.tobytes() for v in votes], pa.binary()), pa.array([d.tobytes() for d in dense], pa.binary())], names=["y", "votes", "dense"])

    rows = train.mapInArrow(collect, "y int, votes binary, dense binary").toPandas()  # at most twice labelled.SAMPLE small rows
    y = rows["y"].to_numpy(float)
    known = y[~np.isnan(y)]
    if not len(known) or known.min() == known.max():
        share = np.clip(known.mean() if len(known) else 0.0, 1e-6, 1 - 1e-6)
        return at, np.r_[np.zeros(width + 4), np.log(share / (1 - share))]
    votes = np.frombuffer(b"".join(rows["votes"]), np.uint8).reshape(-1, width)
    dense = np.frombuffer(b"".join(rows["dense"])).reshape(-1, 4)
    return at, logistic(np.c_[votes.astype(np.float32), dense.astype(np.float32)], posterior(votes, y))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", carry: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; with ``carry`` all columns of docs, then score and predicted."""
    at, w = fit(training(docs, labels, label, sample, id_col, text_col, unlabelled=sample))
    column = docs.columns.index(text_col) if carry else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for i, j, *_ in text_slices(batch.column(column)):
                part = batch.slice(i, j - i)
                votes, dense = signals([t or "" for t in part.column(column).to_pylist()], at, known)
                p = 1 / (1 + np.exp(-np.clip(np.c_[votes, dense] @ w[:-1] + w[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=[*part.schema.names, "score"]) if carry else pa.RecordBatch.from_arrays([part["doc_id"], pa.array(p)], names=["doc_id", "score"])
        known.clear()
        release()

    if carry:
        flat = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])  # names may clash
        scored = flat.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema) + ", score double")
        return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).toDF(*docs.columns, "score", "predicted")
    src = pick(docs, doc_id=id_col, text=text_col)
    scored = src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
