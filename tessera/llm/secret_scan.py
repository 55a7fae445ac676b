"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are private key blocks, long tokens of key alphabets and values of credential assignments, whatever stands
before the credential's name.  What the forest rejects is searched once more for candidates inside it.  The forest sees
a candidate's length, character classes and transitions between them, entropy, how much of it dictionary words cover,
whether it stands in a path or address, and the words around it.  The dictionary is the plain words of a public
vocabulary file (``vocabulary``, a path; a short list without one).  The forest is trained on labelled findings: those
that ``labelled_findings`` makes from stated forms of real and false findings (a seeded table), or a table of your own
given to ``fit``.  All candidates of a slice of texts go down the trees together.

One pass without a shuffle over whole texts, in slices of bounded bytes; a very long text is scanned whole, in time that
grows with its length.  Null and empty texts have no candidates.  Overlapping candidates: the earlier start stays; a
private key block goes to its END line, or without one to the end of its base64 body.  Repeated rows are scanned row by
row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.textbatch import pick, text_slices

# Credential names, public token prefixes, and dictionary and context words.
NAMES = "password passwd pwd passphrase secret token apikey api_key api-key access_key auth_token client_secret private_key credential"
PREFIXES = "AKIA ASIA ghp_ gho_ ghs_ github_pat_ glpat- sk_live_ sk_test_ rk_live_ xoxb- xoxp- AIza npm_ SG."
FALSE_WORDS = "example sample test dummy placeholder changeme your null none redacted xxxx todo default foobar"
REAL_CONTEXT = "password passwd pwd secret token key api auth credential bearer login access private"
FALSE_CONTEXT = "commit sha md5 sha1 sha256 checksum hash digest uuid guid etag revision version build id example placeholder"
DICTIONARY = "the and for with this that from have your data user name page file home test main code time work info news image about service company product account server system public index search order report version release build commit hash change value string number example sample default password secret token key"

_NAME = rf"(?=[pPsSſtTaAcC])(?i:{'|'.join(map(re.escape, NAMES.split()))})"
_ASSIGN = _NAME + r"\\?+[\"'`]?+\s*+(?>:=|=>|={1,3}|:)\s*+\\?+[\"'`]?+"
_KNOWN = rf"(?P<known>(?:{'|'.join(map(re.escape, PREFIXES.split()))})[A-Za-z0-9_\-.]{{10,}})"
_REST = r"|(?P<jwt>\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{4,})|(?P<long>(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{20,}={0,2})"
_GAP = r"(?:\s|\\[nrt]|[\"'`,>#|*])*+"
_PEM = (
    r"(?P<pem>-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?:[^-]|-(?!----))*+-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    # no END line: header lines, base64 lines, and a last short one that has a digit or sign or a line of its own
    rf"|(?:{_GAP}(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[^\n]*+)*+(?:{_GAP}[A-Za-z0-9+/]{{16,}}+={{0,2}}+)++"
    rf"(?:{_GAP}(?=[A-Za-z]*[0-9+/=])[A-Za-z0-9+/]++={{0,2}}+|\s*\n[ \t]*[A-Za-z]{{1,64}}+(?=[ \t]*(?:[\r\n]|\Z)))?)?)"
)
_CANDIDATE = re.compile(rf"{_PEM}|{_KNOWN}|(?P<assigned>{_ASSIGN}(?P<value>[^\s\"'`,;]{{6,}})){_REST}")
#: Inside a rejected candidate; values end at the signs that join assignments, so the whole search is linear.
_INNER = re.compile(rf"{_KNOWN}|(?P<assigned>{_ASSIGN}(?P<value>[^\s\"'`,;&=:]{{6,}}={{0,2}})){_REST}")
#: A name at the end of another candidate, and what is assigned to it.
_NAME_LAST, _ASSIGNED = re.compile(rf"{_NAME}={{0,2}}\Z"), re.compile(rf"(?P<assigned>{_ASSIGN}(?P<value>[^\s\"'`,;]{{6,}}))")
KINDS = ("pem", "known", "assigned", "jwt", "long")
#: A text without any of these has no candidate; one cheap search saves most texts the full pattern.
_HINT = re.compile(rf"-----BEGIN|(?i:{'|'.join(map(re.escape, NAMES.split()))})|{'|'.join(map(re.escape, PREFIXES.split()))}|[A-Za-z0-9+/_\-]{{20}}")
AROUND = 40
TREES, DEPTH, LEAST_LEAF, CUTS = 30, 8, 3, 12


def _span(m: re.Match) -> tuple[str, int, int]:
    """(kind, start, end) of a candidate, in code points."""
    kind = next(k for k in KINDS if m.groupdict().get(k) is not None)
    return kind, *m.span("value" if kind == "assigned" else 0)


def _words(text: str) -> set[str]:
    return set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text).replace("_", " ").lower()))


_FALSE, _REAL_NEAR, _FALSE_NEAR = (frozenset(x.split()) for x in (FALSE_WORDS, REAL_CONTEXT, FALSE_CONTEXT))


LEAST_WORD, MOST_WORD = 4, 14


@functools.lru_cache(2)
def dictionary(vocabulary: str | None = None) -> frozenset[str]:
    """Words of four letters and more; of a vocabulary file, those tokens that begin a word and are plain letters."""
    if vocabulary is None:
        return frozenset(w for w in DICTIONARY.split() if len(w) >= LEAST_WORD)
    with open(vocabulary, "rb") as f:
        tokens = (base64.b64decode(line.split()[0]) for line in f if line.strip())
        return frozenset(t[1:].decode() for t in tokens if re.fullmatch(rb" [a-z]{%d,%d}" % (LEAST_WORD, MOST_WORD), t))


def covered(run: str, words: frozenset[str]) -> int:
    """Letters of a run that dictionary words cover, the longest word from each place first."""
    n, i = 0, 0
    while i <= len(run) - LEAST_WORD:
        k = next((k for k in range(min(MOST_WORD, len(run) - i), LEAST_WORD - 1, -1) if run[i : i + k] in words), 0)
        n, i = n + k, i + (k or 1)
    return n


def features(kind: str, value: str, before: str, after: str, words: frozenset[str] = dictionary()) -> list[float]:
    n = len(value)
    classes = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in value]
    shares = [classes.count(k) / n for k in range(4)]
    moves = sum(a != b for a, b in zip(classes, classes[1:])) / max(1, n - 1)
    counts = np.array([value.count(c) for c in set(value)]) / n
    low, near = value.lower(), _words(before)
    return [
        float(n), *shares, moves, float(-(counts * np.log2(counts)).sum()), sum(covered(run, words) for run in re.findall(r"[a-z]{4,}", low[:256])) / min(n, 256),
        float(value.count("/") + value.count(".") + value.count("\\")), float("://" in before[-12:] or before.endswith(("/", "."))),
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value))), float(n in (32, 40, 64) and shares[3] == 0),
        float(bool(re.search(r"[0-9a-f]{8}-[0-9a-f]{4}-", low))), float(any(w in low for w in _FALSE)),
        float(len(near & _REAL_NEAR)), float(len(near & _FALSE_NEAR)), float(len(_words(after) & _FALSE_NEAR)),
        float(KINDS.index(kind)), max(map(len, re.findall(r"(.)\1*", value)), default=0) / n,
    ]


def labelled_findings(n: int = 3000, seed: int = 0, vocabulary: str | None = None) -> list[tuple[str, str, str, str, int]]:
    """(kind, value, before, after, real) of n findings of stated forms, half of them real."""
    rng = np.random.default_rng(seed)
    some = lambda alphabet, k: "".join(rng.choice(list(alphabet), k))
    lower, upper, digits, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    words = sorted(dictionary(vocabulary))
    prose = lambda: " ".join(some(lower, rng.integers(2, 9)) for _ in range(6)) + " "
    names, prefixes = NAMES.split(), PREFIXES.split()
    out = []
    for i in range(n):
        name, before, after = str(rng.choice(names)), prose(), " " + prose()
        quote = str(rng.choice(["", '"', "'"]))
        assign = f"{before}{name}{rng.choice([' = ', '=', ': '])}{quote}"
        if i % 2:
            form = rng.integers(5)
            if form == 0:
                p = str(rng.choice(prefixes))
                row = ("known", p + some(upper + digits if p in ("AKIA", "ASIA") else lower + upper + digits, 16 if p in ("AKIA", "ASIA") else rng.integers(20, 40)), before if rng.random() < 0.7 else assign, after)
            elif form == 1:
                row = ("assigned", some(hexa, int(rng.choice([16, 18, 20, 24, 32, 40, 64]))), assign, quote + after)
            elif form == 2:
                row = ("assigned", some(lower + upper + digits + "!@#$%_-", rng.integers(10, 40)), assign, quote + after)
            elif form == 3:
                row = ("jwt", f"eyJ{some(lower + upper + digits, 30)}.{some(lower + upper + digits, 60)}.{some(lower + upper + digits + '_-', 40)}", before if rng.random() < 0.5 else assign, after)
            else:
                row = ("long", some(lower + upper + digits + "+/", rng.integers(32, 60)), f"{before}{rng.choice(['key', 'secret', 'bearer', 'token'])} ", after)
        else:
            form = rng.integers(7)
            if form == 0:
                row = ("assigned", "-".join(rng.choice(words, 2)) + str(rng.choice(["", "123", "example"])), assign, quote + after)
            elif form == 1:
                row = ("long", some(hexa, int(rng.choice([32, 40, 64]))), f"{before}{rng.choice(['commit', 'sha256', 'md5', 'checksum', 'etag', 'revision'])} ", after)
            elif form == 2:
                u = some(hexa, 32)
                row = ("long", f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}", before + str(rng.choice(["uuid ", "id ", ""])), after)
            elif form == 3:
                row = ("long", "/".join([*rng.choice(words, 4), some(digits, 2)]), before + str(rng.choice(["", "https://site.", "/"])), after)
            elif form == 4:
                row = ("assigned", str(rng.choice(["your_", "<", "${", "xxxx", "changeme_"])) + name + str(rng.choice(["_here", ">", "}", "xxxx"])), assign, quote + after)
            elif form == 5:
                row = ("long", "".join(w.capitalize() for w in rng.choice(words, 4)) + some(digits, 2), before, after)
            else:
                row = ("known" if rng.random() < 0.3 else "assigned", "AKIA" + "EXAMPLE" * 2 + some(digits, 2) if rng.random() < 0.5 else "test_" * 3 + some(digits, 3), assign, quote + after)
        out.append((*row, i % 2))
    return out


class Forest:
    """Trees of axis splits by Gini impurity, on bootstrap rows and a random subset of features at each split."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            self.trees.append(self._grow(x[rows], y[rows], depth, rng))
        self._flatten()

    def _grow(self, x, y, depth, rng):
        p = float(y.mean())
        if depth == 0 or p in (0.0, 1.0) or len(y) < 2 * LEAST_LEAF:
            return p
        best = (p * (1 - p) * len(y) - 1e-9, None, None)
        for f in rng.permutation(x.shape[1])[: max(1, int(np.sqrt(x.shape[1])) + 1)]:
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, CUTS))):
                left = x[:, f] <= cut
                n = left.sum()
                if LEAST_LEAF <= n <= len(y) - LEAST_LEAF:
                    a, b = y[left].mean(), y[~left].mean()
                    impurity = a * (1 - a) * n + b * (1 - b) * (len(y) - n)
                    if impurity < best[0]:
                        best = (impurity, f, cut)
        if best[1] is None:
            return p
        left = x[:, best[1]] <= best[2]
        return int(best[1]), float(best[2]), self._grow(x[left], y[left], depth - 1, rng), self._grow(x[~left], y[~left], depth - 1, rng)

    def _flatten(self) -> None:
        """The trees as arrays: feature (-1 in a leaf), cut or share, and the nodes at either side."""
        feature, cut, left, right, self.roots = [], [], [], [], []

        def add(node) -> int:
            at = len(feature)
            for column in (feature, cut, left, right):
                column.append(0)
            if isinstance(node, float):
                feature[at], cut[at], left[at], right[at] = -1, node, at, at
            else:
                feature[at], cut[at] = node[0], node[1]
                left[at], right[at] = add(node[2]), add(node[3])
            return at

        self.roots = np.array([add(t) for t in self.trees])
        self.feature, self.cut, self.left, self.right = np.array(feature), np.array(cut), np.array(left), np.array(right)

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        """The mean share of real findings in the leaves of each row."""
        if not rows:
            return np.zeros(0)
        x, node = np.array(rows), np.broadcast_to(self.roots, (len(rows), len(self.roots)))
        each = np.arange(len(x))[:, None]
        while (self.feature[node] >= 0).any():
            node = np.where(x[each, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
        return self.cut[node].mean(axis=1)

    def score(self, row: list[float]) -> float:
        return float(self.scores([row])[0])


@functools.lru_cache(2)
def own_forest(n: int = 3000, seed: int = 0, vocabulary: str | None = None) -> Forest:
    return fit(labelled_findings(n, seed, vocabulary), vocabulary)


def fit(findings: list[tuple[str, str, str, str, int]], vocabulary: str | None = None) -> Forest:
    """A forest from labelled findings (kind, value, text before, text after, 1 if real)."""
    words = dictionary(vocabulary)
    forest = Forest(np.array([features(*f[:4], words) for f in findings]), np.array([f[4] for f in findings], float))
    forest.words = words
    return forest


def _candidates(text: str) -> Iterator[tuple[str, int, int]]:
    m = _CANDIDATE.search(text) if _HINT.search(text) else None
    while m:
        kind, start, end = _span(m)
        yield kind, start, end
        at, name = m.end(), None if kind in ("pem", "assigned") else _NAME_LAST.search(text, start, end)
        m = name and _ASSIGNED.match(text, name.start()) or _CANDIDATE.search(text, at)


def find_all(texts: list[str | None], forest: Forest, threshold: float = 0.5) -> list[tuple[int, list[dict]]]:
    """(number of candidates, kept findings) of each text; all their candidates are scored together, then the inner ones."""
    words = getattr(forest, "words", dictionary())

    def judged(found: list[tuple[int, str, int, int]]) -> list[float]:
        rows = [features(kind, (t := texts[i])[a:b], t[max(0, a - AROUND) : a], t[b : b + AROUND], words) for i, kind, a, b in found if kind != "pem"]
        made = iter(forest.scores(rows) if hasattr(forest, "scores") else [forest.score(r) for r in rows])
        return [1.0 if kind == "pem" else float(next(made)) for _, kind, _, _ in found]

    outer = [(i, *c) for i, t in enumerate(texts) if t for c in _candidates(t)]
    scored = list(zip(outer, judged(outer)))
    inner = [(i, *_span(m)) for (i, kind, a, b), s in scored if s < threshold for m in _INNER.finditer(texts[i], a + (kind != "assigned"), b)]
    scored += zip(inner, judged(inner))
    n, kept = [0] * len(texts), [[] for _ in texts]
    for (i, kind, a, b), s in scored:
        n[i] += 1
        if s >= threshold:
            kept[i].append({"kind": kind, "start": a, "end": b, "score": s})
    return [(k, sorted(own, key=lambda f: f["start"])) for k, own in zip(n, kept)]


def find(text: str | None, forest: Forest, threshold: float = 0.5) -> tuple[int, list[dict]]:
    """(number of candidates, kept findings) of a text."""
    return find_all([text], forest, threshold)[0]


FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_candidates, n_secrets, findings) of every document; spans count code points."""
    src, forest = pick(docs, doc_id=id_col, text=text_col), forest or own_forest(vocabulary=vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, *_ in text_slices(batch["text"]):
                got = find_all(batch["text"].slice(i, j - i).to_pylist(), forest, threshold)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array([n for n, _ in got], pa.int64()), pa.array([len(k) for _, k in got], pa.int64()), pa.array([k for _, k in got], FINDINGS)], names=["doc_id", "n_candidates", "n_secrets", "findings"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_candidates long, n_secrets long, findings array<struct<kind:string,start:long,end:long,score:double>>")


def redact(docs: DataFrame, mark: str = "[SECRET]", forest: Forest | None = None, threshold: float = 0.5, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """docs, each kept finding of a text replaced by ``mark``; other columns, and texts without findings, as they were."""
    forest, at = forest or own_forest(vocabulary=vocabulary), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, *_ in text_slices(batch.column(at)):
                part = batch.slice(i, j - i)
                texts = part.column(at).to_pylist()
                for k, (_, kept) in enumerate(find_all(texts, forest, threshold)):
                    for f in reversed(kept):
                        texts[k] = texts[k][: f["start"]] + mark + texts[k][f["end"] :]
                columns = list(part.columns)
                columns[at] = pa.array(texts, part.column(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    flat = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])  # names may clash
    return flat.mapInArrow(run, flat.schema).toDF(*docs.columns)
