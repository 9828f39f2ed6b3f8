"""Toxicity: a linear-chain conditional random field tags toxic spans, its marginals score documents.

Labels come with documents, not tokens, so the tokens of the training sample are labelled
first: a token of a toxic document is toxic if its word, or a beginning of it, is found in
significantly more toxic than clean documents of the sample. The field has two states, features
of the word (itself, its beginnings and its ending) and transitions; it is trained by
gradient descent on its exact likelihood. Forward-backward marginals of a document's tokens are
aggregated (largest, sum, share), and a logistic regression on these, fitted to the sample's
document labels, gives the score. Marginals also give the offending offsets.

Training reads a bounded sample of labelled rows, at most ``max_rows``; what is broadcast is
the weights of features of that sample. Scoring reads every row, whole, and shuffles nothing.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshtide.llm.arrowtext import coded_words, slices, utf8

MAX_ROWS = 4_000
SEGMENT = 256
#: Log-likelihood ratio from which a feature marks tokens of toxic documents: seven of seven documents at a tenth toxic.
MARKS = 15.0
_EDGES = re.compile(r"[\W\d_]+")


def word_features(word: bytes) -> list[str]:
    """Features of a token: lower-cased letters as a whole, beginnings of three to seven, the last three."""
    w = _EDGES.sub("", word[:400].decode(errors="replace").lower()) if len(word) > 400 else _EDGES.sub("", word.decode().lower())
    return ["b", "w=" + w, *(f"p{k}={w[:k]}" for k in range(3, 8) if len(w) >= k), "s=" + w[-3:]]


class Chain:
    """Forward-backward over many two-state chains at once, chains cut into segments of SEGMENT tokens.

    Odds are carried over the cuts by running the segments again until none changes, so
    marginals are those of whole chains.
    """

    def __init__(self, first: np.ndarray):
        n = np.diff(first)
        count = -(-n // SEGMENT)
        row = np.repeat(np.arange(len(n)), count)
        order = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        self.begin = first[row] + order * SEGMENT
        self.length = np.minimum(SEGMENT, n[row] - order * SEGMENT)
        self.opens, self.closes = order == 0, order == count[row] - 1
        self.longest = int(self.length.max()) if len(row) else 0
        self.place = self.begin + np.minimum(np.arange(self.longest)[:, None], self.length - 1)
        self.valid = np.arange(self.longest)[:, None] < self.length
        self.n = int(first[-1])

    def odds(self, scores: np.ndarray, moves: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward odds of state 1 for each token."""
        if not len(self.begin):
            return np.zeros(self.n), np.zeros(self.n)
        e = np.exp(np.clip(scores, -30, 30))[self.place]
        (m00, m01), (m10, m11) = moves
        s = len(self.begin)
        fore, back = np.empty((self.longest, s)), np.empty((self.longest, s))
        last = (self.length - 1, np.arange(s))
        into = np.full(s, -1.0)  # odds of the token before; -1: none yet
        out = np.ones(s)
        for _ in range(s + 1):
            a = np.where(into < 0, start, (m01 + np.abs(into) * m11) / (m00 + np.abs(into) * m10))
            for t in range(self.longest):
                a = e[t] * (a if t == 0 else (m01 + a * m11) / (m00 + a * m10))
                fore[t] = a
            ends = fore[last]
            new = np.where(self.opens, -1.0, np.concatenate([[-1.0], ends[:-1]]))
            done = np.allclose(new, into, rtol=1e-12, atol=0)
            into = new
            if done:
                break
        for _ in range(s + 1):
            b = out
            for t in range(self.longest - 1, -1, -1):
                if t + 1 < self.longest:
                    x = e[t + 1] * back[t + 1]
                    b = np.where(self.valid[t + 1], (m10 + m11 * x) / (m00 + m01 * x), out)
                back[t] = b
            x = e[0] * back[0]
            new = np.where(self.closes, 1.0, np.append((m10 + m11 * x) / (m00 + m01 * x), 1.0)[1:]) if s else out
            done = np.allclose(new, out, rtol=1e-12, atol=0)
            out = new
            if done:
                break
        made = np.empty((2, self.n))
        made[0, self.place[self.valid]] = fore[self.valid]
        made[1, self.place[self.valid]] = back[self.valid]
        return made[0], made[1]


class Field:
    """The trained field and the regression on its marginals."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray, start: float, regression: np.ndarray):
        self.weights, self.moves, self.start, self.regression = weights, moves, start, regression
        #: whether there were labels of both kinds to learn from
        self.trained = bool(weights)
        self.known: dict[bytes, float] = {}

    def __getstate__(self):
        return {"trained": self.trained, "weights": self.weights, "moves": self.moves, "start": self.start, "regression": self.regression, "known": {}}

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > 150_000:
            self.known.clear()
        get = self.weights.get
        for w in words:
            if w not in self.known:
                self.known[w] = sum(get(f, 0.0) for f in word_features(w))
        return np.fromiter(map(self.known.__getitem__, words), float, len(words))

    def marginals(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        words, code, first, data, starts, ends = coded_words(column)
        a, b = Chain(first).odds(self.word_scores(words.to_pylist())[code] if len(code) else np.zeros(0), self.moves, self.start)
        return a * b / (1 + a * b), first, data, starts, ends

    def score(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        z = document_features(p, first) @ self.regression
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One, largest marginal, logarithm of their sum, square root of their share; a text without tokens has zeros."""
    n = np.diff(first)
    total = np.concatenate([[0], np.cumsum(p)])
    total = total[first[1:]] - total[first[:-1]]
    largest = np.zeros(len(n))
    some = n > 0
    if some.any():
        largest[some] = np.maximum.reduceat(p, first[:-1][some])
    return np.stack([np.ones(len(n)), largest, np.log1p(np.maximum(total, 0)), np.sqrt(np.maximum(total, 0) / np.maximum(n, 1))], 1)


def fit(texts: list[str | None], labels: np.ndarray, steps: int = 60) -> Field:
    """Train on documents and their labels (0 or 1). Without rows of both labels every score is the smoothed share of ones."""
    labels = np.asarray(labels, float)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    prior = np.array([np.log(share / (1 - share)), 0, 0, 0])
    words, code, first, *_ = coded_words(pa.array(texts, pa.string()))
    words = words.to_pylist()
    if not words or labels.min() == labels.max():  # no words: the same for any text
        return Field({}, np.ones((2, 2)), 1.0, prior)
    names: dict[str, int] = {}
    flat, sizes = array("i"), array("i")
    for w in words:
        own = word_features(w)
        flat.extend(names.setdefault(f, len(names)) for f in own)
        sizes.append(len(own))
    flat, sizes = np.frombuffer(flat, np.int32), np.frombuffer(sizes, np.int32)
    at = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(len(texts)), np.diff(first))

    # documents of either label that have a feature, equal texts once, some documents at a time
    seen: dict[str | None, int] = {}
    once = np.array([seen.setdefault(t, i) == i for i, t in enumerate(texts)])
    del seen
    held = np.zeros((2, len(names)), np.int32)
    for i in np.flatnonzero(once).tolist():
        own = np.unique(code[first[i] : first[i + 1]])
        size = sizes[own]
        own = np.unique(flat[np.repeat(at[own], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)])
        held[int(labels[i]), own] += 1
    zeros, ones = held.astype(float)
    base = (labels[once].sum() + 0.5) / (once.sum() + 1)
    rate = ones / np.maximum(ones + zeros, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(ones > 0, ones * np.log(rate / base), 0) + np.where(zeros > 0, zeros * np.log((1 - rate) / (1 - base)), 0)
    marks = (ratio >= MARKS) & (rate >= 0.95)
    of_word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    toxic_word = np.bincount(of_word, marks[flat], len(words)) > 0
    y = (toxic_word[code] & (labels[doc] > 0)).astype(float)

    # features of three documents and more are trained
    common = ones + zeros >= 3
    keep = common[flat]
    number = (np.cumsum(common) - 1).astype(np.int32)
    names = {k: int(number[i]) for k, i in names.items() if common[i]}
    flat, of_word = number[flat[keep]], of_word[keep]
    del at, sizes, held, ones, zeros, ratio, marks, number, keep, doc
    weight = np.zeros(max(1, len(names)))
    moves, start = np.zeros((2, 2)), 0.0
    if "b" in names:
        weight[names["b"]] = -3.0
    grown, grown_moves = np.full(len(weight), 1e-8), np.full((2, 2), 1e-8)
    chain = Chain(first)
    follows = np.ones(len(code), bool)
    follows[first[:-1][np.diff(first) > 0]] = False
    later = np.flatnonzero(follows)
    true_moves = np.array([[((y[later - 1] == i) & (y[later] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    for _ in range(steps):
        scores = np.bincount(of_word, weight[flat], len(words))[code]
        m = np.exp(moves)
        a, b = chain.odds(scores, m, np.exp(start))
        p = a * b / (1 + a * b)
        slope = np.bincount(flat, np.bincount(code, p - y, len(words))[of_word], len(weight)) + 0.05 * weight
        e = np.exp(np.clip(scores[later], -30, 30)) * b[later]
        before = a[later - 1]
        whole = m[0, 0] + m[0, 1] * e + before * (m[1, 0] + m[1, 1] * e)
        wanted = np.array([[(m[0, 0] / whole).sum(), (m[0, 1] * e / whole).sum()], [(m[1, 0] * before / whole).sum(), (m[1, 1] * before * e / whole).sum()]])
        slope_moves = wanted - true_moves + 0.05 * moves
        slope_moves[0, 0] = 0
        grown += slope**2
        grown_moves += slope_moves**2
        weight -= 0.7 * slope / np.sqrt(grown)
        moves -= 0.3 * slope_moves / np.sqrt(grown_moves)
    found = {k: float(weight[i]) for k, i in names.items() if abs(weight[i]) > 1e-3}
    field = Field(found, np.exp(moves), float(np.exp(start)), prior)
    x = document_features(field.marginals(pa.array(texts, pa.string()))[0], first)
    ridge = np.array([1e-3, 0.5, 0.5, 0.5])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(np.logaddexp(0, z).sum() - labels @ z + 0.5 * (ridge * b) @ b)

    beta = prior.copy()
    for _ in range(100):  # Newton's method, steps halved until they help
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (labels - p) - ridge * beta)
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(step).max() < 1e-9 or size <= 1e-6:
            break
    field.regression = beta
    return field


def fold(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Field:
    """Fit to at most max_rows labelled documents outside fold 0, those whose ids hash lowest.

    Null ids and null labels are no labelled rows; of several labels of an id the largest counts. Rows of
    docs that repeat an id and its text are learnt from as often as they stand there, but counted once
    where words are marked; ids that hash alike go by the id itself. Empty tables of docs or labels give a field that has
    learnt nothing (trained is false). Columns besides those named are not read.
    """
    chosen = labels.where((fold(F.col(id_col)) != 0) & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    chosen = chosen.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    # at most max_rows small rows, so the broadcast is bounded
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), "_id")
    sample = rows.orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text")).limit(max_rows).select("_text", "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, np.array(marks) > 0))], pa.binary())], ["field"])

    # one task trains on the bounded sample, where there is more memory than on the driver
    made = sample.coalesce(1).mapInArrow(run, "field binary").first()
    return pickle.loads(made["field"]) if made else fit([], np.zeros(0))


def score_documents(docs: DataFrame, field: Field, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with score (0 to 1), predicted (0 or 1) and spans, an array of (start, end, probability) in code points.

    A span is a run of tokens whose marginals reach the threshold; a token of exactly the threshold, or a
    score of 0.5, counts as reaching it. Null and empty texts have no tokens and get the score of a text
    without any. A text of any length is scored whole; it is held by one task. All columns of docs are kept; columns of
    docs named like an added one give way to it. Repeated rows are scored alike; an empty
    table gives an empty result.
    """
    added = ["score", "predicted", "spans"]
    base = docs.drop(*added)
    names = base.columns
    text_at = names.index(text_col)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            p, first, data, starts, ends = field.marginals(batch.column(text_at))
            score = field.score(p, first)
            hot = np.flatnonzero(p >= threshold)
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            if len(hot):
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                row = np.searchsorted(first, hot, "right") - 1
                row_at = points[utf8(batch.column(text_at))[1]]
                cuts = np.flatnonzero((np.diff(hot) != 1) | (np.diff(row) != 0)) + 1
                for own in np.split(np.arange(len(hot)), cuts):
                    r, i, j = row[own[0]], hot[own[0]], hot[own[-1]]
                    spans[r].append({"start": int(points[starts[i]] - row_at[r]), "end": int(points[ends[j]] - row_at[r]), "probability": float(p[hot[own]].max())})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, span_type)], [*names, *added])

    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in base.schema)
    return base.mapInArrow(run, kinds + ", score double, predicted int, spans array<struct<start: long, end: long, probability: double>>")


def drop_toxic(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns, of any names.

    Null and empty texts are judged as texts without words. Repeated rows go or stay together. A field that
    had no labels of both kinds to learn from rejects nothing. An empty table gives an empty result.
    """
    if not field.trained:
        return docs
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_at):
            p, first, *_ = field.marginals(batch.column(text_at))
            yield batch.filter(pa.array(field.score(p, first) < 0.5))

    return docs.mapInArrow(run, docs.schema)
