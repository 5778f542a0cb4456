"""Toxic spans by a linear-chain conditional random field (CRF).

Training tokens get labels from labelled documents: a token of a toxic
document is toxic if its word or one of its prefixes occurs in toxic documents
far more often than in others (likelihood ratio).  A two-state CRF with word
and prefix features learns from these tokens; forward-backward marginals give
each token's probability.  A document's marginals are summed up and turned
into a score by logistic regression on the training documents.

Model fitting uses a sample of labelled rows bounded by ``per_class`` and
``max_bytes``; scoring covers every word of every text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import pieces, text_buffers
from .wordhash import word_hashes, words

#: Labelled training rows per class, and the longest text (bytes) among them: the driver gathers at most 40 MB.
PER_CLASS, MAX_BYTES = 1000, 20_000
PREFIXES = range(3, 9)
MIN_DOCS, MIN_G, MIN_RATIO, FEATURE_G = 5, 20.0, 5.0, 3.0
CHUNK, STEPS, RATE, RIDGE = 64, 60, 0.3, 1e-3
SPAN = 0.5
OUTER = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())


def features(word: str) -> list[str]:
    """The word without case and outer punctuation, and its prefixes."""
    word = word.lower().strip(OUTER)
    return ["=" + word, *(word[:n] for n in PREFIXES if n <= len(word))] if len(word) > 1 else []


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    move: np.ndarray  # transition scores by state before and after
    final: np.ndarray  # weights of the document's features

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))


def _step(x: np.ndarray, to0: tuple[float, float], to1: tuple[float, float]) -> np.ndarray:
    """log((e^to1[0] + e^(x + to1[1])) / (e^to0[0] + e^(x + to0[1])))."""
    return np.logaddexp(to1[0], x + to1[1]) - np.logaddexp(to0[0], x + to0[1])


def marginals(emission: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of state 1 at each token, and the forward and backward parts; chain i is emission[first[i]:first[i + 1]]."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    begin, ending = first[:-1][order], length[order]
    ahead, back = emission.copy(), np.zeros(len(emission))
    steps = int(ending[0]) if len(ending) else 0
    live = np.searchsorted(-ending, -np.arange(steps), side="left")
    for t in range(1, steps):
        at = begin[: live[t]] + t
        ahead[at] += _step(ahead[at - 1], (move[0, 0], move[1, 0]), (move[0, 1], move[1, 1]))
    for t in range(steps - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        back[at] = _step(emission[at + 1] + back[at + 1], (move[0, 0], move[0, 1]), (move[1, 0], move[1, 1]))
    return ahead + back, ahead, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document: 1, log(1 + expected toxic words), the same per thousand words, the largest marginal."""
    n = np.diff(first)
    total = np.diff(np.concatenate([[0.0], np.cumsum(p)])[first])
    largest = np.zeros(len(n))
    some = np.flatnonzero(n)
    if len(some):
        largest[some] = np.maximum.reduceat(p, first[:-1][some])
    return np.stack([np.ones(len(n)), np.log1p(total), np.log1p(1000 * total / np.maximum(n, 1)), largest], axis=1)


def _tokens(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each token's number among the distinct words, these words, the documents' first tokens, and the tokens' places."""
    buf, offsets = text_buffers(column)
    starts, ends, first = words(buf, offsets)
    _, example, number = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    raw = buf.tobytes()
    return number, [raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in example], first, (buf, starts, ends)


def _g(a: int, b: int, na: int, nb: int) -> float:
    """Likelihood ratio of the counts a of na and b of nb against one common rate."""
    rate = (a + b) / (na + nb)
    return 2 * sum(x * math.log(x / (n * rate)) for x, n in ((a, na), (b, nb)) if x)


def fit(texts: pa.Array, toxic: np.ndarray, weight: np.ndarray) -> Model:
    """The model from training texts, their labels and the rows that each stands for."""
    number, vocabulary, first, _ = _tokens(texts)
    listed = [features(w) for w in vocabulary]
    counts = (Counter(), Counter())
    for i, label in enumerate(toxic.tolist()):
        seen: set[str] = set()
        for w in np.unique(number[first[i] : first[i + 1]]).tolist():
            seen.update(listed[w])
        counts[label].update(seen)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    kept, strong = {}, set()
    for f, b in counts[1].items():
        a = counts[0][f]
        if b < 2 or b / n1 <= a / n0 or (g := _g(b, a, n1, n0)) < FEATURE_G:
            continue
        kept[f] = len(kept)
        if b >= MIN_DOCS and g >= MIN_G and b / n1 >= MIN_RATIO * a / n0:
            strong.add(f)
    seeds = np.array([any(f in strong for f in fs) for fs in listed] or [False])
    pairs = [(w, kept[f]) for w, fs in enumerate(listed) for f in fs if f in kept]
    at_word, at_feature = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    doc = np.repeat(np.arange(len(toxic)), np.diff(first))
    label = seeds[number] & (toxic[doc] == 1) if len(number) else np.zeros(0, bool)

    # chains of at most CHUNK tokens: all that hold a feature, and every tenth of the others
    cuts = np.unique(np.concatenate([first, *(np.arange(a, b, CHUNK) for a, b in zip(first, first[1:], strict=False))]))
    known = np.zeros(len(vocabulary), bool)
    known[at_word] = True
    chains = [(a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if i % 10 == 0 or known[number[a:b]].any()]
    pick = np.concatenate([np.arange(a, b) for a, b in chains]) if chains else np.zeros(0, np.int64)
    edge = np.concatenate([[0], np.cumsum([b - a for a, b in chains])]).astype(np.int64)
    word, y = number[pick], label[pick].astype(float)
    inner = np.ones(len(pick), bool)
    inner[edge[:-1][: len(chains)]] = False
    inner = np.flatnonzero(inner)
    w, bias, move = np.zeros(len(kept)), -3.0, np.zeros((2, 2))
    squares = [np.zeros(len(kept)), 0.0, np.zeros((2, 2))]
    for _ in range(STEPS if len(pick) else 0):
        score = np.bincount(at_word, w[at_feature], len(vocabulary)) + bias
        odds, ahead, back = marginals(score[word], edge, move)
        p = _sigmoid(odds)
        error = y - p
        gw = np.bincount(at_feature, np.bincount(word, error, len(vocabulary))[at_word], len(kept)) - RIDGE * len(pick) / 1000 * w
        joint = np.zeros((len(inner), 2, 2))
        for i in (0, 1):
            for j in (0, 1):
                joint[:, i, j] = i * ahead[inner - 1] + move[i, j] + j * (score[word[inner]] + back[inner])
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        real = np.zeros((2, 2))
        np.add.at(real, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
        grads = [gw, float(error.sum()), real - joint.sum(axis=0)]
        for i, g in enumerate(grads):  # AdaGrad
            squares[i] = squares[i] + g * g
        w = w + RATE * gw / (np.sqrt(squares[0]) + 1e-9)
        bias += RATE * grads[1] / (math.sqrt(squares[1]) + 1e-9)
        move = move + RATE * grads[2] / (np.sqrt(squares[2]) + 1e-9)
    score = np.bincount(at_word, w[at_feature], len(vocabulary)) + bias
    odds, _, _ = marginals(score[number] if len(number) else np.zeros(0), first, move)
    x = summary(_sigmoid(odds), first)
    final = np.zeros(x.shape[1])
    final[0] = -2.0
    for _ in range(30 if toxic.any() else 0):  # Newton steps of the weighted logistic regression
        p = _sigmoid(x @ final)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(x.shape[1])
        final = final + np.clip(np.linalg.solve(h, x.T @ (weight * (toxic - p)) - 0.5 * final), -2, 2)
    return Model({f: float(w[i]) for f, i in kept.items() if abs(w[i]) > 1e-6}, float(bias), move, final)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on labelled rows (id, toxic): at most ``per_class`` of each class, those with the least id hashes."""
    known = labels.where("toxic is not null").groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic")).where("id is not null")
    totals = {bool(r.toxic): r.n for r in known.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    rank = F.xxhash64(F.col("id").cast("string"))
    chosen = None
    for value in (0, 1):
        part = known.where((F.col("toxic") == 1) == bool(value)).orderBy(rank, "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * per_class rows of two numbers: small enough to broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    rows = rows.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).orderBy("id").limit(2 * per_class)
    table = rows.toArrow()
    toxic = (np.array(table.column("toxic").to_pylist() or [], np.int64) == 1).astype(np.int64)
    share = np.array([totals.get(bool(v), 1) / max(1, min(per_class, totals.get(bool(v), 1))) for v in (0, 1)])
    return fit(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()), toxic, share[toxic] if len(toxic) else np.zeros(0))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row for each document: id, score, predicted, spans (first and end code point of each toxic run of words).

    Null and empty texts have no words; their score is that of a document
    without toxic words.  A model that was fitted without a toxic label scores
    every text below the threshold.  Rows given twice give two rows; other columns are
    ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.move, model.final))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            for part in pieces(batch, 1):
                number, vocabulary, first, (buf, starts, ends) = _tokens(part.column(1))
                emission = np.array([own.emission(w) for w in vocabulary] or [0.0])[number] if len(number) else np.zeros(0)
                odds, _, _ = marginals(emission, first, own.move)
                p = _sigmoid(odds)
                total = _sigmoid(summary(p, first) @ own.final)
                points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                _, offsets = text_buffers(part.column(1))
                spans = [[] for _ in range(part.num_rows)]
                hit = np.flatnonzero(p > SPAN)
                for i, d in zip(hit.tolist(), (np.searchsorted(first, hit, side="right") - 1).tolist(), strict=True):
                    a, b = int(points[starts[i]] - points[offsets[d]]), int(points[ends[i]] - points[offsets[d]])
                    if spans[d] and p[i - 1] > SPAN and i - 1 >= first[d]:
                        spans[d][-1]["end"] = b
                    else:
                        spans[d].append({"first": a, "end": b})
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.float64()), pa.array((total >= threshold).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))], ["id", "score", "predicted", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, score double, predicted int, spans array<struct<first: long, end: long>>"
    return rows.mapInArrow(score, schema).withColumnRenamed("id", id_col)
