"""Toxicity by a classifier chain.

Categories are predicted one after the other.  Each has a linear (logistic) model over hashed word and character n-gram
shares of the whole text and over the probabilities of all categories before it.  In training those probabilities are
out-of-fold: a row's come from models that haven't seen the row, so that later models learn to trust earlier ones as
far as they deserve.  The last category decides.

The categories come from the label table: by default `CHAIN`, abuse in plain prose, abuse in junk, and toxic at all.
Models are fitted on the driver from a bounded sample of labelled rows (`rows` documents of any length, whose features
are loaded by batches).

Cases: null and empty texts have no features and get the biases; a category without positive or without negative
rows has the same constant probability in training and in scores; long texts are drawn and scored whole; labels that are null, or whose document is missing, teach nothing; rows may repeat;
`score` ignores columns besides doc_id and text, and `filter_clean` keeps them; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.llm.text_features import Scorer, draw, scorer
from skyweave.llm.util import lean

BITS, LOW, HIGH = 18, 3, 6
#: Category and its condition on the label table, in chain order.
CHAIN = (("abusive_prose", "toxic = 1 AND coalesce(quality, 1) = 1"), ("abusive_junk", "toxic = 1 AND coalesce(quality, 1) = 0"), ("toxic", "toxic = 1"))


class Chain:
    """Weights over features (features, categories), over earlier logits (categories, categories), and biases."""

    def __init__(self, names: tuple[str, ...]):
        self.names = names
        self.weights = np.zeros((1 << BITS, len(names)), np.float32)
        self.links = np.zeros((len(names), len(names)))
        self.bias = np.zeros(len(names))

    def predict(self, linear: np.ndarray) -> np.ndarray:
        """Probabilities from the texts' linear parts, category by category."""
        out = np.zeros_like(linear)
        for k in range(len(self.names)):
            x = linear[:, k] + self.bias[k] + logit(out[:, :k]) @ self.links[:k, k]
            out[:, k] = 1 / (1 + np.exp(-np.clip(x, -500, 500)))
        return out


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.01, 0.99)
    return np.log(p / (1 - p))


def chosen(sums: np.ndarray, squares: np.ndarray, counts: np.ndarray, most: int = 300) -> np.ndarray:
    """Features whose mean share differs most between the classes, in units of its spread. sums, counts: by class; squares: of all."""
    gap = np.abs(sums[1] / max(1, counts[1]) - sums[0] / max(1, counts[0]))
    worth = gap / np.sqrt(squares / max(1, counts.sum()) + 1e-12)
    worth[squares == 0] = 0
    best = np.argpartition(-worth, most)[:most]
    return best[worth[best] > 0]


def chosen_by_fold(texts, y: np.ndarray, fold: np.ndarray, folds: int) -> list[list[np.ndarray]]:
    """chosen() for each category, of all texts and then without each fold, by one pass over the texts."""
    n, rows = 1 << BITS, np.arange(len(y))
    sums, squares = np.zeros((y.shape[1], folds, 2, n), np.float32), np.zeros((folds, n), np.float32)
    for i in rows.tolist():
        ids, share = texts[i]
        f = fold[i]
        squares[f, ids] += share**2
        for k in range(y.shape[1]):
            sums[k, f, y[i, k], ids] += share
    out = []
    for k in range(y.shape[1]):
        own = []
        for left in (None, *range(folds)):
            keep = np.array([f != left for f in range(folds)])
            some = keep[fold]
            own.append(chosen(sums[k][keep].sum(0, dtype=np.float64), squares[keep].sum(0, dtype=np.float64), np.bincount(y[some, k], minlength=2)))
        out.append(own)
    return out


def logistic(texts, which: np.ndarray, pick: np.ndarray, extra: np.ndarray, y: np.ndarray, epochs: int = 30, rate: float = 0.5, decay: float = 1e-3):
    """Weights by feature, weights of the extra columns, bias: AdaGrad on the logistic loss over a dense matrix of the picked features of texts[which]."""
    weights = np.zeros(1 << BITS)
    share = y.mean() if len(y) else 0.0
    if not 0 < share < 1:
        p = min(max(share, 1e-4), 1 - 1e-4)
        return weights, np.zeros(extra.shape[1]), math.log(p / (1 - p))
    place = np.full(1 << BITS, -1)
    place[pick] = np.arange(len(pick))
    x = np.zeros((len(which), len(pick)), np.float32)
    for k, i in enumerate(which.tolist()):
        ids, part = texts[i]
        at = place[ids]
        x[k, at[at >= 0]] = part[at >= 0]
    scale = 1 / (np.sqrt((x**2).mean(0)) + 1e-9)
    x = np.minimum(x * scale, 30)
    x = np.concatenate([x, extra.astype(np.float32)], 1)
    w, b, seen, seen_b = np.zeros(x.shape[1], np.float32), math.log(share / (1 - share)), np.full(x.shape[1], 1e-6, np.float32), 1e-6
    rng = np.random.default_rng(2)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            p = 1 / (1 + np.exp(-np.clip(x[rows] @ w + b, -50, 50)))
            g = (p - y[rows]) @ x[rows] / len(rows) + decay * w
            seen += g * g
            w -= (rate * 0.1) * g / np.sqrt(seen)
            gb = float((p - y[rows]).mean())
            seen_b += gb * gb
            b -= rate * 0.1 * gb / math.sqrt(seen_b)
    weights[pick] = w[: len(pick)] * scale
    return weights, w[len(pick) :].astype(float), b


def train(sample: list[tuple], names: tuple[str, ...], folds: int = 4) -> Chain:
    """sample: (sparse() of a text, 0/1 for each category)."""
    return trained([x for x, *_ in sample], [r[1:] for r in sample], names, folds)


def trained(texts, labels: list[tuple], names: tuple[str, ...], folds: int = 4) -> Chain:
    """Two passes over the texts: one to choose features for all models, one to take these along."""
    chain, rows = Chain(names), len(labels)
    y = np.array(labels, np.int64).reshape(rows, len(names))
    fold = np.arange(rows) % folds
    picks = chosen_by_fold(texts, y, fold, folds)
    wanted = np.zeros(1 << BITS, bool)
    for own in picks:
        for pick in own:
            wanted[pick] = True
    texts = [(ids[wanted[ids]], share[wanted[ids]]) for ids, share in (texts[i] for i in range(rows))]
    before = np.zeros((rows, 0))
    for k in range(len(names)):
        w, link, b = logistic(texts, np.arange(rows), picks[k][0], before, y[:, k])
        out = np.full(rows, 1 / (1 + math.exp(-b)))  # of a constant category
        constant = not 0 < y[:, k].sum() < rows
        for f in range(folds if not constant and k + 1 < len(names) else 0):
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            part, own, base = logistic(texts, inside, picks[k][1 + f], before[inside], y[inside, k])
            for i in outside.tolist():
                ids, shares = texts[i]
                x = part[ids] @ shares + before[i] @ own + base
                out[i] = 1 / (1 + math.exp(-min(500, max(-500, x))))
        chain.weights[:, k], chain.links[:k, k], chain.bias[k] = w, link, b
        before = np.concatenate([before, logit(out)[:, None]], 1)
    return chain


def words(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def fit(docs: DataFrame, labels: DataFrame, chain: tuple = CHAIN, rows: int = 4000) -> Chain:
    """A chain from at most `rows` labelled rows."""
    names = tuple(n for n, _ in chain)
    known = labels.where("toxic IS NOT NULL").select("doc_id", *[F.expr(f"CAST({c} AS INT)").alias(n) for n, c in chain])
    texts, y = draw(docs, known, list(names), rows, words, BITS, LOW, HIGH)
    texts.limit = 0  # two passes: nothing need stay
    model = trained(texts, y, names)
    lean()
    return model


def probabilities(chain: Chain, scores: Scorer, texts) -> np.ndarray:
    return chain.predict(scores.batch(map(words, texts)))


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_<category> for each category, toxic (the last reaches the threshold): one row for each input row."""
    sent, key = docs.sparkSession.sparkContext.broadcast(chain), uuid.uuid4().int
    names = chain.names

    def work(batches):
        own = sent.value
        scores = scorer(key, own.weights, BITS, LOW, HIGH)
        for b in batches:
            p = probabilities(own, scores, (x.as_py() for x in b["raw"]))
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(p[:, k]) for k in range(len(names))), pa.array(p[:, -1] >= threshold)], names=["doc_id", *(f"p_{n}" for n in names), "toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    return rows.mapInArrow(work, "doc_id long, " + "".join(f"p_{n} double, " for n in names) + "toxic boolean")


def filter_clean(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that aren't toxic, with their columns."""
    sent, key = docs.sparkSession.sparkContext.broadcast(chain), uuid.uuid4().int

    def work(batches):
        own = sent.value
        scores = scorer(key, own.weights, BITS, LOW, HIGH)
        for b in batches:
            p = probabilities(own, scores, ((x.as_py() or "").encode() for x in b["text"]))
            yield b.filter(pa.array(p[:, -1] < threshold))

    return docs.mapInArrow(work, docs.schema)
