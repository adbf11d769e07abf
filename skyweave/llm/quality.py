"""Quality classifier of supervised subword embeddings.

Every word and every 3- to 6-gram of its characters hashes to a learned vector, as does the mark that a word repeats the one
before; a text is the average of its vectors, and a softmax layer on the average gives the classes.  The vectors and
the layer are trained by stochastic gradient descent in numpy, on the driver, from a bounded sample of labelled rows
(`rows` documents of any length, whose features are loaded by batches).
As the output is linear in the average, scoring folds vectors and layer into one number per feature, and every task
keeps the sums of the words that it has met.

Cases: null and empty texts score as the layer's bias says; rows may repeat; labels that are null, or whose document
is missing, teach nothing; without a label, or with one class only, the score is the share of label 1 (0.5 without
any); long texts are drawn and scored whole; columns besides doc_id and text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.llm.text_features import draw, order, scorer
from skyweave.llm.util import lean

BITS, LOW, HIGH = 18, 3, 6


class Model:
    """Folded weights per feature, and the bias, of label 1 against label 0."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias


def train(sample: list[tuple], **options) -> Model:
    """sample: (sparse() of a text, 0 or 1)."""
    return trained([x for x, _ in sample], [y for _, y in sample], **options)


def trained(texts, y: list[int], dims: int = 8, epochs: int = 6, rate: float = 40.0, seed: int = 1) -> Model:
    """The folded model of sgd(); a constant one where the sample has one class."""
    share = sum(y) / len(y) if y else 0.5
    if share in (0.0, 1.0) or not y:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros((1 << BITS, 1), np.float32), math.log(p / (1 - p)))
    vectors, layer, bias = sgd(texts, y, dims, epochs, rate, seed)
    return Model((vectors @ (layer[1] - layer[0]))[:, None].astype(np.float32), float(bias[1] - bias[0]))


def sgd(texts, y: list[int], dims: int = 8, epochs: int = 6, rate: float = 40.0, seed: int = 1) -> tuple:
    """Vectors, layer and bias of a softmax regression on averaged feature vectors, one text at a time, with a falling rate."""
    share, rng = sum(y) / len(y), np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dims, 1 / dims, (1 << BITS, dims))
    layer, bias = rng.normal(0, 0.5, (2, dims)), np.array([math.log(1 - share), math.log(share)])
    steps, done = epochs * len(texts), 0
    for _ in range(epochs):
        for k in order(texts, rng):
            ids, weight = texts[k]
            mean = weight @ vectors[ids]
            out = layer @ mean + bias
            p = np.exp(out - out.max())
            p /= p.sum()
            p[y[k]] -= 1  # now the gradient of the loss
            now = rate * (1 - done / steps)
            back = layer.T @ p
            layer -= 0.02 * now * np.outer(p, mean)
            bias -= 0.0005 * now * p
            vectors[ids] -= now * weight[:, None] * back
            done += 1
    return vectors, layer, bias


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def words(raw: bytes) -> list[bytes]:
    return raw.split()


def fit(docs: DataFrame, labels: DataFrame, rows: int = 4000) -> Model:
    """A model from at most `rows` labelled rows that aren't held out."""
    known = labels.where(~held_out(F.col("doc_id"))).select("doc_id", (F.col("quality") == 1).cast("int").alias("y"))
    texts, y = draw(docs, known, ["y"], rows, words, BITS, LOW, HIGH)
    model = trained(texts, [k for (k,) in y])
    lean()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, label 1): one row for each input row."""
    sent, key = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias)), uuid.uuid4().int

    def work(batches):
        weights, bias = sent.value
        own = scorer(key, weights, BITS, LOW, HIGH)
        for b in batches:
            x = own.batch(raw.as_py().split() for raw in b["raw"])[:, 0] + bias
            p = 1 / (1 + np.exp(-np.clip(x, -500, 500)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(p)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    return rows.mapInArrow(work, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, rows))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
