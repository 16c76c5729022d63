"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1, not held out) and unlabelled web text fit a small
network under the non-negative risk estimator (Kiryo et al., 2017):
prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)]), with
logistic loss, so the sigmoid of the output estimates the chance of label 1.
The class prior is estimated from positives and unlabelled texts alone, by the
best bin of Garg et al. (2021): where a ranking of one against the other puts
the purest top, the share of all unlabelled texts there over the share of all
positives there. Labels of 0 are never read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gustline.llm.common import by_text, give_back, held_out, id_and_text, in_arrow, in_bytes, labelled, ship_package
from gustline.llm.quality_rules import measure

N_FEATURES = 16
_OUT = "doc_id long, score double"


def features(text: str) -> list[float]:
    """Shape of a text, not its vocabulary: the same measures mean the same in every language."""
    n, word_chars, symbols, dups, repeats, uppers, pipes = measure(text)
    if not n:
        return [0.0] * N_FEATURES
    raw = text.encode("utf-8", "surrogatepass").split()
    kinds = Counter(raw)
    lines = text.count("\n") + 1
    bangs = text.count("!")
    stops = text.count(".") + text.count(",")
    marked = sum(w[-1:] in b"#*$%&|<>!" for w in raw)
    most = max(kinds.values())
    pairs = sum(a == b for a, b in zip(raw, raw[1:]))
    return [
        math.log1p(n), word_chars / n, symbols / n, min(1.0, dups / lines), repeats / n, uppers / n, pipes / n,
        math.log(len(kinds) + 1) / math.log(n + 1), min(1.0, bangs / n), stops / n, marked / n, most / n, pairs / n, math.log1p(n / lines),
        math.log1p(dups), float(n < 30),
    ]


class Model:
    """Standardised features -> one hidden layer -> a score between 0 and 1."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: list[np.ndarray], prior: float):
        self.mean, self.spread, self.weights, self.prior = mean, spread, weights, prior

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def raw(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(self._scaled(x) @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, epochs: int = 60, batch: int = 512, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Minimise the non-negative unbiased risk with Adam; where the bracket turns negative, step back up instead."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, spread = both.mean(0), np.maximum(both.std(0), 1e-3)
    model = Model(mean, spread, [rng.normal(0, 1 / math.sqrt(N_FEATURES), (N_FEATURES, hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), hidden), np.zeros(1)], prior)
    p, u = model._scaled(positive), model._scaled(unlabelled)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in model.weights]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    step = 0
    rounds = max(200, epochs * max(1, len(u) // batch))
    for _ in range(rounds):
        step += 1
        xp, xu = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
        x = np.concatenate([xp, xu])
        w1, b1, w2, b2 = model.weights
        h = np.tanh(x @ w1 + b1)
        g = h @ w2 + b2
        gp, gu = g[:batch], g[batch:]
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        d = np.zeros_like(g)
        if negative >= 0:
            d[:batch] = prior * (sigmoid(gp) - 1) / batch - prior * sigmoid(gp) / batch
            d[batch:] = sigmoid(gu) / batch
        else:
            d[:batch] = prior * sigmoid(gp) / batch
            d[batch:] = -sigmoid(gu) / batch
        back = np.outer(d, w2) * (1 - h * h)
        grads = [x.T @ back + decay * w1, back.sum(0), h.T @ d + decay * w2, np.array([d.sum()])]
        lr = rate * min(1.0, 2 * (1 - step / (rounds + 1)))
        for k, grad in enumerate(grads):
            m, v = moments[k]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            model.weights[k] = model.weights[k] - lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def _rank_weights(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    """A logistic ranking of positives against unlabelled rows, the constant last."""
    x, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.eye(len(w)), x.T @ (y - p) - w)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, slack: float = 0.01, risk: float = 0.1) -> float:
    """The share of positives among the unlabelled rows; each half is ranked by what the other half taught."""
    both = np.concatenate([positive, unlabelled])
    mean, spread = both.mean(0), np.maximum(both.std(0), 1e-3)
    p, u = (np.clip((x - mean) / spread, -6, 6) for x in (positive, unlabelled))
    if min(len(p), len(u)) < 4:
        return 0.5
    found = []
    for i in (0, 1):
        x = np.concatenate([p[i::2], u[i::2]])
        w = _rank_weights(x, np.r_[np.ones(len(p[i::2])), np.zeros(len(u[i::2]))])
        sp, su = (np.sort(z[1 - i :: 2] @ w[:-1]) for z in (p, u))
        cuts = np.unique(np.concatenate([sp, su]))
        qp, qu = (1 - np.searchsorted(z, cuts, "left") / len(z) for z in (sp, su))
        cuts, qp, qu = cuts[qp > 0], qp[qp > 0], qu[qp > 0]
        unsure = sum(math.sqrt(math.log(4 / risk) / (2 * len(z))) for z in (sp, su))
        best = int(np.argmin((qu + (1 + slack) * unsure) / qp))
        found.append(qu[best] / qp[best])
    return float(np.clip(np.mean(found), 0.01, 0.99))


def _feature_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(2), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, most: int = 12_000) -> Model:
    """Fit on at most ``most`` trusted positives and as many unlabelled documents, both by smallest hash of doc_id.

    With no trusted positive at all the model knows nothing and scores every text 0.5.
    """
    known = labelled(docs, labels.where(F.col("quality") == 1), "quality", most).select("doc_id", "text", "label")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(most)
    some = id_and_text(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", F.lit(-1).alias("label"))
    rows = known.union(some).transform(in_arrow, _feature_kernel, "label int, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), N_FEATURES)
    y = rows["label"].to_numpy()
    positive, unlabelled = x[y == 1], x[y == -1]
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), [np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1), np.zeros(1)], 0.5)
    order = np.lexsort(positive.T)
    positive = positive[order]  # whatever order the rows came in
    unlabelled = unlabelled[np.lexsort(unlabelled.T)]
    model = fit_pu(positive, unlabelled, prior=estimate_prior(positive, unlabelled))
    give_back()
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; keep: the columns of docs, __score and __predicted.

    Null and empty texts get the score of a text without words; rows with the
    same doc_id are scored each on their own; an empty table gives no rows.
    The model's few hundred numbers go with the tasks.
    """

    def chances(texts: list) -> pa.Array:
        x = np.array([features(t or "") for t in texts], dtype=np.float64).reshape(len(texts), N_FEATURES)
        return pa.array(model.score(x), pa.float64())

    if keep:
        ship_package(docs.sparkSession)
        at = docs.columns.index("text")

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in in_bytes(batches, at):
                yield pa.RecordBatch.from_arrays([*b.columns, chances(b.column(at).to_pylist())], names=[*b.schema.names, "__score"])

        plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # Arrow takes no names with dots
        schema = StructType([*plain.schema.fields, StructField("__score", DoubleType())])
        return plain.transform(in_arrow, whole, schema).toDF(*docs.columns, "__score").withColumn("__predicted", (F.col("__score") >= threshold).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in by_text(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), chances(texts)], names=["doc_id", "score"])

    out = id_and_text(docs).transform(in_arrow, run, _OUT)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 12_000) -> DataFrame:
    """Train on the trusted positives that aren't held out and score every document."""
    return score(docs, train(docs, labels, most), threshold)
