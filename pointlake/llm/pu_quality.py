"""Quality classifier by positive-unlabelled learning.

A logistic model is fitted on trusted positives and unlabelled web text with the
non-negative unbiased risk estimator: the risk on negatives is the unlabelled
risk less the share that positives explain, and where that difference turns
negative the fit steps back instead of over-fitting. The class prior is estimated
as the least ratio of unlabelled to positive mass over score ranges, which bounds the
share of positives among the unlabelled; both masses are counted over all training rows
but those that the ranking itself was fitted on.

Features of a text are the square-rooted shares of its pairs of byte classes
(letters, digits, capitals, each punctuation mark, white space, other), and a few
shape measures. All are computed over the whole text.

Fitting uses a bounded sample: the ``sample_docs`` positives and as many
unlabelled documents with the least hash of the id, one text an id (that with the
least hash). Scoring, and the masses of the prior, cover every row.

Edge cases: null text counts as empty; empty texts get the model's score for no
features. Conflicting labels of one id count as positive only if all are 1. With
no positive to learn from every score is 0.5. Rows with a null id are held out.
Equal scores are of equal rank. Very long texts are read whole. An empty table gives
no rows. Repeated rows keep their own result row; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.common import arrow_map, as_bytes, bounded, cut, doc_fold, table

CLASSES = 64
SHAPES = 6
WIDTH = CLASSES * CLASSES + SHAPES


def _byte_classes() -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[ord("a") : ord("z") + 1] = 1 + np.arange(26)
    out[ord("A") : ord("Z") + 1] = 27
    out[ord("0") : ord("9") + 1] = 28
    out[[ord(c) for c in " \t\v\f\r"]] = 29
    out[ord("\n")] = 30
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    out[marks] = 31 + np.arange(len(marks))
    out[128:] = CLASSES - 1
    return out


_CLASS = _byte_classes()


def features(text: bytes) -> np.ndarray:
    """``WIDTH`` numbers between 0 and 1."""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    classes = _CLASS[np.frombuffer(text, np.uint8)]
    pairs = np.bincount(classes[:-1] * CLASSES + classes[1:], minlength=CLASSES * CLASSES)
    out[: CLASSES * CLASSES] = np.sqrt(pairs / max(1, len(text) - 1))
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    n = len(words)
    if n:
        out[-6:] = (
            min(1.0, math.log1p(n) / 10),
            min(1.0, len(text) / n / 20),
            len(set(words)) / n,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
            1 - len(set(lines)) / len(lines),
            1.0 if n < 50 else 0.0,
        )
    return out


@dataclass(frozen=True)
class PuModel:
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights + self.bias, -30, 30)))


class _Adam:
    def __init__(self, size: int, rate: float):
        self.rate, self.m, self.v, self.t = rate, np.zeros(size, np.float32), np.zeros(size, np.float32), 0

    def step(self, w: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return w - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Non-negative PU risk with the logistic loss, by full-batch Adam; the last column is the bias."""
    p, u = positive, unlabelled
    w, adam = np.zeros(p.shape[1], np.float32), _Adam(p.shape[1], rate)
    for _ in range(rounds):
        at_p, at_u = p @ w, u @ w
        as_negative = np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_p).mean()
        negative = (_sigmoid(at_u) @ u) / len(u) - prior * (_sigmoid(at_p) @ p) / len(p)
        if as_negative >= 0:
            gradient = -prior * ((1 - _sigmoid(at_p)) @ p) / len(p) + negative
        else:
            gradient = -negative
        gradient[:-1] += decay * w[:-1]
        w = adam.step(w, gradient.astype(np.float32))
    return w[:-1], float(w[-1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least_mass: float = 0.2) -> float:
    """Upper bound on the share of positives: least unlabelled / positive mass above any score.

    Both are counts of rows by score range, the lowest first. Only ranges with
    ``least_mass`` of the positives are looked at, so that chance in the far tail does not
    set the bound.
    """
    above = lambda n: np.cumsum(n[::-1])[::-1] / max(1, n.sum())
    p, u = above(positive), above(unlabelled)
    seen = p >= least_mass
    return float(np.clip((u[seen] / p[seen]).min(initial=1.0), 0.05, 0.98))


BINS = 1000


def rough_model(positive: np.ndarray, unlabelled: np.ndarray, rate: float = 0.2) -> PuModel:
    """A fit of positives against unlabelled rows, whose scores rank documents for the prior."""
    weights, bias = _train(positive, unlabelled, 0.5, 100, rate, 1e-4)
    return PuModel(weights, bias, 0.5)


def fit_samples(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 600, rate: float = 0.2, decay: float = 1e-6) -> PuModel:
    """The non-negative PU fit. Rows are features and a last column of ones."""
    weights, bias = _train(positive, unlabelled, prior, rounds, rate, decay)
    return PuModel(weights, bias, prior)


def _featured(texts: DataFrame) -> DataFrame:
    """(which, id, raw): features as half-precision bytes, of rows (which, id, text)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = [features(t).astype(np.float16).tobytes() for t in as_bytes(batch.column(2))]
            return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(raw, pa.binary())], names=["which", "id", "raw"])

        return step

    return arrow_map(texts.withColumn("id", F.col("id").cast("long")), make, "which string, id long, raw binary")


def sure_positives(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("least")).filter("least = 1").select("id")


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 4096) -> PuModel:
    """The model from rows where ``train`` holds; of ``labels`` only sure positives are used."""
    rows = docs.filter(train).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    ids = cut(rows.groupBy("id").agg(F.min("h").alias("h")))
    sure = cut(sure_positives(labels))
    least = lambda some: some.orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    positives = least(ids.join(sure, "id", "left_semi")).withColumn("which", F.lit("p"))
    unlabelled = least(ids).withColumn("which", F.lit("u"))
    # at most 2 * sample_docs rows, and as many texts
    chosen = F.broadcast(positives.union(unlabelled))
    found = _featured(rows.join(chosen, ["id", "h"]).select("which", "id", "text"))
    half = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2))
    sampled = found.groupBy("which", "id").agg(F.min("raw").alias("raw")).withColumn("half", half).toArrow()
    which, raw, halves = (sampled.column(c).to_pylist() for c in ("which", "raw", "half"))
    del sampled
    order = sorted(range(len(raw)), key=lambda k: (which[k], raw[k]))
    np.random.default_rng(0).shuffle(order)

    def sample(kind: str, some: tuple[int, ...] = (0, 1)) -> np.ndarray:
        own = [k for k in order if which[k] == kind and halves[k] in some]
        out = np.ones((len(own), WIDTH + 1), np.float32)
        for at, k in enumerate(own):
            out[at, :-1] = np.frombuffer(raw[k], np.float16)
        return out

    positive, unknown = sample("p"), sample("u")
    if not len(positive):
        return PuModel(np.zeros(WIDTH, np.float32), 0.0, 0.5)
    fitted = [x if len(x) else whole for x, whole in ((sample("p", (0,)), positive), (sample("u", (0,)), unknown))]
    others = rows.join(F.broadcast(chosen.filter(half == 0).select("id").distinct()), "id", "left_anti")
    return fit_samples(positive, unknown, _corpus_prior(others, sure, rough_model(*fitted)))


def _corpus_prior(rows: DataFrame, sure: DataFrame, rough: PuModel) -> float:
    """``estimate_prior`` from the scores of all ``rows`` and of the positives among them."""
    scored = classify(rows, rough, "id").select("id", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    marked = scored.join(bounded(sure.withColumn("sure", F.lit(True)), sure.count()), "id", "left")
    found = marked.groupBy("bin").agg(F.count(F.lit(1)).alias("all"), F.count("sure").alias("sure")).collect()
    everything, positive = np.zeros(BINS), np.zeros(BINS)
    for r in found:
        everything[r["bin"]], positive[r["bin"]] = r["all"], r["sure"]
    return estimate_prior(positive, everything)


def classify(docs: DataFrame, model: PuModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = np.stack([features(t) for t in as_bytes(batch.column(1))])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fitted.scores(rows).astype(np.float64))], names=["id", "score"])

        return step

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return arrow_map(slim, make, "id long, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(doc_fold(id_col, 3) == 1, F.lit(True))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered query's rows."""
    model = fit(docs, labels, ~held_out())
    return classify(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
