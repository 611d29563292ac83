"""Quality classifier learned from trusted positives and unlabelled web text.

A small network over whole-text statistics minimises the non-negative unbiased risk

    prior * R(positive as 1) + max(0, R(unlabelled as 0) - prior * R(positive as 0)),

with logistic loss.  Positives are labelled rows of quality 1 outside the test fold,
unlabelled rows are drawn from the whole table; both samples are bounded (``sample``)
and fixed by a hash of doc_id.  The class prior is the share of label 1 among the
labelled rows outside the test fold; where these are all positive, it is estimated from
how often a positive-against-unlabelled classifier fires on the two samples.

Null and empty texts have all statistics zero and are scored like any other row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesieve.llm.toxic_crf import accepted, labelled_sample, texts_of

WORDS = re.compile(r"\S+")
ODD = [c.encode() for c in "|*#%$&@<>{}[]=+/\\_~^;:!?\"'()-,."]


def statistics(text: str) -> list[float]:
    """Numbers that describe a whole text, none of which grows with its length without bound but the first two."""
    raw = text.encode()
    words = text.split()
    n, w = len(raw), len(words)
    if not w:
        return [0.0] * (24 + len(ODD))
    lines = [x for x in text.split("\n") if x.strip()]
    lower = [x.lower() for x in words]
    distinct = len(set(lower))
    repeats = sum(a == b for a, b in zip(lower, lower[1:]))
    pairs = len(set(zip(lower, lower[1:])))
    size = np.fromiter(map(len, words), float, w)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    letters = hist[65:91].sum() + hist[97:123].sum()
    p = hist[hist > 0]
    ends = [x[-1] for x in words]
    odd_end = sum(not (c.isalnum() or c in ".,;:!?") for c in ends)
    stops = sum(e in ".!?" for e in ends)
    capital = sum(x[0].isupper() for x in words)
    upper = sum(len(x) > 1 and x.isupper() for x in words)
    line_words = w / max(1, len(lines))
    return [
        np.log1p(n) / 10, np.log1p(w) / 10, size.mean() / 10, size.std() / 10, size.max() / (size.max() + 20), (size <= 3).mean(), (size == 1).mean(),
        letters, hist[65:91].sum(), hist[48:58].sum(), hist[128:].sum(), hist[10], hist[:9].sum() + hist[11:32].sum(), -(p * np.log(p)).sum() / 4,
        distinct / w, np.log1p(distinct) / 10, repeats / w, pairs / w, odd_end / w, stops / w, capital / w, upper / w,
        len(set(lines)) / max(1, len(lines)), line_words / (line_words + 20),
        *(min(1.0, 20 * hist[c[0]]) for c in ODD),
    ]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts]).reshape(len(texts), 24 + len(ODD))


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ w1 + b1) @ w2 + b2[0]

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.logits(matrix(texts)), -30, 30)))


def minimise_risk(pos: np.ndarray, unl: np.ndarray, prior: float, hidden: int = 32, epochs: int = 60, rate: float = 0.003, seed: int = 7) -> QualityModel:
    """Adam on the non-negative risk; where the negative part falls below zero its gradient is turned round."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl])
    model = QualityModel(both.mean(0), both.std(0) + 1e-3, [])
    d = both.shape[1]
    model.layers = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), np.zeros(hidden), np.array([np.log(prior / (1 - prior))])]
    zp, zu = (np.clip((x - model.mean) / model.scale, -6, 6) for x in (pos, unl))
    m, v, t = [0 * x for x in model.layers], [0 * x for x in model.layers], 0
    size = 512
    for _ in range(epochs):
        ip, iu = rng.permutation(len(zp)), rng.permutation(len(zu))
        for k in range(max(1, len(iu) // size)):
            bp = zp[np.take(ip, np.arange(k * size, (k + 1) * size), mode="wrap")]
            bu = zu[np.take(iu, np.arange(k * size, (k + 1) * size), mode="wrap")]
            x = np.concatenate([bp, bu])
            w1, b1, w2, b2 = model.layers
            h = np.tanh(x @ w1 + b1)
            s = 1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -30, 30)))
            sp, su = s[: len(bp)], s[len(bp) :]
            as0 = lambda q: -np.log(1 - q + 1e-9).mean()
            negative = as0(su) - prior * as0(sp)
            gp, gu = prior * (sp - 1) / len(bp), su / len(bu)
            if negative < 0:
                g = np.concatenate([prior * sp / len(bp), -gu])
            else:
                g = np.concatenate([gp - prior * sp / len(bp), gu])
            back = np.outer(g, w2) * (1 - h * h)
            grads = [x.T @ back, back.sum(0), h.T @ g, np.array([g.sum()])]
            t += 1
            for i, gr in enumerate(grads):
                gr = gr + 1e-5 * model.layers[i]
                m[i] = 0.9 * m[i] + 0.1 * gr
                v[i] = 0.999 * v[i] + 0.001 * gr * gr
                model.layers[i] = model.layers[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return model


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among the unlabelled from a classifier of positive against unlabelled rows (Elkan and Noto)."""
    half = len(pos) // 2
    if half < 5 or len(unl) < 10:
        return 0.5
    g = minimise_risk(pos[:half], unl, 0.5, epochs=20)
    fired = 1 / (1 + np.exp(-g.logits(pos[half:]))).mean()
    return float(np.clip((1 / (1 + np.exp(-g.logits(unl)))).mean() / max(fired, 1e-3), 0.05, 0.98))


def train(docs: DataFrame, labels: DataFrame, fold: int = 3, test: int = 1, sample: int = 4000) -> QualityModel:
    """Fit on at most ``sample`` trusted positives and ``sample`` unlabelled rows."""
    outside = labels.where(F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold != test))
    share = outside.agg(F.avg("quality")).first()[0]
    pos = labelled_sample(docs, labels.where("quality = 1"), "quality", fold, test, (0, sample))
    some = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), F.lit(8)).alias("at")).orderBy("at", "doc_id").limit(sample).select("doc_id")
    p, u = gather(pos), gather(texts_of(docs, some))
    if not len(p) or not len(u):
        return QualityModel(np.zeros(24 + len(ODD)), np.ones(24 + len(ODD)), [np.zeros((24 + len(ODD), 1)), np.zeros(1), np.zeros(1), np.zeros(1)])
    prior = float(share) if share is not None and 0 < share < 1 else estimate_prior(p, u)
    return minimise_risk(p, u, float(np.clip(prior, 0.02, 0.98)))


def gather(rows: DataFrame) -> np.ndarray:
    """Statistics of a bounded sample, worked out in the tasks that read it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": list(matrix(pdf["text"].tolist()))})

    got = rows.select("doc_id", "text").mapInPandas(run, "doc_id long, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    return np.array(got["x"].tolist()).reshape(len(got), 24 + len(ODD))


def score_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score, predicted for each row, from its whole text."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.mean, model.scale, model.layers))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = QualityModel(*sent.value)
        for pdf in batches:
            score = m.score([t if isinstance(t, str) else "" for t in pdf["text"]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": score, "predicted": (score >= 0.5).astype(int)})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, score double, predicted int")


def drop_poor(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """Documents that score ``threshold`` or more, unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast((model.mean, model.scale, model.layers))
    return accepted(docs, lambda: QualityModel(*sent.value).score, lambda s: s >= threshold)
