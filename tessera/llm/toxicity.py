"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the distinct words of a text and their beginnings is trained in numpy from confirmed toxic texts and unlabelled
text. With class prior p and logistic loss l, the risk p*E_pos[l(+)] + max(0, E_unl[l(-)] - p*E_pos[l(-)]) is
minimised; where its second part turns negative, the step climbs that part back instead (the non-negative correction).
Training reads a bounded sample of texts (Settings.positives and Settings.unlabelled, taken in hash order); scoring is
a narrow map over every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import first_by_hash, fold, map_rows

LETTERS = re.compile(r"[^\W\d_]+")


class Settings(NamedTuple):
    """Bounds of the training sample and the optimiser; `held` is the fold of ids that is never learnt from."""

    positives: int = 2048
    unlabelled: int = 6144
    features: int = 1024
    least_positives: int = 5
    least_z: float = 4.0
    steps: int = 400
    rate: float = 0.05
    decay: float = 3e-4
    folds: int = 4
    held: int = 2
    cut: float = 0.3


#: Lengths of the beginnings of longer words that are features too, as compounds share them.
BEGINNINGS = (5, 7)
#: Words whose weight a Python worker remembers.
REMEMBERED = 100_000


def features_of(word: str) -> list[int]:
    """Hashes of a lower-case word and of its beginnings."""
    return [zlib.crc32(w.encode("utf-8", "replace")) for w in (word, *(f"^{word[:n]}" for n in BEGINNINGS if len(word) > n))]


def words_of(text: str | None) -> list[int]:
    """The feature hashes of the distinct lower-case letter runs of a text, ascending; none for null."""
    return sorted(f for w in set(LETTERS.findall((text or "").lower())) for f in features_of(w))


class Model:
    """P(toxic) = sigmoid(bias + the sum of the feature weights of a text's distinct words)."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def weigh(self, words: set[str]) -> float:
        known, get, total = self.known, self.weights.get, []
        for w in words:
            x = known.get(w)
            if x is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                x = known[w] = sum(get(f, 0.0) for f in features_of(w))
            if x:
                total.append(x)
        return math.fsum(total)  # exact, so that the order of the set is of no matter

    def score(self, text: str | None) -> float:
        g = self.bias + self.weigh(set(LETTERS.findall((text or "").lower())))
        return 1 / (1 + math.exp(-min(max(g, -40.0), 40.0)))


def choose(pos: list[np.ndarray], unl: list[np.ndarray], s: Settings) -> np.ndarray:
    """The words whose document frequencies differ most, in standard errors, between positive and unlabelled texts."""
    ids, inv = np.unique(np.concatenate([*pos, *unl]), return_inverse=True)
    n = sum(map(len, pos))
    first = np.concatenate([np.append(True, d[1:] != d[:-1])[: len(d)] for d in [*pos, *unl]])  # a feature counts once for a text here
    a, b = (np.bincount(inv[part], weights=first[part], minlength=len(ids)) for part in (slice(n), slice(n, None)))
    p, q = (a + 0.5) / (len(pos) + 1), (b + 0.5) / (len(unl) + 1)
    z = np.abs(p - q) / np.sqrt(p * (1 - p) / (len(pos) + 1) + q * (1 - q) / (len(unl) + 1))
    z[(a < s.least_positives) | (z < s.least_z)] = 0
    del inv, first
    best = np.lexsort((ids, -z))[: s.features]
    return np.sort(ids[best[z[best] > 0]])


def matrix(docs: list[np.ndarray], vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sparse incidence of docs and vocabulary: row and column of each entry."""
    rows = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    flat = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    at = np.searchsorted(vocab, flat)
    hit = (at < len(vocab)) & (vocab[np.minimum(at, len(vocab) - 1)] == flat)
    return rows[hit], at[hit]


def train(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, s: Settings = Settings()) -> Model:
    """Full-batch Adam on the non-negative PU risk. Without positives or unlabelled texts nothing is toxic."""
    if not pos or not unl or not (vocab := choose(pos, unl, s)).size:
        return Model({}, -40.0)
    prior = min(max(prior, 1e-3), 0.5)
    (pr, pc), (ur, uc) = matrix(pos, vocab), matrix(unl, vocab)
    k, v = len(vocab), np.zeros((2, len(vocab) + 1))
    w = np.zeros(k + 1)
    w[k] = np.log(prior / (1 - prior))
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    def back(rows, cols, per_row):
        return np.append(np.bincount(cols, weights=per_row[rows], minlength=k), per_row.sum())

    for t in range(1, s.steps + 1):
        gp = np.bincount(pr, weights=w[pc], minlength=len(pos)) + w[k]
        gu = np.bincount(ur, weights=w[uc], minlength=len(unl)) + w[k]
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        neg = back(ur, uc, sig(gu) / len(unl)) - prior * back(pr, pc, sig(gp) / len(pos))
        grad = -neg if negative < 0 else prior * back(pr, pc, (sig(gp) - 1) / len(pos)) + neg
        grad[:k] += s.decay * w[:k]
        v[0] = 0.9 * v[0] + 0.1 * grad
        v[1] = 0.999 * v[1] + 0.001 * grad**2
        w -= s.rate * (v[0] / (1 - 0.9**t)) / (np.sqrt(v[1] / (1 - 0.999**t)) + 1e-8)
    keep = np.abs(w[:k]) > 1e-6
    return Model(dict(zip(vocab[keep].tolist(), w[:k][keep].tolist(), strict=True)), float(w[k]))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Train from docs (doc_id, text) and labels (doc_id, toxic); ids of the held fold, and null ids, are not read.

    The prior is the share of toxic among the labelled rows of the other folds. A doc_id with several labels counts
    as toxic if one says so. Only ids and counts are gathered before the bounded sample is.
    """
    learn = lambda d: d.where(fold(F.col("doc_id"), s.folds) != s.held)
    known = learn(labels.where("toxic is not null")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    pos = first_by_hash(known.where("toxic = 1"), "doc_id", s.positives, "toxicity").select("doc_id", F.lit(1).alias("p"))
    unl = first_by_hash(learn(docs.select("doc_id")), "doc_id", s.unlabelled, "toxicity").select("doc_id", F.lit(0).alias("p"))
    sample = docs.select("doc_id", "text").join(F.broadcast(pos.unionByName(unl)), "doc_id")
    rows = map_rows(sample.select("p", "text"), lambda p, text: [(a, np.array(words_of(t), np.uint32).tobytes()) for a, t in zip(p, text, strict=True)], "p int, words binary").toPandas()
    sets = [np.frombuffer(w, np.uint32) for w in rows["words"]]
    # The order in which the sample arrives is no part of the model.
    both = sorted(zip(rows["p"], sets, strict=True), key=lambda r: (r[0], r[1].tobytes()))
    return train([w for p, w in both if p == 1], [w for p, w in both if p == 0], (toxic or 0) / n if n else 0.0, s)


def classify(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) of every row of docs; a null or empty text scores as no words do."""
    held = F.coalesce(fold(F.col("doc_id"), s.folds) == s.held, F.lit(False))
    send = docs.sparkSession.sparkContext.broadcast(model)

    def run(doc_id, held_out, text):
        m = send.value
        return [(d, h, m.score(t)) for d, h, t in zip(doc_id, held_out, text, strict=True)]

    kind = dict(docs.dtypes)["doc_id"]
    out = map_rows(docs.select("doc_id", held.alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= s.cut).cast("int"))


def keep_clean(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic. Narrow: the text is scored where it lies."""
    from pyspark.sql.types import BooleanType

    send = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(BooleanType())
    def clean(text: pd.Series) -> pd.Series:
            return pd.Series([send.value.score(t) < s.cut for t in text], dtype=bool)

    return docs.where(clean(F.col("text")))
