"""Language identification of mixed texts by expectation-maximisation.

Each language is a multinomial over hashed byte trigrams, counted over all its training documents. A text is a mixture
of languages: EM estimates the proportions, and starting from all languages the smallest is dropped for as long as the
penalised likelihood (log-likelihood - PENALTY * languages * log(trigrams)) doesn't get worse.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fold, map_rows

#: Trigram buckets (a power of two), smoothing, EM steps for each set of languages and the penalty's weight.
BUCKETS, SMOOTH, STEPS, PENALTY = 1 << 13, 0.5, 8, 2.0
FOLDS, HELD = 5, 0
LETTER = re.compile(r"[^\W\d_]")


def trigrams(text: str) -> np.ndarray:
    """Bucket of each byte trigram of the lower-case text, a space before and after."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


class Model:
    """names: languages in order; log_p: (languages, BUCKETS)."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        self.p = (counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)

    def mixture(self, text: str) -> list[tuple[str, float]]:
        """The chosen languages with their proportions, largest first (ties: in order of name)."""
        n = np.bincount(trigrams(text), minlength=BUCKETS)
        at = np.flatnonzero(n)
        n = n[at].astype(np.float64)
        p, total = self.p[:, at], n.sum()
        cost = PENALTY * np.log(total + 1)
        alive = np.arange(len(self.names))
        share = np.full(len(alive), 1 / len(alive))

        def run(q, share):
            for _ in range(STEPS):
                share = share * (q @ (n / (share @ q))) / total
            return share, float(np.log(share @ q) @ n)

        share, fit = run(p, share)
        while len(alive) > 1:
            keep = np.arange(len(alive)) != len(alive) - 1 - int(np.argmin(share[::-1]))
            rest = share[keep]
            if rest.sum() <= 0:
                break
            rest, less = run(p[alive[keep]], rest / rest.sum())
            if less < fit - cost:
                break
            alive, share, fit = alive[keep], rest, less
        order = np.lexsort((alive, -share))
        return [(self.names[alive[i]], float(share[i])) for i in order]

    def predict(self, text: str | None) -> tuple[str, float, str]:
        """The main language, its proportion and the whole mixture; `und` without letters or without a model."""
        if text is None or not self.names or not LETTER.search(text):
            return "und", 0.0, ""
        mix = self.mixture(text)
        return mix[0][0], min(1.0, max(0.0, mix[0][1])), ",".join(f"{k}:{v:.3f}" for k, v in mix)


def fit(docs: DataFrame) -> Model:
    """Count the trigrams of every training row of docs (doc_id, text, lang): a known lang, a text, not of the held fold.

    A task sends its sums, at most BUCKETS rows a language, and the totals, as many, come to the driver.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD))

    def count(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = np.bincount(trigrams(text), minlength=BUCKETS)
                sums[lang] = sums[lang] + got if lang in sums else got
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    sums = rows.select("lang", "text").mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(sums["lang"].unique())
    counts = np.zeros((len(names), BUCKETS))
    counts[np.searchsorted(names, sums["lang"].to_numpy(str)) if names else [], sums["bucket"]] = sums["n"]
    return Model([str(x) for x in names], counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, mixture) of every row of docs; narrow."""
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    send = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(doc_id, held_out, text):
        m = send.value
        return [(k, h, *m.predict(t)) for k, h, t in zip(doc_id, held_out, text, strict=True)]

    return map_rows(docs.select("doc_id", held.alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, mixture string")
