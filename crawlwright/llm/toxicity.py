"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

* Token scores: documents with a token are counted by label.  A word's odds have a Dirichlet (two classes: beta) prior centred
  on the odds of its 6-character prefix, that on the 5-character prefix, and so on up to the whole sample, so rare words lean
  on their stem and unseen words have a score as well.  A score is the log-odds above the sample's, less a constant drift.
* Segments: one linear scan finds all maximal-scoring segments of a text (each the best run of tokens that does not gain by
  growing or shrinking).
* Significance: in clean text the best of n tokens follows an extreme-value law with scale ``rate`` and size ``size``, both
  taken from clean sample texts; a segment of score S is worth ``rate * S - log(size * n)`` where that is positive.
* Score: a logistic curve over the sum of a text's significant segments, fitted on the sample.

Counts live in a fixed number of hash buckets, so the model has a fixed size.  It is fitted on at most ``sample_rows`` labelled
rows; every text is scored whole, in one pass without a shuffle.  Language, source, ids and labels are not inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlwright.llm.common import one_each, slices, stash, utf8
from crawlwright.llm.tokens import WORD, hashed, text_of

BUCKETS = 1 << 20
PREFIXES = (3, 4, 5, 6)
PRIOR = 6.0
DRIFT = 1.0
SAMPLE_ROWS = 20_000
EULER = 0.5772156649015329


def nodes(words: list[str]) -> np.ndarray:
    """A bucket per word and level: its prefixes, then the word."""
    return np.stack([hashed([w[:n] for w in words], BUCKETS, salt=n) for n in PREFIXES] + [hashed(words, BUCKETS)])


def log_odds(counts: np.ndarray, root: float, at: np.ndarray, own: int | None = None) -> np.ndarray:
    """Scores of words by their nodes; ``counts`` is (clean, toxic) by bucket.  A sample text with the label ``own`` is scored
    without its own count, as a new text would be."""
    share = np.full(at.shape[1], root)
    for level in at:
        clean, toxic = counts[0][level] - (own == 0), counts[1][level] - (own == 1)
        share = (toxic + PRIOR * share) / (clean + toxic + PRIOR)
    return np.log(share / (1 - share)) - np.log(root / (1 - root)) - DRIFT


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) in one scan; tokens that do not score are passed over in bulk."""
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    out: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, the nearest earlier one that begins lower
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, before, after = i, i + 1, sums[i], sums[i + 1]
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= before:
                j = out[j][4]
            if j < 0 or out[j][3] >= after:
                out.append((start, end, before, after, j))
                break
            start, _, before, _, link = out[j]
            del out[j:]
            j = link
    return [(a, b, float(y - x)) for a, b, x, y, _ in out]


@dataclass(frozen=True)
class ToxicModel:
    counts: np.ndarray
    root: float
    rate: float = 1.0
    size: float = 1.0
    slope: float = 1.0
    level: float = 0.0

    def tokens(self, text: str, own: int | None = None) -> np.ndarray:
        words = WORD.findall(text.lower())
        if not words:
            return np.zeros(0)
        codes, unique = pd.factorize(np.array(words, dtype=object))
        return log_odds(self.counts, self.root, nodes(list(unique)), own)[codes]

    def passages(self, text: str, own: int | None = None) -> list[tuple[int, int, float]]:
        """Significant segments (first word, end, worth) of a text."""
        scores = self.tokens(text, own)
        least = np.log(max(self.size * len(scores), 1.0)) if len(scores) else 0.0
        found = [(a, b, self.rate * s - least) for a, b, s in segments(scores)]
        return [f for f in found if f[2] > 0]

    def worth(self, text: str, own: int | None = None) -> float:
        return sum(w for *_, w in self.passages(text, own))

    def probability(self, worth: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(worth) + self.level, -50, 50)))


def _sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # at most sample_rows pairs of numbers
    return stash(one_each(docs, chosen).select(F.when(F.col("label") > 0, 1).otherwise(0).alias("label"), "text"), "toxicity-sample")


def _map(rows: DataFrame, each, schema: str, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            columns = each(b.column(0).to_pylist(), [text_of(t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
    return rows.mapInArrow(run, schema)


def _counts(labels: list[int], texts: list[str]) -> list[np.ndarray]:
    """In how many texts of the batch a bucket occurs, by label."""
    at: list[list[np.ndarray]] = [[], []]
    for label, text in zip(labels, texts):
        words = list(set(WORD.findall(text.lower())))
        if words:
            at[label].append(np.unique(nodes(words)))
    found = [np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for x in at]
    return [np.concatenate([np.full(len(f[0]), k, np.int64) for k, f in enumerate(found)]), np.concatenate([f[0] for f in found]),
            np.concatenate([f[1] for f in found])]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicModel:
    """Fit on at most ``sample_rows`` rows of ``labels`` (doc_id, label); several labels of a text: the highest.

    Of several rows with one doc_id the one with the least hash of its text stands for it.  The sample is written once and read
    from there.
    With one class only, every text gets that class's side of 0.5.
    """
    rows = _sample(docs, labels, sample_rows)
    each = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0)).cast("int")
    table = (_map(rows, _counts, "label bigint, bucket bigint, n bigint", ["label", "bucket", "n"])
             .groupBy(F.col("bucket").cast("int").alias("bucket")).agg(each(0).alias("clean"), each(1).alias("toxic"))
             .toPandas())  # at most a row of three small numbers a bucket
    counts = np.zeros((2, BUCKETS), np.float32)
    counts[0][table["bucket"]], counts[1][table["bucket"]] = table["clean"], table["toxic"]
    del table
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return ToxicModel(counts * 0, 0.5, slope=0.0, level=5.0 if toxic else -5.0)
    model = ToxicModel(counts, toxic / (clean + toxic))

    # scale of the extreme-value law: the root of E[exp(rate * score)] = 1 over the tokens of clean texts
    def histogram(_, texts):
        found = np.concatenate([np.zeros(0), *[model.tokens(t, 0) for t in texts]])
        bins, n = np.unique(np.round(found * 50).astype(np.int64), return_counts=True)
        return [bins, n]

    spread = (_map(rows.where("label = 0"), histogram, "bin bigint, n bigint", ["bin", "n"]).groupBy("bin").agg(F.sum("n").alias("n")).toPandas())
    if not len(spread):
        return ToxicModel(counts, model.root, slope=0.0, level=-5.0)
    score, weight = spread["bin"].to_numpy() / 50, spread["n"].to_numpy() / spread["n"].sum()
    rate = _root(score, weight)

    # size of the law and the curve: the best segment and the worth of every sample text
    best = lambda labels, texts: [np.array(labels, np.int64), np.array([len(WORD.findall(t)) for t in texts], np.int64),
                                  np.array([max([0.0, *[s for *_, s in segments(model.tokens(t, y))]]) for y, t in zip(labels, texts)], float)]
    tops = _map(rows, best, "label bigint, n bigint, best double", ["label", "n", "best"]).toPandas()
    null = tops[(tops["label"] == 0) & (tops["n"] > 0) & (tops["best"] > 0)]
    size = float(np.exp((rate * null["best"] - np.log(null["n"])).mean() - EULER)) if len(null) else 1.0
    model = ToxicModel(counts, model.root, rate, size)
    worths = _map(rows, lambda labels, texts: [np.array(labels, np.int64), np.array([model.worth(t, y) for y, t in zip(labels, texts)], float)],
                  "label bigint, worth double", ["label", "worth"]).toPandas()
    slope, level = _curve(np.log1p(worths["worth"].to_numpy()), worths["label"].to_numpy(float))
    return ToxicModel(counts, model.root, rate, size, slope, level)


def _root(score: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1; 1 where there is none (no positive score, or no negative drift)."""
    if score.max() <= 0 or (score * weight).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    value = lambda r: float((weight * np.exp(np.clip(r * score, -700, 700))).sum()) - 1
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one variable with a light ridge, by Newton steps; the slope is never negative."""
    a, b = 0.0, float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 1e-2 * a, (p - y).sum() + 1e-2 * b])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 0.0), b


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``(doc_id, score, predicted, passages)`` for every row of ``docs``; ``passages`` are (first word, end, worth).

    Null and empty texts have no passages and the score of a text without any.  Repeated rows get equal scores; an empty table
    gives an empty result.  Other columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 2 * BUCKETS small floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for b in slices(batches, 1):
            found = [own.passages(text_of(t)) for t in b.column(1).to_pylist()]
            p = own.probability(np.array([sum(w for *_, w in f) for f in found], float))
            rows = [[{"start": a, "end": e, "worth": float(w)} for a, e, w in f] for f in found]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("worth", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(rows, kind)],
                                             names=["doc_id", "score", "predicted", "passages"])

    return docs.select("doc_id", utf8("text").alias("text")).mapInArrow(
        run, "doc_id bigint, score double, predicted int, passages array<struct<start:int,end:int,worth:double>>")
