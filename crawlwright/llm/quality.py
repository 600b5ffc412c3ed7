"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

One weight vector over hashed token features is shared by all grades; ordered thresholds cut its score into grades:
``P(grade >= k) = sigmoid(w.x - threshold_k)``.  The expected grade is the sum of these tails, and a tail is a selection
probability.  Features of a whole text: its tokens, the shapes of its tokens (letter runs, digits and signs) and how soon
tokens repeat, as square roots of their shares.

The model is fitted on a bounded sample of rated rows (``sample_rows``, the first by a hash of doc_id); its features come to
the driver, so the bound is also the driver's.  Scoring reads every text once and shuffles nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlwright.llm.common import one_each, slices, utf8
from crawlwright.llm.tokens import hashed, text_of

BUCKETS = 1 << 12
SAMPLE_ROWS = 8_000
STEPS = 150
RIDGE = 1e-4
NEAR = 4  # a token is a repeat if it stood at most so many tokens before
_RUNS = [(re.compile(r"[^\W\d_]+"), lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "Aa" if m[0][0].isupper() else "a"),
         (re.compile(r"\d+"), lambda m: "0"), (re.compile(r"([^\w\s])\1+"), lambda m: m[1] * 2)]


def shape(token: str) -> str:
    for pattern, into in _RUNS:
        token = pattern.sub(into, token)
    return token[:8]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of a whole text, buckets in order; a text without tokens has none."""
    tokens = text.split()
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    codes, unique = pd.factorize(np.array(tokens, dtype=object))
    shapes = [shape(t) for t in unique]
    words = hashed([t.lower() for t in unique], BUCKETS)
    forms = hashed(shapes, BUCKETS, salt=7)
    out = np.bincount(words[codes], minlength=BUCKETS) + np.bincount(forms[codes], minlength=BUCKETS)
    for gap in range(1, NEAR + 1):
        same = int((codes[gap:] == codes[:-gap]).sum())
        if same:
            out[hashed([f"repeat {gap}"], BUCKETS, salt=11)[0]] += same
    at = np.flatnonzero(out)
    return at, np.sqrt(out[at] / len(tokens))


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; one fewer than there are grades

    def tails(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -50, 50)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int) -> OrdinalModel:
    """Maximum likelihood with a ridge by Adam; thresholds are a first value and positive steps, so they stay ordered.

    With fewer than two grades among the rows nothing can be told apart: the model then gives every text that grade (the
    highest if there are no rows).
    """
    seen = np.unique(grades)
    if len(seen) < 2:
        top = int(seen[0]) if len(seen) else levels - 1
        return OrdinalModel(np.zeros(BUCKETS), np.where(np.arange(1, levels) <= top, -50.0, 50.0) + np.arange(levels - 1) * 1e-6)
    n = len(rows)
    row = np.repeat(np.arange(n), [len(r[0]) for r in rows])
    col, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    share = np.array([(grades >= k).mean() for k in range(1, levels)]).clip(1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    steps = np.log(np.maximum(np.diff(first), 1e-2))
    theta = np.concatenate((np.zeros(BUCKETS), first[:1], steps))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for step in range(1, STEPS + 1):
        w, cuts = theta[:BUCKETS], theta[BUCKETS] + np.concatenate(([0.0], np.cumsum(np.exp(theta[BUCKETS + 1:]))))
        score = np.bincount(row, weights=val * w[col], minlength=n)
        # P(y) = tail(y) - tail(y + 1), with tail(0) = 1 and tail(levels) = 0
        tails = np.concatenate((np.ones((n, 1)), sigmoid(score[:, None] - cuts[None, :]), np.zeros((n, 1))), axis=1)
        at = np.arange(n)
        p = np.maximum(tails[at, grades] - tails[at, grades + 1], 1e-9)
        slope = tails * (1 - tails)
        up, down = slope[at, grades] / p, slope[at, grades + 1] / p
        g_score = -(up - down) / n
        g_cut = np.zeros(levels + 1)
        np.add.at(g_cut, grades, up / n)
        np.add.at(g_cut, grades + 1, -down / n)
        g_cut = g_cut[1:levels]
        later = np.cumsum(g_cut[::-1])[::-1]
        grad = np.concatenate((np.bincount(col, weights=val * g_score[row], minlength=BUCKETS) + RIDGE * w, later[:1],
                               later[1:] * np.exp(theta[BUCKETS + 1:])))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        theta = theta - 0.3 / (1 + step / 50) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return OrdinalModel(theta[:BUCKETS].copy(), theta[BUCKETS] + np.concatenate(([0.0], np.cumsum(np.exp(theta[BUCKETS + 1:])))))


def grade_of(labels: DataFrame) -> Column:
    """Three grades from the two labels: 0 poor, 1 fair but toxic, 2 good; null without a quality label."""
    return F.when(F.col("quality") <= 0, 0).when(F.col("toxic") > 0, 1).when(F.col("quality") > 0, 2)


def train(docs: DataFrame, ratings: DataFrame, levels: int = 3, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on at most ``sample_rows`` rows of ``ratings`` (doc_id, grade 0 to levels - 1); several ratings of a text: the lowest.

    Of several rows with one doc_id the one with the least hash of its text stands for it.
    """
    rated = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, levels - 1)).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # at most sample_rows pairs of numbers
    rows = one_each(docs, chosen).select("doc_id", F.col("grade").cast("int").alias("grade"), "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            found = [features(text_of(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0].astype(np.int16) for f in found], pa.list_(pa.int16())),
                                              pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32()))],
                                             names=["doc_id", "grade", "at", "value"])

    got = rows.mapInArrow(read, "doc_id bigint, grade int, at array<smallint>, value array<float>").toPandas().sort_values("doc_id")
    pairs = [(np.asarray(a, np.int64), np.asarray(v, np.float64)) for a, v in zip(got["at"], got["value"])]
    return fit(pairs, got["grade"].to_numpy(np.int64), levels)


def score(docs: DataFrame, model: OrdinalModel, keep: int = 1, least: float = 0.5) -> DataFrame:
    """``docs`` with a column ``quality_score``: struct of expected_grade, tail (probability of grade ``keep`` or better), kept.

    Every text is scored whole.  Null and empty texts have no features and get the score of a text without evidence.  All
    columns are kept (``quality_score`` is replaced); repeated rows get equal scores; an empty table stays empty.
    """
    weights = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            value = np.array([float(weights[at] @ x) for at, x in (features(text_of(t)) for t in b.column(0).cast(pa.binary()).to_pylist())])
            tails = model.tails(value.reshape(-1))
            tail = tails[:, keep - 1]
            scored = pa.StructArray.from_arrays([pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= least)],
                                                names=["expected_grade", "tail", "kept"])
            yield pa.RecordBatch.from_arrays([*b.columns[1:], scored], names=[*b.schema.names[1:], "quality_score"])

    kept = [c for c in docs.columns if c != "quality_score"]
    schema = docs.select(*kept).limit(0).withColumn("quality_score", F.expr("cast(null as struct<expected_grade:double,tail:double,kept:boolean>)")).schema
    return docs.select(utf8("text").alias("_quality_of"), *kept).mapInArrow(run, schema)
