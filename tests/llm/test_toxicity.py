import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlwright.llm import toxicity


def slow_segments(scores, offset=0):
    """By definition: the best run, then the same on both of its sides."""
    n = len(scores)
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    best = max(((sums[j] - sums[i], -(j - i), -i, i, j) for i in range(n) for j in range(i + 1, n + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    i, j = best[3], best[4]
    return slow_segments(scores[:i], offset) + [(offset + i, offset + j)] + slow_segments(scores[j:], offset + j)


def test_segments_like_the_definition():
    rng = random.Random(3)
    for _ in range(300):
        scores = np.array([rng.uniform(-1, .8) for _ in range(rng.randint(0, 24))])
        assert [s[:2] for s in toxicity.segments(scores)] == slow_segments(scores)


def test_segments_in_linear_time():
    saw = np.tile([1.0, -1.5], 200_000)
    assert len(toxicity.segments(saw)) == 200_000


@pytest.fixture(scope="module")
def data(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_held_out_accuracy(data):
    docs, labels = data
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    known = labels.select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, known.where(~held))
    got = toxicity.score(docs, model).join(known.where(held), "doc_id").toPandas()
    assert (got["predicted"] == got["label"]).mean() > 0.93
    assert got["predicted"][got["label"] == 1].mean() > 0.5 and got["predicted"][got["label"] == 0].mean() < 0.05
    clean = next(r["text"] for r in docs.join(known.where("label = 0"), "doc_id").where("lang = 'en' and n_chars > 1500").select("text").take(20)
                 if not model.passages(r["text"]))
    n = len(toxicity.WORD.findall(clean.lower()))
    (start, end, worth), = model.passages(clean + " you stupid worthless moron idiot and scum " + clean)
    assert n <= start < end <= n + 7 and worth > 0


def test_edges(spark, data):
    docs, labels = data
    known = labels.select("doc_id", F.col("toxic").alias("label"))
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "x", 9), (3, "word " * 50_000, 9), (3, "word " * 50_000, 9)], "doc_id bigint, text string, score int")
    model = toxicity.train(docs, known, sample_rows=400)
    rows = toxicity.score(df, model).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= .5) for r in rows)
    assert toxicity.score(df.limit(0), model).count() == 0
    clean = toxicity.train(docs, known.where("label = 0"))
    assert {r["predicted"] for r in toxicity.score(df, clean).collect()} == {0}
    assert toxicity.train(docs, known.where("label is null")).counts.sum() == 0


def test_sample_bound_holds_for_repeated_ids(spark, monkeypatch):
    """3,000 rows with one doc_id give one row of the sample."""
    from crawlwright.llm import common
    docs = spark.createDataFrame([(7, f"text {i} of one id") for i in range(3000)] + [(i, f"other text {i}") for i in range(8, 40)], "doc_id bigint, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(7, 40)], "doc_id bigint, label int")
    sizes, plain = [], common.one_each

    def counted(*args):
        out = plain(*args)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(toxicity, "one_each", counted)
    toxicity.train(docs, known, sample_rows=10)
    assert sizes == [10]
    assert common.one_each(docs, known).where("doc_id = 7").count() == 1
