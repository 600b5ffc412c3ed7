import numpy as np
import pytest

from crawlwright.llm import quality


@pytest.fixture(scope="module")
def data(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    return docs, labels.select("doc_id", quality.grade_of(labels).alias("grade"), "quality")


def test_held_out(data):
    docs, rated = data
    model = quality.train(docs, rated.where("doc_id % 3 <> 0"))
    assert np.all(np.diff(model.thresholds) > 0)
    got = quality.score(docs, model).join(rated.where("doc_id % 3 = 0"), "doc_id").select("quality", "grade", "quality_score.*").toPandas()
    assert (got["kept"] == (got["quality"] == 1)).mean() > 0.95
    assert got["expected_grade"].between(0, 2).all() and got["kept"][got["quality"] == 1].mean() > 0.97
    assert got.groupby("grade")["expected_grade"].mean().is_monotonic_increasing


def test_ordinal_likelihood_finds_the_thresholds():
    """Grades drawn from the model itself: weights and thresholds come back."""
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, 6000)
    score, cuts = 6 * x, np.array([1.5, 4.0])
    grades = (rng.logistic(size=6000) + score > cuts[0]).astype(int)
    noise = rng.logistic(size=6000)
    grades = (score + noise > cuts[0]).astype(int) + (score + noise > cuts[1]).astype(int)
    model = quality.fit([(np.array([5]), np.array([v])) for v in x], grades, 3)
    assert abs(model.weights[5] - 6) < 0.8 and np.abs(model.thresholds - cuts).max() < 0.5


def test_edges(spark, data):
    docs, rated = data
    model = quality.train(docs, rated, sample_rows=200)
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x y", "c"), (3, "w " * 50_000, "d"), (3, "w " * 50_000, "d")],
                               "doc_id bigint, text string, quality_score string")
    rows = quality.score(df, model).collect()
    assert len(rows) == 5 and all(0 <= r["quality_score"]["tail"] <= 1 for r in rows)
    assert quality.score(df.limit(0), model).count() == 0
    # without ratings, or with one grade, nothing is rejected by chance
    for part, kept in (("grade is null", True), ("grade = 2", True), ("grade = 0", False)):
        model = quality.train(docs, rated.where(part))
        assert {r["quality_score"]["kept"] for r in quality.score(df, model).collect()} == {kept}


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

    monkeypatch.setattr(quality, "one_each", counted)
    quality.train(docs, known.withColumnRenamed('label', 'grade'), sample_rows=10)
    assert sizes == [10]
    assert common.one_each(docs, known).where("doc_id = 7").count() == 1
