import math

import numpy as np
import pytest

from crawlwright.llm import topk


def slow(rows, k=10, every=100):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in good if i % every == 0}:
        best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def check(spark, rows):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, rank int")
    assert sorted(map(tuple, topk.search(df).collect())) == slow(rows)


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    assert sorted(map(tuple, topk.search(df).collect())) == slow(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, -7.25]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (100, [inf, 1.0]),
            (200, [-0.0001, 900.5]), (None, [1.0, 1.0]), (300, [1.0]), (400, [3.0]), (500, []), (600, []), (700, [0.0, 0.0])]
    check(spark, rows)
    check(spark, [])
    check(spark, [(0, [0.5])])


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "signs"])
def test_blocks_like_brute_force(kind):
    rng = np.random.default_rng(4)
    rows = {"normal": lambda: rng.normal(0, 128, (3000, 24)), "ties": lambda: rng.integers(-1, 2, (3000, 5)),
            "wide": lambda: rng.normal(0, 1, (3000, 8)) * 10.0 ** rng.integers(0, 6, (3000, 1)), "signs": lambda: rng.choice([-77, 77], (3000, 6))}[kind]()
    rows = np.floor(rows).astype(np.int64)
    ids = rng.permutation(3000)
    index, touched = topk.Index(ids, rows), 0
    for i in range(0, 3000, 150):
        got = index.top(int(ids[i]), rows[i], 10)
        scores = rows @ rows[i]
        want = sorted((-s, j) for s, j in zip(scores.tolist(), ids.tolist()) if j != ids[i])[:10]
        assert list(zip((-got[1]).tolist(), got[0].tolist())) == want
