import random

from pyspark.sql import functions as F

from crawlwright.functions.rank import first_per, flag_keys, number_by_range, number_rows, top_k, with_group_size


def rows(spark, n=400):
    rnd = random.Random(7)
    # one site holds most rows
    data = [("hot" if i % 3 else f"s{i % 4}", i, rnd.choice([None, 1, 2, 3]), f"u{rnd.randrange(50)}") for i in range(n)]
    rnd.shuffle(data)
    return data, spark.createDataFrame(data, "site string, seq long, score int, name string").repartition(5)


def expected(data, key):
    out, per = {}, {}
    for r in sorted(data, key=key):
        per[r[0]] = per.get(r[0], 0) + 1
        out[(r[0], r[1])] = per[r[0]]
    return out


def test_number_rows_equals_a_plain_walk(spark):
    data, df = rows(spark)
    want = expected(data, lambda r: (r[0], r[2] is None, r[2] or 0, r[1]))
    for width in (3, 1 << 20):
        got = {(r["site"], r["seq"]): r["n"] for r in number_rows(df, ["site"], [F.col("score")], "seq", "n", width=width).collect()}
        assert got == want


def test_number_by_range_equals_a_plain_walk(spark):
    data, df = rows(spark)
    want = expected(data, lambda r: (r[0], r[3], r[1]))
    got = {(r["site"], r["seq"]): r["n"] for r in number_by_range(df, ["site"], [F.col("name"), F.col("seq")], "n").collect()}
    assert got == want


def test_first_top_size_and_flags(spark):
    data, df = rows(spark)
    firsts = {r["name"]: r["seq"] for r in first_per(df, ["name"], [F.col("seq")]).collect()}
    assert firsts == {n: min(r[1] for r in data if r[3] == n) for n in {r[3] for r in data}}
    best = top_k(df, ["site"], [F.col("seq")], 2).groupBy("site").agg(F.max("seq").alias("m")).collect()
    assert {r["site"]: r["m"] for r in best} == {s: sorted(r[1] for r in data if r[0] == s)[1] for s in {r[0] for r in data}}
    sized = with_group_size(df, ["site", "name"], "n", F.col("score").isNotNull())
    for r in sized.collect():
        n = sum(1 for x in data if x[0] == r["site"] and x[3] == r["name"] and x[2] is not None)
        assert r["n"] == (max(n, 1) if r["score"] is not None else 1)
    marked = flag_keys(df, ["name"], df.where("seq < 5"), "f", F.col("score") == 1)
    names = {r[3] for r in data if r[1] < 5}
    assert all(r["f"] == (r["score"] == 1 and r["name"] in names) for r in marked.collect())
