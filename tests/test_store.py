"""The keyed store: many batches, merges, replays, a batch that broke off, retention, nulls."""

import datetime as dt
import os
import random

import pytest

from crawlwright.streaming.store import KeyedStore

SCHEMA = "site string, key string, seq bigint, ts timestamp, v string"
DAY = dt.datetime(2024, 1, 1)


def rows(n, seed=1):
    r = random.Random(seed)
    return [("s" if r.random() < 0.7 else None, f"k{r.randrange(12)}", r.choice([i, i, i, None]), DAY + dt.timedelta(minutes=i), f"v{i}") for i in range(n)]


def opened(spark, folder, **more):
    store = KeyedStore(str(folder), spark.createDataFrame([], SCHEMA).schema, ["site", "key"], **more)
    store._open(spark)
    return store


def as_set(df):
    return {tuple(r) for r in df.collect()}


def walked(parts, newest=True):
    """The plain walk: a dictionary that the rows pass through; later batches win ties, nulls lose."""
    best = {}
    for n, part in enumerate(parts):
        for r in part:
            rank = ((-1 if r[2] is None else r[2]) if newest else 0, n)
            if r[:2] not in best or rank >= best[r[:2]][0]:
                best[r[:2]] = (rank, r)
    return {r for _, r in best.values()}


def files(folder):
    return sum(len(d) for _, d, _ in os.walk(folder))


def test_every_batch_equals_the_plain_walk(spark, tmp_path):
    store, parts = opened(spark, tmp_path, newest="seq", every=3, keep=2), []
    assert store.read(spark).count() == 0 and store.done(spark) == -1
    items = [(*r[:2], i, *r[3:]) for i, r in enumerate(rows(70))]  # no ties within a batch
    random.Random(3).shuffle(items)  # late rows do not win
    for n in range(14):
        parts.append(items[5 * n:5 * n + 5])
        store.write(spark.createDataFrame(parts[-1], SCHEMA), n)
        assert len(store.parts(n)) <= 3  # the base and fewer deltas than a merge takes
        assert as_set(store.read(spark)) == walked(parts)
        if n == 9:
            folders = files(tmp_path)
    assert files(tmp_path) == folders  # a ring: further batches make no further folders


def test_nulls_in_the_order_lose(spark, tmp_path):
    store = opened(spark, tmp_path, newest="seq", every=2)
    for n, seq in enumerate([7, None, 5]):
        store.write(spark.createDataFrame([("s", "k", seq, DAY, f"v{n}")], SCHEMA), n)
    assert store.read(spark).first()["v"] == "v0"


def test_replays_change_nothing(spark, tmp_path):
    store, parts = opened(spark, tmp_path, every=2), [[("s", "a", 1, DAY, "x")], [("s", "a", 1, DAY, "y"), ("s", "b", 1, DAY, "z")]]
    for n, part in enumerate(parts):
        store.write(spark.createDataFrame(part, SCHEMA), n)
    before = as_set(store.read(spark))
    store.write(spark.createDataFrame([("s", "c", 9, DAY, "other")], SCHEMA), 1)  # committed: a replay writes nothing
    assert as_set(store.read(spark)) == before == walked(parts, newest=False)


def test_a_batch_that_broke_off_is_not_seen_and_can_be_replayed(spark, tmp_path, monkeypatch):
    store = opened(spark, tmp_path, every=2)
    store.write(spark.createDataFrame([("s", "a", 1, DAY, "x")], SCHEMA), 0)

    def lost(*_):
        raise RuntimeError("driver lost")
    part = spark.createDataFrame([("s", "a", 2, DAY, "y")], SCHEMA)
    for step in ("_merge", "_commit"):  # before the merge, and after it but before the state row
        with monkeypatch.context() as m:
            m.setattr(store, step, lost)
            with pytest.raises(RuntimeError):
                store.write(part, 1)
        assert [r["v"] for r in store.read(spark).collect()] == ["x"] and store.done(spark) == 0
    store.write(part, 1)
    assert [r["v"] for r in store.read(spark).collect()] == ["y"] and store.parts(1) == [store.base(1)]


def test_a_merge_drops_what_is_too_old(spark, tmp_path):
    store = opened(spark, tmp_path, newest="seq", every=2, retain=("ts", 24 * 3600))
    old, edge, new = DAY, DAY + dt.timedelta(hours=1), DAY + dt.timedelta(hours=25)
    store.write(spark.createDataFrame([("s", "old", 1, old, "o"), ("s", "edge", 2, edge, "e"), ("s", "no time", 3, None, "n")], SCHEMA), 0)
    assert store.read(spark).count() == 3  # only a merge drops
    store.write(spark.createDataFrame([("s", "new", 4, new, "w")], SCHEMA), 1)
    assert {r["key"] for r in store.read(spark).collect()} == {"edge", "no time", "new"}


def test_a_stream_over_restarts(spark, tmp_path):
    items, parts = [(*r[:2], i, *r[3:]) for i, r in enumerate(rows(36, 5))], []
    for n in range(6):
        parts.append(items[6 * n:6 * n + 6])
        spark.createDataFrame(parts[-1], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/b{n}"))
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        store = KeyedStore(str(tmp_path / "out"), stream.schema, ["site", "key"], newest="seq", every=2)
        store.start(stream).awaitTermination()
        assert as_set(store.read(spark)) == walked(parts) and store.done(spark) == n


def test_link_counts_over_restarts_equal_the_batch_job(spark, tmp_path, sf):
    from crawlwright.streaming import jobs as S
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    for n in range(3):
        pages.where(f"page_id % 3 = {n}").coalesce(1).write.parquet(str(tmp_path / f"in/b{n}"))
        stream = spark.readStream.schema(pages.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        counts = S.link_counts(stream)
        store = S.link_count_store(counts, str(tmp_path / "out"), every=2)
        store.start(counts, "update").awaitTermination()
    assert store.done(spark) == 2 and len(store.parts(2)) == 2
    assert as_set(store.read(spark)) == as_set(S.link_counts(pages))
