import random
import zlib

from crawlwright.llm import sharding


def test_schedule_is_longest_first():
    placed = sharding.schedule([("a", 7), ("b", 6), ("c", 5), ("d", 4), ("e", 3)], 2)
    assert placed == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 0}  # 7 | 6, 5 to the lower load, then 4 and 3 to 7


def check(rows, got, shards):
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted(
        (d is None, d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert {(r["law"], r["grown_shard"]) for r in got} <= {("bytes", None)} and all(0 <= r["shard"] < shards for r in got)
    for s in range(shards):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    by = {}
    for r in got:
        by.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in by.values())


def test_whole_table(spark, documents):
    got = sharding.shard_documents(documents).collect()
    check([tuple(r) for r in documents.select("doc_id", "text").collect()], got, 8)
    loads = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(loads) - min(loads) <= max(r["size"] for r in got)


def test_hot_group_and_edges(spark):
    rng = random.Random(0)
    rows = [(i, "copy " * 20) for i in range(3000)] + [(i, f"text {i} " * rng.randint(1, 40)) for i in range(3000, 9000)]
    rows += [(9000, None), (9001, ""), (None, None), (7, "copy " * 20), (7, "copy " * 20), (9002, "long " * 50_000)]
    df = spark.createDataFrame([(d, t, 9, "x") for d, t in rows], "doc_id bigint, text string, shard int, size string")
    got = sharding.shard_documents(df, units=64, slot_rows=500).collect()
    check(rows, got, 8)
    loads = sorted(sum(r["size"] for r in got if r["shard"] == s) for s in range(8))
    total = sum(loads)
    hot = [total * 0 + sum(r["size"] for r in got if r["size"] == 101), 250_001]
    assert loads[-1] <= max(max(hot), total / 8) + total / 64 * 2 + 250_001
    assert sharding.shard_documents(df.limit(0)).count() == 0
