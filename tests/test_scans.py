"""Alerts by scan: over midnight, twice a day, over restarts, out of order."""

import datetime as dt
import random

import numpy as np
import pytest

from crawlwright.streaming import jobs as S
from crawlwright.streaming import scans as SC

LOG = "site string, ts timestamp, fetch_code string"


@pytest.fixture()
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", SC.STORE)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def run(spark, folder, parts, gap=1800):
    """Every part is a run of its own, so each is a restart."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, LOG).coalesce(1).write.parquet(f"{folder}/in/b{i}")
        stream = spark.readStream.schema(LOG).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        S.append_table(SC.scan_alerts(stream, gap), f"{folder}/out").awaitTermination()
    return sorted((r["site"], r["scan_start"], r["rejects"], r["home_redirects"], r["first_sign"]) for r in spark.read.parquet(f"{folder}/out/table").collect())


def at(day, hour, minute):
    return dt.datetime(2024, 1, day, hour, minute)


def test_scans_over_midnight_and_restarts(rocks, tmp_path):
    first = [("s", at(1, 23, 40), "http_429"), ("s", at(1, 23, 55), "http_429"), ("t", at(1, 8, 0), "http_429"), ("t", at(1, 8, 10), "http_429")]
    second = [("s", at(2, 0, 10), "http_429"), ("s", at(2, 0, 20), "http_429"), ("t", at(1, 23, 59), "http_429")]  # t: another scan, two refusals are forgotten
    third = [("s", at(2, 0, 30), "http_429"), *[("s", at(2, 9, m), "deleted_home") for m in range(5)], ("s", at(2, 9, 7), "http_403"), ("u", None, "http_429")]
    got = run(rocks, str(tmp_path), [first, second, third])
    assert got == [("s", at(1, 23, 40), 4, 0, at(1, 23, 40)), ("s", at(2, 9, 0), 0, 5, at(2, 9, 0))]


def test_state_is_dropped(rocks, tmp_path):
    """A closed scan is gone: the same site starts from nothing, days later."""
    parts = [[("s", at(1, 8, 0), "http_429"), ("s", at(1, 8, 1), "http_429")], [("s", at(3, 8, 0), "ok")], [("s", at(3, 8, 1), "http_429")],
             [("s", at(3, 8, 2), "http_429"), ("s", at(3, 8, 3), "http_429")]]
    assert run(rocks, str(tmp_path), parts) == [("s", at(3, 8, 0), 3, 0, at(3, 8, 1))]


def test_chunks_in_any_order():
    """Scans of chunks, joined, are the scans of all rows."""
    rng = random.Random(4)
    rows = [(rng.randrange(100_000), rng.random() < 0.2, rng.random() < 0.2) for _ in range(400)]
    whole = SC.scans_of(*(np.array(c) for c in zip(*rows)), 300)
    some = []
    for i in range(0, 400, 37):
        some = SC.joined(some + SC.scans_of(*(np.array(c) for c in zip(*rows[i:i + 37])), 300), 300)
    assert some == whole and len(whole) > 20
