"""Streams over several batches, with late rows and a restart."""

import datetime as dt

from pyspark.sql import functions as F

from crawlwright.streaming import jobs as S

LOG = "site string, key string, seq bigint, ts timestamp, fetch_code string"


def rows(*items):
    return [("s", f"k{i}", i, dt.datetime(2024, 1, 1, h, m), code) for i, (h, m, code) in enumerate(items)]


def land(spark, folder, name, part):
    spark.createDataFrame(part, LOG).coalesce(1).write.parquet(f"{folder}/{name}")


def test_windows_over_restarts(spark, tmp_path):
    first = rows((8, 5, "ok"), (8, 50, "http_429"), (9, 10, "ok"))
    second = rows((9, 8, "http_404"), (9, 20, "http_429"), (10, 0, "ok"))  # the first is late, within the delay
    too_late = rows((8, 1, "ok"))  # its window closed when 10:00 was seen
    for i, part in enumerate((first, second, too_late)):
        land(spark, tmp_path / "in", f"b{i}", part)
        stream = spark.readStream.schema(LOG).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        S.start_versions(S.health_counts(S.late_tolerant(stream)), str(tmp_path / "out")).awaitTermination()
    got = {r["window_start"].hour: (r["fetches"], r["ok"], r["gone"], r["rate_limited"])
           for r in S.newest_versions(spark, str(tmp_path / "out"), ["site", "window_start"]).collect()}
    assert got == {8: (2, 1, 0, 1), 9: (3, 1, 1, 1), 10: (1, 1, 0, 0)}


def test_alerts_count_refusals_only(spark):
    log = spark.createDataFrame(rows((1, 0, "http_429"), (2, 0, "http_403"), (3, 0, "http_429"), (4, 0, "http_403")), LOG)
    assert S.reject_alerts(log).count() == 0
    log = spark.createDataFrame([(*r, r[2] == 1) for r in rows((1, 0, "http_429"), (2, 0, "ok"), (3, 0, "http_429"))], LOG + ", challenge boolean")
    assert S.reject_alerts(log).first()["rejects"] == 3


def test_page_tables_over_restarts_equal_the_batch_job(spark, tmp_path, sf):
    from crawlwright.operators import extract as X
    from crawlwright.plans import views as V
    schema, folder = "site string, page_id long, url string, html string", str(tmp_path / "out")
    odd = spark.createDataFrame([("s1.example.com", -1, "https://s1.example.com/x", None), ("s1.example.com", -2, "https://s1.example.com/y", "")], schema)
    pages = V.fx_html(spark, sf).where("page_id <= 90").withColumn("site", F.concat("site", F.lit(".example.com"))).select(*odd.columns).unionByName(odd)
    for n in range(3):
        pages.where(F.pmod("page_id", F.lit(3)) == n).coalesce(1).write.parquet(str(tmp_path / f"in/b{n}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        S.start_page_audit(stream, folder).awaitTermination()
    S.PAGE_TABLES["links"](X.read_pages_html(pages)).write.parquet(f"{folder}/links/batch=99")  # broke off before its commit
    facts = X.read_pages_html(pages).cache()
    for name, build in S.PAGE_TABLES.items():
        want = sorted(map(str, build(facts).collect()))
        got = S.audited(spark, folder, name)
        assert {r["batch"] for r in got.select("batch").distinct().collect()} == {0, 1, 2}
        assert sorted(map(str, got.select(*build(facts).columns).collect())) == want and want


def test_a_table_of_many_files_is_streamed_whole(spark, tmp_path, sf):
    from crawlwright.plans import q_stream as Q
    from crawlwright.plans.registry import QUERIES
    def table(folder, schema, name, out):
        return sorted(map(str, S.read_after(S.append_table(S.landing_stream(spark, folder, schema, name), out), spark, out).collect()))

    parts = str(tmp_path / "in")
    for name, schema in (("pages", Q.PAGES), ("events", Q.EVENTS)):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(f"{parts}/{name}.parquet")
        got, want = (table(folder, schema, f"{name}.parquet", str(tmp_path / f"{kind}-{name}")) for kind, folder in (("parts", parts), ("file", sf)))
        assert got == want != []
    for name in ("s4_stream_page_audit", "s5_stream_link_counts"):
        assert sorted(map(str, QUERIES[name](spark, parts).collect())) == sorted(map(str, QUERIES[name](spark, sf).collect()))
