"""Runs of an audit: what is committed is seen, what broke off is not; odd pages stop no audit."""

import datetime as dt

import pytest

from crawlwright.operators.audit import run_audit
from crawlwright.sources import runs

AT = dt.datetime(2024, 5, 1)
LANDED = "site string, page_id bigint, url string, html string, status int, content_type string, final_url string, hops array<int>"
MAPS = "site string, file_url string, pos bigint, text string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), "site string, v int")


def put(spark, path, run, day, *values, commit=True):
    df = runs.write_table(rows(spark, *values), path, "t", run)
    if commit:
        runs.commit(df.select("site"), path, run, AT + dt.timedelta(days=day))


def seen(df):
    return sorted((r["site"], r["v"]) for r in df.collect())


def test_newest_run_of_each_site(spark, tmp_path):
    path = str(tmp_path)
    put(spark, path, "one", 0, ("a", 1), ("a", 2), ("b", 3))
    put(spark, path, "two", 1, ("a", 9))                       # a rerun of one site
    put(spark, path, "broken", 2, ("b", 7), commit=False)
    assert seen(runs.restore(spark, path, "t")) == [("a", 9), ("b", 3)]
    old = spark.createDataFrame([("a", "one"), ("b", "broken")], "site string, run_id string")
    assert seen(runs.restore(spark, path, "t", old)) == [("a", 1), ("a", 2)]
    put(spark, path, "two", 1, ("a", 8))                       # a replay replaces itself
    assert seen(runs.restore(spark, path, "t")) == [("a", 8), ("b", 3)]
    assert sorted((r["site"], r["run_id"]) for r in runs.list_runs(spark, path).collect()) == [("a", "one"), ("a", "two"), ("b", "one")]
    runs.compact(spark, path, ("t",), "whole", AT + dt.timedelta(days=3))
    assert seen(runs.restore(spark, path, "t")) == [("a", 8), ("b", 3)]
    assert {r["run_id"] for r in runs.newest(runs.list_runs(spark, path)).collect()} == {"whole"}


def test_new_columns_and_bad_names(spark, tmp_path):
    path = str(tmp_path)
    put(spark, path, "one", 0, ("a", 1))
    runs.write_table(spark.createDataFrame([("b", 2, "x")], "site string, v int, extra string"), path, "t", "two")
    runs.commit(rows(spark, ("b", 0), ("b", 1)).select("site"), path, "two", AT)
    assert sorted((r["site"], r["v"], r["extra"]) for r in runs.restore(spark, path, "t").collect()) == [("a", 1, None), ("b", 2, "x")]
    for name in ("2024-05-01", "a/b", ""):
        with pytest.raises(ValueError):
            put(spark, path, name, 0, ("a", 1))
    with pytest.raises(ValueError):
        runs.write_table(rows(spark, ("a", 1)).selectExpr("site", "'x' AS run_id"), path, "t", "three")


def test_audit_of_odd_pages(spark, tmp_path):
    page = "<html lang='en'><head><title>A lamp with a long and warm light</title></head><body><h1>A lamp</h1><a href='/products/two'>2</a></body></html>"
    base = ("x.com", 1, "https://x.com/products/one", page, 200, "text/html", "https://x.com/products/one", [])
    landed = spark.createDataFrame([
        base, base,                                                                         # a repeated row
        ("x.com", 2, "https://x.com/products/two", page, 200, None, None, None),            # no type, no final address, no hops
        ("x.com", 3, "https://x.com/gone", None, 404, None, "https://x.com/gone", []),
        ("x.com", 4, "https://x.com/products/old", page, 200, "text/html", "https://x.com/", [301]),
        ("x.com", 5, "https://x.com/empty", "", 200, "text/html", "https://x.com/empty", []),
        ("x.com", 6, "https://x.com/silent", None, None, None, None, None),
        ("y.com", 1, "https://y.com/%E0%A4%A", "<title>" + "w " * 200_000, 200, "", "", []),
        ("y.com", 2, None, None, None, None, None, None)], LANDED)
    maps = spark.createDataFrame([("x.com", "m", 0, "<urlset><loc>https://x.com/products/two</loc><loc>https://x.com/gone</loc></urlset>"),
                                  ("x.com", "m", 1, None)], MAPS)
    homes = spark.createDataFrame([("x.com", "https://x.com/"), ("z.com", "https://z.com/shop")], "site string, home_url string")
    out = run_audit(spark, landed, maps, str(tmp_path), "one", AT, homes)
    audit = {(r["site"], r["seq"]): r for r in out["audit"].collect()}
    codes = {k[1]: r["fetch_code"] for k, r in audit.items() if k[0] == "x.com"}
    assert codes == {1: "ok", 2: "ok", 3: "http_404", 4: "deleted_home", 5: "ok", 6: "conn_failed"}
    assert audit["x.com", 2]["in_map"] and audit["x.com", 2]["linked"] and not audit["x.com", 1]["linked"]
    assert audit["x.com", 2]["dup_content"] is False and audit["x.com", 2]["title_shared"] >= 2
    assert audit["x.com", 4]["page_type"] == "broken" and audit["x.com", 4]["title"] == "" and audit["x.com", 4]["link_type"] == "product"
    found = {r["site"]: r for r in out["summary"].collect()}
    assert found["x.com"]["redirects_home"] == 1 and found["x.com"]["not_found_pages"] == 1 and found["x.com"]["dead_count"] == 1
    assert {r["site"] for r in runs.list_runs(spark, str(tmp_path)).collect()} == {"x.com", "y.com"}


def test_audit_of_nothing(spark, tmp_path):
    out = run_audit(spark, spark.createDataFrame([], LANDED), spark.createDataFrame([], MAPS), str(tmp_path), "none", AT)
    assert all(df.count() == 0 for df in out.values()) and runs.list_runs(spark, str(tmp_path)).count() == 0
