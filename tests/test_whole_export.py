from crawlwright.operators import graph as H
from crawlwright.sources import sinks as K

NAMES = {"image_gap", "name_gap", "category_counters", "titles", "descs", "alt_missing", "alt_weak", "broken", "redirect_import"}


def test_bundle_has_every_output(spark):
    import __spark_entry__ as entry
    rows = {r["table_name"]: r["rows"] for r in entry.queries()["a13_export_bundle"](spark, "/root/testdata/sf0.01").collect()}
    assert NAMES <= set(rows) and all(rows[n] > 0 for n in NAMES)
    assert rows["broken"] >= rows["redirect_import"]


def test_structured_tables_are_the_rows_behind_the_report(spark):
    audit = spark.createDataFrame(
        [("s", 1, "u1", "product", True, "red cup", "red cup", 2, 1), ("s", 2, "u2", "product", True, "red cup", "blue hat", 1, 1),
         ("s", 3, "u3", "product", True, "", "blue hat", 5, 0), ("s", 4, "u4", "blog", True, "red cup", "blue hat", 5, 0)],
        "site string, seq long, url string, page_type string, available boolean, declared_name string, display_name string, "
        "declared_images long, total_images long")
    cats = spark.createDataFrame([("s", "c", 3, 1, 2)], "site string, url string, declared long, found long, missing long")
    out = H.structured_tables(audit, cats)
    report = H.structured_report(audit, cats).first()
    assert [r["url"] for r in out["image_gap"].collect()] == ["u1"] and report["image_gap"] == 1
    assert [r["url"] for r in out["name_gap"].collect()] == ["u2"] and report["name_mismatch"] == 1
    assert out["category_counters"].count() == report["categories_checked"] == 1


def test_import_only_for_platforms_that_take_one(spark):
    dead = spark.createDataFrame(
        [(s, i, f"https://{s}.com/products/{n}", "product", up, code, "", True, True, "", to, "", "") for s in ("a", "b") for i, n, up, code, to in
         [(1, "old", False, "http_404", f"https://{s}.com/products/new"), (2, "new", True, "ok", "")]],
        "site string, seq long, url string, link_type string, available boolean, fetch_code string, chain string, in_map boolean, linked boolean, "
        "final_url string, suggested_url string, found_on string, suggestion_conf string")
    platforms = spark.createDataFrame([("a", "zid"), ("b", "salla")], "site string, platform string")
    pages = spark.createDataFrame([], "site string, seq long, page_type string, url string, seo_score long, title_fix boolean, desc_fix boolean, "
                                      "title string, title_len long, meta_desc string, desc_len long, display_name string, title_status string, "
                                      "title_quality string, title_shared long, desc_status string, desc_quality string, desc_shared long")
    images = spark.createDataFrame([], "site string, seq long, page_url string, page_type string, image_url string, alt string, alt_status string, "
                                       "pages long")
    out = K.work_tables(pages, images, dead, platforms)
    assert [(r["site"], r["from_path"], r["to_path"]) for r in out["redirect_import"].collect()] == [("a", "/products/old", "/products/new")]
    assert out["broken"].count() == 2
