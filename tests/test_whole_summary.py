from crawlwright.operators import dedupe as DD
from crawlwright.operators import graph as H
from crawlwright.operators import summary as S

PARTS = ("h1_mismatch", "canon_broken", "hidden_count", "image_slots", "orphan_blog", "redirects_permanent", "redirects_temporary",
         "not_found_pages", "sitemap_products", "scroll_only_count", "unlisted_count", "indexed_pct", "img_format_webp")


def test_summary_has_every_part(spark):
    from crawlwright.plans.q_work import whole_summary
    rows = whole_summary(spark, "/root/testdata/sf0.01").collect()  # the smallest tables have no site of ten live pages
    assert rows and all(sum(r[c] for r in rows) > 0 for c in PARTS)
    by_site = spark.createDataFrame(rows)
    codes = {r["code"] for r in S.diagnosis_points(by_site).collect()}
    assert {"h1_mismatch", "canon_broken", "hidden_count"} <= codes
    names = {r["metric"] for r in S.summary_long(by_site).collect()}
    assert set(PARTS) <= names


def test_coverage_and_canonicals(spark):
    """Twelve live pages of site a name one canonical; two are in the map without a link.  Site b has one sound page."""
    rows = [("a", i, f"https://a.com/blog/x-{i}", "blog", True, "ok", i < 2, i >= 2, "https://a.com/") for i in range(12)]
    rows.append(("b", 99, "https://b.com/blog/y", "blog", True, "ok", True, True, ""))
    audit = spark.createDataFrame(rows, "site string, seq long, url string, page_type string, available boolean, fetch_code string, "
                                        "in_map boolean, linked boolean, canonical_url string")
    cover = S.coverage_counters(H.coverage_report(audit), H.coverage_tables(audit)["orphan"])
    out = cover.join(DD.dedupe_pages(audit)[1], "site").na.fill(0)
    got = {r["site"]: (r["canon_broken"], r["hidden_count"], r["orphan_blog"], r["unlisted_count"]) for r in out.collect()}
    assert got == {"a": (11, 2, 2, 10), "b": (0, 0, 0, 0)}


def test_addresses_with_one_key_are_rows_of_their_own(spark, tmp_path):
    """Pages 22 and 132 are gone, their addresses differ after a '#' only; 26 and 156 have moved.  Every row counts."""
    import duckdb

    import __spark_entry__ as entry
    rows = [(i, f"# word{i} of a text.\nSecond line of it.", "en", f"src{i % 2}", 30) for i in (22, 132, 26, 156)] + [
        (i, f"Page {i} has a title.\nAnd a line below.", "en", f"src{i % 2}", 30) for i in range(1, 12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["site"]: (r["not_found_pages"], r["redirects_permanent"] + r["redirects_temporary"], r["redirects_total"])
           for r in entry.queries()["j1_summary_whole"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT site, not_found_pages, redirects_permanent + redirects_temporary, redirects_total FROM ({entry.oracle_sql()['j1_summary_whole']})").fetchall()
    assert got == {site: tuple(n) for site, *n in want}
    assert got["src0"] == (2, 2, 4)
