import datetime as dt

from pyspark.sql import functions as F

from crawlwright.operators import texts as T
from crawlwright.operators import worklists as W
from crawlwright.sources import sinks as K


def test_chunks_lose_no_row(spark, tmp_path):
    df = spark.range(1725).select(F.lit("s").alias("site"), F.col("id").alias("seq"), F.concat(F.lit("https://m.z/a b "), "id").alias("image_url"))
    sizes = K.assign_chunks(df, ["site"], "seq", "x").groupBy("file_name").count().orderBy(F.desc("count"), "file_name").collect()
    assert [r["count"] for r in sizes] == [500, 500, 500, 225] and sizes[-1]["file_name"] == "x_1501-1725.csv"
    K.write_chunked_csv(df, str(tmp_path / "out"), ["site"], "seq", "x")
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.count() == 1725 and back.where("image_url LIKE '% %'").count() == 0


def quote(spark, **kw):
    s = spark.createDataFrame([("s", 48, 30, 81, 0, 3)], "site string, fix_titles_urls long, fix_descs long, missing_alts long, weak_alts long, "
                                                        "broken_actionable long")
    return W.build_quote(s, **kw).first()


def test_prices(spark):
    assert quote(spark, services=("image_alt",))["total"] == 405
    q = quote(spark, package=True)
    assert q["reference"] == 1296 and q["total"] == 1990      # 162 units
    df = spark.createDataFrame([(62,), (3296,)], "units long")
    assert [r["package_price"] for r in W.volume_tiers(df).collect()] == [990.0, None]
    sizes = spark.createDataFrame([(2,), (10,), (20,), (3000,)], "n long").select(W.sample_size(F.col("n"))).collect()
    assert [r[0] for r in sizes] == [2, 3, 5, 10]


def test_phase_parts(spark):
    rows = spark.range(81).select(F.lit("s").alias("site"), F.lit("titles").alias("table_name"), F.col("id").alias("seq"))
    got = {r["phase"]: r["count"] for r in W.split_phases(rows, 2).groupBy("phase").count().collect()}
    assert got == {1: 41, 2: 40}
    few = {r["seq"]: r["phase"] for r in W.split_phases(rows.where("seq < 2"), 3).collect()}
    assert few == {0: 1, 1: 2}


def test_service_phases(spark):
    """Every set of services with 1 to 4 phases: the phases of the services other than broken links, which always come first."""
    import itertools
    tables = {"titles": "titles", "descs": "descs", "images": "alt_weak", "broken": "broken"}
    phases = {0: {1: "", 2: "", 3: "", 4: ""}, 1: {1: "1", 2: "1", 3: "1", 4: "1"}, 2: {1: "11", 2: "12", 3: "12", 4: "12"},
              3: {1: "111", 2: "112", 3: "123", 4: "123"}}
    sets = [c for k in range(1, 5) for c in itertools.combinations(tables, k)]
    df = spark.createDataFrame([("-".join(c), tables[s], 0) for c in sets for s in c], "site string, table_name string, seq long").cache()
    for n in (1, 2, 3, 4):
        got = {(r["site"], r["table_name"]): r["phase"] for r in W.split_by_service(df, n).collect()}
        for c in sets:
            others = [s for s in c if s != "broken"]
            want = dict(zip(others, phases[len(others)][n])) | {"broken": "1"}
            assert {s: str(got[("-".join(c), tables[s])]) for s in c} == {s: want[s] for s in c}, (c, n)


def test_title_suffix(spark):
    def mode(hits, n):
        df = spark.createDataFrame([("s", i, f"item {i}" + (" | متجر عودي" if i < hits else "")) for i in range(n)], "site string, seq long, title string")
        r = T.detect_title_suffix(df).first()
        return r["mode"], r["core_min"], r["core_max"]
    assert mode(25, 48)[0] == "add" and mode(95, 98) == ("auto", 38, 48) and mode(0, 10) == ("none", 50, 60)


def test_edits(spark):
    saved = spark.createDataFrame([("m.s", "u", "عنوان", "و" * 130, "", "", "ok", False)],
                                  "site string, id string, title string, description string, title_notes string, desc_notes string, status string, edited boolean")
    edits = spark.createDataFrame([("m.s", "u", 1, "عنوان قصير")], "site string, id string, seq long, text string")
    r = T.apply_edits(saved, edits).first()
    assert r["title"] == "عنوان قصير" and r["title_notes"].startswith("title_length") and r["edited"] and r["status"] == "review"
    assert T.keep_edited(T.apply_edits(saved, edits)).count() == 1


def test_similar_texts(spark):
    df = spark.createDataFrame([("مبخرة خشبية صغيرة", "مبخرة خشبية صغيره"), ("abc", "xyz"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(T.too_similar("a", "b")).collect()] == [True, False, False]


def test_client_sample_is_the_greedy_walk(spark):
    texts = ["red oud box one", "red oud box 0ne", "blue lamp", "green chair", "blue lamp!", "white desk"]
    rows = spark.createDataFrame([("s", i, f"n{i % 4}", t, "ok") for i, t in enumerate(texts)], "site string, seq long, name string, proposed string, status string")
    need = spark.createDataFrame([("s", 12)], "site string, total long")
    got = [r["seq"] for r in T.client_sample(rows, need).orderBy("pos").collect()]
    assert got == [0, 2, 3]


def test_history(spark, tmp_path):
    scans = spark.createDataFrame([("a", 1, dt.datetime(2024, 1, 1), 50.0, 2), ("a", 2, dt.datetime(2024, 2, 1), 60.0, 1)],
                                  "site string, scan_id long, scan_date timestamp, score double, total_pages long")
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 2, "z")], "site string, scan_id long, url string")
    K.append_history(scans, rows, str(tmp_path))
    s, r = K.read_history(spark, str(tmp_path))
    assert [x["scan_id"] for x in K.list_history(s).collect()] == [2, 1]
    assert [(x["url"], x["available"]) for x in K.restore_history(s, r).select("url", "available").collect()] == [("z", True)]


def test_export_writes_every_table(spark, tmp_path):
    a = spark.createDataFrame([("s", 1, "u", "product")], "site string, seq long, url string, page_type string")
    tables = K.export_tables(a, a)
    K.write_tables(tables, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "pages_product")).count() == 1
    assert {r["table_name"]: r["rows"] for r in K.count_tables(tables).collect()}["full_audit"] == 1


def test_suggestions_are_judged_as_they_will_show(spark):
    core, desc = "x" * 45, "d" * 130
    rows = [("s", 1, "a", core, desc, "old", "", "", "", "title,desc", " | Shop", "plain"),
            ("s", 2, "b", "y" * 37 + " | Shop name", desc + "e", "old", "", "", "", "title,desc", " | Shop name", "plain"),
            ("s", 3, "c", "z" * 36 + " discount", desc + "f", "old", "", "", "", "title,desc", " | Shop", "Summer deals"),
            ("s", 4, "d", "w" * 36 + " discount", desc + "g", "old", "", "", "", "title,desc", " | Shop", "plain")]
    df = spark.createDataFrame(rows, "site string, seq long, id string, title string, description string, current_title string, current_desc string, "
                                     "source_text string, fixed_title string, need string, suffix string, name string")
    got = {r["id"]: r["title_notes"] for r in T.validate_suggestions(df, ratio=False).collect()}
    assert got == {"a": "", "b": "title_length:49", "c": "", "d": "promo"}
    assert {r["id"]: r["title_notes"] for r in T.validate_suggestions(df.drop("suffix", "name"), ratio=False).collect()}["a"] == "title_length:45"


def test_alt_edits(spark):
    schema = "site string, id string, alt string, alt_notes string, status string, edited boolean"
    saved = spark.createDataFrame([("s", "a", "a wooden bowl", "", "ok", False), ("s", "b", "Photo of it all", "copied", "review", False),
                                   ("s", "c", None, "", "review", None), ("s", "d", "a second bowl", "", "ok", False)], schema)
    edits = spark.createDataFrame([("s", "a", 1, "older text of it"), ("s", "a", 2, " a bowl of dark wood "), ("s", "b", 3, "Photo of it all"),
                                   ("s", "c", 4, "Image of a bowl"), ("s", "d", 5, None), ("s", "none", 6, "not saved")], "site string, id string, seq long, text string")
    got = {r["id"]: tuple(r)[2:] for r in T.apply_alt_edits(saved, edits).collect()}
    assert got == {"a": ("a bowl of dark wood", "", "ok", True), "b": ("Photo of it all", "copied", "review", False),
                   "c": ("Image of a bowl", "says_image", "review", True), "d": ("", "alt_length:0", "review", True)}


def test_alt_file(spark):
    items = spark.createDataFrame([("s", "i1", "p", "Bowl", "product", "bad", 1), ("s", "i2", "p", "Bowl", "product", None, 2), ("s", "i3", "p", "Bowl", "product", "", 3)],
                                  "site string, image_url string, page_url string, name string, page_type string, alt string, seq long")
    sug = spark.createDataFrame([("s", "i1", "a wooden bowl", ""), ("s", "i2", "", ""), ("t", "i3", "of another site", "")],
                                "site string, id string, alt string, alt_notes string")
    assert [tuple(r) for r in T.compact_alt_file(items, sug).collect()] == [("s", 1, "Bowl", "p", "i1", "bad", "a wooden bowl", "")]
    states = {r["image_url"]: (r["proposal_state"], r["proposed_len"]) for r in T.alts_before_after(items, sug, only_found=False).collect()}
    assert states == {"i1": ("ok", 13), "i2": ("not_generated", None), "i3": ("not_generated", None)}


def test_checks_that_a_scan_tells(spark):
    from crawlwright.operators import summary as S
    base = "'salla' AS platform, 50L AS total_urls, false AS partial, 1L AS files_ok, 50L AS live_pages, 0L AS unreachable_pages, 0L AS suspicious_home, " \
           "false AS home_suspicious, 0L AS template_issues, 40L AS store_total, 40L AS products, 0L AS unclassified, 40L AS product_pages, 40L AS products_with_images"
    facts = spark.sql(f"SELECT 'a' AS site, {base}, true AS retry_aborted, true AS auto_gentle, 7L AS cache_hits, 3L AS template_images "
                      f"UNION ALL SELECT 'b', {base}, NULL, false, 0L, NULL UNION ALL SELECT 'c', {base}, false, false, 0L, 0L")
    signs = spark.createDataFrame([("c", "truncated_image_urls", 4), ("c", "one_title_on_most_pages", 30), ("gone", "truncated_image_urls", 1)], "site string, check string, n long")
    checks = S.self_checks(facts, signs)
    got = {}
    for r in checks.orderBy("site", "ord", "check").collect():
        got.setdefault(r["site"], []).append((r["check"], r["level"], r["value"]))
    assert set(got) == {"a", "b", "c"}
    assert {("retry_stopped", "warn", 1.0), ("gentle_mode", "pass", 1.0), ("resumed", "pass", 7.0), ("template_images", "pass", 3.0), ("template", "pass", 0.0)} <= set(got["a"])
    assert not {c[0] for c in got["b"]} & {"retry_stopped", "gentle_mode", "resumed", "template_images"}
    assert [c for c in got["c"] if c[1] == "warn"] == [("one_title_on_most_pages", "warn", 30.0), ("truncated_image_urls", "warn", 4.0)]
    assert {r["site"]: r["verdict"] for r in S.verdicts(checks).collect()} == {"a": "review", "b": "ready", "c": "review"}
    assert S.self_checks(facts.drop("retry_aborted", "auto_gentle", "cache_hits", "template_images")).where("site = 'a'").count() == 9


def test_feed_descriptions_of_products_named_like_the_borrowed_slug(spark, tmp_path):
    from crawlwright.plans.registry import QUERIES
    import crawlwright.plans.catalog  # noqa: F401
    spark.createDataFrame([(59, "blue bolt", "Brand#1", "ECONOMY"), (60, "blue bolt", "Brand#1", "SMALL"), (62, "blue bolt", "Brand#1", "SMALL")],
                          "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["seq"]: r["product_desc"] for r in QUERIES["a9_merge_product_descriptions"](spark, str(tmp_path)).collect()}
    assert got == {59: "economy", 60: "blue bolt " * 4, 62: "blue bolt small & brand#1"}
