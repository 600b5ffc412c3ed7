"""Inputs beyond any former limit: deep walks, long texts, large counts, entities and dots."""

from pyspark.sql import functions as F

from crawlwright.functions.text import decode_entities
from crawlwright.functions.urls import resolve_href
from crawlwright.operators import extract as X
from crawlwright.operators import graph as H
from crawlwright.operators.classify import platform_of
from crawlwright.sources import feeds
from crawlwright.sources import sitemaps as S


def test_twelve_clicks(spark):
    edges = spark.createDataFrame([("s", str(i), str(i + 1)) for i in range(12)] + [("s", "12", "0")], "site string, src string, dst string")
    got = H.reachability(edges, spark.createDataFrame([("s", "0")], "site string, key string")).collect()
    assert {r["key"]: r["clicks"] for r in got} == {str(i): i for i in range(13)}


def test_seven_sitemap_levels(spark):
    files = spark.createDataFrame([("s", f"https://s/sitemap-{i}.xml", 0, f"<sitemapindex><loc>https://s/sitemap-{i + 1}.xml</loc></sitemapindex>")
                                   for i in range(7)], "site string, file_url string, pos bigint, text string")
    got = S.expand_sitemap_index(files, files.limit(1).select("site", F.lit("https://s/sitemap-0.xml").alias("file_url"))).collect()
    assert sorted(r["depth"] for r in got) == list(range(8))


def test_frontier_and_blog_roots_are_whole(spark):
    links = spark.createDataFrame([("s", f"k{i}", f"u{i}", i) for i in range(200)], "site string, key string, url string, seq bigint")
    got = H.frontier(links, links.where("seq < 50")).collect()
    assert sorted(r["pos"] for r in got) == list(range(1, 151))
    rows = spark.createDataFrame([("s", f"https://s.com/blog/tag/t{i}", i, True, "archive") for i in range(60)],
                                 "site string, url string, seq bigint, available boolean, page_type string")
    assert sorted(r["pos"] for r in H.blog_roots(rows).collect()) == list(range(1, 61))


def test_dots_of_any_depth(spark):
    df = spark.createDataFrame([("../../../../../../x",), ("../x/./y/../z?q=../a",), ("./../..",), ("a/b/../../../../c",), ("p..q/r",), ("?a=/../b",)], "h string")
    got = [r[0] for r in df.select(resolve_href(F.lit("https://s.com/a/b/c/d/e/f/g"), F.col("h"))).collect()]
    assert got == ["https://s.com/x", "https://s.com/a/b/c/d/e/x/z?q=../a", "https://s.com/a/b/c/d/", "https://s.com/a/b/c/d/c",
                   "https://s.com/a/b/c/d/e/f/p..q/r", "https://s.com/a/b/c/d/e/f/g?a=/../b"]


def test_entities(spark):
    texts = {"&#1593;&#x637;&#1585;": "عطر", "caf&eacute; &amp; th&#233;": "café & thé", "&amp;lt;": "&lt;", "a &unknown; b & c": "a &unknown; b & c",
             "&#0;&#xD800;&#99999999;": "&#0;&#xD800;&#99999999;", "&#128512;&nbsp;x&quot;&apos;&#39;": "\U0001F600 x\"''", "plain": "plain", "&Eacute;&eacute;": "Éé"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in df.select("t", decode_entities(F.col("t"))).collect()} == texts


def test_counts_after_long_text_in_either_script(spark):
    far = "x " * 5000
    df = spark.createDataFrame([("عدد المنتجات: ٤١٢",), ("٤١٢ منتج",), (far + "120,000 products",), ("showing 1-24 of 250000",)], "t string")
    assert [r[0] for r in df.select(X.declared_count(F.col("t"))).collect()] == [412, 412, 120000, 250000]


def test_long_feed_texts_and_late_platform_signs(spark):
    dump = spark.createDataFrame([("s", '{"products":[{"handle":"a","title":"t","body_html":"' + "word " * 2000 + 'end"}]}')], "site string, json_text string")
    assert feeds.read_product_feed(dump).first()["description"].endswith("end")
    late = spark.createDataFrame([("y" * 300_000 + "cdn.salla.network",)], "h string")
    assert late.select(platform_of(F.col("h"), F.lit(""), F.lit(""))).first()[0] == "salla"


def test_listing_replies(spark):
    replies = {'{"html":"<b>\\u0639\\u0637\\u0631<\\/b>"}': "<b>عطر</b>", '{"products":[{"n":"<i>"}],"x":"https:\\/\\/s\\/\\u0639"}': '{"products":[{"n":"<i>"}],"x":"https://s/ع"}',
               '{"data":{"a":1},"content":"<p>x</p>"}': "<p>x</p>", "{broken <b>": "{broken <b>", "<p>a\\/b</p>": "<p>a/b</p>"}
    df = spark.createDataFrame([(r, "") for r in replies], "body string, content_type string")
    assert {r["body"]: r["listing_text"] for r in X.listing_payload_text(df).collect()} == replies


def test_image_rows_carry_the_page_type_and_resized_copies_count_once(spark):
    ld = '{"@type":"Product","name":"n","offers":{"price":1},"image":["https://c.com/cdn-cgi/image/w=1/a.jpg","https://c.com/a.jpg#x"]}'
    html = f'<img src="/a.jpg"><script type="application/ld+json">{ld}</script>'
    df = spark.createDataFrame([("s.com", 1, "https://s.com/blog/some-news", html), ("s.com", 2, "https://s.com/x/p12345", html)],
                               "site string, page_id long, url string, html string")
    facts = X.read_pages_html(df)
    assert {r["seq"]: r["page_type"] for r in X.page_images(facts).collect()} == {1: "product", 2: "product"}
    assert {(r["declared_images"], r["offers"]) for r in X.page_audit(facts).collect()} == {(1, True)}
    plain = X.read_pages_html(df.withColumn("html", F.lit('<img src="/a.jpg">')))
    assert {r["seq"]: r["page_type"] for r in X.page_images(plain).collect()} == {1: "blog", 2: "product"}


def test_a_fetch_log_in_one_file_is_classified_on_many_tasks(spark, sf):
    from crawlwright.plans import views as V
    assert V.fx_fetch_log(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
