import gzip
import json

from pyspark.sql import functions as F

from crawlwright.operators import extract as X
from crawlwright.sources import sitemaps as SM

M = "https://oud-shop.store"


def facts(spark, html, url=M + "/", site="oud-shop.store"):
    return X.read_pages_html(spark.createDataFrame([(site, 1, url, html)], "site string, page_id long, url string, html string"))


def test_escaped_links(spark):
    h = (f'<a href="/products/Women-Leaves-Black-">x</a><script>var d={json.dumps({"u": M + "/products/copy-of-مبخرة"})};'
         f'var t={json.dumps({"t": "عروض 🔥"})};var c="{M}/products/copy-of-";</script><p>\\ud83d</p>')
    got = {r["dst_url"].split(".store")[1] for r in X.page_link_rows(facts(spark, h)).collect()}
    assert "/products/copy-of-مبخرة" in got and "/products/copy-of-" not in got and "/products/Women-Leaves-Black-" in got


def test_unescape_keeps_emoji_and_drops_half_pairs(spark):
    texts = {r"م 🔥 \ud83d https:\/\/x": "م 🔥  https://x", r"\ud83d\udd25 \u0645\u0639 \udd25 \n": "🔥 مع  \\n", "a\\/b": "a/b"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in df.select("t", X.unescape_script(F.col("t"))).collect()} == texts


def test_resized_lazy_and_noscript_images(spark):
    h = "".join(f'<img srcset="https://media.example.store/cdn-cgi/image/w=620,q=85/b/p{i}.jpg 620w, '
                f'https://media.example.store/cdn-cgi/image/w=1240/b/p{i}.jpg 1240w">' for i in range(3))
    got = [r["image_url"] for r in X.page_images(facts(spark, h)).orderBy("image_pos").collect()]
    assert got == [f"https://media.example.store/b/p{i}.jpg" for i in range(3)]
    h = '<img src="data:x" data-lazyload="https://c.com/a.jpg"><img src=""><noscript><img src="https://c.com/c.jpg"></noscript>'
    assert [r["image_url"] for r in X.page_images(facts(spark, h)).orderBy("image_pos").collect()] == ["https://c.com/a.jpg", "https://c.com/c.jpg"]


def test_declared_counts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["إجمالي 8 منتجات", "اجمالي ٣٥ منتج", "Total 120 products", "none"])], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(X.declared_count(F.col("t"))).collect()] == [8, 35, 120, None]


def test_boilerplate_and_product_facts(spark):
    ld = {"@type": "Product", "name": " Oud  box ", "image": [{"url": "https://c.com/x_800x.jpg"}], "brand": {"name": "B"}, "sku": 7}
    other = {"@type": "Product", "name": "Similar"}
    h = ('<html lang="AR-sa"><head><title>T</title></head><body><header class="site-header"><h1>Menu</h1>skip me</header>'
         f'<main><h1>Oud</h1>{"word " * 50}</main><script type="application/ld+json">{json.dumps([other, ld])}</script></body></html>')
    r = X.page_audit(facts(spark, h)).first()
    assert r["display_name"] == "Oud" and r["lang"] == "ar" and r["content_status"] == "good" and "skip" not in r["excerpt"]
    # a list is walked from its end
    assert r["declared_name"] == "Oud box" and r["brand"] == "B" and r["sku"] == "7" and r["html_signal"] == "product"


def test_meta_and_canonical(spark):
    h = ('<meta name="robots" content="NOINDEX"><meta property="og:description" content=" a  b ">'
         '<link rel="canonical" href="/products/y?x=1"><h1></h1><meta property="og:title" content="Shown">')
    r = X.page_audit(facts(spark, h, M + "/products/x")).first()
    assert (r["indexable"], r["meta_desc"], r["canonical_status"], r["display_name"]) == (False, "a b", "canon_diff", "Shown")
    assert r["canonical_url"] == M + "/products/y"


def test_sitemap_files(spark, tmp_path):
    site = tmp_path / "s.com"
    site.mkdir()
    (site / "a.xml.gz").write_bytes(gzip.compress(b"<urlset><loc> https://s.com/a?x=1&amp;y=2 </loc></urlset>"))
    (site / "b.xml").write_text("<urlset><loc><![CDATA[https://s.com/b]]></loc><loc></loc></urlset>")
    (site / "c.xml").write_text("sorry")
    got = {(r["file_url"], r["loc"]) for r in SM.sitemap_locs(SM.read_sitemap_files(spark, str(tmp_path))).collect()}
    assert got == {("s.com/a.xml.gz", "https://s.com/a?x=1&y=2"), ("s.com/b.xml", "https://s.com/b")}


def test_lists_read_from_html_are_computed_once_and_on_many_tasks(spark, sf):
    from crawlwright.plans import views as V
    pages = V.fx_html(spark, sf)
    assert pages.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    facts = X.read_pages_html(pages)
    for rows in (X.page_images(facts), X.page_link_rows(facts), X.listing_next(facts)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate posexplode" in plan and "Filter ((size(" not in plan
