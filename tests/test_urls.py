from pyspark.sql import functions as F

from crawlwright.functions import urls as U
from crawlwright.operators.classify import classify_pages, decisive_type, listing_kind
from crawlwright.operators.urlsets import preferred_url

B = "https://s.com"


def col(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, url string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("url"))).collect()]


def test_spellings_of_one_page_share_a_key(spark):
    keys = col(spark, ["http://www.s.com/%D8%B9%D8%A8%D8%A7%D9%8A%D8%A9/p1234567/", B + "/ar/عباية/p1234567?utm=1",
                       B + "/عباية/p1234567"], U.url_key)
    assert keys == ["s.com/#p1234567"] * 3
    a, b = col(spark, [B + "/ar-sa/products/Snow-White", B + "/products/snow-white"], U.url_key)
    assert a == b
    a, b, c = col(spark, [B + "/categories/1689986/", B + "/categories/1689986/عروض", B + "/categories/51962/سرير"], U.url_key)
    assert a == b != c


def test_decode_keeps_what_is_not_an_escape(spark):
    assert col(spark, ["a%20b+c", "50%off%zz", "%D8%B9"], U.percent_decode) == ["a b+c", "50%off%zz", "ع"]


def test_decisive_type_and_listing_kind(spark):
    def over(fn, name, paths):
        df = spark.createDataFrame([(i, B + p) for i, p in enumerate(paths)], "i int, url string")
        return [r[name] for r in fn(df).orderBy("i").collect()]
    assert over(decisive_type, "decisive_type", ["/x/brand-1460042538", "/blog/m/a-12345", "/x/page-5555", "/products/y"]) == [
        "category", "blog", "info", "product"]
    assert over(decisive_type, "decisive_type", ["/blog/tag/x", "/blog", "/about", "/"]) == ["", "", "", ""]
    assert over(listing_kind, "listing_kind", ["/x/brand-146004", "/latest-products", "/c/c1906874517", "/brands", "/brands/a"]) == [
        "brand", "listing", "category", "listing", "brand"]


def test_page_types(spark):
    cases = {"/": "home", "/en": "home", "/a/p123": "product", "/blog": "archive", "/blog/category-3": "archive",
             "/blog/شروط-الاستخدام": "info", "/blog/افضل-شركات-الشحن-في-الرياض": "blog", "/pages/x": "info", "/سياسة-الخصوصية": "info",
             "/tag/x": "archive", "/2020": "archive", "/x-p-9": "product", "/عباية": "unknown", "/department/x": "category"}
    df = spark.createDataFrame([(p, B + p) for p in cases], "p string, url string")
    got = {r["p"]: r["page_type"] for r in classify_pages(df, home_url=F.lit(B)).collect()}
    assert got == cases


def test_html_signal_decides_open_cases(spark):
    df = spark.createDataFrame([(B + "/x1", "product"), (B + "/x2", "article"), (B + "/x3", "collection"), (B + "/blog/x4", "product")],
                               "url string, sig string")
    assert [r["page_type"] for r in classify_pages(df, signal=F.col("sig")).orderBy("url").collect()] == [
        "product", "product", "blog", "category"]


def test_platform_rules_stay_with_their_platform(spark):
    df = spark.createDataFrame([("https://s.com/products/x.oembed",), ("https://s.com/products/x&via=y",), ("https://s.com/products/x",)],
                               "url string")
    def rejected(platform):
        c = U.crawl_reject_reason(F.col("url"), F.lit("s.com"), F.lit(platform))
        return [r[0] != "" for r in df.select(c).collect()]
    assert rejected("shopify") == [True, True, False]
    assert rejected("zid") == [False, False, False]


def test_preferred_url(spark):
    rows = [(B + "/ar/categories/12", 0), (B + "/categories/12", 1), (B + "/categories/12/cups", 2), (B + "/a/p1234", 3), (B + "/bb/p1234", 4)]
    out = {r["url_key"]: r["url"] for r in preferred_url(spark.createDataFrame(rows, "url string, seq long")).collect()}
    assert out == {"s.com/#cat12": B + "/categories/12/cups", "s.com/#p1234": B + "/a/p1234"}


def test_resolve_href(spark):
    df = spark.createDataFrame([("/a",), ("b",), ("../c",), ("//x.com/y",), ("?page=2",), ("https://z.com/q",)], "h string")
    got = [r[0] for r in df.select(U.resolve_href(F.lit("https://s.com/d/e/f?x=1"), F.col("h"))).collect()]
    assert got == ["https://s.com/a", "https://s.com/d/e/b", "https://s.com/d/c", "https://x.com/y", "https://s.com/d/e/f?page=2",
                   "https://z.com/q"]


def test_image_names(spark):
    assert col(spark, ["https://c.com/photo_1600x.jpg", "https://c.com/a-620x400.webp?x", "https://c.com/b_thumb.png"],
               lambda c: U.image_stem(c, F.lit("shopify"))) == ["photo", "a", "b"]
    assert col(spark, ["https://m.z/cdn-cgi/image/w=620,q=85/b/p1.jpg", "https://m.z/cdn-cgi/image/w=1/https://o.com/x.png#f"],
               U.clean_image_url) == ["https://m.z/b/p1.jpg", "https://o.com/x.png"]
    assert col(spark, ["https://m.z/a.JPEG", "https://m.z/a?fm=webp", "https://m.z/a"], U.image_format) == ["jpg", "webp", "—"]
