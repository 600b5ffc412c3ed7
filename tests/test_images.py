from pyspark.sql import functions as F

from crawlwright.operators import grading as G
from crawlwright.operators import images as I
from crawlwright.operators import summary as S
from crawlwright.operators.grading import grade_alt

B = "https://s.com"
SCHEMA = "site string, seq long, page_url string, page_type string, image_url string, alt string, own_image boolean, alt_status string"


def names(spark):
    return spark.createDataFrame([], "site string, name string")


def test_alt_that_names_another_product(spark):
    products = ["طقم هدية قهوة زجاج وسيراميك", "غلاية من ستانليس ستيل", "أداة فتح المعلبات والقارورات 5 في 1 بنفسجي",
                "أداة فتح المعلبات والقارورات 5 في 1 برتقالي", "كوب قهوة النمو 350 مل", "كوب قهوة خزفي لون أخضر مطفي", "مفتاح علب ستانلس"]
    prods = spark.createDataFrame([("s", f"{B}/products/p{i}", i, n, True, "product") for i, n in enumerate(products)],
                                  "site string, url string, seq long, name string, available boolean, page_type string")
    alts = [(0, "غلاية من ستانليس ستيل"), (2, "أداة فتح المعلبات والقارورات 5 في 1 برتقالي"), (2, "مفتاح علب"), (4, "كوب قهوة خزفي لون أخضر")]
    images = spark.createDataFrame([("s", j, f"{B}/products/p{p}", "product", f"i{j}", a, True, "alt_ok") for j, (p, a) in enumerate(alts)], SCHEMA)
    got = I.wrong_product_alts(images, prods, names(spark)).orderBy("seq").collect()
    assert [r["alt_status"] for r in got] == ["alt_ok", "alt_ok", "alt_ok", "alt_wrong_product"]


def test_gallery_and_article(spark):
    rows = [("s", i, B + "/products/p1", "product", f"g{i}", "عباية كلوش", None, "alt_ok") for i in range(5)]
    rows += [("s", 10 + i, B + "/blog/x", "blog", f"b{i}", "عنوان المقال", None, "alt_ok") for i in range(3)]
    got = I.alt_duplicates(spark.createDataFrame(rows, SCHEMA)).orderBy("seq").collect()
    assert [r["alt_status"] for r in got] == ["alt_ok"] * 5 + ["alt_page_dup"] * 3


def test_same_alt_on_three_pages(spark):
    rows = [("s", i, f"{B}/products/p{i}", "product", f"g{i}", "one alt", None, "alt_ok") for i in range(3)]
    rows += [("s", 9, B + "/products/p1", "product", "h", "other alt", None, "alt_ok")]
    got = I.alt_duplicates(spark.createDataFrame(rows, SCHEMA)).orderBy("seq").collect()
    assert [r["alt_status"] for r in got] == ["alt_duplicate"] * 3 + ["alt_ok"]


def test_store_name_alts(spark):
    rows = [("s", 0, B, "home", "a", "شعار متجر لفتة", None, "alt_ok"), ("s", 1, B, "home", "b", "متجر لفتة 2", None, "alt_ok"),
            ("s", 2, B, "home", "c", "عباية لفتة", None, "alt_ok")]
    store = spark.createDataFrame([("s", "لفتة")], "site string, name string")
    got = I.store_name_alts(spark.createDataFrame(rows, SCHEMA), store).orderBy("seq").collect()
    assert [r["alt_status"] for r in got] == ["alt_generic", "alt_generic", "alt_ok"]


def test_template_reading(spark):
    audit = spark.createDataFrame([("s", i, f"https://z.com/products/p{i}", "product", True, f"t {i}", f"d {i}") for i in range(20)],
                                  "site string, seq long, url string, page_type string, available boolean, title string, meta_desc string")
    bad = spark.createDataFrame([("s", f"https://z.com/products/p{i}", "https://m.z/cdn-cgi/image/w=620") for i in range(20)],
                                "site string, page_url string, image_url string")
    good = spark.createDataFrame([("s", f"https://z.com/products/p{i}", f"https://m.z/{i}-{j}.jpg") for i in range(20) for j in range(2)],
                                 "site string, page_url string, image_url string")
    assert S.template_reading_checks(audit, bad).count() >= 2
    assert S.template_reading_checks(audit, good).count() == 0


def test_grade_alt_adds_length(spark):
    df = spark.createDataFrame([("  a  b ",)], "alt string")
    assert grade_alt(df).first()["alt_len"] == 3


def wrong_product_input(spark):
    products = ["copper lamp azure shade", "walnut chair low back", "marble table round top", "linen sofa deep seat", "glass vase tall neck"]
    prods = spark.createDataFrame([("s", f"{B}/products/p{i}", i, n, True, "product") for i, n in enumerate(products)],
                                  "site string, url string, seq long, name string, available boolean, page_type string")
    # picture i0 is on two pages: the first slot is the page's own, of the second nobody knows, the third is known to be another's
    rows = [("s", 0, f"{B}/products/p0", "product", "i0", products[1], True, "alt_ok"),
            ("s", 1, f"{B}/products/p0", "product", "i0", products[1], None, "alt_ok"),
            ("s", 2, f"{B}/products/p0", "product", "i0", products[1], False, "alt_ok"),
            ("s", 3, f"{B}/blog/x", "blog", "i0", products[1], None, "alt_ok"),
            ("s", 4, f"{B}/products/p2", "product", "i1", products[3], None, "alt_duplicate"),
            ("s", 5, f"{B}/products/p2", "product", "i2", products[2], None, "alt_ok")]
    return spark.createDataFrame(rows, SCHEMA), prods


def test_a_slot_of_unknown_origin_is_not_judged_by_another_of_the_same_picture(spark):
    images, prods = wrong_product_input(spark)
    got = I.wrong_product_alts(images, prods, names(spark)).orderBy("seq").collect()
    assert [r["alt_status"] for r in got] == ["alt_wrong_product", "alt_ok", "alt_ok", "alt_ok", "alt_wrong_product", "alt_ok"]
    assert sorted(r["seq"] for r in I.wrong_product_slots(images, prods, names(spark)).collect()) == [0, 4]


def test_token_rules_run_over_distinct_alts_and_not_over_slots(spark):
    images, prods = wrong_product_input(spark)
    store = spark.createDataFrame([("s", "copper")], "site string, name string")
    for df in (I.store_name_alts(images, store), I.wrong_product_alts(images, prods, store)):
        plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "regexp" not in plan and "rlike" not in plan and "lambda" not in plan


def test_repeated_alts_get_the_grades_of_single_ones(spark):
    alts = ["  a  b ", None, "", "  ", "image", "copper lamp azure shade", "copper lamp azure shade", "a.jpg"]
    df = spark.createDataFrame(list(enumerate(alts)), "seq long, alt string")
    assert G.grade_repeated_alts(df).orderBy("seq").collect() == grade_alt(df).orderBy("seq").collect()


def test_vocabulary_of_counted_names(spark):
    rows = [("s", "product", "lamp copper"), ("s", "product", "lamp azure")] * 3 + [("s", "product", "vase")] * 2 + [("s", "product", "-")]
    each = spark.createDataFrame(rows, "site string, page_type string, display_name string")
    counted = each.groupBy("site", "page_type", "display_name").agg(F.count("*").alias("n"))
    one, many = G.name_vocabulary(counted, pages="n").first(), G.name_vocabulary(each).first()
    assert sorted(one["vocab"]) == sorted(many["vocab"]) == ["azure", "copper", "lamp", "vase"]
