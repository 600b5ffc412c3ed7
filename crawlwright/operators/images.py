"""Image tables, template images, repeated and misplaced alt texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlwright import constants as K
from crawlwright.functions.rank import first_per, flag_keys, number_by_range
from crawlwright.functions.text import folded_set, has_arabic, let, literal_array, lookup, strip, tokens, word_tokens
from crawlwright.functions.urls import image_stem, raw_host
from crawlwright.operators.grading import GENERIC_ALT, name_vocabulary
from crawlwright.session import stash

STORE_GENERIC = tuple(dict.fromkeys(GENERIC_ALT + folded_set(K.STORE_WORDS) + K.STORE_WORDS))
SET_TOKENS = tuple(dict.fromkeys(folded_set(K.SET_WORDS) + K.SET_WORDS))


def keep_images_of_live_pages(images: DataFrame, audit: DataFrame) -> DataFrame:
    """semi-join on the page URL."""
    return images.join(audit.select("site", F.col("url").alias("page_url")), ["site", "page_url"], "left_semi")


def size_variant_dedupe(images: DataFrame, platforms: DataFrame | None = None) -> DataFrame:
    """One row per page and size-free picture, for sites whose platform writes sizes into file names."""
    had = images.columns
    if platforms is None:
        df = images.withColumn("_platform", F.lit("shopify"))
    else:
        df = images.join(platforms.select("site", F.col("platform").alias("_platform")), "site", "left")
    stem = F.concat_ws("/", raw_host(F.col("image_url")), image_stem(F.col("image_url"), F.col("_platform")))
    # pictures of other platforms keep their row: their key is the row itself
    df = df.withColumn("_key", F.when(F.col("_platform") == "shopify", stem)
                       .otherwise(F.concat_ws("#", "image_url", "seq")))
    return first_per(df, ["site", "page_url", "_key"], [F.col("seq"), F.col("image_url")]).select(*had)


def drop_template_images(images: DataFrame, audit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images without template pictures, the template pictures with their page counts)."""
    pages = audit.where(F.col("available")).groupBy("site").agg(F.count("*").alias("n_pages")).where("n_pages >= 5")
    per_image = (images.select("site", "image_url", "page_url").distinct()
                 .groupBy("site", "image_url").agg(F.count("*").alias("image_pages")))
    template = per_image.join(pages, "site").where(F.col("image_pages") >= F.greatest(
        F.lit(float(K.TEMPLATE_IMAGE_MIN)), F.col("n_pages") * K.TEMPLATE_IMAGE_SHARE))
    return images.join(template, ["site", "image_url"], "left_anti"), template.select("site", "image_url", "image_pages")


def alt_duplicates(images: DataFrame) -> DataFrame:
    """An alt on three or more pages (first row per picture), or on two pictures of one non-product page."""
    slim = images.select("site", "image_url", "page_url", "alt", "alt_status", "seq")
    firsts = first_per(slim, ["site", "image_url"], [F.col("seq"), F.col("page_url")])
    dupes = (firsts.where("alt_status = 'alt_ok'").select("site", "alt", "page_url").distinct()
             .groupBy("site", "alt").agg(F.count("*").alias("n")).where(F.col("n") >= K.ALT_DUP_PAGES))
    dupes = stash(dupes, "dupes")       # read twice; alts that many slots share are few
    df = flag_keys(images, ["site", "alt"], dupes, "_dup", F.col("alt_status") == "alt_ok")
    df = df.withColumn("alt_status", F.when(F.col("_dup"), "alt_duplicate").otherwise(F.col("alt_status"))).drop("_dup")
    others = images.where((F.col("alt_status") == "alt_ok") & (F.col("page_type") != "product")).select(
        "site", "page_url", "alt", "image_url")
    same = (others.join(dupes, ["site", "alt"], "left_anti").distinct()
            .groupBy("site", "page_url", "alt").agg(F.count("*").alias("n")).where("n >= 2"))
    candidate = (F.col("alt_status") == "alt_ok") & (F.col("page_type") != "product")
    df = flag_keys(df, ["site", "page_url", "alt"], stash(same, "same"), "_same", candidate)
    return df.withColumn("alt_status", F.when(F.col("_same"), "alt_page_dup").otherwise(F.col("alt_status"))).drop("_same")


def store_tokens(names: DataFrame) -> DataFrame:
    """``(site, store)``: tokens of the brand and of the home page name, a handful per site."""
    return (names.select("site", F.explode(tokens(F.col("name"))).alias("t")).distinct()
            .groupBy("site").agg(F.collect_list("t").alias("store")))


def store_name_alts(images: DataFrame, names: DataFrame) -> DataFrame:
    """An alt made only of store tokens, generic words and numbers says nothing about the picture.

    Each distinct alt of a site is cut into tokens once; slots are marked by key.
    """
    judged = F.col("alt_status").isin("alt_ok", "alt_duplicate", "alt_page_dup")

    def only_store(toks):
        rest = F.array_except(F.array_except(toks, F.col("store")), literal_array(STORE_GENERIC))
        return (F.size(toks) > 0) & (F.size(rest) == 0) & F.arrays_overlap(toks, F.col("store"))
    empty = (images.where(judged).select("site", "alt").distinct().join(store_tokens(names), "site")
             .where(let(word_tokens(F.col("alt")), only_store)).select("site", "alt"))
    df = flag_keys(images, ["site", "alt"], stash(empty, "store_alts"), "_store", judged)
    return df.withColumn("alt_status", F.when(F.col("_store"), "alt_generic").otherwise(F.col("alt_status"))).drop("_store")


def _distinctive(c, common):
    return F.array_except(F.array_except(word_tokens(c), common), literal_array(GENERIC_ALT))


def _names_a_set(c):
    return F.coalesce(F.arrays_overlap(tokens(c), literal_array(SET_TOKENS)), F.lit(False))


def _may_be_wrong():
    return ((F.col("page_type") == "product") & F.col("alt_status").isin("alt_ok", "alt_duplicate")
            & F.coalesce(F.col("own_image"), F.lit(True)))


def wrong_product_slots(images: DataFrame, products: DataFrame, names: DataFrame) -> DataFrame:
    """G7c with F5: the image slots of product pages whose alt is almost the full name of another product.

    Names and alts repeat, so each distinct one of a site is cut into tokens once.  Equal token sets are folded
    first (on both sides), then an alt looks candidates up through its rarest tokens only: a name that shares 80 %
    of the alt must hold one of the ``n - ceil(0.8 n) + 1`` rarest, so frequent words never build pairs.  The first
    matching product by ``seq`` decides.  ``products`` has one row per page.  Only slots with such an alt meet the name of their page, and only pictures
    of slots that are wrong so far are looked for on other pages.
    """
    named = products.where(F.col("available") & (F.col("page_type") == "product")).select(
        "site", F.col("url").alias("page_url"), "seq", "name").where(strip(F.col("name")) != "")
    named = stash(named, "named")       # one row per page: read for the distinct names and by the slots
    shown = (named.groupBy("site", "name").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
             .select("site", "name", "seq", "n", strip(F.col("name")).alias("bare")))
    shown = stash(shown, "names")
    sites = shown.groupBy("site").agg(F.sum("n").alias("n")).where("n >= 2").select("site")
    vocab = name_vocabulary(shown.withColumn("page_type", F.lit("product")), "bare", "n")
    common = (sites.join(vocab, "site", "left").join(store_tokens(names), "site", "left")
              .select("site", F.array_union(F.coalesce("vocab", F.array().cast("array<string>")),
                                            F.coalesce("store", F.array().cast("array<string>"))).alias("common")))
    common = stash(common, "common")
    shown = stash(shown.join(common, "site").select(
        "site", "name", "seq", F.array_sort(_distinctive(F.col("bare"), F.col("common"))).alias("own"),
        _names_a_set(F.col("bare")).alias("is_set"), has_arabic(F.col("bare")).alias("arabic")), "own_tokens")
    # candidate names: one row per distinct token set, with the first product that carries it
    cand = (shown.where(F.size("own") >= 3).groupBy("site", F.col("own").alias("toks"))
            .agg(F.min("seq").alias("cseq")))
    df_tok = cand.select("site", F.explode("toks").alias("t")).groupBy("site", "t").agg(F.count("*").alias("df"))
    alts = (images.where(_may_be_wrong()).select("site", "alt").distinct().join(common, "site")
            .select("site", "alt", F.array_sort(_distinctive(F.col("alt"), F.col("common"))).alias("at"))
            .where(F.size("at") >= 3))
    alts = stash(alts, "alt_tokens")    # read by the lookup and by its result
    sets = alts.select("site", "at").distinct()
    ranked = (sets.select("site", "at", F.explode("at").alias("t")).join(df_tok, ["site", "t"], "left")
              .groupBy("site", "at").agg(F.array_sort(F.collect_list(
                  F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t"))).alias("r")))
    n = F.size("at")
    need = F.ceil(n * 8 / 10).cast("int")
    probes = ranked.select("site", "at", F.explode(F.slice("r", F.lit(1), n - need + 1)).alias("p")).select(
        "site", "at", F.col("p.t").alias("t"))
    index = cand.select("site", "toks", "cseq", F.explode("toks").alias("t"))
    shared = F.size(F.array_intersect("at", "toks"))
    found = (probes.join(index, ["site", "t"]).where((shared * 10 >= F.size("at") * 8)
                                                     & (shared * 10 >= F.size("toks") * 7))
             .groupBy("site", "at").agg(F.min(F.struct("cseq", "toks")).alias("m"))
             .select("site", "at", F.col("m.toks").alias("other")))
    verdict = stash(alts.join(found, ["site", "at"]).select(
        "site", "alt", "at", "other", has_arabic(F.col("alt")).alias("alt_arabic")), "verdict")
    # the token sets are looked up after slots and pages have met, so that they are not shuffled with them
    own = shown.where(~F.col("is_set") & (F.size("own") > 0)).select("site", "name", "own", "arabic")
    slots = (images.where(_may_be_wrong()).select("site", "page_url", "image_url", "alt", "own_image", "seq")
             .join(verdict, ["site", "alt"], "left_semi"))
    pages = named.select("site", "page_url", "name").join(own, ["site", "name"], "left_semi")
    own_n, other_n = F.size("own"), F.size("other")
    wrong = ((F.col("arabic") == F.col("alt_arabic")) & ~F.arrays_overlap("at", "own")
             & (F.size(F.array_intersect("own", "other")) * 2 < F.greatest(F.least(own_n, other_n), F.lit(1))))
    sus = stash(slots.join(pages, ["site", "page_url"]).join(verdict, ["site", "alt"]).join(own, ["site", "name"])
                .where(wrong).select("site", "page_url", "image_url", "alt", "own_image", "seq"), "suspects")
    sus = sus.where(~_names_a_set(F.col("page_url")))
    asked = sus.where("own_image IS NULL").select("site", "image_url").distinct()
    per_image = (images.select("site", "image_url", "page_url").join(asked, ["site", "image_url"], "left_semi").distinct()
                 .groupBy("site", "image_url").agg(F.count("*").alias("n")).where("n > 1"))
    return sus.join(per_image, ["site", "image_url"], "left").where(F.coalesce("own_image", F.col("n").isNull())).select(
        "site", "page_url", "image_url", "alt", "own_image", "seq")


def wrong_product_alts(images: DataFrame, products: DataFrame, names: DataFrame) -> DataFrame:
    """The images with ``alt_wrong_product`` for the slots that ``wrong_product_slots`` finds."""
    keys = ["site", "page_url", "image_url", "alt", "_own"]     # a slot that is the page's own says nothing about one that may not be
    own = F.col("own_image").isNotNull()
    marked = stash(wrong_product_slots(images, products, names).withColumn("_own", own).select(*keys), "wrong_slots")
    out = flag_keys(images.withColumn("_own", own), keys, marked, "_wrong", _may_be_wrong())
    return out.withColumn("alt_status", F.when(F.col("_wrong"), "alt_wrong_product").otherwise(
        F.col("alt_status"))).select(*images.columns)


def unique_images(images: DataFrame) -> DataFrame:
    """First row per picture plus the number of pages that show it."""
    pages = (images.select("site", "image_url", "page_url").distinct().groupBy("site", "image_url")
             .agg(F.count("*").alias("pages")))
    firsts = first_per(images, ["site", "image_url"], [F.col("seq"), F.col("page_url")])
    return firsts.join(pages, ["site", "image_url"])


def image_order(images: DataFrame, name: str = "no") -> DataFrame:
    """Work order of pictures per site: missing, generic, duplicate, stuffed, long, others; then page."""
    rank = lookup(F.col("alt_status"), K.ALT_ORDER, 9)
    return number_by_range(images.withColumn("_o", rank), ["site"],
                           [F.col("_o"), F.col("page_url"), F.col("seq"), F.col("image_url")], name).drop("_o")


