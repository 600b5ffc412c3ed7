"""Page types, platforms, languages and fixed titles as column rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlwright import constants as K
from crawlwright.functions.rank import first_per
from crawlwright.functions.text import folded_set, fold_arabic, let, literal_array, text
from crawlwright.functions.urls import (clean_url, decisive_from, is_tag_url, listing_kind_from, normalize_url,
                                        percent_decode, url_key, url_parts)

POLICY_TOKENS = folded_set([part for w in K.POLICY_WORDS for part in w.split("-")])


def _seg_tokens(seg: Column) -> Column:
    parts = F.filter(F.split(F.lower(seg), "[-_]+"), lambda t: t != "")
    return F.filter(F.transform(parts, fold_arabic), lambda t: F.length(t) > 2)


def _policy_hits(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*POLICY_TOKENS)))


def page_type_from(low: Column, key: Column, home_key: Column, tag_url: Column, signal: Column) -> Column:
    """C1 as one ordered CASE over prepared columns."""
    first = F.coalesce(F.try_element_at(low, F.lit(1)), F.lit(""))
    last = F.coalesce(F.try_element_at(low, F.lit(-1)), F.lit(""))
    before = F.slice(low, 1, F.greatest(F.size(low) - 1, F.lit(0)))
    path = F.array_join(low, "/")
    n = F.size(low)
    sig = text(signal)

    def any_of(arr: Column, words) -> Column:
        return F.coalesce(F.arrays_overlap(arr, literal_array(words)), F.lit(False))

    in_blog = any_of(low, K.BLOG_SEGMENTS)
    blog_slug = F.when(last.rlike("^[a-z]?-?[0-9]+$") & (n >= 2), F.try_element_at(low, F.lit(-2))).otherwise(last)
    blog_toks = _seg_tokens(blog_slug)
    mostly_policy = (F.size(blog_toks) > 0) & (_policy_hits(blog_toks) * 2 > F.size(blog_toks))
    has_policy = F.exists(low, lambda s: _policy_hits(_seg_tokens(s)) > 0)
    blog_type = (F.when(last.isin(*K.BLOG_SEGMENTS) | ((first == "blogs") & (n == 2)), "archive")
                 .when(last.rlike(K.CATEGORY_ID_PATTERN) | last.rlike(K.ARCHIVE_LAST_PATTERN)
                       | any_of(before, K.ARCHIVE_PARENTS), "archive")
                 .when(sig == "article", "blog").when(sig == "product", "product")
                 .when(mostly_policy, "info").otherwise("blog"))
    return (F.when(tag_url, "archive")
            .when((n == 0) | (key == home_key), "home")
            .when(last.rlike(K.PRODUCT_ID_PATTERN), "product")
            .when(~in_blog & any_of(before, K.PRODUCT_ROOTS), "product")
            .when(last.rlike(K.INFO_ID_PATTERN), "info")
            .when(first.isin(*K.INFO_ROOTS) & (n >= 2), "info")
            .when(in_blog, blog_type)
            .when(last.rlike(K.BRAND_ID_PATTERN) | last.rlike(K.CATEGORY_ID_PATTERN)
                  | path.isin(*K.CATALOG_ROOTS) | any_of(low, K.CATEGORY_SEGMENTS), "category")
            .when(sig == "product", "product").when(sig == "article", "blog").when(sig == "collection", "category")
            .when(last.rlike(K.ARCHIVE_LAST_PATTERN) | last.rlike("^[0-9]{4}$") | any_of(before, K.ARCHIVE_PARENTS),
                  "archive")
            .when(has_policy, "info")
            .when(F.contains(path, F.lit("-p-")) | path.rlike("[-/]p-?[0-9]{4,}$"), "product")
            .when(path.rlike("[-/]c-?[0-9]{4,}$"), "category")
            .otherwise("unknown"))


def classify_pages(df: DataFrame, url_col: str = "url", home_url: Column | None = None,
                   signal: Column | None = None, name: str = "page_type") -> DataFrame:
    """Add the page type of ``url_col``.  ``home_url`` is the site's home, ``signal`` what the HTML declares."""
    home = F.lit("") if home_url is None else url_key(normalize_url(home_url))
    known = F.struct(url_parts(F.col(url_col)).alias("p"), is_tag_url(clean_url(F.col(url_col))).alias("tag"),
                     home.alias("home"), (F.lit("") if signal is None else signal).alias("signal"))
    return df.withColumn(name, let(known, lambda k: page_type_from(
        k["p"]["low"], k["p"]["url_key"], k["home"], k["tag"], k["signal"])))


def decisive_type(df: DataFrame, url_col: str = "url", name: str = "decisive_type") -> DataFrame:
    """C2."""
    return df.withColumn(name, let(url_parts(F.col(url_col))["low"], decisive_from))


def regrade_saved(audit: DataFrame) -> DataFrame:
    """Stored rows get today's decisive type and content grade."""
    had = audit.columns
    work = decisive_type(audit, "url", "_t")
    return work.withColumns({
        "page_type": F.when(F.col("available") & ~F.col("page_type").isin("home", "broken") & (F.col("_t") != ""),
                            F.col("_t")).otherwise(F.col("page_type")),
        "content_status": F.when(F.col("available") & F.col("content_status").isin("good", "thin"),
                                 F.when(F.coalesce(F.col("word_count"), F.lit(0)) >= K.THIN_WORDS, "good")
                                 .otherwise("thin")).otherwise(F.col("content_status"))}).select(*had)


def listing_kind(df: DataFrame, url_col: str = "url", name: str = "listing_kind") -> DataFrame:
    """C4."""
    return df.withColumn(name, let(url_parts(F.col(url_col))["low"], listing_kind_from))


def platform_of(html: Column, headers: Column, url: Column) -> Column:
    blob = F.concat_ws(" ", F.lower(text(html)), F.lower(text(headers)),
                       F.lower(text(url)))
    def first_sign(b: Column) -> Column:
        out = None
        for platform, signs in K.PLATFORM_SIGNS:
            hit = F.contains(b, F.lit(signs[0]))
            for s in signs[1:]:
                hit = hit | F.contains(b, F.lit(s))
            out = F.when(hit, platform) if out is None else out.when(hit, platform)
        return out.otherwise("unknown")
    return let(blob, first_sign)


def detect_platform(home_pages: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """``(site, platform)``: a manual hint, else the first home page that shows a known platform."""
    rows = home_pages.select("site", "seq", platform_of(F.col("html"), F.col("headers"), F.col("url")).alias("platform"))
    found = first_per(rows, ["site"], [F.col("platform") == "unknown", F.col("seq")]).select("site", "platform")
    if hints is None:
        return found
    return (found.join(hints.select("site", F.col("platform").alias("_hint")), "site", "left")
            .select("site", F.coalesce("_hint", "platform").alias("platform")))


def language_of(html_lang: Column, sample: Column) -> Column:
    code = F.substring(F.lower(F.trim(text(html_lang))), 1, 2)
    ar = F.length(F.regexp_replace(text(sample), r"[^\x{0600}-\x{06FF}]", ""))
    la = F.length(F.regexp_replace(text(sample), "[^A-Za-z]", ""))
    return (F.when(code != "", code).when((ar == 0) & (la == 0), "—").when(ar >= la, "ar").otherwise("en"))


NEVER_FIXED = ("product", "category", "home", "blog")


def fixed_title_from(url: Column, low: Column, title: Column, page_type: Column, lang: Column) -> Column:
    """The known title of policy, contact and blog-index pages, or ''."""
    english = F.lower(text(lang)).startswith("en")
    whole = F.concat_ws(" ", F.array_join(low, " "), F.lower(percent_decode(url)), F.lower(text(title)))
    blog_index = (F.size(low) == 1) & F.coalesce(F.try_element_at(low, F.lit(1)).isin(*K.BLOG_SEGMENTS), F.lit(False))
    out = (F.when(page_type.isin(*NEVER_FIXED), "")
           .when(blog_index, F.when(english, K.BLOG_INDEX_TITLE[1]).otherwise(K.BLOG_INDEX_TITLE[0])))
    return out.otherwise(let(whole, lambda hay: _titled(hay, english)))


def _titled(hay: Column, english: Column) -> Column:
    out = None
    for words, arabic, latin in K.FIXED_TITLES:
        hit, name = hay.rlike("|".join(words)), F.when(english, latin).otherwise(arabic)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("")


def fixed_page_title(audit: DataFrame, name: str = "fixed_title") -> DataFrame:
    # the URLs of types that never have a fixed title are not parsed
    found = let(url_parts(F.col("url"))["low"], lambda low: fixed_title_from(
        F.col("url"), low, F.col("title"), F.col("page_type"), F.col("lang")))
    return audit.withColumn(name, F.when(F.col("page_type").isin(*NEVER_FIXED), "").otherwise(found))


