"""D1/D3 as column rules: what a page says with regular markup, without leaving the JVM.

``extract.py`` reads everything else (images, JSON-LD, scripts) with one Python pass per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlwright import constants as K
from crawlwright.functions.text import decode_entities, squeeze, strip, text_length
from crawlwright.functions.urls import (add_url_parts, clean_url, crawl_reject_reason, norm_host_of, resolve_href,
                                        url_key)
from crawlwright.operators.grading import grade_length

HREF = r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"


def _tag_text(html: Column, pattern: str) -> Column:
    return squeeze(decode_entities(F.regexp_replace(F.regexp_extract(html, pattern, 1), "<[^>]+>", " ")))


def html_title(html: Column) -> Column:
    return _tag_text(html, r"(?is)<title[^>]*>(.*?)</title>")


def html_h1(html: Column) -> Column:
    body = F.regexp_replace(html, r"(?is)<(?:header|nav)[^>]*>.*?</(?:header|nav)>", " ")
    return _tag_text(body, r"(?is)<h1[^>]*>(.*?)</h1>")


def html_lang(html: Column) -> Column:
    return F.substring(F.lower(F.regexp_extract(
        html, r"(?is)<html[^>]*\slang\s*=\s*[\"']?([^\"'\s>]+)", 1)), 1, 2)


def page_facts(pages: DataFrame) -> DataFrame:
    """One row per page: key, title, heading, language and title grade."""
    df = add_url_parts(pages.select("page_id", "url", "html"), "url").withColumns({
        "title": html_title(F.col("html")), "h1": html_h1(F.col("html")), "html_lang": html_lang(F.col("html"))})
    df = df.withColumn("title_len", text_length(F.col("title")).cast("bigint"))
    return df.select("page_id", "url", F.col("host").alias("site"), "url_key", "has_lang", "title", "h1", "html_lang",
                     "title_len", grade_length(F.col("title_len"), K.TITLE_BOUNDS).alias("title_status"))


def page_hrefs(pages: DataFrame) -> DataFrame:
    """Every ``<a href>`` resolved and cleaned: ``(site, page_id, src_key, dst_url)``, one row per page and target."""
    raw = (add_url_parts(pages.select("page_id", "url", "html"), "url")
           .select("page_id", "url", F.col("host").alias("site"), F.col("url_key").alias("src_key"),
                   F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href")))
    href = strip(F.col("href"))
    raw = raw.where((href != "") & ~href.rlike("^(?:mailto:|tel:|javascript:|#)"))
    return (raw.select("site", "page_id", "src_key",
                       clean_url(resolve_href(F.col("url"), F.col("href"))).alias("dst_url")).distinct())


def page_links(pages: DataFrame) -> DataFrame:
    """D3 (href part): the edge list ``(site, page_id, src_key, dst_url, dst_key)`` of followable links."""
    links = page_hrefs(pages)
    keep = crawl_reject_reason(F.col("dst_url"), F.col("site")) == ""
    return links.where(keep).withColumn("dst_key", url_key(F.col("dst_url")))


def filter_crawlable(links: DataFrame, sites: DataFrame | None = None, url_col: str = "url") -> DataFrame:
    """Adds ``reject_reason`` ('' = follow).  ``sites`` may give the platform of a site."""
    if sites is None:
        return links.withColumn("reject_reason", crawl_reject_reason(F.col(url_col), norm_host_of(F.col("site"))))
    df = links.join(sites.select("site", "platform"), "site", "left")
    return df.withColumn("reject_reason", crawl_reject_reason(
        F.col(url_col), norm_host_of(F.col("site")), F.coalesce("platform", F.lit("")))).drop("platform")
