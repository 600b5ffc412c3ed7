"""One audit from landed pages to reports: A2, C1, C5, D1-D4, F1, F2, G1-G10, H2-H3, I1-I2, J1, J2, J8 in their order.

Two layers are written: ``facts`` (what each page says, HTML read once), then ``pages``, ``images``, ``links`` and ``next_pages``
made of it; ``audit`` (graded pages), ``graded_images`` and small reports made of those.  Every step reads the columns it needs from
the files of the step before, so an executor that is lost costs its own tasks only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlwright.functions.text import strip, text
from crawlwright.functions.urls import clean_url, url_key
from crawlwright.operators import dedupe as DD
from crawlwright.operators import extract as X
from crawlwright.operators import grading as G
from crawlwright.operators import graph as H
from crawlwright.operators import images as I
from crawlwright.operators import redirects as R
from crawlwright.operators import summary as S
from crawlwright.operators.classify import classify_pages, detect_platform
from crawlwright.session import cut
from crawlwright.sources import runs
from crawlwright.sources.sitemaps import collect_sitemap_urls, sitemap_locs

FETCH = ("req_url", "status", "content_type", "final_url", "hops", "home_url")
OUTCOME = ("fetch_code", "available", "moved", "final_url", "chain", "home_url")
SAID = ("title", "meta_desc", "display_name", "declared_name", "sku", "declared_brand", "category", "product_desc", "excerpt", "html_signal")
COUNTED = ("word_count", "total_images", "declared_images")


def read_facts(landed: DataFrame) -> DataFrame:
    """A2 and D1-D5 in one pass over the HTML, without a shuffle.

    ``landed``: site, page_id, url (requested), html, status, content_type, final_url, hops, home_url.  Addresses in a page are
    relative to where it was served.  A null or empty final address means the requested one.
    """
    served = F.when(text(F.col("final_url")) != "", F.col("final_url")).otherwise(F.col("url"))
    pages = landed.withColumns({"req_url": F.col("url"), "url": clean_url(served), "final_url": served})
    facts = X.read_pages_html(pages, FETCH).withColumn("canonical_url", F.col("canonical"))
    return R.classify_fetch(facts).drop("canonical_url", "status", "content_type", "hops")


def page_rows(facts: DataFrame, sitemap_keys: DataFrame, links: DataFrame) -> DataFrame:
    """Raw page rows: D1's columns, outcome, C1's type and the F2 flags.  Pages that did not answer say nothing (empty texts, zero counts)."""
    up = F.col("available")
    df = X.page_audit(facts, ("req_url", *OUTCOME)).withColumnsRenamed({"page_id": "seq", "brand": "declared_brand"})
    df = df.withColumns({"url": F.when(up, F.col("url")).otherwise(clean_url(F.col("req_url"))),
                         **{c: F.when(up, F.col(c)).otherwise("") for c in SAID},
                         **{c: F.when(up, F.col(c)).otherwise(0).cast("bigint") for c in COUNTED},
                         "h1_match": F.when(up, F.col("h1_match")).otherwise("match_na")})
    df = classify_pages(df, home_url=F.col("home_url"), signal=F.col("html_signal"))
    df = classify_pages(df, "req_url", home_url=F.col("home_url"), name="link_type")
    df = df.withColumns({"page_type": F.when(up, F.col("page_type")).otherwise("broken"), "req_key": url_key(F.col("req_url")),
                         "url_key": url_key(F.col("url"))}).drop("home_url", "scroll_marker")
    df = H.flag_in_map_linked(df, sitemap_keys, links.select("site", F.col("dst_key").alias("key")).distinct())
    return df.withColumn("source", F.when(F.col("req_in_map"), "sitemap").otherwise("link"))


def store_names(audit: DataFrame) -> DataFrame:
    """What a site calls itself: the brand of its titles and the heading of its home page."""
    home = audit.where(F.col("available") & (F.col("page_type") == "home")).select("site", F.col("display_name").alias("name"))
    return G.detect_brand(audit).withColumnRenamed("brand", "name").unionByName(home).where("name <> ''")


def graded_images(images: DataFrame, audit: DataFrame, platforms: DataFrame) -> DataFrame:
    """G9, F1, G6 and G7 over the images of the kept pages."""
    images = I.keep_images_of_live_pages(I.size_variant_dedupe(images, platforms), audit.where("available"))
    images = cut(I.drop_template_images(images, audit)[0])
    names = store_names(audit)
    step = cut(I.store_name_alts(I.alt_duplicates(images), names))
    name = F.when(strip(F.col("declared_name")) != "", F.col("declared_name")).otherwise(F.col("display_name"))
    return I.wrong_product_alts(step, audit.select("site", "url", "seq", "available", "page_type", name.alias("name")), names)


def run_audit(spark: SparkSession, landed: DataFrame, sitemap_files: DataFrame, path: str, run: str, at: dt.datetime,
              homes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Audit the landed pages of any number of sites and commit the result as one run; the tables of this run are returned.

    ``sitemap_files``: site, file_url, pos, text.  ``homes``: site, home_url; the root of the host by default.  A page is
    ``(site, page_id)``.  No pages give empty tables and a run without sites.
    """
    def keep(name: str, df: DataFrame) -> DataFrame:
        return runs.write_table(df, path, name, run)

    root = F.concat(F.lit("https://"), "site", F.lit("/"))
    if homes is None:
        landed = landed.withColumn("home_url", root)
    else:
        known = homes.select("site", F.col("home_url").alias("_home_url"))
        landed = landed.join(known, "site", "left").withColumn("home_url", F.coalesce("_home_url", root)).drop("_home_url")
    platforms = keep("platforms", detect_platform(landed.select(
        "site", F.col("page_id").alias("seq"), "html", F.lit("").alias("headers"), "url")))
    facts = keep("facts", read_facts(landed))
    live = facts.where("available")
    links, images = keep("links", X.page_link_rows(live)), keep("images", X.page_images(live))
    keep("next_pages", X.listing_next(live))
    locs = sitemap_locs(sitemap_files).select("site", F.col("pos").alias("seq"), "loc")
    listed = keep("sitemap_urls", collect_sitemap_urls(locs))
    pages = keep("pages", page_rows(facts, listed.select("site", F.col("url_key").alias("key")), links))

    redirects = keep("redirects", R.redirect_report(pages))
    kept, canonicals = DD.dedupe_pages(pages)
    kept, canonicals = cut(kept), keep("canonicals", canonicals)
    shown = keep("graded_images", graded_images(images, kept, platforms))
    audit = keep("audit", S.fix_masks(G.grade_audit(kept, shown).withColumns({"suggested_url": F.lit("")})))
    coverage = keep("coverage", H.coverage_report(audit))
    orphans = keep("orphans", H.coverage_tables(audit)["orphan"])
    summary = keep("summary", S.compute_summary(audit, I.unique_images(shown), coverage, R.redirect_stats(redirects), platforms, orphans,
                                                canonicals, formats=True))
    diagnosis = keep("diagnosis", S.diagnosis_points(summary))
    runs.commit(summary.select("site", "score", "total_pages"), path, run, at)
    return {"platforms": platforms, "facts": facts, "links": links, "images": images, "pages": pages, "redirects": redirects,
            "canonicals": canonicals, "graded_images": shown, "audit": audit, "coverage": coverage, "orphans": orphans,
            "summary": summary, "diagnosis": diagnosis}
