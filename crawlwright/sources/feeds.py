"""Product feed dumps and the descriptions they add to product pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlwright.functions.text import squeeze, text
from crawlwright.functions.urls import add_url_parts

ITEM = "array<struct<handle:string,title:string,body_html:string>>"
PAGE = f"products {ITEM}, collections {ITEM}"


def plain_text(c):
    t = F.regexp_replace(text(c), "<[^>]+>", " ")
    t = F.replace(F.replace(t, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return squeeze(t)


def read_product_feed(dumps: DataFrame) -> DataFrame:
    """``(site, kind, handle, url, title, description)`` from ``(site, json_text)`` feed pages."""
    parsed = dumps.select("site", F.from_json("json_text", PAGE).alias("p"))
    out = None
    for kind in ("products", "collections"):
        rows = parsed.select("site", F.lit(kind).alias("kind"), F.explode(F.col("p")[kind]).alias("i")).where(
            text(F.col("i.handle")) != "")
        out = rows if out is None else out.unionByName(rows)
    return out.select("site", "kind", F.col("i.handle").alias("handle"),
                      F.concat(F.lit("https://"), "site", F.lit("/"), "kind", F.lit("/"), "i.handle").alias("url"),
                      F.col("i.title").alias("title"), plain_text(F.col("i.body_html")).alias("description"))


def feed_counts(feed: DataFrame) -> DataFrame:
    """The official number of products per site."""
    return (feed.where("kind = 'products'").select("site", "handle").distinct().groupBy("site")
            .agg(F.count("*").alias("products")))


def merge_product_descriptions(pages: DataFrame, feed: DataFrame) -> DataFrame:
    """Product pages take the feed's description when it is longer."""
    had = pages.columns
    texts = (feed.where("kind = 'products'").groupBy("site", F.lower("handle").alias("_handle"))
             .agg(F.max_by("description", F.struct(F.length("description"), "description")).alias("_desc")))
    df = add_url_parts(pages, "url", "k_")
    last = F.coalesce(F.try_element_at("k_low", F.lit(-1)), F.lit(""))
    # other page types carry a key that no handle has
    df = df.withColumn("_handle", F.when(F.col("page_type") == "product", last).otherwise(
        F.concat(F.lit("/"), F.col("seq"))))
    df = df.join(texts, ["site", "_handle"], "left")
    longer = F.length(text(F.col("_desc"))) > F.length(text(F.col("product_desc")))
    return df.withColumn("product_desc", F.when(longer, F.col("_desc")).otherwise(F.col("product_desc"))).select(*had)
