"""Queries: full extraction (D1-D7) over the landed pages and over product markup derived from parts."""

from pyspark.sql import functions as F

from crawlwright.functions.urls import add_url_parts
from crawlwright.operators import extract as X
from crawlwright.plans import views as V
from crawlwright.plans.registry import query
from crawlwright.sources.tables import read_pages, read_table


def landed(spark, d):
    p = read_pages(spark, f"{d}/pages.parquet")
    return X.read_pages_html(add_url_parts(p, "url").withColumnRenamed("host", "site"))


def markup(spark, d):
    return X.read_pages_html(V.fx_html(spark, d).withColumn("site", F.concat("site", F.lit(".example.com"))))


@query("d1_extract_page_facts", "SELECT page_id, title, h1 AS display_name, html_lang AS lang, title_status FROM page_facts")
def _(spark, d):
    return X.page_audit(landed(spark, d)).select("page_id", "title", "display_name", "lang", "title_status")


@query("d1_extract_page_audit")
def _(spark, d):
    return X.page_audit(landed(spark, d))


_SLUG = "'s' || p_partkey % 5 || '.example.com'"


@query("d1_extract_markup", f"""SELECT p_partkey AS page_id, p_name || ' store' AS title, p_name || ' & ' || lower(p_type) AS meta_desc,
    p_name || ' ' || lower(p_type) AS display_name, p_partkey % 9 <> 0 AS indexable, 'en' AS lang,
    CASE WHEN p_partkey % 3 = 0 AND p_partkey % 4 <> 0 THEN 'canon_same'
         ELSE 'canon_diff' END AS canonical_status, 'product' AS html_signal FROM part WHERE p_partkey >= 10000 OR p_partkey < 10000""")
def _(spark, d):
    return X.page_audit(markup(spark, d)).select("page_id", "title", "meta_desc", "display_name", "indexable", "lang",
                                                 "canonical_status", "html_signal")


@query("d2_extract_images", """SELECT p_partkey AS seq, pos AS image_pos, CASE pos WHEN 1 THEN 'https://cdn.example.com/i/' || p_partkey || '.jpg'
    WHEN 2 THEN 'https://cdn.example.com/g/' || p_partkey || '.webp' ELSE 'https://s' || p_partkey % 5 || '.example.com/n/' || p_partkey || '.png' END
      AS image_url, CASE pos WHEN 1 THEN p_name WHEN 2 THEN lower(p_type) ELSE '' END AS alt,
    CASE pos WHEN 1 THEN 'jpg' WHEN 2 THEN 'webp' ELSE 'png' END AS image_format, true AS own_image
    FROM part, range(1, 4) r(pos)""")
def _(spark, d):
    return X.page_images(markup(spark, d)).select("seq", "image_pos", "image_url", "alt", "image_format", "own_image")


@query("d3_extract_links", """SELECT page_id, dst_url FROM (SELECT p_partkey AS page_id, unnest([root || '/home-' || p_partkey % 7,
      root || '/products/' || (p_partkey + 1), root || '/categories/' || p_size, root || '/products/emb-' || p_partkey]) AS dst_url
    FROM (SELECT *, 'https://s' || p_partkey % 5 || '.example.com' AS root FROM part))
    UNION SELECT p_partkey, 'https://s' || p_partkey % 5 || '.example.com/products/' || p_partkey FROM part WHERE false""")
def _(spark, d):
    return X.page_link_rows(markup(spark, d)).select("page_id", "dst_url")


@query("d4_extract_next_pages", """SELECT p_partkey AS page_id, 'https://s' || p_partkey % 5 || '.example.com/' || CASE WHEN p_partkey % 4 = 0
    THEN 'categories/' ELSE 'products/' END || p_partkey || '?page=2' AS next_url, true AS scroll_marker FROM part""")
def _(spark, d):
    return X.listing_next(markup(spark, d)).select("page_id", "next_url", "scroll_marker")


@query("d5_extract_product_facts", """SELECT p_partkey AS page_id, p_name AS declared_name, p_partkey::VARCHAR AS sku, p_brand AS brand,
    p_type AS category, p_name || ' fine' AS product_desc, 1::BIGINT AS declared_images FROM part""")
def _(spark, d):
    return X.page_audit(markup(spark, d)).select("page_id", "declared_name", "sku", "brand", "category", "product_desc",
                                                 "declared_images")


@query("d6_declared_count", """SELECT p_partkey AS page_id, p_size::BIGINT AS declared_count FROM part""")
def _(spark, d):
    body = F.regexp_replace("html", "<[^>]+>", " ")
    return V.fx_html(spark, d).select("page_id", X.declared_count(body).alias("declared_count"))


@query("d6_declared_count_phrases", """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN p_size + 1000 WHEN 1 THEN p_size
      WHEN 2 THEN greatest(p_size, 30) WHEN 3 THEN p_size ELSE NULL END::BIGINT AS declared_count FROM part""")
def _(spark, d):
    t = read_table(spark, d, "part").selectExpr("p_partkey AS id", """CASE p_partkey % 5
        WHEN 0 THEN concat('إجمالي 1,', lpad(p_size, 3, '0'), ' منتجات') WHEN 1 THEN concat('showing 1-24 of ', p_size)
        WHEN 2 THEN concat('30 products. عدد المنتجات: ', p_size) WHEN 3 THEN concat(p_size, ' منتجاً') ELSE 'no number here' END AS t""")
    return t.select("id", X.declared_count(F.col("t")).alias("declared_count"))


@query("d7_listing_payload_text", """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '<p>' || p_name || '</p>' WHEN 1 THEN
    '<b>' || p_name || '</b>/' ELSE '{"products":[{"u":"https://x/' || p_partkey || '"}]}' END AS listing_text FROM part""")
def _(spark, d):
    t = read_table(spark, d, "part").selectExpr("p_partkey AS id", r"""CASE p_partkey % 3 WHEN 0 THEN concat('<p>', p_name, '</p>')
        WHEN 1 THEN concat('{"html":"<b>', p_name, '<\\/b>\\/"}') ELSE concat('{"products":[{"u":"https:\\/\\/x\\/', p_partkey, '"}]}') END
        AS body""", "CASE WHEN p_partkey % 3 = 1 THEN 'application/json' ELSE 'text/html' END AS content_type")
    return X.listing_payload_text(t).select("id", "listing_text")
