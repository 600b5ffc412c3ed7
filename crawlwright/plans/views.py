"""Audit-shaped views derived from the given tables.

Every view is a projection (or an equi-join) of whole tables, so that a query over it grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlwright.session import spread
from crawlwright.sources.tables import read_table


def _sql(spark: SparkSession, sf_dir: str, query: str, *spread_by: str, **tables: str | DataFrame) -> DataFrame:
    """The query over tables; ``spread_by`` names the key by which the rows of costly ones are dealt out."""
    frames = {alias: read_table(spark, sf_dir, t) if isinstance(t, str) else t for alias, t in tables.items()}
    if spread_by:
        frames = {alias: spread(df, *spread_by) for alias, df in frames.items()}
    return spark.sql(query, **frames)


def fx_images(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, """
        SELECT concat('s', l_suppkey % 5) AS site,
               CAST(l_orderkey * 10 + l_linenumber AS bigint) AS seq,
               concat('https://s', l_suppkey % 5, '.example.com/',
                      CASE WHEN l_orderkey % 4 = 0 THEN 'blog/' ELSE 'products/' END, l_orderkey) AS page_url,
               CASE WHEN l_orderkey % 4 = 0 THEN 'blog' ELSE 'product' END AS page_type,
               concat('https://cdn.example.com/i/', p_partkey,
                      CASE p_partkey % 3 WHEN 0 THEN '.webp' WHEN 1 THEN '_800x.jpg' ELSE '.png' END) AS image_url,
               CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'image'
                    WHEN 2 THEN repeat(concat(p_name, ' '), 14)
                    WHEN 3 THEN concat(p_name, ', a, b, c, d')
                    ELSE concat(p_name, ' ', lower(p_type)) END AS alt,
               l_partkey AS tie
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""", lineitem="lineitem", part="part")


def fx_banner_images(spark: SparkSession, d: str) -> DataFrame:
    """The same image slots, with two fifths of them showing one banner."""
    return fx_images(spark, d).selectExpr(
        "site", "seq", "page_url", "page_type",
        "CASE WHEN tie % 20 < 8 THEN 'https://cdn.example.com/banner.jpg' ELSE image_url END AS image_url",
        "alt", "tie")


def fx_fetch_log(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, """
        SELECT *, concat('https://', site, '.example.com/products/item-', seq) AS req_url,
               CASE WHEN event_type = 'signup'
                         THEN concat('https://', site, '.example.com/products/item-', seq + 1)
                    WHEN event_type = 'purchase' AND seq % 7 = 0 THEN concat('https://', site, '.example.com')
                    ELSE concat('https://', site, '.example.com/products/item-', seq) END AS final_url,
               CASE WHEN event_type = 'signup' AND seq % 3 = 0 THEN 302
                    WHEN event_type = 'signup' THEN 301
                    WHEN event_type = 'purchase' AND seq % 7 = 0 THEN 302 END AS first_hop
        FROM (SELECT concat('s', user_id % 5) AS site, event_id AS seq, ts, event_type,
                     CASE WHEN event_type <> 'error' THEN 200
                          WHEN event_id % 5 = 0 THEN 404 WHEN event_id % 5 = 1 THEN 410
                          WHEN event_id % 5 = 2 THEN 429 WHEN event_id % 5 = 3 THEN 503 END AS status
              FROM {events})""", "event_id", events="events")


def fx_audit(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, """
        SELECT source AS site, doc_id AS seq,
               CASE doc_id % 5 WHEN 0 THEN 'category' WHEN 1 THEN 'blog' WHEN 2 THEN 'info' ELSE 'product' END
                   AS page_type,
               concat('https://', source, '.example.com/',
                      CASE doc_id % 5 WHEN 0 THEN 'categories/' WHEN 1 THEN 'blog/' WHEN 2 THEN 'pages/'
                           ELSE 'products/' END,
                      lower(split_part(text, ' ', 1)), '-', lower(split_part(text, ' ', 2)), '-', doc_id) AS url,
               trim(split_part(text, chr(10), 1)) AS title,
               trim(split_part(text, chr(10), 2)) AS meta_desc,
               trim(split_part(text, '.', 1)) AS display_name,
               CAST(length(text) - length(replace(text, ' ', '')) + 1 AS bigint) AS word_count,
               doc_id % 11 <> 0 AS available,
               CASE WHEN doc_id % 11 <> 0 THEN 'ok' WHEN doc_id % 22 = 0 THEN 'http_404' ELSE 'http_429' END
                   AS fetch_code,
               doc_id % 3 <> 0 AS in_map, doc_id % 4 <> 0 AS linked, doc_id % 17 <> 0 AS indexable,
               CASE doc_id % 7 WHEN 0 THEN 'canon_missing' WHEN 1 THEN 'canon_diff' ELSE 'canon_same' END
                   AS canonical_status,
               CASE WHEN doc_id % 13 = 0 AND doc_id % 11 <> 0
                    THEN concat('https://', source, '.example.com/moved-', doc_id) ELSE '' END AS final_url,
               lang
        FROM {documents}""", documents="documents")


def text_heads(docs: DataFrame) -> DataFrame:
    """The documents with their texts up to the first full stop and the second blank, whichever comes later: a split at either gives
    the same first (and second) part, without cutting the whole text into an array."""
    stop, blank = F.substring_index("text", ".", 1), F.substring_index("text", " ", 2)
    return docs.withColumn("text", F.when(F.length(stop) > F.length(blank), stop).otherwise(blank))


def fx_audit_images(spark: SparkSession, d: str) -> DataFrame:
    """One to three image slots per audited page; pictures are shared between pages."""
    return _sql(spark, d, """
        SELECT site, seq * 10 + k AS seq, page_url, page_type, image_url, alt, seq AS tie FROM (
          SELECT source AS site, doc_id AS seq, k,
               concat('https://', source, '.example.com/',
                      CASE doc_id % 5 WHEN 0 THEN 'categories/' WHEN 1 THEN 'blog/' WHEN 2 THEN 'pages/'
                           ELSE 'products/' END,
                      lower(split_part(text, ' ', 1)), '-', lower(split_part(text, ' ', 2)), '-', doc_id) AS page_url,
               CASE doc_id % 5 WHEN 0 THEN 'category' WHEN 1 THEN 'blog' WHEN 2 THEN 'info' ELSE 'product' END
                   AS page_type,
               concat('https://cdn.example.com/d/', (doc_id * 7 + k * 3) % 997, CASE k WHEN 0 THEN '.webp'
                      WHEN 1 THEN '.jpg' ELSE '.png' END) AS image_url,
               CASE (doc_id + k) % 6 WHEN 0 THEN '' WHEN 1 THEN 'photo' WHEN 2 THEN split_part(text, '.', 1)
                    ELSE concat(lower(split_part(text, ' ', 1)), ' ', lower(split_part(text, ' ', 2)), ' ', k)
                    END AS alt
          FROM {documents} LATERAL VIEW explode(sequence(0L, doc_id % 3)) e AS k)""", documents=text_heads(read_table(spark, d, "documents")))


def fx_audit_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The audit with some dead links outside every known folder (generic links)."""
    return fx_audit(spark, d).selectExpr(
        "site", "seq", "page_type", """CASE WHEN seq % 44 = 0 THEN replace(url, '/categories/', '/') ELSE url END AS url""",
        "title", "meta_desc", "display_name", "word_count", "available", "fetch_code", "in_map", "linked", "indexable",
        "final_url", "lang", "CASE WHEN seq % 44 = 0 THEN 'unknown' ELSE page_type END AS link_type", "'' AS chain")


def fx_sitemaps(spark: SparkSession, d: str) -> DataFrame:
    """Sitemap text as landed in parts: one row per part of a file."""
    return _sql(spark, d, """
        SELECT site, concat('https://', site, '/sitemap.xml') AS file_url, page_id AS pos,
               concat('<url><loc>', url, '</loc></url>') AS text
        FROM (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS site FROM {pages})""",
                pages="pages")


def fx_sitemap_index(spark: SparkSession, d: str) -> DataFrame:
    """A tree of sitemap index files: file n lists files 5n+1 .. 5n+5."""
    return _sql(spark, d, """
        SELECT 'maps.example.com' AS site,
               concat('https://maps.example.com/sitemap-', CAST(floor((page_id - 1) / 5) AS bigint), '.xml') AS file_url,
               page_id AS pos,
               concat('<sitemap><loc><![CDATA[https://maps.example.com/sitemap-', page_id,
                      '.xml]]></loc></sitemap><url><loc>', url, '</loc></url>') AS text
        FROM {pages} WHERE page_id >= 1""", pages="pages")


def fx_sitemap_fetches(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, """
        SELECT concat('s', user_id % 5) AS site, concat('https://s', user_id % 5, '.example.com/sitemap-', event_id, '.xml')
                   AS file_url,
               CASE WHEN event_type <> 'error' THEN 200
                    WHEN event_id % 5 = 0 THEN 404 WHEN event_id % 5 = 1 THEN 403
                    WHEN event_id % 5 = 2 THEN 429 WHEN event_id % 5 = 3 THEN 503 END AS status,
               event_id % 19 = 0 AS challenge,
               CASE WHEN event_id % 23 = 0 THEN 'plain text'
                    ELSE concat('<urlset><url><loc>https://s', user_id % 5, '.example.com/products/', event_id % 400,
                                '</loc></url></urlset>') END AS text
        FROM {events}""", events="events")


def fx_robots(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, """
        SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS site, page_id AS seq,
               concat('User-agent: *', chr(10), 'Disallow: /cart', chr(10),
                      CASE page_id % 3 WHEN 0 THEN 'Sitemap: ' WHEN 1 THEN 'sitemap:' ELSE '  SITEMAP: ' END,
                      'https://', regexp_extract(url, '^https?://([^/?#]+)', 1), '/map-', page_id % 4, '.xml', chr(10))
                   AS robots_text
        FROM {pages}""", pages="pages")


def fx_feed(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, """
        SELECT concat('s', p_partkey % 5) AS site, p_partkey AS seq,
               concat('{{"products":[{{"handle":"', replace(p_name, ' ', '-'), '-', p_partkey, '","title":"', p_name,
                      '","body_html":"<p>', p_name, '&nbsp;', lower(p_type), ' &amp; ', lower(p_brand),
                      '</p>"}}]}}') AS json_text
        FROM {part}""", part="part")


def fx_products(spark: SparkSession, d: str) -> DataFrame:
    """Product pages whose slug is their own name, a copy, another product's name, or has an extra number."""
    return _sql(spark, d, """
        SELECT concat('s', p_partkey % 5) AS site, p_partkey AS seq, 'product' AS page_type, true AS available,
               concat('https://s', p_partkey % 5, '.example.com/products/',
                      CASE p_partkey % 50 WHEN 7 THEN 'copy-of-' ELSE '' END,
                      CASE WHEN p_partkey % 50 = 9 THEN 'blue-bolt' WHEN p_partkey % 50 = 11 THEN '6deef1ae'
                           ELSE replace(p_name, ' ', '-') END, '-', p_partkey) AS url,
               concat(p_name, ' ', lower(p_type)) AS display_name,
               CASE WHEN p_partkey % 3 = 0 THEN repeat(concat(p_name, ' '), 4) ELSE lower(p_type) END AS product_desc,
               concat(p_name, ' ', lower(p_type), ' ', lower(p_brand), ' | store') AS title
        FROM {part}""", part="part")


def fx_urls(spark: SparkSession, d: str) -> DataFrame:
    """Page URLs rewritten into the shapes the URL rules tell apart."""
    return _sql(spark, d, """
        SELECT site, page_id, concat('https://', site, '/', path) AS url, html FROM (
          SELECT page_id, html, regexp_extract(url, '^https?://([^/?#]+)', 1) AS site,
            CASE page_id % 32
              WHEN 0 THEN '' WHEN 1 THEN concat('products/red-shoe-', page_id)
              WHEN 2 THEN concat('en/red-shoe/p', 100000 + page_id) WHEN 3 THEN concat('cups/c', 1000 + page_id)
              WHEN 4 THEN concat('x/brand-', page_id) WHEN 5 THEN concat('about/page-', page_id)
              WHEN 6 THEN 'pages/privacy-policy' WHEN 7 THEN concat('blog/how-to-', page_id)
              WHEN 8 THEN 'blog' WHEN 9 THEN 'blogs/news' WHEN 10 THEN concat('blog/tag/t', page_id)
              WHEN 11 THEN concat('blog/x/a-', 10000 + page_id) WHEN 12 THEN 'blog/shipping-returns-policy'
              WHEN 13 THEN concat('categories/', 1000 + page_id % 3, '/', 'Cups')
              WHEN 14 THEN concat('ar-sa/categories/', 1000 + page_id % 3) WHEN 15 THEN 'latest-products'
              WHEN 16 THEN 'collections/all' WHEN 17 THEN concat('tag/', page_id) WHEN 18 THEN concat('2024/', 1990 + page_id % 30)
              WHEN 19 THEN 'shipping-and-delivery' WHEN 20 THEN concat('shop-p-', page_id)
              WHEN 21 THEN concat('thing-c', 5000 + page_id) WHEN 22 THEN 'contact-us/'
              WHEN 23 THEN concat('products/item-', page_id, '/reviews') WHEN 24 THEN concat('offers?tag=', page_id)
              WHEN 25 THEN concat('author/jane-', page_id) WHEN 26 THEN 'Brands'
              WHEN 27 THEN concat('fr/Produit_Rouge_', page_id) WHEN 28 THEN 'red-red-shoe-red'
              WHEN 29 THEN concat('copy-of-shoe-', page_id) WHEN 30 THEN concat('product-', page_id)
              ELSE concat('caf%C3%A9-bar-', page_id, '/') END AS path
          FROM {pages})""", pages="pages")


def fx_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns as proposed texts, with the turn before as the current text."""
    return _sql(spark, d, """
        SELECT concat('s', conv_id % 5) AS site, conv_id, turn AS seq, concat(conv_id, '-', turn) AS id,
               trim(split_part(text, '.', 1)) AS title,
               trim(text) AS description,
               trim(split_part(prev, '.', 1)) AS current_title,
               trim(prev) AS current_desc, prev AS source_text
        FROM (SELECT c.conv_id, c.turn, c.text, p.text AS prev
              FROM {conversations} c JOIN {conversations} p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
              WHERE c.role = 'assistant')""", conversations="conversations")


def fx_html(spark: SparkSession, d: str) -> DataFrame:
    """One product page per part, in the markup the extraction rules have to read."""
    return _sql(spark, d, r"""
        SELECT concat('s', p_partkey % 5) AS site, p_partkey AS page_id,
          concat('https://s', p_partkey % 5, '.example.com/', CASE WHEN p_partkey % 4 = 0 THEN 'categories/' ELSE
                 'products/' END, p_partkey) AS url,
          concat('<!doctype html><html lang="en"><head><title> ', p_name, '  store </title>',
            '<meta property="og:description" content="og ', p_name, '"><meta name="description" content="', p_name,
            ' &amp; ', lower(p_type), '"><meta name="', CASE p_partkey % 9 WHEN 0 THEN 'robots' ELSE 'viewport' END,
            '" content="noindex"><link rel="canonical" href="/products/', p_partkey - p_partkey % 3, '">',
            '<link rel="next" href="?page=2"><script type="application/ld+json">{{"@graph":[{{"@type":"BreadcrumbList",',
            '"itemListElement":[{{"name":"Home"}},{{"item":{{"name":"', p_type, '"}}}},{{"name":"', p_name, '"}}]}},',
            '{{"@type":["Product"],"name":"', p_name, '","sku":"', p_partkey, '","brand":{{"name":"', p_brand,
            '"}},"image":["https://cdn.example.com/i/', p_partkey, '_800x800.jpg"],"description":"<b>', p_name,
            '</b>&nbsp;fine"}}]}}</script></head><body><header id="site-header"><a href="/home-', p_partkey % 7,
            '">h</a></header><nav><h1>menu</h1></nav><h1>', p_name, ' <i>', lower(p_type), '</i></h1>',
            '<p>Total ', p_size, ' products in this list</p>',
            '<a href="../products/', p_partkey + 1, '#x">next</a><a href="mailto:a@b.c">m</a>',
            '<div data-href="/categories/', p_size, '"></div><button href="/cart">c</button>',
            '<img data-src="https://cdn.example.com/i/', p_partkey, '.jpg" src="data:image/gif;base64,AA" alt="', p_name, '">',
            '<img srcset="https://cdn.example.com/cdn-cgi/image/w=620,q=85/g/', p_partkey,
            '.webp 620w, https://cdn.example.com/big.webp 1240w" alt=" ', lower(p_type), '">',
            '<img src="https://cdn.example.com/logo.png" alt="logo"><img src=""><noscript><img src="/n/', p_partkey,
            '.png"></noscript><script>var d={{"u":"https:\\/\\/s', p_partkey % 5,
            '.example.com\\/products\\/emb-', p_partkey, '"}};</script><div class="load-more"></div></body></html>')
            AS html
        FROM {part}""", "p_partkey", part="part")


def fx_crawl(spark: SparkSession, d: str) -> DataFrame:
    """Every landed page with its fetch, on five sites and one that holds a third of all, with the head and the pictures a shop writes."""
    return _sql(spark, d, r"""
        SELECT site, page_id, url, status, listed, product, descr, final_url, canon,
          CASE WHEN status <> 200 OR final_url = url THEN NULL WHEN page_id % 23 <> 5 AND page_id % 2 = 0 THEN 302 ELSE 301 END AS first_hop,
          concat('<meta name="description" content="', descr, '"><link rel="canonical" href="', canon, '">',
            CASE site WHEN 's1.example.com' THEN '<link rel="preload" href="https://media.zid.sa/a.css">'
              WHEN 's2.example.com' THEN '<link rel="preload" href="https://cdn.shopify.com/a.css">' ELSE '' END,
            CASE WHEN indexable THEN '' ELSE '<meta name="robots" content="noindex">' END,
            CASE WHEN product THEN concat('<script type="application/ld+json">{{"@type":"Product","name":"Lamp number ', page_id % 60,
              '","image":["https://cdn.example.com/i/', page_id, '.jpg"]}}</script><img src="https://cdn.example.com/i/', page_id, '.jpg" alt="',
              CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'photo' WHEN 2 THEN concat('Lamp number ', page_id % 60, ' azure copper shade')
                ELSE concat('Lamp number ', page_id % 60) END,
              '"><img src="https://cdn.example.com/i/', page_id, '_800x.jpg" alt="Side view">')
              ELSE concat('<img src="https://cdn.example.com/b/', page_id, '.png" alt="Story picture ', page_id % 30, '">') END,
            CASE WHEN page_id % 2 = 0 THEN concat('<img src="https://cdn.example.com/banner.webp" alt="Big sale banner"><a href="/products/item-lamp-',
              page_id + 9, '">more</a>') ELSE '' END, body) AS html, indexable
        FROM (SELECT *, CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 41 = 1 THEN concat('https://', site, '/')
                WHEN site = 's4.example.com' THEN concat('https://', site, '/collections/all')
                WHEN page_id % 7 = 2 THEN concat('https://', site, '/products/item-lamp-', page_id - page_id % 50) ELSE final_url END AS canon
          FROM (SELECT *, CASE WHEN status <> 200 THEN url WHEN page_id % 23 = 5 THEN concat('https://', site, '/')
                  WHEN page_id % 19 = 4 THEN concat(url, '-moved') ELSE url END AS final_url
            FROM (SELECT page_id, body, site, page_id % 8 IN (1, 2, 3, 7) AS product, page_id % 4 <> 3 AS listed, page_id % 14 <> 3 AS indexable,
                CASE WHEN page_id % 29 = 0 THEN 404 WHEN page_id % 31 = 0 THEN 429 WHEN page_id % 37 = 0 THEN 503 ELSE 200 END AS status,
                CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'Our best lamps' WHEN 2 THEN concat('Lamps of series ', page_id % 40,
                  ' with shades in many colours, made by hand and sent within two days to every town of the country') ELSE
                  concat('Number ', page_id, ' of our lamps has a warm light, a long cord and a shade that keeps its colour for years') END AS descr,
                concat('https://', site, CASE page_id % 8 WHEN 0 THEN concat('/', w) WHEN 3 THEN concat('/products/Blue_Bolt-', page_id)
                  WHEN 4 THEN concat('/categories/', w, '-', page_id) WHEN 5 THEN concat('/blog/', w, '-', page_id)
                  WHEN 6 THEN concat('/pages/', w, '-', page_id) WHEN 7 THEN concat('/products/item-lamp-', page_id - page_id % 50)
                  ELSE concat('/products/item-lamp-', page_id) END) AS url
              FROM (SELECT page_id, coalesce(html, '') AS body, CASE WHEN regexp_extract(coalesce(html, ''), '<a href="/([A-Za-z]+)"', 1) = '' THEN 'start' ELSE regexp_extract(coalesce(html, ''), '<a href="/([A-Za-z]+)"', 1) END AS w,
                  CASE WHEN page_id % 3 = 0 THEN 'hot.example.com' ELSE concat('s', page_id % 5, '.example.com') END AS site FROM {pages}))))""",
                pages="pages")
