"""Queries: URL keys, token index, classification and grades (B, C, E, G2-G5, G10)."""

from pyspark.sql import functions as F

from crawlwright import constants as K
from crawlwright.functions import text as T
from crawlwright.functions.urls import add_url_parts, image_format
from crawlwright.operators import classify as C
from crawlwright.operators import grading as G
from crawlwright.operators import pages as P
from crawlwright.operators import urlsets as U
from crawlwright.plans import duck as D
from crawlwright.plans import duck_views as DV
from crawlwright.plans import views as V
from crawlwright.plans.registry import query
from crawlwright.session import cut
from crawlwright.sources.tables import read_pages, read_table


def pages(spark, d):
    return read_pages(spark, f"{d}/pages.parquet")


def audit(spark, d):
    return V.fx_audit(spark, d)


def graded(spark, d):
    """The page grades.  The audit rows are written once: seven lookups and the main branch read them."""
    images = G.grade_alt(V.fx_audit_images(spark, d))
    return G.grade_audit(cut(audit(spark, d)), images)


@query("a1_read_pages", "SELECT page_id, url, length(html) AS html_chars FROM pages")
def _(spark, d):
    return pages(spark, d).select("page_id", "url", F.length("html").cast("bigint").alias("html_chars"))


@query("b1_key_urls", """SELECT host AS site, url_key, count(*) AS pages, count(DISTINCT url) AS variants,
    bool_or(has_lang) AS any_lang FROM pages_keyed GROUP BY 1, 2""")
def _(spark, d):
    return U.key_variants(pages(spark, d).select("url"))


@query("b1_key_shapes", f"""SELECT page_id, url_key, array_to_string(segs, '/') AS seg_path, {D.slug('segs')} AS slug,
    CASE WHEN starts_with({D.decode(D.path('url'))}, '/') THEN {D.decode(D.path('url'))}
         ELSE '/' || {D.decode(D.path('url'))} END AS path_only FROM urls_keyed""")
def _(spark, d):
    from crawlwright.functions.urls import path_only, slug_from
    return add_url_parts(V.fx_urls(spark, d), "url").select(
        "page_id", "url_key", F.array_join("segs", "/").alias("seg_path"), slug_from(F.col("segs")).alias("slug"),
        path_only(F.col("url")).alias("path_only"))


_PREF = """SELECT site, url_key, url FROM (SELECT *, row_number() OVER (PARTITION BY site, url_key
      ORDER BY lang, ext DESC, length(url), seq) AS rn FROM (
        SELECT a.*, EXISTS (SELECT 1 FROM cand b WHERE b.site = a.site AND b.url_key = a.url_key AND b.lang = a.lang
               AND starts_with(a.dec, b.dec || '/')) AS ext FROM cand a)) WHERE rn = 1"""


@query("b2_preferred_url", f"""WITH cand AS (SELECT site, url_key, url, min(page_id) AS seq,
      any_value(has_lang)::INT AS lang, rtrim(url_decode(url), '/') AS dec FROM (
        SELECT host AS site, url_key, {D.clean('url')} AS url, page_id, has_lang FROM urls_keyed) GROUP BY ALL)
    {_PREF}""")
def _(spark, d):
    from crawlwright.functions.urls import clean_url
    df = V.fx_urls(spark, d).select(clean_url(F.col("url")).alias("url"), F.col("page_id").alias("seq"))
    return U.preferred_url(df).select("site", "url_key", "url")


_LINKS = """SELECT host AS site, 'https://' || host || CASE page_id % 9 WHEN 0 THEN '/a.JPG' WHEN 1 THEN '/cart'
      WHEN 2 THEN '/tags-x/' || page_id WHEN 3 THEN '/cdn-cgi/l/email' WHEN 4 THEN '/products/1/reviews'
      WHEN 5 THEN '/x?tag_id=3' WHEN 6 THEN '.evil.net/x' WHEN 7 THEN '/collections/a/products/b' ELSE '/ok-' || page_id END
      AS url, CASE WHEN page_id % 2 = 0 THEN 'shopify' ELSE 'zid' END AS platform FROM pages_keyed"""


@query("b3_filter_crawlable", f"""SELECT site, reject_reason, count(*) AS links FROM (
    SELECT site, CASE WHEN lhost <> site THEN 'other_host' WHEN {D.is_tag('url')} THEN 'tag'
      WHEN regexp_matches(lower(url), '\\.(?:{'|'.join(K.BLOCKED_EXTENSIONS)})$') THEN 'extension'
      WHEN list_has_any(string_split(trim(lower({D.path('url')}), '/'), '/'), {D.lst(K.EXCLUDED_SEGMENTS)})
        THEN 'excluded_segment'
      WHEN contains({D.path('url')}, '/cdn-cgi/') THEN 'cdn_or_email' WHEN {D.subpage('llow')} THEN 'product_subpage'
      WHEN platform = 'shopify' AND len(llow) >= 4 AND llow[1] = 'collections' AND llow[3] = 'products'
        THEN 'platform_rule' ELSE '' END AS reject_reason
    FROM (SELECT *, {D.parts('url', 'l')} FROM ({_LINKS}))) GROUP BY 1, 2""")
def _(spark, d):
    p = add_url_parts(pages(spark, d).select("page_id", "url"), "url")
    tail = F.expr("""CASE page_id % 9 WHEN 0 THEN '/a.JPG' WHEN 1 THEN '/cart'
      WHEN 2 THEN '/tags-x/' || page_id WHEN 3 THEN '/cdn-cgi/l/email' WHEN 4 THEN '/products/1/reviews'
      WHEN 5 THEN '/x?tag_id=3' WHEN 6 THEN '.evil.net/x' WHEN 7 THEN '/collections/a/products/b' ELSE '/ok-' || page_id END""")
    links = p.select(F.col("host").alias("site"), F.concat(F.lit("https://"), "host", tail).alias("url"),
                     F.when(F.col("page_id") % 2 == 0, "shopify").otherwise("zid").alias("platform"))
    from crawlwright.functions.urls import crawl_reject_reason
    return (links.select("site", crawl_reject_reason(F.col("url"), F.col("site"), F.col("platform"))
                         .alias("reject_reason")).groupBy("site", "reject_reason").agg(F.count("*").alias("links")))


@query("b4_key_images", """SELECT site, count(DISTINCT image_url) AS images, count(DISTINCT stem) AS stems,
    count(DISTINCT fmt) AS formats, count(*) AS slots FROM (
      SELECT site, image_url, regexp_replace(regexp_extract(image_url, '([^/]*)\\.[a-z]+$', 1), '_[0-9]+x$', '') AS stem,
             regexp_extract(image_url, '([a-z]+)$', 1) AS fmt FROM fx_images) GROUP BY 1""")
def _(spark, d):
    return U.image_sets(V.fx_images(spark, d).withColumn("platform", F.lit("shopify")))


@query("b5_token_index", f"""SELECT site, token, count(*) AS df FROM (
    SELECT source AS site, unnest(list_distinct({D.toks('text')})) AS token FROM documents) GROUP BY 1, 2""")
def _(spark, d):
    docs = read_table(spark, d, "documents").select(F.col("source").alias("site"), F.col("doc_id").alias("id"), "text")
    return U.document_frequency(U.token_index(docs, "text"))


@query("b5_token_index_parts", f"""SELECT p_partkey AS id, unnest(list_distinct({D.toks('p_name')})) AS token FROM part""")
def _(spark, d):
    parts = read_table(spark, d, "part").select(F.lit("s").alias("site"), F.col("p_partkey").alias("id"),
                                                F.col("p_name").alias("text"))
    return U.token_index(parts, "text").select("id", "token")


@query("c1_classify_pages", "SELECT page_id, page_type FROM urls_typed")
def _(spark, d):
    return C.classify_pages(V.fx_urls(spark, d)).select("page_id", "page_type")


@query("c1_classify_site_pages", f"""SELECT site, page_type, count(*) AS pages FROM (SELECT host AS site,
    {D.page_type('low', 'url_key', 'host', D.is_tag(D.clean('url')))} AS page_type FROM pages_keyed) GROUP BY 1, 2""")
def _(spark, d):
    df = add_url_parts(pages(spark, d).select("page_id", "url"), "url").withColumnRenamed("host", "site")
    return (C.classify_pages(df, home_url=F.col("site")).groupBy("site", "page_type")
            .agg(F.count("*").alias("pages")))


@query("c2_decisive_type", f"SELECT page_id, {D.decisive('low')} AS decisive_type FROM urls_keyed")
def _(spark, d):
    return C.decisive_type(V.fx_urls(spark, d)).select("page_id", "decisive_type")


@query("c3_regrade_saved", f"""SELECT page_id, CASE WHEN {D.decisive('low')} <> '' AND page_id % 10 NOT IN (0, 1)
      AND page_id % 9 <> 0 THEN {D.decisive('low')}
      ELSE CASE page_id % 10 WHEN 0 THEN 'home' WHEN 1 THEN 'broken' ELSE 'unknown' END END AS page_type,
    CASE WHEN page_id % 9 = 0 THEN 'na' WHEN page_id % 80 >= 40 THEN 'good' ELSE 'thin' END AS content_status
    FROM urls_keyed""")
def _(spark, d):
    saved = V.fx_urls(spark, d).selectExpr(
        "page_id", "url", "page_id % 9 <> 0 AS available", "page_id % 80 AS word_count",
        "CASE page_id % 10 WHEN 0 THEN 'home' WHEN 1 THEN 'broken' ELSE 'unknown' END AS page_type",
        "CASE WHEN page_id % 9 = 0 THEN 'na' ELSE 'thin' END AS content_status")
    return C.regrade_saved(saved).select("page_id", "page_type", "content_status")


@query("c4_listing_kind", f"SELECT page_id, {D.listing_kind('low')} AS listing_kind FROM urls_keyed")
def _(spark, d):
    return C.listing_kind(V.fx_urls(spark, d)).select("page_id", "listing_kind")


_SIGN = """CASE WHEN page_id % 6 = 1 THEN '<script src="https://CDN.zid/x">' WHEN page_id % 6 = 2 THEN 'cdn.shopify.com'
      WHEN page_id % 6 = 3 THEN 'woocommerce' WHEN page_id % 6 = 4 THEN 'twilight' ELSE '' END"""


@query("c5_detect_platform", f"""SELECT site, platform FROM (SELECT *, row_number() OVER (PARTITION BY site
      ORDER BY platform = 'unknown', page_id) AS rn FROM (
        SELECT host AS site, page_id, CASE {' '.join('WHEN ' + ' OR '.join(f"contains(b, {D.q(s)})" for s in signs) + f" THEN '{p}'" for p, signs in K.PLATFORM_SIGNS)}
          ELSE 'unknown' END AS platform
        FROM (SELECT host, page_id, lower({_SIGN} || html) || ' ' || lower(url) AS b FROM pages_keyed))) WHERE rn = 1""")
def _(spark, d):
    df = add_url_parts(pages(spark, d).select("page_id", "url", "html"), "url").select(
        F.col("host").alias("site"), F.col("page_id").alias("seq"), "url", F.lit("").alias("headers"),
        F.concat(F.expr(_SIGN), "html").alias("html"))
    return C.detect_platform(df)


@query("c6_detect_language", f"""SELECT 'pages' AS src, html_lang AS lang, count(*) AS n FROM page_facts GROUP BY 2
    UNION ALL SELECT 'documents', CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE '—' END, count(*)
    FROM documents GROUP BY 2""")
def _(spark, d):
    a = pages(spark, d).select(F.lit("pages").alias("src"), C.language_of(
        P.html_lang(F.col("html")), P.html_title(F.col("html"))).alias("lang"))
    b = read_table(spark, d, "documents").select(F.lit("documents").alias("src"), C.language_of(
        F.lit(""), F.col("text")).alias("lang"))
    return a.unionByName(b).groupBy("src", "lang").agg(F.count("*").alias("n"))


def _fixed_sql():
    hay = "(array_to_string(u_low, ' ') || ' ' || lower(url_decode(url)) || ' ' || lower(title))"
    arms = " ".join("WHEN " + " OR ".join(f"contains({hay}, {D.q(w)})" for w in words) +
                    f" THEN CASE WHEN starts_with(lang, 'en') THEN {D.q(en)} ELSE {D.q(ar)} END"
                    for words, ar, en in K.FIXED_TITLES)
    return (f"CASE WHEN page_type IN ('product', 'category', 'home', 'blog') THEN '' "
            f"WHEN len(u_low) = 1 AND u_low[1] IN {D.inlist(K.BLOG_SEGMENTS)} THEN "
            f"CASE WHEN starts_with(lang, 'en') THEN 'Blog' ELSE {D.q(K.BLOG_INDEX_TITLE[0])} END {arms} ELSE '' END")


DV.view("audit_fixed", f"SELECT *, {_fixed_sql()} AS fixed_title FROM audit_scored")


@query("c7_fixed_page_title", "SELECT seq, fixed_title FROM audit_fixed")
def _(spark, d):
    return C.fixed_page_title(audit(spark, d)).select("seq", "fixed_title")


@query("c7_fixed_page_title_urls", f"""SELECT page_id, {_fixed_sql()} AS fixed_title FROM (
    SELECT page_id, url, low AS u_low, 'info' AS page_type, '' AS title,
           CASE WHEN page_id % 2 = 0 THEN 'en' ELSE 'ar' END AS lang FROM urls_keyed)""")
def _(spark, d):
    df = V.fx_urls(spark, d).selectExpr("page_id", "url", "'info' AS page_type", "'' AS title",
                                        "CASE WHEN page_id % 2 = 0 THEN 'en' ELSE 'ar' END AS lang")
    return C.fixed_page_title(df).select("page_id", "fixed_title")


@query("e1_grade_lengths", "SELECT seq, title_len, title_status, desc_len, desc_status FROM audit_len")
def _(spark, d):
    return G.grade_lengths(audit(spark, d)).select("seq", "title_len", "title_status", "desc_len", "desc_status")


@query("e1_regrade_lengths", f"""SELECT doc_id AS seq, CASE WHEN doc_id % 5 = 0 THEN 'missing' ELSE
    {D.grade('(doc_id % 70)', K.TITLE_BOUNDS)} END AS title_status, {D.grade('(doc_id % 200)', K.DESC_BOUNDS)} AS desc_status
    FROM documents""")
def _(spark, d):
    saved = read_table(spark, d, "documents").selectExpr(
        "doc_id AS seq", "true AS available", "doc_id % 70 AS title_len", "doc_id % 200 AS desc_len",
        "CASE WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'long' END AS title_status", "'long' AS desc_status")
    return G.regrade_lengths(saved).select("seq", "title_status", "desc_status")


@query("e2_grade_alt", "SELECT alt, alt_status, alt_len, count(*) AS slots FROM img_g GROUP BY ALL")
def _(spark, d):
    return G.grade_alt(V.fx_images(spark, d)).groupBy("alt", "alt_status", "alt_len").agg(F.count("*").alias("slots"))


@query("e3_title_h1_match", f"""SELECT page_id, CASE WHEN title = '' OR h1 = '' OR len(h) = 0 THEN 'match_na'
    WHEN len(list_intersect(t, h)) * 2 >= len(h) THEN 'match_ok' ELSE 'match_diff' END AS h1_match FROM (
    SELECT *, list_distinct({D.toks('title')}) AS t, list_distinct({D.toks('h1')}) AS h FROM page_facts)""")
def _(spark, d):
    f = P.page_facts(pages(spark, d))
    return f.select("page_id", G.title_h1_match(F.col("title"), F.col("h1")).alias("h1_match"))


_PROMO = D.has(f"regexp_replace(lower(translate(title, '{K.EASTERN_DIGITS}', '{K.WESTERN_DIGITS}')), "
               f"{D.q(K.WIDTH_NOT_OFFER_PATTERN)}, ' ', 'g')", T.any_pattern(K.PROMO_PATTERNS))


@query("e4_text_flags", f"""SELECT site, count(*) AS texts, count(*) FILTER (ph) AS placeholders,
    count(*) FILTER (sy) AS symbols, count(*) FILTER (few OR ph OR sy) AS meaningless,
    count(*) FILTER (promo) AS promo FROM (
      SELECT source AS site, {DV.placeholder('title')} AS ph, {D.strip('title')} <> '' AND {D.ld('title')} = '' AS sy,
        length({D.sub('title', r'[^\p{L}\p{Nl}\p{No}]+')}) < 3 AS few, {_PROMO} AS promo
      FROM (SELECT source, text AS title FROM documents
            UNION ALL SELECT source, '{{{{' || split_part(text, ' ', 1) || '}}}} 20% off' FROM documents
            UNION ALL SELECT source, '*** ' || doc_id % 3 FROM documents
            UNION ALL SELECT source, 'page ' || doc_id FROM documents
            UNION ALL SELECT source, 'عرض الشال 50 سم' FROM documents)) GROUP BY 1""")
def _(spark, d):
    docs = read_table(spark, d, "documents")
    t = docs.select(F.col("source").alias("site"), F.explode(F.array(
        F.col("text"), F.concat(F.lit("{{"), F.split_part("text", F.lit(" "), F.lit(1)), F.lit("}} 20% off")),
        F.concat(F.lit("*** "), F.col("doc_id") % 3), F.concat(F.lit("page "), "doc_id"),
        F.lit("عرض الشال 50 سم"))).alias("title"))
    return G.text_flags(t).groupBy("site").agg(
        F.count("*").alias("texts"), F.count_if("is_placeholder").alias("placeholders"),
        F.count_if("is_symbols").alias("symbols"), F.count_if("is_meaningless").alias("meaningless"),
        F.count_if("is_promo").alias("promo"))


@query("e5_filter_pages", """SELECT seq, url FROM audit_scored WHERE page_type = 'product' AND (title_status <> 'optimal'
    OR desc_status <> 'optimal' OR title_quality NOT IN ('q_ok', 'q_na') OR desc_quality NOT IN ('q_ok', 'q_na')
    OR url_quality NOT IN ('u_ok', 'u_na') OR images_missing_alt > 0 OR NOT available)""")
def _(spark, d):
    return G.filter_pages(graded(spark, d), "product", True).select("seq", "url")


@query("e5_filter_images", f"""SELECT seq, image_url FROM aimg_g WHERE alt_status IN {D.inlist(K.ALT_WEAK)}
    AND image_format = 'webp'""")
def _(spark, d):
    df = G.grade_alt(V.fx_audit_images(spark, d)).withColumn("image_format", image_format(F.col("image_url")))
    return G.filter_images(df, "weak", "webp").select("seq", "image_url")


@query("e6_drop_subpages_and_tags", f"""SELECT page_id, url FROM urls_keyed WHERE NOT {D.is_tag('url')}
    AND NOT coalesce({D.subpage('low')}, false)""")
def _(spark, d):
    return G.drop_subpages_and_tags(V.fx_urls(spark, d)).select("page_id", "url")


@query("g2_detect_brand", "SELECT site, brand FROM audit_brand")
def _(spark, d):
    return G.detect_brand(audit(spark, d))


@query("g2_detect_brand_suffix", """SELECT site, coalesce(CASE WHEN n >= 3 AND n >= 0.25 * valid THEN tail END, '') AS brand
    FROM (SELECT site, tail, n, sum(n) OVER (PARTITION BY site) AS valid,
      row_number() OVER (PARTITION BY site ORDER BY n DESC, f) AS rn FROM (
        SELECT source AS site, 'Shop ' || doc_id % 3 AS tail, count(*) AS n, min(doc_id) AS f FROM documents
        WHERE trim(split_part(text, ' ', 1)) <> '' OR true GROUP BY 1, 2)) WHERE rn = 1""")
def _(spark, d):
    t = read_table(spark, d, "documents").selectExpr(
        "source AS site", "doc_id AS seq", "true AS available",
        "concat(replace(split_part(text, ' ', 1), '|', ''), ' - x | Shop ', doc_id % 3) AS title")
    return G.detect_brand(t)


@query("g3_text_quality", """SELECT seq, brand, title_quality, desc_quality, title_status, title_len, desc_status, desc_len,
    title_shared, desc_shared FROM audit_q""")
def _(spark, d):
    base = cut(audit(spark, d))
    return G.text_quality(G.grade_lengths(base), base=base).select(
        "seq", "brand", "title_quality", "desc_quality", "title_status", "title_len", "desc_status", "desc_len",
        "title_shared", "desc_shared")


@query("g4_url_quality", "SELECT seq, slug, url_quality FROM audit_u")
def _(spark, d):
    base = cut(audit(spark, d))
    return G.url_quality(G.grade_lengths(base), base=base).select("seq", "slug", "url_quality")


@query("g5_duplicate_content", "SELECT seq, dup_content, dup_pages FROM audit_dup")
def _(spark, d):
    return G.duplicate_content(cut(audit(spark, d))).select("seq", "dup_content", "dup_pages")


@query("g5_duplicate_groups", """SELECT site, title, meta_desc, count(*) AS pages, min(seq) AS first_seq FROM audit_dup
    WHERE dup_content GROUP BY 1, 2, 3""")
def _(spark, d):
    return (G.duplicate_content(cut(audit(spark, d))).where("dup_content").groupBy("site", "title", "meta_desc")
            .agg(F.count("*").alias("pages"), F.min("seq").alias("first_seq")))


@query("g10_score_pages", "SELECT seq, seo_score, images_missing_alt, images_weak_alt FROM audit_scored")
def _(spark, d):
    return graded(spark, d).select("seq", "seo_score", "images_missing_alt", "images_weak_alt")

