"""Queries: link graph, coverage, redirects, broken links and suggestions (D, F, H, I)."""

from pyspark.sql import functions as F

from crawlwright import constants as K
from crawlwright.functions.urls import url_key
from crawlwright.operators import classify as C
from crawlwright.operators import graph as H
from crawlwright.operators import pages as P
from crawlwright.operators import redirects as R
from crawlwright.operators import suggest as S
from crawlwright.plans import duck as D
from crawlwright.plans import views as V
from crawlwright.plans.duck import view
from crawlwright.plans.q_images import fetched
from crawlwright.plans.registry import query
from crawlwright.session import cut
from crawlwright.sources.tables import read_pages, read_table


def pages(spark, d):
    return read_pages(spark, f"{d}/pages.parquet")


@query("d1_page_facts", "SELECT page_id, site, url_key, title, h1, html_lang, title_len, title_status FROM page_facts")
def _(spark, d):
    return P.page_facts(pages(spark, d)).select("page_id", "site", "url_key", "title", "h1", "html_lang", "title_len",
                                                "title_status")


@query("d3_page_links", "SELECT site, page_id, src_key, dst_url, dst_key FROM page_links")
def _(spark, d):
    return P.page_links(pages(spark, d)).select("site", "page_id", "src_key", "dst_url", "dst_key")


_SHIFT = """SELECT 'x' AS site, a.url_key AS src_key, b.url_key AS dst_key FROM urls_typed a JOIN urls_typed b
    ON b.page_id IN (a.page_id + 1, a.page_id + 30)"""


@query("d8_listing_products", f"""SELECT DISTINCT site, src_key AS listing_key, dst_key AS product_key FROM ({_SHIFT})
    WHERE src_key IN (SELECT url_key FROM urls_typed WHERE page_type IN ('category', 'home'))
    AND dst_key IN (SELECT url_key FROM urls_typed WHERE page_type = 'product')""")
def _(spark, d):
    t = C.classify_pages(V.fx_urls(spark, d)).select("page_id", url_key(F.col("url")).alias("key"), "page_type")
    src = t.select(F.col("key").alias("src_key"), F.explode(F.array(F.col("page_id") + 1, F.col("page_id") + 30)).alias("page_id"))
    links = src.join(t, "page_id").select(F.lit("x").alias("site"), "src_key", F.col("key").alias("dst_key"))
    types = t.select(F.lit("x").alias("site"), "key", "page_type")
    return H.listing_products(links, types, types)


@query("f2_flag_in_map_linked", """SELECT page_id, rm AS req_in_map, rl AS req_linked, rm OR fm AS in_map, rl OR fl AS linked
    FROM (SELECT page_id, EXISTS (SELECT 1 FROM pages_keyed m WHERE m.page_id % 3 = 0 AND m.host = p.host AND m.url_key = p.url_key) AS rm,
      EXISTS (SELECT 1 FROM pages_keyed m WHERE m.page_id % 4 = 0 AND m.host = p.host AND m.url_key = p.url_key) AS rl,
      EXISTS (SELECT 1 FROM pages_keyed m WHERE m.page_id % 3 = 0 AND m.host = p.host AND m.url_key = p.host || '/' || p.page_id % 100) AS fm,
      EXISTS (SELECT 1 FROM pages_keyed m WHERE m.page_id % 4 = 0 AND m.host = p.host AND m.url_key = p.host || '/' || p.page_id % 100) AS fl
      FROM pages_keyed p)""")
def _(spark, d):
    f = P.page_facts(pages(spark, d)).select("page_id", "site", F.col("url_key").alias("req_key"))
    keys = f.select("site", F.col("req_key").alias("key"), "page_id")
    df = f.withColumn("url_key", F.concat_ws("/", "site", (F.col("page_id") % 100).cast("string")))
    return H.flag_in_map_linked(df, keys.where("page_id % 3 = 0"), keys.where("page_id % 4 = 0")).select(
        "page_id", "req_in_map", "req_linked", "in_map", "linked")


@query("f3_frontier", """SELECT site, key, url, pos FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY seq, url, key) AS pos FROM (
    SELECT site, dst_key AS key, arg_min(dst_url, row(page_id, dst_url)) AS url, min(page_id) AS seq FROM page_links
    WHERE dst_key NOT IN (SELECT dst_key FROM page_links WHERE length(dst_key) % 3 = 0) GROUP BY 1, 2))""")
def _(spark, d):
    links = P.page_links(pages(spark, d)).select("site", F.col("dst_key").alias("key"), F.col("dst_url").alias("url"),
                                                 F.col("page_id").alias("seq"))
    seen = links.where(F.length("key") % 3 == 0)
    return H.frontier(links, seen).select("site", "key", "url", "pos")


def links(spark, d):
    """The edge list, written once: it is narrow, the HTML it comes from is not."""
    p = pages(spark, d)
    urls = p.select("page_id", F.col("url").alias("src_url"))
    return cut(P.page_links(p).join(urls, "page_id").select("site", "dst_key", "src_url", F.col("page_id").alias("seq")))


view("ref_index", """SELECT site, dst_key, count(*) AS n_pages, list(src_url ORDER BY seq, src_url)[1:3] AS samples FROM (
    SELECT DISTINCT site, dst_key, url AS src_url, page_id AS seq FROM page_links JOIN pages USING (page_id))
    GROUP BY 1, 2""")


@query("h1_referrer_index", "SELECT site, dst_key, n_pages, array_to_string(samples, ' ') AS samples FROM ref_index")
def _(spark, d):
    return H.referrer_index(links(spark, d)).withColumn("samples", F.array_join("samples", " "))


_pth = f"CASE WHEN starts_with({D.path('x')}, '/') THEN {D.path('x')} ELSE '/' || {D.path('x')} END"


@query("h2_where_label", f"""SELECT site, dst_key, n_pages, CASE WHEN n_pages >= greatest(10, total_pages * 0.5)
      THEN 'menu/footer (' || n_pages || ' pages)' ELSE array_to_string(list_transform(samples, lambda x: {_pth}), ' | ')
        || CASE WHEN n_pages > len(samples) THEN ' (+' || (n_pages - len(samples)) || ')' ELSE '' END END AS found_on
    FROM ref_index JOIN (SELECT host AS site, count(*) AS total_pages FROM pages_keyed GROUP BY 1) USING (site)""")
def _(spark, d):
    totals = P.page_facts(pages(spark, d)).groupBy("site").agg(F.count("*").alias("total_pages"))
    return H.where_label(H.referrer_index(links(spark, d)), totals)


_gone = "fetch_code IN ('http_404', 'http_410', 'deleted_home')"
view("audit_cov", f"""SELECT site, count(*) FILTER (in_map) AS sitemap_total, count(*) FILTER (in_map AND available) AS sitemap_live,
    count(*) FILTER (in_map AND NOT available AND {_gone}) AS sitemap_dead,
    count(*) FILTER (in_map AND NOT available AND NOT {_gone}) AS sitemap_unreachable,
    count(*) FILTER (in_map AND available AND NOT linked AND page_type <> 'product') AS orphan_pages,
    count(*) FILTER (in_map AND available AND NOT linked AND page_type = 'product') AS scroll_only_products,
    count(*) FILTER (NOT in_map AND available) AS unl, count(*) FILTER (available AND page_type = 'product') AS products_live,
    count(*) FILTER (NOT in_map AND available AND page_type = 'product') AS products_unlisted,
    site IN ('src1', 'src2') AS partial FROM fx_audit GROUP BY site""")


@query("h3_coverage_report", """SELECT * EXCLUDE (unl), CASE WHEN partial THEN 0 ELSE unl END AS unlisted_pages,
    CASE WHEN partial THEN unl ELSE 0 END AS unlisted_suppressed,
    CASE WHEN products_live > 0 THEN round((products_live - products_unlisted)::DOUBLE / products_live * 100, 1) ELSE 100.0 END
      AS indexed_pct FROM audit_cov""")
def _(spark, d):
    a = V.fx_audit(spark, d)
    rep = a.select("site").distinct().withColumn("partial", F.col("site").isin("src1", "src2"))
    return H.coverage_report(a, rep)


@query("h3_coverage_tables", f"""SELECT kind, seq, url FROM (
    SELECT 'dead' AS kind, seq, url FROM fx_audit WHERE in_map AND NOT available AND {_gone}
    UNION ALL SELECT 'orphan', seq, url FROM fx_audit WHERE in_map AND available AND NOT linked AND page_type <> 'product'
    UNION ALL SELECT 'scroll_only', seq, url FROM fx_audit WHERE in_map AND available AND NOT linked AND page_type = 'product'
    UNION ALL SELECT 'unlisted', seq, url FROM fx_audit WHERE NOT in_map AND available)""")
def _(spark, d):
    out = None
    for kind, t in H.coverage_tables(V.fx_audit(spark, d)).items():
        t = t.select(F.lit(kind).alias("kind"), "seq", "url")
        out = t if out is None else out.unionByName(t)
    return out


_kind = f"CASE WHEN page_type = 'category' AND {D.listing_kind('low')} <> 'category' THEN 'listing' ELSE page_type END"
_dec = f"CASE WHEN {D.decisive('low')} <> '' THEN {D.decisive('low')} ELSE page_type END"


@query("h4_reconcile_counts", f"""WITH live AS (SELECT host AS site, url_key AS key, max({_kind}) AS live_type FROM urls_typed
      WHERE page_id % 4 <> 0 GROUP BY 1, 2),
    sm AS (SELECT site, key, max(CASE WHEN t = 'category' AND lk <> 'category' THEN 'listing' ELSE t END) AS map_type FROM (
      SELECT host AS site, CASE WHEN page_id % 7 = 0 THEN host || '/latest-products' ELSE url_key END AS key, {_dec} AS t,
        {D.listing_kind('low')} AS lk FROM urls_typed WHERE page_id % 3 <> 0) GROUP BY 1, 2)
    SELECT coalesce(live.site, sm.site) AS site, coalesce(live_type, map_type) AS page_type,
      count(*) FILTER (live_type IS NOT NULL) AS found, count(*) FILTER (map_type IS NOT NULL) AS in_map,
      count(*) FILTER (live_type IS NOT NULL AND map_type IS NULL) AS outside_map,
      count(*) FILTER (live_type IS NULL) AS map_not_live
    FROM live FULL JOIN sm ON live.site = sm.site AND live.key = sm.key
    WHERE coalesce(live_type, map_type) IN ('product', 'category', 'blog') GROUP BY 1, 2""")
def _(spark, d):
    t = C.classify_pages(V.fx_urls(spark, d)).withColumn("site", F.regexp_replace("site", "^www[.]", ""))
    audit = t.withColumn("available", F.col("page_id") % 4 != 0)
    sm = t.where("page_id % 3 <> 0")
    # the page id keeps the test mapping one-to-one with its sitemap row
    mapping = sm.where("page_id % 7 = 0").select("site", url_key(F.col("url")).alias("req_key"), F.concat(
        F.col("site"), F.lit("/latest-products")).alias("final_key")).distinct()
    others = sm.where("page_id % 7 <> 0").select("site", url_key(F.col("url")).alias("req_key")).distinct()
    return H.reconcile_counts(audit, sm.select("site", "url", F.col("page_type").alias("url_type")),
                              mapping.join(others, ["site", "req_key"], "left_anti"))


@query("h4_store_totals", """SELECT coalesce(f.site, a.site) AS site, coalesce(f.products, a.declared)::BIGINT AS store_total
    FROM (SELECT 's' || p_partkey % 15 AS site, max(p_size) FILTER (p_partkey % 7 = 1) AS declared FROM part GROUP BY 1) a
    FULL JOIN (SELECT 's' || s_suppkey % 10 AS site, count(*) AS products FROM supplier GROUP BY 1) f ON f.site = a.site""")
def _(spark, d):
    a = read_table(spark, d, "part").selectExpr(
        "concat('s', p_partkey % 15) AS site", "true AS available", "p_size AS declared_count",
        "CASE WHEN p_partkey % 7 = 1 THEN 'https://s.com/ar/Latest-Products' ELSE concat('https://s.com/x', p_partkey) END AS url")
    feed = read_table(spark, d, "supplier").selectExpr("concat('s', s_suppkey % 10) AS site").groupBy("site").agg(
        F.count("*").alias("products"))
    return H.store_totals(a, feed)


_LP = """SELECT concat('s', l_partkey % 5) AS site, concat('s', l_partkey % 5, '.example.com/#cat', 1000 + l_partkey) AS listing_key,
    concat('p', l_suppkey) AS product_key FROM {lineitem}"""
_LIST = """SELECT concat('s', p_partkey % 5) AS site, concat('https://s', p_partkey % 5, '.example.com/en/categories/',
    1000 + p_partkey, '/', p_size) AS url, p_size AS declared_count FROM {part}"""
view("decl_rows", f"""SELECT l.site, url, declared_count::BIGINT AS declared, coalesce(found, 0) AS found,
    greatest(declared_count - coalesce(found, 0), 0)::BIGINT AS missing FROM ({_LIST.replace('{part}', 'part')}) l
    LEFT JOIN (SELECT listing_key, count(DISTINCT product_key) AS found FROM ({_LP.replace('{lineitem}', 'lineitem')}) GROUP BY 1) f
    ON f.listing_key = regexp_replace(regexp_replace(url, '^https://', ''), '/en/categories/([0-9]+)/.*$', '/#cat\\1')
    WHERE declared_count > 0""")


def declared(spark, d):
    return H.declared_vs_found(spark.sql(_LIST, part=read_table(spark, d, "part")),
                               spark.sql(_LP, lineitem=read_table(spark, d, "lineitem")))


@query("h5_declared_vs_found", "SELECT * FROM decl_rows")
def _(spark, d):
    return declared(spark, d)


_STR = """SELECT site, seq, page_type, available, display_name, CASE seq % 6 WHEN 0 THEN '' WHEN 1 THEN 'zzz qqq' ELSE display_name END
    AS declared_name, seq % 3 AS declared_images, seq % 4 AS total_images FROM {products}"""


@query("h5_structured_report", f"""SELECT site, found_products, no_jsonld, name_mismatch, image_gap, categories_checked,
    categories_matched, missing_products, round(categories_matched::DOUBLE / categories_checked * 100, 1) AS coverage_pct FROM (
      SELECT site, count(*) AS found_products, count(*) FILTER (declared_name = '') AS no_jsonld,
        count(*) FILTER (declared_name = 'zzz qqq') AS name_mismatch,
        count(*) FILTER (declared_name <> '' AND declared_images > 0 AND total_images < declared_images) AS image_gap
      FROM ({_STR.replace('{products}', 'fx_products')}) GROUP BY 1)
    JOIN (SELECT site, count(*) AS categories_checked, count(*) FILTER (missing = 0) AS categories_matched,
      sum(missing)::BIGINT AS missing_products FROM decl_rows GROUP BY 1) USING (site)""")
def _(spark, d):
    return H.structured_report(spark.sql(_STR, products=V.fx_products(spark, d)), declared(spark, d))


_REP = """CASE site WHEN 'src0' THEN 0 ELSE 50 END AS total_urls, site = 'src1' AS partial"""


@query("h6_pagination_needed", f"""SELECT site, reason, reason <> 'complete' AS needed FROM (
    SELECT site, CASE WHEN total_urls = 0 THEN 'no_sitemap' WHEN partial THEN 'partial_sitemap'
      WHEN coalesce(best, 0) > known THEN 'declared_more_than_known' WHEN known = 0 THEN 'no_products' ELSE 'complete' END AS reason
    FROM (SELECT site, {_REP}, max(seq % 40) FILTER (page_type = 'category') AS best,
      count(DISTINCT CASE WHEN available AND page_type = 'product' THEN u_url_key END) AS known FROM audit_keyed GROUP BY site))""")
def _(spark, d):
    a = V.fx_audit(spark, d).withColumn("declared_count", F.col("seq") % 40)
    rep = a.select("site").distinct().selectExpr("site", *_REP.split(", "))
    return H.pagination_needed(a, rep)


@query("h7_home_redirect_suspicion", """SELECT site, n AS home_redirects, n >= 10 AND n > 0.15 * greatest(u, 1) AS suspicious FROM (
    SELECT site, count(*) FILTER (fetch_code = 'deleted_home') AS n, count(DISTINCT CASE WHEN seq % 4 = 0 THEN req_url END) AS u
    FROM fetched2 GROUP BY 1)""")
def _(spark, d):
    f = fetched(spark, d)
    counts = (f.where("seq % 4 = 0").select("site", "req_url").distinct().groupBy("site")
              .agg(F.count("*").alias("sitemap_urls")))
    return H.home_redirect_suspicion(f, counts)


@query("h8_reachability", """WITH RECURSIVE walk(key, clicks) AS (SELECT 0::BIGINT, 0 UNION ALL
      SELECT 3 * key + k, clicks + 1 FROM walk, (VALUES (1), (2), (5)) v(k) WHERE key IN (SELECT page_id FROM pages))
    SELECT 'x' AS site, key::VARCHAR AS key, min(clicks)::BIGINT AS clicks FROM walk GROUP BY 2""")
def _(spark, d):
    e = read_table(spark, d, "pages").selectExpr(
        "'x' AS site", "string(page_id) AS src",
        "explode(transform(array(1, 2, 5), k -> string(page_id * 3 + k))) AS dst")
    roots = read_table(spark, d, "pages").where("page_id = 0").select(F.lit("x").alias("site"), F.lit("0").alias("key"))
    return H.reachability(e, roots)


_SEED = """SELECT site, seq, status, content_type, concat('https://', site, '.example.com/', CASE seq % 11 WHEN 0 THEN 'products' WHEN 1
    THEN 'offers' WHEN 2 THEN 'collections/all' WHEN 3 THEN 'blog' WHEN 4 THEN 'brands' ELSE 'nowhere' END) AS req_url,
    CASE WHEN seq % 11 = 3 OR event_type = 'purchase' THEN concat('https://', site, '.example.com/') ELSE concat('https://', site,
    '.example.com/x') END AS final_url FROM (SELECT *, CASE WHEN seq % 11 = 4 THEN 'application/json' END AS content_type FROM {log})"""


@query("h9_guessed_listing_seeds", f"""SELECT DISTINCT site, req_url AS url FROM ({_SEED.replace('{log}', 'fx_fetch_log')})
    WHERE status = 200 AND content_type IS NULL AND seq % 11 < 3 AND event_type_ok""".replace(
        "SELECT site, seq, status,", "SELECT site, event_type <> 'purchase' AS event_type_ok, seq, status,"))
def _(spark, d):
    log = spark.sql(_SEED, log=V.fx_fetch_log(spark, d))
    sites = log.select("site").distinct().withColumn("home_url", F.concat(F.lit("https://"), "site", F.lit(".example.com")))
    return H.guessed_listing_seeds(sites, log)


@query("h10_blog_roots", f"""SELECT site, url, depth, pos FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY depth, seq, url)
      AS pos FROM (SELECT 's' || page_id % 2 AS site, url, min(len(segs)) AS depth, min(page_id) AS seq FROM urls_typed
        WHERE page_type = 'archive' AND list_has_any(low, {D.lst(K.BLOG_SEGMENTS)}) GROUP BY 1, 2))""")
def _(spark, d):
    t = C.classify_pages(V.fx_urls(spark, d)).selectExpr("concat('s', page_id % 2) AS site", "url", "page_id AS seq",
                                                         "page_type", "true AS available")
    return H.blog_roots(t).select("site", "url", "depth", "pos")


# --- redirects --------------------------------------------------------------------------------------------
view("red_in", """SELECT *, seq % 3 <> 0 AS in_map, seq % 4 <> 0 AS linked, 'https://' || site || '.example.com/old-' || seq // 2 AS rq
    FROM fetched2""")
view("red_rep", """SELECT site, rq AS req_url, st AS status, final_url, chain, in_map, linked,
      CASE WHEN st IN ('perm', 'temp') AND NOT in_map AND NOT linked THEN 'none_urgent' WHEN st = 'home' THEN 'restore_or_redirect'
        WHEN st IN ('404', '410') THEN 'add_redirect' WHEN st = 'temp' THEN 'make_permanent' ELSE 'update_links' END AS action
    FROM (SELECT *, row_number() OVER (PARTITION BY site, rq ORDER BY seq) AS rn FROM (
      SELECT *, CASE WHEN fetch_code = 'deleted_home' THEN 'home' WHEN fetch_code = 'http_404' THEN '404' WHEN fetch_code = 'http_410'
        THEN '410' WHEN available AND final_url <> '' THEN CASE WHEN starts_with(chain, '302') THEN 'temp' ELSE 'perm' END END AS st
      FROM red_in) WHERE st IS NOT NULL) WHERE rn = 1""")


def redirect_rows(spark, d):
    return fetched(spark, d).withColumns({
        "in_map": F.col("seq") % 3 != 0, "linked": F.col("seq") % 4 != 0, "link_type": F.lit("product"),
        "source": F.lit("sitemap"), "req_url": F.concat(F.lit("https://"), "site", F.lit(".example.com/old-"),
                                                        F.floor(F.col("seq") / 2))})


@query("i1_redirect_report", "SELECT * FROM red_rep")
def _(spark, d):
    return R.sorted_report(R.redirect_report(redirect_rows(spark, d))).select(
        "site", "req_url", "status", "final_url", "chain", "in_map", "linked", "action")


@query("i2_redirect_stats", """SELECT site, count(*) FILTER (status = 'perm') AS redirects_permanent,
    count(*) FILTER (status = 'temp') AS redirects_temporary, count(*) FILTER (status = 'home') AS redirects_home,
    count(*) FILTER (status IN ('404', '410')) AS not_found_pages, count(*) FILTER (in_map) AS redirects_in_sitemap,
    count(*) AS redirects_total FROM red_rep GROUP BY 1""")
def _(spark, d):
    return R.redirect_stats(R.redirect_report(redirect_rows(spark, d)))


@query("i3_broken_mask", "SELECT seq, req_url FROM fetched2 WHERE fetch_code IN ('http_404', 'http_410') AND trim(chain) = ''")
def _(spark, d):
    return R.broken_mask(fetched(spark, d)).select("seq", "req_url")


@query("i10_unreachable_reasons", """SELECT site, CASE fetch_code WHEN 'http_429' THEN 'rate_limited' WHEN 'conn_failed' THEN 'connection'
    WHEN 'http_503' THEN 'server_error' ELSE 'other:' || fetch_code END AS reason, count(*) AS pages FROM fetched2
    WHERE NOT available AND fetch_code NOT IN ('http_404', 'http_410', 'deleted_home') GROUP BY 1, 2""")
def _(spark, d):
    return R.unreachable_reasons(fetched(spark, d))


# --- suggestions ----------------------------------------------------------------------------------------------
view("fx_audit_mixed", """SELECT * REPLACE (CASE WHEN seq % 44 = 0 THEN replace(url, '/categories/', '/') ELSE url END AS url),
    CASE WHEN seq % 44 = 0 THEN 'unknown' ELSE page_type END AS link_type, '' AS chain FROM fx_audit""")
view("sug_keyed", f"SELECT *, {D.slug('segs')} AS slug FROM (SELECT *, {D.parts('url')} FROM fx_audit_mixed)")
_nostop = f"lambda t: NOT list_contains({D.lst(K.PATH_STOP_WORDS)}, t)"
view("sug_cand", f"""SELECT site, seq, url, page_type AS ctype, list_filter(list_distinct(list_concat({D.wtoks('slug')},
    {D.wtoks('display_name')})), {_nostop}) AS toks FROM sug_keyed WHERE available AND trim(final_url) = '' AND indexable""")
view("sug_common", """SELECT site, list(t) AS common FROM (SELECT site, t, count(*) AS k FROM (SELECT site, unnest(toks) AS t
    FROM sug_cand) GROUP BY 1, 2) JOIN (SELECT site, count(*) AS n FROM sug_cand GROUP BY 1) USING (site)
    WHERE k > greatest(3, n * 0.33) GROUP BY 1""")
view("sug_ask", f"""SELECT *, CASE WHEN len(core) > 0 THEN core ELSE want END AS base, CASE WHEN generic THEN
      ['category', 'blog', 'info', 'product'] WHEN link_type = 'product' THEN ['product', 'category'] WHEN link_type = 'category'
      THEN ['category', 'product'] WHEN link_type = 'blog' THEN ['blog'] WHEN link_type = 'info' THEN ['info']
      ELSE ['product', 'category', 'blog', 'info'] END AS allowed
    FROM (SELECT *, list_filter(want, lambda t: NOT list_contains({D.lst(S.VARIANTS)}, t)) AS core FROM (
      SELECT k.site, k.seq, link_type, ({D.decisive('low')}) = '' AND link_type <> 'product' AS generic,
        list_filter(list_filter({D.wtoks('slug')}, {_nostop}), lambda t: NOT list_contains(coalesce(common, []), t)) AS want
      FROM sug_keyed k LEFT JOIN sug_common USING (site) WHERE NOT available AND fetch_code = 'http_404')) WHERE len(want) > 0""")
view("sug_pairs", f"""SELECT *, hit::DOUBLE / len(base) AS score, len(list_intersect(list_filter(want, lambda t:
      list_contains({D.lst(S.VARIANTS)}, t)), ct)) AS vhit, list_position(allowed, ctype) AS pos
    FROM (SELECT a.site, a.seq, a.want, a.base, a.generic, a.allowed, c.seq AS cseq, c.url, c.ctype, c.ct,
      len(list_intersect(a.base, c.ct)) AS hit FROM sug_ask a JOIN (
        SELECT s.*, list_filter(toks, lambda t: NOT list_contains(coalesce(common, []), t)) AS ct FROM sug_cand s
        LEFT JOIN sug_common USING (site)) c ON c.site = a.site AND list_contains(a.allowed, c.ctype)) WHERE hit > 0""")
view("suggested", """SELECT site, seq, url AS suggested_url, CASE WHEN hit >= 2 AND score >= 0.75 THEN 'high' ELSE 'medium' END
    AS suggestion_conf FROM (SELECT *, row_number() OVER (PARTITION BY site, seq ORDER BY
      CASE WHEN NOT generic THEN 0 WHEN ctype = 'blog' AND score >= 0.99 THEN 3 WHEN ctype = 'category' THEN 2
           WHEN ctype IN ('blog', 'info') THEN 1 ELSE 0 END DESC, score DESC, hit DESC,
      CASE WHEN generic THEN hit::DOUBLE / len(ct) ELSE vhit END DESC, CASE WHEN generic THEN -vhit ELSE pos END, cseq) AS rn
    FROM sug_pairs WHERE NOT (generic AND ctype = 'product' AND (hit < 3 OR score < 0.75)))
    WHERE rn = 1 AND ((hit >= 2 AND score >= 0.5) OR (len(want) = 1 AND hit = 1 AND ctype = 'category')
                      OR (generic AND ctype = 'category'))""")


@query("i4_suggest_alternatives", "SELECT site, seq, suggested_url, suggestion_conf FROM suggested")
def _(spark, d):
    return S.suggest_alternatives(V.fx_audit_mixed(spark, d))


view("dead_found", f"""SELECT site, dst_key, n_pages, array_to_string(list_transform(samples, lambda x:
      {D.path('x')}), ' | ') || CASE WHEN n_pages > 3 THEN ' (+' || (n_pages - 3) || ')' ELSE '' END AS found_on
    FROM (SELECT b.site, b.url_key AS dst_key, count(*) AS n_pages, list(a.url ORDER BY a.seq)[1:3] AS samples
      FROM sug_keyed a JOIN sug_keyed b ON b.seq = a.seq - (a.seq // 20) % 5 * 20 AND a.seq <> b.seq GROUP BY 1, 2)""")


def annotated(spark, d):
    a = V.fx_audit_mixed(spark, d)
    links_ = (a.select("site", F.col("url").alias("src_url"), "seq", (F.col("seq") - F.floor(F.col("seq") / 20) % 5 * 20).alias("to"))
              .where("seq <> to").join(a.select(F.col("seq").alias("to"), url_key(F.col("url")).alias("dst_key")), "to"))
    totals = a.groupBy("site").agg(F.lit(1000).alias("total_pages"))
    found = H.where_label(H.referrer_index(links_), totals)
    return S.annotate_broken(a.withColumn("req_url", F.col("url")), found, S.suggest_alternatives(a))


def site_platforms(spark, d):
    return read_table(spark, d, "documents").select(F.col("source").alias("site")).distinct().withColumn(
        "platform", F.when(F.col("site").rlike("[02468]$"), "zid").otherwise("salla"))


view("annotated", """SELECT k.* EXCLUDE (chain), chain, CASE WHEN broken THEN coalesce(f.found_on, '') ELSE '' END AS found_on,
      CASE WHEN broken THEN coalesce(s.suggested_url, '') ELSE '' END AS suggested_url,
      CASE WHEN broken THEN coalesce(s.suggestion_conf, '') ELSE '' END AS suggestion_conf,
      regexp_matches(k.site, '[02468]$') AS can FROM (
        SELECT *, NOT available AND fetch_code = 'http_404' AS broken FROM sug_keyed) k
      LEFT JOIN dead_found f ON f.site = k.site AND f.dst_key = k.url_key LEFT JOIN suggested s ON s.site = k.site AND s.seq = k.seq""")
_action = """CASE WHEN can AND suggested_url <> '' THEN CASE WHEN linked THEN 'redirect_fix' ELSE 'redirect' END
    WHEN linked THEN CASE WHEN suggested_url <> '' THEN 'fix_to' ELSE 'fix_remove' END ELSE 'none' END"""


@query("i5_annotate_broken", """SELECT seq, found_on, suggested_url, suggestion_conf FROM annotated""")
def _(spark, d):
    return annotated(spark, d).select("seq", "found_on", "suggested_url", "suggestion_conf")


@query("i6_broken_links", f"""SELECT site, url, link_type, '404' AS code, in_map, linked, found_on, suggested_url, suggestion_conf,
    {_action} AS action FROM annotated WHERE broken""")
def _(spark, d):
    return R.sorted_broken_links(R.broken_links(annotated(spark, d), site_platforms(spark, d)))


@query("i7_broken_work_counts", f"""SELECT site, count(*) FILTER (action LIKE 'redirect%') AS redirect_qty,
    count(*) FILTER (linked) AS internal_fix_qty, count(*) FILTER (action <> 'none') AS broken_actionable
    FROM (SELECT *, {_action} AS action FROM annotated WHERE broken) GROUP BY 1""")
def _(spark, d):
    return R.broken_work_counts(annotated(spark, d), site_platforms(spark, d))


# destinations for the import file: the next page of the same site, sometimes itself or a dead page
_DEST = """CASE WHEN seq % 66 = 0 THEN url WHEN next_url IS NULL THEN '' WHEN seq % 4 = 0 THEN dead_url ELSE next_url END"""
view("imp_in", f"""SELECT a.*, {_DEST} AS dest FROM (SELECT a.*, b.url AS next_url, c.url AS dead_url FROM (
    SELECT * FROM sug_keyed) a LEFT JOIN fx_audit_mixed b ON b.seq = a.seq + 20 LEFT JOIN fx_audit_mixed c ON c.seq = a.seq + 440) a""")
view("imp_rows", f"""SELECT site, seq, url, {D.path('url')} AS from_path, {D.path('dest')} AS to_path, CASE
    WHEN NOT EXISTS (SELECT 1 FROM sug_keyed l WHERE l.site = i.site AND l.available AND trim(l.final_url) = '' AND l.url_key = dkey)
      THEN 'destination_not_live' WHEN {D.path('url')} = {D.path('dest')} OR EXISTS (SELECT 1 FROM sug_keyed l WHERE l.site = i.site
      AND NOT l.available AND l.fetch_code = 'http_404' AND {D.path('l.url')} = {D.path('dest')}) THEN 'loop_or_chain' ELSE '' END AS reason
    FROM (SELECT *, {D.parts('dest', 'x')}, xurl_key AS dkey FROM imp_in WHERE NOT available AND fetch_code = 'http_404'
          AND coalesce(dest, '') <> '') i""")


def import_input(spark, d):
    a = V.fx_audit_mixed(spark, d)
    nxt = a.select((F.col("seq") - 20).alias("seq"), F.col("url").alias("next_url"))
    dead = a.select((F.col("seq") - 440).alias("seq"), F.col("url").alias("dead_url"))
    return (a.join(nxt, "seq", "left").join(dead, "seq", "left")
            .withColumn("suggested_url", F.coalesce(F.expr(_DEST), F.lit(""))))


@query("i8_redirect_import", """SELECT site, 'seo-' || row_number() OVER (PARTITION BY site ORDER BY seq) AS name,
    CASE WHEN starts_with(from_path, '/') THEN from_path ELSE '/' || from_path END AS from_path,
    CASE WHEN starts_with(to_path, '/') THEN to_path ELSE '/' || to_path END AS to_path FROM imp_rows WHERE reason = ''""")
def _(spark, d):
    return R.redirect_import(import_input(spark, d))[0]


@query("i8_redirect_import_skipped", "SELECT site, url, reason FROM imp_rows WHERE reason <> ''")
def _(spark, d):
    return R.redirect_import(import_input(spark, d))[1]


@query("f10_phase_redirects", """SELECT site, 'seo-' || rn AS name FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY seq) AS rn
    FROM imp_rows WHERE reason = '') WHERE seq % 5 < 3""")
def _(spark, d):
    rows = R.redirect_import(import_input(spark, d))[0]
    return R.phase_redirects(rows, V.fx_audit_mixed(spark, d).where("seq % 5 < 3")).select("site", "name")


@query("i9_verify_redirects", """SELECT site, '/products/item-' || seq AS from_path, CASE WHEN status IS NULL THEN 'no_reply'
    WHEN first_hop IS NULL THEN 'no_redirect' WHEN mv_to <> seq % 2 THEN 'wrong_destination' WHEN status <> 200 THEN 'destination_failed'
    WHEN first_hop <> 301 THEN 'not_permanent' WHEN seq % 5 = 0 THEN 'more_than_one_hop' ELSE 'works' END AS verdict
    FROM (SELECT *, CASE WHEN event_type = 'signup' THEN 1 ELSE 5 END AS mv_to FROM fx_fetch_log WHERE seq % 2 = 1)""")
def _(spark, d):
    log = V.fx_fetch_log(spark, d)
    pairs = log.where("seq % 2 = 1").selectExpr("site", "concat('https://', site, '.example.com') AS home_url",
                                                "concat('/products/item-', seq) AS from_path",
                                                "concat('/products/item-', seq + 1) AS to_path")
    later = log.withColumn("hops", F.expr("CASE WHEN first_hop IS NULL THEN array() WHEN seq % 5 = 0 THEN array(first_hop, 301) "
                                          "ELSE array(first_hop) END"))
    return R.verify_redirects(pairs, later).select("site", "from_path", "verdict")


# --- slugs ---------------------------------------------------------------------------------------------------
view("slug_in", f"""SELECT *, list_distinct({D.wtoks('name')}) AS own, {D.wtoks('seg')} AS st FROM (
    SELECT site, seq, url, trim(display_name) AS name, regexp_extract(url, '([^/]*)$', 1) AS seg FROM fx_products)""")


@query("i11_url_change_reasons", """SELECT site, seq, reason FROM (SELECT site, seq, CASE WHEN contains(seg, 'copy-of') THEN 'copy_of'
      WHEN regexp_matches(seg, '^(?:[0-9a-f]{6,}|[0-9a-f-]{20,})$') THEN 'code_like'
      WHEN len(list_intersect(st, own)) * 2 <= len(st) AND other IS NOT NULL AND other <> name THEN 'other_product'
      WHEN regexp_matches(seg, '-[0-9]{1,2}$') THEN 'extra_number' END AS reason FROM slug_in LEFT JOIN (
        SELECT a.site, a.st, arg_min(b.name, b.seq) AS other FROM (SELECT DISTINCT site, st FROM slug_in) a
        JOIN slug_in b ON b.site = a.site AND len(list_intersect(a.st, b.own)) * 10 >= len(a.st) * 7 GROUP BY 1, 2) o USING (site, st))
    WHERE reason IS NOT NULL""")
def _(spark, d):
    return S.url_change_reasons(V.fx_products(spark, d)).where("reason IS NOT NULL").select("site", "seq", "reason")


@query("i11_url_changes")
def _(spark, d):
    p = V.fx_products(spark, d)
    return S.url_changes(p, p.where("seq % 2 = 0").select("site", "url", "title"))


@query("i12_url_change_redirects", """SELECT 's' || p_partkey % 5 AS site, 'seo-url-' || row_number() OVER (PARTITION BY p_partkey % 5
    ORDER BY p_partkey) AS name, regexp_replace(url, '^https://[^/]*', '') AS from_path, '/products/new ' || seq AS to_path
    FROM fx_products JOIN part ON p_partkey = seq""")
def _(spark, d):
    ch = V.fx_products(spark, d).withColumn("new_url", F.concat(F.lit("https://x.example.com/products/new%20"), "seq"))
    return R.url_change_redirects(ch)
