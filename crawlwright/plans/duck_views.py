"""DuckDB versions of the derived views and of the graded audit, for the check queries."""

from __future__ import annotations

import inspect
import re

from crawlwright import constants as K
from crawlwright.functions import text as T
from crawlwright.functions.urls import clone_pattern
from crawlwright.plans import duck as D
from crawlwright.plans import views as V
from crawlwright.plans.duck import view

# The projection views use SQL that means the same in both engines: take it from the Spark view.
for _name in ("fx_images", "fx_fetch_log", "fx_audit", "fx_sitemaps", "fx_sitemap_index", "fx_sitemap_fetches",
              "fx_robots", "fx_feed", "fx_products", "fx_urls", "fx_suggestions", "fx_html", "fx_crawl"):
    _src = inspect.getsource(getattr(V, _name))
    _m = re.search(r'_sql\(spark, d, (r?)"""(.*?)"""', _src, re.S)
    _sql = _m.group(2) if _m.group(1) else _m.group(2).encode().decode("unicode_escape")
    view(_name, re.sub(r"FROM \{(\w+)\}|JOIN \{(\w+)\}", lambda m: m.group(0).replace("{", "").replace("}", ""), _sql)
         .replace("{{", "{").replace("}}", "}"))

view("fx_banner_images", """SELECT site, seq, page_url, page_type,
    CASE WHEN tie % 20 < 8 THEN 'https://cdn.example.com/banner.jpg' ELSE image_url END AS image_url, alt, tie
    FROM fx_images""")
view("fx_audit_images", """
    SELECT site, seq * 10 + k AS seq, page_url, page_type, image_url, alt, seq AS tie FROM (
      SELECT site, seq, k, url AS page_url, page_type,
        concat('https://cdn.example.com/d/', (seq * 7 + k * 3) % 997, CASE k WHEN 0 THEN '.webp'
               WHEN 1 THEN '.jpg' ELSE '.png' END) AS image_url,
        CASE (seq + k) % 6 WHEN 0 THEN '' WHEN 1 THEN 'photo' WHEN 2 THEN split_part(text, '.', 1)
             ELSE concat(lower(split_part(text, ' ', 1)), ' ', lower(split_part(text, ' ', 2)), ' ', k) END AS alt
      FROM fx_audit JOIN documents ON doc_id = seq, unnest(generate_series(0, seq % 3)) g(k))""")

# --- graded audit -------------------------------------------------------------------------------------
_up = "available"
view("audit_len", f"""SELECT *,
    CASE WHEN NOT available THEN 'failed' ELSE {D.grade('title_len', K.TITLE_BOUNDS)} END AS title_status,
    CASE WHEN NOT available THEN 'failed' ELSE {D.grade('desc_len', K.DESC_BOUNDS)} END AS desc_status,
    CASE WHEN NOT available THEN 'na' WHEN word_count >= {K.THIN_WORDS} THEN 'good' ELSE 'thin' END AS content_status
  FROM (SELECT *, CASE WHEN available THEN length({D.sq('title')}) ELSE 0 END::BIGINT AS title_len,
               CASE WHEN available THEN length({D.sq('meta_desc')}) ELSE 0 END::BIGINT AS desc_len FROM fx_audit)""")


def brand_tail(t):
    arms = " ".join(f"WHEN contains({t}, {D.q(s)}) THEN {D.strip(f'split_part({t}, {D.q(s)}, -1)')}"
                    for s in K.BRAND_SEPARATORS)
    return f"CASE {arms} END"


view("audit_brand", f"""SELECT site, coalesce(CASE WHEN n >= 3 AND n >= 0.25 * valid THEN tail END, '') AS brand FROM (
    SELECT site, tail, n, sum(n) OVER (PARTITION BY site) AS valid,
           row_number() OVER (PARTITION BY site ORDER BY tail IS NULL, n DESC, first_seq) AS rn
    FROM (SELECT site, CASE WHEN length(t) BETWEEN 2 AND 40 THEN t END AS tail, count(*) AS n, min(seq) AS first_seq
          FROM (SELECT site, seq, {brand_tail('title')} AS t FROM fx_audit WHERE available AND {D.strip('title')} <> '')
          GROUP BY 1, 2)) WHERE rn = 1""")


def without_brand(t, b):
    v = t
    for s in K.BRAND_SEPARATORS:
        v = f"replace(replace({v}, {D.q(s + ' ')} || {b}, ''), {D.q(s)} || {b}, '')"
    v = f"replace({v}, {b}, '')"
    return D.sub(v, r"^[ |\-–—•·]+|[ |\-–—•·]+$")


def placeholder(x):
    return f"({D.strip(x)} <> '' AND {D.has(f'lower({D.strip(x)})', T.any_pattern(K.PLACEHOLDER_PATTERNS))})"


view("audit_q0", f"""SELECT a.*, coalesce(b.brand, '') AS brand,
    CASE WHEN available THEN {D.strip('title')} ELSE '' END AS t_,
    CASE WHEN available THEN {D.strip('meta_desc')} ELSE '' END AS d_
    FROM audit_len a LEFT JOIN audit_brand b USING (site)""")
view("audit_q", f"""SELECT * EXCLUDE (t_, d_, title_status, title_len, desc_status, desc_len),
    CASE WHEN title_quality IN ('q_symbols', 'q_placeholder') THEN 'missing' ELSE title_status END AS title_status,
    CASE WHEN title_quality IN ('q_symbols', 'q_placeholder') THEN 0 ELSE title_len END AS title_len,
    CASE WHEN desc_quality IN ('q_symbols', 'q_placeholder') THEN 'missing' ELSE desc_status END AS desc_status,
    CASE WHEN desc_quality IN ('q_symbols', 'q_placeholder') THEN 0 ELSE desc_len END AS desc_len
  FROM (SELECT *,
    CASE WHEN NOT available OR t_ = '' THEN 'q_na' WHEN {placeholder('t_')} THEN 'q_placeholder'
         WHEN {D.ld('t_')} = '' THEN 'q_symbols'
         WHEN brand <> '' AND {D.ld(without_brand('t_', 'brand'))} = '' THEN 'q_brand_only'
         WHEN title_shared >= 2 THEN 'q_duplicate' ELSE 'q_ok' END AS title_quality,
    CASE WHEN NOT available OR d_ = '' THEN 'q_na' WHEN {placeholder('d_')} THEN 'q_placeholder'
         WHEN {D.ld('d_')} = '' THEN 'q_symbols' WHEN d_ = t_ THEN 'q_same_as_title'
         WHEN desc_shared >= 2 THEN 'q_duplicate' ELSE 'q_ok' END AS desc_quality
    FROM (SELECT *, CASE WHEN t_ = '' THEN 0 ELSE count(*) OVER (PARTITION BY site, t_) END AS title_shared,
                 CASE WHEN d_ = '' THEN 0 ELSE count(*) OVER (PARTITION BY site, d_) END AS desc_shared FROM audit_q0))""")
view("audit_vocab", f"""SELECT site, list(token) AS vocab FROM (
    SELECT site, token, count(*) AS k, any_value(n_names) AS n_names FROM (
      SELECT site, unnest(tk) AS token, n_names FROM (
        SELECT site, tk, count(*) OVER (PARTITION BY site) AS n_names FROM (
          SELECT site, list_distinct({D.toks('display_name')}) AS tk FROM audit_q WHERE page_type = 'product')
        WHERE len(tk) > 0)) GROUP BY 1, 2)
    WHERE n_names >= {K.VOCAB_MIN_NAMES} AND k >= {K.VOCAB_SHARE} * n_names GROUP BY site""")
view("audit_keyed", f"""SELECT *, {D.slug('u_segs')} AS slug FROM (SELECT *, {D.parts('url', 'u_')} FROM audit_q)""")
view("audit_parent", f"""SELECT seq AS pseq, {D.parts('purl', 'p_')} FROM (
    SELECT seq, replace(url, slug, regexp_extract(slug, '(?s)^(.*)-[0-9]{{1,2}}$', 1)) AS purl
    FROM audit_keyed WHERE regexp_matches(slug, '(?s)^.*-[0-9]{{1,2}}$'))""")
_words = f"list_transform(list_filter(string_split_regex(slug, '[-_]+'), lambda w: w <> ''), lambda w: {D.fold('lower(w)')})"
view("audit_u", f"""SELECT * EXCLUDE (vocab, pseq, p_url_key, s_tok, n_tok, dist, brand_t, refname),
    CASE WHEN NOT available OR slug = '' THEN 'u_na' WHEN {D.has('lower(slug)', clone_pattern())} THEN 'u_clone'
      WHEN p_url_key IS NOT NULL AND p_url_key <> u_url_key AND EXISTS (
           SELECT 1 FROM audit_keyed k WHERE k.site = z.site AND k.u_url_key = z.p_url_key) THEN 'u_clone'
      WHEN {D.has('lower(slug)', T.edges(K.MALFORMED_SLUG_PATTERN))} THEN 'u_malformed'
      WHEN {D.has('slug', T.NO_LETTERS)} OR {D.has('lower(slug)', K.GENERIC_SLUG_PATTERN)} THEN 'u_generic'
      WHEN contains(slug, '_') THEN 'u_underscore' WHEN {D.has('slug', '[A-Z]')} THEN 'u_uppercase'
      WHEN len({_words}) > 2 AND len(list_distinct({_words})) < len({_words}) THEN 'u_repeat'
      WHEN page_type = 'product' AND refname <> '' AND len(s_tok) > 0 AND len(n_tok) > 0
           AND {D.script('slug')} = {D.script('refname')} AND len(dist) > 0 AND NOT list_has_any(dist, n_tok)
           THEN 'u_wrongname' ELSE 'u_ok' END AS url_quality
  FROM (SELECT *, list_filter(s_tok, lambda t: NOT list_contains(coalesce(vocab, []), t) AND NOT list_contains(brand_t, t))
               AS dist
        FROM (SELECT a.*, v.vocab, p.pseq, p.p_url_key, {D.toks('brand')} AS brand_t, {D.wtoks('slug')} AS s_tok,
                list_filter(list_concat({D.toks('display_name')}, {D.toks('title')}),
                            lambda t: NOT list_contains({D.toks('brand')}, t)) AS n_tok,
                CASE WHEN {D.strip('display_name')} <> '' THEN {D.strip('display_name')} ELSE {D.strip('title')} END
                  AS refname
              FROM audit_keyed a LEFT JOIN audit_vocab v USING (site) LEFT JOIN audit_parent p ON p.pseq = a.seq)) z""")
view("audit_dup", f"""SELECT *, CASE WHEN both_ THEN count(*) OVER (PARTITION BY site, title, meta_desc, both_) ELSE 0 END
      AS dup_pages, both_ AND count(*) OVER (PARTITION BY site, title, meta_desc, both_) >= 2 AS dup_content
  FROM (SELECT *, available AND {D.strip('title')} <> '' AND {D.strip('meta_desc')} <> '' AS both_ FROM audit_u)""")


# --- images ---------------------------------------------------------------------------------------------
def image_views(prefix: str, base: str) -> None:
    view(f"{prefix}_g", f"""SELECT *, {D.alt_status('alt')} AS alt_status, length({D.sq('alt')}) AS alt_len,
        {D.image_format('image_url')} AS image_format FROM {base}""")


image_views("img", "fx_images")
image_views("aimg", "fx_audit_images")
view("audit_scored", f"""SELECT *, CASE WHEN available THEN greatest(0, least(100, round_even((
      25.0::DOUBLE * {D.lookup('title_status', K.LENGTH_WEIGHT, '0.0')}::DOUBLE * {D.lookup('title_quality', K.QUALITY_CREDIT, '1.0')}::DOUBLE
      + 25.0::DOUBLE * {D.lookup('desc_status', K.LENGTH_WEIGHT, '0.0')}::DOUBLE * {D.lookup('desc_quality', K.QUALITY_CREDIT, '1.0')}::DOUBLE
      + CASE WHEN coalesce(n_, 0) = 0 THEN 25.0::DOUBLE ELSE 2.5::DOUBLE * credit_ / n_ END
      + CASE WHEN content_status = 'good' THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END)
      * {D.lookup('url_quality', K.URL_CREDIT, '1.0')}::DOUBLE, 0)::BIGINT)) END AS seo_score,
      CASE WHEN available THEN coalesce(miss_, 0) ELSE 0 END AS images_missing_alt,
      CASE WHEN available THEN coalesce(weak_, 0) ELSE 0 END AS images_weak_alt
  FROM audit_dup LEFT JOIN (
    SELECT site, page_url AS url, count(*) AS n_,
      sum({D.lookup('alt_status', [(k, int(round(v * 10))) for k, v in K.ALT_CREDIT], '0')})::BIGINT AS credit_,
      count(*) FILTER (alt_status = 'alt_missing') AS miss_,
      count(*) FILTER (alt_status IN {D.inlist(K.ALT_WEAK)}) AS weak_ FROM aimg_g GROUP BY 1, 2) USING (site, url)""")

# --- pages --------------------------------------------------------------------------------------------
view("pages_keyed", f"SELECT *, {D.parts('url')} FROM pages")
view("urls_keyed", f"SELECT *, {D.parts('url')} FROM fx_urls")
view("urls_typed", f"""SELECT *, {D.page_type('low', 'url_key', "''", D.is_tag(D.clean('url')))} AS page_type FROM urls_keyed""")
_h1 = "(?is)<h1[^>]*>(.*?)</h1>"
view("page_facts", f"""SELECT page_id, url, host AS site, url_key, has_lang, title, h1, html_lang,
      length(title) AS title_len, {D.grade('length(title)', K.TITLE_BOUNDS)} AS title_status
  FROM (SELECT *, {D.sq(D.entities("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')"))} AS title,
    {D.sq(D.entities(f"regexp_replace(regexp_extract(regexp_replace(html, '(?is)<(?:header|nav)[^>]*>.*?</(?:header|nav)>', ' ', 'g'), '{_h1}', 1), '<[^>]+>', ' ', 'g')"))} AS h1,
    substring(lower(regexp_extract(html, '(?is)<html[^>]*\\slang\\s*=\\s*["'']?([^"''\\s>]+)', 1)), 1, 2) AS html_lang
    FROM pages_keyed)""")
view("page_hrefs", f"""SELECT DISTINCT site, page_id, src_key, {D.clean('link')} AS dst_url FROM (
    SELECT page_id, host AS site, url_key AS src_key, {D.resolve('url', 'href')} AS link FROM (
      SELECT page_id, url, host, url_key, trim(unnest(regexp_extract_all(html,
        '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1))) AS href FROM pages_keyed)
    WHERE href <> '' AND NOT regexp_matches(href, '^(?:mailto:|tel:|javascript:|#)'))""")
view("page_links", f"""SELECT site, page_id, src_key, dst_url, l_url_key AS dst_key FROM (
    SELECT *, {D.parts('dst_url', 'l_')} FROM page_hrefs) WHERE l_host = site""")
