"""Queries: the whole audit, from landed pages to findings, and its runs in a store."""

import datetime as dt
import re
import uuid

from pyspark.sql import functions as F

from crawlwright import constants as K
from crawlwright.operators import audit as A
from crawlwright.operators import summary as S
from crawlwright.plans import duck as D
from crawlwright.plans import q_work as QW
from crawlwright.plans import views as V
from crawlwright.plans.duck import view
from crawlwright.plans.registry import query
from crawlwright.session import ensure_checkpoint_dir
from crawlwright.sources import runs

AT = dt.datetime(2024, 5, 1)


def crawl(spark, d):
    return V.fx_crawl(spark, d).select("site", "page_id", "url", "html", "status", F.lit("text/html").alias("content_type"), "final_url",
                                       F.expr("CASE WHEN first_hop IS NULL THEN array() ELSE array(first_hop) END").alias("hops"))


def sitemap(spark, d):
    return V.fx_crawl(spark, d).selectExpr("site", "'map' AS file_url", "page_id AS pos", "concat('<urlset><url>', CASE WHEN listed THEN "
                                           "concat('<loc>', url, '</loc>') ELSE '' END, '</url></urlset>') AS text")


def store(spark):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/audit-{uuid.uuid4().hex}"


def audited(spark, d):
    return A.run_audit(spark, crawl(spark, d), sitemap(spark, d), store(spark), "first", AT)


# --- what DuckDB reads from the same pages ---------------------------------------------------------------------
_tag = """(?:[^>"']|"[^"]*"|'[^']*')*>"""
_bare = D.sub("html", "(?s)<!--.*?-->", " ")


def _cut(x, name):
    return D.sub(x, rf"""(?is)<{name}(?:[\s/](?:[^>"']|"[^"]*"|'[^']*')*)?>.*?</{name}\s*>""", " ")


_seen = _cut(_cut(_cut("bare", "script"), "style"), "noscript")
_words = D.sq(D.entities(D.sub("seen", "<[a-zA-Z/!]" + _tag, " ")))
_title = D.sq(D.entities("regexp_replace(regexp_extract(bare, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')"))
_h1 = D.sq(D.entities("regexp_replace(regexp_extract(" + _cut(_cut("seen", "header"), "nav") + ", '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')"))

view("run_fetch", """SELECT *, page_id AS seq, url AS req_url, CASE WHEN status <> 200 THEN 'http_' || status
      WHEN final_url = 'https://' || site || '/' OR canon = 'https://' || site || '/' THEN 'deleted_home' ELSE 'ok' END AS fetch_code FROM fx_crawl""")
view("run_read", f"""SELECT * EXCLUDE (url, final_url, html), fetch_code = 'ok' AS available, final_url AS landed,
    CASE WHEN fetch_code = 'ok' THEN final_url ELSE req_url END AS url, {_bare} AS bare,
    CASE WHEN fetch_code = 'deleted_home' OR final_url <> req_url THEN {D.clean('final_url')} ELSE '' END AS final_url,
    CASE WHEN first_hop IS NOT NULL THEN first_hop || ' → 200' WHEN fetch_code = 'deleted_home' THEN 'canonical → home' ELSE '' END AS chain
    FROM run_fetch""")
view("run_said", f"""SELECT * EXCLUDE (bare, seen, words), {_title} AS title0, {_h1} AS h10,
    CASE WHEN words = '' THEN 0 ELSE len(string_split(words, ' ')) END::BIGINT AS words0,
    substring(lower(regexp_extract(bare, '(?is)<html[^>]*\\slang\\s*=\\s*["'']?([^"''\\s>]+)', 1)), 1, 2) AS lang
    FROM (SELECT *, {_words} AS words FROM (SELECT *, {_seen} AS seen FROM run_read))""")
view("run_typed", f"""SELECT * EXCLUDE (title0, h10, words0, descr), CASE WHEN available THEN title0 ELSE '' END AS title, CASE WHEN available THEN h10 ELSE '' END
      AS display_name, CASE WHEN available THEN descr ELSE '' END AS meta_desc, CASE WHEN available THEN words0 ELSE 0 END AS word_count,
    CASE WHEN available AND product THEN 'Lamp number ' || seq % 60 ELSE '' END AS declared,
    CASE WHEN available THEN {D.page_type('low', 'url_key', 'site', D.is_tag(D.clean('url')), "CASE WHEN product THEN 'product' ELSE '' END")} ELSE 'broken' END AS page_type,
    CASE WHEN canon = '' THEN 'canon_missing' WHEN c_url_key = l_url_key THEN 'canon_same' ELSE 'canon_diff' END AS canonical_status
    FROM (SELECT *, {D.parts('url')}, {D.parts('req_url', 'r_')}, {D.parts('canon', 'c_')}, {D.parts('landed', 'l_')} FROM run_said)""")
view("run_map", f"""SELECT DISTINCT host AS site, url_key AS key FROM (SELECT {D.parts('loc')}, loc, site FROM (SELECT site, {D.clean('url')} AS loc FROM fx_crawl WHERE listed))
    WHERE host = site AND NOT {D.is_tag('loc')} AND NOT {D.subpage('low')}""")
# DuckDB's expressions cannot look around: the second kind of script link is taken with its quotes
_whole, _rooted = re.fullmatch(r"(.*)\|\(\?<=(?:.*?)\)(.*)\(\?=.*", K.EMBEDDED_LINK_PATTERN).groups()
_rooted = f"""["''](?i:({_rooted}))["'']""".replace("''", "'")
view("run_links", f"""SELECT DISTINCT site, url_key AS key FROM (SELECT site, dst, {D.parts('dst')} FROM (
      SELECT site, {D.clean(D.resolve('landed', 'href'))} AS dst FROM (SELECT site, landed, trim(unnest(list_concat(regexp_extract_all(bare,
        '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1), regexp_extract_all(bare, {D.q(_whole)}), regexp_extract_all(bare, {D.q(_rooted)}, 1)))) AS href FROM run_read WHERE available)
      WHERE href <> '' AND NOT regexp_matches(href, '^(?:mailto:|tel:|javascript:|#)'))) WHERE host = site""")
view("run_raw", """SELECT t.*, rm.key IS NOT NULL AS req_in_map, rl.key IS NOT NULL AS req_linked, rm.key IS NOT NULL OR fm.key IS NOT NULL AS in_map,
    rl.key IS NOT NULL OR fl.key IS NOT NULL AS linked, CASE WHEN declared <> '' THEN declared ELSE display_name END AS ref_name FROM run_typed t
    LEFT JOIN run_map rm ON rm.site = t.site AND rm.key = r_url_key LEFT JOIN run_map fm ON fm.site = t.site AND fm.key = url_key
    LEFT JOIN run_links rl ON rl.site = t.site AND rl.key = r_url_key LEFT JOIN run_links fl ON fl.site = t.site AND fl.key = url_key""")
view("run_one", """SELECT *, row_number() OVER (PARTITION BY site, available, ck ORDER BY has_lang, seq) AS crn FROM (
    SELECT *, CASE WHEN canonical_status = 'canon_diff' THEN c_url_key ELSE url_key END AS ck,
      row_number() OVER (PARTITION BY site, url_key ORDER BY NOT available, has_lang, seq) AS rn FROM run_raw) WHERE rn = 1""")
view("run_canon", """SELECT site, CASE WHEN n >= 10 AND dup > n * 0.5 THEN dup ELSE 0 END AS canon_broken FROM (
    SELECT site, count(*) AS n, count(*) - count(DISTINCT ck) AS dup FROM run_one WHERE available GROUP BY site)""")
_keys = ", ".join(f"{p}{c}" for p in ("", "r_", "c_", "l_") for c in ("host", "alls", "segs", "has_lang", "low", "url_key"))
view("run_base", f"""SELECT * EXCLUDE ({_keys}, ck, rn, crn) FROM run_one LEFT JOIN run_canon USING (site)
    WHERE NOT available OR crn = 1 OR coalesce(canon_broken, 0) > 0""")

# --- images: up to four slots a page; the banner is on half of all pages -----------------------------------------
view("run_slots", f"""SELECT s.* EXCLUDE (keep) FROM (
    SELECT site, seq, url AS page_url, page_type, pos, image_url, alt, keep, CASE WHEN product THEN pos IN (1, 2) END AS own_image FROM run_raw,
      LATERAL (VALUES (1, 'https://cdn.example.com/i/' || seq || '.jpg', CASE seq % 5 WHEN 0 THEN '' WHEN 1 THEN 'photo' WHEN 2 THEN 'Lamp number ' || seq % 60
          || ' azure copper shade' ELSE 'Lamp number ' || seq % 60 END, product),
        (2, 'https://cdn.example.com/i/' || seq || '_800x.jpg', 'Side view', product AND site <> 's2.example.com'),
        (3, 'https://cdn.example.com/b/' || seq || '.png', 'Story picture ' || seq % 30, NOT product),
        (4, 'https://cdn.example.com/banner.webp', 'Big sale banner', seq % 2 = 0)) v(pos, image_url, alt, keep) WHERE available) s
    SEMI JOIN (SELECT * FROM run_base WHERE available) b ON b.site = s.site AND b.url = s.page_url WHERE keep""")
view("run_live", f"""SELECT *, {D.alt_status('alt')} AS alt_status FROM run_slots s WHERE NOT EXISTS (SELECT 1 FROM (
      SELECT site, image_url, count(DISTINCT page_url) AS k FROM run_slots GROUP BY 1, 2) i
      JOIN (SELECT site, count(*) AS n FROM run_base WHERE available GROUP BY 1 HAVING count(*) >= 5) p USING (site)
      WHERE k >= greatest(5, n * 0.3) AND i.site = s.site AND i.image_url = s.image_url)""")
_IMAGES = {"img_g": "run_live", "img_dup_alts": "run_dup_alts", "img_d1": "run_d1", "img_d2": "run_d2", "img_store": "run_store", "img_d3": "run_d3",
           "img_products": "run_products", "img_vocab": "run_names_vocab", "img_names": "run_names", "img_cands": "run_cands",
           "img_alts": "run_alts", "img_match": "run_match", "aimg_g": "run_img", "aimg_uni": "run_uni"}
_GRADES = {"fx_audit": "run_base", **{f"audit_{n}": f"run_{n}" for n in ("len", "brand", "q0", "q", "vocab", "keyed", "parent", "u", "dup", "scored", "fixed", "mask")}}
_SUMS = {"summary_pages": "run_sum_pages", "summary_images": "run_sum_images", "whole_formats": "run_sum_formats", "summary_all": "run_sum"}
_NAMES = _IMAGES | _GRADES | _SUMS


def _again(*names, **change):
    """The rules of a view, read over this audit's tables."""
    for n in names:
        sql = re.sub(r"\b(" + "|".join(_NAMES) + r")\b", lambda m: _NAMES[m[1]], D.VIEWS[n])
        for old, new in change.items():
            sql = sql.replace(old, new)
        view(_NAMES[n], sql)


_again("audit_len", "audit_brand", "audit_q0", "audit_q", "audit_vocab", "audit_keyed", "audit_parent")
_again("audit_u", display_name="ref_name")
_again("audit_dup", "img_dup_alts", "img_d1", "img_d2")
view("run_store", f"""SELECT site, coalesce(list_distinct(flatten(list({D.toks('name')}))), []) AS store FROM (
    SELECT site, brand AS name FROM run_brand UNION ALL SELECT site, display_name FROM run_base WHERE available AND page_type = 'home'
    UNION ALL SELECT site, '' FROM run_base) GROUP BY 1""")
_again("img_d3")
view("run_products", f"SELECT site, url AS page_url, seq, {D.strip('ref_name')} AS name FROM run_base WHERE available AND page_type = 'product' AND {D.strip('ref_name')} <> ''")
_again("img_vocab", "img_names", "img_cands", "img_alts", "img_match")
view("run_img", f"""SELECT i.* EXCLUDE (alt_status), {D.image_format('i.image_url')} AS image_format,
    CASE WHEN i.page_type = 'product' AND alt_status IN ('alt_ok', 'alt_duplicate')
      AND m.other IS NOT NULL AND n.own IS NOT NULL AND coalesce(own_image, np = 1) AND NOT is_set AND len(own) > 0 AND NOT list_has_any(alt_t, own)
      AND len(list_intersect(own, other)) * 2 < greatest(least(len(own), len(other)), 1) THEN 'alt_wrong_product' ELSE alt_status END AS alt_status
    FROM run_d3 i LEFT JOIN run_match m ON m.site = i.site AND m.alt = i.alt LEFT JOIN run_names n ON n.site = i.site AND n.page_url = i.page_url
      LEFT JOIN (SELECT site, image_url, count(DISTINCT page_url) AS np FROM run_d3 GROUP BY 1, 2) c ON c.site = i.site AND c.image_url = i.image_url""")
_again("audit_scored", "audit_fixed", "audit_mask", "aimg_uni", "summary_images", "whole_formats")
D.VIEWS["run_sum_pages"] = (re.sub(r"\baudit_mask\b", "run_mask", D.VIEWS["summary_pages"])
                            .replace("regexp_matches(site, '[02468]$') AND seq % 44 = 0", "false")
                            .replace("fetch_code = 'http_429'", "fetch_code IN ('http_429', 'http_503')"))
_again("summary_all")

_live_h = f"list_distinct({D.toks('title')}) AS t, list_distinct({D.toks('display_name')}) AS h"
view("run_sum_h1", f"""SELECT site, count(*) FILTER (available AND title <> '' AND display_name <> '' AND len(h) > 0 AND len(list_intersect(t, h)) * 2 < len(h))
      AS h1_mismatch, coalesce(sum(CASE WHEN product THEN 2 ELSE 1 END + CASE WHEN seq % 2 = 0 THEN 1 ELSE 0 END) FILTER (available), 0)::BIGINT
      AS image_slots FROM (SELECT *, {_live_h} FROM run_base) GROUP BY site""")
_gone = "fetch_code IN ('http_404', 'http_410', 'deleted_home')"
_cov = {"visible_products": "available AND page_type = 'product'", "sitemap_products": "in_map", "sitemap_live": "in_map AND available",
        "not_indexed_count": "NOT in_map AND available AND page_type = 'product'", "dead_count": f"in_map AND NOT available AND {_gone}",
        "sitemap_unreachable": f"in_map AND NOT available AND NOT {_gone}", "hidden_count": "in_map AND available AND NOT linked AND page_type <> 'product'",
        "scroll_only_count": "in_map AND available AND NOT linked AND page_type = 'product'",
        "unlisted_count": "NOT in_map AND available AND page_type IN ('product', 'category', 'blog', 'info')", "unlisted_suppressed": "false",
        **{f"orphan_{t}": f"in_map AND available AND NOT linked AND page_type = '{t}'" for t in S.ORPHAN_TYPES}}
view("run_sum_cover", f"""SELECT *, CASE WHEN visible_products > 0 THEN round((visible_products - not_indexed_count)::DOUBLE / visible_products * 100, 1)
    ELSE 100.0 END AS indexed_pct FROM (SELECT site, {', '.join(QW._cnt(k, v) for k, v in _cov.items())} FROM run_base GROUP BY site)""")
view("run_moved", """SELECT site, req_url, seq, final_url, chain, link_type, req_in_map, req_linked, CASE WHEN fetch_code = 'deleted_home' THEN 'home'
      WHEN fetch_code = 'http_404' THEN '404' WHEN first_hop = 302 THEN 'temp' ELSE 'perm' END AS status FROM (
    SELECT *, row_number() OVER (PARTITION BY site, r_url_key ORDER BY seq) AS k FROM (SELECT *, %s AS link_type FROM run_raw)
    WHERE fetch_code IN ('http_404', 'deleted_home') OR (available AND final_url <> '')) WHERE k = 1"""
     % D.page_type('r_low', 'r_url_key', 'site', D.is_tag(D.clean('req_url')), "''"))
view("run_sum_moved", """SELECT site, count(*) FILTER (status = 'perm') AS redirects_permanent, count(*) FILTER (status = 'temp') AS redirects_temporary,
    count(*) FILTER (status = 'home') AS redirects_home, count(*) FILTER (status = '404') AS not_found_pages,
    count(*) FILTER (req_in_map) AS redirects_in_sitemap, count(*) AS redirects_total FROM run_moved GROUP BY site""")
_parts = {"run_sum_formats": QW._parts["whole_formats"], "run_sum_cover": [*_cov, "indexed_pct"], "run_sum_moved": QW._parts["whole_moved"],
          "run_canon": ["canon_broken"]}
_counts = [m for m in QW._metrics.split(", ")]
view("run_summary", f"""SELECT site, {', '.join(f'coalesce({m}, 0) AS {m}' for m in _counts)}, h1_mismatch, image_slots,
    {', '.join(f'coalesce({c}, 0) AS {c}' for cs in _parts.values() for c in cs)}
    FROM run_sum JOIN run_sum_h1 USING (site) {' '.join(f'LEFT JOIN {t} USING (site)' for t in _parts)}""")

# --- queries ----------------------------------------------------------------------------------------------------
_PAGE = ("site", "seq", "url", "page_type", "fetch_code", "in_map", "linked", "title_status", "desc_status", "title_quality", "desc_quality", "url_quality",
         "content_status", "canonical_status", "dup_content", "images_missing_alt", "images_weak_alt", "seo_score", "title_fix", "desc_fix")


@query("a1_whole_audit_pages", f"SELECT {', '.join(_PAGE)} FROM (SELECT * EXCLUDE (url), {D.clean('url')} AS url FROM run_mask)")
def _(spark, d):
    return audited(spark, d)["audit"].select(*_PAGE)


@query("a1_whole_audit_images", "SELECT site, page_url, image_url, alt, alt_status, image_format FROM run_img")
def _(spark, d):
    return audited(spark, d)["graded_images"].select("site", "page_url", "image_url", "alt", "alt_status", "image_format")


@query("a1_whole_audit_redirects", "SELECT site, req_url, status, final_url, chain, link_type, req_in_map AS in_map, req_linked AS linked FROM run_moved")
def _(spark, d):
    return audited(spark, d)["redirects"].select("site", "req_url", "status", "final_url", "chain", "link_type", "in_map", "linked")


@query("a1_whole_audit_summary", "SELECT * FROM run_summary")
def _(spark, d):
    return audited(spark, d)["summary"]


@query("a1_whole_audit_findings", f"""SELECT site, ord::BIGINT AS ord, code, n::BIGINT AS n,
      CASE WHEN code = 'missing_alts' AND total_images > 0 THEN round(n::DOUBLE / total_images * 100, 1) END AS share_pct,
      CASE WHEN score < 60 THEN 'substantial_gap' WHEN score < 80 THEN 'partly_optimised' ELSE 'good_level' END AS closing
    FROM run_summary, LATERAL (VALUES {', '.join(f"({i + 1}, '{c}', {QW._found.get(c, e)})" for i, (c, e) in enumerate(zip(S.DIAGNOSIS, QW._diag)))})
      v(ord, code, n) WHERE n > 0""")
def _(spark, d):
    return audited(spark, d)["diagnosis"]


# --- runs in a store --------------------------------------------------------------------------------------------
# the first run covers all sites; the second only those with an even number, without the dead pages; the third breaks off
_EVEN = "right(site, 1) IN ('0', '2', '4', '6', '8')"
view("runs_now", f"SELECT * FROM audit_mask WHERE available OR NOT {_EVEN}")
D.VIEWS["runs_summary"] = re.sub(r"\baudit_mask\b", "runs_now", D.VIEWS["summary_pages"])


def three_runs(spark, d):
    path = store(spark)
    rows = runs.write_table(QW.masked(spark, d), path, "audit", "first")
    head = lambda df: df.groupBy("site").agg(F.count("*").alias("total_pages"))
    runs.commit(head(rows), path, "first", AT)
    again = runs.write_table(rows.where(f"available AND {_EVEN}"), path, "audit", "second")
    runs.commit(head(again), path, "second", AT + dt.timedelta(days=1))
    runs.write_table(rows.withColumn("available", F.lit(False)), path, "audit", "third")
    return path


@query("a11_runs_list", f"""SELECT site, 'first' AS run_id, count(*) AS total_pages, TIMESTAMP '2024-05-01' AS scan_date FROM audit_mask GROUP BY 1
    UNION ALL SELECT site, 'second', count(*), TIMESTAMP '2024-05-02' FROM audit_mask WHERE available AND {_EVEN} GROUP BY 1""")
def _(spark, d):
    return runs.list_runs(spark, three_runs(spark, d)).select("site", "run_id", "total_pages", "scan_date")


@query("a11_runs_restore", "SELECT site, seq, url, available, seo_score, CASE WHEN %s THEN 'second' ELSE 'first' END AS run_id FROM runs_now" % _EVEN)
def _(spark, d):
    return runs.restore(spark, three_runs(spark, d), "audit").select("site", "seq", "url", "available", "seo_score", "run_id")


@query("a11_runs_restore_summary", "SELECT * FROM runs_summary")
def _(spark, d):
    return S.compute_summary(runs.restore(spark, three_runs(spark, d), "audit"), platforms=QW.site_platforms(spark, d))
