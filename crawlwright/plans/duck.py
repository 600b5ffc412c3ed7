"""DuckDB text fragments for the check queries: the same rules, written in DuckDB SQL.

Nothing here runs in Spark.  ``build`` puts the views that a query names in front of it as CTEs.
"""

from __future__ import annotations

import re

from crawlwright import constants as K
from crawlwright.functions import text as T

SP = T.SPACE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def inlist(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def tx(x):
    return f"coalesce({x}, '')"


def sq(x):
    return f"trim(regexp_replace({tx(x)}, {q(SP + '+')}, ' ', 'g'))"


def strip(x):
    return f"regexp_replace({tx(x)}, {q(f'^{SP}+|{SP}+$')}, '', 'g')"


def has(x, pattern):
    return f"regexp_matches({x}, {q(pattern)})"


def sub(x, pattern, repl=""):
    return f"regexp_replace({x}, {q(pattern)}, {q(repl)}, 'g')"


def fold_ar(t):
    t = sub(t, r"^[.,،؛:!?()\[\]]+|[.,،؛:!?()\[\]]+$")
    t = sub(t, T.ARABIC_MARKS)
    t = f"translate({t}, 'أإآىة', 'ااايه')"
    return f"regexp_replace({t}, {q('^(?:' + '|'.join(K.ARABIC_PREFIXES) + ')(..)')}, '\\1')"


def fold(t):
    return f"CASE WHEN {has(t, T.ARABIC)} THEN {fold_ar(t)} ELSE {t} END"


def toks(x):
    cut = (f"list_transform(string_split_regex(lower({tx(x)}), {q(T.TOKEN_SPLIT)}), "
           f"lambda t: {sub('t', T.TOKEN_DROP)})")
    return f"list_transform(list_filter({cut}, lambda t: length(t) >= 2), lambda t: {fold('t')})"


def wtoks(x):
    return f"list_distinct(list_filter({toks(x)}, lambda t: NOT {has('t', r'^\p{Nd}+$')}))"


def ld(x):
    return sub(tx(x), r"[^0-9A-Za-z\x{0600}-\x{06FF}]+")


def script(x):
    ar = f"length({sub(tx(x), r'[^\x{0600}-\x{06FF}]')})"
    la = f"length({sub(tx(x), '[^A-Za-z]')})"
    return f"CASE WHEN {ar} = 0 AND {la} = 0 THEN '' WHEN {ar} >= {la} THEN 'ar' ELSE 'la' END"


def entities(x):
    for e, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"),
                 ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {q(e)}, {q(c)})"
    return x


def grade(n, b):
    return (f"CASE WHEN {n} = 0 THEN 'missing' WHEN {n} < {b[0]} THEN 'very_short' WHEN {n} < {b[1]} THEN "
            f"'acceptable' WHEN {n} <= {b[2]} THEN 'optimal' ELSE 'long' END")


def lookup(c, pairs, default):
    return f"CASE {c} " + " ".join(f"WHEN {q(k)} THEN {v!r}" for k, v in pairs) + f" ELSE {default} END"


# --- URLs ------------------------------------------------------------------------------------------
LANG = "^(?:" + "|".join(K.LANG_CODES) + ")(?:[-_][a-z]{2})?$"
SCHEME_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*"


def clean(u):
    return f"regexp_replace(regexp_replace({tx(u)}, '(?s)[?#].*$', ''), '/+$', '')"


def nobreak(u):
    return f"translate({tx(u)}, chr(9) || chr(10) || chr(13), '')"


def host(u):
    netloc = f"regexp_extract({nobreak(u)}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"
    return f"regexp_replace(regexp_extract(lower({netloc}), '^([^:]*)', 1), '^www\\.', '')"


def path(u):
    p = f"regexp_replace({nobreak(u)}, {q(SCHEME_HOST)}, '')"
    return f"regexp_replace(regexp_replace({p}, '[?#].*$', ''), ';[^/]*$', '')"


def decode(x):
    return f"url_decode({x})"


def allsegs(u):
    return f"list_filter(string_split({decode(path(clean(u)))}, '/'), lambda s: s <> '')"


def droplang(s):
    return f"CASE WHEN {has(f'lower({tx(s + "[1]")})', LANG)} THEN {s}[2:] ELSE {s} END"


def key_from(h, segs, low):
    last = tx(f"{low}[-1]")
    kind = f"regexp_extract({last}, {q(K.KEY_ID_PATTERN)}, 1)"
    num = f"regexp_extract({last}, {q(K.KEY_ID_PATTERN)}, 2)"
    return (f"CASE WHEN {kind} <> '' THEN {h} || '/#' || {kind} || {num} "
            f"WHEN {low}[1] IN ('categories', 'category') AND {has(tx(low + '[2]'), '^[0-9]+$')} "
            f"THEN {h} || '/#cat' || {low}[2] "
            f"ELSE lower(regexp_replace({h} || '/' || array_to_string({segs}, '/'), '/+$', '')) END")


def parts(u, p=""):
    """Select items (lateral aliases) for one URL column."""
    return (f"{host(clean(u))} AS {p}host, {allsegs(u)} AS {p}alls, {droplang(f'{p}alls')} AS {p}segs, "
            f"coalesce({has(f'lower({p}alls[1])', LANG)}, false) AS {p}has_lang, "
            f"list_transform({p}segs, lambda s: lower(s)) AS {p}low, "
            f"CASE WHEN {tx(u)} = '' THEN '' ELSE {key_from(f'{p}host', f'{p}segs', f'{p}low')} END AS {p}url_key")


def key(u):
    """Key as one scalar subquery-free expression (used where a lateral alias cannot be)."""
    segs = f"(CASE WHEN {has(f'lower({tx(allsegs(u) + "[1]")})', LANG)} THEN ({allsegs(u)})[2:] ELSE {allsegs(u)} END)"
    low = f"list_transform({segs}, lambda s: lower(s))"
    return f"CASE WHEN {tx(u)} = '' THEN '' ELSE {key_from(host(clean(u)), segs, '(' + low + ')')} END"


def is_id(seg):
    return has(f"lower({tx(seg)})", "|".join((K.PRODUCT_ID_PATTERN, K.CATEGORY_ID_PATTERN, K.INFO_ID_PATTERN,
                                             K.BRAND_ID_PATTERN, K.ARTICLE_ID_PATTERN, r"^[0-9]+$")))


def slug(segs):
    return f"CASE WHEN {is_id(segs + '[-1]')} AND len({segs}) >= 2 THEN {segs}[-2] ELSE {tx(segs + '[-1]')} END"


def overlap(a, values):
    return f"list_has_any({a}, {lst(values)})"


def is_tag(u):
    low = f"url_decode(lower({tx(u)}))"
    segs = f"list_filter(string_split({path(low)}, '/'), lambda s: s <> '')"
    stem = "^(?:" + "|".join(K.TAG_STEMS) + ")[-_]"
    query = f"regexp_extract(regexp_replace({nobreak(low)}, '#.*$', ''), '\\?(.*)$', 1)"
    return (f"({overlap(segs, K.TAG_WORDS)} OR len(list_filter({segs}, lambda s: {has('s', stem)})) > 0 "
            f"OR {has(query, '|'.join(K.TAG_QUERY_KEYS))})")


def subpage(low):
    return (f"(len({low}) >= 3 AND {low}[1] IN {inlist(K.PRODUCT_ROOTS)} AND {low}[-1] IN "
            f"{inlist(K.PRODUCT_SUBPAGES)})")


def decisive(low):
    first, second, last = tx(f"{low}[1]"), tx(f"{low}[2]"), tx(f"{low}[-1]")
    cats = ("tag", "tags", "category", "categories", "author")
    return (f"CASE WHEN {has(last, K.PRODUCT_ID_PATTERN)} THEN 'product' "
            f"WHEN {has(last, K.BRAND_ID_PATTERN)} OR {has(last, K.CATEGORY_ID_PATTERN)} THEN 'category' "
            f"WHEN {has(last, K.INFO_ID_PATTERN)} THEN 'info' "
            f"WHEN {has(last, K.ARTICLE_ID_PATTERN)} AND len({low}) >= 2 THEN 'blog' "
            f"WHEN {first} IN {inlist(K.BLOG_SEGMENTS)} AND len({low}) >= 2 AND {second} NOT IN {inlist(cats)} "
            f"AND NOT {overlap(f'{low}[2:greatest(len({low}) - 1, 2)]', cats)} THEN 'blog' "
            f"WHEN {first} IN {inlist(K.PRODUCT_ROOTS)} AND len({low}) >= 2 THEN 'product' "
            f"WHEN {first} IN ('categories', 'category', 'collections') AND len({low}) >= 2 THEN 'category' "
            f"WHEN {first} = 'pages' AND len({low}) >= 2 THEN 'info' ELSE '' END")


def listing_kind(low):
    first, last = tx(f"{low}[1]"), tx(f"{low}[-1]")
    b = has(last, K.BRAND_ID_PATTERN)
    return (f"CASE WHEN len({low}) = 0 THEN 'listing' WHEN {b} OR ({first} IN {inlist(K.BRAND_ROOTS)} AND "
            f"len({low}) >= 2) THEN 'brand' WHEN {first} IN {inlist(K.BRAND_ROOTS)} OR array_to_string({low}, '/') "
            f"IN {inlist(K.CATALOG_ROOTS)} THEN 'listing' ELSE 'category' END")


def page_type(low, k, home, tag, sig="''"):
    from crawlwright.operators.classify import POLICY_TOKENS
    first, last = tx(f"{low}[1]"), tx(f"{low}[-1]")
    before = f"{low}[1:greatest(len({low}) - 1, 0)]"
    pth = f"array_to_string({low}, '/')"

    def stoks(s):
        cut = f"list_filter(string_split_regex(lower({s}), '[-_]+'), lambda t: t <> '')"
        return f"list_filter(list_transform({cut}, lambda t: {fold_ar('t')}), lambda t: length(t) > 2)"

    def hits(t):
        return f"len(list_filter({t}, lambda x: x IN {inlist(POLICY_TOKENS)}))"
    bslug = f"CASE WHEN {has(last, '^[a-z]?-?[0-9]+$')} AND len({low}) >= 2 THEN {low}[-2] ELSE {last} END"
    bt = stoks(f"({bslug})")
    blog = (f"CASE WHEN {last} IN {inlist(K.BLOG_SEGMENTS)} OR ({first} = 'blogs' AND len({low}) = 2) THEN 'archive' "
            f"WHEN {has(last, K.CATEGORY_ID_PATTERN)} OR {has(last, K.ARCHIVE_LAST_PATTERN)} OR "
            f"{overlap(before, K.ARCHIVE_PARENTS)} THEN 'archive' WHEN {sig} = 'article' THEN 'blog' "
            f"WHEN {sig} = 'product' THEN 'product' WHEN len({bt}) > 0 AND {hits(bt)} * 2 > len({bt}) THEN 'info' "
            f"ELSE 'blog' END")
    return (f"CASE WHEN {tag} THEN 'archive' WHEN len({low}) = 0 OR {k} = {home} THEN 'home' "
            f"WHEN {has(last, K.PRODUCT_ID_PATTERN)} THEN 'product' "
            f"WHEN NOT {overlap(low, K.BLOG_SEGMENTS)} AND {overlap(before, K.PRODUCT_ROOTS)} THEN 'product' "
            f"WHEN {has(last, K.INFO_ID_PATTERN)} THEN 'info' "
            f"WHEN {first} IN {inlist(K.INFO_ROOTS)} AND len({low}) >= 2 THEN 'info' "
            f"WHEN {overlap(low, K.BLOG_SEGMENTS)} THEN {blog} "
            f"WHEN {has(last, K.BRAND_ID_PATTERN)} OR {has(last, K.CATEGORY_ID_PATTERN)} OR {pth} IN "
            f"{inlist(K.CATALOG_ROOTS)} OR {overlap(low, K.CATEGORY_SEGMENTS)} THEN 'category' "
            f"WHEN {sig} = 'product' THEN 'product' WHEN {sig} = 'article' THEN 'blog' "
            f"WHEN {sig} = 'collection' THEN 'category' "
            f"WHEN {has(last, K.ARCHIVE_LAST_PATTERN)} OR {has(last, '^[0-9]{4}$')} OR "
            f"{overlap(before, K.ARCHIVE_PARENTS)} THEN 'archive' "
            f"WHEN len(list_filter({low}, lambda s: {hits(stoks('s'))} > 0)) > 0 THEN 'info' "
            f"WHEN contains({pth}, '-p-') OR {has(pth, '[-/]p-?[0-9]{4,}$')} THEN 'product' "
            f"WHEN {has(pth, '[-/]c-?[0-9]{4,}$')} THEN 'category' ELSE 'unknown' END")


def resolve(base, href):
    """Absolute, root-relative and plain relative links (what the test pages hold)."""
    root = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)"
    return (f"CASE WHEN {has(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:')} THEN {href} "
            f"WHEN starts_with({href}, '/') THEN {root} || {href} ELSE {root} || '/' || {href} END")


def alt_status(a):
    from crawlwright.operators.grading import GENERIC_ALT
    t = sq(a)
    bare = (f"list_transform(string_split(lower({t}), ' '), lambda w: "
            f"{sub('w', r'^[.,،؛:!?|\-()\[\]]+|[.,،؛:!?|\-()\[\]]+$')})")
    words = f"list_transform(list_filter({bare}, lambda w: w <> ''), lambda w: {fold('w')})"
    commas = f"length({sub(t, '[^,،]')})"
    return (f"CASE WHEN {t} = '' THEN 'alt_missing' "
            f"WHEN {has(f'lower({t})', r'\.(jpg|jpeg|png|webp|gif|svg)$')} OR {has(t, T.NO_LETTERS)} THEN 'alt_generic' "
            f"WHEN len(list_filter({words}, lambda w: w NOT IN {inlist(GENERIC_ALT)})) = 0 THEN 'alt_generic' "
            f"WHEN length({t}) > {K.ALT_MAX} THEN 'alt_long' "
            f"WHEN {commas} >= 4 AND len({words}) < 3 * {commas} THEN 'alt_stuffed' "
            f"WHEN len({words}) >= 6 AND len(list_distinct({words})) * 2 < len({words}) THEN 'alt_stuffed' "
            f"ELSE 'alt_ok' END")


def image_format(u):
    ext = f"regexp_extract(lower({path(u)}), {q(K.IMAGE_FORMAT_PATTERN)}, 1)"
    return (f"CASE WHEN {ext} IN ('jpg', 'jpeg') THEN 'jpg' WHEN {ext} <> '' THEN {ext} ELSE '—' END")


VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def build(sql: str) -> str:
    """Prefix the query with the views it needs, in dependency order."""
    done: list[str] = []

    def visit(text: str, current: str | None) -> None:
        for name in VIEWS:
            if name != current and name not in done and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name], name)
                if name not in done:
                    done.append(name)
    visit(sql, None)
    if not done:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in done)
    head = "WITH RECURSIVE" if "/*recursive*/" in sql else "WITH"
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"{head} {ctes},\n{body[5:]}"
    return f"{head} {ctes}\n{body}"
