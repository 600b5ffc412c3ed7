"""Everything a page says, as column expressions over its HTML.

Markup is read with regular expressions that take a tag with its quoted attributes as one token, so a ``>`` inside a value ends
nothing.  Every fact is a column of its own: a query that selects the title pays for the title.  Only JSON-LD, whose objects
nest without a fixed depth, goes through a small Arrow UDF; it sees the JSON-LD blocks and nothing else of the page.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from crawlwright import constants as K
from crawlwright.functions.text import decode_entities, edges, let, literal_array, squeeze, strip, text, western_digits
from crawlwright.functions.urls import (clean_image_url, clean_url, crawl_reject_reason, image_format, image_stem,
                                        norm_host_of, resolve_href, url_key)
from crawlwright.operators.classify import classify_pages, language_of
from crawlwright.operators.grading import grade_alt, grade_length, title_h1_match
from crawlwright.operators.pages import html_title

TAG_REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
# Page furniture by tag and the id or class that marks it.
FURNITURE = (("header", "site-header|main-header"), ("footer", "site-footer|main-footer"), ("nav", "main-nav|main-navigation"), ("aside", "sidebar"))
CARDS = "salla-product-card|custom-salla-product-card|salla-products-list"
NOT_A_LINK = "^(?:mailto:|tel:|javascript:|#)"
LOW_CONTENT_SHARE = 0.15
MANY_CHARS = 200


# --- markup ----------------------------------------------------------------------------------------
def tags(html: Column, names: str) -> Column:
    """All start tags of the given names, with their attributes."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)<(?:{names})(?=[\s/>]){TAG_REST}"), F.lit(0))


def attr(tag: Column, name: str) -> Column:
    """An attribute's decoded value; '' if it is missing."""
    pattern = rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    found = decode_entities(F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]))
    return F.when(~_names(tag, F.lit(name)), "").otherwise(found)


def _names(tag: Column, name: Column) -> Column:
    """Whether a tag may have the attribute: most tags lack most attributes, and a pattern costs more than this."""
    return F.contains(F.lower(tag), name)


def _attr_named(tag: Column, name: Column) -> Column:
    """An attribute whose name is a column: one expression for a whole list of names."""
    pattern = F.concat(F.lit(r"(?i)\s"), name, F.lit(r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""))
    found = decode_entities(F.regexp_replace(F.coalesce(F.try_element_at(F.regexp_extract_all(tag, pattern, F.lit(1)), F.lit(1)), F.lit("")),
                                             """^["']|["']$""", ""))
    return F.when(~_names(tag, name), "").otherwise(found)


def first_filled(values: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(values, lambda v: v != ""), F.lit(1)), F.lit(""))


def one_row_each(df: DataFrame, keep: list[str], values: Column, name: str) -> DataFrame:
    """``keep`` with a row per value.  An inner explode would have Spark test the size of ``values`` first, which computes a list read
    from HTML once more for every step that it is made of."""
    return df.select(*keep, F.posexplode_outer(values).alias("_pos", name)).where(F.col("_pos").isNotNull()).drop("_pos")


def without(html: Column, names: str) -> Column:
    """The page without the elements of the given names."""
    return F.regexp_replace(html, rf"(?is)<({names})(?=[\s/>]){TAG_REST}.*?</\1\s*>", " ")


def words_of(html: Column) -> Column:
    return squeeze(decode_entities(F.regexp_replace(html, rf"<[a-zA-Z/!]{TAG_REST}", " ")))


def _cut_furniture(opening: str, name: str):
    def cut(part: Column) -> Column:
        return let(F.regexp_instr(part, F.lit(opening)), lambda at: shortened(part, at))

    def shortened(part: Column, at: Column) -> Column:
        inside = F.substring(part, at, F.length(part))
        kept = (at == 0) | inside.rlike(r"""(?i)<main(?=[\s>])|\sclass\s*=\s*["'][^"']*product""")
        return F.when(kept, F.concat(part, F.lit(f"</{name}>"))).otherwise(F.substring(part, F.lit(1), at - 1))
    return cut


def without_furniture(html: Column) -> Column:
    """The page without marked headers, footers, navigation and side bars.  One that holds the main part or a product stays."""
    for name, marks in FURNITURE:
        html = let(html, _without_one(name, rf"""(?is)<{name}(?=\s)[^>]*?\s(?:id|class)\s*=\s*["'](?:[^"']*\s)?(?:{marks})(?=[\s"'])"""))
    return html


def _without_one(name: str, opening: str):
    def rebuilt(parts: Column) -> Column:
        head = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), _cut_furniture(opening, name))
        return F.concat(F.array_join(head, " "), F.lit(" "), F.element_at(parts, -1))
    return lambda html: F.when(html.rlike(opening), let(F.split(html, rf"(?i)</{name}\s*>"), rebuilt)).otherwise(html)


def meta(metas: Column, key: str, value: str) -> Column:
    """The first filled content of the meta tags whose ``key`` attribute has the value."""
    return first_filled(F.transform(F.filter(metas, lambda m: F.lower(attr(m, key)) == value), lambda m: attr(m, "content")))


def unescape_script(c: Column) -> Column:
    """Undo JSON escapes in script text; UTF-16 pairs become one character, lone halves vanish."""
    low, high = r"\\u[dD][89abAB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    pieces = F.regexp_extract_all(F.replace(text(c), F.lit("\\/"), F.lit("/")),
                                  F.lit(rf"(?s){low}{high}|\\u[0-9a-fA-F]{{4}}|[^\\]++|\\"), F.lit(0))

    def one(p: Column) -> Column:
        units = F.replace(p, F.lit("\\u"), F.lit(""))
        char = F.when(p.rlike("^(?:" + low + ")?" + high + "$") | p.rlike(f"^{low}$"),
                      F.when(F.length(p) == 12, F.decode(F.unhex(units), "UTF-16BE")).otherwise("")).otherwise(F.decode(F.unhex(units), "UTF-16BE"))
        return F.when(p.rlike(r"^\\u[0-9a-fA-F]{4}"), char).otherwise(p)

    plain = F.replace(text(c), F.lit("\\/"), F.lit("/"))
    return F.when(F.contains(text(c), F.lit("\\u")), F.array_join(F.transform(pieces, one), "")).otherwise(plain)


# --- images ----------------------------------------------------------------------------------------
def _usable(value: Column) -> Column:
    return let(strip(value), lambda v: F.when(v.startswith("data:"), "").otherwise(v))


def first_candidate(srcset: Column) -> Column:
    """First URL of a srcset.  Candidates end at white space; commas inside a URL belong to it."""
    words = F.transform(F.split(strip(srcset), r"\s+"), lambda w: F.regexp_replace(w, ",+$", ""))
    return first_filled(F.filter(words, lambda w: ~w.rlike(r"^[\d.]+[wx]$")))


def page_pictures(html: Column) -> Column:
    """``array<struct<src, alt, marks>>`` of all pictures in order: a picture element is one, and an image takes the source of the
    noscript copy that follows it if it has none itself."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<picture(?=[\s>]).*?</picture\s*>|<noscript(?=[\s>]).*?</noscript\s*>|"
                                             rf"<(?:img|salla-image)(?=[\s/>]){TAG_REST}"), F.lit(0))

    def one(token: Column, after: Column) -> Column:
        first = F.coalesce(F.try_element_at(tags(token, "img|salla-image"), F.lit(1)), F.lit(""))
        return let(first, lambda img: _picture(token, after, img))

    def _picture(token: Column, after: Column, img: Column) -> Column:
        sets = F.concat(F.transform(tags(token, "source"), lambda t: F.coalesce(F.nullif(attr(t, "srcset"), F.lit("")), attr(t, "data-srcset"))),
                        F.array(*[attr(img, n) for n in ("data-srcset", "data-lazy-srcset", "srcset")]))
        copy = F.when(F.lower(after).startswith("<noscript"),
                      first_filled(F.transform(tags(after, "img"), lambda t: _usable(attr(t, "src"))))).otherwise("")
        return F.struct(first_filled(F.concat(F.transform(literal_array(K.LAZY_IMAGE_ATTRS), lambda n: _usable(_attr_named(img, n))),
                                              F.transform(sets, lambda s: first_candidate(_usable(s))),
                                              F.array(_usable(attr(img, "src")), copy))).alias("src"),
                        strip(attr(img, "alt")).alias("alt"), F.lower(F.concat_ws(" ", attr(img, "class"), attr(img, "id"))).alias("marks"),
                        (img != "").alias("real"))

    def all_of(tokens: Column) -> Column:
        rows = F.transform(tokens, lambda t, i: one(t, F.coalesce(F.try_element_at(tokens, i + 2), F.lit(""))))
        return F.filter(F.zip_with(rows, tokens, lambda r, t: F.when(~F.lower(t).startswith("<noscript"), r)),
                        lambda r: r.isNotNull() & r["real"])

    return let(found, all_of)


def is_content_picture(picture: Column) -> Column:
    """Not a logo, an icon, a badge, a spacer or anything else that belongs to the template."""
    low = F.lower(picture["src"])
    path = F.regexp_replace(F.regexp_replace(low, r"^[a-z][a-z0-9+.\-]*://[^/?#]*", ""), r"(?s)[?#].*$", "")
    template = (F.arrays_overlap(F.split(path, "[^a-z0-9]+"), literal_array(K.JUNK_IMAGE_WORDS)) | picture["marks"].rlike("logo|brand|favicon")
                | F.regexp_replace(low, r"(?s)\?.*$", "").rlike(r"\.(?:gif|svg|ico)$")
                | low.rlike("|".join([r"static\.", "/static/", *[p.replace(".", r"\.") for p in K.JUNK_IMAGE_PARTS]])))
    return (picture["src"] != "") & ~template


# --- JSON-LD ---------------------------------------------------------------------------------------
_TEXTS = ("name", "sku", "brand", "category", "description")
DECLARED = StructType([StructField("types", ArrayType(StringType())), *[StructField(n, StringType()) for n in _TEXTS],
                       StructField("images", ArrayType(StringType())), StructField("offers", BooleanType()), StructField("items", LongType()), StructField("broken", BooleanType())])
MOST_ITEMS = 1 << 31  # a larger number of items, or an infinite one, is no count


def _objects(value) -> Iterator[dict]:
    """A JSON value's objects: each before those inside it, later siblings first; nesting may be of any depth."""
    open_ = [value]
    while open_:
        value = open_.pop()
        if isinstance(value, dict):
            yield value
            value = list(value.values())
        if isinstance(value, list):
            open_.extend(value)


def _clean(value: str) -> str:
    """JSON may spell half of a surrogate pair, which is no text."""
    return value.encode("utf-8", "replace").decode()


def _kinds(node) -> set[str]:
    kind = node.get("@type") if isinstance(node, dict) else None
    return {_clean(str(k)) for k in (kind if isinstance(kind, list) else [kind]) if k}


def _string(value, key: str | None = None) -> str:
    value = value.get(key) if key and isinstance(value, dict) else value
    return "" if value is None or isinstance(value, (dict, list)) else _clean(str(value))


def _listed(value) -> list:
    return value if isinstance(value, list) else []


def _declared(blocks) -> dict:
    values, broken = [], False
    for block in blocks if blocks is not None else ():
        try:
            values.append(json.loads(block))
        except (ValueError, RecursionError):
            broken = True
    outer = [n for v in values for n in (v if isinstance(v, list) else [v]) if isinstance(n, dict)]
    outer += [n for o in outer for n in _listed(o.get("@graph"))]
    nodes = [n for v in values for n in _objects(v)]
    of_kind = lambda *kinds: (n for n in nodes if _kinds(n).intersection(kinds))
    product = next(of_kind("Product"), {})
    pictures = product.get("image") or []
    pictures = [p.get("url") or p.get("contentUrl") if isinstance(p, dict) else p for p in (pictures if isinstance(pictures, list) else [pictures])]
    trails = [[_string(i["item"] if isinstance(i.get("item"), dict) else i, "name").strip() for i in _listed(n.get("itemListElement")) if isinstance(i, dict)]
              for n in of_kind("BreadcrumbList")]
    trails = [[name for name in t if name] for t in trails]
    counts = [n.get("numberOfItems") for n in of_kind("ItemList", "CollectionPage")]
    return {"types": sorted(set().union(*map(_kinds, outer))), "name": _string(product.get("name")) if isinstance(product.get("name"), str) else "",
            "sku": _string(product.get("sku")), "brand": _string(product.get("brand"), "name").strip(),
            "category": next((t[-2] for t in trails if len(t) > 1), ""), "description": _string(product.get("description")),
            "images": [_clean(p).strip() for p in pictures if isinstance(p, str) and p.strip()], "offers": bool(product.get("offers")),
            "items": next((int(c) for c in counts if isinstance(c, (int, float)) and 0 < c < MOST_ITEMS), None), "broken": broken}


EMPTY = {"types": [], **dict.fromkeys(_TEXTS, ""), "images": [], "offers": False, "items": None, "broken": True}


def declared(blocks) -> dict:
    """The facts of a page's JSON-LD; a page that defeats the reader has none and says so, and stops no other page."""
    try:
        return _declared(blocks)
    except Exception:  # noqa: BLE001
        return EMPTY


@F.pandas_udf(DECLARED)
def declared_facts(blocks: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([declared(b) for b in blocks], columns=[f.name for f in DECLARED.fields]).astype({"items": "Int64"})


def plain_text(c: Column) -> Column:
    bare = F.regexp_replace(text(c), "<[^>]+>", " ")
    return squeeze(F.replace(F.replace(bare, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&")))


# --- one row per page ------------------------------------------------------------------------------
def _signal(types: Column, marks: Column, og_type: Column) -> Column:
    """What the page calls itself: product, article or collection."""
    out = F.lit("")
    for signal, kinds, word in (("collection", ("CollectionPage",), None), ("article", ("Article", "BlogPosting", "NewsArticle"), "article|blog"),
                                ("product", ("Product", "IndividualProduct"), "product")):
        hit = F.arrays_overlap(types, literal_array(kinds)) | marks.rlike(r"(?i)schema\.org/(?:" + "|".join(kinds) + ")")
        out = F.when((hit | og_type.rlike(word)) if word else hit, signal).otherwise(out)
    return out


def read_pages_html(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page with every fact, arrays nested: D1's page table before grading.  Columns in ``keep`` come along."""
    cols = [c if c in pages.columns else F.lit("").alias(c) for c in ("site", "page_id", "url", "html", "robots_header")]
    url, bare = F.col("url"), F.col("_bare")
    df = pages.select(*cols, *keep).withColumn("html", text(F.col("html")))
    df = df.withColumn("_bare", F.regexp_replace("html", "(?s)<!--.*?-->", " "))
    # stage by stage, so that what many facts need is computed once
    df = df.withColumns({
        "_any": tags(bare, "[a-zA-Z][a-zA-Z0-9-]*"), "_meta": tags(bare, "meta"), "_links": tags(bare, "link|a"), "_seen": without(bare, "script|style|noscript"), "_script": unescape_script(bare),
        "_ld": F.regexp_extract_all("_bare", F.lit(r"""(?is)<script(?=\s)[^>]*?type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""), F.lit(1))})
    df = df.withColumns({"_all": words_of(F.col("_seen")), "_main": words_of(without_furniture(F.col("_seen"))), "_said": declared_facts("_ld")})
    thin = (F.length("_all") > MANY_CHARS) & (F.length("_main") < LOW_CONTENT_SHARE * F.length("_all"))
    df = df.withColumns({"_thin": thin, "body_text": F.when(thin, F.col("_all")).otherwise(F.col("_main"))})
    df = df.withColumn("_pictures", F.filter(page_pictures(F.when(F.col("_thin"), bare).otherwise(without_furniture(bare))), is_content_picture))

    full = lambda arr: F.filter(F.transform(arr, strip), lambda h: h != "")
    absolute = lambda arr: F.transform(arr, lambda h: resolve_href(url, h))
    h1 = lambda html: F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<h1(?=[\s>]){TAG_REST}(.*?)</h1\s*>"), F.lit(1)), words_joined)
    words_joined = lambda t: squeeze(decode_entities(F.regexp_replace(t, f"<[a-zA-Z/!]{TAG_REST}", "")))
    metas, links = F.col("_meta"), F.col("_links")
    cards = tags(bare, CARDS)
    card = F.flatten(F.transform(cards, lambda t: let(attr(t, "product"), lambda j: F.array(
        *[attr(t, n) for n in ("url", "data-url", "link")], F.coalesce(F.get_json_object(j, "$.url"), F.get_json_object(j, "$.slug"), F.lit(""))))))
    hrefs = F.filter(full(F.concat(F.transform(tags(bare, "a|salla-button|div|button"), lambda t: attr(t, "href")),
                                   F.transform(F.col("_any"), lambda t: attr(t, "data-href")), card)), lambda h: ~h.rlike(NOT_A_LINK))
    nexts = full(F.concat(
        F.transform(F.filter(links, lambda t: F.lower(attr(t, "rel")).rlike(r"(?:^|\s)next(?:\s|$)")), lambda t: attr(t, "href")),
        F.flatten(F.transform(F.filter(F.col("_any"), lambda t: t.rlike(r"(?i)\s(?:data-)?next")), lambda t: F.transform(
            literal_array(K.NEXT_PAGE_ATTRS), lambda n: _attr_named(t, n)))),
        F.regexp_extract_all("_script", F.lit(K.NEXT_PAGE_JSON_PATTERN), F.lit(1))))
    same = lambda u: F.regexp_replace(u, "/+$", "") == F.regexp_replace(url, "/+$", "")
    canonical = first_filled(F.transform(F.filter(links, lambda t: F.lower(t).startswith("<link") & F.contains(F.lower(attr(t, "rel")), F.lit("canonical"))),
                                         lambda t: attr(t, "href")))
    robots = F.exists(metas, lambda m: F.lower(attr(m, "name")).isin("robots", "googlebot") & F.contains(F.lower(attr(m, "content")), F.lit("noindex")))
    og_text, own_text = meta(metas, "property", "og:description"), meta(metas, "name", "description")
    said = F.col("_said")
    types = F.concat_ws(" ", F.transform(F.filter(F.col("_any"), lambda t: t.rlike(r"(?i)\sitemtype")), lambda t: attr(t, "itemtype")))
    either = lambda a, b: F.when(a != "", a).otherwise(b)
    return df.select(
        *keep, "site", "page_id", "url", html_title(bare).alias("title"), squeeze(either(own_text, og_text)).alias("meta_desc"),
        F.when(canonical != "", resolve_href(url, canonical)).otherwise("").alias("canonical"),
        either(either(first_filled(h1(without(F.col("_seen"), "header|nav"))), first_filled(h1(F.col("_seen")))),
               squeeze(meta(metas, "property", "og:title"))).alias("h1"),
        first_filled(F.transform(tags(bare, "html"), lambda t: attr(t, "lang"))).alias("html_lang"),
        (robots | F.contains(F.lower(text(F.col("robots_header"))), F.lit("noindex"))).alias("noindex"),
        _signal(said["types"], types, F.lower(meta(metas, "property", "og:type"))).alias("html_signal"),
        F.when(F.col("body_text") == "", 0).otherwise(F.size(F.split("body_text", " "))).alias("word_count"), "body_text",
        F.transform("_pictures", lambda p, i: F.struct((i + 1).alias("pos"), resolve_href(url, p["src"]).alias("src"), p["alt"].alias("alt"))).alias("images"),
        F.array_distinct(absolute(hrefs)).alias("hrefs"),
        F.array_distinct(absolute(full(F.regexp_extract_all("_script", F.lit(K.EMBEDDED_LINK_PATTERN), F.lit(0))))).alias("embedded"),
        F.array_sort(F.array_distinct(F.filter(absolute(F.filter(nexts, lambda n: ~n.rlike("^(?:#|javascript:)"))), lambda n: ~same(n)))).alias("next_pages"),
        F.lower("html").rlike("|".join(K.SCROLL_MARKERS)).alias("scroll_marker"), squeeze(said["name"]).alias("declared_name"), said["sku"].alias("sku"),
        said["brand"].alias("brand"), said["category"].alias("category"),
        plain_text(either(said["description"], either(og_text, own_text))).alias("product_desc"),
        F.array_distinct(F.transform(said["images"], clean_image_url)).alias("product_images"), said["offers"].alias("offers"),
        said["items"].cast("int").alias("item_count"), F.length("html").alias("html_chars"), said["broken"].alias("ld_error"))


def page_audit(facts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The page table: grades, canonical state, language and excerpt.  Columns in ``keep`` come along."""
    same = url_key(F.col("canonical")) == url_key(F.col("url"))
    title_len, desc_len = F.length("title").cast("bigint"), F.length("meta_desc").cast("bigint")
    return facts.select(
        *keep, "site", "page_id", "url", "title", title_len.alias("title_len"), grade_length(title_len, K.TITLE_BOUNDS).alias("title_status"),
        "meta_desc", desc_len.alias("desc_len"), grade_length(desc_len, K.DESC_BOUNDS).alias("desc_status"),
        F.col("h1").alias("display_name"), title_h1_match(F.col("title"), F.col("h1")).alias("h1_match"),
        (~F.col("noindex")).alias("indexable"), "html_signal", F.col("word_count").cast("bigint").alias("word_count"),
        F.when(F.col("word_count") >= K.THIN_WORDS, "good").otherwise("thin").alias("content_status"),
        F.when(F.col("canonical") == "", "canon_missing").when(same, "canon_same").otherwise("canon_diff").alias("canonical_status"),
        F.when((F.col("canonical") != "") & ~same, clean_url(F.col("canonical"))).otherwise("").alias("canonical_url"),
        language_of(F.col("html_lang"), F.concat_ws(" ", "title", "body_text")).alias("lang"),
        F.substring("body_text", 1, K.EXCERPT_CHARS).alias("excerpt"), "declared_name", "sku", "brand", "category",
        "product_desc", "offers", F.size("product_images").cast("bigint").alias("declared_images"),
        F.size("images").cast("bigint").alias("total_images"), "scroll_marker")


def page_images(facts: DataFrame) -> DataFrame:
    """One row per content image with its page's type; ``own_image`` by the file stems the product data names, null
    without any."""
    stems = F.transform("product_images", lambda u: image_stem(u))
    df = classify_pages(facts, signal=F.col("html_signal")).select(
        "site", F.col("url").alias("page_url"), "page_type", F.col("page_id").alias("seq"), stems.alias("_stems"), "images")
    df = one_row_each(df, ["site", "page_url", "page_type", "seq", "_stems"], F.col("images"), "i")
    url = clean_image_url(F.col("i.src"))
    df = df.select("site", "page_url", "page_type", "seq", F.col("i.pos").cast("bigint").alias("image_pos"),
                   url.alias("image_url"), F.col("i.alt").alias("alt"), image_format(F.col("i.src")).alias("image_format"),
                   F.when(F.size("_stems") > 0, F.array_contains("_stems", image_stem(url))).alias("own_image"))
    return grade_alt(df)


def page_link_rows(facts: DataFrame) -> DataFrame:
    """D3: followable links of markup and scripts.

    A script link that ends in '-' and starts another link of the page is cut short: it goes.
    """
    site_host = norm_host_of(F.col("site"))
    clean = F.array_distinct(F.transform("embedded", lambda u: clean_url(u)))
    known = F.array_union(F.transform("hrefs", lambda u: clean_url(u)), clean)
    whole = F.filter(clean, lambda u: ~u.endswith("-") | ~F.exists(known, lambda o: (o != u) & o.startswith(u)))
    links = F.array_union(F.transform("hrefs", lambda u: clean_url(u)), whole)
    df = one_row_each(facts, ["site", "page_id", "url"], links, "dst_url").distinct()
    df = df.where(crawl_reject_reason(F.col("dst_url"), site_host) == "")
    return df.select("site", "page_id", url_key(F.col("url")).alias("src_key"), "dst_url", url_key(F.col("dst_url")).alias("dst_key"))


def listing_next(facts: DataFrame) -> DataFrame:
    """Next-page links of listing pages, query string kept."""
    site_host = norm_host_of(F.col("site"))
    df = one_row_each(facts, ["site", "page_id", "url", "scroll_marker"], F.col("next_pages"), "next_url")
    return df.where(crawl_reject_reason(clean_url(F.col("next_url")), site_host) == "")


def declared_count(body, item_count=None):
    """An explicit total, else the structured number, else the largest of five phrasings; digits of either script."""
    ints = lambda arr: F.filter(F.transform(arr, lambda x: F.try_to_number(
        F.regexp_replace(western_digits(x), ",", ""), F.lit("99999999999")).cast("bigint")),
        lambda n: n > 0)
    def strong(b):
        pat = edges(K.STRONG_COUNT_PATTERN)
        return ints(F.transform(F.regexp_extract_all(b, F.lit(pat), F.lit(0)),
                                lambda m: F.regexp_extract(m, "([0-9,٠-٩]*[0-9٠-٩][0-9,٠-٩]*)", 1)))
    western = western_digits(body)
    loose = [ints(F.regexp_extract_all(western, F.lit(edges(p)), F.lit(1))) for p in K.COUNT_PATTERNS]
    every = loose[0]
    for arr in loose[1:]:
        every = F.concat(every, arr)
    item = F.lit(None).cast("bigint") if item_count is None else item_count.cast("bigint")
    return F.coalesce(F.try_element_at(strong(text(body)), F.lit(1)), item, F.array_max(every)).cast("bigint")


def listing_payload_text(responses: DataFrame) -> DataFrame:
    """The readable text of a listing response: HTML as it is, the first string field of a JSON reply that holds markup,
    else the reply without its escapes."""
    body, kind = text(F.col("body")), F.lower(text(F.col("content_type")))
    is_json = F.contains(kind, F.lit("json")) | strip(body).rlike(r"^[\{\[]")

    def field(reply: Column) -> Column:
        found = []
        for name in ("html", "content", "data", "products"):
            value = F.try_variant_get(reply, f"$.{name}", "variant")
            found.append(F.when((F.schema_of_variant(value) == "STRING") & F.contains(value.cast("string"), F.lit("<")), value.cast("string")))
        return F.coalesce(*found)

    plain = F.replace(body, F.lit("\\/"), F.lit("/"))
    return responses.withColumn("listing_text", F.when(is_json, F.coalesce(let(F.try_parse_json(body), field), unescape_script(body))).otherwise(plain))
