"""URL columns: cleaning, decoding, segments, page keys and URL-only classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlwright import constants as K
from crawlwright.functions.text import any_pattern, let, literal_array, text

_SCHEME_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*"
_LANG = "^(?:" + "|".join(K.LANG_CODES) + ")(?:[-_][a-z]{2})?$"


def clean_url(c: Column) -> Column:
    """Drop fragment and query, then trailing slashes."""
    return F.regexp_replace(F.regexp_replace(text(c), r"(?s)[?#].*$", ""), "/+$", "")


def normalize_url(c: Column) -> Column:
    u = F.trim(text(c))
    u = F.when((u == "") | u.startswith("http://") | u.startswith("https://"), u).otherwise(
        F.concat(F.lit("https://"), u))
    return F.regexp_replace(u, "/+$", "")


def percent_decode(c: Column) -> Column:
    """Decode valid %XX sequences and leave every other character, '+' included, as it is."""
    return F.url_decode(F.regexp_replace(F.replace(text(c), F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"))


def _no_breaks(c: Column) -> Column:
    return F.translate(text(c), "\t\r\n", "")


def raw_host(c: Column) -> Column:
    return F.regexp_extract(_no_breaks(c), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def norm_host_of(netloc: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.lower(text(netloc)), "^([^:]*)", 1), r"^www\.", "")


def host(c: Column) -> Column:
    return norm_host_of(raw_host(c))


def raw_path(c: Column) -> Column:
    """Path of a URL (or of a bare path), still percent-encoded."""
    p = F.regexp_replace(_no_breaks(c), _SCHEME_HOST, "")
    p = F.regexp_replace(p, r"[?#].*$", "")
    return F.regexp_replace(p, ";[^/]*$", "")


def query_of(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(_no_breaks(c), r"#.*$", ""), r"\?(.*)$", 1)


def is_lang(seg: Column) -> Column:
    return F.lower(text(seg)).rlike(_LANG)


def all_segments(c: Column) -> Column:
    """Decoded, non-empty path segments, language prefix included."""
    return F.filter(F.split(percent_decode(raw_path(clean_url(c))), "/"), lambda s: s != "")


def drop_lang(segs: Column) -> Column:
    return F.when(is_lang(F.try_element_at(segs, F.lit(1))), F.slice(segs, 2, F.size(segs))).otherwise(segs)


def key_from(host_c: Column, segs: Column, low: Column) -> Column:
    """Stable page key from a normalised host and the segments without language prefix."""
    last = F.coalesce(F.try_element_at(low, F.lit(-1)), F.lit(""))
    kind = F.regexp_extract(last, K.KEY_ID_PATTERN, 1)
    number = F.regexp_extract(last, K.KEY_ID_PATTERN, 2)
    second = F.coalesce(F.try_element_at(low, F.lit(2)), F.lit(""))
    by_category = F.try_element_at(low, F.lit(1)).isin("categories", "category") & second.rlike(r"^\p{Nd}+$")
    return (F.when(kind != "", F.concat(host_c, F.lit("/#"), kind, number))
            .when(by_category, F.concat(host_c, F.lit("/#cat"), second))
            .otherwise(F.lower(F.regexp_replace(
                F.concat(host_c, F.lit("/"), F.array_join(segs, "/")), "/+$", ""))))


def url_parts(c: Column) -> Column:
    """Struct ``host, has_lang, segs, low, url_key`` of one URL.

    One expression in which every step is bound once: a filter that the optimizer pushes below it copies the
    parsing once, not once per use of every intermediate column.
    """
    first = F.struct(host(clean_url(c)).alias("host"), all_segments(c).alias("all"))
    second = let(first, lambda b: F.struct(
        b["host"].alias("host"),
        F.coalesce(is_lang(F.try_element_at(b["all"], F.lit(1))), F.lit(False)).alias("has_lang"),
        drop_lang(b["all"]).alias("segs")))
    return let(second, lambda p: let(F.transform(p["segs"], F.lower), lambda low: F.struct(
        p["host"].alias("host"), p["has_lang"].alias("has_lang"), p["segs"].alias("segs"), low.alias("low"),
        F.when(text(c) == "", F.lit("")).otherwise(key_from(p["host"], p["segs"], low)).alias("url_key"))))


PARTS = ("host", "has_lang", "segs", "low", "url_key")


def url_key(c: Column) -> Column:
    """The page key alone."""
    return url_parts(c)["url_key"]


def add_url_parts(df: DataFrame, url_col: str, prefix: str = "") -> DataFrame:
    """Add ``host, has_lang, segs, low, url_key`` (with a prefix) for one URL column."""
    df = df.withColumn("_parts", url_parts(F.col(url_col)))
    return df.withColumns({prefix + n: F.col("_parts")[n] for n in PARTS}).drop("_parts")


def same_page_key(c: Column) -> Column:
    """Host and lower-case segments without the id rules: tells a real move from a cosmetic one."""
    return F.concat(host(clean_url(c)), F.lit("/"), F.lower(F.array_join(let(all_segments(c), drop_lang), "/")))


def is_id_segment(seg: Column) -> Column:
    low = F.lower(text(seg))
    return low.rlike("|".join((K.PRODUCT_ID_PATTERN, K.CATEGORY_ID_PATTERN, K.INFO_ID_PATTERN,
                               K.BRAND_ID_PATTERN, K.ARTICLE_ID_PATTERN, r"^\p{Nd}+$")))


def slug_from(segs: Column) -> Column:
    last = F.coalesce(F.try_element_at(segs, F.lit(-1)), F.lit(""))
    return F.when(is_id_segment(last) & (F.size(segs) >= 2), F.try_element_at(segs, F.lit(-2))).otherwise(last)


def path_only(c: Column) -> Column:
    p = percent_decode(raw_path(c))
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def match_path(c: Column) -> Column:
    """Path used to match rows of a phase: decoded, lower-case, without trailing slash."""
    u = percent_decode(c)
    p = F.when(u.startswith("http"), raw_path(u)).otherwise(u)
    return F.lower(F.regexp_replace(p, "/+$", ""))


def is_tag_url(c: Column) -> Column:
    word = "^(?:(?:" + "|".join(K.TAG_STEMS) + ")[-_].*|" + "|".join(K.TAG_WORDS) + ")$"
    return let(percent_decode(F.lower(text(c))), lambda low: (
        F.exists(F.split(raw_path(low), "/"), lambda s: s.rlike(word))
        | query_of(low).rlike("|".join(K.TAG_QUERY_KEYS))))


def is_product_subpage_from(low: Column) -> Column:
    return ((F.size(low) >= 3) & F.coalesce(F.try_element_at(low, F.lit(1)).isin(*K.PRODUCT_ROOTS), F.lit(False))
            & F.coalesce(F.try_element_at(low, F.lit(-1)).isin(*K.PRODUCT_SUBPAGES), F.lit(False)))


def is_product_subpage(c: Column) -> Column:
    return let(F.transform(let(all_segments(c), drop_lang), F.lower), is_product_subpage_from)


def crawl_reject_reason(c: Column, site_host: Column, platform: Column | None = None) -> Column:
    """Why a link is not followed ('' = it is).  Platform-only rules need ``platform``."""
    low_path = percent_decode(F.lower(raw_path(c)))
    scheme = F.lower(F.regexp_extract(text(c), "^([A-Za-z][A-Za-z0-9+.\\-]*):", 1))
    out = (F.when(~scheme.isin("http", "https"), "scheme")
           .when(host(c) != site_host, "other_host")
           .when(is_tag_url(c), "tag")
           .otherwise(let(low_path, _path_reject)))
    out = (F.when(out != "", out)
           .when(is_product_subpage(c), "product_subpage"))
    if platform is not None:
        path = percent_decode(raw_path(c))
        low = F.filter(F.split(F.lower(path), "/"), lambda s: s != "")
        junk = (F.lower(path).rlike(r"\.(?:" + "|".join(K.SHOPIFY_JUNK_EXTENSIONS) + ")$")
                | path.rlike(r"[& \"<]")
                | ((F.size(low) >= 4) & (F.try_element_at(low, F.lit(1)) == "collections")
                   & (F.try_element_at(low, F.lit(3)) == "products")))
        out = out.when((platform == "shopify") & F.coalesce(junk, F.lit(False)), "platform_rule")
    return out.otherwise("")


def _path_reject(p: Column) -> Column:
    segs = F.split(F.regexp_replace(p, "^/+|/+$", ""), "/")
    return (F.when(p.rlike(r"\.(?:" + "|".join(K.BLOCKED_EXTENSIONS) + ")$"), "extension")
            .when(F.arrays_overlap(segs, literal_array(K.EXCLUDED_SEGMENTS)), "excluded_segment")
            .when(p.rlike("/cdn-cgi/|/email-protection"), "cdn_or_email").otherwise(""))


def decisive_from(low: Column) -> Column:
    """Page type that the URL alone proves, or ''."""
    first = F.coalesce(F.try_element_at(low, F.lit(1)), F.lit(""))
    second = F.coalesce(F.try_element_at(low, F.lit(2)), F.lit(""))
    last = F.coalesce(F.try_element_at(low, F.lit(-1)), F.lit(""))
    n = F.size(low)
    # blog path parts after the first one, the last left out unless it is the second
    middle = F.slice(low, 2, F.greatest(n - 2, F.lit(1)))
    blog_list = F.arrays_overlap(middle, literal_array(("tag", "tags", "category", "categories", "author")))
    return (F.when(last.rlike(K.PRODUCT_ID_PATTERN), "product")
            .when(last.rlike(K.BRAND_ID_PATTERN) | last.rlike(K.CATEGORY_ID_PATTERN), "category")
            .when(last.rlike(K.INFO_ID_PATTERN), "info")
            .when(last.rlike(K.ARTICLE_ID_PATTERN) & (n >= 2), "blog")
            .when(first.isin(*K.BLOG_SEGMENTS) & (n >= 2) & ~second.isin(
                "tag", "tags", "category", "categories", "author") & ~F.coalesce(blog_list, F.lit(False)), "blog")
            .when(first.isin(*K.PRODUCT_ROOTS) & (n >= 2), "product")
            .when(first.isin("categories", "category", "collections") & (n >= 2), "category")
            .when((first == "pages") & (n >= 2), "info")
            .otherwise(""))


def listing_kind_from(low: Column) -> Column:
    first = F.coalesce(F.try_element_at(low, F.lit(1)), F.lit(""))
    last = F.coalesce(F.try_element_at(low, F.lit(-1)), F.lit(""))
    brand_id = last.rlike(K.BRAND_ID_PATTERN)
    return (F.when(F.size(low) == 0, "listing")
            .when(brand_id | (first.isin(*K.BRAND_ROOTS) & (F.size(low) >= 2)), "brand")
            .when(first.isin(*K.BRAND_ROOTS) | F.array_join(low, "/").isin(*K.CATALOG_ROOTS), "listing")
            .otherwise("category"))


def resolve_href(base: Column, href: Column) -> Column:
    """Resolve a link against its page: absolute, scheme-relative, root-relative, query or relative."""
    def joined(root: Column, page: Column, h: Column) -> Column:
        folder = F.regexp_replace(F.regexp_replace(page, _SCHEME_HOST, ""), "[^/]*$", "")
        return F.concat(root, F.when(folder == "", "/").otherwise(folder), F.regexp_replace(h, r"^(?:\./)+", ""))

    def known(b: Column, h: Column) -> Column:
        root = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
        page = F.regexp_replace(b, r"(?s)[?#].*$", "")
        return (F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
                .when(h.startswith("//"), F.concat(F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1), h))
                .when(h.startswith("/"), F.concat(root, h))
                .when(h.startswith("?"), F.concat(page, h))
                .when(h == "", b)
                .otherwise(let(joined(root, page, h), _fold_dots)))

    return let(F.struct(text(base).alias("base"), F.trim(text(href)).alias("href")), lambda x: known(x["base"], x["href"]))


def _fold_dots(c: Column) -> Column:
    """Take ``.`` and ``..`` segments out of a URL's path, however many there are; the root has no parent."""
    parts = F.struct(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)(?s:(.*))$", 1).alias("root"),
                     F.split(F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1), "/").alias("segs"),
                     F.regexp_extract(c, r"(?s)^[^?#]*(.*)$", 1).alias("rest"))

    def step(done: Column, seg: Column) -> Column:
        return (F.when(seg == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(seg == ".", done)
                .otherwise(F.array_append(done, seg)))

    def whole(p: Column) -> Column:
        kept = F.aggregate(p["segs"], F.array().cast("array<string>"), step)
        end = F.when(F.element_at(p["segs"], -1).isin(".", ".."), "/").otherwise("")
        return F.concat(p["root"], F.array_join(kept, "/"), end, p["rest"])

    return F.when(c.rlike(r"^[^?#]*/\.\.?(?:[/?#]|$)"), let(parts, whole)).otherwise(c)


def image_format(c: Column) -> Column:
    path = F.lower(raw_path(c))
    ext = F.regexp_extract(path, K.IMAGE_FORMAT_PATTERN, 1)
    fmt = F.regexp_extract(F.lower(text(c)), K.IMAGE_FORMAT_QUERY_PATTERN, 1)
    return (F.when(ext.isin("jpg", "jpeg"), "jpg").when(ext != "", ext)
            .when(fmt != "", fmt).otherwise("—"))


def clean_image_url(c: Column) -> Column:
    """Unwrap resizer URLs and drop the fragment."""
    u = F.trim(text(c))
    inner = F.regexp_extract(u, r"(?i)/cdn-cgi/image/[^/]+/(https?://.+)$", 1)
    u = F.when(inner != "", inner).otherwise(F.regexp_replace(u, r"(?i)/cdn-cgi/image/[^/]+/", "/"))
    return F.regexp_replace(u, "(?s)#.*$", "")


def image_stem(c: Column, platform: Column | None = None) -> Column:
    """File name without extension and size suffix: the same picture in every size."""
    base = F.regexp_extract(F.lower(raw_path(clean_image_url(c))), "([^/]*)$", 1)
    base = F.regexp_replace(base, r"\.(jpe?g|png|webp|avif|gif|bmp)$", "")
    base = F.regexp_replace(base, K.IMAGE_SIZE_PATTERN, "")
    if platform is None:
        return base
    return F.when(platform == "shopify", F.regexp_replace(base, K.SHOPIFY_SIZE_PATTERN, "")).otherwise(base)


def clone_pattern() -> str:
    return any_pattern(K.CLONE_PATTERNS)
