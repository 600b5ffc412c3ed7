"""Length, alt and text grades, quality codes and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlwright import constants as K
from crawlwright.functions.text import (ARABIC, NO_LETTERS, any_pattern, edges, fold, folded_set, has_letters_or_digits, has_tokens,
                                        let, lookup, script_of, squeeze, strip, text, text_length, tokens, western_digits,
                                        word_tokens)
from crawlwright.functions.urls import (clone_pattern, is_product_subpage, is_tag_url, slug_from, url_key, url_parts)
from crawlwright.session import stash

GENERIC_ALT = folded_set(K.GENERIC_ALT_WORDS)


# --- lengths -------------------------------------------------------------------------------------
def grade_length(n: Column, bounds: tuple[int, int, int]) -> Column:
    low, best, high = bounds
    return (F.when(n == 0, "missing").when(n < low, "very_short").when(n < best, "acceptable")
            .when(n <= high, "optimal").otherwise("long"))


def grade_lengths(audit: DataFrame) -> DataFrame:
    """Length and status of title and description; unreachable pages get 'failed'."""
    up = F.col("available")
    df = audit.withColumns({
        "title_len": F.when(up, text_length(F.col("title"))).otherwise(0).cast("bigint"),
        "desc_len": F.when(up, text_length(F.col("meta_desc"))).otherwise(0).cast("bigint")})
    return df.withColumns({
        "title_status": F.when(up, grade_length(F.col("title_len"), K.TITLE_BOUNDS)).otherwise("failed"),
        "desc_status": F.when(up, grade_length(F.col("desc_len"), K.DESC_BOUNDS)).otherwise("failed")})


def regrade_lengths(audit: DataFrame) -> DataFrame:
    """Stored lengths are judged by today's bounds; a stored 'missing' stays."""
    def again(status: str, n: str, bounds) -> Column:
        return F.when(F.col("available") & (F.col(status) != "missing"),
                      grade_length(F.coalesce(F.col(n), F.lit(0)), bounds)).otherwise(F.col(status))
    return audit.withColumns({"title_status": again("title_status", "title_len", K.TITLE_BOUNDS),
                              "desc_status": again("desc_status", "desc_len", K.DESC_BOUNDS)})


# --- alt texts -----------------------------------------------------------------------------------
def alt_status(alt: Column) -> Column:
    """E2.  Cheap tests first; words are cut only for texts that reach them, folded only where Arabic occurs."""
    def judge(txt: Column) -> Column:
        return (F.when(txt == "", "alt_missing")
                .when(F.lower(txt).rlike(r"\.(jpg|jpeg|png|webp|gif|svg)$") | txt.rlike(NO_LETTERS), "alt_generic")
                .otherwise(let(words_of(txt), lambda ws: by_words(txt, ws))))

    def words_of(txt: Column) -> Column:
        # the text is squeezed: blanks alone part its words, whose edges are cleared in one pass
        bare = F.regexp_replace(F.lower(txt), r"(?<![^ ])[.,،؛:!?|\-()\[\]]+|[.,،؛:!?|\-()\[\]]++(?![^ ])", "")
        words = F.filter(F.split(bare, " "), lambda w: w != "")
        return F.when(txt.rlike(ARABIC), F.transform(words, fold)).otherwise(words)

    def by_words(txt: Column, words: Column) -> Column:
        n, commas = F.size(words), F.length(F.regexp_replace(txt, "[^,،]", ""))
        return (F.when(F.forall(words, lambda w: w.isin(*GENERIC_ALT)), "alt_generic")
                .when(F.length(txt) > K.ALT_MAX, "alt_long")
                .when((commas >= 4) & (n < 3 * commas), "alt_stuffed")
                .when((n >= 6) & (F.size(F.array_distinct(words)) * 2 < n), "alt_stuffed")
                .otherwise("alt_ok"))
    return let(squeeze(alt), judge)


def grade_alt(images: DataFrame) -> DataFrame:
    return images.withColumns({"alt_status": alt_status(F.col("alt")),
                               "alt_len": text_length(F.col("alt")).cast("bigint")})


def grade_repeated_alts(images: DataFrame) -> DataFrame:
    """``grade_alt`` for alts that repeat over many slots: each is graded once and meets its slots again.  ``images`` is read twice."""
    said = images.select("alt").where("alt <> ''").distinct()
    graded = stash(grade_alt(said), "alts")
    return (images.join(graded, "alt", "left").withColumns({"alt_status": F.coalesce("alt_status", F.lit("alt_missing")),
                                                            "alt_len": F.coalesce("alt_len", F.lit(0).cast("bigint"))})
            .select(*images.columns, "alt_status", "alt_len"))


# --- title against heading ------------------------------------------------------------------------
def title_h1_match(title: Column, h1: Column) -> Column:
    """Share of heading tokens that the title repeats."""
    both = F.struct(F.array_distinct(tokens(title)).alias("t"), F.array_distinct(tokens(h1)).alias("h"))
    return let(both, lambda b: F.when((text(title) == "") | (text(h1) == "") | (F.size(b["h"]) == 0), "match_na")
               .when(F.size(F.array_intersect(b["t"], b["h"])) * 2 >= F.size(b["h"]), "match_ok")
               .otherwise("match_diff"))


# --- text flags ----------------------------------------------------------------------------------
def is_placeholder(c: Column) -> Column:
    """The patterns are tried only on texts that begin like a match or hold a mark or a whole word that it must have."""
    def judge(low: Column) -> Column:
        maybe = low.rlike(K.PLACEHOLDER_STARTS)
        for mark in K.PLACEHOLDER_MARKS:
            maybe = maybe | F.contains(low, F.lit(mark))
        for word in K.PLACEHOLDER_WORDS:
            maybe = maybe | (F.contains(low, F.lit(word)) & low.rlike(rf"{word}(?<![\p{{L}}\p{{N}}_]{word})(?![\p{{L}}\p{{N}}_])"))
        return maybe & low.rlike(any_pattern(K.PLACEHOLDER_PATTERNS))
    return let(F.lower(strip(c)), judge)


def is_symbols(c: Column) -> Column:
    return (strip(c) != "") & ~has_letters_or_digits(c)


def is_promotional(c: Column) -> Column:
    t = F.regexp_replace(F.lower(western_digits(c)), K.WIDTH_NOT_OFFER_PATTERN, " ")
    return t.rlike(any_pattern(K.PROMO_PATTERNS))


def promo_phrase(title: Column) -> Column:
    """The promotional wording of a title as it is written there, with a neighbour that belongs to it ('coupon discount'),
    or ''.  Patterns are tried in order; each is one regular expression with optional words at both sides."""
    raw, low = text(title), F.lower(western_digits(title))
    offers = F.regexp_replace(low, K.WIDTH_NOT_OFFER_PATTERN, " ")
    found = [F.regexp_extract(offers, f"(?:(?:{'|'.join(K.PROMO_LEFT_WORDS)})\\s*)?(?:{p})(?:\\s*و?\\s*(?:{K.PROMO_RIGHT_PATTERN})\\S*)?", 0)
             for p in K.PROMO_PATTERNS]
    first = F.coalesce(*[F.when(f != "", F.trim(f)) for f in found], F.lit(""))
    cut = let(first, lambda f: F.when(f != "", F.substring(raw, F.greatest(F.instr(low, f), F.lit(1)), F.length(f))).otherwise(""))
    return F.regexp_replace(cut, "^[ |،,-]+|[ |،,-]+$", "")


def few_letters(c: Column) -> Column:
    return ~text(c).rlike(r"(?:[\p{L}\p{Nl}\p{No}][^\p{L}\p{Nl}\p{No}]*+){3}")


def text_flags(audit: DataFrame) -> DataFrame:
    """Placeholder, symbols, meaningless and (opt-in) promotional flags of the title."""
    t = F.col("title")
    return audit.withColumns({"is_placeholder": is_placeholder(t), "is_symbols": is_symbols(t),
                              "is_meaningless": few_letters(t) | is_placeholder(t) | is_symbols(t),
                              "is_promo": is_promotional(t)})


# --- filters -------------------------------------------------------------------------------------
def has_issue() -> Column:
    return ((F.col("title_status") != "optimal") | (F.col("desc_status") != "optimal")
            | ~F.col("title_quality").isin("q_ok", "q_na") | ~F.col("desc_quality").isin("q_ok", "q_na")
            | ~F.col("url_quality").isin("u_ok", "u_na") | (F.col("images_missing_alt") > 0) | ~F.col("available"))


def filter_pages(audit: DataFrame, page_type: str | None = None, only_issues: bool = False) -> DataFrame:
    """E5."""
    if page_type:
        audit = audit.where(F.col("page_type") == page_type)
    return audit.where(has_issue()) if only_issues else audit


def filter_images(images: DataFrame, state: str | None = None, image_format: str | None = None) -> DataFrame:
    """E5: state is 'missing', 'weak', 'ok' or None."""
    if state:
        wanted = {"missing": ("alt_missing",), "weak": K.ALT_WEAK, "ok": ("alt_ok",)}[state]
        images = images.where(F.col("alt_status").isin(*wanted))
    return images.where(F.col("image_format") == image_format) if image_format else images


def drop_subpages_and_tags(pages: DataFrame, url_col: str = "url", req_col: str | None = None) -> DataFrame:
    """E6."""
    out = pages.where(~is_tag_url(F.col(url_col)) & ~is_product_subpage(F.col(url_col)))
    return out.where(~is_product_subpage(F.col(req_col))) if req_col else out


# --- brand and text quality -------------------------------------------------------------------------
def brand_tail(title: Column) -> Column:
    out = None
    for sep in K.BRAND_SEPARATORS:
        cond, val = F.contains(title, F.lit(sep)), strip(F.substring_index(title, sep, -1))
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return F.when(F.length(out).between(2, 40), out)


def detect_brand(audit: DataFrame) -> DataFrame:
    """``(site, brand)`` from the ends of the titles of reachable pages; '' when none is common enough."""
    t = audit.where(F.col("available") & (strip(F.col("title")) != ""))
    tails = t.groupBy("site", brand_tail(F.col("title")).alias("tail")).agg(
        F.count("*").alias("n"), F.min("seq").alias("first"))
    best = tails.groupBy("site").agg(
        F.sum("n").alias("valid"),
        F.min(F.when(F.col("tail").isNotNull(), F.struct(-F.col("n"), F.col("first"), F.col("tail")))).alias("b"))
    n = -F.col("b.col1")
    return best.select("site", F.coalesce(F.when((n >= 3) & (n >= 0.25 * F.col("valid")), F.col("b.tail")),
                                          F.lit("")).alias("brand"))


def without_brand(title: Column, brand: Column) -> Column:
    v = text(title)
    for sep in K.BRAND_SEPARATORS:
        v = F.replace(v, F.concat(F.lit(sep + " "), brand), F.lit(""))
        v = F.replace(v, F.concat(F.lit(sep), brand), F.lit(""))
    v = F.replace(v, brand, F.lit(""))
    return F.regexp_replace(v, r"^[ |\-–—•·]+|[ |\-–—•·]+$", "")


def _stripped_texts(df: DataFrame) -> DataFrame:
    up = F.col("available")
    return df.withColumns({"_t": F.when(up, strip(F.col("title"))).otherwise(""),
                           "_d": F.when(up, strip(F.col("meta_desc"))).otherwise("")})


def page_flags(base: DataFrame) -> DataFrame:
    """``(site, seq, title_shared, desc_shared, dup_pages, has_parent)`` for the rows that have any.

    Title, description, the pair of both and the parent key of a numbered slug are looked up in one narrow pass:
    every row offers the keys it has, counts are pre-aggregated per key, and only keys that repeat come back.  The
    wide table then meets all flags in a single join on (site, seq).
    """
    t = _stripped_texts(base.select("site", "seq", "available", "title", "meta_desc", "url"))
    both = F.col("available") & (strip(F.col("title")) != "") & (strip(F.col("meta_desc")) != "")
    keys = F.array_compact(F.array(
        F.when(F.col("_t") != "", F.struct(F.lit("t").alias("kind"), F.col("_t").alias("key"))),
        F.when(F.col("_d") != "", F.struct(F.lit("d").alias("kind"), F.col("_d").alias("key"))),
        F.when(both, F.struct(F.lit("c").alias("kind"),
                              F.to_json(F.struct("title", "meta_desc")).alias("key")))))
    offers = t.select("site", "seq", F.explode(keys).alias("k")).select("site", "seq", "k.kind", "k.key")
    counts = offers.groupBy("site", "kind", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = offers.join(counts, ["site", "kind", "key"]).select("site", "seq", "kind", "n")

    urls = base.select("site", url_key(F.col("url")).alias("key"))
    # most URLs show at a glance that no part of their path ends in a number: only the others are parsed, whatever filter Spark puts first
    maybe = text(F.col("url")).rlike(r"-[0-9]{1,2}(?:[/?#;]|$)|[%\t\r\n]")
    numbered = base.select("site", "seq", "url", F.when(maybe, url_parts(F.col("url"))).alias("p")).select(
        "site", "seq", "url", F.col("p.url_key").alias("own"), F.when(maybe, let(F.col("p.segs"), slug_from)).alias("slug"))
    stem = F.regexp_extract("slug", r"(?s)^(.*)-[0-9]{1,2}$", 1)
    numbered = numbered.where(maybe & F.col("slug").rlike(r"(?s)^.*-[0-9]{1,2}$")).select(
        "site", "seq", "own", F.when(maybe, url_key(F.replace(F.col("url"), F.col("slug"), stem))).alias("key")).where("key <> own")
    parents = numbered.join(urls.distinct(), ["site", "key"], "left_semi")
    rows = shared.unionByName(parents.select("site", "seq", F.lit("p").alias("kind"), F.lit(1).cast("bigint").alias("n")))

    def pick(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("n")))
    return rows.groupBy("site", "seq").agg(
        pick("t").alias("_tn"), pick("d").alias("_dn"), pick("c").alias("_cn"), pick("p").isNotNull().alias("_has_parent"))


def site_words(base: DataFrame) -> DataFrame:
    """``(site, brand, vocab)``: what the text and URL grades need to know about a site."""
    return detect_brand(base).join(name_vocabulary(base), "site", "full_outer")


def with_lookups(audit: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Join the site words and the page flags; a table that already has them stays as it is.

    ``base`` is the ungraded table that ``audit`` comes from, so every lookup is a column-pruned scan of its own.
    """
    if "_has_parent" in audit.columns:
        return audit
    base = audit if base is None else base
    return (audit.join(page_flags(base), ["site", "seq"], "left").join(site_words(base), "site", "left")
            .withColumns({"brand": F.coalesce("brand", F.lit("")), "vocab": F.coalesce("vocab", F.array().cast("array<string>")),
                          "_has_parent": F.coalesce("_has_parent", F.lit(False))}))


LOOKUPS = ("_tn", "_dn", "_cn", "_has_parent", "vocab")


def text_quality(audit: DataFrame, base: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """Quality codes of title and description; fatal codes force status 'missing' and length 0."""
    df = _stripped_texts(with_lookups(audit, base)).withColumns({
        "title_shared": F.coalesce("_tn", F.lit(1)), "_desc_shared": F.coalesce("_dn", F.lit(1))})
    up = F.col("available")
    t, d, brand = F.col("_t"), F.col("_d"), F.col("brand")
    tq = (F.when(~up | (t == ""), "q_na").when(is_placeholder(t), "q_placeholder")
          .when(~has_letters_or_digits(t), "q_symbols")
          .when((brand != "") & ~has_letters_or_digits(without_brand(t, brand)), "q_brand_only")
          .when(F.col("title_shared") >= 2, "q_duplicate").otherwise("q_ok"))
    dq = (F.when(~up | (d == ""), "q_na").when(is_placeholder(d), "q_placeholder")
          .when(~has_letters_or_digits(d), "q_symbols").when(d == t, "q_same_as_title")
          .when(F.col("_desc_shared") >= 2, "q_duplicate").otherwise("q_ok"))
    df = df.withColumns({"title_quality": tq, "desc_quality": dq,
                         "title_shared": F.when(t == "", 0).otherwise(F.col("title_shared")).cast("bigint"),
                         "desc_shared": F.when(d == "", 0).otherwise(F.col("_desc_shared")).cast("bigint")})
    fix = {}
    for kind in ("title", "desc"):
        fatal = F.col(f"{kind}_quality").isin(*K.QUALITY_FATAL)
        fix[f"{kind}_status"] = F.when(fatal, "missing").otherwise(F.col(f"{kind}_status"))
        fix[f"{kind}_len"] = F.when(fatal, F.lit(0)).otherwise(F.col(f"{kind}_len")).cast("bigint")
    return df.withColumns(fix).drop("_t", "_d", "_desc_shared", *(() if keep else LOOKUPS))


# --- URL quality -----------------------------------------------------------------------------------
def name_vocabulary(audit: DataFrame, name_col: str = "display_name", pages: str | None = None) -> DataFrame:
    """``(site, vocab)``: tokens in at least 22 % of five or more product names.  ``pages``: a column that says how many products a
    row stands for.

    The shares of all tokens add up to the mean number of tokens per name, so the array holds at most
    that number / 0.22 entries whatever the size of the site.
    """
    n = F.lit(1) if pages is None else F.col(pages)
    products = audit.where(F.col("page_type") == "product").select("site", F.col(name_col).alias("name"), n.cast("bigint").alias("n"))
    totals = (products.where(has_tokens(F.col("name"))).groupBy("site").agg(F.sum("n").alias("n_names"))
              .where(F.col("n_names") >= K.VOCAB_MIN_NAMES))
    counts = products.select("site", "n", F.explode(F.array_distinct(tokens(F.col("name")))).alias("token")).groupBy("site", "token").agg(
        F.sum("n").alias("k"))
    return (counts.join(totals, "site").where(F.col("k") >= K.VOCAB_SHARE * F.col("n_names"))
            .groupBy("site").agg(F.collect_list("token").alias("vocab")))


def url_quality(audit: DataFrame, declared_col: str | None = None, base: DataFrame | None = None, keep: bool = False
                ) -> DataFrame:
    """G4 with F4: adds ``slug`` and ``url_quality``."""
    had = [c for c in audit.columns if c not in ("slug", "url_quality", *(() if keep else LOOKUPS))]
    df = with_lookups(audit, base).withColumn("slug", let(url_parts(F.col("url"))["segs"], slug_from))
    slug, low = F.col("slug"), F.lower(F.col("slug"))
    declared = F.lit("") if declared_col is None else strip(F.col(declared_col))
    df = df.withColumns({
        "_words": F.transform(F.filter(F.split(slug, "[-_]+"), lambda w: w != ""), lambda w: fold(F.lower(w))),
        "_declared": declared, "_shown": strip(F.col("display_name")), "_meta": strip(F.col("title")),
        "_brand": tokens(F.col("brand")), "_stok": word_tokens(slug)})
    df = df.withColumn("_name", F.when(F.col("_declared") != "", F.col("_declared")).otherwise(F.col("_shown")))
    df = df.withColumns({
        "_ref": F.when(F.col("_name") != "", F.col("_name")).otherwise(F.col("_meta")),
        "_own": F.array_except(F.array_except("_stok", "vocab"), F.col("_brand"))})
    # titles may be long: they are cut into words only where the slug of a product has a word of its own that its name lacks
    named = tokens(F.col("_name"))
    asks = (F.col("page_type") == "product") & (F.size("_own") > 0) & ~F.arrays_overlap("_own", named)
    df = df.withColumn("_ntok", F.when(asks, F.array_except(F.array_union(named, tokens(F.col("_meta"))), F.col("_brand"))))
    wrong = ((F.col("page_type") == "product") & (F.col("_ref") != "") & (F.size("_stok") > 0) & (F.size("_ntok") > 0)
             & (F.size("_own") > 0) & ~F.arrays_overlap("_own", "_ntok")
             & (script_of(slug) == script_of(F.col("_ref"))))
    grade = (F.when(~F.col("available") | (slug == ""), "u_na")
             .when(low.rlike(clone_pattern()), "u_clone")
             .when(F.col("_has_parent"), "u_clone")
             .when(low.rlike(edges(K.MALFORMED_SLUG_PATTERN)), "u_malformed")
             .when(slug.rlike(NO_LETTERS) | low.rlike(K.GENERIC_SLUG_PATTERN), "u_generic")
             .when(F.contains(slug, F.lit("_")), "u_underscore")
             .when(slug.rlike("[A-Z]"), "u_uppercase")
             .when((F.size("_words") > 2) & (F.size(F.array_distinct("_words")) < F.size("_words")), "u_repeat")
             .when(wrong, "u_wrongname").otherwise("u_ok"))
    return df.withColumn("url_quality", grade).select(*had, "slug", "url_quality")


# --- duplicate content -------------------------------------------------------------------------------
def duplicate_content(audit: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Flag reachable pages that share title and description; ``dup_pages`` is the size of the group."""
    had = [c for c in audit.columns if c not in LOOKUPS]
    if "_cn" in audit.columns:
        df = audit
    else:
        flags = page_flags(audit if base is None else base)
        df = audit.join(flags.select("site", "seq", "_cn"), ["site", "seq"], "left")
    both = F.col("available") & (strip(F.col("title")) != "") & (strip(F.col("meta_desc")) != "")
    n = F.when(both, F.coalesce("_cn", F.lit(1))).otherwise(0).cast("bigint")
    return df.withColumns({"dup_pages": n, "dup_content": n >= 2}).select(*had, "dup_pages", "dup_content")


# --- scores ------------------------------------------------------------------------------------------
def score_pages(audit: DataFrame, images: DataFrame | None) -> DataFrame:
    """0-100 per reachable page, null otherwise; also the missing / weak alt counts of the page.

    Alt credits are summed as tenths, so the result does not depend on the order of the rows.
    """
    had = [c for c in audit.columns if c not in ("seo_score", "images_missing_alt", "images_weak_alt")]
    if images is None:
        df = audit.withColumns({"_n": F.lit(None).cast("bigint"), "_credit": F.lit(0), "_miss": F.lit(0),
                                "_weak": F.lit(0)})
    else:
        tenths = lookup(F.col("alt_status"), [(k, int(round(v * 10))) for k, v in K.ALT_CREDIT], 0)
        per_page = images.groupBy("site", F.col("page_url").alias("url")).agg(
            F.count("*").alias("_n"), F.sum(tenths).alias("_credit"),
            F.count_if(F.col("alt_status") == "alt_missing").alias("_miss"),
            F.count_if(F.col("alt_status").isin(*K.ALT_WEAK)).alias("_weak"))
        df = audit.join(per_page, ["site", "url"], "left")
    lw = K.LENGTH_WEIGHT
    title = F.lit(25.0) * lookup(F.col("title_status"), lw, 0.0) * lookup(F.col("title_quality"), K.QUALITY_CREDIT, 1.0)
    desc = F.lit(25.0) * lookup(F.col("desc_status"), lw, 0.0) * lookup(F.col("desc_quality"), K.QUALITY_CREDIT, 1.0)
    alt = F.when(F.coalesce("_n", F.lit(0)) == 0, F.lit(25.0)).otherwise(
        F.lit(2.5) * F.col("_credit") / F.col("_n"))
    body = F.when(F.col("content_status") == "good", F.lit(25.0)).otherwise(F.lit(0.0))
    score = (title + desc + alt + body) * lookup(F.col("url_quality"), K.URL_CREDIT, 1.0)
    up = F.col("available")
    return df.withColumns({
        "seo_score": F.when(up, F.greatest(F.lit(0), F.least(F.lit(100), F.bround(score, 0).cast("bigint")))),
        "images_missing_alt": F.when(up, F.coalesce("_miss", F.lit(0))).otherwise(0).cast("bigint"),
        "images_weak_alt": F.when(up, F.coalesce("_weak", F.lit(0))).otherwise(0).cast("bigint"),
    }).select(*had, "seo_score", "images_missing_alt", "images_weak_alt")


def grade_audit(audit: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """The fixed order of the page grades: lengths, content, text quality, URL quality, duplicates, score."""
    df = grade_lengths(audit).withColumn(
        "content_status", F.when(~F.col("available"), "na").when(F.col("word_count") >= K.THIN_WORDS, "good")
        .otherwise("thin"))
    declared = "declared_name" if "declared_name" in audit.columns else None
    df = url_quality(text_quality(with_lookups(df, audit), keep=True), declared, keep=True)
    return score_pages(duplicate_content(df), images)


