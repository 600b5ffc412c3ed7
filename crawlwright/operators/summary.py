"""Counters, fix masks, trust checks and diagnosis per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlwright import constants as K
from crawlwright.functions.text import strip
from crawlwright.functions.urls import add_url_parts, listing_kind_from
from crawlwright.operators.classify import fixed_page_title
from crawlwright.operators.grading import few_letters
from crawlwright.operators.redirects import broken_action, is_broken

BAD_LENGTHS = ("missing", "very_short", "long")


def title_needs_fix() -> Column:
    """J2 on a graded audit with ``fixed_title`` and ``title_shared``: fixed pages only when the title says nothing."""
    issue = ((F.col("title_status") != "optimal") | ~F.coalesce("title_quality", F.lit("q_na")).isin("q_ok", "q_na")
             | (F.col("title_shared") >= 2))
    fixed = F.col("fixed_title") != ""
    empty = few_letters(F.col("title")) | F.col("title_quality").isin("q_symbols", "q_placeholder", "q_brand_only")
    return F.col("available") & ((issue & ~fixed) | (fixed & empty))


def desc_needs_fix() -> Column:
    return F.col("available") & ((F.col("desc_status") != "optimal")
                                 | ~F.coalesce("desc_quality", F.lit("q_na")).isin("q_ok", "q_na"))


def fix_masks(graded: DataFrame) -> DataFrame:
    """Adds ``fixed_title, title_fix, desc_fix``."""
    return fixed_page_title(graded).withColumns({"title_fix": title_needs_fix(), "desc_fix": desc_needs_fix()})


def _n(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def page_counters(masked: DataFrame, platforms: DataFrame | None = None) -> DataFrame:
    """J1, page part: one conditional aggregation over the graded, masked audit."""
    df = add_url_parts(masked, "url", "k_").withColumn("_kind", listing_kind_from(F.col("k_low")))
    if platforms is None:
        df = df.withColumn("_can", F.lit(False))
    else:
        df = df.join(platforms.select("site", F.col("platform").isin(*K.REDIRECT_PLATFORMS).alias("_can")), "site", "left")
    up, t, code = F.col("available"), F.col("page_type"), F.col("fetch_code")
    gone, deleted = code.isin(*K.GONE_CODES), code == K.FETCH_DELETED_HOME
    cat, tq, dq, uq = t == "category", F.col("title_quality"), F.col("desc_quality"), F.col("url_quality")
    act = F.when(is_broken(), broken_action(F.coalesce("_can", F.lit(False))))
    aggs = {
        "total_pages": F.count("*"), "live_pages": _n(up),
        "score": F.coalesce(F.round(F.avg(F.when(up, F.col("seo_score"))), 1), F.lit(0.0)),
        "products": _n(up & (t == "product")), "categories": _n(up & cat & (F.col("_kind") == "category")),
        "brand_pages": _n(up & cat & (F.col("_kind") == "brand")),
        "listing_pages": _n(up & cat & (F.col("_kind") == "listing")),
        "info_pages": _n(up & (t == "info")), "blog_pages": _n(up & (t == "blog")),
        "archive_pages": _n(up & (t == "archive")), "unclassified": _n(up & (t == "unknown")),
        "broken_pages": _n(~up & gone), "broken_no_redirect": _n(is_broken()),
        "unreachable_pages": _n(~up & ~gone & ~deleted), "deleted_pages": _n(deleted),
        "bad_titles": _n(up & (F.col("title_status") != "optimal")), "fix_titles_urls": _n(F.col("title_fix")),
        "fix_descs": _n(F.col("desc_fix")), "critical_titles": _n(up & F.col("title_status").isin(*BAD_LENGTHS)),
        "bad_descs": _n(up & (F.col("desc_status") != "optimal")),
        "critical_descs": _n(up & F.col("desc_status").isin(*BAD_LENGTHS)),
        "title_symbols": _n(up & tq.isin(*K.QUALITY_FATAL)), "title_brand_only": _n(up & (tq == "q_brand_only")),
        "title_promo": _n(up & (tq == "q_promo")), "title_dup": _n(up & (F.col("title_shared") >= 2)),
        "desc_dup": _n(up & (dq == "q_duplicate")), "desc_same": _n(up & (dq == "q_same_as_title")),
        "url_clone": _n(up & (uq == "u_clone")), "url_wrongname": _n(up & (uq == "u_wrongname")),
        "url_style": _n(up & uq.isin("u_underscore", "u_uppercase", "u_repeat")),
        "url_underscore": _n(up & (uq == "u_underscore")), "url_uppercase": _n(up & (uq == "u_uppercase")),
        "url_repeat": _n(up & (uq == "u_repeat")), "url_malformed": _n(up & (uq == "u_malformed")),
        "url_generic": _n(up & (uq == "u_generic")), "url_bad": _n(up & ~uq.isin("u_ok", "u_na")),
        "dup_content": _n(up & F.col("dup_content")), "canon_missing": _n(up & (F.col("canonical_status") == "canon_missing")),
        "canon_diff": _n(up & (F.col("canonical_status") == "canon_diff")), "thin_pages": _n(up & (F.col("content_status") == "thin")),
        "noindex_pages": _n(up & ~F.coalesce("indexable", F.lit(True))),
        "redirect_qty": _n(act.isin("redirect", "redirect_fix")), "internal_fix_qty": _n(is_broken() & F.col("linked")),
        "broken_actionable": _n(act != "none"),
    }
    if "h1_match" in masked.columns:
        aggs["h1_mismatch"] = _n(up & (F.col("h1_match") == "match_diff"))
    if "total_images" in masked.columns:
        aggs["image_slots"] = F.sum(F.when(up, F.col("total_images")).otherwise(0)).cast("bigint")
    return df.groupBy("site").agg(*[c.alias(n) for n, c in aggs.items()])


def image_counters(unique: DataFrame) -> DataFrame:
    """J1, image part, over the unique images of a site."""
    s = F.col("alt_status")
    modern = F.count_if(F.col("image_format").isin(*K.MODERN_FORMATS))
    return unique.groupBy("site").agg(
        F.count("*").alias("total_images"), F.count_if(s == "alt_missing").alias("missing_alts"),
        F.count_if(s.isin(*K.ALT_WEAK)).alias("weak_alts"), F.count_if(s == "alt_ok").alias("good_alts"),
        F.count_if(s == "alt_duplicate").alias("dup_alts"), modern.alias("img_modern"),
        (F.count("*") - modern).alias("img_legacy"), F.round(modern / F.count("*") * 100, 1).alias("img_modern_pct"))


def format_counters(unique: DataFrame) -> DataFrame:
    """Unique images of a site by format; formats outside the known ones count as ``img_format_other``."""
    fmt = F.coalesce("image_format", F.lit(""))
    counts = {f"img_format_{f}": F.count_if(fmt == f) for f in K.IMAGE_FORMATS}
    counts["img_format_other"] = F.count_if(~fmt.isin(*K.IMAGE_FORMATS))
    return unique.groupBy("site").agg(*[c.alias(n) for n, c in counts.items()])


#: H3 counter -> its name in the summary
COVERAGE = (("products_live", "visible_products"), ("sitemap_total", "sitemap_products"), ("sitemap_live", "sitemap_live"),
            ("products_unlisted", "not_indexed_count"), ("sitemap_dead", "dead_count"), ("sitemap_unreachable", "sitemap_unreachable"),
            ("orphan_pages", "hidden_count"), ("scroll_only_products", "scroll_only_count"), ("unlisted_pages", "unlisted_count"),
            ("unlisted_suppressed", "unlisted_suppressed"), ("indexed_pct", "indexed_pct"))
ORPHAN_TYPES = tuple(t for t in K.PAGE_TYPES if t not in ("product", "broken"))


def coverage_counters(coverage: DataFrame, orphans: DataFrame | None = None) -> DataFrame:
    """J1, coverage part: the H3 report under its summary names, and the orphan rows by page type."""
    out = coverage.select("site", *[F.col(c).alias(n) for c, n in COVERAGE])
    if orphans is None:
        return out
    by_type = orphans.groupBy("site").agg(*[F.count_if(F.col("page_type") == t).alias(f"orphan_{t}") for t in ORPHAN_TYPES])
    return out.join(by_type, "site", "left")


def compute_summary(masked: DataFrame, unique_images: DataFrame | None = None, coverage: DataFrame | None = None,
                    redirects: DataFrame | None = None, platforms: DataFrame | None = None, orphans: DataFrame | None = None,
                    deduped: DataFrame | None = None, formats: bool = False) -> DataFrame:
    """One wide row per site.  Every part is one pass over its table; the joins see one row per site.

    ``coverage`` is the report of H3 and ``orphans`` its orphan rows, ``redirects`` the counters of I2, ``deduped`` the per-site
    report of G1, which tells the canonicals that are broken.
    """
    out = page_counters(masked, platforms)
    parts = [image_counters(unique_images) if unique_images is not None else None,
             format_counters(unique_images) if formats and unique_images is not None else None,
             coverage_counters(coverage, orphans) if coverage is not None else None, redirects,
             deduped.select("site", "canon_broken") if deduped is not None else None]
    for part in parts:
        if part is not None:
            out = out.join(part, "site", "left")
    if coverage is not None:
        out = out.na.fill(100.0, ["indexed_pct"])
    return out.na.fill(0)


def summary_long(summary: DataFrame) -> DataFrame:
    """The same counters as ``(site, metric, value)``."""
    names = [c for c, t in summary.dtypes if c != "site" and t in ("bigint", "int", "double")]
    wide = summary.select("site", *[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot("site", names, "metric", "value")


def distributions(graded: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Value counts of many columns in one pass: ``(site, field, value, n)``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))
                                for c in columns])).alias("p")
    return (graded.select("site", pairs).groupBy("site", F.col("p.field").alias("field"), F.col("p.value").alias("value"))
            .agg(F.count("*").alias("n")))


def template_reading_checks(audit: DataFrame, images: DataFrame) -> DataFrame:
    """``(site, check, n)`` for every sign that a template was misread."""
    live = audit.where(F.col("available"))
    prods = live.where("page_type = 'product'").select("site", "url").distinct()
    pages = live.groupBy("site").agg(F.count("*").alias("n_live"), F.count_if(F.col("page_type") == "product").alias("n_prod"))
    with_img = images.select("site", F.col("page_url").alias("url")).distinct()
    shown = prods.join(with_img, ["site", "url"], "left_semi").groupBy("site").agg(F.count("*").alias("with_images"))
    total = prods.groupBy("site").agg(F.count("*").alias("prod_urls"))
    uniq = images.select("site", "image_url").distinct().groupBy("site").agg(
        F.count("*").alias("n_images"), F.count_if(F.col("image_url").rlike(K.TRUNCATED_IMAGE_PATTERN)).alias("truncated"))

    def most_common(column: str, name: str) -> DataFrame:
        v = strip(F.col(column))
        return (live.where(v != "").groupBy("site", v.alias("v")).agg(F.count("*").alias("n"))
                .groupBy("site").agg(F.max("n").alias(name)))
    df = pages
    for part in (shown, total, uniq, most_common("title", "top_title"), most_common("meta_desc", "top_desc")):
        df = df.join(part, "site", "left")
    df = df.na.fill(0)
    no_img = F.col("prod_urls") - F.col("with_images")
    def sign(name: str, n: Column, hit: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), n.alias("n"), hit.alias("hit"))
    many, live_n = F.col("n_prod") >= 10, F.col("n_live")
    checks = F.array(
        sign("fewer_images_than_products", F.col("n_images"), many & (F.col("n_images") < F.col("n_prod"))),
        sign("products_without_images", no_img, many & (F.col("n_images") > 0) & (no_img > F.col("n_prod") * 0.3)),
        sign("truncated_image_urls", F.col("truncated"), F.col("truncated") > 0),
        sign("one_title_on_most_pages", F.col("top_title"), (live_n >= 20) & (F.col("top_title") > live_n * 0.5)),
        sign("one_description_on_most_pages", F.col("top_desc"), (live_n >= 20) & (F.col("top_desc") > live_n * 0.5)))
    return (df.select("site", F.explode(checks).alias("c")).where("c.hit")
            .select("site", F.col("c.check").alias("check"), F.col("c.n").cast("bigint").alias("n")))


def self_checks(facts: DataFrame, signs: DataFrame | None = None) -> DataFrame:
    """``(site, ord, check, level, value)`` from one wide fact row per site.

    Needs: platform, total_urls, partial, files_ok, live_pages, unreachable_pages, suspicious_home, home_suspicious,
    template_issues, store_total, products, unclassified, product_pages, products_with_images.  Where facts have them, these get rows
    of their own: retry_aborted (a warning, so it changes the verdict), auto_gentle, cache_hits, template_images; null counts as no.
    With ``signs`` (J3) every sign of a misread template is a warning of its own, all at the place of ``template``, and
    template_issues is not needed; sites without signs pass if any page was tried.
    """
    facts = facts if signs is None else facts.join(signs.select("site", F.lit(True).alias("_signs")).distinct(), "site", "left")
    n_ok = F.col("live_pages")
    tried = n_ok + F.col("unreachable_pages") + F.col("suspicious_home")
    pct = F.round(F.try_divide(n_ok, tried) * 100, 1)
    gap = F.col("store_total") - F.col("products")
    tolerance = F.greatest(F.lit(1), F.bround(F.col("store_total") * 0.01, 0))
    unk = F.try_divide(F.col("unclassified"), n_ok) * 100
    pics = F.try_divide(F.col("products_with_images"), F.col("product_pages")) * 100

    def row(name: str, shown: Column, level: Column, value: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), F.when(shown, level).alias("level"), value.cast("double").alias("value"))
    yes = F.lit(True)

    def told(name: str, column: str, level: str) -> list[Column]:
        if column not in facts.columns:
            return []
        n = F.coalesce(F.col(column).cast("bigint"), F.lit(0))
        return [row(name, n > 0, F.lit(level), n)]

    if signs is None:
        template = row("template", yes, F.when(F.col("template_issues") > 0, "warn").otherwise("pass"), F.col("template_issues"))
    else:
        template = row("template", F.col("_signs").isNull() & (tried > 0), F.lit("pass"), F.lit(0))
    rows = [
        row("platform", yes, F.when(F.col("platform").isin(*K.SUPPORTED_PLATFORMS), "pass").otherwise("warn"), F.lit(None)),
        row("sitemap", yes, F.when(F.col("total_urls") == 0, "warn").when(F.col("partial"), "warn")
            .when(F.col("files_ok") > 0, "pass").otherwise("warn"), F.col("total_urls")),
        row("crawl_size", yes, F.when(n_ok < 5, "fail").otherwise("pass"), n_ok),
        row("completeness", tried > 0, F.when(pct < 85, "fail").when(pct < 97, "warn").otherwise("pass"), pct),
        row("home_redirects", F.col("home_suspicious"), F.lit("fail"), F.col("suspicious_home")),
        *told("retry_stopped", "retry_aborted", "warn"),
        template,
        row("counts_match", yes, F.when((F.coalesce("store_total", F.lit(0)) > 0) & (F.abs(gap) > tolerance) & (gap > 0), "warn")
            .otherwise("pass"), gap),
        *told("gentle_mode", "auto_gentle", "pass"),
        *told("resumed", "cache_hits", "pass"),
        *told("template_images", "template_images", "pass"),
        row("products_found", (n_ok >= 2) | (F.col("products") > 0), F.when(F.col("products") == 0, "fail").otherwise("pass"),
            F.col("products")),
        row("classification", n_ok > 0, F.when(unk > 25, "fail").when(unk > 10, "warn").otherwise("pass"), F.round(unk, 1)),
        row("product_images", F.col("product_pages") >= 3, F.when(pics == 0, "fail").when(pics < 60, "warn").otherwise("pass"),
            F.round(pics, 1)),
    ]
    checks = (facts.select("site", F.posexplode(F.array(*rows)).alias("ord", "c")).where("c.level IS NOT NULL")
              .select("site", F.col("ord").cast("bigint").alias("ord"), F.col("c.check").alias("check"), F.col("c.level").alias("level"),
                      F.col("c.value").alias("value")))
    if signs is None:
        return checks
    place = 5 + len(told("", "retry_aborted", ""))
    warnings = signs.join(facts.select("site"), "site", "left_semi").select(
        "site", F.lit(place).cast("bigint").alias("ord"), "check", F.lit("warn").alias("level"), F.col("n").cast("double").alias("value"))
    return checks.unionByName(warnings)


def verdicts(checks: DataFrame) -> DataFrame:
    """Blocked, review or ready."""
    df = checks.groupBy("site").agg(F.count_if(F.col("level") == "fail").alias("fails"),
                                    F.count_if(F.col("level") == "warn").alias("warns"))
    return df.withColumn("verdict", F.when(F.col("fails") > 0, "blocked").when(F.col("warns") > 0, "review").otherwise("ready"))


DIAGNOSIS = ("missing_alts", "weak_alts", "title_symbols", "title_brand_only", "title_dup", "desc_same", "critical_titles",
             "improvable_titles", "critical_descs", "improvable_descs", "url_clone", "dup_content", "noindex_pages",
             "h1_mismatch", "canon_broken", "canon_missing", "hidden_count", "redirect_qty", "internal_fix_qty",
             "archive_pages", "thin_pages")


def diagnosis_points(summary: DataFrame) -> DataFrame:
    """Findings in report order ``(site, ord, code, n, share, closing)``; sites without any get one 'clean' row."""
    have = set(summary.columns)
    zero = F.lit(0).cast("bigint")
    value = {c: F.coalesce(F.col(c), zero) if c in have else zero for c in DIAGNOSIS}
    value["improvable_titles"] = F.greatest(F.col("bad_titles") - F.col("critical_titles"), zero)
    value["improvable_descs"] = F.greatest(F.col("bad_descs") - F.col("critical_descs"), zero)
    value["archive_pages"] = F.when(F.col("archive_pages") > 20, F.col("archive_pages")).otherwise(zero)
    images = F.coalesce(F.col("total_images"), zero) if "total_images" in have else zero
    value["missing_alts"] = F.when(images > 0, value["missing_alts"]).otherwise(zero)
    points = F.array(*[F.struct(F.lit(i + 1).cast("bigint").alias("ord"), F.lit(c).alias("code"), value[c].cast("bigint").alias("n"))
                       for i, c in enumerate(DIAGNOSIS)])
    found = F.filter(points, lambda p: p["n"] > 0)
    clean = F.array(F.struct(zero.alias("ord"), F.lit("clean").alias("code"), zero.alias("n")))
    close = (F.when(F.size(found) == 0, "periodic_review").when(F.col("score") < 60, "substantial_gap")
             .when(F.col("score") < 80, "partly_optimised").otherwise("good_level"))
    df = summary.select("site", close.alias("closing"), images.alias("_i"),
                        F.explode(F.when(F.size(found) > 0, found).otherwise(clean)).alias("p"))
    share = F.when((F.col("p.code") == "missing_alts") & (F.col("_i") > 0), F.round(F.col("p.n") / F.col("_i") * 100, 1))
    return df.select("site", F.col("p.ord").alias("ord"), F.col("p.code").alias("code"), F.col("p.n").alias("n"),
                     share.alias("share_pct"), "closing")


def health_split(summary: DataFrame) -> DataFrame:
    """Good / improve / fix per element with the share of good ones."""
    live, zero = F.col("live_pages"), F.lit(0)
    def part(name, good, mid, bad):
        return F.struct(F.lit(name).alias("element"), F.greatest(good, zero).cast("bigint").alias("good"),
                        F.greatest(mid, zero).cast("bigint").alias("improve"), bad.cast("bigint").alias("fix"))
    rows = F.array(
        part("titles", live - F.col("bad_titles"), F.col("bad_titles") - F.col("critical_titles"), F.col("critical_titles")),
        part("descs", live - F.col("bad_descs"), F.col("bad_descs") - F.col("critical_descs"), F.col("critical_descs")),
        part("images", F.col("good_alts"), F.col("weak_alts"), F.col("missing_alts")))
    df = summary.select("site", F.explode(rows).alias("r")).select("site", "r.*")
    total = F.greatest(F.col("good") + F.col("improve") + F.col("fix"), F.lit(1))
    return df.withColumn("good_pct", F.bround(F.col("good") / total * 100, 0).cast("bigint"))


def store_mix(summary: DataFrame) -> DataFrame:
    """Composition of the live pages by type."""
    names = ["products", "categories", "brand_pages", "listing_pages", "info_pages", "blog_pages", "archive_pages", "unclassified"]
    df = summary.select("site", "live_pages", *names).unpivot(["site", "live_pages"], names, "kind", "pages").where("pages > 0")
    return df.select("site", "kind", "pages", F.round(F.col("pages") / F.col("live_pages") * 100, 1).alias("pct"))


