"""Link graph, coverage and reconciliation."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlwright import constants as K
from crawlwright.functions.rank import first_per, number_rows, top_k
from crawlwright.functions.text import tokens
from crawlwright.functions.urls import (add_url_parts, decisive_from, listing_kind_from, path_only, url_key)
from crawlwright.session import cut


def flag_in_map_linked(pages: DataFrame, sitemap_keys: DataFrame, linked_keys: DataFrame) -> DataFrame:
    """is the requested or the final key in the sitemap / linked?  One flag table, two joins."""
    flags = (sitemap_keys.select("site", "key", F.lit(True).alias("m"), F.lit(False).alias("l"))
             .unionByName(linked_keys.select("site", "key", F.lit(False).alias("m"), F.lit(True).alias("l")))
             .groupBy("site", "key").agg(F.max("m").alias("m"), F.max("l").alias("l")))
    had = [c for c in pages.columns if c not in ("in_map", "linked", "req_in_map", "req_linked")]
    df = pages.join(flags.select("site", F.col("key").alias("req_key"), F.col("m").alias("_rm"), F.col("l").alias("_rl")),
                    ["site", "req_key"], "left")
    df = df.join(flags.select("site", F.col("key").alias("url_key"), F.col("m").alias("_fm"), F.col("l").alias("_fl")),
                 ["site", "url_key"], "left")
    no = F.lit(False)
    return df.select(*had, F.coalesce("_rm", no).alias("req_in_map"), F.coalesce("_rl", no).alias("req_linked"),
                     (F.coalesce("_rm", no) | F.coalesce("_fm", no)).alias("in_map"),
                     (F.coalesce("_rl", no) | F.coalesce("_fl", no)).alias("linked"))


def frontier(links: DataFrame, seen: DataFrame) -> DataFrame:
    """every newly discovered key with its first link and its place ``pos`` in the site's queue."""
    fresh = links.select("site", "key", "url", "seq").join(seen.select("site", "key"), ["site", "key"], "left_anti")
    fresh = first_per(fresh, ["site", "key"], [F.col("seq"), F.col("url")])
    return number_rows(fresh, ["site"], [], "seq", "pos", ties=["url", "key"])


def referrer_index(links: DataFrame, samples: int = 3) -> DataFrame:
    """H1: per target, the number of linking pages and up to three of them, first seen first."""
    edges = links.select("site", "dst_key", "src_url", "seq").distinct()
    counts = edges.groupBy("site", "dst_key").agg(F.count("*").alias("n_pages"))
    urls = edges.groupBy("site", "dst_key", "src_url").agg(F.min("seq").alias("seq"))
    first = top_k(urls, ["site", "dst_key"], [F.col("seq"), F.col("src_url")], samples)
    first = first.groupBy("site", "dst_key").agg(F.array_sort(F.collect_list(F.struct("rank", "src_url"))).alias("s"))
    return counts.join(first, ["site", "dst_key"]).select(
        "site", "dst_key", "n_pages", F.transform("s", lambda x: x["src_url"]).alias("samples"))


def where_label(referrers: DataFrame, site_pages: DataFrame) -> DataFrame:
    """H2: where a link shows: menu or footer when on most pages, else sample paths."""
    paths = F.transform("samples", path_only)
    n = F.col("n_pages")
    more = F.when(n > F.size("samples"), F.concat(F.lit(" (+"), n - F.size("samples"), F.lit(")"))).otherwise("")
    label = (F.when(n >= F.greatest(F.lit(10.0), F.col("total_pages") * 0.5),
                    F.concat(F.lit("menu/footer ("), n, F.lit(" pages)")))
             .otherwise(F.concat(F.array_join(paths, " | "), more)))
    return referrers.join(site_pages.select("site", "total_pages"), "site").select(
        "site", "dst_key", "n_pages", label.alias("found_on"))


def _gone() -> Column:
    return F.col("fetch_code").isin(*K.GONE_CODES, K.FETCH_DELETED_HOME)


def coverage_report(audit: DataFrame, sitemap_report: DataFrame | None = None) -> DataFrame:
    """H3: sitemap coverage counters per site."""
    m, up, linked = F.col("in_map"), F.col("available"), F.col("linked")
    prod, content = F.col("page_type") == "product", F.col("page_type").isin(*K.CONTENT_TYPES)
    df = audit.groupBy("site").agg(
        F.count_if(m).alias("sitemap_total"), F.count_if(m & up).alias("sitemap_live"),
        F.count_if(m & ~up & _gone()).alias("sitemap_dead"), F.count_if(m & ~up & ~_gone()).alias("sitemap_unreachable"),
        F.count_if(m & up & ~linked & ~prod).alias("orphan_pages"),
        F.count_if(m & up & ~linked & prod).alias("scroll_only_products"),
        F.count_if(~m & up & content).alias("unlisted"), F.count_if(up & prod).alias("products_live"),
        F.count_if(~m & up & prod).alias("products_unlisted"))
    if sitemap_report is None:
        df = df.withColumn("partial", F.lit(False))
    else:
        df = df.join(sitemap_report.select("site", "partial"), "site", "left").withColumn(
            "partial", F.coalesce("partial", F.lit(False)))
    live = F.col("products_live")
    return df.withColumns({
        "unlisted_pages": F.when(F.col("partial"), 0).otherwise(F.col("unlisted")).cast("bigint"),
        "unlisted_suppressed": F.when(F.col("partial"), F.col("unlisted")).otherwise(0).cast("bigint"),
        "indexed_pct": F.when(live > 0, F.round((live - F.col("products_unlisted")) / live * 100, 1)).otherwise(100.0)
    }).drop("unlisted")


def coverage_tables(audit: DataFrame, sitemap_report: DataFrame | None = None) -> dict[str, DataFrame]:
    """H3: the rows behind the counters.  A site whose sitemap was read in part has no ``unlisted`` rows."""
    whole = audit
    if sitemap_report is not None:
        whole = audit.join(sitemap_report.where("partial").select("site").distinct(), "site", "left_anti")
    m, up, linked = F.col("in_map"), F.col("available"), F.col("linked")
    prod, content = F.col("page_type") == "product", F.col("page_type").isin(*K.CONTENT_TYPES)
    cols = ("site", "seq", "url", "page_type")
    return {"dead": audit.where(m & ~up & _gone()).select(*cols, "fetch_code"),
            "orphan": audit.where(m & up & ~linked & ~prod).select(*cols),
            "scroll_only": audit.where(m & up & ~linked & prod).select(*cols),
            "unlisted": whole.where(~m & up & content).select(*cols)}


def reconcile_counts(audit: DataFrame, sitemap_urls: DataFrame, mapping: DataFrame | None = None,
                     feed_counts: DataFrame | None = None) -> DataFrame:
    """H4: per site and type, pages found live against pages the sitemap announces."""
    live = add_url_parts(audit.where(F.col("available")).select("site", "url", "page_type"), "url", "k_")
    kind = F.when((F.col("page_type") == "category") & (listing_kind_from(F.col("k_low")) != "category"),
                  "listing").otherwise(F.col("page_type"))
    live = live.groupBy("site", F.col("k_url_key").alias("key")).agg(F.max(kind).alias("live_type"))
    sm = add_url_parts(sitemap_urls.select("site", "url", "url_type"), "url", "k_").withColumnRenamed("k_url_key", "req_key")
    if mapping is not None:
        sm = sm.join(mapping.select("site", "req_key", "final_key"), ["site", "req_key"], "left")
    else:
        sm = sm.withColumn("final_key", F.lit(None).cast("string"))
    own = F.when(decisive_from(F.col("k_low")) != "", decisive_from(F.col("k_low"))).otherwise(F.col("url_type"))
    own = F.when((own == "category") & (listing_kind_from(F.col("k_low")) != "category"), "listing").otherwise(own)
    sm = (sm.select("site", F.coalesce("final_key", "req_key").alias("key"), own.alias("map_type"))
          .groupBy("site", "key").agg(F.max("map_type").alias("map_type")))
    both = live.join(sm, ["site", "key"], "full_outer")
    t = F.coalesce("live_type", "map_type")
    out = both.groupBy("site", t.alias("page_type")).agg(
        F.count_if(F.col("live_type").isNotNull()).alias("found"),
        F.count_if(F.col("map_type").isNotNull()).alias("in_map"),
        F.count_if(F.col("live_type").isNotNull() & F.col("map_type").isNull()).alias("outside_map"),
        F.count_if(F.col("live_type").isNull()).alias("map_not_live"))
    return out.where(F.col("page_type").isin("product", "category", "blog"))


def store_totals(audit: DataFrame, feed_counts: DataFrame | None = None) -> DataFrame:
    """H4: the product total a site declares: on its catalogue root pages, or by its feed."""
    df = add_url_parts(audit.where(F.col("available")).select("site", "url", "declared_count"), "url", "k_")
    df = (df.where(F.array_join("k_low", "/").isin(*K.CATALOG_ROOTS) & (F.col("declared_count") > 0))
          .groupBy("site").agg(F.max("declared_count").cast("bigint").alias("store_total")))
    if feed_counts is None:
        return df
    return df.join(feed_counts.select("site", F.col("products").alias("_feed")), "site", "full_outer").select(
        "site", F.coalesce("_feed", "store_total").cast("bigint").alias("store_total"))


def declared_vs_found(listings: DataFrame, listing_products: DataFrame) -> DataFrame:
    """H5: per listing, declared count, distinct product keys seen and the gap."""
    seen = (listing_products.select("site", "listing_key", "product_key").distinct()
            .groupBy("site", "listing_key").agg(F.count("*").alias("found")))
    df = (listings.where(F.coalesce("declared_count", F.lit(0)) > 0)
          .withColumn("listing_key", url_key(F.col("url"))).join(seen, ["site", "listing_key"], "left"))
    found = F.coalesce("found", F.lit(0))
    return df.select("site", "url", F.col("declared_count").cast("bigint").alias("declared"),
                     found.cast("bigint").alias("found"),
                     F.greatest(F.col("declared_count") - found, F.lit(0)).cast("bigint").alias("missing"))


def _declared_gaps() -> tuple[Column, Column, Column]:
    """H5, per product page: (declared name, does the shown name share no word with it, are there fewer images than declared)."""
    declared, shown = F.trim(F.coalesce("declared_name", F.lit(""))), F.trim(F.coalesce("display_name", F.lit("")))
    dt, st = tokens(declared), tokens(shown)
    name_gap = (declared != "") & (shown != "") & (F.size(dt) > 0) & ~F.coalesce(F.arrays_overlap(dt, st), F.lit(False))
    img_gap = ((declared != "") & (F.coalesce("declared_images", F.lit(0)) > 0)
               & (F.coalesce("total_images", F.lit(0)) < F.col("declared_images")))
    return declared, name_gap, img_gap


def structured_report(audit: DataFrame, category_rows: DataFrame) -> DataFrame:
    """H5: per-site counters of structured data against what the pages show."""
    p = audit.where(F.col("available") & (F.col("page_type") == "product"))
    declared, name_gap, img_gap = _declared_gaps()
    prod = p.groupBy("site").agg(
        F.count("*").alias("found_products"), F.count_if(declared == "").alias("no_jsonld"),
        F.count_if(name_gap).alias("name_mismatch"), F.count_if(img_gap).alias("image_gap"))
    cats = category_rows.groupBy("site").agg(
        F.count("*").alias("categories_checked"), F.count_if(F.col("missing") == 0).alias("categories_matched"),
        F.sum("missing").alias("missing_products"))
    df = prod.join(cats, "site", "full_outer")
    names = ("found_products", "no_jsonld", "name_mismatch", "image_gap", "categories_checked", "categories_matched",
             "missing_products")
    return df.select("site", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names],
                     F.when(F.col("categories_checked") > 0,
                            F.round(F.col("categories_matched") / F.col("categories_checked") * 100, 1))
                     .alias("coverage_pct"))


def structured_tables(audit: DataFrame, category_rows: DataFrame) -> dict[str, DataFrame]:
    """H5: the rows behind the counters."""
    p = audit.where(F.col("available") & (F.col("page_type") == "product"))
    _, name_gap, img_gap = _declared_gaps()
    return {"image_gap": p.where(img_gap).select("site", "seq", "url", "declared_images", F.coalesce("total_images", F.lit(0)).alias("total_images")),
            "name_gap": p.where(name_gap).select("site", "seq", "url", "declared_name", "display_name"),
            "category_counters": category_rows}


def pagination_needed(audit: DataFrame, sitemap_report: DataFrame) -> DataFrame:
    """H6: per site, does the slow listing walk have to run, and why."""
    keyed = audit.select("site", "available", "page_type", "declared_count", url_key(F.col("url")).alias("key"))
    known = (keyed.where(F.col("available") & (F.col("page_type") == "product")).select("site", "key").distinct()
             .groupBy("site").agg(F.count("*").alias("known")))
    best = keyed.groupBy("site").agg(F.max(F.when(F.col("page_type").isin("category", "home"),
                                                  F.col("declared_count"))).alias("best"))
    df = best.join(known, "site", "left").join(sitemap_report, "site", "left")
    total, k = F.coalesce("total_urls", F.lit(0)), F.coalesce("known", F.lit(0))
    reason = (F.when(total == 0, "no_sitemap").when(F.coalesce("partial", F.lit(False)), "partial_sitemap")
              .when(F.coalesce("best", F.lit(0)) > k, "declared_more_than_known")
              .when(k == 0, "no_products").otherwise("complete"))
    return df.select("site", reason.alias("reason"), (reason != "complete").alias("needed"))


def home_redirect_suspicion(fetched: DataFrame, sitemap_counts: DataFrame) -> DataFrame:
    """H7."""
    n = fetched.groupBy("site").agg(F.count_if(F.col("fetch_code") == K.FETCH_DELETED_HOME).alias("home_redirects"))
    df = n.join(sitemap_counts.select("site", "sitemap_urls"), "site", "left")
    return df.select("site", "home_redirects", ((F.col("home_redirects") >= 10) & (
        F.col("home_redirects") > F.greatest(F.coalesce("sitemap_urls", F.lit(0)), F.lit(1)) * 0.15)).alias("suspicious"))


def reachability(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """H8: pages reachable from the roots, with the number of clicks.

    Breadth-first: the frontier meets the edge table on (site, src), known pages leave by an anti-join, and every
    round is written to the checkpoint folder, so the plan stays one round long.
    """
    edges = cut(edges.select("site", "src", "dst").distinct())
    front = roots.select("site", F.col("key").alias("dst")).distinct().withColumn("clicks", F.lit(0).cast("bigint"))
    seen = cut(front)
    front = seen
    for depth in count(1):  # ends with an empty frontier: known pages are never entered again
        step = (front.select("site", F.col("dst").alias("src")).join(edges, ["site", "src"]).select("site", "dst")
                .distinct().join(seen.select("site", "dst"), ["site", "dst"], "left_anti")
                .withColumn("clicks", F.lit(depth).cast("bigint")))
        front = cut(step)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.select("site", F.col("dst").alias("key"), "clicks")


def guessed_listing_seeds(sites: DataFrame, fetch_log: DataFrame) -> DataFrame:
    """H9: known listing paths of a site that answered with an HTML page other than home."""
    cand = sites.select("site", F.col("home_url"), F.explode(F.array(*[F.lit(p) for p in K.GUESSED_LISTINGS])).alias("p"))
    cand = cand.select("site", F.concat_ws("/", F.regexp_replace("home_url", "/+$", ""), "p").alias("url"),
                       url_key(F.col("home_url")).alias("home_key"))
    ok = fetch_log.where((F.col("status") == 200) & F.contains(
        F.lower(F.coalesce("content_type", F.lit("html"))), F.lit("html"))).select(
        "site", F.col("req_url").alias("url"), url_key(F.col("final_url")).alias("final_key"))
    return (cand.join(ok, ["site", "url"]).where(F.col("final_key") != F.col("home_key"))
            .select("site", "url").distinct())


def blog_roots(audit: DataFrame) -> DataFrame:
    """Reachable archive pages with a blog segment; ``pos`` orders them by path length."""
    df = add_url_parts(audit.where(F.col("available") & (F.col("page_type") == "archive")), "url", "k_")
    df = df.where(F.exists("k_low", lambda s: s.isin(*K.BLOG_SEGMENTS)))
    df = df.groupBy("site", "url").agg(F.min(F.size("k_segs")).cast("bigint").alias("depth"), F.min("seq").alias("seq"))
    return number_rows(df, ["site"], [F.col("depth")], "seq", "pos", ties=["url"])


def listing_products(links: DataFrame, page_types: DataFrame, listings: DataFrame) -> DataFrame:
    """Distinct product keys among the links of category and home pages."""
    prod = page_types.where(F.col("page_type") == "product").select("site", F.col("key").alias("dst_key")).distinct()
    lists = listings.where(F.col("page_type").isin("category", "home")).select("site", F.col("key").alias("src_key")).distinct()
    return (links.select("site", "src_key", "dst_key").join(lists, ["site", "src_key"], "left_semi")
            .join(prod, ["site", "dst_key"], "left_semi").select(
                "site", F.col("src_key").alias("listing_key"), F.col("dst_key").alias("product_key")).distinct())
