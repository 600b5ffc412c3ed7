"""Fetch outcomes, redirect report, broken links and their repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlwright import constants as K
from crawlwright.functions.rank import first_per, number_rows
from crawlwright.functions.text import let, lookup, text
from crawlwright.functions.urls import (clean_url, match_path, normalize_url, path_only, percent_decode, same_page_key,
                                        url_key)

ARROW = " → "


def classify_fetch(fetch_log: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """A2: outcome code, moved flag, final URL and redirect chain of every request.

    ``fetch_log``: site, seq, req_url, status, content_type, final_url, hops array<int>, canonical_url.
    ``sites``: site, home_url; without it every row carries its ``home_url``, and nothing is shuffled.
    """
    had = [c for c in fetch_log.columns if c not in ("fetch_code", "available", "moved", "chain", "final_url")]
    known = F.struct(
        F.col("_home").alias("home"), url_key(clean_url(F.col("req_url"))).alias("req_key"),
        clean_url(F.col("final_url")).alias("final"),
        (same_page_key(F.col("final_url")) != same_page_key(F.col("req_url"))).alias("moved"),
        (url_key(clean_url(F.col("final_url"))) == F.col("_home")).alias("home_final"),
        F.when(text(F.col("canonical_url")) != "", url_key(clean_url(F.col("canonical_url"))) == F.col("_home"))
        .otherwise(False).alias("home_canon"),
        F.when(F.size("hops") > 0, F.array_join(F.array_append(
            F.col("hops").cast("array<string>"), F.col("status").cast("string")), ARROW)).otherwise("").alias("chain"))
    status, ctype = F.col("status"), F.lower(text(F.col("content_type")))

    def judge(k: Column) -> Column:
        lost = (k["req_key"] != k["home"]) & (k["home_final"] | k["home_canon"])
        code = (F.when(status.isNull(), K.FETCH_CONN_FAILED)
                .when(status != 200, F.concat(F.lit("http_"), status))
                .when((ctype != "") & ~F.contains(ctype, F.lit("html")), K.FETCH_NOT_HTML)
                .when(lost, K.FETCH_DELETED_HOME).otherwise(K.FETCH_OK))
        return let(code, lambda c: outcome(k, c))

    def outcome(k: Column, c: Column) -> Column:
        quiet = c.isin(K.FETCH_CONN_FAILED, K.FETCH_NOT_HTML)
        gone_home = c == K.FETCH_DELETED_HOME
        chain = F.when(gone_home & (k["chain"] == ""), "canonical" + ARROW + "home").otherwise(k["chain"])
        return F.struct(
            c.alias("fetch_code"), (c == K.FETCH_OK).alias("available"),
            F.coalesce(k["moved"], F.lit(False)).alias("moved"),
            F.when(~quiet & (gone_home | k["moved"]), k["final"]).otherwise("").alias("final_url"),
            F.when(quiet | ((c == K.FETCH_OK) & ~k["moved"]), "").otherwise(chain).alias("chain"))

    home = url_key(normalize_url(F.col("home_url"))).alias("_home")
    df = fetch_log.withColumn("_home", home) if sites is None else fetch_log.join(sites.select("site", home), "site", "left")
    df = df.withColumn("_r", let(known, judge))
    return df.select(*had, *[F.col("_r")[n].alias(n) for n in ("fetch_code", "available", "moved", "final_url", "chain")])


def moved_rows(fetched: DataFrame) -> DataFrame:
    """Rows that moved or are gone, with ``status_kind``: every fetched row, also where addresses share a key (fragments, variants)."""
    c, first = F.col("fetch_code"), F.split_part("chain", F.lit(ARROW), F.lit(1))
    status = (F.when(c == K.FETCH_DELETED_HOME, "home").when(c == "http_404", "404").when(c == "http_410", "410")
              .when(F.col("available") & (text(F.col("final_url")) != ""),
                    F.when(first.isin("302", "303", "307"), "temp").otherwise("perm")))
    return fetched.withColumn("status_kind", status).where(F.col("status_kind").isNotNull())


def redirect_report(fetched: DataFrame) -> DataFrame:
    """One row per requested key that moved or is gone, with the action it needs.

    Built on rows before deduplication, so that old addresses are not lost.
    """
    df = moved_rows(fetched).withColumn("req_key", url_key(F.col("req_url")))
    one = first_per(df, ["site", "req_key"], [F.col("seq")])
    if "req_in_map" in one.columns:  # what is said of the requested address, not of its target
        one = one.withColumns({"in_map": F.col("req_in_map"), "linked": F.col("req_linked")})
    k = F.col("status_kind")
    quiet = k.isin("perm", "temp") & ~F.col("in_map") & ~F.col("linked")
    action = (F.when(quiet, "none_urgent").when(k == "home", "restore_or_redirect")
              .when(k.isin("404", "410"), "add_redirect").when(k == "temp", "make_permanent").otherwise("update_links"))
    return one.select("site", percent_decode(F.col("req_url")).alias("req_url"), k.alias("status"), "final_url", "chain",
                      "link_type", "in_map", "linked", "source", action.alias("action"))


def sorted_report(report: DataFrame) -> DataFrame:
    rank = lookup(F.col("status"), (("404", 0), ("410", 0), ("home", 1), ("temp", 2), ("perm", 3)))
    return report.orderBy("site", rank, ~F.col("in_map"), "req_url")


def redirect_stats(report: DataFrame) -> DataFrame:
    """I2."""
    s = F.col("status")
    return report.groupBy("site").agg(
        F.count_if(s == "perm").alias("redirects_permanent"), F.count_if(s == "temp").alias("redirects_temporary"),
        F.count_if(s == "home").alias("redirects_home"), F.count_if(s.isin("404", "410")).alias("not_found_pages"),
        F.count_if("in_map").alias("redirects_in_sitemap"), F.count("*").alias("redirects_total"))


def is_broken() -> Column:
    """Gone and not redirected."""
    return ~F.col("available") & F.col("fetch_code").isin(*K.GONE_CODES) & (F.trim(text(F.col("chain"))) == "")


def broken_mask(pages: DataFrame) -> DataFrame:
    return pages.where(is_broken())


def broken_action(can_redirect: Column) -> Column:
    has_alt = F.trim(text(F.col("suggested_url"))) != ""
    return (F.when(can_redirect & has_alt, F.when(F.col("linked"), "redirect_fix").otherwise("redirect"))
            .when(F.col("linked"), F.when(has_alt, "fix_to").otherwise("fix_remove")).otherwise("none"))


def _with_action(pages: DataFrame, platforms: DataFrame) -> DataFrame:
    df = broken_mask(pages).join(platforms.select("site", "platform"), "site", "left")
    can = F.coalesce(F.col("platform").isin(*K.REDIRECT_PLATFORMS), F.lit(False))
    return df.withColumn("action", broken_action(can))


def broken_links(pages: DataFrame, platforms: DataFrame) -> DataFrame:
    """The table of dead links with place, destination and action."""
    return _with_action(pages, platforms).select(
        "site", "url", "link_type", F.regexp_replace("fetch_code", "^http_", "").alias("code"), "in_map", "linked",
        text(F.col("found_on")).alias("found_on"), text(F.col("suggested_url")).alias("suggested_url"),
        text(F.col("suggestion_conf")).alias("suggestion_conf"), "action")


ACTION_ORDER = (("redirect_fix", 0), ("redirect", 1), ("fix_to", 2), ("fix_remove", 3), ("none", 4))


def sorted_broken_links(table: DataFrame) -> DataFrame:
    return table.orderBy("site", lookup(F.col("action"), ACTION_ORDER), "url")


def broken_work_counts(pages: DataFrame, platforms: DataFrame) -> DataFrame:
    """I7."""
    a = F.col("action")
    return _with_action(pages, platforms).groupBy("site").agg(
        F.count_if(a.isin("redirect", "redirect_fix")).alias("redirect_qty"),
        F.count_if("linked").alias("internal_fix_qty"), F.count_if(a != "none").alias("broken_actionable"))


def redirect_import(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I8: (import rows named seo-n, skipped rows with the reason)."""
    live = (pages.where(F.col("available") & (F.trim(text(F.col("final_url"))) == ""))
            .select("site", url_key(F.col("url")).alias("_dk")).distinct().withColumn("_live", F.lit(True)))
    broken = broken_mask(pages).withColumn("_from", path_only(F.col("url")))
    sources = broken.select("site", F.col("_from").alias("_to")).distinct().withColumn("_chain", F.lit(True))
    rows = broken.where(F.trim(text(F.col("suggested_url"))) != "").select(
        "site", "seq", "url", "_from", path_only(F.col("suggested_url")).alias("_to"),
        url_key(F.col("suggested_url")).alias("_dk"))
    rows = rows.join(live, ["site", "_dk"], "left").join(sources, ["site", "_to"], "left")
    reason = (F.when(F.col("_live").isNull(), "destination_not_live")
              .when((F.col("_from") == F.col("_to")) | F.col("_chain").isNotNull(), "loop_or_chain"))
    rows = rows.withColumn("_reason", reason)
    good = rows.where(F.col("_reason").isNull())
    first = good.groupBy("site", "_from").agg(F.min("seq").alias("seq"), F.lit(True).alias("_first"))
    marked = good.join(first, ["site", "_from", "seq"], "left")
    table = number_rows(marked.where("_first").select("site", "seq", "_from", "_to"), ["site"], [], "seq", "n",
                        ties=["_from"])
    table = table.select("site", F.concat(F.lit("seo-"), "n").alias("name"), F.col("_from").alias("from_path"),
                         F.col("_to").alias("to_path"))
    skipped = rows.where(F.col("_reason").isNotNull()).select("site", "url", F.col("_reason").alias("reason")).unionByName(
        marked.where(F.col("_first").isNull()).select("site", "url", F.lit("duplicate").alias("reason")))
    return table, skipped


def url_change_redirects(changes: DataFrame) -> DataFrame:
    """I12."""
    n = number_rows(changes.select("site", "seq", "url", "new_url"), ["site"], [], "seq", "n", ties=["url"])
    return n.select("site", F.concat(F.lit("seo-url-"), "n").alias("name"), path_only(F.col("url")).alias("from_path"),
                    path_only(F.col("new_url")).alias("to_path"))


def phase_redirects(import_rows: DataFrame, phase_broken: DataFrame) -> DataFrame:
    """import rows whose source is among the broken links of a phase."""
    paths = phase_broken.select("site", match_path(F.col("url")).alias("_p")).distinct()
    return (import_rows.withColumn("_p", match_path(F.col("from_path"))).join(paths, ["site", "_p"], "left_semi")
            .select(*import_rows.columns))


def verify_redirects(pairs: DataFrame, fetch_log: DataFrame) -> DataFrame:
    """Verdict per planned redirect from a later fetch log (latest request per URL)."""
    latest = first_per(fetch_log.select("site", "seq", "req_url", "status", "hops", "final_url"), ["site", "req_url"],
                       [-F.col("seq")])
    p = pairs.withColumn("req_url", F.concat("home_url", "from_path"))
    df = p.join(latest.drop("seq"), ["site", "req_url"], "left")
    hops, first = F.coalesce(F.size("hops"), F.lit(0)), F.try_element_at("hops", F.lit(1))
    verdict = (F.when(F.col("status").isNull(), "no_reply").when(hops <= 0, "no_redirect")
               .when(url_key(F.col("final_url")) != url_key(F.concat("home_url", "to_path")), "wrong_destination")
               .when(F.col("status") != 200, "destination_failed").when(first != 301, "not_permanent")
               .when(hops > 1, "more_than_one_hop").otherwise("works"))
    return df.select("site", "from_path", "to_path", verdict.alias("verdict"), (verdict == "works").alias("ok"))


def unreachable_reasons(pages: DataFrame) -> DataFrame:
    """I10."""
    c = F.col("fetch_code")
    reason = (F.when(F.contains(c, F.lit("429")), "rate_limited").when(F.contains(c, F.lit("403")), "forbidden")
              .when(c.rlike("^http_5[0-9]{2}"), "server_error").when(c == K.FETCH_CONN_FAILED, "connection")
              .when(c.startswith(K.FETCH_TECH_ERROR), "technical").otherwise(F.concat(F.lit("other:"), c)))
    gone = c.isin(*K.GONE_CODES, K.FETCH_DELETED_HOME)
    return (pages.where(~F.col("available") & ~gone).groupBy("site", reason.alias("reason"))
            .agg(F.count("*").alias("pages")))
