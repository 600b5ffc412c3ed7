"""One row per page, retries, request mapping and the resume store."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlwright import constants as K
from crawlwright.functions.rank import first_per
from crawlwright.functions.urls import url_key, url_parts
from crawlwright.session import cut


def dedupe_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G1: (kept pages, per-site report).

    First per page key, reachable and prefix-free rows first.  Then, among reachable rows, the later ones of a
    canonical target go, unless a site of ten or more pages would lose over half of them: such canonicals are
    broken, everything stays and the report says so.
    """
    canon = F.trim(F.coalesce("canonical_url", F.lit("")))
    keyed = pages.select("site", "seq", "available", canon.alias("_c"), url_parts(F.col("url")).alias("_p"))
    keyed = keyed.select("site", "seq", (~F.col("available")).alias("_down"), F.col("_p.has_lang").alias("_lang"),
                         F.col("_p.url_key").alias("_pk"),
                         F.when(F.col("_c") != "", url_key(F.col("_c"))).otherwise(F.col("_p.url_key")).alias("_ck"))
    # keys only: the wide rows meet the verdict once, at the end
    one = cut(first_per(keyed, ["site", "_pk"], [F.col("_down"), F.col("_lang"), F.col("seq")]))
    # the first reachable page of every canonical target that has more than one
    slim = one.where("NOT _down").groupBy("site", "_ck").agg(
        F.count("*").alias("_n"), F.min_by("_pk", F.struct("_lang", "seq")).alias("_first"))
    stats = slim.groupBy("site").agg(F.sum("_n").alias("available_pages"), F.sum(F.col("_n") - 1).alias("dup_pages"))
    stats = stats.withColumn("canon_broken", F.when((F.col("available_pages") >= 10)
                                                    & (F.col("dup_pages") > F.col("available_pages") * 0.5),
                                                    F.col("dup_pages")).otherwise(0).cast("bigint"))
    later = (one.where("NOT _down").join(slim.where("_n > 1").drop("_n"), ["site", "_ck"]).where("_first <> _pk")
             .join(stats.where("canon_broken = 0").select("site"), "site", "left_semi").select("site", "seq"))
    kept = one.select("site", "seq").join(later, ["site", "seq"], "left_anti")
    return pages.join(kept, ["site", "seq"], "left_semi"), stats


def retryable(code):
    return code.isin("conn_failed", "http_429", "http_403") | code.rlike("^http_5[0-9]{2}$")


def merge_retry(pages: DataFrame, retry: DataFrame, keep: tuple[str, ...] = ("in_map", "linked", "source")) -> DataFrame:
    """an unreachable row takes its retry row if that one is reachable or final; discovery flags stay."""
    good = retry.where(F.col("available") | ~retryable(F.col("fetch_code")))
    good = first_per(good, ["site", "req_url"], [-F.col("seq")])
    payload = [c for c in pages.columns if c not in ("site", "req_url", "seq", *keep)]
    joined = pages.join(good.select("site", "req_url", F.struct(*payload).alias("_g")), ["site", "req_url"], "left")
    swap = ~F.col("available") & F.col("_g").isNotNull()
    return joined.select(*[F.when(swap, F.col("_g")[c]).otherwise(F.col(c)).alias(c) if c in payload else F.col(c)
                           for c in pages.columns])


def req_to_final(pages: DataFrame) -> DataFrame:
    """requested key -> final key, from reachable rows before deduplication (the last row wins)."""
    up = pages.where(F.col("available")).select(
        "site", "seq", url_key(F.col("req_url")).alias("req_key"), url_key(F.col("url")).alias("final_key"))
    return first_per(up, ["site", "req_key"], [-F.col("seq")]).drop("seq")


def resume_store_latest(log: DataFrame, now: dt.datetime, ttl_seconds: int = K.RESUME_SECONDS) -> DataFrame:
    """A10: reusable results: success or gone, at most ``ttl`` old, last record per key."""
    keep = ((F.col("fetch_code") == K.FETCH_OK) | F.col("fetch_code").isin(*K.GONE_CODES))
    oldest = F.lit(now - dt.timedelta(seconds=ttl_seconds)).cast(dict(log.dtypes)["ts"])
    return first_per(log.where(keep & (F.col("ts") >= oldest)), ["site", "key"], [-F.col("seq")])
