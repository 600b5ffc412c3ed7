"""The flagship report: which sites have the worst titles?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlwright import constants as K
from crawlwright.functions.rank import first_per
from crawlwright.functions.text import lookup
from crawlwright.operators.pages import page_facts


def site_titles(pages: DataFrame) -> DataFrame:
    """Landed pages -> facts -> one row per page key -> shared titles -> one row per site.

    The HTML column ends in the scan stage: what is shuffled is a key and a few short strings.  Titles are counted
    per (site, title) first, so a title on a third of all pages is one row per task after the partial count.
    """
    facts = page_facts(pages).select("page_id", "site", "url_key", "has_lang", "title", "h1", "title_status")
    one = first_per(facts, ["site", "url_key"], [F.col("has_lang"), F.col("page_id")])
    weight = lookup(F.col("title_status"), [(k, int(v * 100)) for k, v in K.LENGTH_WEIGHT], 0)
    per_title = one.groupBy("site", "title").agg(
        F.count("*").alias("n"), F.count_if(F.col("title_status") != "optimal").alias("bad"),
        F.count_if((F.col("h1") != "") & (F.col("title") == F.col("h1"))).alias("same"), F.sum(weight).alias("w"))
    return per_title.groupBy("site").agg(
        F.sum("n").alias("pages"), F.sum("bad").alias("bad_titles"),
        F.sum(F.when(F.col("n") >= 2, F.col("n")).otherwise(0)).alias("shared_titles"),
        F.sum("same").alias("title_is_h1"), F.round(F.sum("w") / F.sum("n"), 1).alias("title_score"))
