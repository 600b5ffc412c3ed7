"""Sets over URL keys, image stems and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlwright.functions.rank import first_per
from crawlwright.functions.text import tokens
from crawlwright.functions.urls import add_url_parts, image_format, image_stem, percent_decode


def key_variants(df: DataFrame, url_col: str = "url") -> DataFrame:
    """B1: per site and page key, how many rows and URL spellings collapse into it."""
    keyed = add_url_parts(df, url_col)
    spelled = keyed.groupBy(F.col("host").alias("site"), "url_key", url_col).agg(
        F.count("*").alias("n"), F.max("has_lang").alias("l"))
    return spelled.groupBy("site", "url_key").agg(F.sum("n").alias("pages"), F.count("*").alias("variants"),
                                                  F.max("l").alias("any_lang"))


def preferred_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """B2: one URL per key: without language prefix, then one that extends another of the key, then the shortest,
    then the first seen.

    "Extends another" is a path-prefix test.  Each URL offers its own (few) parent paths to an equi-join, so the
    URLs of a key are never paired with each other.
    """
    keyed = add_url_parts(df, url_col)
    cand = keyed.groupBy(F.col("host").alias("site"), "url_key", F.col(url_col).alias("url"),
                         F.col("has_lang").alias("lang")).agg(F.min("seq").alias("seq"))
    cand = cand.withColumn("dec", F.regexp_replace(percent_decode(F.col("url")), "/+$", ""))
    pieces = F.split("dec", "/")
    parents = F.when(F.size(pieces) > 3, F.transform(
        F.sequence(F.lit(3), F.size(pieces) - 1), lambda n: F.array_join(F.slice(pieces, F.lit(1), n), "/")))
    ups = cand.select("site", "url_key", "lang", "url", F.explode(parents).alias("dec"))
    hits = (ups.join(cand.select("site", "url_key", "lang", "dec").distinct(), ["site", "url_key", "lang", "dec"],
                     "left_semi").select("site", "url_key", "url", F.lit(True).alias("ext")).distinct())
    work = cand.join(hits, ["site", "url_key", "url"], "left")
    return first_per(work, ["site", "url_key"], [
        F.col("lang"), ~F.coalesce("ext", F.lit(False)), F.length("url"), F.col("seq")]).drop("ext", "dec")


def image_sets(images: DataFrame) -> DataFrame:
    """Per site, slots, distinct images, size-free stems and formats."""
    df = images.select("site", "image_url", image_stem(F.col("image_url"), F.col("platform")).alias("stem"),
                       image_format(F.col("image_url")).alias("fmt"))
    per = df.groupBy("site", "stem", "fmt", "image_url").agg(F.count("*").alias("n"))
    return per.groupBy("site").agg(F.countDistinct("image_url").alias("images"), F.countDistinct("stem").alias("stems"),
                                   F.countDistinct("fmt").alias("formats"), F.sum("n").alias("slots"))


def token_index(df: DataFrame, text_col: str, id_col: str = "id") -> DataFrame:
    """The posting list ``(site, token, id)``."""
    return df.select("site", F.col(id_col).alias("id"),
                     F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("token")).select("site", "token", "id")


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("site", "token").agg(F.count("*").alias("df"))
