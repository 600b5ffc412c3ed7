"""Unions and differences of page key sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlwright.functions.rank import first_per


def compare_keys(found: DataFrame, declared: DataFrame) -> DataFrame:
    """``(kind, site, key)``: keys only found, only declared, or both; one shuffle of the two key sets."""
    marks = (found.select("site", "key", F.lit(True).alias("f"), F.lit(False).alias("d"))
             .unionByName(declared.select("site", "key", F.lit(False).alias("f"), F.lit(True).alias("d")))
             .groupBy("site", "key").agg(F.max("f").alias("f"), F.max("d").alias("d")))
    kind = F.when(F.col("f") & F.col("d"), "both").when(F.col("f"), "found_only").otherwise("declared_only")
    return marks.select(kind.alias("kind"), "site", "key")


def union_sources(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Pages of several discovery steps; a key stays with the first step that found it."""
    out = None
    for order, (source, df) in enumerate(parts):
        df = df.withColumns({"source": F.lit(source), "_o": F.lit(order)})
        out = df if out is None else out.unionByName(df)
    return first_per(out, ["site", "key"], [F.col("_o"), F.col("seq")]).drop("_o")
