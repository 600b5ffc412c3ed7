"""Readers of landed tables, with declared schemas and typed nulls for missing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_COLUMNS = {"page_id": "bigint", "url": "string", "html": "string", "content_type": "string",
                "robots_header": "string"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns_filled(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add every missing column as a typed null; existing columns keep their values."""
    missing = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A1: landed pages ``(page_id, url, html, ...)`` whose content type is HTML or unknown."""
    df = with_columns_filled(spark.read.parquet(path), PAGE_COLUMNS)
    kind = F.lower(F.coalesce(F.col("content_type"), F.lit("")))
    return df.where((kind == "") | F.contains(kind, F.lit("html"))).select(*PAGE_COLUMNS)
