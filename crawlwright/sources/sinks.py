"""Scan history, chunked CSV and the export tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlwright import constants as K
from crawlwright.functions.rank import number_rows
from crawlwright.operators import redirects as R
from crawlwright.operators import worklists as W


def append_history(scans: DataFrame, rows: DataFrame, path: str) -> None:
    """Append one scan per site: its header and its graded rows (both carry site and scan_id)."""
    scans.write.mode("append").partitionBy("site").parquet(f"{path}/scans")
    rows.write.mode("append").partitionBy("site", "scan_id").parquet(f"{path}/rows")


def read_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/scans"), spark.read.parquet(f"{path}/rows")


def list_history(scans: DataFrame) -> DataFrame:
    """Headers, newest first within the site."""
    return scans.select("site", "scan_id", "scan_date", "score", "total_pages").orderBy(
        "site", F.desc("scan_date"), F.desc("scan_id"))


def latest_scans(scans: DataFrame) -> DataFrame:
    return scans.groupBy("site").agg(F.max_by("scan_id", F.struct("scan_date", "scan_id")).alias("scan_id"))


def restore_history(scans: DataFrame, rows: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The rows of the wanted scans (the newest per site by default); a missing flag means reachable."""
    wanted = latest_scans(scans) if wanted is None else wanted
    out = rows.join(wanted.select("site", "scan_id"), ["site", "scan_id"], "left_semi")
    if "available" not in out.columns:
        out = out.withColumn("available", F.lit(True))
    return out


def assign_chunks(df: DataFrame, group: list[str], seq: str, stem: str, rows: int = K.CSV_CHUNK_ROWS,
                  ties: list[str] | None = None) -> DataFrame:
    """Continuous numbering, chunk number and file name; a table of one chunk keeps the plain name."""
    out = number_rows(df, group, [], seq, "row_no", ties=ties)
    out = out.withColumn("chunk", F.floor((F.col("row_no") - 1) / rows).cast("bigint"))
    totals = out.groupBy(*group).agg(F.count("*").alias("_total"))
    first = F.col("chunk") * rows + 1
    last = F.least(first + rows - 1, F.col("_total"))
    name = F.when(F.col("_total") <= rows, F.lit(f"{stem}.csv")).otherwise(
        F.concat(F.lit(f"{stem}_"), first, F.lit("-"), last, F.lit(".csv")))
    return out.join(totals, group).withColumn("file_name", name).drop("_total")


def clickable(df: DataFrame) -> DataFrame:
    """Blanks in URL columns become %20, so that a link in a file opens as a whole."""
    urls = [c for c, t in df.dtypes if t == "string" and (c.endswith("url") or c == "found_on")]
    return df.withColumns({c: F.when(F.col(c).startswith("http"), F.replace(F.col(c), F.lit(" "), F.lit("%20")))
                           .otherwise(F.col(c)) for c in urls}) if urls else df


def write_chunked_csv(df: DataFrame, path: str, group: list[str], seq: str, stem: str, ties: list[str] | None = None) -> None:
    """One CSV file per site and chunk of 500 rows, written in parallel."""
    out = assign_chunks(clickable(df), group, seq, stem, ties=ties).drop("chunk")
    (out.repartition(*group, "file_name").sortWithinPartitions(*group, "file_name", "row_no")
     .write.mode("overwrite").partitionBy(*group, "file_name").option("header", True).csv(path))


def work_tables(masked: DataFrame, unique_images: DataFrame, dead: DataFrame, platforms: DataFrame) -> dict[str, DataFrame]:
    """The work lists of J5 and the import file of I8, the latter for sites whose platform takes one.

    ``masked`` is the graded audit with its fix masks; ``dead`` the audit with the place and destination of dead links.
    """
    takes = platforms.where(F.col("platform").isin(*K.REDIRECT_PLATFORMS)).select("site").distinct()
    return {"titles": W.titles_list(masked), "descs": W.descs_list(masked),
            "alt_missing": W.image_list(unique_images, ("alt_missing",)), "alt_weak": W.image_list(unique_images, K.ALT_WEAK),
            "broken": R.broken_links(dead, platforms), "redirect_import": R.redirect_import(dead.join(takes, "site", "left_semi"))[0]}


def export_tables(audit: DataFrame, images: DataFrame, coverage: dict[str, DataFrame] | None = None,
                  structured: dict[str, DataFrame] | None = None, work: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Every named output of an audit."""
    out = {f"pages_{t}": audit.where(F.col("page_type") == t) for t in K.PAGE_TYPES if t != "broken"}
    out["images"] = images
    for group in (coverage, structured, work):
        out.update(group or {})
    out["full_audit"] = audit
    return out


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def count_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per named output, in one job."""
    out = None
    for name, df in tables.items():
        one = df.groupBy().agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


