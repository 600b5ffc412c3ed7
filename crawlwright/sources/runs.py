"""Runs of an audit in one folder.  Tables first, then the manifest: what the manifest does not name was never there.

``<path>/<table>/run_id=<run>/`` holds the rows of a run, ``<path>/manifest/run_id=<run>/`` one row per site it covers.  A site's
rows are those of the newest run that names it, so a rerun of one site replaces that site and touches no other file.  Folders
are per run and not per site: a run over a million small sites writes as many files as it has tasks.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest"


def _folder(path: str, table: str, run: str) -> str:
    """Run names start with a letter, so that a folder name never reads as a number or a date."""
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_.-]*", run):
        raise ValueError(f"a run name is a letter and letters, digits, '_', '.' or '-': {run!r}")
    return f"{path}/{table}/run_id={run}"


def write_table(df: DataFrame, path: str, table: str, run: str) -> DataFrame:
    """Write one table of a run and go on from its files.  A replay of the run replaces what it wrote before."""
    if table == MANIFEST or "run_id" in df.columns:
        raise ValueError("'manifest' and the column 'run_id' belong to the store")
    where = _folder(path, table, run)
    df.write.mode("overwrite").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def commit(headers: DataFrame, path: str, run: str, at: dt.datetime) -> None:
    """Make a run visible: one row per site (``headers`` has ``site`` and whatever the list of scans shows).

    Call it when every table of the run is written.  A site that repeats in ``headers`` counts once.
    """
    headers.dropDuplicates(["site"]).withColumn("scan_date", F.lit(at)).write.mode("overwrite").parquet(_folder(path, MANIFEST, run))


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    """Every committed run of every site with its header, as ``(site, run_id, scan_date, ...)``."""
    return spark.read.option("mergeSchema", "true").parquet(f"{path}/{MANIFEST}")


def newest(runs: DataFrame) -> DataFrame:
    """``(site, run_id)`` of each site's newest run; the later name where two runs have one time."""
    return runs.groupBy("site").agg(F.max_by("run_id", F.struct("scan_date", "run_id")).alias("run_id"))


def restore(spark: SparkSession, path: str, table: str, wanted: DataFrame | None = None) -> DataFrame:
    """A table as the wanted runs ``(site, run_id)`` left it, by default each site's newest.

    Runs that were not committed are not read, whatever ``wanted`` says: files of a run that broke off are never seen.
    """
    done = list_runs(spark, path)
    pick = newest(done) if wanted is None else done.join(wanted.select("site", "run_id"), ["site", "run_id"], "left_semi")
    rows = spark.read.option("mergeSchema", "true").parquet(f"{path}/{table}")
    return rows.join(pick.select("site", "run_id"), ["site", "run_id"], "left_semi")


def compact(spark: SparkSession, path: str, tables: tuple[str, ...], run: str, at: dt.datetime) -> None:
    """Write what is current as one run, so that the folders of earlier runs are read no more and may be removed."""
    for table in tables:
        write_table(restore(spark, path, table).drop("run_id"), path, table, run)
    runs = list_runs(spark, path)
    commit(runs.join(newest(runs), ["site", "run_id"], "left_semi").drop("run_id", "scan_date"), path, run, at)
