"""The incremental jobs as Structured Streaming.

Every transformation is an ordinary DataFrame function that also runs on a batch; the ``start_*`` functions add
source, trigger and sink.  Sinks write tables, never driver memory.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlwright import constants as K
from crawlwright.operators import extract as X
from crawlwright.operators.pages import page_facts, page_links
from crawlwright.session import ensure_checkpoint_dir
from crawlwright.streaming.store import KeyedStore


def landing_stream(spark: SparkSession, folder: str, schema: str, table: str | None = None, files_per_batch: int = 1000
                   ) -> DataFrame:
    """A stream over landed parquet files: all of a folder, or one table of it, which is a file or a folder of files (a plain path
    must be a folder, a pattern may meet either)."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/{{{table}}}" if table else folder)


def job_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder for the table and the progress of one run."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def append_table(stream: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Append-mode parquet table."""
    return (stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/table")
            .option("checkpointLocation", f"{folder}/progress").trigger(**(trigger or {"availableNow": True})).start())


# --- S1 -----------------------------------------------------------------------------------------------
def first_results(log: DataFrame) -> DataFrame:
    """S1, first wins: one result per key within 24 hours of event time; state older than that is dropped."""
    return (log.withWatermark("ts", f"{K.RESUME_SECONDS} seconds").dropDuplicatesWithinWatermark(["site", "key"]))


def usable(log: DataFrame) -> DataFrame:
    """Results that a later scan may take over: success or gone."""
    return log.where((F.col("fetch_code") == K.FETCH_OK) | F.col("fetch_code").isin(*K.GONE_CODES))


def resume_store(log: DataFrame, folder: str, **options) -> KeyedStore:
    """S1, last wins: the newest row per key by ``seq``; merges drop what is older than a result may be.  ``resume_store_latest`` over
    ``read`` is the store at a given time.  ``seq`` follows ``ts`` within a key."""
    return KeyedStore(folder, log.schema, ["site", "key"], "seq", retain=("ts", K.RESUME_SECONDS), **options)


def start_resume_store(log: DataFrame, folder: str, **trigger) -> StreamingQuery:
    return resume_store(log, folder).start(usable(log), **trigger)


# --- S2 -----------------------------------------------------------------------------------------------
def reject_alerts(fetches: DataFrame, scan_window: str = "1 day") -> DataFrame:
    """Sites that turned calm in a scan: three refusals or five redirects to the home page."""
    refused = F.col("fetch_code") == "http_429"  # a plain 403 is a page's own answer, not a refusal of the scan
    if "challenge" in fetches.columns:
        refused = refused | F.coalesce("challenge", F.lit(False))
    home = F.col("fetch_code") == K.FETCH_DELETED_HOME
    counts = fetches.groupBy("site", F.window("ts", scan_window).alias("w")).agg(
        F.count_if(refused).alias("rejects"), F.count_if(home).alias("home_redirects"),
        F.min(F.when(refused | home, F.col("ts"))).alias("first_sign"))
    return counts.where("rejects >= 3 OR home_redirects >= 5").select(
        "site", F.col("w.start").alias("window_start"), "rejects", "home_redirects", "first_sign")


# --- S3 -----------------------------------------------------------------------------------------------
def health_counts(fetches: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """S3: successes and failures by reason over tumbling or sliding windows."""
    c = F.col("fetch_code")
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return fetches.groupBy(w.alias("w"), "site").agg(
        F.count("*").alias("fetches"), F.count_if(c == K.FETCH_OK).alias("ok"), F.count_if(c.isin(*K.GONE_CODES)).alias("gone"),
        F.count_if(c == "http_429").alias("rate_limited"), F.count_if(c.rlike("^http_5")).alias("server_error"),
        F.count_if(c == K.FETCH_CONN_FAILED).alias("connection")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "site", "fetches", "ok", "gone",
        "rate_limited", "server_error", "connection")


def late_tolerant(fetches: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return fetches.withWatermark("ts", delay)


# --- S4, S5 -------------------------------------------------------------------------------------------
def audit_stream(pages: DataFrame) -> DataFrame:
    """Facts and title grade of arriving pages, stateless."""
    return page_facts(pages)


PAGE_TABLES = {"pages": X.page_audit, "images": X.page_images, "links": X.page_link_rows}


def start_page_audit(pages: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Full extraction and grades of arriving pages (``site``, ``page_id``, ``url``, ``html``): tables ``pages`` (D1), ``images`` (D2) and
    ``links`` (D3), read with ``audited``.

    The HTML of a batch is read once, into scratch files of which two batches' worth are kept; the three tables come from those.  The
    row in ``batches`` is written last, so the tables of a batch appear together, and a batch that was replayed appears once.
    """
    spark = pages.sparkSession

    def done(number: int) -> None:
        spark.createDataFrame([(number,)], "done long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/batches/batch={number}")

    def write(batch: DataFrame, number: int) -> None:
        if not spark.read.parquet(f"{folder}/batches").where(F.col("done") == number).isEmpty():
            return
        scratch = f"{folder}/facts/slot={number % 2}"
        X.read_pages_html(batch).write.mode("overwrite").parquet(scratch)
        facts = spark.read.parquet(scratch)
        for name, build in PAGE_TABLES.items():
            build(facts).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        done(number)

    done(-1)  # no batch yet
    return (pages.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress")
            .trigger(**(trigger or {"availableNow": True})).start())


def audited(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of ``start_page_audit``, with ``batch``: the rows of finished batches."""
    finished = spark.read.parquet(f"{folder}/batches").select(F.col("done").alias("batch"))
    return spark.read.parquet(f"{folder}/{name}").withColumn("batch", F.col("batch").cast("long")).join(finished, "batch", "left_semi")


def start_versions(stream: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Update-mode table: every batch writes the rows that changed under its own number, so a replayed batch replaces itself and
    windows that are still open are in the table as well."""
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/table/batch={number}")
    return (stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/progress")
            .trigger(**(trigger or {"availableNow": True})).start())


def newest_versions(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The newest row per key of a ``start_versions`` table: versions are decided on keys, then the rows are read."""
    rows = spark.read.parquet(f"{folder}/table").drop("batch")
    newest = rows.groupBy(*keys).agg(F.max("version").alias("version"))
    return rows.join(newest, [*keys, "version"], "left_semi").drop("version")


def link_counts(pages: DataFrame) -> DataFrame:
    """Running number of linking pages per target."""
    return page_links(pages).groupBy("site", "dst_key").agg(F.count("*").alias("n_pages"))


def link_count_store(counts: DataFrame, folder: str, **options) -> KeyedStore:
    """The newest count per target; start it in update mode, so a batch writes the targets that changed."""
    return KeyedStore(folder, counts.schema, ["site", "dst_key"], **options)


def read_after(query: StreamingQuery, spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """Wait for an ``availableNow`` run and read its table."""
    query.awaitTermination()
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/table")
