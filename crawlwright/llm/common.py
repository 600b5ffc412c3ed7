"""Shared helpers: scratch tables in the session's checkpoint folder, plain typed inputs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlwright.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once as Parquet in the shared folder and go on from the files, whatever executors are lost later."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: Column | str) -> Column:
    """The bytes of a text for Python tasks; a null text has none.  Bytes also carry strings that are not valid UTF-8."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z and nothing else.  ``lower`` may do it where every character is ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut (without a copy) where the texts of a binary column reach ``most`` bytes: what a task turns into Python
    objects at a time is then bounded by that, or by one text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
        parts = np.cumsum(sizes.astype(np.int64) + 64) // most
        edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def blocks_for(df: DataFrame, size: Column, block_bytes: int) -> int:
    """How many blocks of about ``block_bytes`` the rows need."""
    total = df.agg(F.sum(size).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // block_bytes))


def one_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen`` (doc_id and other columns, few rows) with one text per doc_id: the one with the least hash, as bytes.

    Texts of a doc_id that repeats are compared by hash before anything is moved, so a task sends one row per doc_id at most.
    """
    text = utf8("text")
    found = docs.select("doc_id", F.xxhash64(text).alias("name"), text.alias("text")).join(F.broadcast(chosen.select("doc_id")), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", "name").alias("text")).join(F.broadcast(chosen), "doc_id")
