"""A keyed table that a stream keeps up to date: a base, a few deltas, and a small state table as the commit point.

Batch ``n`` writes its newest row per key as a delta.  Every ``every`` batches the base and its deltas are merged into the next base, so
a read costs the base and fewer than ``every`` deltas, however many batches have run.  The state row of a batch is written last: what
the newest state row does not name is not read, and a batch that is replayed after its state row was written changes nothing.

Folders are a ring of ``keep`` generations and are written over in turn, so their number is bounded and nothing has to be removed.  A
reader's files stay as they are for at least ``(keep - 1) * every`` further batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

VERSION = "version"
STATE = "batch bigint"


class KeyedStore:
    """The newest row per key of a stream, in one folder together with the stream's progress.

    ``newest`` names the column whose largest value wins (rows of a later batch win ties); without it the later batch wins, and of
    equal keys in one batch any row may stay.  ``retain`` is ``(column, seconds)``: a merge drops rows whose time is that much before the newest time
    in the store; rows without a time stay.  Null keys are keys like others.  Batch numbers are those of the stream's checkpoint.
    """

    def __init__(self, folder: str, schema: StructType, keys: list[str], newest: str | None = None, every: int = 8,
                 retain: tuple[str, int] | None = None, keep: int = 3):
        if every < 1 or keep < 2:
            raise ValueError("at least one batch per merge and two generations")
        if VERSION in schema.names:
            raise ValueError(f"the column {VERSION!r} belongs to the store")
        self.folder, self.schema, self.keys, self.newest = folder, schema, keys, newest
        self.every, self.retain, self.keep = every, retain, keep
        self.stored = StructType(list(schema.fields)).add(VERSION, "long")

    # --- folders --------------------------------------------------------------------------------------
    def delta(self, batch: int) -> str:
        return f"{self.folder}/delta/generation={batch // self.every % self.keep}/slot={batch % self.every}"

    def base(self, generation: int) -> str:
        return f"{self.folder}/base/generation={generation % self.keep}"

    def state(self, batch: int) -> str:
        return f"{self.folder}/state/slot={batch % (2 * self.every)}"

    # --- reading --------------------------------------------------------------------------------------
    def done(self, spark: SparkSession) -> int:
        """The last committed batch; -1 before the first.  A state row that is being written over while this reads is not the newest."""
        rows = spark.read.schema(STATE).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").parquet(f"{self.folder}/state")
        return rows.agg(F.max("batch")).first()[0]

    def parts(self, batch: int) -> list[str]:
        """The folders that hold the store as it is after ``batch``."""
        generation = (batch + 1) // self.every
        base = [self.base(generation)] if generation else []
        return base + [self.delta(n) for n in range(generation * self.every, batch + 1)]

    def _rows(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], self.stored)
        return spark.read.schema(self.stored).parquet(*folders)

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row per key, by an aggregate; a null in ``newest`` loses against any value."""
        rank = F.struct(*([self.newest] if self.newest else []), VERSION)
        rest = [c for c in rows.columns if c not in self.keys]
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
        return best.select(*self.keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*rows.columns)

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest row per key after the last committed batch."""
        folders = self.parts(self.done(spark))
        rows = self._rows(spark, folders)
        return (rows if len(folders) == 1 else self._newest(rows)).drop(VERSION)

    # --- writing --------------------------------------------------------------------------------------
    def write(self, batch: DataFrame, number: int) -> None:
        """One batch of the stream: delta, merge where one is due, state row.  A committed batch is not written again."""
        spark = batch.sparkSession
        if number <= self.done(spark):
            return
        rows = self._newest(batch.select(*self.schema.names).withColumn(VERSION, F.lit(number).cast("bigint")))
        rows.write.mode("overwrite").parquet(self.delta(number))
        if (number + 1) % self.every == 0:
            self._merge(spark, number)
        self._commit(spark, number)

    def _merge(self, spark: SparkSession, number: int) -> None:
        rows = self._rows(spark, self.parts(number - 1) + [self.delta(number)])
        if self.retain:
            column, seconds = self.retain
            time = F.unix_micros(F.col(column).cast("timestamp"))
            last = rows.agg(F.max(time)).first()[0]
            if last is not None:
                rows = rows.where(time.isNull() | (time >= last - int(seconds * 1_000_000)))
        self._newest(rows).write.mode("overwrite").parquet(self.base((number + 1) // self.every))

    def _commit(self, spark: SparkSession, number: int) -> None:
        row = spark.createDataFrame([(number,)], STATE)
        row.coalesce(1).write.mode("overwrite").parquet(self.state(number))

    # --- streams --------------------------------------------------------------------------------------
    def start(self, stream: DataFrame, mode: str = "append", **trigger) -> StreamingQuery:
        """Run ``stream`` into the store; a restart goes on from its progress."""
        self._open(stream.sparkSession)
        return (stream.writeStream.outputMode(mode).foreachBatch(self.write).option("checkpointLocation", f"{self.folder}/progress")
                .trigger(**(trigger or {"availableNow": True})).start())

    def _open(self, spark: SparkSession) -> None:
        """A state row for 'no batch yet', which later batches do not overwrite."""
        spark.createDataFrame([(-1,)], STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/state/slot=start")
