"""Row numbers and first-row-per-key without sending a whole site to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 1 << 20


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row of every key by ``order``.

    An aggregate instead of a window: every task keeps one row per key before the shuffle, so a key that holds
    a third of the table costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def number_rows(df: DataFrame, group: list[str], order: list[Column], seq: str, name: str,
                ties: list[str] | None = None, width: int = BUCKET_ROWS) -> DataFrame:
    """``row_number`` over (group, order, seq) for groups of any size.

    ``order`` holds a few low-cardinality sort values (score, state rank ...), ``seq`` an integer row order.
    Rows fall into ordered buckets (order values, seq div width) of at most ``width`` sequence numbers.  A count
    per bucket gives each bucket its start, and the window runs inside one bucket only.
    """
    names = [f"_o{i}" for i in range(len(order))]
    work = df.withColumns({n: c for n, c in zip(names, order)} | {"_b": F.floor(F.col(seq) / F.lit(width))})
    bucket = [*group, *names, "_b"]
    # the bucket key may hold nulls (a missing score), so the join is null-safe through one struct key
    work = work.withColumn("_k", F.to_json(F.struct(*[F.col(c) for c in bucket]), {"ignoreNullFields": "false"}))
    starts = work.groupBy("_k", *bucket).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    w = w.orderBy(*[F.col(n).asc_nulls_last() for n in names], F.col("_b"))
    starts = starts.select("_k", (F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
                           .alias("_start"))
    inside = Window.partitionBy("_k").orderBy(F.col(seq), *[F.col(t) for t in (ties or [])])
    work = work.withColumn("_pos", F.row_number().over(inside)).join(starts, "_k")
    return work.withColumn(name, (F.col("_start") + F.col("_pos")).cast("bigint")).select(*df.columns, name)


def with_group_size(df: DataFrame, keys: list[str], name: str, where: Column | None = None,
                    spread: str = "seq", base: DataFrame | None = None) -> DataFrame:
    """Add the number of rows per key, counting only the rows that satisfy ``where``.

    Counts are pre-aggregated and only repeated keys (count > 1) are joined back, so the lookup is small.  Rows
    outside ``where`` (empty titles, say) get a private key part from ``spread``: they match nothing and do not
    pile up in one partition.  ``base`` is a narrower table with the same keys to count on, so that the wide
    branch of a long job is not computed twice.
    """
    inside = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    counts = ((df if base is None else base).where(inside).groupBy(*keys).agg(F.count("*").alias("_cnt"))
              .where("_cnt > 1").withColumn("_spread", F.lit(-1).cast("bigint")))
    work = df.withColumn("_spread", F.when(inside, F.lit(-1)).otherwise(F.col(spread)).cast("bigint"))
    return (work.join(counts, [*keys, "_spread"], "left")
            .withColumn(name, F.coalesce(F.col("_cnt"), F.lit(1)).cast("bigint"))
            .select(*df.columns, name))


def number_by_range(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``row_number`` over (group, order) for any sort key, strings included.

    Rows are range-partitioned by the sort key, sorted inside their partition and written once (so that a lost
    executor cannot move a range border), then every partition learns where its part of a group starts.
    """
    from crawlwright.session import cut

    by = [*[F.col(g) for g in group], *order]
    mask = F.lit((1 << 33) - 1)
    placed = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({
        "_pid": F.spark_partition_id(), "_pos": F.monotonically_increasing_id().bitwiseAND(mask)}))
    parts = placed.groupBy("_pid", *group).agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    w = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("_pid")
    parts = parts.select("_pid", *group, "_first", (F.sum("_n").over(
        w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_start"))
    return (placed.join(parts, ["_pid", *group])
            .withColumn(name, (F.col("_start") + F.col("_pos") - F.col("_first") + 1).cast("bigint"))
            .select(*df.columns, name))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key.  Spark keeps at most ``k`` rows per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k).withColumn(
        name, F.col(name).cast("bigint"))


def flag_keys(df: DataFrame, keys: list[str], flagged: DataFrame, name: str, where: Column, spread: str = "seq"
              ) -> DataFrame:
    """Boolean column: does the row satisfy ``where`` and is its key among ``flagged``?  Other rows carry a
    private key part, so they spread evenly and match nothing."""
    inside = F.coalesce(where, F.lit(False))
    marks = flagged.select(*keys).distinct().withColumns({"_spread": F.lit(-1).cast("bigint"), name: F.lit(True)})
    work = df.withColumn("_spread", F.when(inside, F.lit(-1)).otherwise(F.col(spread)).cast("bigint"))
    return work.join(marks, [*keys, "_spread"], "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(False))).select(*df.columns, name)
