"""Ranking: top-k per group, and full ranks of groups too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SCORE_DIGITS = 9


def best_first() -> list[Column]:
    """Score descending, ties in catalogue order. Sums differ in the last bits with the order of
    addition, so scores are compared at nine decimals."""
    return [F.round("score", SCORE_DIGITS).desc(), F.col("row_idx").asc()]


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The literal bound lets Spark keep only k rows per group on the map side."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def distributed_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``row_number`` per group without gathering a group in one task.

    Rows are range-partitioned on (group, order), sorted within partitions and numbered by
    position; a group's rank is the position in its partition plus the group's rows in earlier
    partitions. The numbered rows are cut so that counts and rows come from one run.
    """
    keys = [F.col(g) for g in group]
    ranged = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    numbered = cut(ranged)
    # one row per (partition, group): at most groups + partitions rows
    runs = numbered.groupBy("_part", *group).agg(
        F.count("*").alias("_n"), F.min("_pos").alias("_first")
    )
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return (
        numbered.join(offsets, ["_part", *group])
        .withColumn("rn", F.col("_pos") - F.col("_first") + F.col("_before") + 1)
        .drop("_part", "_pos", "_first", "_before")
    )


def placed(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Adds ``place``, the row number in the group by ``order`` (distinct within it), and ``before``, the sum of ``value`` over
    the rows before, without gathering a group in one task: each range partition numbers and sums its own rows and
    is shifted by the partitions before it."""
    ranged = cut(df.repartitionByRange(group, order).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part", group).orderBy(order)
    # one row per (partition, group): at most groups + partitions rows
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part", group).agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    offsets = totals.select(
        "_part", group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_sum"),
    )
    numbered = ranged.withColumns({
        "_rn": F.row_number().over(own),
        "_own": F.coalesce(F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    return numbered.join(offsets, ["_part", group]).select(
        *df.columns, (F.col("_rows") + F.col("_rn")).alias("place"), (F.col("_sum") + F.col("_own")).alias("before")
    )


def running_sum(df: DataFrame, group: str, order: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the group up to and with this one, in ``order`` (distinct
    within a group), without gathering a group in one task: each range partition sums its own rows
    and is shifted by the sums before it."""
    ranged = df.repartitionByRange(group, order).withColumn("_part", F.spark_partition_id())
    placed = cut(ranged)
    own = Window.partitionBy("_part", group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row per (partition, group): at most groups + partitions rows
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part", group).agg(F.sum(value).alias("_own"))
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_own").over(earlier), F.lit(0))).drop("_own")
    return (
        placed.withColumn("_sum", F.sum(value).over(own)).join(offsets, ["_part", group])
        .withColumn(out, F.col("_sum") + F.col("_before")).drop("_part", "_sum", "_before")
    )
