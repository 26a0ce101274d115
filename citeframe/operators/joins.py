"""Equi-joins of a large relation with one whose size has to be found out first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, cut, fits_broadcast, shuffle_partitions

# A key with more rows than this is dealt out over several partitions.
HOT_ROWS = 1_000_000
# Askers told in one row
ASKERS = 1024
# Rows a task makes of shared ones, and tasks at most
ANSWERS, MOST_TASKS = 4_000_000, 20_000


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    where: Column | None = None,
    limit: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``big`` with ``small`` (already cut) on ``keys``.

    ``small`` is replicated when its measured payload is under ``limit``. Otherwise both sides are
    shuffled on the keys. Keys with more than ``hot_rows`` rows in ``big`` are split by a salt, one
    part per ``hot_rows``, and only their rows of ``small`` are repeated.
    """
    if where is not None and how != "inner":
        raise ValueError("a residual predicate is only supported for inner joins")
    if fits_broadcast(small, limit):
        joined = big.join(F.broadcast(small), list(keys), how)
    else:
        # at most rows / hot_rows keys
        hot = cut(
            big.groupBy(*keys).agg(F.ceil(F.count("*") / hot_rows).cast("int").alias("_parts")).where("_parts > 1")
        )
        parts = F.coalesce("_parts", F.lit(1))
        salted = big.join(F.broadcast(hot), list(keys), "left").withColumn(
            "_salt", F.pmod(F.xxhash64(*spread), parts).cast("int")
        )
        copies = small.join(F.broadcast(hot), list(keys), "left").withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), parts - 1))
        )
        joined = salted.drop("_parts").join(copies.drop("_parts"), [*keys, "_salt"], how).drop("_salt")
    return joined if where is None else joined.where(where)


def for_each_asker(
    shared: DataFrame,
    askers: DataFrame,
    key: str,
    asker: str,
    spread: Sequence[str],
    limit: int = BROADCAST_BYTES,
    answers: int = ANSWERS,
) -> DataFrame:
    """Each row of ``shared`` (stored) once for every row of ``askers`` (key, asker) with its key; the key goes.

    What comes of it may be far larger than both sides, so it is formed last and never shuffled: askers are put in lists,
    replicated when they measure less than ``limit``, and shared rows are dealt out by ``spread`` before they are repeated.
    """
    asked = cut(askers.select(key, asker))
    n = cut(asked.groupBy(key).agg(F.count("*").alias("_n")))
    dealt = lookup_join(asked, n, [key], [asker]).withColumn("_list", F.monotonically_increasing_id() % F.ceil(F.col("_n") / ASKERS))
    # a list leaves out nulls unless they are wrapped
    lists = cut(
        dealt.groupBy(key, "_list").agg(F.collect_list(F.struct(asker)).alias("_a"))
        .select(key, F.transform("_a", lambda a: a[asker]).alias("_a"))
    )
    sizes = cut(lookup_join(shared.groupBy(key).agg(F.count("*").alias("_m")), n, [key], [key]))
    made = F.col("_m") * F.col("_n")
    total = sizes.agg(F.coalesce(F.sum(made), F.lit(0))).first()[0]
    # The number is spelled out, as adaptive execution would merge partitions by the size of the shared rows.
    tasks = min(max(shuffle_partitions(shared), -(-total // answers)), MOST_TASKS)
    if fits_broadcast(lists, limit):
        met = shared.repartition(tasks, key, *spread).join(F.broadcast(lists), key)
    else:
        parts = cut(sizes.select(key, F.ceil(made / answers).cast("int").alias("_parts")))
        salted = lookup_join(shared, parts, [key], spread).withColumn("_salt", F.pmod(F.xxhash64(*spread), "_parts").cast("int"))
        copies = lookup_join(lists, parts, [key], ["_a"]).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        by = (tasks, key, "_salt")
        met = salted.drop("_parts").repartition(*by).join(copies.drop("_parts").repartition(*by), [key, "_salt"])
    return met.select(*[c for c in shared.columns if c != key], F.explode("_a").alias(asker))
