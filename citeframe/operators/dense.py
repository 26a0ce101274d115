"""Cosine top-k over dense vectors: all of a pool compared, or exact pruning by pivots.

Angles between vectors are a metric. Each vector is filed under the nearest of its pool's pivots, with its angle
to it; a query's angle to a pivot then bounds its angle to all vectors filed there, and to each single one. Vectors of a cell and
the queries that read it meet in blocks, which tasks multiply as matrices; only pairs that can be among the k best leave them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, part_of, store
from .joins import lookup_join
from .ranking import best_first, top_k

# Pivots of a pool
PIVOTS = 16
# What bounds are widened by, for angles carry rounding errors up to 3e-8
SLACK = 1e-6
# Where vectors without an angle to any pivot are filed
ODD = -1
# Vectors and queries of a block at most, about
TILE, ASKED = 4096, 2048
# How much scores may differ by the order of addition, and a place of nine decimals
CLOSE = 2e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, p: s + p
    )


def label_centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): the mean vector per label, summed vector by vector with map-side combine."""
    mean = Summarizer.mean(array_to_vector(vector))
    return vectors.groupBy(label).agg(mean.alias("_m")).select(label, vector_to_array("_m").alias("centroid"))


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, query_key: str) -> DataFrame:
    """The k vectors nearest each query, exact.

    ``vectors`` is (row_idx, v, pool), ``queries`` (query_key, q, pool): a query is ranked against
    the vectors of its pool, as ranking is against a candidate set. Each partition keeps k per
    query before anything is shuffled. A zero vector scores 0.
    """
    pairs = lookup_join(
        vectors.withColumn("_nv", _norm(F.col("v"))), queries.withColumn("_nq", _norm(F.col("q"))),
        ["pool"], ["row_idx"],
    )
    return top_k(pairs.select(query_key, "row_idx", _score().alias("score")), [query_key], best_first(), k)


def _norm(c: Column) -> Column:
    return F.sqrt(dot(c, c))


def _cosine(a: Column, norm_a: Column, b: Column, norm_b: Column) -> Column:
    return F.try_divide(dot(a, b), norm_a * norm_b)


def _score() -> Column:
    return F.coalesce(_cosine(F.col("q"), F.col("_nq"), F.col("v"), F.col("_nv")), F.lit(0.0))


def _sound(norm: Column) -> Column:
    """Whether products of norms neither overflow nor vanish."""
    return norm.between(1e-100, 1e100)


def _angle(a: Column, norm_a: Column, b: Column, norm_b: Column) -> Column:
    """NULL where there is none: such vectors are never pruned."""
    cosine = F.least(F.greatest(_cosine(a, norm_a, b, norm_b), F.lit(-1.0)), F.lit(1.0))
    return F.when(_sound(norm_a) & _sound(norm_b) & dot(a, b).isNotNull(), F.acos(cosine))


@dataclass
class PivotIndex:
    """Vectors filed under pivots: ``filed`` (pool, cell, angle, row_idx, v, _nv) and, for each cell, ``cells``
    (pool, cell, p, _np, n, low, high): its pivot, size, and smallest and largest angle."""

    filed: DataFrame
    cells: DataFrame


def pivot_index(vectors: DataFrame, pivots: int = PIVOTS) -> PivotIndex:
    """Index of (row_idx, v, pool), for any number of query sets. Pivots are the vectors with the smallest hashes
    of their row numbers. A vector without an angle to any pivot (zero, NULL, of another length, with an element that is
    no number) is filed as odd, and always read."""
    normed = vectors.select("row_idx", "v", "pool", _norm(F.col("v")).alias("_nv"))
    sound = normed.where(_sound(F.col("_nv")))
    chosen = top_k(sound, ["pool"], [F.xxhash64("row_idx"), F.col("row_idx")], pivots)
    # at most ``pivots`` vectors a pool
    lists = cut(chosen.groupBy("pool").agg(F.collect_list(F.struct("rn", F.col("v").alias("p"), F.col("_nv").alias("np"))).alias("_pivots")))
    angles = F.transform(
        "_pivots", lambda x: F.struct(_angle(F.col("v"), F.col("_nv"), x["p"], x["np"]).alias("angle"), x["rn"].alias("cell"))
    )
    nearest = F.array_min(F.filter(angles, lambda x: x["angle"].isNotNull()))
    filed = store(
        lookup_join(normed, lists, ["pool"], ["row_idx"], "left").withColumn("_near", nearest).select(
            "pool", F.coalesce("_near.cell", F.lit(ODD)).alias("cell"), "_near.angle", "row_idx", "v", "_nv"
        ),
        "filed",
    )
    sizes = filed.groupBy("pool", "cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    own = lists.select("pool", F.explode("_pivots").alias("_p")).select("pool", F.col("_p.rn").alias("cell"), "_p.p", F.col("_p.np").alias("_np"))
    return PivotIndex(filed, cut(sizes.join(own, ["pool", "cell"], "left")))


def _reached(filed: DataFrame, asked: DataFrame) -> DataFrame:
    """Vectors of the asked cells, leaving out those whose own bound is under ``floor``."""
    met = lookup_join(filed, asked, ["pool", "cell"], ["row_idx"])
    reachable = F.cos(F.abs(F.col("_aq") - F.col("angle"))) >= F.col("floor") - SLACK
    return met.where(F.coalesce(reachable, F.lit(True)))


def _block_best(query_key: str, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """(query, row_idx, score) of at least the k best vectors of a block for each of its queries, by ``best_first``."""

    def best(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if vectors.empty or queries.empty:
            return pd.DataFrame({query_key: [], "row_idx": [], "score": []})
        vectors = vectors.sort_values("row_idx", kind="stable", na_position="first")
        v = np.stack(vectors["v"].to_list()).astype(np.float64)
        # equal vectors have equal scores, so the first k of them are enough
        copy = pd.Series([r.tobytes() for r in v])
        kept = (copy.groupby(copy).cumcount() < k).to_numpy()
        vectors, v = vectors[kept], v[kept]
        norm = vectors["_nv"].to_numpy(np.float64)
        q, norm_q = np.stack(queries["q"].to_list()).astype(np.float64), queries["_nq"].to_numpy(np.float64)
        scores = (q / norm_q[:, None]) @ (v / norm[:, None]).T
        least = np.nan_to_num(queries["floor"].to_numpy(np.float64), nan=-np.inf) - CLOSE
        close = scores >= least[:, None]
        if len(norm) > k and np.count_nonzero(close) > 4 * k * len(q):
            kth = np.partition(scores, len(norm) - k, axis=1)[:, len(norm) - k]
            close &= scores >= (kth - CLOSE)[:, None]
        at, of = np.nonzero(close)
        # of these the score itself, added in the order of the elements as ``dot`` does
        total = np.zeros(len(at))
        for d in range(v.shape[1]):
            total += q[at, d] * v[of, d]
        return pd.DataFrame({
            query_key: queries[query_key].to_numpy()[at], "row_idx": vectors["row_idx"].to_numpy()[of],
            "score": total / (norm_q[at] * norm[of]),
        })

    return best


def _scored(filed: DataFrame, asked: DataFrame, query_key: str, k: int, tile: int = TILE, batch: int = ASKED) -> DataFrame:
    """(query, row_idx, score) of at least the k best vectors of the asked cells; with ``floor``, of those that reach it.

    Blocks are (pool, cell, tile, batch), so neither a large cell nor a cell that all read is held by one task. Pairs without an
    angle, which a matrix may have no row for, are scored one by one.
    """
    told = F.col("pool").isNotNull() & (F.col("cell") != ODD)
    direct = asked.where(told & F.col("_aq").isNotNull())
    parts = cut(direct.groupBy("pool", "cell").agg(
        F.ceil(F.max("n") / tile).cast("int").alias("_tiles"), F.ceil(F.count("*") / batch).cast("int").alias("_batches")
    ))
    number = lambda of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = lookup_join(filed.select("pool", "cell", "row_idx", "v", "_nv"), parts, ["pool", "cell"], ["row_idx"])
    left = left.withColumn("_tile", number("row_idx", "_tiles")).withColumn("_batch", each("_batches")).drop("_tiles", "_batches")
    right = lookup_join(direct.select("pool", "cell", query_key, "q", "_nq", "floor"), parts, ["pool", "cell"], [query_key])
    right = right.withColumn("_batch", number(query_key, "_batches")).withColumn("_tile", each("_tiles")).drop("_tiles", "_batches")
    kinds = {**dict(filed.dtypes), **dict(asked.dtypes)}
    schema = f"`{query_key}` {kinds[query_key]}, row_idx {kinds['row_idx']}, score double"
    block = ("pool", "cell", "_tile", "_batch")
    by_block = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInPandas(_block_best(query_key, k), schema)
    odd = part_of(asked.where(F.col("_aq").isNull() | (F.col("cell") == ODD)), asked)
    one_by_one = _reached(filed, odd).select(query_key, "row_idx", _score().alias("score"))
    return by_block.unionByName(one_by_one)


def pruned_top_k(index: PivotIndex, queries: DataFrame, k: int, query_key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``dense_top_k``, and (query_key, pool, n_pool, n_scored): how many vectors its bounds
    leave it, counted when asked for.

    A query first reads its nearest cells until they hold k vectors, and the odd ones. Its k-th score there is a floor:
    other cells are read only where the best score that their angles allow reaches it, ties included, and of these
    only vectors whose own angle allows it. Queries without an angle to a pivot read all its vectors. A query is a row of
    ``queries`` (query_key, q, pool); the key is distinct. A pool without vectors has no rows.
    """
    normed = cut(queries.select(query_key, "q", "pool", _norm(F.col("q")).alias("_nq")))
    met = lookup_join(normed, index.cells, ["pool"], [query_key])
    # at most one row per pivot of a pool for each query
    near = Window.partitionBy(query_key).orderBy(F.col("_aq").asc_nulls_first(), "cell")
    faced = met.withColumn("_aq", _angle(F.col("q"), F.col("_nq"), F.col("p"), F.col("_np")))
    apart = F.greatest(F.col("_aq") - F.col("high"), F.col("low") - F.col("_aq"), F.lit(0.0))
    placed = cut(
        faced.withColumns({
            "_sure": F.coalesce(F.sum(F.when(F.col("_aq").isNotNull(), F.col("n"))).over(
                near.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "best": F.when(F.col("_aq").isNotNull() & F.col("high").isNotNull(), F.cos(F.least(apart, F.lit(math.pi)))),
        }).select(query_key, "pool", "cell", "q", "_nq", "_aq", "n", "best", (F.col("best").isNull() | (F.col("_sure") < k)).alias("first"))
    )
    no_floor = F.lit(None).cast("double")
    begun = cut(top_k(_scored(index.filed, _part(placed.where("first").withColumn("floor", no_floor)), query_key, k), [query_key], best_first(), k))
    # a query with fewer than k vectors so far has read its pool, for the first cells are read until there are k
    floors = cut(begun.where(F.col("rn") == k).select(query_key, F.col("score").alias("floor")))
    left = lookup_join(placed.where("not first"), floors, [query_key], ["cell"])
    asked = _part(left.where(F.col("best") >= F.col("floor") - SLACK))
    later = _scored(index.filed, asked, query_key, k)
    best = top_k(begun.drop("rn").unionByName(later), [query_key], best_first(), k)
    counts = placed.groupBy(query_key, "pool").agg(
        F.sum("n").alias("n_pool"), F.sum(F.when(F.col("first"), F.col("n")).otherwise(0)).alias("_first")
    )
    more = _reached(index.filed, asked.drop("n")).groupBy(query_key).agg(F.count("*").alias("_later"))
    work = counts.join(more, query_key, "left").select(
        query_key, "pool", "n_pool", (F.col("_first") + F.coalesce("_later", F.lit(0))).alias("n_scored")
    )
    return best, work


def _part(asked: DataFrame) -> DataFrame:
    return cut(asked.drop("first", "best"))
