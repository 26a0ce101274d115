"""Pruned dense ranking against the plain one, on clustered, tied and odd vectors."""

from __future__ import annotations

import numpy as np

from pyspark.sql import functions as F

from citeframe.operators import dense
from citeframe.operators.ranking import best_first, top_k
from citeframe.session import cut

SCHEMA = "row_idx long, v array<double>, pool string"


def _rows():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    spread = (centres[rng.integers(0, 12, 600)] + 0.05 * rng.normal(size=(600, 8))).tolist()
    spread[7] = spread[8] = spread[9]  # ties
    odd = [
        None, [], [0.0] * 8, [1.0, 2.0], [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1e-170] * 8, [None] + [1.0] * 7,
    ]
    rows = [(i, v, "hot") for i, v in enumerate(spread + odd)]
    rows += [(1000 + i, v, "small") for i, v in enumerate(spread[:3])] + [(2000, [0.0] * 8, "zero"), (3000, spread[0], None)]
    asked = [(f"{p}{i}", v, p) for p in ("hot", "small", "zero", "empty") for i, v in enumerate(spread[:6] + odd)]
    return rows, asked


def _plain(df):
    return sorted((r["query_id"], r["rn"], r["row_idx"], str(round(r["score"], 9))) for r in df.collect())


def test_pruned_rows_are_the_plain_ones_and_most_vectors_are_not_scored(spark):
    rows, asked = _rows()
    vectors = spark.createDataFrame(rows, SCHEMA)
    queries = spark.createDataFrame(asked, "query_id string, q array<double>, pool string")
    index = dense.pivot_index(vectors, 24)
    assert index.cells.agg({"n": "sum"}).first()[0] == len(rows)
    best, work = dense.pruned_top_k(index, queries, 5, "query_id")
    assert _plain(best) == _plain(dense.dense_top_k(vectors, queries, 5, "query_id"))
    done = {r["query_id"]: (r["n_pool"], r["n_scored"]) for r in work.collect()}
    assert all(done[f"hot{i}"][1] < 0.5 * done[f"hot{i}"][0] for i in range(6))
    assert done["hot6"] == (608, 608)  # a query that is NULL can rule nothing out


def test_no_vectors_and_no_queries(spark):
    rows, asked = _rows()
    vectors = spark.createDataFrame(rows, SCHEMA)
    queries = spark.createDataFrame(asked, "query_id string, q array<double>, pool string")
    empty = dense.pivot_index(vectors.limit(0))
    assert dense.pruned_top_k(empty, queries, 5, "query_id")[0].count() == 0
    assert dense.pruned_top_k(dense.pivot_index(vectors), queries.limit(0), 5, "query_id")[0].count() == 0


def test_blocks_of_any_size_give_the_plain_rows_and_no_row_for_each_pair(spark):
    rows, asked = _rows()
    rows += [(5000 + i, rows[7][1], "hot") for i in range(300)]  # copies of one vector
    vectors = spark.createDataFrame(rows, SCHEMA)
    queries = spark.createDataFrame(asked, "query_id string, q array<double>, pool string")
    index = dense.pivot_index(vectors, 6)
    cells = index.cells.where("pool = 'hot' and p is not null").select("pool", "cell", "n", "p", "_np")
    met = queries.withColumn("_nq", dense._norm(F.col("q"))).join(cells, "pool").withColumn("floor", F.lit(None).cast("double"))
    met = met.withColumn("_aq", dense._angle(F.col("q"), F.col("_nq"), F.col("p"), F.col("_np"))).drop("p", "_np").where("_aq is not null")
    found = dense._scored(index.filed, cut(met), "query_id", 5, tile=50, batch=4)
    sound = vectors.where("pool = 'hot'").join(index.filed.where("cell >= 0").select("row_idx"), "row_idx", "left_semi")
    want = dense.dense_top_k(sound, met.select("query_id", "q", "pool").distinct(), 5, "query_id")
    assert _plain(top_k(found, ["query_id"], best_first(), 5)) == _plain(want)
    assert found.count() < sound.count() * met.select("query_id").distinct().count() / 2
    best, _ = dense.pruned_top_k(index, queries, 5, "query_id")
    assert _plain(best) == _plain(dense.dense_top_k(vectors, queries, 5, "query_id"))
