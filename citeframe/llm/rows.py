"""Dropping rows of a table of documents by decisions made on a slim copy of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store

KEYS = ("_row_id", "_row_hash")


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Adds the columns by which a decision finds its row again: id and a hash of the text."""
    return docs.withColumns({"_row_id": F.col(doc_id), "_row_hash": F.xxhash64(F.col(text).isNull(), F.col(text))})


def one_of_each(
    docs: DataFrame, doc_id: str, text: str, decided: DataFrame, group: str, order: Sequence[str],
    gone: DataFrame | None = None,
) -> DataFrame:
    """The row of ``docs`` that comes first by ``order`` in each group.

    ``decided`` has ``KEYS``, ``group`` and ``order`` for each row. Only groups of several rows are
    looked at; their losers leave by an anti-join, and so do the rows ``gone`` (``KEYS``), which
    ``decided`` has not. Rows that agree in id and text are one document: one of them stays.
    """
    variants = decided.groupBy(group, *KEYS, *[o for o in order if o not in KEYS]).agg(F.count("*").alias("_n"))
    rank = F.struct(*[x for o in order for x in (F.col(o).isNull().alias(f"{o}_none"), F.col(o))], F.col("_row_hash"))
    variants = store(variants.withColumn("_rank", rank), "variants")
    first = variants.groupBy(group).agg(F.min("_rank").alias("_first"), F.count("*").alias("_variants")).where("_variants > 1")
    losers = variants.join(first, group).where("_rank > _first").select(*KEYS)
    losers = losers if gone is None else losers.unionByName(gone.select(*KEYS))
    losers = losers.select(*[F.col(k).alias(f"{k}_l") for k in KEYS])
    same = F.col("_row_id").eqNullSafe(F.col("_row_id_l")) & (F.col("_row_hash") == F.col("_row_hash_l"))
    # the document travels as one column, so that no name of its own can clash
    whole = keyed(docs.select(F.struct("*").alias("_doc"), F.col(doc_id).alias("_a"), F.col(text).alias("_b")), "_a", "_b")
    kept = whole.select("_doc", *KEYS).join(losers, same, "left_anti")
    repeated = variants.where("_n > 1").join(first, group, "left").where("_first is null or _rank = _first")
    if not repeated.isEmpty():
        marks = repeated.select(*[F.col(k).alias(f"{k}_l") for k in KEYS])
        several = kept.join(marks, same, "left_semi").dropDuplicates(list(KEYS))
        kept = kept.join(marks, same, "left_anti").unionByName(several)
    return kept.select("_doc.*")
