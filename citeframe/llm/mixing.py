"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies wanted of each of its documents; the fraction
beyond whole copies is a probability. Documents are rounded in leaves of bounded size: two fractional ones
meet, words move from one to the other at random until one of them is whole, and the other goes on. The
words taken don't change, and each document's expected copies stay what they were. Each leaf leaves one
fractional document at most; these meet in further rounds, a reduction tree, until one is left in a source,
which is rounded at random. So a source misses its target by less than one document.

Draws depend on document ids and leaf numbers only, so that reruns agree, however tables are partitioned.

Defined results: null or empty texts have size 0 and take 0 words; null is a source of its own, the last;
repeated rows are separate documents; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..operators.ranking import distributed_rank
from ..session import cut, store
from .arrow_text import text_column

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
MOST = 2
# Documents of a leaf, and leaves that meet in a node of the tree.
LEAF = 4096
FAN = 256
SNAP = 1e-9
ROUNDED = "doc_id string, size long, source_size long, target double, base long, _src string, _none boolean, leaf long, odds double, up long"


def sizes(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    words = F.regexp_count(text_column(docs, text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(
        F.col(doc_id).alias("doc_id"), words.alias("size"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_src"), F.col(source).isNull().alias("_none"),
    )


def targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(_src, _none, n_docs, source_size, target): shares by weight, none above ``most`` times its size."""
    sources = sized.groupBy("_src", "_none").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    ranked = distributed_rank(sources, [], [F.col("_none"), F.col("_src")])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rn") - 1) % len(weights) + 1).cast("int"))
    ranked = cut(ranked.select("_src", "_none", "n_docs", "source_size", weight.alias("w")))
    wanted = float(share) * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    # each round caps the sources that the level found so far takes above their most, and reshares
    level, capped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("w") * level > most * F.col("source_size")
        free, taken, n = ranked.select(
            F.sum(F.when(~over, F.col("w"))), F.sum(F.when(over, most * F.col("source_size"))), F.count(F.when(over, 1))
        ).first()
        if n == capped or not free:
            break
        level, capped = (wanted - (taken or 0)) / free, n
    target = F.least(F.col("w") * F.lit(level), (most * F.col("source_size")).cast("double")) if level is not None else None
    if target is None:
        target = (most * F.col("source_size")).cast("double")
    return cut(ranked.select("_src", "_none", "n_docs", "source_size", target.cast("double").alias("target")))


def pivot(weights: np.ndarray, odds: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Rounds all but one of ``odds`` to 0 or 1, moving mass so that sum(weights * odds) stays."""
    out = odds.copy()
    held = -1
    for k in range(len(out)):
        if not 0 < out[k] < 1:
            continue
        if held < 0:
            held = k
            continue
        a, b = held, k
        up = min(weights[a] * (1 - out[a]), weights[b] * out[b])
        down = min(weights[a] * out[a], weights[b] * (1 - out[b]))
        move = up if draws[k] * (up + down) < down else -down
        out[a] += move / weights[a]
        out[b] -= move / weights[b]
        for x in (a, b):
            if out[x] < SNAP:
                out[x] = 0.0
            elif out[x] > 1 - SNAP:
                out[x] = 1.0
        held = a if 0 < out[a] < 1 else b if 0 < out[b] < 1 else -1
    return out


def _rounder(level: int, last: bool):
    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        # large ones first: the one that is left over tends to be small
        pdf = pdf.sort_values(["size", "_order", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        name = f"{pdf['_none'].iloc[0]}|{pdf['_src'].iloc[0]}|{pdf['leaf'].iloc[0]}|{level}"
        draws = np.random.default_rng(zlib.crc32(name.encode())).random(len(pdf) + 1)
        odds = pivot(pdf["size"].to_numpy(float), pdf["odds"].to_numpy(float), draws)
        if last:
            odds = np.where((odds > 0) & (odds < 1), (draws[-1] < odds).astype(float), odds)
        pdf["odds"] = odds
        pdf["up"] = pd.array([int(x) if x in (0.0, 1.0) else None for x in odds], dtype="Int64")
        return pdf.drop(columns="_order")

    return leaf


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        share=SHARE, most=MOST, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken (words, repeats counted)."""
    sized = store(sizes(docs, doc_id, text, source), "sizes")
    by_source = targets(sized, weights, share, most)
    rows = lookup_join(sized, by_source, ["_src", "_none"], ["doc_id", "size"])
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(copies + SNAP).cast("long")
    fraction = F.greatest(copies - base, F.lit(0.0))
    rows = rows.withColumns({"base": base, "odds": F.when((F.col("size") == 0) | (fraction < SNAP), 0.0).otherwise(fraction)})
    order = F.xxhash64("doc_id", F.lit("order"))
    leaves = F.ceil(F.col("n_docs") / leaf).cast("long")
    rows = rows.withColumn("leaf", F.pmod(F.xxhash64("doc_id", F.lit("leaf")), leaves)).drop("n_docs")
    # ids travel as text: pandas has no integers with nulls
    kind = dict(sized.dtypes)["doc_id"]
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    columns = [c.split()[0] for c in ROUNDED.split(", ")]
    whole = rows.where("odds = 0").withColumn("up", F.lit(0).cast("long")).select(*columns)
    open_ = rows.where("odds > 0").withColumn("_order", order)
    width = by_source.agg(F.max(F.ceil(F.col("n_docs") / leaf))).first()[0] or 1
    level = 0
    while True:
        last = width == 1
        grouped = open_.groupBy("_none", "_src", "leaf").applyInPandas(_rounder(level, last), ROUNDED)
        done = store(grouped, "rounded")
        whole = whole.unionByName(done.where("up is not null").select(*columns))
        if last:
            break
        # the fractional document of each leaf goes up to one of fewer nodes
        width, level = -(-width // fan), level + 1
        up = F.floor(F.col("leaf") / fan).cast("long")
        open_ = done.where("up is null").drop("up").withColumns({"leaf": up, "_order": order})
    return whole.select(
        F.col("doc_id").cast(kind).alias("doc_id"), F.when(F.col("_none"), None).otherwise(F.col("_src")).alias("source"), "size", "source_size", "target",
        (F.col("size") * (F.col("base") + F.col("up"))).alias("taken"),
    )
