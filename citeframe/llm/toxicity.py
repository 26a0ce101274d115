"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased (A-Z) and every run of other ASCII than letters and digits is one blank, so
decorated words keep their n-grams. An n-gram (4 to 6 bytes) counts once per document. From labelled
documents come its log-count ratio r = log((p/|p|) / (q/|q|)); the ``FEATURES`` n-grams that tell the
classes apart best are kept, and logistic regression learns weights over presence times r.

Defined results: a null or empty text, or one without any known n-gram, has the base score of the
intercept; documents with a null id are held out; a null label is no label; several labels of one id
count as their largest; without labels of both classes every score is the share of label 1 (0 without
any); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import store
from .arrow_text import WORD_FOLD, distinct, doc_hash, pieces, text_column

ORDERS = (4, 5, 6)
# n-grams are told apart by this many bits of a hash
HASH_BITS = 20
# bound of the sample of labelled documents that the classifier is fitted on
SAMPLE = 10_000
FEATURES = 4096
SMOOTHING = 1.0
PENALTY = 0.02
STEPS = 120


def grams(data: np.ndarray, ends: np.ndarray):
    """For each order the hashed n-grams at every byte of normalised texts, and the rows they lie in."""
    text = np.frombuffer(data.tobytes().translate(WORD_FOLD), np.uint8)
    blank = text == 32
    keep = np.ones(len(text), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    sizes = np.diff(np.concatenate(([0], np.cumsum(keep)))[ends])
    # a blank before and after each text
    rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 2)
    padded = np.full(len(rows), 32, np.uint32)
    starts = np.concatenate(([0], np.cumsum(sizes + 2)))[:-1]
    padded[np.arange(int(sizes.sum())) + np.repeat(starts + 1 - np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes)] = text[keep]
    mixed = padded * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    rolling = mixed.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(mixed) < n:
            return
        rolling = rolling[:-1] * np.uint32(0x01000193) + mixed[n - 1 :]
        if n in ORDERS:
            inside = rows[: len(rolling)] == rows[n - 1 :]
            spread = rolling ^ (rolling >> np.uint32(15))
            yield (spread * np.uint32(0x85EBCA6B)) >> np.uint32(32 - HASH_BITS), rows[: len(rolling)], inside


def present(data: np.ndarray, ends: np.ndarray, known: np.ndarray | None = None):
    """Distinct (row, n-gram) of each text; with ``known`` (number of each hash, 0 if none) only known ones."""
    found = []
    for hashed, rows, inside in grams(data, ends):
        if known is not None:
            number = known[hashed]
            at = np.flatnonzero((number > 0) & inside)
            found.append(rows[at].astype(np.int64) << 32 | (number[at] - 1).astype(np.int64))
        else:
            found.append(distinct(rows[inside].astype(np.int64) << 32 | hashed[inside].astype(np.int64)))
    pairs = distinct(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return (pairs >> 32).astype(np.int64), (pairs & 0xFFFFFFFF).astype(np.int64)


@dataclass
class Model:
    hashes: np.ndarray
    weights: np.ndarray
    intercept: float


def numbered(hashes: np.ndarray) -> np.ndarray:
    """For every hash its place among ``hashes`` from 1, or 0."""
    table = np.zeros(1 << HASH_BITS, np.uint16)
    table[hashes] = np.arange(1, len(hashes) + 1)
    return table


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logistic(rows: np.ndarray, columns: np.ndarray, scale: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on sparse presence times ``scale``, by accelerated gradient steps."""
    n, k = len(y), len(scale)
    values = scale[columns]
    base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    w, b = np.zeros(k), base
    # power steps bound the curvature, which sets the step length
    v = np.ones(k)
    for _ in range(12):
        v /= max(np.linalg.norm(v), 1e-12)
        u = np.bincount(rows, values * v[columns], minlength=n)
        v = np.bincount(columns, values * u[rows], minlength=k)
    step = 1 / (0.3 * np.linalg.norm(v) / n + PENALTY / n * 10 + 0.3)
    wm, bm, t = w.copy(), b, 1.0
    for _ in range(STEPS):
        error = _sigmoid(np.bincount(rows, values * wm[columns], minlength=n) + bm) - y
        w1 = wm - step * (np.bincount(columns, values * error[rows], minlength=k) / n + PENALTY / n * wm)
        b1 = bm - step * error.mean()
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wm, bm = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    return w, b


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
        held_out: Column | None = None, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled documents, those with the smallest hash of their id.

    n-gram counts are summed by Spark; the driver gets the ``FEATURES`` best n-grams and the sample's
    occurrences of these.
    """
    chosen = labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull())
    if held_out is not None:
        chosen = chosen.where(~held_out)
    chosen = chosen.groupBy(F.col(doc_id).alias("_label_id")).agg(F.max(F.col(toxic).cast("int")).alias("_y"))
    # at most `sample` rows: their bound is proven, so they are broadcast
    chosen = store(chosen.orderBy(F.xxhash64("_label_id"), "_label_id").limit(sample), "labels")
    texts = docs.select(F.col(doc_id).alias("_label_id"), text_column(docs, text).alias("_text"))
    texts = store(texts.join(F.broadcast(chosen), "_label_id").select("_label_id", "_text", "_y"), "labelled")
    sizes = {int(r["_y"]): r["n"] for r in texts.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    p, q = sizes.get(1, 0), sizes.get(0, 0)
    if not p or not q:
        share = p / max(p + q, 1)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(max(share, 1e-15) / max(1 - share, 1e-15))))

    def count(batches):
        both = np.zeros((2, 1 << HASH_BITS), np.int32)
        for batch in batches:
            y = np.asarray(batch.column("_y"))
            done = 0
            for data, ends in pieces(batch.column("_text")):
                rows, hashed = present(data, ends)
                toxic_here = y[done : done + len(ends) - 1][rows] == 1
                done += len(ends) - 1
                both[0] += np.bincount(hashed[~toxic_here], minlength=1 << HASH_BITS).astype(np.int32)
                both[1] += np.bincount(hashed[toxic_here], minlength=1 << HASH_BITS).astype(np.int32)
        seen = np.flatnonzero(both.any(axis=0))
        yield pa.RecordBatch.from_pydict({"h": seen, "p": both[1, seen].astype(np.int64), "q": both[0, seen].astype(np.int64)})

    counts = texts.select("_text", "_y").mapInArrow(count, "h long, p long, q long")
    counts = counts.groupBy("h").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    ratio = F.log((F.col("p") + SMOOTHING) / (p + 2 * SMOOTHING)) - F.log((F.col("q") + SMOOTHING) / (q + 2 * SMOOTHING))
    told = F.abs(F.col("p") / p - F.col("q") / q) * F.abs(F.col("r"))
    best = counts.withColumn("r", ratio).withColumn("told", told).orderBy(F.desc("told"), "h").limit(FEATURES).collect()
    hashes = np.array([r["h"] for r in best], np.int64)
    scale = np.array([r["r"] for r in best])
    spread = texts.sparkSession.sparkContext.broadcast(hashes)

    def occurrences(batches):
        table = numbered(spread.value)
        for batch in batches:
            y = np.asarray(batch.column("_y"))
            done = 0
            for data, ends in pieces(batch.column("_text")):
                rows, numbers = present(data, ends, table)
                n = len(ends) - 1
                cuts = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(numbers.astype(np.int16)))
                yield pa.RecordBatch.from_arrays([pa.array(y[done : done + n], pa.int32()), lists], ["y", "f"])
                done += n

    table = texts.select("_text", "_y").mapInArrow(occurrences, "y int, f array<smallint>").toArrow()
    lists = table.column("f").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    columns = np.asarray(lists.flatten()).astype(np.int64)
    rows = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    w, b = _logistic(rows, columns, scale, np.asarray(table.column("y")).astype(float))
    return Model(hashes, w * scale, float(b))


def scorer(spark: SparkSession, model: Model):
    """A column function from a text to its score, 0 to 1."""
    shared = spark.sparkContext.broadcast((model.hashes, model.weights, model.intercept))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        hashes, weights, intercept = shared.value
        known = numbered(hashes)
        out = [np.zeros(0)]
        for data, ends in pieces(texts):
            rows, numbers = present(data, ends, known)
            total = np.bincount(rows, weights[numbers], minlength=len(ends) - 1) if len(rows) else np.zeros(len(ends) - 1)
            out.append(_sigmoid(total + intercept))
        return pa.array(np.concatenate(out))

    return score


def held_out(doc_id: str = "doc_id") -> Column:
    return F.col(doc_id).isNull() | (doc_hash(doc_id) % 5 == 0)


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, score, predicted."""
    score = scorer(docs.sparkSession, model)
    scored = docs.select(F.col(doc_id).alias("doc_id"), score(text_column(docs, text)).alias("score"))
    return scored.select("doc_id", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns."""
    return docs.where(scorer(docs.sparkSession, model)(text_column(docs, text)) < threshold)
