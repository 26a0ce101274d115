"""TF-IDF over a table of texts: terms, inverse document frequencies, norms and cosines."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens, with_bigrams
from ..functions.vocab import ENGLISH_STOPS
from ..session import BROADCAST_BYTES, cut, exists, fits_broadcast, fresh_path, part_of, shuffle_partitions, store, write_buckets, write_once
from .blockmax import BlockMax
from .joins import HOT_ROWS, lookup_join

# Groups of texts that share a lower bound of their heaviest weights: 32 MB
TOPS = 1 << 20
# Terms of a text among which the start of a run is looked for
BACK = (64, 4096)
# Text of a bucket of an index; it grows into some five million counts
BUCKET_BYTES = 24 << 20


def with_terms(
    texts: DataFrame, text: str, stops: Sequence[str] = ENGLISH_STOPS, bigrams: bool = True
) -> DataFrame:
    """Replaces the text column by ``terms``: its tokens and, if asked, their bigrams."""
    rest = [c for c in texts.columns if c != text]
    tokenised = texts.select(*rest, tokens(F.col(text), tuple(stops)).alias("_tokens"))
    terms = with_bigrams(F.col("_tokens")) if bigrams else F.col("_tokens")
    return tokenised.select(*rest, terms.alias("terms"))


def term_counts(termed: DataFrame) -> DataFrame:
    """One row per text and distinct term, with its count ``tf``.

    Equal terms are runs of the sorted array, counted at their ends by looking back: nothing is shuffled, whatever partitioning
    the texts had is kept, and from the sorted array on all of it is generated code. A long run's start is looked for in the
    least of ``BACK`` that holds the run, so a text costs in proportion to its length.
    """
    rest = [c for c in termed.columns if c != "terms"]
    # for a bare column Spark would infer a filter, and work the terms out twice
    runs = F.posexplode(F.coalesce("_s", F.array().cast("array<string>"))).alias("_at", "term")
    each = termed.select(*rest, F.sort_array("terms").alias("_s")).select(*rest, "_s", runs)
    at, term = F.col("_at"), F.col("term")

    def here(place: Column) -> Column:
        return F.get("_s", place).eqNullSafe(term)

    tf = F.when(~here(at - 1), 1).when(~here(at - 2), 2).when(~here(at - 3), 3)
    for width in BACK:
        start = F.greatest(at + 1 - width, F.lit(0))
        tf = tf.when(~here(at - width), at + 2 - start - F.array_position(F.slice("_s", start + 1, at + 1 - start), term))
    tf = tf.otherwise(at + 2 - F.array_position("_s", term))
    return each.where(~here(at + 1)).select(*rest, "term", tf.cast("long").alias("tf"))


def document_frequencies(counts: DataFrame, n_docs: Column) -> DataFrame:
    """(term, df, n_docs, idf) with the smoothed inverse document frequency."""
    return (
        counts.groupBy("term").agg(F.count("*").alias("df"))
        .withColumn("n_docs", n_docs)
        .withColumn("idf", F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)
    )


def _frequent_from(weights: DataFrame, limit: int) -> int | None:
    """The lowest power of two so that the terms of at least that many texts fit ``limit`` bytes together."""
    step = F.floor(F.log2(F.greatest("df", F.lit(1)))).cast("int").alias("step")
    size = F.sum(F.lit(16 * len(weights.columns)) + F.octet_length("term")).alias("bytes")
    # at most 63 rows
    lowest, total = None, 0
    for row in weights.groupBy(step).agg(size).orderBy(F.desc("step")).collect():
        total += row["bytes"] or 0
        if total > limit:
            break
        lowest = 1 << row["step"]
    return lowest


def weigh(counts: DataFrame, idf: DataFrame, spread: str, own: bool = False, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Adds ``idf`` (stored, so that its size is known) to each counted term; terms outside the
    vocabulary are dropped.

    Weights too large to be replicated are met in two parts: those of the most frequent terms, as many as fit, where the counts
    lie, and only rows of the others are shuffled. ``own``: the weights were fitted on these counts, so that ``df`` tells
    how many rows a term has.
    """
    weights = part_of(idf.select("term", "df", "n_docs", "idf"), idf)
    lowest = None if fits_broadcast(weights, limit) else _frequent_from(weights, limit)
    if lowest is None:
        return lookup_join(counts, weights, ["term"], [spread], limit=limit)
    frequent = F.broadcast(cut(weights.where(F.col("df") >= lowest)))
    near = counts.join(frequent, "term")
    rest = counts.join(frequent.select("term"), "term", "left_anti")
    rare = part_of(weights.where(F.col("df") < lowest), idf)
    far = rest.join(rare, "term") if own and lowest <= HOT_ROWS else lookup_join(rest, rare, ["term"], [spread], limit=limit)
    return near.unionByName(far)


def norms(weighed: DataFrame, key: str) -> DataFrame:
    """(key, norm, n_terms, top): Euclidean length of each text's tf-idf vector, and its largest weight. Sums and maxima of
    numbers are formed without sorting the rows."""
    w = F.col("tf") * F.col("idf")
    return weighed.groupBy(key).agg(F.sqrt(F.sum(w * w)).alias("norm"), F.count("*").alias("n_terms"), F.max(w).alias("top"))


def leads(
    counts: DataFrame, idf: DataFrame, tops: DataFrame, key: str, own: bool = False, groups: int = TOPS, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """(key, lead): each text's heaviest term, of equal ones the last; ``tops`` has (key, top), its weight.

    A text among the aggregates makes Spark sort the rows, so only those that can be the heaviest are left for it: texts are
    dealt to ``groups`` by a hash, and no row below the least ``top`` of its text's group is one. Most are told by their
    count or a frequent term's weight, and only the others are weighed.
    """
    group = F.pmod(F.xxhash64(key), F.lit(groups))
    # at most as many rows as there are groups
    least = cut(tops.where("top is not null").groupBy(group.alias("_group")).agg(F.min("top").alias("_least")))
    rarest = idf.agg(F.max("idf").alias("m")).scalar()
    may = counts.select(key, "term", "tf", group.alias("_group")).join(F.broadcast(least), "_group").drop("_group")
    may = may.where(F.col("tf") * rarest >= F.col("_least"))
    weights = part_of(idf.select("term", "df", "n_docs", "idf"), idf)
    lowest = None if fits_broadcast(weights, limit) else _frequent_from(weights, limit)
    if lowest is not None:
        frequent = cut(weights.where(F.col("df") >= lowest).select("term", "idf"))
        known = may.join(F.broadcast(frequent), "term", "left")
        may = store(known.where(F.col("tf") * F.coalesce("idf", rarest) >= F.col("_least")).drop("idf"), "heavy")
    w = F.col("tf") * F.col("idf")
    heavy = weigh(may, idf, key, own, limit).where(w >= F.col("_least"))
    return heavy.groupBy(key).agg(F.max(F.struct(w, "term"))["term"].alias("lead"))


def query_vector(queries: DataFrame, idf: DataFrame, key: str, text: str, **options) -> DataFrame:
    """(key, term, coef), cut: the normalised query weight with the record side's idf
    folded in, so scoring needs only raw counts from the record side."""
    counts = term_counts(with_terms(queries.select(key, text), text, **options))
    weighed = lookup_join(counts, idf.select("term", "df", "n_docs", "idf"), ["term"], [key])
    w = F.col("tf") * F.col("idf")
    length = F.sqrt(F.sum(w * w).over(Window.partitionBy(key)))
    return cut(weighed.select(key, "term", (w * F.col("idf") / length).alias("coef")))


def cosine_pairs(
    counts: DataFrame, doc_norms: DataFrame, vector: DataFrame, query_key: str, doc_key: str,
    on: Sequence[str] = ("term",), where: Column | None = None,
) -> DataFrame:
    """(query, doc, score) for pairs that share a term.

    With the query vectors replicated, only rows of asked-for terms are kept, brought together by
    document, and each document's pairs are formed and summed where it lies: no pair is shuffled.
    Vectors too large for that are met by a salted shuffle on the term. Rows are divided by their
    document's norm before they are multiplied into pairs.
    """
    doc_norms = doc_norms.select(doc_key, "norm")
    if fits_broadcast(vector):
        asked_terms = F.broadcast(vector.select(*on).distinct())
        # The number is spelled out because adaptive execution would otherwise merge partitions
        # by the size of these rows, although each grows into a pair per question.
        counts = counts.join(asked_terms, list(on), "left_semi").repartition(shuffle_partitions(counts), doc_key)
    scaled = counts.join(doc_norms.select(doc_key, "norm"), doc_key)
    matched = lookup_join(scaled, vector, on, [doc_key], where=where)
    return matched.groupBy(query_key, doc_key).agg(
        F.sum(F.col("tf") / F.col("norm") * F.col("coef")).alias("score")
    )


def top_pairs(counts: DataFrame, docs: DataFrame, vector: DataFrame, query_key: str, doc_key: str, k: int) -> DataFrame:
    """(query, doc, score): exact scores of at least every pair among a query's k best, by block-max postings of ``counts``;
    ``docs`` has a row (doc, norm, lead) for each text."""
    return BlockMax(counts.select(doc_key, "term", "tf"), docs, doc_key).top_pairs(vector, query_key, k)


def with_zero_rows(keys: DataFrame, found: DataFrame, key: str, *numbers: str) -> DataFrame:
    """A row for every key: a text without (known) terms has the zero vector."""
    rest = [c for c in found.columns if c not in (key, *numbers)]
    zeros = [F.coalesce(F.col(n), F.lit(0)).alias(n) for n in numbers]
    return keys.select(key).join(found, key, "left").select(key, *zeros, *rest)


class Index:
    """TF-IDF tables of one corpus: term counts written once, the rest derived from them. Counts lie in buckets by text and
    fitted weights in as many by term, so that neither is shuffled where they are joined or saved.

    With ``idf`` (term, df, n_docs, idf), the vocabulary fitted on another corpus, terms and weights
    are those; else they are fitted on this one.
    """

    def __init__(self, docs: DataFrame, key: str, text: str, idf: DataFrame | None = None, **options):
        self.key, self.text, self.options = key, text, options
        self.keys, self.own = docs.select(key), idf is None
        # One text grows into many times its size, so texts are dealt out evenly first. Buckets are a multiple of the
        # partitions terms are counted in, so that each of these has whole buckets.
        spread = shuffle_partitions(docs)
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        self.buckets = spread * max(1, -(-size // (spread * BUCKET_BYTES)))
        dealt = docs.repartition(self.buckets, key)
        self.counts = self._filed(term_counts(with_terms(dealt, text, **options)), "counts", key)
        n_docs = docs.agg(F.count("*").alias("n")).scalar()
        self.idf = self._filed(document_frequencies(self.counts, n_docs), "idf", "term") if idf is None else idf

    def _filed(self, rows: DataFrame, label: str, by: str) -> DataFrame:
        return write_buckets(rows, fresh_path(rows.sparkSession, label), self.buckets, by)

    def norms(self) -> DataFrame:
        found = norms(weigh(self.counts.select(self.key, "term", "tf"), self.idf, self.key, self.own), self.key)
        return with_zero_rows(self.keys, found, self.key, "norm", "n_terms")

    @cached_property
    def lengths(self) -> DataFrame:
        """(key, norm, top), written once: a row per text."""
        return store(self.norms().select(self.key, "norm", "top"), "lengths")

    @cached_property
    def doc_norms(self) -> DataFrame:
        """(key, norm, lead), written once: a row per text, with its heaviest term."""
        found = leads(self.counts, self.idf, self.lengths, self.key, self.own)
        return store(self.lengths.select(self.key, "norm").join(found, self.key, "left"), "norms")

    def block_max(self, vector: DataFrame) -> BlockMax:
        """Postings of the terms of ``vector`` (cut) in blocks with their largest impacts."""
        asked = part_of(vector.select("term").distinct(), vector)
        counts = lookup_join(self.counts.select(self.key, "term", "tf"), asked, ["term"], [self.key], "left_semi")
        return BlockMax(part_of(counts, self.counts), self.doc_norms, self.key)

    def top_pairs(self, queries: DataFrame, key: str, text: str, k: int) -> DataFrame:
        """(query key, doc key, score): exact scores of at least every pair among a query's k best."""
        vector = self.vector(queries, key, text)
        return self.block_max(vector).top_pairs(vector, key, k)

    def vector(self, queries: DataFrame, key: str, text: str) -> DataFrame:
        return query_vector(queries, self.idf, key, text, **self.options)

    def scores(self, queries: DataFrame, key: str, text: str) -> DataFrame:
        """(query key, doc key, score) for every pair with a positive cosine."""
        vector = self.vector(queries, key, text)
        return cosine_pairs(self.counts.select(self.key, "term", "tf"), self.lengths, vector, key, self.key)


FORMAT = 1


def save_index(index: Index, path: str, buckets: int | None = None) -> None:
    """Writes a fitted index for later sessions: counts and norms in buckets by text, weights by term. What lies in as many
    buckets already is copied bucket by bucket.

    ``<path>/layout`` is written last and says how the index is kept; without it there is none.
    """
    spark = index.counts.sparkSession
    if exists(spark, f"{path}/layout"):
        raise ValueError(f"there is an index at {path}")
    buckets = buckets or index.buckets
    kept = buckets == index.buckets
    parts = {
        "counts": (index.counts.select(index.key, "term", "tf"), index.key, kept), "norms": (index.doc_norms, index.key, False),
        "idf": (index.idf.select("term", "df", "n_docs", "idf"), "term", kept and index.own),
    }
    kinds = {}
    for name, (rows, by, dealt) in parts.items():
        filed = write_buckets(rows if dealt else rows.repartition(buckets, by), f"{path}/{name}", buckets, by)
        kinds[name] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in filed.schema.fields)
    layout = {
        "format": FORMAT, "key": index.key, "buckets": buckets, "columns": kinds,
        "stops": list(index.options.get("stops", ENGLISH_STOPS)), "bigrams": index.options.get("bigrams", True),
    }
    write_once(spark, f"{path}/layout", json.dumps(layout))


class SavedIndex(Index):
    """An index that ``save_index`` wrote, in this session or an earlier one. Texts meet their norms and are summed where
    their bucket lies: ranking shuffles nothing of the index. ``close`` takes its tables out of the catalogue."""

    def __init__(self, spark: SparkSession, path: str):
        if not exists(spark, f"{path}/layout"):
            raise ValueError(f"there is no index at {path}")
        layout = json.loads(spark.read.text(f"{path}/layout").first()["value"])
        if layout["format"] != FORMAT:
            raise ValueError(f"the index at {path} has format {layout['format']}")
        self.spark, self.key = spark, layout["key"]
        self.options = {"stops": tuple(layout["stops"]), "bigrams": layout["bigrams"]}
        self.buckets, self.own = layout["buckets"], True
        self.names = {}
        for part, by in (("counts", self.key), ("norms", self.key), ("idf", "term")):
            self.names[part] = f"index_{part}_{uuid.uuid4().hex}"
            spark.sql(
                f"CREATE TABLE {self.names[part]} ({layout['columns'][part]}) USING parquet CLUSTERED BY (`{by}`) "
                f"INTO {layout['buckets']} BUCKETS LOCATION '{path}/{part}'"
            )
        self.counts, self.idf, self.saved_norms = (spark.table(self.names[p]) for p in ("counts", "idf", "norms"))
        self.keys = self.saved_norms.select(self.key)

    @property
    def doc_norms(self) -> DataFrame:
        return self.saved_norms

    @property
    def lengths(self) -> DataFrame:
        return self.saved_norms

    def scores(self, queries: DataFrame, key: str, text: str) -> DataFrame:
        vector = self.vector(queries, key, text)
        if not fits_broadcast(vector):
            return cosine_pairs(self.counts, self.doc_norms, vector, key, self.key)
        asked = F.broadcast(vector.select("term").distinct())
        near = self.counts.join(asked, "term", "left_semi").join(self.doc_norms.select(self.key, "norm").hint("merge"), self.key)
        return near.join(F.broadcast(vector), "term").groupBy(key, self.key).agg(
            F.sum(F.col("tf") / F.col("norm") * F.col("coef")).alias("score")
        )

    def close(self) -> None:
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
