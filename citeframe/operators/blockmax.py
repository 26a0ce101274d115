"""Top-k by block-max postings: an index that says for whole blocks of texts how well they can score at most.

Texts are ordered by their heaviest term and length, so that neighbours are alike, and dealt to blocks. Postings
are kept per term and block, with the largest impact (term count over the text's norm) in it. A query adds up, per
block, its weights times those maxima: no text of the block can score more. The blocks that promise most are
scored first and give a k-th best; of the others, only those whose bound still reaches it are read. Results are
exact, ties included.

Where the blocks left to read are too many to be replicated, a sample of the texts raises the k-th bests, and the texts are
scored where they lie: no pair is shuffled, and only those that reach their query's k-th best are kept.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, cut, fits_broadcast, part_of, shuffle_partitions, store
from .joins import lookup_join
from .ranking import SCORE_DIGITS, distributed_rank, top_k

# Texts of a block
BLOCK = 256
# Sums of doubles differ in their last digits with the order of addition; bounds leave room for that.
SLACK = 1e-12
# Blocks to read, as bytes, that are told one by one
TOLD_BYTES = BROADCAST_BYTES // 8
# One text in so many is scored first when texts are scored where they lie
SAMPLE = 64
# Pairs that share a term in a task
PAIRS = 4_000_000


class BlockMax:
    """Block-max postings over ``counts`` (key, term, tf); ``docs`` (key, norm, lead), stored, with each text's heaviest term."""

    def __init__(self, counts: DataFrame, docs: DataFrame, key: str, block: int = BLOCK):
        self.counts, self.docs, self.key, self.block = counts, docs, key, block

    @property
    def placed(self) -> DataFrame:
        """(key, norm, block)"""
        ranked = distributed_rank(self.docs, [], [F.col("lead"), F.col("norm"), F.col(self.key)])
        return ranked.select(self.key, "norm", F.floor((F.col("rn") - 1) / self.block).alias("block"))

    @cached_property
    def postings(self) -> DataFrame:
        """(term, block, peak, first, docs): at most a block's texts in a row, the largest impact and smallest key."""
        placed = part_of(self.placed, self.docs)
        met = lookup_join(self.counts.select(self.key, "term", "tf"), placed, [self.key], ["term"])
        impact = met.select("term", "block", F.struct(F.col(self.key).alias("doc"), (F.col("tf") / F.col("norm")).alias("impact")).alias("d"))
        rows = impact.groupBy("term", "block").agg(
            F.max("d.impact").alias("peak"), F.min("d.doc").alias("first"), F.collect_list("d").alias("docs")
        )
        return part_of(store(rows, "postings"), self.counts)

    def bounds(self, vector: DataFrame, query: str) -> DataFrame:
        """(query, block, bound, first), written once: what no text of the block can exceed."""
        peaks = self.postings.select("term", "block", "peak", "first")
        met = lookup_join(peaks, part_of(vector.select(query, "term", "coef"), vector), ["term"], ["block"])
        bound = F.round(F.sum(F.col("coef") * F.col("peak")) + SLACK, SCORE_DIGITS).alias("bound")
        return store(met.groupBy(query, "block").agg(bound, F.min("first").alias("first")), "bounds")

    def scored(self, chosen: DataFrame, vector: DataFrame, query: str) -> DataFrame:
        """(query, key, score) of the texts in the ``chosen`` (query, block) that share a term with the query.

        Postings are brought together by block, so that sums are complete where they are formed.
        """
        wanted = cut(lookup_join(chosen, part_of(vector.select(query, "term", "coef"), vector), [query], ["block"]))
        if fits_broadcast(wanted):
            asked = F.broadcast(wanted.select("term", "block").distinct())
            near = self.postings.select("term", "block", "docs").join(asked, ["term", "block"], "left_semi")
            # the number is spelled out, as adaptive execution would merge partitions by the size of these rows
            near = near.repartition(shuffle_partitions(near), "block")
            met = near.join(F.broadcast(wanted), ["block", "term"])
        else:
            met = lookup_join(wanted, part_of(self.postings.select("term", "block", "docs"), self.counts), ["block", "term"], [query])
        pairs = met.select(query, "block", "coef", F.explode("docs").alias("d")).select(query, "block", "coef", "d.doc", "d.impact")
        sums = pairs.groupBy(query, "block", "doc").agg(F.sum(F.col("impact") * F.col("coef")).alias("score"))
        return sums.select(query, F.col("doc").alias(self.key), "score")

    def plan(self, vector: DataFrame, query: str, k: int, admitted) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(first scores, further blocks to read, all bounds). ``admitted`` keeps the pairs that count."""
        bounds = self.bounds(vector, query)
        # blocks that promise most; of equal ones, those of the smallest keys
        probes = 1 + -(-k // self.block)
        best = cut(top_k(bounds, [query], [F.col("bound").desc(), F.col("first").asc()], probes).select(query, "block"))
        first = store(admitted(self.scored(best, vector, query)), "probed")
        kth = self.floors(first, query, k)
        rest = bounds.join(best.withColumn("_read", F.lit(True)), [query, "block"], "left").where("_read is null")
        rest = lookup_join(rest, kth, [query], ["block"], "left")
        reaches = (F.col("bound") > F.col("kth")) | ((F.col("bound") == F.col("kth")) & (F.col("first") < F.col("kth_key")))
        return first, cut(rest.where(F.coalesce(reaches, F.lit(True))).select(query, "block")), bounds

    def floors(self, pairs: DataFrame, query: str, k: int) -> DataFrame:
        """(query, kth, kth_key), cut: the k-th best of each query that has k pairs."""
        value = F.round("score", SCORE_DIGITS)
        kth = top_k(pairs, [query], [value.desc(), F.col(self.key).asc()], k).where(F.col("rn") == k)
        return cut(kth.select(query, value.alias("kth"), F.col(self.key).alias("kth_key")))

    def in_place(
        self, counts: DataFrame, vector: DataFrame, query: str, sides: DataFrame | None = None, where: Column | None = None,
        partitions: int | None = None,
    ) -> DataFrame:
        """(query, key, score, norm) of all pairs that share a term.

        A text's rows are brought together, with what ``where`` reads of it, and its pairs are complete where they are formed.
        """
        docs = self.docs.select(self.key, "norm")
        docs = docs if sides is None else docs.join(sides, self.key)
        near = counts.select(self.key, "term", "tf").repartition(partitions or shuffle_partitions(counts), self.key)
        met = lookup_join(near.join(docs, self.key), vector, ["term"], [self.key], where=where)
        return met.groupBy(query, self.key).agg(
            F.sum(F.col("tf") / F.col("norm") * F.col("coef")).alias("score"), F.max("norm").alias("norm")
        )

    def _all_in_place(
        self, first: DataFrame, vector: DataFrame, query: str, k: int, sides: DataFrame | None, where: Column | None
    ) -> DataFrame:
        """Of a query's terms, the most frequent are light, as many as cannot bring a text to the k-th best of a sample: pairs
        are formed through its other terms, and light ones added to those that can still reach it."""
        counts = store(self.counts.select(self.key, "term", "tf"), "asked")
        sample = self.in_place(counts.where(F.pmod(F.xxhash64(self.key), F.lit(SAMPLE)) == 0), vector, query, sides, where)
        pair = (query, self.key, "score")
        seen = sample.select(*pair).unionByName(first.select(*pair)).groupBy(query, self.key).agg(F.max("score").alias("score"))
        floors = self.floors(seen, query, k)

        terms = self.postings.groupBy("term").agg(F.max("peak").alias("_top"), F.sum(F.size("docs")).alias("_n"))
        most = F.col("coef") * F.col("_top")
        # a query's terms
        own = Window.partitionBy(query)
        upto = own.orderBy(F.col("_n").desc(), "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        faced = vector.join(terms, "term").join(floors, query, "left").withColumn(
            "_light", F.coalesce(F.round(F.sum(most).over(upto) + SLACK, SCORE_DIGITS) < F.col("kth"), F.lit(False))
        )
        weighed = cut(faced.withColumn("_rest", F.coalesce(F.sum(F.when(F.col("_light"), most)).over(own), F.lit(0.0))))
        met = weighed.where("not _light").agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        heavy = part_of(weighed.where("not _light").drop("_light", "_rest", "_top", "_n", "kth", "kth_key"), weighed)
        light = part_of(weighed.where("_light").select(query, "term", "coef"), weighed)
        marks = part_of(weighed.select(query, "kth", "kth_key", "_rest").distinct(), weighed)

        def reaching(pairs: DataFrame, most: Column) -> DataFrame:
            value = F.round(most, SCORE_DIGITS)
            enough = (value > F.col("kth")) | ((value == F.col("kth")) & (F.col(self.key) <= F.col("kth_key")))
            return pairs.where(F.coalesce(enough, F.lit(True)))

        sums = self.in_place(counts, heavy, query, sides, where, max(shuffle_partitions(counts), -(-met // PAIRS)))
        may = reaching(lookup_join(sums, marks, [query], [self.key]), F.col("score") + F.col("_rest") + F.when(F.col("_rest") > 0, SLACK).otherwise(0.0))
        found = store(may, "reaching")
        unfinished = cut(found.where("_rest > 0").select(query, self.key, "norm"))
        rows = lookup_join(lookup_join(counts, unfinished, [self.key], ["term"]), light, [query, "term"], [self.key])
        added = rows.select(query, self.key, (F.col("tf") / F.col("norm") * F.col("coef")).alias("score"))
        whole = found.select(*pair).unionByName(added).groupBy(query, self.key).agg(F.sum("score").alias("score"))
        return reaching(lookup_join(whole, marks, [query], [self.key]), F.col("score")).select(*pair)

    def top_pairs(
        self, vector: DataFrame, query: str, k: int, sides: DataFrame | None = None, where: Column | None = None, told: int = TOLD_BYTES
    ) -> DataFrame:
        """(query, key, score): exact scores of at least every pair among a query's k best.

        With ``where``, only pairs that it holds for count; it reads columns of ``vector`` and of ``sides`` (a row for
        each key).
        """
        wants = None
        if where is not None:
            rest = [c for c in vector.columns if c not in ("term", "coef")]
            wants = part_of(vector.select(*rest).dropDuplicates([query]), vector)
            sides = cut(sides)

        def admitted(pairs: DataFrame) -> DataFrame:
            if where is None:
                return pairs
            both = lookup_join(lookup_join(pairs, wants, [query], [self.key]), sides, [self.key], [query])
            return both.where(where).select(query, self.key, "score")

        first, further, _ = self.plan(vector, query, k, admitted)
        if fits_broadcast(further, told) or not fits_broadcast(vector):
            return first.unionByName(admitted(self.scored(further, vector, query)))
        return self._all_in_place(first, vector, query, k, sides if where is not None else None, where)
