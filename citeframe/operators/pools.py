"""Whole pools: what exhaustive questions are answered from, kept once for all questions that share them.

A pool is a dictionary of records in catalogue order, with each record's place and the length of the texts before
it: one for the open questions, one for each distinct set of constraints, one for each distinct set of names. What
a question adds is sparse: the members that share a term with it and so score above zero. They lead its ranking;
the rest of it is the pool in catalogue order with those members left out, which is a range of places between
each two of them. So a ranking, or a prompt, of any length is a row for each scored member and at most one more
range than that, and rows for the other members are only made where someone asks for them.
"""

from __future__ import annotations

from functools import cached_property
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, store
from .context import paragraph
from .eligibility import eligible_pairs, signatures
from .joins import lookup_join
from .ranking import SCORE_DIGITS, best_first, distributed_rank, placed

if TYPE_CHECKING:
    from .retrieve import Retrieval

# Places of a pool that a range meets at once when its members are written out.
PLACES = 1024


class WholePools:
    """Pools of the distinct questions ``asked`` (rows of ``run.routed``)."""

    def __init__(self, run: Retrieval, asked: DataFrame):
        self.run, self.asked = run, cut(asked)

    # ---- dictionary --------------------------------------------------------------------

    def _of(self, route: str) -> DataFrame:
        return self.asked.where(F.col("route") == route)

    @cached_property
    def assigned(self) -> DataFrame:
        """(uid, pool), cut for reuse: a pool has the same key for every question it answers."""
        said = self.run.named.join(self._of("named").select("uq", "uid"), "uq")
        # a set of names is told by its size and two sums of hashes, whatever its size
        hashes = [F.sum(F.xxhash64("name_key", F.lit(k)).cast("decimal(38,0)")) for k in (1, 2)]
        names = said.groupBy("uid").agg(F.concat_ws(":", F.lit("names"), F.count("*"), *hashes).alias("pool"))
        limited = self._of("constrained").select("uid", F.concat(F.lit("limits:"), "sig").alias("pool"))
        opened = self._of("open").select("uid", F.lit("open").alias("pool"))
        return cut(names.unionByName(limited).unionByName(opened))

    def _members(self) -> DataFrame:
        """(pool, row_idx, chars)"""
        sizes = store(
            self.run.records.select("row_idx", "name_key", F.length(paragraph()).cast("long").alias("chars")), "lengths"
        )
        # the names of one question speak for all that say the same ones
        speakers = self.assigned.where(F.col("pool").startswith("names:")).groupBy("pool").agg(F.min("uid").alias("uid"))
        said = speakers.join(self.asked.select("uid", "uq"), "uid").join(self.run.named, "uq")
        named = lookup_join(sizes, cut(said.select("pool", "name_key")), ["name_key"], ["row_idx"]).drop("name_key")
        sigs = signatures(self._of("constrained"))
        pools = cut(sigs.select("sid", F.concat(F.lit("limits:"), "sig").alias("pool")))
        pairs = lookup_join(eligible_pairs(sigs, self.run.records), pools, ["sid"], ["row_idx"])
        limited = lookup_join(pairs, cut(sizes.select("row_idx", "chars")), ["row_idx"], ["pool"])
        # if anybody asks for it
        opened = self._of("open").agg((F.count("*") > 0).alias("any")).scalar()
        whole = sizes.where(opened).withColumn("pool", F.lit("open"))
        columns = ("pool", "row_idx", "chars")
        return named.select(*columns).unionByName(limited.select(*columns)).unionByName(whole.select(*columns))

    @cached_property
    def dictionary(self) -> DataFrame:
        """(pool, row_idx, chars, place, before), written once: places count from 1, ``before`` is the length of the
        texts of earlier places."""
        return store(placed(store(self._members(), "members"), "pool", "row_idx", "chars"), "pools")

    @cached_property
    def sizes(self) -> DataFrame:
        """(pool, n, chars), cut for reuse: members and length of their texts."""
        return cut(self.dictionary.groupBy("pool").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")))

    @cached_property
    def totals(self) -> DataFrame:
        """(uid, pool, n, chars) of questions whose pool has members, cut for reuse."""
        return cut(lookup_join(self.assigned, self.sizes, ["pool"], ["uid"]))

    # ---- sparse rankings ---------------------------------------------------------------

    @cached_property
    def scored(self) -> DataFrame:
        """(uid, pool, row_idx, score, chars, place, before, rn, nth), written once: the members that share a term with the
        question, their rank, and their order by place."""
        scores = self.run.scores(self.asked).where(F.round("score", SCORE_DIGITS) > 0)
        owned = lookup_join(scores, self.assigned, ["uid"], ["row_idx"])
        found = lookup_join(owned, self.dictionary, ["pool", "row_idx"], ["uid"])
        ranked = distributed_rank(store(found, "scored"), ["uid"], best_first())
        by_place = distributed_rank(ranked.withColumnRenamed("rn", "_rank"), ["uid"], [F.col("place")])
        return store(by_place.withColumnsRenamed({"rn": "nth", "_rank": "rn"}), "ranked")

    def ranges(self) -> DataFrame:
        """(uid, pool, first, last, rn, chars): the places between scored members, the rank of the first of them and
        the length of their texts."""
        counts = self.scored.groupBy("uid").agg(F.count("*").alias("n_scored"))
        ends = self.totals.join(counts, "uid", "left").select(
            "uid", "pool", "n", F.col("chars").alias("total"), F.coalesce("n_scored", F.lit(0)).alias("n_scored")
        )
        ends = cut(ends)
        after = self.scored.select("uid", "nth", "place", (F.col("before") + F.col("chars")).alias("stop"))
        start = ends.select("uid", F.lit(0).cast("long").alias("nth"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("stop"))
        until = self.scored.select("uid", (F.col("nth") - 1).alias("nth"), F.col("place").alias("next"), F.col("before").alias("until"))
        gaps = after.unionByName(start).join(until, ["uid", "nth"], "left")
        owned = lookup_join(gaps, ends, ["uid"], ["nth"])
        return owned.select(
            "uid", "pool", (F.col("place") + 1).alias("first"), (F.coalesce("next", F.col("n") + 1) - 1).alias("last"),
            (F.col("n_scored") + F.col("place") + 1 - F.col("nth")).alias("rn"),
            (F.coalesce("until", "total") - F.col("stop")).alias("chars"),
        ).where("first <= last")

    # ---- written out -------------------------------------------------------------------

    def members(self) -> DataFrame:
        """(uid, row_idx): every question's pool."""
        return lookup_join(self.dictionary, self.assigned, ["pool"], ["row_idx"]).select("uid", "row_idx")

    def ranked(self) -> DataFrame:
        """(uid, rn, row_idx, score) of all members."""
        block = lambda place: F.floor(F.col(place) / PLACES)
        blocks = self.ranges().withColumn("block", F.explode(F.sequence(block("first"), block("last"))))
        inside = F.col("place").between(F.col("first"), F.col("last"))
        dealt = store(self.dictionary.select("pool", "row_idx", "place", block("place").alias("block")), "blocks")
        rest = lookup_join(blocks, dealt, ["pool", "block"], ["uid"], where=inside)
        rest = rest.select("uid", (F.col("rn") + F.col("place") - F.col("first")).alias("rn"), "row_idx", F.lit(0.0).alias("score"))
        return self.scored.select("uid", "rn", "row_idx", "score").unionByName(rest)

