"""Retrieval for a table of questions: route, rank inside the route's pool, pad, widen.

A question that names records is answered from those; else one with constraints from the records
that satisfy them (none is a valid outcome); else from the whole catalogue. Ranking is TF-IDF
cosine with the catalogue's global idf. All of it runs once per distinct lower-cased question.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import ENGLISH_STOPS, Vocabulary
from ..session import cut, part_of, payload_bytes, store
from ..sources.catalog import document
from .eligibility import first_eligible, is_eligible, nothing_wanted, signatures
from .entities import match_names, name_key
from .joins import for_each_asker, lookup_join
from .pools import WholePools
from .profile import WANTS, lowered, profiled_questions
from .ranking import best_first, top_k
from .tfidf import Index, cosine_pairs

NAMED, CONSTRAINED, OPEN = "named", "constrained", "open"
RECORD_SIDE = ("row_idx", "name_key", "type", "flag", "categories", "fee", "cutoff", "placement")


class Retrieval:
    """Relations of one retrieval run over ``records`` (normalised) and ``questions``."""

    def __init__(
        self, records: DataFrame, questions: DataFrame, vocabulary: Vocabulary,
        stops: tuple[str, ...] = ENGLISH_STOPS, idf: DataFrame | None = None,
    ):
        """``idf``: weights fitted on another catalogue, kept as they are."""
        self.vocabulary = vocabulary
        # written once: routing, indexing and padding all read it
        self.records = store(records.withColumn("name_key", name_key(F.col("name"))), "records")
        self.questions = questions.withColumn("uq", lowered("question"))
        self.stops, self.frozen = stops, idf

    @cached_property
    def index(self) -> Index:
        return Index(
            self.records.select(*RECORD_SIDE, document().alias("doc")), "row_idx", "doc", self.frozen, stops=self.stops
        )

    # ---- routing -----------------------------------------------------------------------

    @cached_property
    def unique(self) -> DataFrame:
        """Distinct questions with their constraints, cut for reuse."""
        return profiled_questions(self.questions, self.vocabulary)

    @cached_property
    def named(self) -> DataFrame:
        """(uq, name_key), cut for reuse."""
        texts = part_of(self.unique.select("uq", F.col("uid").alias("n")), self.unique)
        return cut(match_names(texts, self.records, self.vocabulary.name_stops))

    @cached_property
    def routed(self) -> DataFrame:
        """Distinct questions with their route, cut for reuse."""
        hits = self.named.select("uq", F.lit(True).alias("_named")).distinct()
        route = (
            F.when(F.col("_named"), NAMED).when(F.col("applied"), CONSTRAINED).otherwise(OPEN)
        )
        return cut(self.unique.join(hits, "uq", "left").withColumn("route", route).drop("_named"))

    # ---- pools -------------------------------------------------------------------------

    def _asked(self, route: str, exhaustive: bool | None = None) -> DataFrame:
        chosen = self.routed.where(F.col("route") == route)
        return chosen if exhaustive is None else chosen.where(F.col("exhaustive") == exhaustive)

    def _named_pool(self, asked: DataFrame) -> DataFrame:
        """(uid, name_key) of the named questions in ``asked``."""
        return self.named.join(asked.select("uq", "uid"), "uq").select("uid", "name_key")

    def pools(self, exhaustive: bool) -> WholePools:
        return WholePools(self, self.routed.where(F.col("exhaustive") == exhaustive))

    @cached_property
    def whole(self) -> WholePools:
        """What exhaustive questions are answered from."""
        return self.pools(exhaustive=True)

    def pool(self, exhaustive: bool) -> DataFrame:
        """(uid, row_idx) written out: as large as the answer to an exhaustive question."""
        return self.pools(exhaustive).members()

    def first_of_pool(self, asked: DataFrame, k: int) -> DataFrame:
        """(uid, row_idx): each pool's first k records in catalogue order, pools left unformed."""
        order = [F.col("row_idx").asc()]
        by_name = top_k(self.records.select("row_idx", "name_key"), ["name_key"], order, k).drop("rn")
        names = self._named_pool(asked.where(F.col("route") == NAMED))
        named = top_k(by_name.join(names, "name_key"), ["uid"], order, k)
        limited = asked.where(F.col("route") == CONSTRAINED)
        sigs = signatures(limited)
        constrained = (
            limited.select("uid", "sig").join(sigs.select("sid", "sig"), "sig")
            .join(first_eligible(sigs, self.records, k), "sid")
        )
        # k ids, whatever the catalogue's size
        heads = self.records.select("row_idx").orderBy("row_idx").limit(k).agg(
            F.array_sort(F.collect_list("row_idx")).alias("ids")
        ).scalar()
        opened = asked.where(F.col("route") == OPEN).select("uid", F.explode(heads).alias("row_idx"))
        return (
            named.select("uid", "row_idx")
            .unionByName(constrained.select("uid", "row_idx"))
            .unionByName(opened)
        )

    # ---- scores ------------------------------------------------------------------------

    def scores(self, asked: DataFrame, k: int | None = None) -> DataFrame:
        """(uid, row_idx, score) for pool members sharing a term with the question; given ``k``,
        members that cannot be among the k best may be left out."""
        vector = self.index.vector(asked.select("uid", "uq"), "uid", "uq")
        counts, norms = self.index.counts, self.index.lengths
        free = cut(vector.join(asked.where(F.col("route") != NAMED).select("uid", *WANTS), "uid"))
        if k is None:
            by_rule = cosine_pairs(counts, norms, free, "uid", "row_idx", where=is_eligible())
        else:
            sides = self.records.select(*[c for c in RECORD_SIDE if c != "name_key"])
            by_rule = self.index.block_max(free).top_pairs(free, "uid", k, sides, is_eligible())
        names = self._named_pool(asked.where(F.col("route") == NAMED))
        by_name = cosine_pairs(
            counts.select("row_idx", "name_key", "term", "tf"), norms, cut(vector.join(names, "uid")),
            "uid", "row_idx", on=("term", "name_key"),
        )
        return by_rule.unionByName(by_name)

    # ---- results -----------------------------------------------------------------------

    def _spelled(self, ranked: DataFrame) -> DataFrame:
        """Question texts back in place of their numbers."""
        texts = cut(self.unique.select("uid", "uq"))
        return lookup_join(ranked, texts, ["uid"], ["row_idx"]).select("uq", "rn", "row_idx", "score")

    def ranked(self, k: int, asked: DataFrame | None = None) -> DataFrame:
        """(uq, rn, row_idx, score): the k best of each pool; records without a shared term score
        zero and fill up in catalogue order."""
        return self._spelled(self.ranked_by_number(k, asked))

    def ranked_by_number(self, k: int, asked: DataFrame | None = None) -> DataFrame:
        """``ranked`` as (uid, rn, row_idx, score)."""
        asked = self.routed.where(~F.col("exhaustive")) if asked is None else asked
        best = cut(top_k(self.scores(asked, k), ["uid"], best_first(), k).select("uid", "row_idx", "score", "rn"))
        full = best.where(F.col("rn") == k).select("uid")
        short = cut(asked.join(full, "uid", "left_anti"))
        if payload_bytes(short) == 0:
            return best.select("uid", "rn", "row_idx", "score")
        padding = self.first_of_pool(short, k).select("uid", "row_idx", F.lit(0.0).alias("score"))
        best = best.drop("rn")
        merged = best.unionByName(padding).groupBy("uid", "row_idx").agg(F.max("score").alias("score"))
        return top_k(merged, ["uid"], best_first(), k).select("uid", "rn", "row_idx", "score")

    def ranked_whole(self) -> DataFrame:
        """(uq, rn, row_idx, score) for exhaustive questions: the whole pool, however large."""
        return self._spelled(self.whole.ranked())

    def askers(self) -> DataFrame:
        """(qid, question, uid) of every question."""
        numbers = part_of(self.unique.select("uq", "uid"), self.unique)
        return lookup_join(self.questions.select("qid", "question", "uq"), numbers, ["uq"], ["qid"]).drop("uq")

    def ranked_by_question(self, k: int, shown: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """(qid, rn, row_idx, score) for every question, bounded or exhaustive.

        ``shown``: what to give in place of the rows (uid, rn, row_idx, score), with ``uid`` and ``rn`` kept; worked out once
        for equal questions, which share their rows until the last step.
        """
        bounded = self.ranked_by_number(k).withColumn("rn", F.col("rn").cast("long"))
        answers = store(bounded.unionByName(self.whole.ranked()), "answers")
        answers = answers if shown is None else store(shown(answers), "shown")
        columns = [c for c in answers.columns if c != "uid"]
        return for_each_asker(answers, self.askers(), "uid", "qid", ["rn"]).select("qid", *columns)

    def with_ids(self, ranked: DataFrame, asker: str = "uq") -> DataFrame:
        """Adds ``record_id``; records that pad many answers don't gather in one task."""
        return lookup_join(ranked, cut(self.records.select("row_idx", "record_id")), ["row_idx"], [asker])

    def asked_as(self, route: str) -> DataFrame:
        """Distinct questions put on one route: all of them on the open one (constraints lifted),
        those with constraints on the constrained one (names ignored)."""
        fixed = self.unique.withColumn("route", F.lit(route))
        return fixed.where("applied") if route == CONSTRAINED else fixed.withColumns(nothing_wanted())

    def route_counts(self) -> DataFrame:
        """Questions and distinct questions per route and width."""
        return self.routed.groupBy("route", "exhaustive").agg(
            F.sum("n_questions").alias("n_questions"), F.count("*").alias("n_distinct")
        )

    def membership(self, pairs: DataFrame, k: int) -> DataFrame:
        """Keeps (uq, record_id, ...) rows whose record was retrieved for the question.

        For a bounded question that is its k ranked records; for an exhaustive one the pool,
        tested on the pair itself rather than by writing the pool out.
        """
        spread = pairs.columns
        listed = cut(self.with_ids(self.ranked(k)).select("uq", "record_id"))
        known = lookup_join(pairs, listed, ["uq", "record_id"], spread, "left_semi")
        wide = cut(self.routed.where("exhaustive").select("uq", "route", *WANTS))
        sides = cut(self.records.select("record_id", *RECORD_SIDE[1:]))
        tested = lookup_join(lookup_join(pairs, wide, ["uq"], spread), sides, ["record_id"], spread)
        by_name = lookup_join(
            tested.where(F.col("route") == NAMED), self.named, ["uq", "name_key"], spread, "left_semi"
        )
        by_rule = tested.where((F.col("route") != NAMED) & is_eligible())
        columns = pairs.columns
        return known.select(columns).unionByName(by_name.select(columns)).unionByName(by_rule.select(columns))
