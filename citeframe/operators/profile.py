"""Constraint extraction over a table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constraints as C
from ..functions.vocab import Vocabulary
from ..session import cut
from .ranking import running_sum

WANTS = ("want_type", "want_flag", "want_cats", "max_fee", "own_score", "min_placement")


def lowered(text: str) -> Column:
    """What a question is known by; a missing one is an empty one."""
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def folded_questions(questions: DataFrame, text: str = "question") -> DataFrame:
    """Adds the normalised texts the extractors read, each computed once per row."""
    return (
        questions.withColumn("_lower", lowered(text))
        .withColumn("_folded", C.folded(F.col("_lower")))
        .withColumn("_ungrouped", C.ungrouped(F.col("_folded")))
    )


def with_constraints(questions: DataFrame, vocabulary: Vocabulary, text: str = "question") -> DataFrame:
    """Adds one nullable column per kind of constraint, and whether any is set."""
    lower, folded, ungrouped = F.col("_lower"), F.col("_folded"), F.col("_ungrouped")
    wanted = folded_questions(questions, text).select(
        *questions.columns,
        C.wanted_type(lower, vocabulary.types).alias("want_type"),
        C.wants_flag(lower, vocabulary.flag_word).alias("want_flag"),
        C.wanted_categories(lower, vocabulary.categories).alias("want_cats"),
        C.budget(ungrouped).alias("max_fee"),
        C.cutoff(folded).alias("own_score"),
        C.placement(folded).alias("min_placement"),
        C.exhaustive(lower).alias("exhaustive"),
    )
    applied = (
        F.col("want_type").isNotNull()
        | F.col("want_flag")
        | (F.size("want_cats") > 0)
        | F.coalesce("max_fee", "own_score", "min_placement").isNotNull()
    )
    return wanted.withColumn("applied", applied)


def with_signature(profiled: DataFrame) -> DataFrame:
    """Questions asking for the same things share a signature."""
    return profiled.withColumn("sig", F.to_json(F.struct(*WANTS)))


def unique_questions(questions: DataFrame) -> DataFrame:
    """(uq, n_questions). Every rule works on the lower-cased question, so equal ones are
    answered once."""
    return questions.groupBy(lowered("question").alias("uq")).agg(F.count("*").alias("n_questions"))


def profiled_questions(questions: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Distinct questions with their constraints, signature and a number, cut for reuse (which
    also fixes the numbers)."""
    unique = with_signature(with_constraints(unique_questions(questions), vocabulary, "uq"))
    return cut(unique.withColumn("uid", F.monotonically_increasing_id()))


def constraint_profile(profiled: DataFrame) -> DataFrame:
    """How often each kind of constraint, alone or combined, is asked for."""
    n = F.col("n_questions")
    return profiled.groupBy(
        F.col("want_type").isNotNull().alias("has_type"),
        F.col("want_flag").alias("has_flag"),
        (F.size("want_cats") > 0).alias("has_category"),
        F.col("max_fee").isNotNull().alias("has_budget"),
        F.col("own_score").isNotNull().alias("has_cutoff"),
        F.col("min_placement").isNotNull().alias("has_floor"),
    ).agg(
        F.sum(n).alias("n_questions"),
        F.min("max_fee").alias("min_budget"),
        F.max("max_fee").alias("max_budget"),
        F.round(
            F.sum(F.col("own_score") * n) / F.sum(F.when(F.col("own_score").isNotNull(), n)), 4
        ).alias("avg_cutoff"),
        F.max("min_placement").alias("max_floor"),
        F.sum(F.when(F.col("exhaustive"), n).otherwise(0)).alias("n_exhaustive"),
    )


def constraint_values(profiled: DataFrame) -> DataFrame:
    """(kind, value, n_questions): how often each type, flag and category is asked for."""
    kinds = F.array(
        F.struct(F.lit("type").alias("kind"), F.col("want_type").alias("value")),
        F.struct(F.lit("flag").alias("kind"), F.when(F.col("want_flag"), F.lit("yes")).alias("value")),
    )
    categories = F.transform("want_cats", lambda c: F.struct(F.lit("category").alias("kind"), c.alias("value")))
    asked = profiled.select("n_questions", F.explode(F.concat(kinds, categories)).alias("k")).where("k.value is not null")
    return asked.groupBy("k.kind", "k.value").agg(F.sum("n_questions").alias("n_questions"))


def constraint_histogram(profiled: DataFrame, buckets: int) -> DataFrame:
    """(kind, bucket, low, high, n_values, n_questions): for each numeric kind of constraint, values in order are dealt to
    buckets of about equal numbers of questions; a value's questions are in one bucket.

    Distinct values are counted first; their running sums come from range partitions, so no kind is gathered in one task.
    """
    kinds = F.array(
        F.struct(F.lit("budget").alias("kind"), F.col("max_fee").alias("value")),
        F.struct(F.lit("cutoff").alias("kind"), F.col("own_score").alias("value")),
        F.struct(F.lit("floor").alias("kind"), F.col("min_placement").alias("value")),
    )
    asked = profiled.select("n_questions", F.explode(kinds).alias("k")).where("k.value is not null")
    values = asked.groupBy(F.col("k.kind").alias("kind"), F.col("k.value").alias("value")).agg(F.sum("n_questions").alias("n"))
    placed = running_sum(values, "kind", "value", "n", "upto")
    # a row for each kind
    totals = F.broadcast(placed.groupBy("kind").agg(F.max("upto").alias("total")))
    # the middle of a value's questions says where it belongs
    middle = (2 * F.col("upto") - F.col("n")) * buckets
    bucket = F.floor(middle / (2 * F.col("total"))).cast("long").alias("bucket")
    return placed.join(totals, "kind").withColumn("bucket", bucket).groupBy("kind", "bucket").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n_values"), F.sum("n").alias("n_questions")
    )
