"""Scoring answers against evaluation cases. A NULL expectation is not checked; a case without an
answer fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quoted(items: Column) -> Column:
    inner = F.array_join(F.transform(F.array_sort(items), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    return F.concat(F.lit("["), inner, F.lit("]"))


def _same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def score(cases: DataFrame, answers: DataFrame, on: str) -> DataFrame:
    """Case and answer columns plus ``failures`` (texts) and ``passed``."""
    text = F.lower(F.coalesce("answer", F.lit("")))
    got = F.array_distinct(F.coalesce("citations", F.array().cast("array<string>")))
    said = F.coalesce("answered", F.lit(False))

    def texts_where(wanted: str, present: bool, label: str) -> Column:
        hits = F.filter(
            F.coalesce(wanted, F.array().cast("array<string>")),
            lambda s: text.contains(F.lower(s)) == F.lit(present),
        )
        return F.transform(hits, lambda s: F.concat(F.lit(f"{label} substring: '"), s, F.lit("'")))

    checks = F.array_compact(
        F.array(
            F.when(F.col("_found").isNull(), F.lit("no answer")),
            F.when(
                F.col("expected_answered") != said,
                F.concat(
                    F.lit("answered="), F.initcap(said.cast("string")), F.lit(", expected="),
                    F.initcap(F.col("expected_answered").cast("string")),
                ),
            ),
            F.when(
                F.col("expected_citations").isNotNull() & ~_same_set(got, F.col("expected_citations")),
                F.concat(F.lit("citations="), _quoted(got), F.lit(", expected="), _quoted(F.col("expected_citations"))),
            ),
            F.when(
                F.col("any_of").isNotNull() & ~F.arrays_overlap(got, "any_of"),
                F.concat(F.lit("citations="), _quoted(got), F.lit(" matched none of "), _quoted(F.col("any_of"))),
            ),
        )
    )
    failures = F.concat(
        checks,
        texts_where("required", False, "missing required"),
        texts_where("forbidden", True, "contains forbidden"),
    )
    return (
        cases.join(answers.withColumn("_found", F.lit(True)), on, "left")
        .withColumn("failures", failures)
        .withColumn("passed", F.size("failures") == 0)
        .drop("_found")
    )


def pass_rate(scored: DataFrame) -> DataFrame:
    """One row; the rate is NULL when nothing was scored."""
    passed = F.coalesce(F.sum(F.col("passed").cast("long")), F.lit(0))
    return scored.agg(
        passed.alias("n_passed"),
        F.count("*").alias("n_total"),
        F.round(F.try_divide(passed * 100, F.count("*")), 4).alias("pass_pct"),
    )
