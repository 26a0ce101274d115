"""Redaction over tables of text, and how much of it there was to do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pii import RULES, mask, may_match, redact


def redact_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All rules on each named text column; other columns pass through."""
    return df.withColumns({c: redact(F.col(c)) for c in columns})


def staged_counts(texts: DataFrame, text: str) -> DataFrame:
    """Adds n_<rule>: matches each rule finds in what the rules before it left. Texts in which a rule cannot find
    anything are told once and passed by."""
    out = texts.withColumn("_stage", F.col(text))
    stage, may = F.col("_stage"), F.col("_may")
    for name, pattern, _ in RULES:
        count = F.when(may, F.regexp_count(stage, F.lit(pattern))).when(stage.isNotNull(), 0)
        out = out.withColumn("_may", may_match(stage, name)).withColumns({f"n_{name}": count, "_stage": mask(stage, name, may)})
    return out.withColumnRenamed("_stage", "redacted").drop("_may")


def redaction_stats(texts: DataFrame, text: str, group: Sequence[str]) -> DataFrame:
    counted = staged_counts(texts, text)
    return counted.groupBy(*group).agg(
        F.count("*").alias("n_texts"),
        *[F.sum(f"n_{name}").cast("long").alias(f"n_{name}") for name, _, _ in RULES],
        F.sum((F.col("redacted") != F.col(text)).cast("long")).alias("n_changed"),
    )
