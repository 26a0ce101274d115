"""Evaluation cases: a JSON array of objects whose checks are optional keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_list

SCHEMA = (
    "id string, question string, expected_answered boolean, expected_citations array<string>, "
    "expected_citations_any_of array<string>, required_substrings array<string>, "
    "forbidden_substrings array<string>, note string"
)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """An absent key reads as NULL (check not requested), which an empty list is not."""
    return (
        spark.read.schema(SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(path)
        .withColumnsRenamed(
            {
                "id": "case_id",
                "expected_citations_any_of": "any_of",
                "required_substrings": "required",
                "forbidden_substrings": "forbidden",
            }
        )
    )


# Cases in one array, and so in one file.
ARRAY_CASES = 1000


def write_cases(cases: DataFrame, path: str, size: int = ARRAY_CASES) -> None:
    """JSON arrays of about ``size`` objects, one a file; keys of NULL are left out."""
    parts = max(1, -(-cases.count() // size))
    array = F.to_json(F.collect_list(F.struct(*cases.columns)))
    (
        cases.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(array.alias("value"))
        .write.partitionBy("part").text(path)
    )


def from_delimited(cases: DataFrame) -> DataFrame:
    """Cases whose lists are stored as ``;``-separated text."""
    lists = ["expected_citations", "any_of", "required", "forbidden"]
    return cases.withColumns({c: split_list(F.col(c)) for c in lists})
