"""Catalogue records: typed scan, flag and list normalisation, text document per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import split_list, yes_no
from ..functions.vocab import MISSING, Vocabulary
from ..functions.constraints import offered_categories

CSV_SCHEMA = T.StructType(
    [
        T.StructField("college_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("courses_offered", T.StringType()),
        T.StructField("annual_fees_inr", T.LongType()),
        T.StructField("last_year_cutoff_pct", T.DoubleType()),
        T.StructField("total_seats", T.LongType()),
        T.StructField("hostel_available", T.StringType()),
        T.StructField("naac_grade", T.StringType()),
        T.StructField("avg_placement_lpa", T.DoubleType()),
        T.StructField("established_year", T.LongType()),
        T.StructField("about", T.StringType()),
    ]
)

_RENAMES = {
    "college_id": "record_id",
    "courses_offered": "courses",
    "annual_fees_inr": "fee",
    "last_year_cutoff_pct": "cutoff",
    "total_seats": "seats",
    "hostel_available": "flag_text",
    "naac_grade": "grade",
    "avg_placement_lpa": "placement",
    "established_year": "established",
}


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header row, RFC-4180 quoting, free text that may span lines; explicit schema."""
    return (
        spark.read.schema(CSV_SCHEMA)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
        .withColumnsRenamed(_RENAMES)
    )


def number_rows(records: DataFrame, key: str) -> DataFrame:
    """Positions 0..n-1 in key order, for sources without a numeric business key.

    Rows are range-partitioned by key; each partition numbers its own rows and is shifted by the
    rows before it, so no task holds more than its range.
    """
    from ..operators.ranking import distributed_rank

    return distributed_rank(records, group=[], order=[F.col(key)]).withColumn(
        "row_idx", F.col("rn") - 1
    ).drop("rn")


def normalise(raw: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Flag to boolean, course text to list, and the category keywords each record serves."""
    return raw.select(
        *[c for c in raw.columns if c != "flag_text"],
        yes_no(F.col("flag_text")).alias("flag"),
        split_list(F.col("courses")).alias("course_list"),
        offered_categories(F.col("courses"), vocabulary.categories).alias("categories"),
    )


def shown(column: str) -> Column:
    """A field as text; a missing one is marked, so that it never takes the record with it."""
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def whole(column: str) -> Column:
    """A figure as text, without decimals where it has none."""
    c = F.col(column)
    return F.coalesce(F.when(c == F.floor(c), F.floor(c).cast("string")), c.cast("string"), F.lit(MISSING))


def document() -> Column:
    """The record as one text, worded so that questions and records share terms."""
    figures = F.when(
        F.coalesce("placement", F.lit(0.0)) == 0, F.lit("placement not reported / not applicable")
    ).otherwise(
        F.concat(F.lit("average placement "), F.col("placement").cast("string"), F.lit(" lakhs per annum"))
    )
    hostel = F.when(F.col("flag"), F.lit("hostel available")).otherwise(F.lit("no hostel"))
    courses = F.coalesce(F.array_join("course_list", ", "), F.lit(MISSING))
    return F.concat(
        shown("name"), F.lit(" ("), shown("record_id"), F.lit(") in "), shown("city"), F.lit(", "),
        shown("state"), F.lit(". Type: "), shown("type"), F.lit(". Courses offered: "),
        courses, F.lit(". Annual fees: Rs "), shown("fee"),
        F.lit(" per year. Last year cutoff: "), whole("cutoff"),
        F.lit(" percent aggregate (hard minimum). Total seats: "), shown("seats"),
        F.lit(". "), hostel, F.lit(". NAAC grade: "), shown("grade"), F.lit(". "), figures,
        F.lit(". Established "), shown("established"), F.lit(". "), shown("about"),
    )


def corpus(records: DataFrame) -> DataFrame:
    return records.select("row_idx", document().alias("doc"))


__all__ = ["CSV_SCHEMA", "read_catalog_csv", "number_rows", "normalise", "document", "corpus"]
