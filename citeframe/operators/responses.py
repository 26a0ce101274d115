"""Validation of model responses: extract, parse, fail closed, keep only retrieved citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.text import strip
from ..session import store
from .retrieve import Retrieval

NO_CITATIONS = "array<string>"
# Texts and numbers accepted as a boolean.
TRUE_WORDS = ("true", "1", "yes", "on", "t", "y")
FALSE_WORDS = ("false", "0", "no", "off", "f", "n")


def json_object(raw: Column) -> Column:
    """From the first opening to the last closing brace; the trimmed text if there is no such span."""
    found = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(strip(raw))


def may_be_json(text: Column) -> Column:
    """Whether a trimmed text can be a list's elements at all: it starts like a value or ends the list, and an object it starts
    has an end. A parser that gives up on a text costs more than one that reads it."""
    start = F.substring(text, 1, 1)
    return (text == "") | start.rlike(r'["\[\]0-9tfn-]') | ((start == "{") & text.endswith("}"))


def validate(responses: DataFrame) -> DataFrame:
    """Adds answer, citations, answered, reason_if_unanswered, valid and quarantined raw text.

    Fields are checked on a parsed variant, by the type they have in the JSON: text is not made
    from numbers, and a list of anything but text is not a list of citations.
    """
    # parsed as a one-element list, which text after the object would break or lengthen
    listed = F.try_parse_json(F.concat(F.lit("["), F.col("_text"), F.lit("]")))
    parsed = (
        responses.withColumn("_text", json_object(F.col("raw_text")))
        .withColumn("_v", F.when(may_be_json(F.col("_text")), listed))
        .withColumn("_v", F.when(F.try_variant_get("_v", "$[1]", "variant").isNull(), F.col("_v")))
    )
    field = lambda name, kind: F.try_variant_get("_v", f"$[0].{name}", kind)
    kind_of = lambda name: F.schema_of_variant(field(name, "variant"))
    typed = parsed.select(
        *responses.columns,
        F.when(kind_of("answer") == "STRING", field("answer", "string")).alias("_answer"),
        F.when(kind_of("citations").isin("ARRAY<STRING>", "ARRAY<VOID>"), field("citations", "array<string>")).alias("_citations"),
        F.when(kind_of("answered") == "BOOLEAN", field("answered", "boolean"))
        .when(F.lower(field("answered", "string")).isin(*TRUE_WORDS), True)
        .when(F.lower(field("answered", "string")).isin(*FALSE_WORDS), False)
        .alias("_answered"),
        F.when(kind_of("reason_if_unanswered") == "STRING", field("reason_if_unanswered", "string")).alias("_reason"),
        F.coalesce(kind_of("reason_if_unanswered").isin("STRING", "VOID"), F.lit(True)).alias("_reason_ok"),
        F.col("_v").isNotNull().alias("_json"),
    )
    cites_ok = F.col("_citations").isNotNull() & ~F.exists("_citations", lambda c: c.isNull())
    faults = F.array_compact(
        F.array(
            F.when(~F.col("_json"), F.lit("not JSON")),
            F.when(F.col("_json") & F.col("_answer").isNull(), F.lit("answer")),
            F.when(F.col("_json") & ~F.coalesce(cites_ok, F.lit(False)), F.lit("citations")),
            F.when(F.col("_json") & F.col("_answered").isNull(), F.lit("answered")),
            F.when(F.col("_json") & ~F.col("_reason_ok"), F.lit("reason_if_unanswered")),
        )
    )
    checked = typed.withColumn("_faults", faults).withColumn("_failed", F.col("error_type").isNotNull())
    good = ~F.col("_failed") & (F.size("_faults") == 0)
    nothing = F.array().cast(NO_CITATIONS)
    return checked.select(
        *responses.columns,
        F.when(F.col("_failed"), F.lit(v.SERVICE_DOWN_ANSWER)).when(good, F.col("_answer")).otherwise("").alias("answer"),
        F.when(good, F.col("_citations")).otherwise(nothing).alias("citations"),
        F.when(good, F.col("_answered")).otherwise(False).alias("answered"),
        F.when(F.col("_failed"), F.concat(F.lit("API error ("), "error_type", F.lit("): "), "error_message"))
        .when(good, F.col("_reason"))
        .otherwise(F.concat(F.lit(v.INVALID_REASON + ": "), F.array_join("_faults", ", ")))
        .alias("reason_if_unanswered"),
        good.alias("valid"),
        F.when(~F.col("_failed") & ~good, F.col("raw_text")).alias("quarantined"),
    )


def cited(validated: DataFrame, questions: DataFrame) -> DataFrame:
    """(resp_id, pos, uq, record_id): one row per distinct citation, at its first position."""
    first = F.array_distinct("citations")
    return (
        validated.select("resp_id", "qid", F.posexplode(first).alias("pos", "record_id"))
        .join(questions.select("qid", "uq"), "qid")
        .select("resp_id", "pos", "uq", "record_id")
    )


def check_citations(validated: DataFrame, retrieval: Retrieval, k: int) -> DataFrame:
    """Replaces citations by those retrieved for the question, in order and once each; none if
    the response does not answer. ``dropped`` counts the distinct ones that were not retrieved."""
    validated = store(validated, "validated")
    kept = (
        retrieval.membership(cited(validated, retrieval.questions), k)
        .groupBy("resp_id")
        # bounded by one response's own citations
        .agg(F.array_sort(F.collect_list(F.struct("pos", "record_id"))).alias("_kept"))
        .select("resp_id", F.col("_kept.record_id").alias("_kept"))
    )
    nothing = F.array().cast(NO_CITATIONS)
    checked = validated.join(kept, "resp_id", "left").withColumn("_kept", F.coalesce("_kept", nothing))
    return (
        checked.withColumn("dropped", (F.size(F.array_distinct("citations")) - F.size("_kept")).cast("long"))
        .withColumn("citations", F.when(F.col("answered"), F.col("_kept")).otherwise(nothing))
        .drop("_kept")
    )


def dropped_by_model(checked: DataFrame) -> DataFrame:
    return checked.groupBy("model").agg(
        F.count("*").alias("n_responses"),
        F.sum("dropped").alias("n_dropped"),
        F.sum((F.col("dropped") > 0).cast("long")).alias("n_with_dropped"),
        F.sum((~F.col("valid")).cast("long")).alias("n_invalid"),
    )


OUTPUT = ("answer", "citations", "answered", "reason_if_unanswered")


def final_answers(checked: DataFrame, negatives: DataFrame) -> DataFrame:
    """(qid, resp_id, four output fields): checked responses, and the fixed answer (resp_id -1)
    for true negatives, which no response may replace."""
    fixed = negatives.select("qid", F.lit(-1).cast("long").alias("resp_id"), *OUTPUT)
    answered = checked.join(negatives.select("qid"), "qid", "left_anti")
    return answered.select("qid", "resp_id", *OUTPUT).unionByName(fixed)


def report(answers: DataFrame) -> DataFrame:
    """One JSON object per answer with exactly the four output fields."""
    body = F.to_json(
        F.struct(
            F.coalesce("answer", F.lit("")).alias("answer"),
            F.coalesce("citations", F.array().cast(NO_CITATIONS)).alias("citations"),
            F.coalesce("answered", F.lit(False)).alias("answered"),
            "reason_if_unanswered",
        ),
        {"ignoreNullFields": "false"},
    )
    return answers.select("qid", "resp_id", body.alias("json"))


def save_report(answers: DataFrame, path: str) -> None:
    """The report as text files whose names and lines follow the questions' order."""
    report(answers).orderBy("qid", "resp_id").select(F.col("json").alias("value")).write.text(path)
