"""Column expressions against published results, as one table per extractor."""

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

import goldens as g
from citeframe.functions import constraints as C
from citeframe.functions import pii, text
from citeframe.functions.vocab import ENGLISH_STOPS
from citeframe.operators.profile import folded_questions
from citeframe.operators.redact import staged_counts


def check(spark, pairs, kind, expression):
    rows = [(q, None if e is None else kind(e)) for q, e in pairs]
    name = {float: "double", bool: "boolean", str: "string"}[kind]
    df = folded_questions(spark.createDataFrame(rows, f"question string, expected {name}"))
    got = df.select("question", "expected", expression.alias("got")).where(~F.col("expected").eqNullSafe(F.col("got")))
    assert got.collect() == []


def test_budget(spark):
    check(spark, g.BUDGET, float, C.budget(F.col("_ungrouped")))


def test_cutoff(spark):
    check(spark, g.CUTOFF, float, C.cutoff(F.col("_folded")))


def test_placement(spark):
    check(spark, g.PLACEMENT, float, C.placement(F.col("_folded")))


def test_exhaustive(spark):
    check(spark, g.EXHAUSTIVE, bool, C.exhaustive(F.col("_lower")))


def test_redaction(spark):
    check(spark, g.REDACTED, str, pii.redact(F.col("question")))


def test_redaction_is_idempotent(spark):
    df = spark.createDataFrame([(t,) for t, _ in g.REDACTED], "t string")
    once = df.select(pii.redact(F.col("t")).alias("once"))
    assert once.where(~pii.redact(F.col("once")).eqNullSafe(F.col("once"))).count() == 0


def test_stop_list_is_sparks(spark):
    assert list(ENGLISH_STOPS) == StopWordsRemover.loadDefaultStopWords("english")


@pytest.mark.parametrize(
    "doc, expected",
    [
        ("The fees of the college", ["fees", "college", "fees college"]),
        ("a I x", []),
        ("Öl für_2 é", ["öl", "für_2", "öl für_2"]),
        ("", []),
    ],
)
def test_terms(spark, doc, expected):
    df = spark.createDataFrame([(doc,)], "d string").select(text.tokens(F.col("d"), ENGLISH_STOPS).alias("t"))
    assert df.select(text.with_bigrams(F.col("t"))).first()[0] == expected


def test_list_and_flag(spark):
    df = spark.createDataFrame([(" YES ", "a; b;; "), ("no", ""), (None, None)], "f string, l string")
    rows = df.select(text.yes_no(F.col("f")), text.split_list(F.col("l"))).collect()
    assert [tuple(r) for r in rows] == [(True, ["a", "b"]), (False, []), (False, None)]


def test_rules_look_only_where_something_can_be_found(spark):
    texts = [
        None, "", "hers, rs and firs", "income unknown", "call 1234", "rs 12345", "Rs.९८७६५४", "my income is rs. 5 lakhs", "(987) 654-3210",
        "+91 9876543210", "1234 5678-9012", "a@b.co, 123456789012 and income 3", "987.654.3210x", "1234 567", "ıncome 7, RS 123456",
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for name, pattern, _ in pii.RULES:
        found = rows.where(F.regexp_count("t", F.lit(pattern)) > 0)
        assert found.where(~pii.may_match(F.col("t"), name)).count() == 0, name
    assert [r[0] for r in rows.where(pii.may_match(F.col("t"), "amount")).orderBy("i").select("i").collect()] == [5, 6, 14]
    assert rows.where(pii.may_match(F.col("t"), "phone") & F.col("i").isin(4, 13)).count() == 0
    staged = staged_counts(rows, "t").orderBy("i").collect()
    assert [r["n_email"] for r in staged[:2]] == [None, 0] and staged[5]["n_amount"] == 1 and staged[7]["redacted"] != texts[7]
