"""Hard constraints read out of a question, as Column expressions (NULL = not asked for)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as v
from .text import EDGE, NOT_AFTER_WORD, NOT_BEFORE_WORD, SP, WORD, ascii_digits, contains_any, strip

NUMBER = r"\d+(?:\.\d+)?"


def _spaced(pattern: str) -> str:
    """Use the Unicode space class wherever a vocabulary pattern says ``\\s``."""
    return pattern.replace(r"\s", SP)


def _number(c: Column, pattern: str) -> Column:
    """First match's group 1 as a double; NULL when there is none."""
    return F.regexp_extract(c, pattern, 1).try_cast("double")


def _first_number(numbers: Column, keep) -> Column:
    return F.get(F.filter(numbers, keep), F.lit(0)).try_cast("double")


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def folded(question: Column) -> Column:
    """What the extractors read: lower case, all digits ASCII."""
    return ascii_digits(F.lower(question))


def ungrouped(q: Column) -> Column:
    """Commas between digits removed (1,50,000 -> 150000)."""
    return F.regexp_replace(q, r"(?<=\d),(?=\d)", "")


def budget(q: Column) -> Column:
    """Yearly ceiling in folded, ungrouped text: lakhs, else thousands, else the first plain
    number that is large enough."""
    lakhs = _number(q, rf"({NUMBER}){SP}*(?:lakhs?|l){NOT_BEFORE_WORD}") * v.LAKH
    thousands = _number(q, rf"({NUMBER}){SP}*k{NOT_BEFORE_WORD}") * 1000
    plain = _first_number(
        _all(q, rf"{NOT_AFTER_WORD}\d+{NOT_BEFORE_WORD}"),
        lambda n: n.try_cast("double") >= v.PLAIN_BUDGET_MIN,
    )
    per_year = F.when(contains_any(q, v.HALF_YEAR_TERMS), 2).otherwise(1)
    return F.coalesce(lakhs, thousands, plain) * per_year


def cutoff(q: Column) -> Column:
    """Own score in folded text: a percentage, else a number after a scoring word, else any
    plausible number."""
    low, high = v.SCORE_RANGE
    percentage = _number(q, rf"({NUMBER}){SP}*(?:%|percent|percentage){EDGE}")
    after_word = _number(q, rf"(?:{_spaced(v.SCORE_PREFIXES)}){SP}*({NUMBER}){NOT_BEFORE_WORD}")

    def plausible(n: Column) -> Column:
        rest = F.substring(q, F.instr(q, n) + F.length(n), F.length(q))
        return n.try_cast("double").between(low, high) & ~rest.rlike(f"^{SP}*[kl]")

    anywhere = F.when(
        contains_any(q, v.SCORE_WORDS),
        _first_number(_all(q, rf"{EDGE}{NUMBER}{NOT_BEFORE_WORD}"), plausible),
    )
    return F.coalesce(
        percentage, F.when(after_word.between(low, high), after_word), anywhere
    )


def placement(q: Column) -> Column:
    """Floor on the placement figure in folded text: the first number after the word, else one
    right before it."""
    at = F.instr(q, F.lit(v.PLACEMENT_WORD))
    after = F.substring(q, at + len(v.PLACEMENT_WORD), F.length(q))
    before = strip(F.substring(q, F.lit(1), at - 1))
    unit = r"(?:lakhs?|lpa|l)?"
    return F.when(
        at > 0,
        F.coalesce(
            _number(after, rf"(?:{_spaced(v.PLACEMENT_LEADS)}){SP}*({NUMBER}){SP}*{unit}{EDGE}"),
            _number(before, rf"({NUMBER}){SP}*{unit}$"),
        ),
    )


def exhaustive(q: Column) -> Column:
    """The (lower-case) question is about the whole catalogue, not the best few."""
    return q.rlike(rf"{NOT_AFTER_WORD}(?:{v.EXHAUSTIVE_WORDS}){NOT_BEFORE_WORD}")


def wanted_type(q: Column, types: tuple[tuple[str, str], ...]) -> Column:
    return F.coalesce(*[F.when(q.contains(term), F.lit(value)) for term, value in types])


def wants_flag(q: Column, word: str) -> Column:
    """The flag word, phrased as a property to select on rather than to ask about."""
    phrased = contains_any(q, v.FLAG_PHRASES) | q.rlike(
        rf"{NOT_AFTER_WORD}(?:{v.FLAG_VERBS}){SP}+{word}s?{NOT_BEFORE_WORD}"
    )
    return q.contains(word) & phrased


def wanted_categories(q: Column, categories: tuple[tuple[str, str], ...]) -> Column:
    """Keywords present as whole words, in vocabulary order; empty when there is none."""
    return F.array_compact(
        F.array(
            *[
                F.when(q.rlike(f"{EDGE}{_java_literal(word)}{EDGE}"), F.lit(word))
                for word, _ in categories
            ]
        )
    )


def offered_categories(courses: Column, categories: tuple[tuple[str, str], ...]) -> Column:
    """Keywords whose (case-insensitive) pattern occurs in a record's course text."""
    return F.array_compact(
        F.array(*[F.when(courses.rlike(f"(?i){p}"), F.lit(word)) for word, p in categories])
    )


def _java_literal(word: str) -> str:
    return re.sub(rf"([^A-Za-z0-9_ ])", r"\\\1", word)


__all__ = [
    "folded", "ungrouped", "budget", "cutoff", "placement", "exhaustive", "wanted_type", "wants_flag",
    "wanted_categories", "offered_categories", "WORD",
]
