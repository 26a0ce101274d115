"""Text expressions shared by the operators.

Character classes are spelled out instead of using ``(?U)``: the rules were defined with
Unicode letters, digits and spaces, which Java's ``\\w`` and ``\\b`` do not match exactly
(combining marks, control separators).
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\p{Z}\x1c-\x1f\x85"
SP = f"[{SPACE}]"
# word boundary, start of word, end of word
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
NOT_AFTER_WORD = rf"(?<![{WORD}])"
NOT_BEFORE_WORD = rf"(?![{WORD}])"


@cache
def _decimal_digits() -> tuple[str, str]:
    """Every non-ASCII decimal digit and its ASCII counterpart (basic plane)."""
    chars = [chr(c) for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(chars), "".join(str(unicodedata.decimal(c)) for c in chars)


def ascii_digits(c: Column) -> Column:
    foreign, plain = _decimal_digits()
    return F.when(c.rlike(r"[\p{Nd}&&[^0-9]]"), F.translate(c, foreign, plain)).otherwise(c)


def strip(c: Column) -> Column:
    """Without spaces at its ends; a text that has none there is not searched."""
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.when(ends.rlike(SP), F.regexp_replace(c, rf"^{SP}+|{SP}+$", "")).otherwise(c)


def contains_any(c: Column, terms: tuple[str, ...]) -> Column:
    return F.array_contains(F.array(*[c.contains(t) for t in terms]), True)


def only_words(c: Column) -> Column:
    """Lower-case text with everything but letters, digits, underscores and spaces blanked."""
    return F.regexp_replace(F.lower(c), rf"[^{WORD}{SPACE}]", " ")


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, f"{SP}+"), lambda w: w != "")


def tokens(c: Column, stops: tuple[str, ...]) -> Column:
    """Runs of two or more word characters, lower-cased, stop words removed."""
    found = F.regexp_extract_all(F.lower(c), F.lit(f"[{WORD}]{{2,}}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stops)) if stops else found


def with_bigrams(toks: Column) -> Column:
    """Unigrams followed by bigrams of neighbours (after stop-word removal)."""
    n = F.size(toks)
    pairs = F.zip_with(
        F.slice(toks, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(toks, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(toks, pairs)


def yes_no(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)) == "yes", F.lit(False))


def split_list(c: Column, sep: str = ";") -> Column:
    return F.filter(F.transform(F.split(c, sep), strip), lambda x: x != "")
