"""Masking of personal data. The rules are staged: each sees what the one before left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as v
from .text import EDGE, SP, WORD

# What counts as an address, a number, an id or an amount.
# An address can only start where a run of its characters does (or the last match ended), which
# keeps the scan linear in long runs without an "@".
EMAIL = rf"(?:\G|(?<![{WORD}.\-]))[{WORD}.\-]++@[{WORD}.\-]+\.[{WORD}]+"
PHONE = (
    rf"{EDGE}(?:\+?[0-9]{{1,3}}(?:[.\-]|{SP})?)?\(?[0-9]{{3}}\)?(?:[.\-]|{SP})?"
    rf"[0-9]{{3}}(?:[.\-]|{SP})?[0-9]{{4}}{EDGE}"
)
ID12 = rf"{EDGE}\p{{Nd}}{{4}}(?:{SP}|-)?\p{{Nd}}{{4}}(?:{SP}|-)?\p{{Nd}}{{4}}{EDGE}"
INCOME = (
    rf"(?iu)({EDGE}(?:my{SP}+)?(?:family{SP}+)?income{SP}*)(?:is{SP}*)?(?:rs\.?{SP}*)?"
    rf"\p{{Nd}}+(?:\.\p{{Nd}}+)?{SP}*(?:lakhs?|l)?{EDGE}"
)
AMOUNT = rf"(?iu){EDGE}rs\.?{SP}*\p{{Nd}}{{5,7}}{EDGE}"

# What a text must hold at all for a rule to find anything, cheap to look for; the rarer thing first.
GUARDS = {
    "email": ("@",), "phone": (rf"[0-9]{{3}}\)?(?:[.\-]|{SP})?[0-9]{{3}}(?:[.\-]|{SP})?[0-9]{{4}}",),
    "id12": (rf"\p{{Nd}}{{4}}(?:{SP}|-)?\p{{Nd}}{{4}}(?:{SP}|-)?\p{{Nd}}{{4}}",), "income": (r"\p{Nd}", "(?iu)income"),
    "amount": (r"\p{Nd}{5}", "(?iu)rs"),
}

# (rule, pattern, replacement) in the order they apply
RULES = (
    ("email", EMAIL, v.EMAIL_MASK),
    ("phone", PHONE, v.PHONE_MASK),
    ("id12", ID12, v.ID_MASK),
    ("income", INCOME, "$1" + v.INCOME_MASK),
    ("amount", AMOUNT, v.INCOME_MASK),
)


def may_match(c: Column, rule: str) -> Column:
    """False for texts in which the rule cannot find anything."""
    first, *others = [c.contains(g) if rule == "email" else c.rlike(g) for g in GUARDS[rule]]
    for other in others:
        first = first & other
    return first


def mask(c: Column, rule: str, found: Column | None = None) -> Column:
    """One rule on its own; texts that cannot match are passed by. ``found``: ``may_match``, if it is known already."""
    (pattern, replacement) = next((p, r) for name, p, r in RULES if name == rule)
    found = may_match(c, rule) if found is None else found
    return F.when(found, F.regexp_replace(c, pattern, replacement)).otherwise(c)


def redact(c: Column) -> Column:
    """All rules in order. NULL and empty text pass through."""
    for name, _, _ in RULES:
        c = mask(c, name)
    return c
