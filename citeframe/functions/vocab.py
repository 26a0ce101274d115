"""Vocabularies: the words, patterns and constants each rule is parameterised by.

A ``Vocabulary`` holds what is specific to one catalogue. ``COLLEGES`` is the published
admissions catalogue; ``PARTS`` describes the catalogue derived from the ``part`` table.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Vocabulary:
    # ordered: the first term found in the question decides the wanted type
    types: tuple[tuple[str, str], ...]
    # keyword in the question -> regular expression over the catalogue's course text
    categories: tuple[tuple[str, str], ...]
    # words of a record name that do not identify it
    name_stops: tuple[str, ...]
    flag_word: str = "hostel"


# ---- fixed values: must equal the published rules for results to agree ----------------

COLLEGES = Vocabulary(
    types=(
        ("government", "Government"),
        ("deemed", "Deemed"),
        ("private", "Private"),
    ),
    categories=(
        ("engineering", "B.Tech|Diploma CSE|Diploma ME|Diploma Civil"),
        ("mba", "MBA"),
        ("b.tech", "B.Tech"),
        ("diploma", "Diploma|D.Pharm"),
        ("law", "LLB|LLM|BA-LLB"),
        ("medical", "MBBS|BDS"),
        ("design", "B.Des|M.Des|B.F.A"),
        ("hotel", "BHM|Hospitality|Culinary"),
        ("pharmacy", "B.Pharm|D.Pharm|M.Pharm"),
        ("commerce", "B.Com|M.Com|CA-Foundation"),
        ("business", "BBA|MBA|PGDM"),
        ("management", "BBA|MBA|PGDM"),
        ("media", "BJMC|BA-Film|MA-Mass Comm"),
        ("nursing", "Nursing"),
    ),
    name_stops=(
        "of", "and", "in", "at", "the", "institute", "college", "university", "school",
        "technology", "sciences", "polytechnic", "management",
    ),
)

# Phrases that make a mention of the flag word a request to filter on it.
FLAG_PHRASES = (
    "with hostel", "have hostel", "has hostel", "hostel facility", "hostel facilities",
    "hostel available", "hostels available", "having hostel", "accommodation",
)
FLAG_VERBS = "have|has|with|having|available"

# A budget mentioning any of these is for half a year.
HALF_YEAR_TERMS = ("semester", "sem", "half-yearly", "six month")
LAKH = 100_000
PLAIN_BUDGET_MIN = 5_000

SCORE_PREFIXES = r"scored?|score\s*of|marks?|cutoff\s*of|aggregate|got|have"
SCORE_WORDS = ("score", "scor", "marks", "cutoff", "percent", "percentage", "aggregate")
SCORE_RANGE = (30, 100)

PLACEMENT_WORD = "placement"
PLACEMENT_LEADS = r"above|over|greater\s*than|at\s*least|min|minimum|of|package|average|avg|\s"

EXHAUSTIVE_WORDS = "any|every|all|each"

# Model prices in USD per million tokens, and the model assumed when one is not listed.
PRICES = (
    ("gemini-3.1-flash-lite", 0.25, 1.50),
    ("gemini-3.5-flash", 0.30, 2.50),
    ("gemini-flash-latest", 0.30, 2.50),
    ("gemini-2.5-flash", 0.30, 2.50),
    ("gemini-2.5-flash-lite", 0.10, 0.40),
)
DEFAULT_MODEL = "gemini-3.1-flash-lite"
USD_TO_INR = 87.0

EMAIL_MASK = "[EMAIL_MASKED]"
PHONE_MASK = "[PHONE_MASKED]"
ID_MASK = "[AADHAAR_MASKED]"
INCOME_MASK = "[INCOME_MASKED]"

EMPTY_CONTEXT = "(no matching college records were found for this query)"
PROMPT_HEAD = "CONTEXT (retrieved college records, use ONLY these):\n"
PROMPT_QUESTION = "\n\nQUESTION: "
PROMPT_TAIL = "\n\nRespond with only the JSON object described in the system prompt."
NO_MATCH_ANSWER = "No college in our dataset matches that constraint."
NO_MATCH_REASON = "Structured filter (budget/cutoff/type/hostel) matched zero records."
SERVICE_DOWN_ANSWER = "The AI service is temporarily unavailable. Please try again in a moment."
INVALID_REASON = "Model failed schema validation or JSON decoding"

# Spark ML's English stop list (the tests compare it with StopWordsRemover's).
ENGLISH_STOPS = tuple(
    """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that
these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll
i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't
shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
what's when's where's who's why's would
""".split()
)

# ---- end of fixed values ---------------------------------------------------------------

# The catalogue derived from the driver's part table.
PARTS = Vocabulary(
    types=(
        ("economy", "ECONOMY"),
        ("promo", "PROMO"),
        ("standard", "STANDARD"),
    ),
    categories=(
        ("engineering", "Brand#1[0-9]"),
        ("mba", "Brand#2"),
        ("b.tech", "Brand#3|Brand#4"),
        ("law", "economy"),
        ("medical", "PROMO|size 7"),
        ("design", "size 2."),
        ("media", "Brand#9"),
    ),
    name_stops=("of", "and", "the", "small", "ring", "medium", "standard"),
)

# How a field that a record lacks is written in texts.
MISSING = "not stated"
