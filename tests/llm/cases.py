"""Small tables with every kind of odd row: nulls, empty and very long texts, ties, repeated rows, extra columns
named like the operators' own."""

import random
import re

from pyspark.sql import Row
from pyspark.sql import functions as F

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, fp string, "
    "_row_id string, _found string, bucket long"
)


def prose(seed: int, words: int, letters: str = "abcdefghij") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(words))


def documents(spark, texts):
    """``texts``: (doc_id, text) or (doc_id, text, source)."""
    rows = []
    for k, (i, t, *s) in enumerate(texts):
        rows.append((i, t, "en", s[0] if s else f"s{k % 3}", None if t is None else len(t), 0.5, "d", "f", "r", "x", k))
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts():
    long = prose(1, 30_000)
    passage = prose(2, 80)
    return [
        (10, None), (11, ""), (12, " \t\n"), (13, "..."), (14, "word"), (15, "Word"), (16, "w o r d"),
        (17, long), (18, long + " tail"), (19, prose(3, 40) + " " + passage + " " + prose(4, 60)),
        (20, passage + "\n" + prose(5, 30)), (21, "ÉÈ ßü " + prose(6, 20, "éüñç")), (22, prose(7, 50)), (22, prose(7, 50)),
        (23, prose(7, 50)), (None, prose(7, 50)), (None, prose(8, 50)), (24, prose(8, 50)), (25, "a" * 3000), (26, "ab " * 2000),
        (27, "a" * 3000), (28, "日本語 テキスト です"), (29, "x" * 199), (30, "x" * 199), (31, passage.upper()),
    ]


def odd(spark):
    return documents(spark, odd_texts())


def empty(spark):
    return documents(spark, []).where(F.lit(False))


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def rows(df) -> list[Row]:
    return df.collect()
