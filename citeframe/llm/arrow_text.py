"""Whole texts as flat byte arrays inside Arrow batches, and small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of text that a task works on at once; a longer text is taken alone.
PIECE_BYTES = 4 << 20


def text_column(docs: DataFrame, name: str) -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins and ends; nulls are empty."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    ends = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = plain.buffers()[2]
    if not len(plain) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(plain) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``flat`` of consecutive runs of texts, each run of at most ``limit`` bytes or one text."""
    data, ends = flat(texts)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def runs(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of consecutive runs of texts of at most ``limit`` bytes or one text."""
    _, ends = flat(texts)
    first = 0
    while first < len(texts):
        last = int(ends.searchsorted(ends[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last - first
        first = last


def folding_table(kept: bytes | None = None) -> bytes:
    """256 bytes for ``bytes.translate``: A-Z to a-z; with ``kept``, all ASCII outside it to a space."""
    table = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    if kept is not None:
        for c in range(128):
            if table[c] not in kept:
                table[c] = 32
    return bytes(table)


# Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text: digits, a-z and everything beyond ASCII.
WORD_FOLD = folding_table(b"0123456789abcdefghijklmnopqrstuvwxyz")


def doc_hash(name: str) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which is far faster than numpy's hashing for integers."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    return values[keep]
