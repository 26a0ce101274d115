"""Fill-in-middle transformation as a pyarrow.compute pipeline.

A text is cut into units (blanks and the word after them; blanks at the end). Per batch, all units of all
texts are one flat array with parent indices; a unit's ordinal is its place after its parent's first. Ordinals
against the two cuts of a text give each unit's role; per role the units are filtered, rebuilt into lists and
joined, so that every text has a prefix, a middle and a suffix, and the pieces are put together with their
marks by ``binary_join_element_wise``. Draws are digits of a hash of seed and id, so reruns agree.

Defined results: a null text is an empty one; empty texts and texts that contain a mark are plain, as are
those the draw leaves; a null id counts as the empty text; repeated rows give equal rows; texts of any length are
worked on whole (a batch is taken in runs of bounded size, a longer text alone); an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import runs, text_column

SEED = 42
# Per cent of texts that are transformed, and of these, that put the suffix first.
RATE = 50
SUFFIX_FIRST = 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Bytes of text that are worked on at once
RUN_BYTES = 4 << 20
# A unit ends where a blank follows a word. The separator is made free of use first: "\x1d" and "\x1e" of a text
# become "\x1d0" and "\x1d1", which are no blanks either.
UNIT = r"([ \t-\r]*[^ \t-\r]+)"
FORM = "n long, form string, prefix_chars long, middle_chars long, output string"


def unit_lists(texts: pa.Array) -> pa.Array:
    """Each text's units, escaped; the last piece of a list is empty unless the text ends in blanks."""
    free = pc.replace_substring(pc.replace_substring(texts, "\x1d", "\x1d0"), "\x1e", "\x1d1")
    return pc.split_pattern(pc.replace_substring_regex(free, UNIT, "\\1\x1e"), "\x1e")


def plain_units(texts: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(texts, "\x1d1", "\x1e"), "\x1d0", "\x1d")


def joined(units: pa.Array, parents: pa.Array, chosen: pa.Array, n: int) -> pa.Array:
    """The chosen units of each of ``n`` texts in one string."""
    counts = pc.value_counts(pc.filter(parents, chosen))
    at = pc.index_in(pa.array(np.arange(n)), counts.field("values"))
    sizes = pc.fill_null(pc.take(counts.field("counts"), at), 0)
    ends = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
    return plain_units(pc.binary_join(pa.ListArray.from_arrays(ends, pc.filter(units, chosen)), ""))


def transformed(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array, rate: int, suffix_first: int) -> pa.Array:
    """The struct ``FORM`` for each text; no nulls."""
    rows = len(texts)
    lists = unit_lists(texts)
    units, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(units, "")
    units, parents = pc.filter(units, real), pc.filter(parents, real)
    counts = pc.value_counts(parents)
    n = pc.fill_null(pc.take(counts.field("counts"), pc.index_in(pa.array(np.arange(rows)), counts.field("values"))), 0)
    firsts = pc.subtract(pc.cumulative_sum(n), n)
    ordinals = pc.subtract(pa.array(np.arange(len(units))), pc.take(firsts, parents))

    def remainder(value, by):
        return pc.subtract(value, pc.multiply(pc.divide(value, by), by))

    one_cut, other_cut = remainder(h1, pc.add(n, 1)), remainder(h2, pc.add(n, 1))
    low, high = pc.min_element_wise(one_cut, other_cut), pc.max_element_wise(one_cut, other_cut)
    before, behind = pc.less(ordinals, pc.take(low, parents)), pc.greater_equal(ordinals, pc.take(high, parents))
    between = pc.and_not(pc.invert(before), behind)
    prefix, middle, suffix = (joined(units, parents, chosen, rows) for chosen in (before, between, behind))

    marked = pc.or_(pc.match_substring(texts, PREFIX), pc.or_(pc.match_substring(texts, SUFFIX), pc.match_substring(texts, MIDDLE)))
    left = pc.greater_equal(remainder(h3, pa.scalar(100, pa.int64())), rate)
    plain = pc.or_(pc.or_(pc.equal(texts, ""), marked), left)
    spm = pc.less(remainder(h4, pa.scalar(100, pa.int64())), suffix_first)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    psm_text = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm_text = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    output = pc.if_else(plain, texts, pc.if_else(spm, spm_text, psm_text))
    none = pa.scalar(None, pa.int64())
    sizes = [pc.if_else(plain, none, pc.utf8_length(part).cast(pa.int64())) for part in (prefix, middle)]
    return pa.StructArray.from_arrays([n, form, *sizes, output], ["n", "form", "prefix_chars", "middle_chars", "output"])


def draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hash of seed and id, as unsigned integers."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE,
              suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """A row per document: doc_id, n (units), form (plain, spm or psm), prefix_chars, middle_chars (code points, null
    if plain) and output (the transformed text)."""

    @F.arrow_udf(FORM)
    def fim(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        texts = texts.cast(pa.string())
        parts = [
            transformed(texts.slice(a, size), *(h.slice(a, size) for h in (h1, h2, h3, h4)), rate, suffix_first)
            for a, size in runs(texts, RUN_BYTES)
        ]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([
            ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()),
        ]))

    whole = docs.select(F.col(doc_id).alias("_id"), text_column(docs, text).alias("_text"))
    made = whole.select(F.col("_id").alias("doc_id"), fim("_text", *draws(F.col("_id"), seed)).alias("_fim"))
    return made.select("doc_id", "_fim.*")


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of. Marks are unambiguous: a text that contains one is plain."""
    p, s, m = (F.locate(mark, output) for mark in (PREFIX, SUFFIX, MIDDLE))
    size, rest = len(PREFIX), F.length(output)

    def piece(start: Column, stop: Column) -> Column:
        return F.substring(output, start + size, stop - start - size)

    psm = F.concat(piece(p, s), piece(m, rest + 1), piece(s, m))
    spm = F.concat(piece(p, m), piece(m, rest + 1), piece(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
