"""Language identification: script ranges narrow the candidates of each word, and Viterbi over per-word scores
with a switching penalty labels spans of mixed-language text.

Letters n-grams (3 and 4 bytes, with word borders) are counted by language over a bounded sample of labelled
documents; a word scores the sum of their smoothed log shares. A language that hardly ever writes a word's script
is no candidate for it. The best path over a text's words, where each change of language costs ``PENALTY``, gives
its spans; the language with most words is the text's, and its share of them the score.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any labelled document all
are; ties go to the language first in code-point order; documents with a null language are never learned from;
repeated rows are separate rows with equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import top_k
from ..session import store
from .arrow_text import doc_hash, flat, text_column

UNKNOWN = "und"
# bound of the sample: documents of each language, those with the smallest hash of their id
SAMPLE = 3000
ORDERS = ((3, 15), (4, 18))  # n-gram length, bits of its hash
PENALTY = 12.0
# share of a language's words below which a script is none of its own
RARE_SCRIPT = 0.002
OUT_OF_SCRIPT = -30.0
# words times languages that one search holds
HELD = 1 << 24

# Ranges of UTF-8 lead bytes and the scripts they lead (0: ASCII letters).
LEADS = [
    (0xC3, 0xC9, 1), (0xCA, 0xCD, 0), (0xCE, 0xCF, 2), (0xD0, 0xD4, 3), (0xD5, 0xD6, 4), (0xD7, 0xD7, 5), (0xD8, 0xDD, 6),
    (0xE0, 0xE0, 7), (0xE1, 0xE1, 8), (0xE3, 0xE3, 9), (0xE4, 0xE9, 10), (0xEA, 0xED, 11),
]
SCRIPTS = 12


def _script_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for low, high, script in LEADS:
        table[low : high + 1] = script
    return table


def _letters() -> np.ndarray:
    """Lower-cased letters and bytes beyond ASCII stay; all else is a blank."""
    table = np.full(256, 32, np.uint8)
    for c in range(256):
        if 97 <= c <= 122 or c >= 128:
            table[c] = c
        elif 65 <= c <= 90:
            table[c] = c + 32
    return table


def split_words(data: np.ndarray, ends: np.ndarray):
    """(letters with a blank after each text, word starts, word ends, words of each text)."""
    sizes = np.diff(ends)
    blank = np.full(len(data) + len(sizes) + 1, 32, np.uint8)
    blank[1 + np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = _letters()[data]
    inside = blank != 32
    edge = np.diff(inside.view(np.int8))
    starts, stops = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    texts = ends[1:] + np.arange(1, len(sizes) + 1)  # the blank after each text
    counts = np.diff(np.searchsorted(starts, np.concatenate(([0], texts))))
    return blank, starts, stops, counts


def hashes(text: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Hash of the bytes from each position on."""
    n = len(text) - order + 1
    out = np.zeros(max(n, 0), np.uint32)
    for k in range(order):
        out = out * np.uint32(0x01000193) + text[k : k + n]
    return ((out ^ (out >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def scripts_of(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The highest script of each word: what is written beyond plain letters says most."""
    return np.maximum.reduceat(_script_table()[text], starts) if len(starts) else np.zeros(0, np.uint8)


@dataclass
class Model:
    languages: list[str]
    tables: list[np.ndarray]  # for each order (hash, language) -> log share
    scripts: np.ndarray  # (script, language) -> 0 or OUT_OF_SCRIPT


def learned(doc_id: str = "doc_id") -> Column:
    return ~held_out(doc_id)


def held_out(doc_id: str = "doc_id") -> Column:
    return doc_hash(doc_id) % 4 == 2


def fit(docs: DataFrame, rows: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` documents of each language among ``rows`` of ``docs``."""
    known = docs.where(rows & F.col(lang).isNotNull() & F.col(text).isNotNull())
    ids = known.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.xxhash64(doc_id).alias("_order"))
    # at most sample x languages rows
    chosen = store(top_k(ids, ["_lang"], [F.col("_order"), F.col("_id")], sample).drop("rn", "_order").distinct(), "chosen")
    texts = known.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    texts = store(texts.join(F.broadcast(chosen), ["_id", "_lang"]).select("_lang", "_text"), "learned")
    names = sorted(r["_lang"] for r in texts.select("_lang").distinct().collect())

    def count(batches):
        sums: dict = {}
        for batch in batches:
            langs = np.array(batch.column("_lang").to_pylist(), object)
            data, ends = flat(batch.column("_text"))
            for lang_here in sorted(set(langs)):
                own = np.flatnonzero(langs == lang_here)
                parts = [data[ends[k] : ends[k + 1]] for k in own]
                blank, starts, _, _ = split_words(np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))))
                for o, (order, bits) in enumerate(ORDERS):
                    at = np.flatnonzero(blank[1:] != 32) if len(blank) > order else np.zeros(0, np.int64)
                    at = at[at < len(blank) - order + 1]
                    found = np.bincount(hashes(blank, order, bits)[at], minlength=1 << bits)
                    sums[lang_here, o] = sums.get((lang_here, o), 0) + found
                sums[lang_here, -1] = sums.get((lang_here, -1), 0) + np.bincount(scripts_of(blank, starts), minlength=SCRIPTS)
        for (name, o), found in sums.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_pydict({"l": [name] * len(at), "o": np.full(len(at), o, np.int32), "h": at, "n": found[at].astype(np.int64)})

    counted = texts.mapInArrow(count, "l string, o int, h long, n long").groupBy("l", "o", "h").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # at most languages x hashes rows
    place = {name: k for k, name in enumerate(names)}
    column = np.array([place[x] for x in table.column("l").to_pylist()], np.int64)
    o, h, n = (table.column(c).to_numpy() for c in ("o", "h", "n"))
    tables = []
    for k, (_, bits) in enumerate(ORDERS):
        grid = np.full((1 << bits, len(names)), 0.5)
        grid[h[o == k], column[o == k]] += n[o == k]
        tables.append(np.log(grid / grid.sum(axis=0)).astype(np.float32))
    grid = np.zeros((SCRIPTS, len(names)))
    grid[h[o == -1], column[o == -1]] += n[o == -1]
    own = grid / np.maximum(grid.sum(axis=0), 1) >= RARE_SCRIPT
    own[~own.any(axis=1)] = True  # a script that nobody writes narrows nothing
    return Model(names, tables, np.where(own, 0.0, OUT_OF_SCRIPT).astype(np.float32))


def word_scores(data: np.ndarray, ends: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(word, language) scores of all texts, and words of each text."""
    blank, starts, stops, counts = split_words(data, ends)
    if not len(starts):
        return np.zeros((0, len(model.languages)), np.float32), counts
    total = model.scripts[scripts_of(blank, starts)].copy()
    # n-grams from the blank before a word to its last letter
    tail = np.concatenate((blank, np.full(8, 32, np.uint8)))
    spans = np.stack((starts - 1, stops), axis=1).ravel()
    for table, (order, bits) in zip(model.tables, ORDERS):
        hashed = hashes(tail, order, bits)
        total += np.add.reduceat(table[hashed], np.minimum(spans, len(hashed) - 1), axis=0)[::2]
    return total, counts


def best_paths(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Language number of each word on each text's best path; all texts are walked in step."""
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    lengths = counts[order]
    order_none = int((lengths > 0).sum())
    starts, lengths = starts[:order_none], lengths[:order_none]
    labels = np.zeros(len(scores), np.int16)
    if not order_none:
        return labels
    switched = np.zeros(scores.shape, bool)
    source = np.zeros(len(scores), np.int16)
    steps = int(lengths[0])
    live = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts longer than t
    value = scores[starts].astype(np.float64)
    ends = np.zeros(order_none, np.int64)
    for t in range(1, steps):
        k = live[t]
        if k < len(value):
            ends[k : len(value)] = value[k:].argmax(axis=1)
            value = value[:k]
        at = starts[:k] + t
        top = value.argmax(axis=1)
        other = value[np.arange(k), top] - penalty
        change = other[:, None] > value
        switched[at], source[at] = change, top
        value = np.where(change, other[:, None], value) + scores[at]
        value -= value.max(axis=1, keepdims=True)
    ends[: len(value)] = value.argmax(axis=1)
    current = ends
    for t in range(steps - 1, -1, -1):
        k = live[t]
        at = starts[:k] + t
        labels[at] = current[:k]
        current[:k] = np.where(switched[at, current[:k]], source[at], current[:k])
    return labels


def labeller(spark: SparkSession, model: Model, spans: bool = False):
    """Column function: text -> struct(lang, score) and, if asked for, its spans (lang, words)."""
    shared = spark.sparkContext.broadcast((model.languages, model.tables, model.scripts))
    kind = "lang string, score double" + (", spans array<struct<lang:string,words:int>>" if spans else "")

    @F.arrow_udf(kind)
    def label(texts: pa.Array) -> pa.Array:
        import regex

        fitted = Model(*shared.value)
        names = np.array([*fitted.languages, UNKNOWN], object)
        data, ends = flat(texts)
        langs, shares, runs = [], [], []
        first = 0
        piece = max(1, HELD // max(1, len(fitted.languages)) // 8)
        while first < len(texts):
            # scored in pieces, searched together
            scores, counts, last, held = [], [], first, 0
            while last < len(texts) and (not held or held * max(1, len(fitted.languages)) < HELD):
                upto = min(max(int(np.searchsorted(ends, ends[last] + piece, side="right")) - 1, last + 1), len(texts))
                s, c = word_scores(data[ends[last] : ends[upto]], ends[last : upto + 1] - ends[last], fitted)
                scores.append(s)
                counts.append(c)
                held += len(s)
                last = upto
            scores, counts = np.concatenate(scores), np.concatenate(counts)
            if not fitted.languages:
                counts = np.zeros_like(counts)
            path = best_paths(scores, counts, PENALTY) if len(fitted.languages) else np.zeros(0, np.int16)
            n = len(fitted.languages) or 1
            owner = np.repeat(np.arange(len(counts)), counts)
            votes = np.bincount(owner * n + path[: len(owner)], minlength=len(counts) * n).reshape(-1, n)
            best = np.where(counts > 0, votes.argmax(axis=1), len(fitted.languages))
            share = votes.max(axis=1) / np.maximum(counts, 1)
            for k in range(len(counts)):
                raw = data[ends[first + k] : ends[first + k + 1]]
                # bytes beyond ASCII need not be letters
                plain = ((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 128)
                if counts[k] and not plain.any() and not regex.search(r"\p{L}", raw.tobytes().decode("utf-8", "replace")):
                    best[k], share[k] = len(fitted.languages), 0.0
            langs += names[best].tolist()
            shares.append(np.where(best == len(fitted.languages), 0.0, share))
            if spans:
                bounds = np.concatenate(([0], np.cumsum(counts)))
                for k in range(len(counts)):
                    own = path[bounds[k] : bounds[k + 1]]
                    cuts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True]))) if len(own) else np.zeros(1, int)
                    runs.append([{"lang": names[own[a]], "words": int(b - a)} for a, b in zip(cuts[:-1], cuts[1:])])
            first = last
        arrays = [pa.array(langs, pa.string()), pa.array(np.concatenate(shares) if shares else np.zeros(0))]
        if spans:
            arrays.append(pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))))
        return pa.StructArray.from_arrays(arrays, ["lang", "score", "spans"][: len(arrays)])

    return label


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """A row per document: doc_id, lang_pred, score, and with ``spans`` the runs of words by language."""
    label = labeller(docs.sparkSession, model, spans)
    found = docs.select(F.col(doc_id).alias("doc_id"), label(text_column(docs, text)).alias("p"))
    return found.select("doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), *(["p.spans"] if spans else []))
