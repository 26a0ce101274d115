"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark: ``WINDOW`` consecutive words of an item, or the whole item if it
is shorter. The alphabet is the words of the benchmark, everything else is one letter that no pattern has.
For each pattern length, a block (the last two words of a position) indexes the shift table: how far the
search may jump without missing an occurrence. Where the shift is zero, the block's bucket names the
patterns that end so, and direct comparison confirms them. Stretches of all texts of a batch are searched in
step, one numpy operation for all.

Patterns are searched in shards of bounded size, so what is broadcast doesn't grow with the benchmark; each
further shard is one more pass over the documents, which keeps what was hit under the texts' digests. Which items hold
a pattern is a table of its own that stays distributed: texts name the patterns they hold, and each set of patterns is
looked up once, however many texts hold it.

Defined results: null and empty texts have no words and are clean; null items or items without words have
no windows; items that share an id are one item, a null id counts as the empty text; windows that several
items share, or that overlap, hit a word once and name every item; repeated rows are separate rows with equal
results; a very long text is searched whole, alone in its run; without benchmark rows nothing is hit; extra
columns are ignored by ``report`` and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..session import cut, store
from .arrow_text import WORD_FOLD, distinct, pieces, text_column

WINDOW = 13
# Patterns in a shard; they are broadcast together.
SHARD = 100_000
# End positions of a stretch that one lane of the search walks over.
STRETCH = 512
# Candidates compared at once
COMPARED = 1 << 18
FOUND = "n_words long, starts array<int>, stops array<int>, patterns array<long>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_FOLD).split()


def windows(benchmark: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """Distinct (window, item): a window is its words joined by blanks."""

    def cut(batches):
        for batch in batches:
            found, items = [], []
            for item, whole in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = [w.decode() for w in words_of(whole.encode())]
                if words:
                    for i in range(max(1, len(words) - width + 1)):
                        found.append(" ".join(words[i : i + width]))
                        items.append(item)
            yield pa.RecordBatch.from_pydict({"window": pa.array(found, pa.string()), "item": pa.array(items, pa.string())})

    item = F.coalesce(F.col(item_id).cast("string"), F.lit(""))
    return (
        benchmark.select(item.alias("item"), text_column(benchmark, text).alias("text"))
        .mapInArrow(cut, "window string, item string").distinct()
    )


@dataclass
class Length:
    """Tables for the patterns of one length."""

    size: int
    shift: np.ndarray  # by hashed block
    suffixes: np.ndarray  # sorted blocks that end a pattern
    first: np.ndarray  # where the bucket of each suffix begins among the patterns, and the end
    patterns: np.ndarray  # word ids, sorted by suffix
    numbers: np.ndarray  # of the patterns


class Search:
    """Shift tables and buckets for one shard of patterns."""

    def __init__(self, rows: list[tuple[str, int]]):
        split = [(pattern.encode().split(b" "), number) for pattern, number in rows]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for words, _ in split for w in words}), 1)}
        self.base = len(self.vocabulary) + 1
        self.bits = max(8, min(20, (len(rows) * 16).bit_length()))
        self.lengths = []
        for size in sorted({len(words) for words, _ in split}):
            own = [(words, number) for words, number in split if len(words) == size]
            ids = np.array([[self.vocabulary[w] for w in words] for words, _ in own], np.int64)
            blocks = self.blocks(ids.ravel(), np.arange(ids.size), size > 1).reshape(ids.shape)
            reach = size - 1 if size > 1 else 1
            shift = np.full(1 << self.bits, reach, np.uint8 if reach < 256 else np.int32)
            for k in range(1 if size > 1 else 0, size):  # nearer to the end last: the smallest shift stays
                shift[self.hashed(blocks[:, k])] = size - 1 - k
            order = np.argsort(blocks[:, -1], kind="stable")
            ends = blocks[order, -1]
            suffixes = distinct(ends)
            numbers = np.array([number for _, number in own], np.int64)[order]
            first = np.searchsorted(ends, suffixes)
            self.lengths.append(Length(size, shift, suffixes, np.append(first, len(ends)), ids[order], numbers))

    def blocks(self, ids: np.ndarray, at: np.ndarray, pair: bool) -> np.ndarray:
        return ids[np.maximum(at - 1, 0)] * self.base + ids[at] if pair else ids[at]

    def hashed(self, blocks: np.ndarray) -> np.ndarray:
        mixed = blocks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def candidates(self, table: Length, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Positions of last words where the shift is zero. ``ends``: where each text begins and ends."""
        low, high = ends[:-1] + table.size - 1, ends[1:]
        parts = -(-np.maximum(high - low, 0) // STRETCH)
        lane = np.repeat(np.arange(len(low)), parts)
        step = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        at = low[lane] + step * STRETCH
        stop = np.minimum(at + STRETCH, high[lane])
        found = [np.zeros(0, np.int64)]
        while len(at):
            jump = table.shift[self.hashed(self.blocks(ids, at, table.size > 1))].astype(np.int64)
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return np.concatenate(found)

    def occurrences(self, ids: np.ndarray, ends: np.ndarray):
        """(start, table, place of the pattern in it) of all occurrences."""
        for table in self.lengths:
            at = np.sort(self.candidates(table, ids, ends))
            blocks = self.blocks(ids, at, table.size > 1)
            bucket = np.minimum(np.searchsorted(table.suffixes, blocks), len(table.suffixes) - 1)
            real = table.suffixes[bucket] == blocks
            at, bucket = at[real], bucket[real]
            sizes = table.first[bucket + 1] - table.first[bucket]
            # compare a bounded number of (position, pattern) at a time
            before = np.cumsum(sizes) - sizes
            group = before // COMPARED
            for g in distinct(group).tolist():
                own = group == g
                which = np.repeat(np.flatnonzero(own), sizes[own])
                inner = np.arange(len(which)) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
                pattern = table.first[bucket[which]] + inner
                start = at[which] - table.size + 1
                same = np.ones(len(which), bool)
                for k in range(table.size):
                    live = np.flatnonzero(same)
                    same[live] = ids[start[live] + k] == table.patterns[pattern[live], k]
                yield start[same], table, pattern[same]


# The tables of the shard that this Python worker searches, by the shard's name
_built: dict[str, Search | None] = {}


def tables_of(name: str, rows) -> Search | None:
    """Tables of a broadcast shard, built once in each worker, not for each batch; the shard before goes. None if there
    are no patterns."""
    if name not in _built:
        _built.clear()
        _built[name] = Search(rows.value) if rows.value else None
    return _built[name]


def _searcher(rows):
    """Function from (texts, what earlier shards found) to what is found so far."""
    name = uuid.uuid4().hex

    def search(texts: pa.Array, earlier: pa.Array) -> pa.Array:
        tables = tables_of(name, rows)
        get = tables.vocabulary.get if tables else None
        out = []
        past = earlier.to_pylist()
        for data, ends in pieces(texts):
            raw = data.tobytes()
            split = [words_of(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            counts = np.fromiter(map(len, split), np.int64, len(split))
            bounds = np.concatenate(([0], np.cumsum(counts)))
            total = int(bounds[-1])
            hit = np.zeros(total + 1, np.int32)
            held: dict[int, set] = {}
            if tables and total:
                ids = np.fromiter((get(w, 0) for doc in split for w in doc), np.int64, total)
                for start, table, pattern in tables.occurrences(ids, bounds):
                    np.add.at(hit, start, 1)
                    np.add.at(hit, start + table.size, -1)
                    doc = np.searchsorted(bounds, start, side="right") - 1
                    pairs = distinct(doc * len(table.numbers) + pattern)
                    for d, k in zip((pairs // len(table.numbers)).tolist(), table.numbers[pairs % len(table.numbers)].tolist()):
                        held.setdefault(d, set()).add(k)
            covered = np.zeros(total + 2, np.int8)
            covered[1:-1] = np.cumsum(hit[:-1]) > 0
            for k in range(len(split)):
                before = past[len(out)]
                a, b = int(bounds[k]), int(bounds[k + 1])
                own = covered[a + 1 : b + 1].astype(bool)
                if before is not None:
                    for x, y in zip(before["starts"], before["stops"]):
                        own[x:y] = True
                if own.any():
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
                    numbers = held.get(k, set()) | set(before["patterns"] if before else ())
                    out.append((b - a, edges[::2], edges[1::2], sorted(numbers)))
                else:
                    out.append((b - a, (), (), ()))
        lists = [pa.array([list(r[i]) for r in out], pa.list_(pa.int32())) for i in (1, 2)]
        numbers = pa.array([list(r[3]) for r in out], pa.list_(pa.int64()))
        return pa.StructArray.from_arrays(
            [pa.array([r[0] for r in out], pa.int64()), *lists, numbers], ["n_words", "starts", "stops", "patterns"]
        )

    return F.arrow_udf(FOUND)(search)


def numbered(pairs: DataFrame) -> DataFrame:
    """Distinct patterns with numbers that stay."""
    return store(pairs.select("window").distinct().select("window", F.monotonically_increasing_id().alias("pattern")), "windows")


def annotate(docs: DataFrame, patterns: DataFrame, spread: Sequence[str], text: str = "text", shard: int = SHARD) -> DataFrame:
    """``docs`` with ``_found``: number of words, hit runs of words, and the patterns that occur. Rows of a text that very
    many share are dealt out by ``spread``."""
    spark = docs.sparkSession
    shards = max(1, -(-patterns.count() // shard))
    nothing = F.lit(None).cast(f"struct<{', '.join(x.replace(' ', ':', 1) for x in FOUND.split(', '))}>")

    def search(k: int):
        part = patterns.where(F.pmod(F.xxhash64("window"), F.lit(shards)) == k) if shards > 1 else patterns
        return _searcher(spark.sparkContext.broadcast([(r["window"], r["pattern"]) for r in part.collect()]))

    whole = text_column(docs, text)
    if shards == 1:
        return docs.withColumn("_found", search(0)(whole, nothing))
    digest = F.sha2(whole.cast("binary"), 256)
    hits = []
    for k in range(1, shards):
        found = docs.select(digest.alias("_digest"), search(k)(whole, nothing).alias("_found")).where(F.size("_found.starts") > 0)
        # equal texts are hit alike
        hits.append(store(found.dropDuplicates(["_digest"]), "searched"))
    joined = {c: F.flatten(F.collect_list(f"_found.{c}")) for c in ("starts", "stops", "patterns")}
    once = F.struct(F.max("_found.n_words").alias("n_words"), *[c.alias(n) for n, c in joined.items()])
    hits = reduce(DataFrame.union, hits).groupBy("_digest").agg(once.alias("_earlier"))
    out = lookup_join(docs.withColumn("_digest", digest), cut(hits), ["_digest"], spread, "left")
    return out.withColumn("_found", search(0)(text_column(out, text), F.col("_earlier"))).drop("_digest", "_earlier")


def _hit_words(found: str):
    return F.aggregate(F.zip_with(f"{found}.starts", f"{found}.stops", lambda a, b: b - a), F.lit(0), lambda x, y: x + y)


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", width: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    pairs = store(windows(benchmark, item_id, item_text, width), "pairs")
    patterns = numbered(pairs)
    owners = pairs.join(patterns, "window").select("pattern", "item")
    slim = docs.select(F.col(doc_id).alias("doc_id"), text_column(docs, text).alias("text"))
    found = annotate(slim, patterns, ["doc_id"], "text", shard)
    held = F.when(F.size("_found.patterns") > 0, F.sha2(F.array_join("_found.patterns", ",").cast("binary"), 256))
    found = store(found.select(
        "doc_id", "_found.n_words", _hit_words("_found").cast("long").alias("n_hit"), held.alias("held"), "_found.patterns"), "found")
    sets = found.where("held is not null").select("held", "patterns").dropDuplicates(["held"])
    sets = sets.select("held", F.explode("patterns").alias("pattern")).join(owners, "pattern").select("held", "item").distinct()
    sets = sets.groupBy("held").agg(F.sort_array(F.collect_list("item")).alias("items"))
    sets = cut(sets.select("held", F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items")).select(
        "held", "n_items", F.sha2(F.col("items").cast("binary"), 256).alias("items_sha256")))
    out = lookup_join(found.drop("patterns"), sets, ["held"], ["doc_id", "n_words", "n_hit"], "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(
        "doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
          width: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    whole = docs.select(F.struct("*").alias("_doc"), text_column(docs, text).alias("_whole"))
    spread = [f"_doc.`{c}`" for c, kind in docs.dtypes if c != text and "map<" not in kind] or ["_whole"]
    found = annotate(whole, numbered(windows(benchmark, item_id, item_text, width)), spread, "_whole", shard)
    n_hit = _hit_words("_found")
    return found.where((n_hit == 0) | (20 * n_hit < F.col("_found.n_words"))).select("_doc.*")
