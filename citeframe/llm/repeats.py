"""Suffix-array dedup: maximal repeats from interval trees over a sparse enhanced suffix array.

A suffix array over all bytes doesn't fit a shuffle, so suffixes are sampled by content: of each stretch of
``WIDTH - GRAM + 1`` consecutive ``GRAM``-byte strings the one with the smallest hash is an anchor. Equal strings
of ``WIDTH`` bytes hold the same anchor at the same place, so no repeat is missed. The suffixes that begin with
one anchor are one bucket of the suffix array. In a bucket, suffixes are sorted, neighbours' common prefixes
computed, and a stack-scan lists the nodes of the common-prefix interval tree. A node's occurrences agree to the
right for its depth; whether and where they go apart to the left is read off an interval tree over their left
contexts, so that each node there gives one maximal repeat with all its occurrences, not only neighbours.

Before that, occurrences with equal context (all bytes a repeat over this anchor could cover) are folded to one
with a count by a pre-aggregated group-by: most of a large group of copies never meets as rows. Only distinct
contexts of buckets with several of them are compared. A bucket with over ``BUCKET`` distinct contexts is not
gathered: its windows meet by hash over the whole cluster, with the same result.

Defined results: null and empty texts have no bytes and lose none; texts under ``WIDTH`` bytes lose none; repeated
rows are occurrences of each other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .arrow_text import flat, pieces, text_column
from .rows import KEYS, keyed

WIDTH = 200
GRAM = 24
# Distinct contexts of an anchor that a task compares; beyond, windows meet by hash over the cluster,
BUCKET = 4096
# and beyond this many in salted parts.
SPLIT = 1 << 20


# ---- anchors -------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 32-bit hash of the ``gram`` bytes from each position, by joining hashes of halves."""
    mixed = (data.astype(np.uint32) + np.uint32(0x9E37)) * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    size, part, done, total = 1, mixed, 0, None
    while size <= gram:
        if gram & size:
            if total is None:
                total = part
            else:
                n = len(part) - done
                total = total[:n] * np.uint32(0x85EBCA6B) + (part[done:] ^ (part[done:] >> np.uint32(13)))
            done += size
        if len(part) <= size:
            break
        part = part[:-size] * np.uint32(0xC2B2AE35) + (part[size:] ^ (part[size:] >> np.uint32(16)))
        size *= 2
    total = total[: len(data) - gram + 1]
    total = (total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return total ^ (total >> np.uint32(12))


def anchor_positions(data: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """Where the first smallest gram of some window of ``width`` bytes begins."""
    if len(data) < width:
        return np.zeros(0, np.int64)
    hashed = gram_hashes(data, gram)
    best = hashed.astype(np.uint64) << np.uint64(32) | np.arange(len(hashed), dtype=np.uint64)
    span, want = 1, width - gram + 1
    while span < want:  # minima over twice the span until the window is covered
        step = min(span, want - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    at = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    keep = np.ones(len(at), bool)
    keep[1:] = at[1:] != at[:-1]
    return at[keep]


def anchors(docs: DataFrame, doc_id: str, text: str, width: int, gram: int) -> DataFrame:
    """A row per anchor: keys, at, hash of the gram, hash of the context."""

    def scan(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            done = 0
            for data, ends in pieces(batch.column("_text")):
                raw = data.tobytes()
                counts, places, names, contexts = [], [], [], []
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    at = anchor_positions(data[a:b], width, gram)
                    counts.append(len(at))
                    places.append(at)
                    for p in at.tolist():
                        low, high = max(0, p + gram - width), min(b - a, p + width)
                        names.append(digest(raw[a + p : a + p + gram]))
                        # the anchor's place in the context matters near the ends of a text
                        contexts.append(digest(raw[a + low : a + high], p - low))
                rows = pa.array(np.repeat(np.arange(done, done + len(counts)), counts))
                done += len(counts)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(rows) for c in KEYS), pa.array(np.concatenate(places), pa.int32()),
                     pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(np.array(contexts, np.uint64).view(np.int64))],
                    [*KEYS, "at", "anchor", "context"],
                )

    whole = keyed(docs, doc_id, text).select(*KEYS, text_column(docs, text).alias("_text")).where(F.octet_length("_text") >= width)
    return whole.mapInArrow(scan, f"_row_id {dict(whole.dtypes)['_row_id']}, _row_hash long, at int, anchor long, context long")


# ---- interval trees ------------------------------------------------------------------------


def intervals(lcp: np.ndarray, least: int):
    """Stack-scan of ``lcp`` (common prefix of each suffix with the one before it, lcp[0] unused): the nodes
    (depth, first, last) of the interval tree with depth >= least, children before parents."""
    stack = []
    for i, depth in enumerate([*lcp[1:].tolist(), -1], 1):
        first = i - 1
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            if top >= least:
                yield top, first, i - 1
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def padded(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    table = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
    return table, np.fromiter(map(len, strings), np.int64, len(strings))


def common(table: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Common prefix length of each row with the one before; 0 for the first."""
    out = np.zeros(len(table), np.int64)
    if len(table) > 1:
        differs = table[1:] != table[:-1]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), table.shape[1])
        out[1:] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
    return out


def maximal_repeats(lefts: list[bytes], rights: list[bytes], width: int):
    """Maximal repeats of at least ``width`` bytes over one anchor: (bytes left of it, bytes from it on, members).

    ``lefts`` are contexts read backwards from the anchor, ``rights`` forwards.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    suffixes, lengths = padded([rights[i] for i in order], max(map(len, rights)))
    by_left = sorted(range(len(lefts)), key=lefts.__getitem__)
    rank = np.empty(len(lefts), np.int64)
    rank[by_left] = np.arange(len(lefts))
    contexts, sizes = padded([lefts[i] for i in by_left], max(1, max(map(len, lefts))))
    for right, first, last in intervals(common(suffixes, lengths), 1):
        members = np.sort(rank[order[first : last + 1]])
        shared = common(contexts[members], sizes[members])
        # left-extension diversity: each node here has members that differ in the byte before, or end there
        for left, a, b in intervals(shared, max(0, width - right)):
            yield left, right, [by_left[k] for k in members[a : b + 1]]


def bucket_cover(width: int):
    """Sorted (anchor, context, left, right) rows of a partition -> how far from the anchor each context is
    repeated: (anchor, context, before, after)."""

    def cover(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            names = held.column("anchor").to_numpy()
            cut = int(np.searchsorted(names, names[-1])) if len(names) else 0
            if cut:
                yield from solve(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from solve(held)

    def solve(table):
        names = table.column("anchor").to_numpy()
        lefts, rights = table.column("left").to_pylist(), table.column("right").to_pylist()
        before, after = np.full(len(names), -1, np.int32), np.full(len(names), -1, np.int32)
        edges = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1], [True])))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            for left, right, members in maximal_repeats(lefts[a:b], rights[a:b], width) if b - a > 1 else ():
                at = a + np.array(members)
                before[at] = np.maximum(before[at], left)
                after[at] = np.maximum(after[at], right)
        rows = np.flatnonzero(before >= 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[rows]), pa.array(table.column("context").to_numpy()[rows]), pa.array(before[rows]), pa.array(after[rows])],
            ["anchor", "context", "before", "after"],
        )

    return cover


# A crowded anchor's contexts are not gathered. Rows (anchor, place, hash of a string there) of all its contexts are
# sorted instead, and next to each other stand those that hold the same string at the same place.
PLACED = ["anchor", "place", "h1", "h2", "salt"]


def placed(pick, *bounds: str):
    """Contexts -> a row for each (place, string) that ``pick`` lists of left, right and ``bounds``."""

    def explode(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                piece = batch.slice(start, 1000)
                rows, places, digests = [], [], []
                for k, one in enumerate(zip(*(piece.column(c).to_pylist() for c in ("left", "right", *bounds)))):
                    for place, string in pick(*one):
                        rows.append(k)
                        places.append(place)
                        digests.append(xxhash.xxh3_128_digest(string))
                halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c).take(take) for c in ("anchor", "context", "m")), pa.array(places, pa.int32()),
                     pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                    ["anchor", "context", "m", "place", "h1", "h2"],
                )

    return explode


def steps(width: int, gram: int) -> int:
    return max(1, -(-(width - gram) // 8))


def sides(width: int, gram: int):
    """What a context has right of the anchor's start (places above 0) and left of it (below), in steps."""

    def pick(left, right):
        step = steps(width, gram)
        for size in range(gram + step, len(right) + 1, step):
            yield size, right[:size]
        for size in range(step, len(left) + 1, step):
            yield -size, left[:size]

    return pick


def windows(width: int):
    """The windows that reach at most ``low`` bytes before the anchor and ``high`` from it on, by bytes before it."""

    def pick(left, right, low, high):
        whole = left[::-1] + right
        for before in range(max(0, width - high), low + 1):
            start = len(left) - before
            yield before, whole[start : start + width]

    return pick


def neighbours(first: bool):
    """Sorted rows -> those next to one with equal ``PLACED`` and another context; or the first of each ``PLACED``."""

    def mark(batches):
        last, known = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if last is None else pa.concat_tables([last, table])
            columns = {c: table.column(c).to_numpy() for c in (*PLACED, "context")}
            same = np.logical_and.reduce([columns[c][1:] == columns[c][:-1] for c in PLACED])
            hit = np.zeros(table.num_rows, bool)
            if first:
                hit[1:] = ~same
                hit[0] = last is None or known
            else:
                same &= columns["context"][1:] != columns["context"][:-1]
                hit[1:] = same
                hit[:-1] |= same
                hit[0] |= known
            last, known = table.slice(table.num_rows - 1), bool(hit[-1])
            yield from table.slice(0, table.num_rows - 1).filter(pa.array(hit[:-1])).to_batches()
        if last is not None and known:
            yield from last.to_batches()

    return mark


def alike(contexts: DataFrame, explode, split: int) -> DataFrame:
    """(anchor, context, place) of the strings that another context of the anchor has at the same place.

    Anchors with over ``split`` contexts are salted by context; the first rows of their salts meet again without.
    """

    def meet(rows, salt, first):
        rows = rows.withColumn("salt", salt).repartition(*PLACED).sortWithinPartitions(*PLACED, "context")
        return rows.mapInArrow(neighbours(first), rows.schema)

    salt = F.expr(f"pmod(context, ceil(m / {split}))").cast("long")
    near = meet(contexts.mapInArrow(explode, STRINGS), salt, False)
    crowd = meet(contexts.where(F.col("m") > split).mapInArrow(explode, STRINGS), salt, True)
    far = meet(crowd.drop("salt"), F.lit(0).cast("long"), False)
    return near.unionByName(far).select("anchor", "context", "place")


def crowded_cover(contexts: DataFrame, width: int, gram: int, split: int) -> DataFrame:
    """``bucket_cover`` for contexts of crowded anchors, spread over the cluster.

    What a context shares with another on either side of the anchor, in steps, bounds the windows it can share.
    """
    step = steps(width, gram)
    shared = alike(contexts, placed(sides(width, gram)), split)
    reach = shared.groupBy(F.col("anchor").alias("_anchor"), F.col("context").alias("_context")).agg(
        F.max(F.greatest(-F.col("place"), F.lit(0))).alias("_low"), F.max(F.greatest(F.col("place"), F.lit(gram))).alias("_high")
    )
    bounded = contexts.join(reach, (F.col("anchor") == F.col("_anchor")) & (F.col("context") == F.col("_context")), "left")
    bounded = bounded.select(
        *contexts.columns,
        F.least(F.octet_length("left"), F.coalesce("_low", F.lit(0)) + (step - 1)).alias("low"),
        F.least(F.octet_length("right"), F.coalesce("_high", F.lit(gram)) + (step - 1)).alias("high"),
    )
    bounded = store(bounded.where(F.col("low") + F.col("high") >= width), "bounded")
    return alike(bounded, placed(windows(width), "low", "high"), split).groupBy("anchor", "context").agg(
        F.max("place").alias("before"), (F.lit(width) - F.min("place")).cast("int").alias("after")
    )


# ---- operator ------------------------------------------------------------------------------


CONTEXTS = "anchor long, context long, m long, left binary, right binary"
COVER = "anchor long, context long, before int, after int"
STRINGS = "anchor long, context long, m long, place int, h1 long, h2 long"


def cut_contexts(width: int, gram: int):
    """(text, its anchors) -> a row per anchor with its contexts; of repeated rows that share a task, once."""

    def cut(batches):
        seen = set()
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in KEYS)))
            data, ends = flat(batch.column("_text"))
            raw = data.tobytes()
            spots = batch.column("spots")
            for k in range(batch.num_rows):
                if names[k] in seen:
                    continue
                seen.add(names[k])
                text = raw[ends[k] : ends[k + 1]]
                own = spots[k].values
                at = own.field("at").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [*(own.field(c) for c in ("anchor", "context", "m")),
                     pa.array([text[max(0, p + gram - width) : p][::-1] for p in at], pa.binary()),
                     pa.array([text[p : p + width] for p in at], pa.binary())],
                    ["anchor", "context", "m", "left", "right"],
                )

    return cut


def covered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM,
            bucket: int = BUCKET, split: int = SPLIT) -> DataFrame:
    """(keys, start, stop): byte runs of repeated strings, overlapping, for each document that has some."""
    found = store(anchors(docs, doc_id, text, width, gram), "anchors")
    folded = found.groupBy("anchor", "context").agg(
        F.count("*").alias("n"), *[F.first(c).alias(c) for c in (*KEYS, "at")]
    )
    folded = store(folded, "contexts")
    # anchors whose occurrences differ
    several = folded.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1")
    wanted = folded.join(several, "anchor").select("anchor", "context", "m", "at", *[F.col(k).alias(f"{k}_w") for k in KEYS])
    texts = keyed(docs, doc_id, text).select(*KEYS, text_column(docs, text).alias("_text")).where(F.octet_length("_text") >= width)
    same = F.col("_row_id").eqNullSafe(F.col("_row_id_w")) & (F.col("_row_hash") == F.col("_row_hash_w"))
    # of each text once, whatever number of rows repeats it, and all of its anchors
    spots = wanted.groupBy("_row_id_w", "_row_hash_w").agg(F.collect_list(F.struct("at", "anchor", "context", "m")).alias("spots"))
    cut = cut_contexts(width, gram)
    strings = store(texts.join(spots, same).select(*KEYS, "_text", "spots").mapInArrow(cut, CONTEXTS), "strings")
    small = strings.where(F.col("m") <= bucket).repartition("anchor").sortWithinPartitions("anchor")
    answers = small.select("anchor", "context", "left", "right").mapInArrow(bucket_cover(width), COVER)
    large = strings.where(F.col("m") > bucket)
    if not large.isEmpty():
        wide = crowded_cover(large, width, gram, split)
        answers = answers.unionByName(wide)
    # an occurrence with its like elsewhere is repeated as far as its context goes
    full = folded.where("n > 1").select("anchor", "context", F.lit(1 << 30).alias("before"), F.lit(1 << 30).alias("after"))
    answers = answers.unionByName(full).groupBy("anchor", "context").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    marked = found.join(store(answers, "answers"), ["anchor", "context"])
    start = F.greatest(F.col("at") - F.least(F.col("before"), F.lit(width - gram)), F.lit(0))
    return marked.select(*KEYS, start.cast("int").alias("start"), (F.col("at") + F.least(F.col("after"), F.lit(width))).cast("int").alias("stop"))


REMOVAL = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<int>, stops array<int>"


def removal(texts: pa.Array, runs: pa.Array) -> pa.Array:
    """Merges a document's runs and removes them."""
    out = []
    k = 0
    for data, ends in pieces(texts):
        raw = data.tobytes()
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            own, starts, stops = runs[k], [], []
            k += 1
            text = raw[a:b]
            if own.is_valid:
                begin = own.values.field("start").to_numpy(zero_copy_only=False)
                end = np.minimum(own.values.field("stop").to_numpy(zero_copy_only=False), b - a)
                order = np.argsort(begin, kind="stable")
                begin, reach = begin[order], np.maximum.accumulate(end[order])
                new = np.flatnonzero(np.concatenate(([True], begin[1:] > reach[:-1])))
                starts, stops = begin[new].tolist(), reach[np.append(new[1:] - 1, len(reach) - 1)].tolist()
            last, parts = 0, []
            for x, y in zip(starts, stops):
                parts.append(text[last:x])
                last = y
            kept = b"".join([*parts, text[last:]])
            out.append((b - a, b - a - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), starts, stops))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "stops"]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM,
           bucket: int = BUCKET, split: int = SPLIT) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the runs (starts, stops)."""
    runs = covered(docs, doc_id, text, width, gram, bucket, split)
    gathered = runs.groupBy(*KEYS).agg(F.collect_set(F.struct("start", "stop")).alias("_runs"))
    gathered = gathered.select(F.col("_row_id").alias("_i"), F.col("_row_hash").alias("_h"), "_runs")
    own = keyed(docs, doc_id, text).select(*KEYS, text_column(docs, text).alias("_text"))
    joined = own.join(gathered, F.col("_row_id").eqNullSafe(F.col("_i")) & (F.col("_row_hash") == F.col("_h")), "left")
    return joined.select(F.col("_row_id").alias("doc_id"), F.arrow_udf(REMOVAL)(removal)("_text", "_runs").alias("r")).select("doc_id", "r.*")
