"""SimHash near-dedup by bit-sliced comparison.

Fingerprints: majority bits of the XXH64 hashes of word shingles. Equal fingerprints are folded first.
Distinct ones are dealt to buckets by the pigeonhole rule: of ``m`` bit blocks at least ``m - radius``
agree between two fingerprints within the radius, so they share a bucket for some choice of that many
blocks. In a bucket the bits are stored vertically, one plane of 64 fingerprints a word for each bit;
differing bits are added up in carry-save counters for 64 pairs at once, rows of pairs are abandoned once
all are beyond the radius, and what is within it is folded to a spanning forest, so that a bucket of n
fingerprints sends on fewer than n links, however many pairs are near. Buckets too large for a task are
cut to tiles, compared pair by pair of tiles.

Defined results: null and empty texts have fingerprint zero and are linked like any other; repeated rows
are separate rows of one group; a group's id is its smallest doc_id, null ids aside; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .arrow_text import pieces, text_column
from .components import components
from .rows import keyed, one_of_each

SHINGLE = 4
RADIUS = 4
SEED = 42
# A bucket is aimed at half of this many fingerprints at most; larger ones are cut to tiles of this size.
TILE = 4096
# Query rows compared with a bucket at once, and planes between two looks for rows to abandon.
STRIP = 512
LOOK = 8


# ---- fingerprints --------------------------------------------------------------------------

# for each byte eight counters, one for each of its bits, in the bytes of a word
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()


def shingle_hashes(text: bytes, width: int = SHINGLE, seed: int = SEED) -> list[bytes]:
    """XXH64 digests (big-endian) of the lower-cased text's shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        return [digest(joined, seed)]
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    return [digest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :])]


def majority(digests: bytes, counts: np.ndarray) -> np.ndarray:
    """Fingerprints (uint64) of consecutive runs of ``counts`` digests: bits set in over half of a run."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    lanes = _LANES[np.frombuffer(digests, np.uint8).reshape(-1, 8)]
    ends = np.cumsum(counts[full])
    starts = ends - counts[full]
    # eight-bit counters hold runs of 255
    parts = -(-counts[full] // 255)
    first = np.concatenate(([0], np.cumsum(parts)[:-1]))
    cuts = np.repeat(starts - first * 255, parts) + np.arange(int(parts.sum())) * 255
    sums = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8)
    totals = np.add.reduceat(sums.astype(np.int32), first, axis=0)
    bits = np.packbits(totals * 2 > counts[full][:, None], axis=1)
    out[full] = bits.view(">u8").ravel()
    return out


def fingerprint_udf(width: int, seed: int):
    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        found = [np.zeros(0, np.uint64)]
        for data, ends in pieces(texts):
            raw = data.tobytes()
            hashes = [shingle_hashes(raw[a:b], width, seed) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
            found.append(majority(b"".join(h for doc in hashes for h in doc), counts))
        return pa.array(np.concatenate(found).view(np.int64))

    return fingerprint


# ---- bit-sliced comparison -----------------------------------------------------------------


def planes(values: np.ndarray) -> np.ndarray:
    """(64, ceil(n / 64)) words: bit i of all values side by side."""
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    padded = np.zeros((64, -(-len(values) // 64) * 64), np.uint8)
    padded[:, : len(values)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def near_pairs(queries: np.ndarray, values: np.ndarray, radius: int):
    """Positions (i, j) of all queries and values within ``radius`` bits, strip by strip."""
    columns = planes(values)
    wide = columns.shape[1]
    size = max(1, radius.bit_length())
    start = (1 << size) - 1 - radius  # so that the carry out of the counter says "beyond the radius"
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    spare = np.zeros(wide * 64, np.uint8)
    spare[len(values) :] = 1
    spare = np.packbits(spare, bitorder="little").view(np.uint64)
    for at in range(0, len(queries), STRIP):
        strip = queries[at : at + STRIP]
        bits = planes(strip)
        own = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[:, : len(strip)]
        masks = own.astype(np.uint64) * ones
        alive = np.arange(len(strip))
        counter = [np.full((len(strip), wide), ones if start >> k & 1 else 0, np.uint64) for k in range(size)]
        beyond = np.broadcast_to(spare, (len(strip), wide)).copy()
        for plane in range(64):
            carry = columns[plane] ^ masks[plane][alive][:, None]
            for k in range(size):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            beyond |= carry
            if plane % LOOK == LOOK - 1:
                stay = (beyond != ones).any(axis=1)
                if not stay.all():
                    alive, beyond = alive[stay], beyond[stay]
                    counter = [c[stay] for c in counter]
                if not len(alive):
                    break
        if len(alive):
            near = np.unpackbits((~beyond).view(np.uint8), axis=1, bitorder="little")
            i, j = np.nonzero(near)
            yield at + alive[i], j


def hook(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Joins the trees of u and v; every node points at its root, the smallest of its tree."""
    while True:
        a, b = parent[u], parent[v]
        open_ = a != b
        if not open_.any():
            return parent
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the near pairs among ``values``: (value, another of its tree)."""
    parent = np.arange(len(values))
    for i, j in near_pairs(values, values, radius):
        later = i < j
        parent = hook(parent, i[later], j[later])
    child = np.flatnonzero(parent != np.arange(len(values)))
    return values[child], values[parent[child]]


def bucket_links(radius: int):
    """Sorted (bucket, fp) rows of a partition -> links. Small buckets are compared together: a pair
    within the radius is a link, whatever bucket it was found in."""

    def links(batches):
        keys, values = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def compare(values):
            a, b = forest(values.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            keys = np.concatenate((keys, np.asarray(batch.column("bucket"))))
            values = np.concatenate((values, np.asarray(batch.column("fp"))))
            ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1  # whole buckets end here
            done = 0
            while True:
                far = ends[ends >= done + STRIP]
                if not len(far):
                    break
                yield compare(values[done : far[0]])
                done = far[0]
            keys, values = keys[done:], values[done:]
        if len(values) > 1:
            yield compare(values)

    return links


def block_count(n: int, radius: int, tile: int = TILE) -> int:
    """Blocks to split 64 bits into, so that an even spread of ``n`` puts half a tile in a bucket at most."""
    m = radius + 1
    while n >> (64 * (m - radius) // m) > tile // 2 and m < 2 * radius + 4:
        m += 1
    return m


def bucket_keys(fp, radius: int, m: int):
    """Array column of bucket numbers: for each choice of m - radius of m blocks, a hash of the choice and
    its bits."""
    edges = [64 * i // m for i in range(m + 1)]
    keys = []
    for k, choice in enumerate(combinations(range(m), m - radius)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in choice)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(signed).cast("long"))))
    return F.array(*keys)


def near_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect all of the distinct ``fp`` of a stored table that lie within ``radius``
    of each other, directly or over others."""
    m = block_count(fps.count(), radius, tile)
    keyed = fps.select("fp", F.explode(bucket_keys(F.col("fp"), radius, m)).alias("bucket"))
    keyed = store(keyed, "buckets")
    large = store(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > tile), "large-buckets")
    if not large.isEmpty():
        parts = F.ceil(F.col("n") / (tile // 2)).cast("int")
        here = F.pmod(F.xxhash64("fp", F.lit(7)), parts).cast("int")
        tiles = keyed.join(large, "bucket").withColumns({"_parts": parts, "_here": here})
        tiles = tiles.withColumn("_there", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        pair = F.xxhash64("bucket", F.least("_here", "_there"), F.greatest("_here", "_there"))
        keyed = keyed.join(large, "bucket", "left_anti").unionByName(tiles.select("fp", pair.alias("bucket")))
    dealt = keyed.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.select("bucket", "fp").mapInArrow(bucket_links(radius), "a long, b long")


# ---- operator ------------------------------------------------------------------------------


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """One slim row per document: keys and fp."""
    udf = fingerprint_udf(width, SEED)
    whole = keyed(docs, doc_id, text).select("_row_id", "_row_hash", text_column(docs, text).alias("_text"))
    return whole.select("_row_id", "_row_hash", udf("_text").alias("fp"))


def grouped(slim: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Adds ``class_fp`` and ``component_id`` to stored fingerprint rows."""
    folded = store(slim.groupBy("fp").agg(F.min("_row_id").alias("least")), "fingerprints")
    linked = components(near_links(folded.select("fp"), radius))
    linked = store(linked.select(F.col("node").alias("fp"), F.col("root").alias("class_fp")), "classes")
    classes = folded.join(linked, "fp", "left").select("fp", "least", F.coalesce("class_fp", "fp").alias("class_fp"))
    least = classes.groupBy("class_fp").agg(F.min("least").alias("component_id"))
    by_fp = classes.join(least, "class_fp").select("fp", "class_fp", "component_id")
    return slim.join(by_fp, "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """A row per document: doc_id, fingerprint (hex), component_id."""
    rows = grouped(store(fingerprints(docs, doc_id, text, width), "slim"), radius)
    return rows.select(
        F.col("_row_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE,
              radius: int = RADIUS) -> DataFrame:
    """One document of each group, that with the smallest id (null ids last), with all its columns."""
    rows = store(grouped(store(fingerprints(docs, doc_id, text, width), "slim"), radius), "grouped")
    return one_of_each(docs, doc_id, text, rows, "class_fp", ["_row_id"])
