"""Cross-tokenizer alignment by inverted pair bitmaps.

Each text is cut by two tokenizers. Byte offsets where tokens of both end cut it into groups; all A-B token
occurrence pairs of a group are links. A block of documents is inverted at once: each id pair linked in it gets a
compressed bitmap of the block's documents (16-bit places where sparse, a bit set where dense), plane 0, and
planes for how often: plane j has the documents whose multiplicity less one has bit j - 1. Bitmaps of runs of a block
are OR-merged, and popcounts are added up over blocks: plane 0 gives the documents of a pair, all planes with
their weights its links. The scores of pairs return over the same postings: each bitmap hands its pair's score to
its documents, so no list of a document's links is ever stored.

Defined results: texts that are null or empty, or whose tokens of either kind do not spell the text (one that contains
the word mark U+2581, for instance), have no tokens: zeros and an empty digest; strings of special tokens inside
texts are plain text; repeated rows are separate documents; ties for the best pair all count; whole texts of any length
are tokenised, a longer one in a block of its own; groups of many tokens are paired by distinct ids with their
counts; a null id stays null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..session import store
from .arrow_text import runs, text_column

VOCABULARIES = "/opt/tokenizers"
BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
WORD_MARK = "▁"
# A pair of ids is one number: a << B_BITS | b. The place of a document in its block has PLACE_BITS.
B_BITS, PLACE_BITS = 16, 16
# Text and documents of a block, and text tokenised at once
BLOCK_BYTES, BLOCK_DOCS, RUN_BYTES = 8 << 20, 1 << PLACE_BITS, 1 << 18
# Links of a group that are written out one by one; larger groups are paired by distinct ids.
WRITTEN_OUT = 4096
# Bit sets unpacked at once
UNPACKED = 1024
# Small tables are replicated up to this payload.
REPLICATED = 1 << 20


# ---- tokenizers ----------------------------------------------------------------------------

# How a byte-level vocabulary splits a text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Characters whose classes (letter, number, blank) no edition of the character tables disagrees about
SETTLED = re.compile(
    "[\t\n\r -~\u00a1-\u02af\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u0513\u05d0-\u05ea\u0621-\u063a\u0641-\u064a"
    "\u0904-\u0939\u0e01-\u0e30\u2010-\u2027\u2030-\u205e\u3001-\u3003\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*"
)


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as itself and the others as characters from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers in a worker, built from the contents of their files.

    Texts of settled characters go through a faster engine with the same vocabulary, where the vocabulary says that
    both must agree: merges in the order of ids, the plain byte-level split, nothing else done to a text.
    """

    def __init__(self, byte_json: bytes, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_json.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=piece_model)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        spelled = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            spelled[number] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.a_bytes = spelled
        pieces = ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(WORD_MARK, " ").encode() for i, p in pieces
        ]
        self.fast = self.same_engine(json.loads(byte_json))
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        if len(self.a_bytes) > 1 << (63 - B_BITS - PLACE_BITS) or len(self.b_bytes) > 1 << B_BITS:
            raise ValueError("a vocabulary is too large for the numbers of pairs")

    def same_engine(self, file: dict):
        import tiktoken

        model, split = file["model"], file["pre_tokenizer"] or {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        first = len(model["vocab"]) - len(merges) - sum(t in model["vocab"] for t in (x["content"] for x in file["added_tokens"]))
        agree = (
            model["type"] == "BPE" and not file["normalizer"] and not any(model.get(k) for k in ("dropout", "unk_token", "ignore_merges"))
            and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
            and all(model["vocab"].get("".join(m)) == first + k for k, m in enumerate(merges))
        )
        if not agree:
            return None
        ranks = {spelled: i for i, spelled in enumerate(self.a_bytes[: first + len(merges)])}
        return tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        quick = [self.fast is not None and SETTLED.fullmatch(t) is not None for t in texts]
        slow = iter(self.a.encode_batch_fast([t for t, q in zip(texts, quick) if not q], add_special_tokens=False))
        return [self.fast.encode_ordinary(t) if q else next(slow).ids for t, q in zip(texts, quick)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for each text; none where either doesn't spell it."""
        spaced = [" " + t for t in texts]
        out = []
        for text, whole, one, two in zip(texts, spaced, self.encode_a(spaced), self.b.encode(texts, num_threads=1)):
            raw = whole.encode()
            spells = text and all(
                raw == b"".join(map(table.__getitem__, ids)) for table, ids in ((self.a_bytes, one), (self.b_bytes, two))
            )
            out.append((np.array(one if spells else [], np.int64), np.array(two if spells else [], np.int64)))
        return out


# ---- a run of texts ------------------------------------------------------------------------


@dataclass
class Run:
    """Documents of a run and its postings: sorted (pair, place) as one number, and multiplicities."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    keys: np.ndarray
    times: np.ndarray


def folded(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their times added up."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.concatenate((first, [len(keys)])))


def pair_keys(a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (a << B_BITS | b) << PLACE_BITS | place


def spelled_groups(names: list[str], a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, cuts: np.ndarray) -> list[str]:
    """Digests of the documents' groups, written ``a1,a2|b1;a3|b2``. ``of_*``: group of each token; ``cuts``: where
    each document's tokens end among all."""
    order = np.argsort(np.concatenate((of_a * 2, of_b * 2 + 1)), kind="stable")
    part = np.concatenate((of_a * 2, of_b * 2 + 1))[order]
    last = np.concatenate((part[1:] != part[:-1], [True]))
    ids = np.concatenate((a, b))[order]
    # names: ids followed by a comma, then those that end a group's A side, then those that end a group
    written = list(map(names.__getitem__, (ids + np.where(last, 1 + (part & 1), 0) * (len(names) // 3)).tolist()))
    out, start = [], 0
    for stop in cuts.tolist():
        text = "".join(written[start:stop])
        out.append(hashlib.sha256(text[:-1].encode()).hexdigest() if stop > start else "")
        start = stop
    return out


def run_of(encoded: list[tuple[np.ndarray, np.ndarray]], first_place: int, tokenizers: Tokenizers, names: list[str]) -> Run:
    n_a = np.fromiter((len(x) for x, _ in encoded), np.int64, len(encoded))
    n_b = np.fromiter((len(y) for _, y in encoded), np.int64, len(encoded))
    a, b = (np.concatenate([side[k] for side in encoded] + [np.zeros(0, np.int64)]) for k in (0, 1))
    if not len(a):
        zero = np.zeros(len(encoded), np.int64)
        return Run(n_a, n_b, zero, zero, [""] * len(encoded), a, a)
    doc_a = np.repeat(np.arange(len(encoded)), n_a)
    # both spell the same bytes, so offsets may run on over the documents, whose ends are common
    a_end, b_end = np.cumsum(tokenizers.a_sizes[a]), np.cumsum(tokenizers.b_sizes[b])
    at = np.searchsorted(b_end, a_end)
    common = b_end[at] == a_end
    ends_b = np.zeros(len(b), np.int64)
    ends_b[at[common]] = 1
    of_a, of_b = np.cumsum(common) - common, np.cumsum(ends_b) - ends_b
    size_a, size_b = np.bincount(of_a), np.bincount(of_b)
    links = size_a * size_b
    group_doc = doc_a[np.flatnonzero(common)]
    n_groups = np.bincount(group_doc, minlength=len(encoded))
    n_links = np.zeros(len(encoded), np.int64)
    np.add.at(n_links, group_doc, links)

    first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    small = links[of_a] <= WRITTEN_OUT
    each = np.where(small, size_b[of_a], 0)
    step = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    partner = b[np.repeat(first_b[of_a], each) + step]
    keys, times = counted(pair_keys(np.repeat(a, each), partner, np.repeat(doc_a + first_place, each)))
    for g in np.flatnonzero(links > WRITTEN_OUT).tolist():
        x, nx = np.unique(a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
        y, ny = np.unique(b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
        place = np.full(len(x) * len(y), group_doc[g] + first_place)
        more = pair_keys(np.repeat(x, len(y)), np.tile(y, len(x)), place)
        keys, times = folded(np.concatenate((keys, more)), np.concatenate((times, np.outer(nx, ny).ravel())))
    digests = spelled_groups(names, a, b, of_a, of_b, np.cumsum(n_a + n_b))
    return Run(n_a, n_b, n_groups, n_links, digests, keys, times)


# ---- bitmaps -------------------------------------------------------------------------------


def bitmaps(pairs: np.ndarray, places: np.ndarray, docs: int):
    """Sorted (pair, place) -> batches of (pairs, dense, n, binary bitmaps)."""
    if not len(pairs):
        return
    first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    n = np.diff(np.concatenate((first, [len(pairs)])))
    dense = n * PLACE_BITS > docs
    stays = np.repeat(~dense, n)
    ends = np.concatenate(([0], np.cumsum(n[~dense]))) * 2
    packed = np.ascontiguousarray(places[stays].astype("<u2"))
    if (~dense).any():
        bodies = pa.Array.from_buffers(
            pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(packed)]
        )
        yield pairs[first[~dense]], False, n[~dense], bodies.cast(pa.binary())
    which = np.flatnonzero(dense)
    for at in range(0, len(which), UNPACKED):
        rows = which[at : at + UNPACKED]
        bits = np.zeros((len(rows), docs), np.uint8)
        for k, r in enumerate(rows.tolist()):
            bits[k, places[first[r] : first[r] + n[r]]] = 1
        sets = np.packbits(bits, axis=1, bitorder="little")
        yield pairs[first[rows]], True, n[rows], pa.array([s.tobytes() for s in sets], pa.binary())


def planes_of(keys: np.ndarray, times: np.ndarray, docs: int):
    """All bitmaps of a block: (plane, pairs, dense, n, bitmaps)."""
    pairs, places = keys >> PLACE_BITS, keys & (BLOCK_DOCS - 1)
    more = times - 1
    plane = 0
    chosen = np.ones(len(keys), bool)
    while True:
        for found in bitmaps(pairs[chosen], places[chosen], docs):
            yield plane, *found
        if not (more >> plane).any():
            return
        chosen = (more >> plane & 1).astype(bool)
        plane += 1


def weight(plane):
    """How many links of a document a bit of a plane stands for."""
    return F.pow(F.lit(2), F.greatest(plane - 1, F.lit(0))).cast("long")


# ---- operator ------------------------------------------------------------------------------

DOCUMENT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
POSTING = "pair long, plane int, dense boolean, n long, docs binary"


def inverted(docs: DataFrame, doc_id: str, text: str, folder: str) -> DataFrame:
    """Stored rows of two kinds: documents (block, place, doc_id, DOCUMENT) and postings (block, POSTING)."""
    spark = docs.sparkSession
    # two vocabulary files of fixed size
    files = spark.sparkContext.broadcast([(Path(folder) / name).read_bytes() for name in (BYTE_FILE, PIECE_FILE)])
    whole = docs.select(F.col(doc_id).alias("_id"), text_column(docs, text).alias("_text"))
    kind = whole.schema["_id"].dataType.simpleString()

    def invert(batches):
        tokenizers = Tokenizers(*files.value)
        ids = [str(i) for i in range(max(len(tokenizers.a_bytes), len(tokenizers.b_bytes)))]
        names = [i + mark for mark in ",|;" for i in ids]
        part = TaskContext.get().partitionId()
        schema = None
        block, docs_in, bytes_in, keys, times = 0, 0, 0, [], []

        def number():
            return part << 32 | block

        def flushed():
            nonlocal block, docs_in, bytes_in, keys, times
            merged = folded(np.concatenate(keys), np.concatenate(times)) if keys else None
            if merged is not None:
                for plane, pairs, dense, n, bodies in planes_of(*merged, docs_in):
                    yield {"block": pa.array(np.full(len(pairs), number())), "pair": pa.array(pairs),
                           "plane": pa.array(np.full(len(pairs), plane, np.int32)), "dense": pa.array([dense] * len(pairs)),
                           "n": pa.array(n), "docs": bodies}
            block, docs_in, bytes_in, keys, times = block + 1, 0, 0, [], []

        def rows(columns):
            size = len(columns["block"])
            return pa.RecordBatch.from_arrays(
                [columns.get(f.name, pa.nulls(size, f.type)).cast(f.type) for f in schema], schema=schema
            )

        for batch in batches:
            if schema is None:
                schema = pa.schema([
                    ("block", pa.int64()), ("place", pa.int32()), ("_id", batch.schema.field("_id").type), ("n_a", pa.int64()),
                    ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                    ("pair", pa.int64()), ("plane", pa.int32()), ("dense", pa.bool_()), ("n", pa.int64()), ("docs", pa.binary()),
                ])
            for at, size in runs(batch.column("_text"), RUN_BYTES):
                texts = batch.column("_text").slice(at, size)
                room = sum(map(len, texts.to_pylist()))
                if docs_in and (bytes_in + room > BLOCK_BYTES or docs_in + size > BLOCK_DOCS):
                    yield from map(rows, flushed())
                run = run_of(tokenizers.encode(texts.to_pylist()), docs_in, tokenizers, names)
                yield rows({
                    "block": pa.array(np.full(size, number())), "place": pa.array(np.arange(docs_in, docs_in + size, dtype=np.int32)),
                    "_id": batch.column("_id").slice(at, size), "n_a": pa.array(run.n_a), "n_b": pa.array(run.n_b),
                    "n_groups": pa.array(run.n_groups), "n_links": pa.array(run.n_links), "groups_sha256": pa.array(run.groups, pa.string()),
                })
                keys.append(run.keys)
                times.append(run.times)
                docs_in, bytes_in = docs_in + size, bytes_in + room
        if docs_in:
            yield from map(rows, flushed())

    made = whole.mapInArrow(invert, f"block long, place int, _id {kind}, {DOCUMENT}, {POSTING}")
    return store(made, "inverted")


def pair_counts(postings: DataFrame) -> DataFrame:
    """Stored (pair, a, b, docs, links, best): over the corpus, in how many documents a pair is linked, how often, and
    whether no pair of its A id is in more."""
    popcount = F.col("n")
    sums = postings.groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == 0, popcount)).alias("docs"), F.sum(popcount * weight(F.col("plane"))).alias("links")
    )
    sums = store(sums.withColumns({"a": F.shiftright("pair", B_BITS), "b": F.col("pair").bitwiseAND((1 << B_BITS) - 1)}), "sums")
    # a row for each A id: at most the vocabulary
    most = F.broadcast(sums.groupBy("a").agg(F.max("docs").alias("most")))
    return store(sums.join(most, "a").select("pair", "a", "b", "docs", "links", (F.col("docs") == F.col("most")).alias("best")), "pairs")


def returned(scored: DataFrame) -> DataFrame:
    """Scored postings -> (block, place, n_best, count_sum) of the documents that have any."""

    def hand_out(batches):
        block, total, best = None, None, None

        def rows():
            found = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), block)), pa.array(found.astype(np.int32)), pa.array(best[found]), pa.array(total[found])],
                ["block", "place", "n_best", "count_sum"],
            )

        for batch in batches:
            blocks = np.asarray(batch.column("block"))
            cuts = np.concatenate(([0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(blocks)]))
            for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if start == stop:
                    continue
                if blocks[start] != block:
                    if block is not None:
                        yield rows()
                    block, total, best = int(blocks[start]), np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
                part = batch.slice(start, stop - start)
                gain, top = np.asarray(part.column("gain")), np.asarray(part.column("top"))
                dense = np.asarray(part.column("dense").cast(pa.uint8())).astype(bool)
                bodies = part.column("docs").to_pylist()
                thin = np.flatnonzero(~dense)
                places = np.frombuffer(b"".join([bodies[k] for k in thin.tolist()]), "<u2")
                each = np.fromiter((len(bodies[k]) // 2 for k in thin.tolist()), np.int64, len(thin))
                # sums of integers below 2^53, exact as doubles
                total += np.bincount(places, np.repeat(gain[thin], each), BLOCK_DOCS).astype(np.int64)
                best += np.bincount(places, np.repeat(top[thin], each), BLOCK_DOCS).astype(np.int64)
                wide = np.flatnonzero(dense)
                for at in range(0, len(wide), UNPACKED):
                    own = wide[at : at + UNPACKED]
                    sets = np.frombuffer(b"".join([bodies[k] for k in own.tolist()]), np.uint8).reshape(len(own), -1)
                    bits = np.unpackbits(sets, axis=1, bitorder="little")
                    width = bits.shape[1]
                    total[:width] += (gain[own] @ bits).astype(np.int64)
                    best[:width] += (top[own] @ bits).astype(np.int64)
        if block is not None:
            yield rows()

    dealt = scored.repartition("block").sortWithinPartitions("block").select("block", "gain", "top", "dense", "docs")
    return dealt.mapInArrow(hand_out, "block long, place int, n_best long, count_sum long")


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = VOCABULARIES) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and what
    ``pair_counts`` gives."""
    made = inverted(docs, doc_id, text, folder)
    postings = made.where("pair is not null").select("block", "pair", "plane", "dense", "n", "docs")
    pairs = pair_counts(postings)
    scores = store(pairs.select("pair", F.col("docs").alias("count"), "best"), "scores")
    met = lookup_join(postings, scores, ["pair"], ["block"], limit=REPLICATED)
    per_bit = weight(F.col("plane"))
    scored = met.select(
        "block", "dense", "docs", (F.col("count") * per_bit).alias("gain"), F.when(F.col("best"), per_bit).otherwise(0).cast("long").alias("top")
    )
    rows = made.where("pair is null").select("block", "place", F.col("_id").alias("doc_id"), *[c.split()[0] for c in DOCUMENT.split(", ")])
    rows = rows.join(returned(scored), ["block", "place"], "left")
    none = F.lit(0).cast("long")
    return rows.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256",
    ), pairs
