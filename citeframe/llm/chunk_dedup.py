"""Substring dedup by content-defined chunking.

A gear rolling hash over the last 16 bytes says where a chunk of a text ends, so that boundaries depend on
what stands there and not on where it stands: after an insertion they fall in step again. Chunks are told
apart by a 128-bit digest. Counts and first documents of digests are pre-aggregated; only digests that
occur more than once meet the chunks again. Runs of consecutive repeated chunks shorter than ``MIN_RUN``
bytes are left alone, as short phrases repeat by chance. Of a repeated chunk in longer runs, the copy in
the document with the smallest id, first place, stays.

Defined results: null and empty texts have no chunks; rows without an id come last; repeated rows are
separate documents, of which the later (by a hash of the text, then in any order: they are equal) lose
their chunks; an empty table gives an empty result; extra columns are ignored by ``report`` and kept by ``rewrite``, whatever their
names; a text is never cut short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .arrow_text import flat, text_column
from .rows import KEYS, keyed

# Least and most bytes of a chunk, and how far apart boundaries lie on average beyond the least.
LEAST, MOST, SPACING = 16, 1024, 32
MIN_RUN = 100
WINDOW = 16
GEAR = np.random.default_rng(20240229).integers(0, 1 << 16, 256, dtype=np.uint16)


def boundaries(data: np.ndarray, least: int = LEAST, most: int = MOST, spacing: int = SPACING) -> list[int]:
    """Ends of the chunks of one text."""
    rolling = GEAR[data]
    step = 1
    while step < WINDOW:  # sum of gear[b] << age over the last 16 bytes, by doubling
        if len(rolling) > step:
            rolling[step:] = rolling[step:] + (rolling[:-step] << np.uint16(step))
        step *= 2
    ends, last = [], 0
    for at in (np.flatnonzero(rolling < (1 << 16) // spacing) + 1).tolist():
        while at - last > most:
            last += most
            ends.append(last)
        if at - last >= least:
            ends.append(at)
            last = at
    while len(data) - last > most:
        last += most
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per chunk: keys, _row (tells repeated rows apart), at, size, digest as two longs; and for
    each document a row with at -1 and its bytes as size."""

    def cut(batches):
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            data, ends = flat(batch.column("_text"))
            raw = data.tobytes()
            counts, ats, lengths, digests = [], [], [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                cuts = boundaries(data[a:b])
                starts = [0, *cuts][:-1]
                counts.append(len(cuts) + 1)
                ats += [-1, *starts]
                lengths += [b - a, *(y - x for x, y in zip(starts, cuts))]
                digests.append(bytes(16))
                digests += [digest(raw[a + x : a + y]) for x, y in zip(starts, cuts)]
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            rows = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(rows) for c in (*KEYS, "_row")), pa.array(ats, pa.int32()),
                 pa.array(lengths, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                [*KEYS, "_row", "at", "size", "d1", "d2"],
            )

    whole = keyed(docs, doc_id, text).select(*KEYS, F.monotonically_increasing_id().alias("_row"), text_column(docs, text).alias("_text"))
    kind = dict(whole.dtypes)["_row_id"]
    return whole.mapInArrow(cut, f"_row_id {kind}, _row_hash long, _row long, at int, size int, d1 long, d2 long")


def _summaries(min_run: int):
    """Sorted rows of documents (each with its head, at -1, first) -> a row per document."""

    def one(head, at, size, first, d1, d2):
        # runs of repeated chunks that touch each other
        ends = at + size
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != ends[:-1]
        run = np.cumsum(new) - 1
        long_enough = (np.bincount(run, size) >= min_run)[run] if len(at) else np.zeros(0, bool)
        gone, seen = [], set()
        for k in range(len(at)):
            key = (d1[k], d2[k])
            if long_enough[k] and (not first[k] or key in seen):
                gone.append(k)
            seen.add(key)
        starts, stops = [], []
        for k in gone:
            if stops and stops[-1] == at[k]:
                stops[-1] = int(ends[k])
            else:
                starts.append(int(at[k]))
                stops.append(int(ends[k]))
        shared = int(size[long_enough].sum())
        return {**head, "n_repeated": int(long_enough.sum()), "n_shared": shared,
                "n_removed": int(size[gone].sum()), "n_spans": len(starts), "starts": starts, "stops": stops}

    schema = pa.schema([(k, pa.int64()) for k in ("n_bytes", "n_repeated", "n_shared", "n_removed", "n_spans")])

    def run(batches):
        # documents are gathered whole: at most one document and one batch are held
        held = None
        seen_in_id: list = [None, set()]
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            heads = np.flatnonzero(held.column("at").to_numpy() < 0)
            if len(heads) > 1:
                yield from emit(held.slice(0, int(heads[-1])), seen_in_id)
                held = held.slice(int(heads[-1]))
        if held is not None and held.num_rows:
            yield from emit(held, seen_in_id)

    def emit(table, state):
        columns = {c: table.column(c).to_numpy() for c in ("at", "size", "first", "d1", "d2")}
        heads = np.flatnonzero(columns["at"] < 0)
        keys = {c: table.column(c).take(pa.array(heads)) for c in KEYS}
        ids = keys["_row_id"].to_pylist()
        out = []
        for n, (a, b) in enumerate(zip(heads, [*heads[1:], table.num_rows])):
            part = {c: v[a + 1 : b] for c, v in columns.items()}
            part["first"] = part["first"].copy()
            # rows that share an id are one sequence: an earlier one has the first copies
            if state[0] is not None and state[0] == (ids[n],):
                known = state[1]
                part["first"] = np.array([f and (x, y) not in known for f, x, y in zip(part["first"], part["d1"], part["d2"])], bool)
            else:
                state[0], state[1] = (ids[n],), set()
            state[1].update(zip(part["d1"].tolist(), part["d2"].tolist()))
            out.append(one({"n_bytes": int(columns["size"][a])}, **part))
        arrays = [*keys.values(), *(pa.array([r[f.name] for r in out], f.type) for f in schema),
                  *(pa.array([r[c] for r in out], pa.list_(pa.int32())) for c in ("starts", "stops"))]
        arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
        yield pa.RecordBatch.from_arrays(arrays, [*KEYS, *schema.names, "starts", "stops"])

    return run


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """A row per document: keys, n_bytes, n_repeated (chunks that occur elsewhere too), n_shared (their
    bytes), n_removed, n_spans, and the byte runs to remove (starts, stops)."""
    cut = store(chunks(docs, doc_id, text), "chunks")
    body = cut.where("at >= 0")
    groups = body.groupBy("d1", "d2").agg(F.count("*").alias("_n"), F.min("_row_id").alias("_first")).where("_n > 1").drop("_n")
    repeated = body.join(store(groups, "repeated"), ["d1", "d2"])
    columns = [*KEYS, "_row", "at", "size", "d1", "d2"]
    marked = repeated.select(*columns, F.col("_row_id").eqNullSafe(F.col("_first")).alias("first"))
    heads = cut.where("at < 0").select(*columns, F.lit(False).alias("first"))
    order = [F.col("_row_id").asc_nulls_last(), "_row_hash", "_row", "at"]
    dealt = marked.unionByName(heads).repartition("_row_id").sortWithinPartitions(*order)
    kind = dict(cut.dtypes)["_row_id"]
    return dealt.mapInArrow(
        _summaries(min_run),
        f"_row_id {kind}, _row_hash long, n_bytes long, n_repeated long, n_shared long, n_removed long, n_spans long, "
        "starts array<int>, stops array<int>",
    )


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """``repeats`` by doc_id; spans as start:stop in bytes, comma-joined."""
    found = repeats(docs, doc_id, text, min_run)
    pairs = F.zip_with("starts", "stops", lambda a, b: F.concat(a.cast("string"), F.lit(":"), b.cast("string")))
    return found.select(
        F.col("_row_id").alias("doc_id"), "n_bytes", "n_repeated", "n_shared", "n_removed", "n_spans",
        F.array_join(pairs, ",").alias("removed"),
    )


def without(raw: bytes, starts, stops) -> bytes:
    last, parts = 0, []
    for a, b in zip(starts, stops):
        parts.append(raw[last:a])
        last = b
    return b"".join([*parts, raw[last:]])


def kept_text(texts: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
    data, ends = flat(texts)
    raw = data.tobytes()
    return pa.array([
        without(raw[a:b], x or (), y or ()).decode("utf-8", "replace")
        for a, b, x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), starts.to_pylist(), stops.to_pylist())
    ], pa.string())


def rewrite(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with the repeated chunks cut out of ``text``. A character cut through becomes U+FFFD; of
    rows that agree in id and text, which are one document here, one stays."""
    spans = repeats(docs, doc_id, text, min_run).where("n_removed > 0")
    # of repeated rows the first keeps most
    spans = spans.groupBy(*KEYS).agg(F.min_by(F.struct("starts", "stops"), "n_removed").alias("_cut"))
    spans = spans.select(F.col("_row_id").alias("_i"), F.col("_row_hash").alias("_h"), "_cut")
    # the row travels in one struct, so its columns may have any names
    own = keyed(docs.select(F.struct("*").alias("_doc"), F.col(doc_id).alias("_id"), F.col(text).alias("_text")), "_id", "_text")
    joined = own.join(spans, F.col("_row_id").eqNullSafe(F.col("_i")) & (F.col("_row_hash") == F.col("_h")), "left")
    cut = F.arrow_udf("string")(kept_text)(F.col("_text"), F.col("_cut.starts"), F.col("_cut.stops"))
    return joined.select(F.col("_doc").withField(text, cut).alias("_doc")).select("_doc.*")
