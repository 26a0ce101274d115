"""MinHash near-dedup by an inverted join over signature coordinates.

A document's set of word shingles is reduced to ``COORDINATES`` minima. Equal sets are folded to classes first.
Each class is posted under its coordinate-value pairs. Two sets of Jaccard similarity 0.8 agree in fewer than
``MATCHES`` of the coordinates with a probability of about 2.4e-7, so:

* *skip*: pairs that only one class has count for nothing, and a class with fewer than ``MATCHES`` others can have
  no partner;
* *prefix*: of a class's pairs, from rare to common, only those before its last ``MATCHES - 1`` are merged; two
  classes that agree in ``MATCHES`` meet there, and the long lists are left out;
* collisions of classes that meet are counted over the whole signatures, abandoned half way where hopeless, and
  pairs above the threshold and within the exact size bound stay.

Links are confirmed on full sets. First each class is tested against its best partner of smaller number, which
connects groups of near copies by fewer links than members. Candidates also make clusters of classes, a
spanning forest for each list. In clusters that hold several components still, the classes outside the largest are
asked against all others, in blocks of bounded size, until one link joins two components. So no link between
components is lost, and no group is written as all its pairs.

Defined results: null and empty texts and texts without words have empty sets and are linked with nothing;
texts of fewer words than a shingle have one element, all their words; repeated rows are separate rows of one
class; a component's id is its smallest doc_id, null ids aside; whole texts of any length count; an empty table
gives an empty result; extra columns are ignored. Shingles are told apart by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..session import store
from .arrow_text import pieces, text_column
from .components import components
from .rows import KEYS, keyed, one_of_each
from .simhash import hook, shingle_hashes

SHINGLE = 4
SEED = 42
# Links: 100 * intersection >= PERCENT * union.
PERCENT = 80
COORDINATES = 64
MATCHES = 34
# Classes of a list that meet in one task; longer lists are cut to tiles. Followers of a leader are dealt out likewise.
TILE = 4096
# Classes outside a cluster's largest component that are asked together, and classes they are asked against in one task
BLOCK, STRETCH = 128, 1024
# Streamed classes compared at once, and full sets tested between two looks at what is joined already
STREAMED, ASKED = 512, 32
# Pairs compared at once
COMPARED = 1 << 16
# Small tables are replicated up to this payload.
REPLICATED = 1 << 20


# ---- signatures ----------------------------------------------------------------------------


def multipliers(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(0, 1 << 64, n, np.uint64), draw.integers(0, 1 << 64, n, np.uint64) | np.uint64(1)


def minima(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """(runs, n) smallest values of each run of hashes under ``n`` orders; no run is empty."""
    out = np.empty((len(starts), n), np.uint32)
    for k, (flip, odd) in enumerate(zip(*multipliers(n))):
        mixed = (hashes ^ flip) * odd
        mixed ^= mixed >> np.uint64(29)
        out[:, k] = np.minimum.reduceat((mixed * odd >> np.uint64(32)).astype(np.uint32), starts)
    return out


def set_digests(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(runs, 2) order-free hashes of sets."""
    flips, odds = multipliers(2, SEED + 1)
    sums = []
    for flip, odd in zip(flips, odds):
        mixed = (hashes ^ flip) * odd
        mixed = (mixed ^ mixed >> np.uint64(32)) * odd
        sums.append(np.add.reduceat(mixed ^ mixed >> np.uint64(29), starts))
    return np.stack(sums, axis=1)


def shingle_sets(texts: pa.Array, width: int):
    """Per run of texts: flat distinct shingle hashes and the size of each text's set."""
    for data, ends in pieces(texts):
        raw = data.tobytes()
        sets = [set(shingle_hashes(raw[a:b], width, SEED)) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        yield np.frombuffer(b"".join(h for s in sets for h in s), ">u8").astype(np.uint64), sizes


def binaries(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    wide = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * wide
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def signatures(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """One slim row per document: keys, n (set size), digest of the set and signature (null if empty)."""

    def sign(batches):
        for batch in batches:
            sizes, digests, sigs = [], [], []
            for hashes, n in shingle_sets(batch.column("_text"), width):
                full = np.flatnonzero(n)
                starts = np.cumsum(n[full]) - n[full]
                digest = np.zeros((len(n), 2), np.uint64)
                sig = np.zeros((len(n), COORDINATES), np.uint32)
                if len(full):
                    digest[full], sig[full] = set_digests(hashes, starts), minima(hashes, starts, COORDINATES)
                sizes.append(n)
                digests.append(digest)
                sigs.append(sig)
            if not sizes:
                continue
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row_id"), batch.column("_row_hash"), pa.array(np.concatenate(sizes)),
                 binaries(np.concatenate(digests)), binaries(np.concatenate(sigs))],
                ["_row_id", "_row_hash", "n", "digest", "sig"],
            )

    whole = keyed(docs, doc_id, text).select("_row_id", "_row_hash", text_column(docs, text).alias("_text"))
    kind = whole.schema["_row_id"].dataType.simpleString()
    return whole.mapInArrow(sign, f"_row_id {kind}, _row_hash long, n long, digest binary, sig binary")


def fixed(column: pa.Array, kind) -> np.ndarray:
    """Rows of binary values of one length as a matrix."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


# ---- postings ------------------------------------------------------------------------------


def post(classes: DataFrame) -> DataFrame:
    """(key, cid) for each coordinate-value pair of each class."""

    def rows(batches):
        for batch in batches:
            sigs = fixed(batch.column("sig"), np.uint32).astype(np.int64)
            if len(sigs):
                keys = sigs + (np.arange(sigs.shape[1], dtype=np.int64) << 32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.repeat(np.asarray(batch.column("cid")), sigs.shape[1]))], ["key", "cid"]
                )

    return classes.select("cid", "sig").mapInArrow(rows, "key long, cid long")


def prefixes(classes: DataFrame, matches: int) -> DataFrame:
    """Stored (key, cid, freq): the pairs under which a class can meet all its partners."""
    postings = post(classes)
    shared = store(postings.groupBy("key").agg(F.count("*").alias("freq")).where("freq > 1"), "shared")
    met = lookup_join(postings, shared, ["key"], ["cid"], limit=REPLICATED)
    # at most one row a coordinate
    own = met.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("freq", "key"))).alias("own"))
    own = own.where(F.size("own") >= matches)
    first = F.slice("own", 1, F.size("own") - (matches - 1))
    return store(own.select("cid", F.explode(first).alias("p")).select("p.key", "cid", "p.freq"), "prefixes")


def dealt(lists: DataFrame, classes: DataFrame, tile: int) -> DataFrame:
    """Lists with the sizes and signatures of their classes, sorted for a task. Lists over ``tile`` are cut to tiles,
    one for each pair of halves of a tile, so that any two classes still meet."""
    joined = lists.join(classes.select("cid", "n", "sig"), "cid")
    long = F.col("freq") > tile
    parts = F.ceil(F.col("freq") / (tile // 2)).cast("int")
    here = F.when(long, F.pmod(F.xxhash64("cid", "key"), parts).cast("int")).otherwise(0)
    there = F.when(long, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    tiles = joined.withColumn("_here", here).withColumn("_there", F.explode(there))
    part = F.when(long, F.xxhash64(F.least("_here", "_there"), F.greatest("_here", "_there"))).otherwise(0)
    dealt_out = tiles.withColumn("part", part).repartition("key", "part").sortWithinPartitions("key", "part", "cid")
    return dealt_out.select("key", "part", "cid", "n", "sig")


def collisions(i: np.ndarray, j: np.ndarray, sigs: np.ndarray, matches: int):
    """Those of the pairs that agree in ``matches`` coordinates, and in how many."""
    half = sigs.shape[1] // 2
    found = [(np.zeros(0, np.int64),) * 3]
    for at in range(0, len(i), COMPARED):
        a, b = i[at : at + COMPARED], j[at : at + COMPARED]
        count = (sigs[a, :half] == sigs[b, :half]).sum(axis=1)
        stay = count + sigs.shape[1] - half >= matches
        a, b, count = a[stay], b[stay], count[stay]
        count += (sigs[a, half:] == sigs[b, half:]).sum(axis=1)
        stay = count >= matches
        found.append((a[stay], b[stay], count[stay]))
    return tuple(np.concatenate(x) for x in zip(*found))


def meetings(ends: np.ndarray, n: np.ndarray, sigs: np.ndarray, matches: int, percent: int):
    """Pairs (i, j, collisions), i < j, within each list; lists end at ``ends``."""
    starts = np.concatenate(([0], ends[:-1]))
    row_end = np.repeat(ends, ends - starts)
    step, left = 1, np.arange(len(n))
    while True:
        left = left[left + step < row_end[left]]
        if not len(left):
            return
        i, j = left, left + step
        fit = np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent
        yield collisions(i[fit], j[fit], sigs, matches)
        step += 1


def lists_of(batches, columns: list[str], size: int = 1 << 15):
    """Rows sorted by (key, part) -> whole lists: where each ends, and their columns."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows >= size:
            lists, held = split(held)
            if lists.num_rows:
                yield boundaries(lists), [lists.column(c).combine_chunks() for c in columns]
    if held is not None and held.num_rows:
        yield boundaries(held), [held.column(c).combine_chunks() for c in columns]


def boundaries(table: pa.Table) -> np.ndarray:
    key, part = np.asarray(table.column("key")), np.asarray(table.column("part"))
    return np.concatenate((np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1, [len(key)]))


def split(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Whole lists, and the last one, which may go on."""
    ends = boundaries(table)
    last = int(ends[-2]) if len(ends) > 1 else 0
    return table.slice(0, last), table.slice(last)


def partners(lists: DataFrame, classes: DataFrame, matches: int, percent: int, tile: int) -> DataFrame:
    """(x, y, roots) for each class that meets candidates: y is the one of smaller number that it agrees with most
    (null if all have larger ones), roots the smallest members of the trees that candidates make of its lists."""

    def best(batches):
        for ends, (cid, n, sig) in lists_of(batches, ["cid", "n", "sig"]):
            cid, n, sigs = np.asarray(cid), np.asarray(n), fixed(sig, np.uint32)
            score = np.zeros(len(cid), np.int64)
            partner = np.full(len(cid), -1, np.int64)
            met = np.zeros(len(cid), bool)
            tree = np.arange(len(cid))
            for i, j, count in meetings(ends, n, sigs, matches, percent):
                met[i] = met[j] = True
                tree = hook(tree, i, j)
                # lists are sorted by class; a step pairs each row with one before it at most
                better = (cid[i] < cid[j]) & ((count > score[j]) | (count == score[j]) & (cid[i] < partner[j]))
                score[j[better]], partner[j[better]] = count[better], cid[i[better]]
            got = np.flatnonzero(met)
            columns = [cid[got], partner[got], score[got], cid[tree[got]]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["x", "y", "m", "root"])

    met = dealt(lists, classes, tile).mapInArrow(best, "x long, y long, m long, root long")
    # a class stands in at most as many lists as it has coordinates, or tiles of them
    found = met.groupBy("x").agg(F.max(F.struct("m", (-F.col("y")).alias("y"))).alias("b"), F.collect_set("root").alias("roots"))
    return found.select("x", F.when(F.col("b.m") > 0, -F.col("b.y")).alias("y"), "roots")


# ---- confirming links ----------------------------------------------------------------------


def full_sets(docs: DataFrame, doc_id: str, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """(cid, shingles): the sets of the ``wanted`` (KEYS, cid), sorted hashes in one binary value."""

    def collect(batches):
        for batch in batches:
            found = []
            for hashes, sizes in shingle_sets(batch.column("_text"), width):
                found += [np.sort(part).tobytes() for part in np.split(hashes, np.cumsum(sizes)[:-1])] if len(sizes) else []
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(found, pa.binary())], ["cid", "shingles"])

    whole = keyed(docs, doc_id, text).select("_row_id", "_row_hash", text_column(docs, text).alias("_text"))
    # by shuffles at every size: the wanted keys grow with the documents
    mine = whole.hint("merge").join(
        wanted.withColumnsRenamed({"_row_id": "_i", "_row_hash": "_h"}),
        F.col("_row_id").eqNullSafe(F.col("_i")) & (F.col("_row_hash") == F.col("_h")),
    )
    sets = store(mine.select("cid", "_text").mapInArrow(collect, "cid long, shingles binary"), "sets")
    # rows that repeat an id and a text are found once each
    repeated = store(sets.groupBy("cid").agg(F.count("*").alias("n")).where("n > 1").select("cid"), "repeated")
    if repeated.isEmpty():
        return sets
    once = sets.join(repeated, "cid", "left_semi").dropDuplicates(["cid"])
    return store(sets.join(repeated, "cid", "left_anti").unionByName(once), "sets")


def similar(one: np.ndarray, others: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets in ``others`` (flat, none empty) link with the sorted set ``one``."""
    at = np.minimum(np.searchsorted(one, others), len(one) - 1)
    common = np.add.reduceat((one[at] == others).astype(np.int64), np.cumsum(sizes) - sizes)
    return common * 100 >= (len(one) + sizes - common) * percent


def flat_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint64), np.fromiter((len(v) // 8 for v in values), np.int64, len(values))


def confirmed_partners(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the (x, y) that are links. The set of y travels once for all its x, or once per salt."""

    def confirm(batches):
        leader = None, None
        for batch in batches:
            keys = list(zip(batch.column("y").to_pylist(), batch.column("salt").to_pylist()))
            cids = np.asarray(batch.column("cid"))
            roles = np.asarray(batch.column("role"))
            first = 0
            a, b = [], []
            while first < len(keys):
                last = first
                while last < len(keys) and keys[last] == keys[first] and last - first < 256:
                    last += 1
                values, sizes = flat_sets(batch.column("shingles").slice(first, last - first))
                skipped = 0
                if roles[first] == 0:
                    leader = keys[first], values[: sizes[0]]
                    skipped = 1
                if last - first > skipped:
                    assert leader[0] == keys[first], "a leader comes first"
                    values, sizes = values[sizes[:skipped].sum() :], sizes[skipped:]
                    hit = similar(leader[1], values, sizes, percent)
                    a += cids[first + skipped : last][hit].tolist()
                    b += [keys[first][0]] * int(hit.sum())
                first = last
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    parts = store(pairs.groupBy("y").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")), "leaders")
    leaders = parts.select("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("y").alias("cid"))
    many = parts.where("parts > 1")
    salted = lookup_join(pairs, store(many, "many"), ["y"], ["x"], "left", limit=REPLICATED)
    salt = F.pmod(F.xxhash64("x"), F.coalesce("parts", F.lit(1))).cast("int")
    rows = leaders.unionByName(salted.select("y", salt.alias("salt"), F.lit(1).alias("role"), F.col("x").alias("cid")))
    rows = rows.join(sets, "cid").repartition("y", "salt").sortWithinPartitions("y", "salt", "role")
    return rows.select("y", "salt", "role", "cid", "shingles").mapInArrow(confirm, "a long, b long")


def crossings(members: DataFrame, sets: DataFrame, matches: int, percent: int, block: int, stretch: int) -> DataFrame:
    """(a, b): components of one cluster that a link joins. ``members``: (cid, cluster, comp, sig) of all classes that
    have candidates. Classes outside a cluster's largest component are asked against all its classes: blocks
    of them are held, the classes stream by in stretches."""
    sizes = store(members.groupBy("cluster", "comp").agg(F.count("*").alias("n")), "sizes")
    largest = sizes.groupBy("cluster").agg(
        F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("comps")
    ).where("comps > 1")
    shape = largest.select(
        "cluster", F.col("top.comp").alias("top"), F.ceil((F.col("all") - F.col("top.n")) / block).cast("int").alias("blocks"),
        F.ceil(F.col("all") / stretch).cast("int").alias("stretches"),
    )
    mixed = store(lookup_join(members, store(shape, "clusters"), ["cluster"], ["cid"], limit=REPLICATED), "mixed")
    h = F.xxhash64("cid", F.lit(3))
    asked = mixed.where("comp <> top").withColumn("block", F.pmod(h, F.col("blocks")).cast("int"))
    asked = asked.withColumn("stretch", F.explode(F.sequence(F.lit(0), F.col("stretches") - 1)))
    stream = mixed.withColumn("stretch", F.pmod(h, F.col("stretches")).cast("int"))
    stream = stream.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["cluster", "block", "stretch"]
    rows = asked.select(*keys, F.lit(0).alias("role"), "cid", "comp", "sig").unionByName(
        stream.select(*keys, F.lit(1).alias("role"), "cid", "comp", "sig")
    )
    rows = rows.join(sets, "cid").repartition(*keys).sortWithinPartitions(*keys, "role")

    def test(batches):
        key, held, joined = None, None, set()
        for batch in batches:
            names = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in (*keys, "role")], axis=1)
            edges = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(names)]):
                if start == stop:
                    continue
                part, here = batch.slice(start, stop - start), tuple(names[start, :3].tolist())
                if here != key:
                    key, held, joined = here, [], set()
                if names[start, 3] == 0:
                    held.append(part)
                    continue
                before = len(joined)
                for at in range(0, part.num_rows, STREAMED):
                    ask(held, part.slice(at, STREAMED), joined, matches, percent)
                if len(joined) > before:
                    yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in joined]), "b": pa.array([b for _, b in joined])})

    return rows.select(*keys, "role", "comp", "sig", "shingles").mapInArrow(test, "a long, b long").distinct()


def ask(held: list[pa.RecordBatch], stream: pa.RecordBatch, joined: set, matches: int, percent: int) -> None:
    """Tests the held classes against the streamed ones of other components; adds pairs of components to ``joined``,
    each as soon as one link is found."""
    comps, sigs = np.asarray(stream.column("comp")), fixed(stream.column("sig"), np.uint32)
    shingles = stream.column("shingles").to_pylist()
    sizes = np.fromiter((len(v) // 8 for v in shingles), np.int64, len(shingles))
    for part in held:
        for comp, sig, own in zip(part.column("comp").to_pylist(), fixed(part.column("sig"), np.uint32), part.column("shingles").to_pylist()):
            one = np.frombuffer(own, np.uint64)
            count = (sigs == sig).sum(axis=1)
            fit = np.minimum(sizes, len(one)) * 100 >= np.maximum(sizes, len(one)) * percent
            open_ = np.flatnonzero((count >= matches) & fit & (comps != comp))
            open_ = open_[np.argsort(-count[open_], kind="stable")]
            while len(open_):
                open_ = open_[[(min(comp, c), max(comp, c)) not in joined for c in comps[open_].tolist()]]
                now, open_ = open_[:ASKED], open_[ASKED:]
                if len(now):
                    hit = similar(one, np.frombuffer(b"".join([shingles[k] for k in now.tolist()]), np.uint64), sizes[now], percent)
                    joined.update((min(comp, c), max(comp, c)) for c in comps[now[hit]].tolist())


# ---- operator ------------------------------------------------------------------------------


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT,
            matches: int = MATCHES, tile: int = TILE, block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """A row per document: KEYS, n, component_id and class, which names its component; empty sets have their own id
    and class."""
    slim = store(signatures(docs, doc_id, text, width), "slim")
    classes = slim.where("n > 0").groupBy("digest").agg(
        F.min("_row_id").alias("least"), F.min(F.struct("_row_hash", "_row_id")).alias("of"), F.first("sig").alias("sig"),
        F.first("n").alias("n"), F.count("*").alias("rows"),
    )
    classes = store(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    lists = prefixes(classes, matches)
    met = store(partners(lists, classes, matches, percent, tile), "partners")
    wanted = store(classes.join(met.select(F.col("x").alias("cid")), "cid").select("of._row_id", "of._row_hash", "cid"), "wanted")
    sets = full_sets(docs, doc_id, text, width, wanted)
    links = store(confirmed_partners(met.where("y is not null").select("x", "y"), sets, percent), "confirmed")
    comps = components(links).select(F.col("node").alias("cid"), F.col("root").alias("comp"))
    near = components(met.select(F.col("x").alias("a"), F.explode("roots").alias("b")))
    clusters = near.select(F.col("node").alias("cid"), F.col("root").alias("cluster"))
    members = met.select(F.col("x").alias("cid")).join(clusters, "cid", "left").join(comps, "cid", "left")
    members = members.select("cid", F.coalesce("cluster", "cid").alias("cluster"), F.coalesce("comp", "cid").alias("comp"))
    members = store(members.join(classes.select("cid", "sig"), "cid"), "members")
    across = store(crossings(members, sets, matches, percent, block, stretch), "across")
    merged = components(across).select(F.col("node").alias("comp"), F.col("root").alias("top"))
    tops = members.select("cid", "comp").join(merged, "comp", "left").select("cid", F.coalesce("top", "comp").alias("top"))
    final = classes.join(tops, "cid", "left").select("cid", "digest", "least", "rows", F.coalesce("top", "cid").alias("top"))
    final = store(final, "final")
    roots = final.groupBy("top").agg(F.min("least").alias("component_id"), F.count("*").alias("of_top"))
    total = slim.count()
    hot = max(256, total // 10_000)
    named = lookup_join(final, store(roots.where("of_top > 1"), "roots"), ["top"], ["cid"], "left", limit=REPLICATED, hot_rows=hot)
    # only sets that several rows or several classes share have to be looked up
    named = named.where("rows > 1 or of_top > 1").select("digest", "top", F.coalesce("component_id", "least").alias("component_id"))
    known = lookup_join(slim.drop("sig"), store(named, "named"), ["digest"], ["_row_id", "_row_hash"], "left", limit=REPLICATED, hot_rows=hot)
    none = F.col("n") == 0
    alone = F.struct(F.when(none, F.col("_row_id")), F.when(none, F.col("_row_hash")), F.col("top"), F.when(F.col("top").isNull(), F.col("digest")))
    own = F.when(none | F.col("top").isNull(), F.col("_row_id")).otherwise(F.col("component_id"))
    return known.select(*KEYS, "n", own.alias("component_id"), alone.alias("class"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept."""
    return grouped(docs, doc_id, text, **options).select(
        F.col("_row_id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id",
        F.col("_row_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component, that with the smallest id (null ids last), with all its columns."""
    rows = store(grouped(docs, doc_id, text, **options), "grouped")
    return one_of_each(docs, doc_id, text, rows, "class", ["_row_id"])
