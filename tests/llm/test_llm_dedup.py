"""Exact, near and substring dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from cases import documents, empty, lower, odd, odd_texts, prose
from pyspark.sql import functions as F

from citeframe.llm import chunk_dedup, components, exact_dedup, repeats, simhash


def key(i):
    return (i is None, i or 0)


# ---- exact dedup -----------------------------------------------------------------------------


def test_exact_dedup_matches_brute_force(spark):
    groups = defaultdict(list)
    for i, t in odd_texts():
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((i, t or ""))
    want = Counter()
    for text, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1]), key(r[0])))[0]
        for i, _ in own:
            want[(i, keep, len(own), i == keep, hashlib.sha256(text.encode()).hexdigest())] += 1
    got = exact_dedup.dedup(odd(spark), exact_dedup.temporary_index(spark))
    assert Counter(tuple(r) for r in got.collect()) == want


def test_exact_survivors_are_one_row_for_each_text(spark):
    docs = odd(spark)
    kept = exact_dedup.survivors(docs, index=exact_dedup.temporary_index(spark))
    assert kept.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", "", r["text"] or "") for r in kept.collect()]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]+", "", t or "") for _, t in odd_texts()})
    assert all(r["_row_id"] == "r" for r in kept.collect())


def test_index_persists_and_knows_earlier_batches(spark, tmp_path):
    path = str(tmp_path / "index")
    first = exact_dedup.DigestIndex(spark, path, buckets=4)
    a = exact_dedup.dedup(documents(spark, [(1, "one two"), (2, "onetwo"), (3, "three")]), first).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in a} == {(1, 1, True), (2, 1, False), (3, 3, True)}
    again = exact_dedup.DigestIndex(spark, path, buckets=4)  # another session would open it so
    b = exact_dedup.dedup(documents(spark, [(4, "onetwo"), (5, "four"), (6, "f our")]), again).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in b} == {(4, 1, False), (5, 6, False), (6, 6, True)}
    assert again.table().count() == 3
    left = exact_dedup.survivors(documents(spark, [(7, "three"), (8, "new"), (9, "new")]), index=again).collect()
    assert [r["doc_id"] for r in left] == [8]


def test_index_join_does_not_shuffle_the_index(spark):
    index = exact_dedup.temporary_index(spark)
    exact_dedup.dedup(odd(spark), index).collect()
    batch = exact_dedup.digests(odd(spark)).groupBy("digest").count()
    plan = index.unknown(batch, "next")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def answers(df):
    return Counter(tuple(r) for r in df.collect())


def test_index_opened_with_other_settings_keeps_its_own(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = documents(spark, [(k, f"text {k}") for k in range(50)])
    exact_dedup.dedup(docs, exact_dedup.DigestIndex(spark, path, buckets=4)).collect()
    for buckets in (None, 16):
        again = exact_dedup.DigestIndex(spark, path, buckets=buckets)
        assert again.buckets == 4
        assert again.unknown(exact_dedup.digests(docs).groupBy("digest").count(), "new").count() == 0
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, id_type="string")


def test_a_batch_run_again_gets_the_same_answers(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"))
    one, two = documents(spark, [(1, "a b"), (2, "ab"), (3, "c")]), documents(spark, [(4, "ab"), (5, "d"), (6, "d")])
    first, second = (answers(exact_dedup.dedup(d, index, batch=b)) for d, b in ((one, "one"), (two, "two")))
    size = index.table().count()
    assert answers(exact_dedup.dedup(one, index, batch="one")) == first
    assert answers(exact_dedup.dedup(two, index, batch="two")) == second
    assert index.table().count() == size == 3
    # a try that wrote only part of its batch
    index.append(spark.createDataFrame([(bytearray(b"x"), 9)], "digest binary, keep_id long"), "three")
    both = spark.createDataFrame([(bytearray(b"x"), 9), (bytearray(b"y"), 8)], "digest binary, keep_id long")
    index.append(both, "three")
    assert index.table().where("batch = 'three'").count() == 2


def test_compacted_index_has_one_file_a_bucket_and_the_same_digests(spark, tmp_path):
    path = str(tmp_path / "index")
    index = exact_dedup.DigestIndex(spark, path, buckets=2)
    for k in range(3):
        exact_dedup.dedup(documents(spark, [(100 * k + i, f"{k} {i}") for i in range(30)]), index).collect()
    before = answers(index.table())
    index.compact(buckets=4)
    assert answers(index.table()) == before and index.buckets == 4
    assert answers(exact_dedup.DigestIndex(spark, path).table()) == before
    assert len(list((tmp_path / "index" / "edition=2").glob("*.parquet"))) == 4
    known = exact_dedup.dedup(documents(spark, [(999, "2 7"), (998, "new")]), index).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in known} == {(999, 207, False), (998, 998, True)}
    index.close()
    assert not spark.catalog.tableExists(index.name)


def test_rows_of_one_id_are_kept_by_row(spark):
    got = exact_dedup.dedup(documents(spark, [(1, "a b"), (1, "ab"), (2, "ab"), (3, "x"), (3, "x")]), exact_dedup.temporary_index(spark))
    assert Counter((r["doc_id"], r["kept"]) for r in got.collect()) == {(1, True): 1, (1, False): 1, (2, False): 1, (3, True): 2}


# ---- components ------------------------------------------------------------------------------


def test_components_of_chains_stars_and_rings(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 140)} | {201: 200, 202: 200}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- simhash ---------------------------------------------------------------------------------


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps, radius):
    parent = list(range(len(fps)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                parent[root(a)] = root(b)
    return [root(k) for k in range(len(fps))]


def test_simhash_matches_brute_force(spark):
    base = prose(50, 120).split()
    texts = odd_texts() + [(100 + k, " ".join(base[:k] + ["new"] + base[k + 1 :])) for k in range(0, 60, 3)]
    fps = [fingerprint(t) for _, t in texts]
    roots = linked(fps, 4)
    least = defaultdict(list)
    for (i, _), r in zip(texts, roots):
        least[r] += [] if i is None else [i]
    want = Counter((i, f"{f:016x}", min(least[r])) for (i, _), f, r in zip(texts, fps, roots))
    got = simhash.near_duplicates(documents(spark, texts)).collect()
    assert Counter(tuple(r) for r in got) == want
    kept = simhash.survivors(documents(spark, texts)).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter(min(v) for v in least.values())


@pytest.mark.parametrize("tile", [16, 4096])
def test_near_links_find_every_link_with_and_without_tiles(spark, tile):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    fps = set(centres.tolist())
    for c in centres[:10].tolist():
        for _ in range(30):
            x = c
            for bit in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                x ^= 1 << bit if bit < 63 else -(1 << 63)
            fps.add(x)
    fps = sorted(fps)
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4, tile)
    root = dict(components.components(links).collect())
    mine = [root.get(f, f) for f in fps]
    theirs = linked([f % (1 << 64) for f in fps], 4)
    assert len(set(zip(mine, theirs))) == len(set(mine)) == len(set(theirs))


def test_bit_sliced_pairs_equal_plain_distances():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    values[100:200] = values[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64))
    values[200:] = values[100:200] ^ (np.uint64(3) << rng.integers(0, 62, 100, dtype=np.uint64))
    for radius in (1, 3, 4, 7):
        got = {(int(i), int(j)) for a, b in simhash.near_pairs(values[:150], values, radius) for i, j in zip(a, b)}
        far = np.bitwise_count(values[:150, None] ^ values[None, :])
        assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(far <= radius))}


# ---- repeats ---------------------------------------------------------------------------------


def removed(texts, width):
    seen = Counter(b[i : i + width] for b in texts for i in range(len(b) - width + 1))
    out = []
    for b in texts:
        mask = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                mask[i : i + width] = b"\1" * width
        kept = bytes(c for c, m in zip(b, mask) if not m)
        out.append((len(b), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("bucket, split", [(repeats.BUCKET, repeats.SPLIT), (2, repeats.SPLIT), (2, 3)])
def test_repeats_match_brute_force(spark, bucket, split):
    core = prose(60, 200)
    texts = [(i, t[:6000] if t else t) for i, t in odd_texts()]
    # a common passage with other bytes around it, cut at every place
    texts += [(200 + k, prose(300 + k, 20) + core[k * 7 : 700 + k * 11] + prose(400 + k, 20)) for k in range(20)]
    want = Counter((i, *r) for (i, _), r in zip(texts, removed([(t or "").encode() for _, t in texts], 200)))
    got = repeats.report(documents(spark, texts), bucket=bucket, split=split)
    assert Counter(tuple(r)[:5] for r in got.collect()) == want


def test_interval_tree_lists_all_maximal_repeats():
    text = b"xabcabcyabcz"
    spots = [k for k in range(len(text)) if text[k : k + 1] == b"b"]
    found = repeats.maximal_repeats([text[:k][::-1] for k in spots], [text[k:] for k in spots], 2)
    got = {(text[spots[m[0]] - a : spots[m[0]] + b], tuple(sorted(spots[i] for i in m))) for a, b, m in found}
    assert got == {(b"abc", tuple(spots))}


# ---- chunks ----------------------------------------------------------------------------------


def test_chunks_cover_texts_and_fall_in_step_after_an_insertion():
    text = np.frombuffer(prose(70, 3000).encode(), np.uint8)
    ends = chunk_dedup.boundaries(text)
    assert ends[-1] == len(text) and all(0 < b - a <= chunk_dedup.MOST for a, b in zip([0, *ends], ends))
    moved = np.concatenate((text[:5000], np.frombuffer(b"inserted words", np.uint8), text[5000:]))
    later = {e - 14 for e in chunk_dedup.boundaries(moved) if e > 6000}
    assert len(later & set(ends)) > 0.98 * len(later)
    assert chunk_dedup.boundaries(text[:0]) == []


def test_repeated_passages_are_cut_once_and_texts_come_back_whole(spark):
    passage = prose(80, 90)
    texts = odd_texts() + [(300, prose(81, 50) + passage + prose(82, 50)), (301, passage), (302, prose(83, 30) + passage)]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in chunk_dedup.report(docs).where("doc_id >= 300").collect()}
    assert got[300]["n_removed"] == 0 and got[300]["n_shared"] > 0.6 * len(passage)
    assert got[301]["n_removed"] > 0.6 * len(passage) and got[302]["n_removed"] > 0.6 * len(passage)
    all_rows = chunk_dedup.report(docs).collect()
    assert Counter(r["doc_id"] for r in all_rows) == Counter(i for i, _ in texts)
    assert Counter((r["doc_id"], r["n_bytes"]) for r in all_rows) == Counter((i, len((t or "").encode())) for i, t in texts)
    # brute force over the same chunks
    owners = defaultdict(set)
    for row, (_, t) in enumerate(texts):
        raw = (t or "").encode()
        last = 0
        for e in chunk_dedup.boundaries(np.frombuffer(raw, np.uint8)):
            owners[raw[last:e]].add((row, last))
            last = e
    assert max(r["n_shared"] for r in all_rows if r["doc_id"] in (14, 22)) <= 3000
    unique = [i for row, (i, t) in enumerate(texts) if t and all(len(o) == 1 for o in owners.values() if any(r == row for r, _ in o))]
    assert all(r["n_shared"] == 0 for r in all_rows if r["doc_id"] in unique)
    # of repeated rows one keeps its text
    same = [r["n_removed"] for r in all_rows if r["doc_id"] == 22]
    assert sorted(same)[0] == 0 and sorted(same)[1] > 0
    cut = chunk_dedup.rewrite(docs).where("doc_id = 302").first()
    assert cut["text"].startswith(prose(83, 30)[:100]) and len(cut["text"]) < len(texts[-1][1])
    # columns named like the operator's own pass through
    named = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("_i", "_h", "_cut", "_row_hash", "_id", "_text", "_doc"))])
    again = chunk_dedup.rewrite(named)
    assert again.columns == named.columns
    row = again.where("doc_id = 302").first()
    assert row["text"] == cut["text"] and [row[c] for c in ("_i", "_h", "_cut", "_row_hash", "_id", "_text", "_doc")] == list(range(7))


def test_empty_tables(spark):
    none = empty(spark)
    assert exact_dedup.dedup(none, exact_dedup.temporary_index(spark)).count() == 0
    assert exact_dedup.survivors(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.survivors(none).count() == 0
    assert repeats.report(none).count() == 0
    assert chunk_dedup.report(none).count() == 0
