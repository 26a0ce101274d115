"""MinHash near-dedup against brute force over full sets."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import documents, empty, lower, odd, odd_texts, prose

from citeframe.llm import minhash


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def expected(texts):
    sets = [shingles(t) for _, t in texts]
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(texts):
        ids[root(k)].append(i)
    want = Counter()
    for k, (i, _) in enumerate(texts):
        known = [x for x in ids[root(k)] if x is not None]
        least = i if not sets[k] else min(known, default=None)
        want[(i, len(sets[k]), least, i == least)] += 1
    return want, ids


def edited(base, edits, seed):
    """``base`` with some words replaced: each takes up to four shingles along."""
    r, out = random.Random(seed), list(base)
    for at in r.sample(range(len(out)), edits):
        out[at] = f"new{r.randint(0, 10**6)}"
    return " ".join(out)


def near_copies():
    """Groups that are dense, chains that drift away from their start, and groups that nearly link."""
    texts = []
    dense = prose(60, 200).split()
    texts += [(1000 + k, edited(dense, 3, k)) for k in range(60)]
    chain = prose(61, 150).split()
    for k in range(25):
        chain = edited(chain, 3, 100 + k).split()
        texts.append((2000 + k, " ".join(chain)))
    border = prose(62, 90).split()
    texts += [(3000 + k, edited(border, 1 + k % 6, 200 + k)) for k in range(40)]
    texts += [(4000 + k, f"a b c d e f g h {'ijklmnop'[: k % 9]}") for k in range(12)]
    return texts


@pytest.mark.parametrize("tile,block,stretch", [(4096, 128, 8192), (8, 3, 5)])
def test_near_duplicates_match_brute_force(spark, tile, block, stretch):
    texts = odd_texts() + near_copies()
    want, _ = expected(texts)
    got = minhash.near_duplicates(documents(spark, texts), tile=tile, block=block, stretch=stretch).collect()
    assert Counter(tuple(r) for r in got) == want


def test_links_across_components_are_tested_even_if_no_best_partner_links(spark):
    # of three versions the outer two link only over the middle one, and best partners need not be links
    base = prose(70, 300).split()
    texts = [(k, edited(base, 6, k)) for k in range(30)]
    want, _ = expected(texts)
    got = minhash.near_duplicates(documents(spark, texts), tile=4, block=1, stretch=2).collect()
    assert Counter(tuple(r) for r in got) == want


def test_survivors_are_one_of_each_component_with_all_columns(spark):
    docs = odd(spark)
    kept = minhash.survivors(docs)
    assert kept.columns == docs.columns
    _, ids = expected(odd_texts())
    sets = {i: shingles(t) for i, t in odd_texts()}
    want = Counter()
    for own in ids.values():
        known = [x for x in own if x is not None]
        want[min(known) if known else None] += 1
    got = Counter(r["doc_id"] for r in kept.collect())
    assert got == want and sets


def test_signatures_estimate_similarity_and_keep_links(spark):
    rng = np.random.default_rng(5)
    agree = []
    for _ in range(300):
        both, a, b = (rng.integers(0, 1 << 64, n, np.uint64) for n in (80, 10, 10))
        hashes = np.concatenate((both, a, both, b))
        one, two = minhash.minima(hashes, np.array([0, 90]), minhash.COORDINATES)
        agree.append(int((one == two).sum()))
    share = np.array(agree) / minhash.COORDINATES
    assert abs(share.mean() - 0.8) < 0.01 and 0.04 < share.std() < 0.06
    assert min(agree) >= minhash.MATCHES


def test_set_digests_do_not_depend_on_order():
    a = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one, two, three = minhash.set_digests(np.concatenate((a, a[::-1], a[:-1])), np.array([0, 49, 98]))
    assert (one == two).all() and (one != three).all()


def test_empty_table(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    assert minhash.survivors(empty(spark)).count() == 0
