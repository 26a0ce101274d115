"""Cross-tokenizer alignment against a brute-force version."""

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from cases import documents, empty, odd_texts, prose

from citeframe.llm import alignment

FOLDER = Path(alignment.VOCABULARIES)
pytestmark = pytest.mark.skipif(not (FOLDER / alignment.BYTE_FILE).exists(), reason="no vocabulary files")


def tokens(text):
    """(A ids with byte strings, B ids with byte strings) or nothing."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not hasattr(tokens, "a"):
        tokens.a = Tokenizer.from_file(str(FOLDER / alignment.BYTE_FILE))
        tokens.a.encode_special_tokens = True
        tokens.b = SentencePieceProcessor(model_file=str(FOLDER / alignment.PIECE_FILE))
        names = alignment.byte_alphabet()
        tokens.spell = {i: bytes(names[c] for c in t) for t, i in tokens.a.get_vocab().items() if t != "<|endoftext|>"}
    if not text:
        return [], []
    a = [(i, tokens.spell[i]) for i in tokens.a.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in tokens.b.encode(text):
        piece = tokens.b.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if tokens.b.is_byte(i) else piece.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    if b"".join(s for _, s in a) != raw or b"".join(s for _, s in b) != raw:
        return [], []
    return a, b


def groups(a, b):
    def ends(side):
        at, out = 0, []
        for i, s in side:
            at += len(s)
            out.append((at, i))
        return out

    ea, eb = ends(a), ends(b)
    found, start = [], 0
    for stop in sorted({e for e, _ in ea} & {e for e, _ in eb}):
        found.append(([i for e, i in ea if start < e <= stop], [i for e, i in eb if start < e <= stop]))
        start = stop
    return found


def expected(texts):
    docs = [(i, *tokens(t)) for i, t in texts]
    cut = [groups(a, b) for _, a, b in docs]
    links = [Counter((x, y) for ga, gb in g for x in ga for y in gb) for g in cut]
    count = Counter(pair for own in links for pair in own)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    rows = Counter()
    for (i, a, b), g, own in zip(docs, cut, links):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        rows[(
            i, len(a), len(b), len(g), sum(own.values()), sum(n for p, n in own.items() if count[p] == most[p[0]]),
            sum(n * count[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if g else "",
        )] += 1
    totals = {(x, y, n, sum(own[(x, y)] for own in links), n == most[x]) for (x, y), n in count.items()}
    return rows, totals


def odd_tokens():
    return [(i, t) for i, t in odd_texts() if not t or len(t) < 20_000] + [
        (50, "a▁b"), (51, "<s> hi </s><unk> <|endoftext|>"), (52, "tab\there\nnew  "), (53, "\x00 nul"), (54, "😀👍🏽 é"), (55, "हिन्दी ภาษาไทย"),
        (56, "<0x41> ▁"), (57, "the cat the cat the dog"), (58, "  　 x"), (59, "don't can't   won't"),
        *[(200 + k, prose(k, 30, "aeioustr")) for k in range(40)],
    ]


@pytest.mark.parametrize("block,written", [(8 << 20, 4096), (300, 2)])
def test_alignment_matches_brute_force(spark, monkeypatch, block, written):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "RUN_BYTES", block // 2)
    monkeypatch.setattr(alignment, "WRITTEN_OUT", written)
    rows, totals = expected(odd_tokens())
    got, pairs = alignment.align(documents(spark, odd_tokens()).repartition(3))
    assert Counter(tuple(r) for r in got.collect()) == rows
    assert {tuple(r) for r in pairs.select("a", "b", "docs", "links", "best").collect()} == totals


def test_bitmaps_round_trip_in_both_forms():
    rng = np.random.default_rng(1)
    pairs = np.sort(rng.integers(0, 40, 900)) ** 2 // 40
    found = sorted(set(zip(pairs.tolist(), rng.integers(0, 500, 900).tolist())))
    p, d = (np.array(x) for x in zip(*found))
    back, forms = [], set()
    for own, dense, n, bodies in alignment.bitmaps(p, d, 500):
        forms.add(dense)
        for pair, size, body in zip(own.tolist(), n.tolist(), bodies.to_pylist()):
            places = np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little")) if dense else np.frombuffer(body, "<u2")
            assert len(places) == size
            back += [(pair, x) for x in places.tolist()]
    assert sorted(back) == found and forms == {True, False}


def test_multiplicity_planes_add_up():
    keys, times = np.arange(5) << alignment.PLACE_BITS, np.array([1, 2, 3, 8, 1000])
    links = Counter()
    for plane, pairs, _, n, _ in alignment.planes_of(keys, times, 64):
        for pair, size in zip(pairs.tolist(), n.tolist()):
            links[pair] += size * (1 if plane == 0 else 1 << (plane - 1))
    assert [links[k] for k in range(5)] == times.tolist()


def test_both_engines_give_the_same_ids():
    files = [(FOLDER / name).read_bytes() for name in (alignment.BYTE_FILE, alignment.PIECE_FILE)]
    both = alignment.Tokenizers(*files)
    assert both.fast is not None
    rng = np.random.default_rng(2)
    settled = [chr(c) for c in range(1, 0xD800) if alignment.SETTLED.fullmatch(chr(c))]
    some = settled[:400] + list("  \n\t'stdmlvre  0123 ..!?") * 40
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 60))) for alphabet in (settled, some) for _ in range(3000)]
    texts += [prose(k, 40) for k in range(50)] + [t for _, t in odd_tokens() if t]
    slow = [x.ids for x in both.a.encode_batch(texts, add_special_tokens=False)]
    assert both.encode_a(texts) == slow
    assert sum(alignment.SETTLED.fullmatch(t) is not None for t in texts) > 6000


def test_empty_table(spark):
    got, pairs = alignment.align(empty(spark))
    assert got.count() == 0 and pairs.count() == 0
