"""Fill-in-middle against a brute-force version and as an exact round trip."""

import hashlib
import re

import pytest
from cases import documents, empty, odd, odd_texts, prose

from citeframe.llm import arrow_text, fim, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(doc_id, text, seed=42, rate=50, suffix_first=80):
    text = text or ""
    units = UNIT.findall(text)
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    spm = h4 % 100 < suffix_first
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(units), "spm" if spm else "psm", len(p), len(m), out


def more():
    return odd_texts() + [
        (40, "a\x1eb \x1d0 c\x1d1\x1e d"), (41, "x <P> y"), (42, "<M>"), (43, " lead and trail \n\n"), (44, "\u3000wide\u00a0blank x"),
        (45, "\x1c\x1f \x85 \x0b v"), (46, "nul \x00 in"), *[(100 + k, prose(k, k % 17)) for k in range(120)],
    ]


@pytest.mark.parametrize("rate,suffix_first", [(50, 80), (100, 50)])
def test_fim_matches_brute_force_and_round_trips(spark, rate, suffix_first):
    got = fim.transform(documents(spark, more()), rate=rate, suffix_first=suffix_first)
    rows = got.withColumn("back", fim.restored(got["output"], got["form"])).collect()
    order = lambda r: tuple((x is None, x) for x in r)
    want = [expected(i, t, 42, rate, suffix_first) for i, t in more()]
    assert sorted((tuple(r)[:6] for r in rows), key=order) == sorted(want, key=order)
    assert sorted(r["back"] for r in rows) == sorted(t or "" for _, t in more())
    assert {r["form"] for r in rows} == {"plain", "spm", "psm"}


def test_fim_works_in_runs_and_on_empty_tables(spark):
    assert fim.transform(empty(spark)).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fim.transform(empty(spark)).count() == 0
    import pyarrow as pa

    texts = pa.array(["abc", None, "", "x" * 50, "y"])
    assert list(arrow_text.runs(texts, 4)) == [(0, 3), (3, 1), (4, 1)]


def test_fim_query_hashes_its_outputs(spark, tmp_path):
    odd(spark).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in queries.op13_fill_in_middle(spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {(i, sha(expected(i, t)[5]), sha(t or "")) for i, t in odd_texts()}
