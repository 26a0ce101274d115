"""The pipeline's stages one after the other over every odd row, each against a brute-force version on its own input."""

import re
from collections import Counter, defaultdict

from cases import documents, lower, odd_texts, prose, words
from test_llm_dedup import fingerprint, linked

import corpus_pipeline
from citeframe.llm import queries
from citeframe.session import store

PASSAGE = prose(90, 26)
TOXIC = "vile slime filth scum"


def tables(spark, folder):
    texts = odd_texts() + [(100 + k, prose(100 + k, 30)) for k in range(40)]
    texts += [(200 + k, f"{TOXIC} {prose(200 + k, 6)} {TOXIC}") for k in range(40)]
    base = prose(91, 200).split()
    texts += [(300 + k, " ".join(base[:k] + ["changed"] + base[k + 1 :])) for k in range(0, 200, 20)]
    texts += [(400, PASSAGE), (401, prose(92, 20) + " " + PASSAGE), (402, PASSAGE + " " + prose(93, 2000)), (403, PASSAGE[:20])]
    documents(spark, texts).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(200 <= i < 240)) for i, _ in texts if i is not None and 100 <= i < 236]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    items = [("b1", PASSAGE), ("b2", None), ("b3", "..."), ("b3", prose(94, 5))]
    spark.createDataFrame(items, "item_id string, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")


def ids(df):
    return Counter(r["doc_id"] for r in df.collect())


def key(i):
    return (i is None, i or 0)


def distinct_documents(rows):
    """Rows that agree in id and text are one document."""
    return {(r["doc_id"], r["text"]): r for r in rows}.values()


def first_of_groups(rows, group, order):
    groups = defaultdict(list)
    for r in distinct_documents(rows):
        groups[group[r["doc_id"], r["text"]]].append(r)
    return Counter(min(own, key=order)["doc_id"] for own in groups.values())


def contaminated(text):
    said, own = words(text), words(PASSAGE)
    windows = {tuple(own[i : i + 13]) for i in range(len(own) - 12)} | {tuple(words(prose(94, 5)))}
    hit = set()
    for size in {len(w) for w in windows}:
        for i in range(len(said) - size + 1):
            if tuple(said[i : i + size]) in windows:
                hit |= set(range(i, i + size))
    return bool(hit) and 20 * len(hit) >= len(said)


def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(store(stage(spark, kept[-1], folder), "stage"))
    before, mild, exact, near, clean, mixed = kept
    assert all(df.columns == columns for df in kept[:-1])

    toxic = {r["doc_id"] for r in queries.op9_toxicity(spark, folder).where("predicted = 1").collect()}
    assert toxic >= set(range(200, 240)) and not toxic & set(range(100, 140))
    assert ids(mild) == Counter(r["doc_id"] for r in before.collect() if r["doc_id"] not in toxic)

    rows = mild.collect()
    plain = {(r["doc_id"], r["text"]): re.sub(r"[\x20\x09-\x0D]+", "", r["text"] or "") for r in rows}
    assert ids(exact) == first_of_groups(rows, plain, lambda r: (-len(r["text"] or ""), key(r["doc_id"])))

    rows = exact.collect()
    roots = linked([fingerprint(r["text"]) for r in rows], 4)
    group = {(r["doc_id"], r["text"]): root for r, root in zip(rows, roots)}
    assert ids(near) == first_of_groups(rows, group, lambda r: key(r["doc_id"]))

    assert ids(clean) == Counter(r["doc_id"] for r in near.collect() if not contaminated(r["text"]))
    assert not {400, 401} & ids(clean).keys() and ids(clean)[402] == ids(clean)[403] == 1

    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", lower(r["text"]))) for r in clean.collect()}
    took, target, largest = Counter(), {}, Counter()
    source = {r["doc_id"]: r["source"] for r in clean.collect()}
    for r in mixed.collect():
        assert r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        own = source[r["doc_id"]]
        took[own] += r["taken"]
        target[own] = r["target"]
        largest[own] = max(largest[own], r["size"])
    assert sum(ids(mixed).values()) == sum(ids(clean).values())
    assert all(abs(took[s] - target[s]) <= largest[s] for s in target)
    assert ids(corpus_pipeline.run(spark, folder)) == ids(mixed)


def test_empty_tables_go_through(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{folder}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
