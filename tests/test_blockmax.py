"""Block-max postings against scores of all pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citeframe.operators.ranking import best_first, top_k
from citeframe.operators.tfidf import Index, cosine_pairs, leads, term_counts, weigh
from citeframe.session import cut, payload_bytes


def texts(spark, n=900):
    """Common words everywhere, words of a topic, and texts that repeat, so that scores tie."""
    r = random.Random(4)
    topics = [[f"topic{t}word{k}" for k in range(12)] for t in range(15)]
    rows = []
    for i in range(n):
        words = ["common"] * r.randint(0, 2) + ["often"] * (i % 2) + r.choices(topics[i % 15], k=r.randint(1, 9))
        rows.append((i, " ".join(words), i % 4))
    rows += [(n + k, "common often topic3word1", k % 4) for k in range(40)] + [(n + 50, None, 0), (n + 51, "", 1)]
    return spark.createDataFrame(rows, "row_idx long, text string, side int").withColumn("text", F.coalesce("text", F.lit("")))


def questions(spark):
    asked = [f"common topic{t}word{k} often topic{t}word{k + 1}" for t in range(15) for k in range(3)]
    asked += ["common", "often common", "topic3word1 common often", "nothing known", ""]
    return spark.createDataFrame([(k, t, k % 4) for k, t in enumerate(asked)], "uid long, q string, want int")


def best(df, k):
    ranked = top_k(df, ["uid"], best_first(), k)
    return {(r["uid"], r["rn"], r["row_idx"], round(r["score"], 9)) for r in ranked.collect()}


@pytest.mark.parametrize("k,block", [(5, 16), (1, 4), (30, 16), (5, 100_000)])
def test_top_k_is_that_of_all_pairs(spark, k, block):
    index = Index(texts(spark).select("row_idx", "text"), "row_idx", "text")
    vector = index.vector(questions(spark), "uid", "q")
    blocks = index.block_max(vector)
    blocks.block = block
    every = cosine_pairs(index.counts.select("row_idx", "term", "tf"), index.doc_norms, vector, "uid", "row_idx")
    assert best(blocks.top_pairs(vector, "uid", k), k) == best(every, k)


def test_top_k_among_admitted_pairs(spark):
    docs, asked = texts(spark), questions(spark)
    index = Index(docs.select("row_idx", "text"), "row_idx", "text")
    vector = index.vector(asked, "uid", "q").join(asked.select("uid", "want"), "uid")
    blocks = index.block_max(vector)
    blocks.block = 16
    sides = docs.select("row_idx", "side")
    got = blocks.top_pairs(vector, "uid", 5, sides, F.col("side") == F.col("want"))
    every = cosine_pairs(index.counts.select("row_idx", "term", "tf"), index.doc_norms, vector.select("uid", "term", "coef"), "uid", "row_idx")
    kept = every.join(sides, "row_idx").join(asked.select("uid", "want"), "uid").where("side = want")
    assert best(got, 5) == best(kept, 5)


def test_most_blocks_are_not_read(spark):
    index = Index(texts(spark, 6000).select("row_idx", "text"), "row_idx", "text")
    vector = index.vector(questions(spark), "uid", "q")
    blocks = index.block_max(vector)
    blocks.block = 16
    first, further, bounds = blocks.plan(vector, "uid", 5, lambda pairs: pairs)
    topical = bounds.where("uid < 45")
    read = further.where("uid < 45").count() + 45 * 2
    assert read < topical.count() / 5
    assert first.count() > 0


def test_a_saved_index_ranks_without_shuffling_itself(spark, tmp_path):
    from citeframe.operators.tfidf import SavedIndex, save_index

    fitted = Index(texts(spark).select("row_idx", "text"), "row_idx", "text", stops=("often",))
    path = str(tmp_path / "index")
    save_index(fitted, path, buckets=3)
    with pytest.raises(ValueError):
        save_index(fitted, path)
    with pytest.raises(ValueError):
        SavedIndex(spark, str(tmp_path / "none"))
    later = spark.newSession()  # knows nothing of this one's tables and views
    saved = SavedIndex(later, path)
    asked = later.createDataFrame([tuple(r) for r in questions(spark).collect()], "uid long, q string, want int")
    scores = saved.scores(asked, "uid", "q")
    plan = scores._jdf.queryExecution().executedPlan().toString()
    # the one exchange is that of the distinct terms asked for
    assert "SortMergeJoin" in plan and plan.count("Bucketed: true") == 2
    assert plan.count("Exchange hashpartitioning(term") == plan.count("Exchange hashpartitioning") == 1
    assert best(scores, 5) == best(fitted.scores(questions(spark), "uid", "q"), 5)
    assert best(saved.top_pairs(asked, "uid", "q", 5), 5) == best(scores, 5)
    saved.close()
    assert not any(later.catalog.tableExists(n) for n in saved.names.values())


def test_terms_of_any_number_are_counted_in_generated_code(spark):
    words = [f"w{n}" for n in (1, 2, 3, 4, 63, 64, 65, 66, 4095, 4096, 4097, 5000) for _ in range(n)]
    rows = [(1, words), (2, words[::-1]), (3, ["a"] * 70), (4, ["b", "a"]), (5, []), (6, None), (None, ["a", "a"]), (None, ["a", "a"])]
    counts = term_counts(spark.createDataFrame(rows, "id int, terms array<string>"))
    wanted = Counter((i, t, n) for i, own in rows for t, n in Counter(own or []).items())
    assert Counter(map(tuple, counts.collect())) == wanted
    assert dict(counts.dtypes)["tf"] == "bigint"
    plan = counts._jdf.queryExecution().executedPlan().toString()
    # looked at where they are exploded, terms made once
    assert "lambdafunction" not in plan and plan.count("sort_array") == 1 and "posexplode" in plan


@pytest.mark.parametrize("frozen", [False, True])
def test_an_index_lies_in_buckets_and_is_saved_bucket_by_bucket(spark, tmp_path, monkeypatch, frozen):
    from citeframe.operators.tfidf import SavedIndex, save_index

    docs = texts(spark).select("row_idx", "text").unionByName(spark.createDataFrame([(None, "often rare"), (10_000, None)], "row_idx long, text string"))
    fitted = Index(docs, "row_idx", "text", Index(docs, "row_idx", "text").idf.localCheckpoint() if frozen else None)
    for rows, by in [(fitted.counts, "row_idx")] + [(fitted.idf, "term")] * (not frozen):
        assert "Exchange" not in rows.groupBy(by).count()._jdf.queryExecution().executedPlan().toString()
    conf = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    assert fitted.doc_norms.count() == docs.count()
    kind, dealt = type(fitted.counts), []
    plain = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda df, *by: dealt.append(sorted(df.columns)) or plain(df, *by))
    save_index(fitted, str(tmp_path / "index"))
    monkeypatch.undo()
    assert dealt == [["lead", "norm", "row_idx"]] + [["df", "idf", "n_docs", "term"]] * frozen
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == conf
    saved = SavedIndex(spark, str(tmp_path / "index"))
    for mine, theirs in ((saved.counts, fitted.counts), (saved.idf, fitted.idf), (saved.doc_norms, fitted.doc_norms)):
        assert Counter(map(tuple, mine.collect())) == Counter(map(tuple, theirs.select(mine.columns).collect()))
    # in the buckets Spark looks for them in
    assert saved.counts.join(saved.doc_norms.hint("merge"), "row_idx").count() == fitted.counts.where("row_idx is not null").count()
    saved.close()


def test_pairs_are_scored_where_the_texts_lie(spark):
    docs, asked = texts(spark), questions(spark)
    index = Index(docs.select("row_idx", "text"), "row_idx", "text")
    vector = index.vector(asked, "uid", "q")
    every = cosine_pairs(index.counts.select("row_idx", "term", "tf"), index.doc_norms, vector, "uid", "row_idx")
    blocks = index.block_max(vector)
    blocks.block = 16
    near = blocks.top_pairs(vector, "uid", 5, told=-1)
    assert best(near, 5) == best(every, 5)
    assert near.count() < every.count() / 4  # those that reach the k-th best
    limited = cut(vector.join(asked.select("uid", "want"), "uid"))
    sides = docs.select("row_idx", "side")
    kept = every.join(sides, "row_idx").join(asked.select("uid", "want"), "uid").where("side = want")
    got = blocks.top_pairs(limited, "uid", 5, sides, F.col("side") == F.col("want"), told=-1)
    assert best(got, 5) == best(kept, 5)


@pytest.mark.parametrize("own", [True, False])
def test_frequent_terms_are_weighed_without_a_shuffle(spark, own):
    index = Index(texts(spark).select("row_idx", "text"), "row_idx", "text")
    counts = index.counts.select("row_idx", "term", "tf")
    near = weigh(counts, index.idf, "row_idx", own)
    far = weigh(counts, index.idf, "row_idx", own, limit=payload_bytes(index.idf) // 4)
    assert sorted(map(tuple, far.select(near.columns).collect())) == sorted(map(tuple, near.collect()))
    assert far.count() > 0
    plan = far._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1
    assert sorted(map(tuple, weigh(counts, index.idf, "row_idx", own, limit=1).select(near.columns).collect())) == sorted(map(tuple, near.collect()))


def test_norms_are_formed_without_sorting_rows_and_leads_are_the_heaviest_terms(spark):
    docs = texts(spark, 300).select("row_idx", "text").unionByName(texts(spark, 3).select("row_idx", "text"))
    index = Index(docs, "row_idx", "text")
    weighed = weigh(index.counts, index.idf, "row_idx")
    assert "SortAggregate" not in index.norms()._jdf.queryExecution().executedPlan().toString()
    w = F.col("tf") * F.col("idf")
    heaviest = weighed.groupBy("row_idx").agg(F.max(F.struct(w, "term"))["term"].alias("lead"))
    wanted = {(r["row_idx"], r["lead"]) for r in heaviest.collect()}
    for groups, limit in ((1, 1 << 26), (7, 10_000), (1 << 20, 10_000), (1 << 20, 10)):
        found = leads(index.counts, index.idf, index.lengths, "row_idx", True, groups, limit).collect()
        assert len(found) == len(wanted) and {(r["row_idx"], r["lead"]) for r in found} == wanted
    stored = index.doc_norms.collect()
    assert len(stored) == docs.count() and all(r["lead"] is None for r in stored if r["norm"] == 0)
