"""Operators against brute force on small data, and both ways of every size-dependent plan."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from citeframe import session
from citeframe.functions import text
from citeframe.functions.vocab import PRICES
from citeframe.operators import costs, entities, evals, responses, tfidf
from citeframe.operators.joins import lookup_join
from citeframe.operators.ranking import best_first, distributed_rank, placed, top_k
from citeframe.sources import cases as case_source
from citeframe.sources import querylog


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_lookup_join_both_ways(spark):
    # one key holds a third of the big side
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    small = session.cut(spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")))
    for how in ("inner", "left", "left_semi"):
        near = lookup_join(big, small, ["k"], ["id"], how=how)
        far = lookup_join(big, small, ["k"], ["id"], how=how, limit=0, hot_rows=100)
        assert rows(near) == rows(far.select(near.columns))


def test_payload_is_observed(spark):
    df = session.cut(spark.createDataFrame([("abc", 1), (None, 2)], "s string, n int"))
    assert session.payload_bytes(df) == 2 * 16 * 2 + 3


def test_distributed_rank_matches_the_window(spark):
    df = spark.range(5000).select(
        F.col("id").alias("row_idx"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        (F.col("id") % 11).alias("score"),
    )
    order = [F.col("score").desc(), F.col("row_idx").asc()]
    expected = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    got = distributed_rank(df, ["g"], order)
    assert rows(got.select("g", "row_idx", "rn")) == rows(expected.select("g", "row_idx", "rn"))
    whole = distributed_rank(df, [], [F.col("row_idx").desc()])
    assert whole.where(F.col("rn") != 5000 - F.col("row_idx")).count() == 0


def test_placed_matches_the_window(spark):
    df = spark.range(5000).select(
        (F.col("id") * 7919 % 5000).alias("row_idx"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        (F.col("id") % 11).alias("size"),
    )
    w = Window.partitionBy("g").orderBy("row_idx")
    want = df.withColumn("place", F.row_number().over(w)).withColumn("before", F.sum("size").over(w) - F.col("size"))
    got = placed(df, "g", "row_idx", "size")
    assert rows(got.select("g", "row_idx", "place", "before")) == rows(want.select("g", "row_idx", "place", "before"))


def brute_force_names(questions, names, stops):
    import re

    hits = set()
    for q in questions:
        clean = re.sub(r"[^\w\s]", " ", q)
        said = set(clean.split())
        for name in names:
            words = name.split()
            own = [w for w in words if w not in stops]
            pairs = [(a, b) for a, b in zip(words, words[1:]) if not (a in stops and b in stops)]
            if any(f"{a} {b}" in clean for a, b in pairs):
                hits.add((q, name))
            if sum(w in said for w in own) >= 2 or name in clean:
                hits.add((q, name))
    return hits


@pytest.mark.parametrize("seed", range(4))
def test_names_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["of", "the", "law", "lawn", "art", "arts", "a", "b", "hotel", "mart", "law-art"]
    stops = ("of", "the")
    name = lambda: rng.choice([" ", "  ", " & "]).join(rng.choices(words, k=rng.randint(1, 4)))
    records = spark.createDataFrame([(name(),) for _ in range(40)] + [("&&",), ("law law",)], "name string")
    asked = sorted({" ".join(rng.choices(words + ["xlaw", "artsy", "x&y"], k=rng.randint(1, 6))) for _ in range(60)})
    unique = spark.createDataFrame([(q,) for q in asked], "uq string")
    keys = [r[0] for r in records.select(entities.name_key(F.col("name"))).distinct().collect()]
    got = {(r["uq"], r["name_key"]) for r in entities.match_names(unique, records, stops).collect()}
    assert got == brute_force_names(asked, keys, stops)


def test_tfidf_against_brute_force(spark):
    import math

    docs = {1: "red fox red dog", 2: "red cat", 3: "", 4: "blue fox", 5: "the the"}
    df = spark.createDataFrame(list(docs.items()), "id long, text string")
    index = tfidf.Index(df, "id", "text")
    terms = lambda t: (w := [x for x in t.split() if x != "the"]) + [f"{a} {b}" for a, b in zip(w, w[1:])]
    df_of = {}
    for t in docs.values():
        for x in set(terms(t)):
            df_of[x] = df_of.get(x, 0) + 1
    idf = {x: math.log((1 + len(docs)) / (1 + n)) + 1 for x, n in df_of.items()}

    def vec(t):
        v = {}
        for x in terms(t):
            if x in idf:
                v[x] = v.get(x, 0) + idf[x]
        n = math.sqrt(sum(c * c for c in v.values()))
        return {x: c / n for x, c in v.items()}

    queries = spark.createDataFrame([(1, "Red fox!"), (2, "unknown"), (3, "blue red cat")], "q long, text string")
    got = {(r["q"], r["id"]): r["score"] for r in index.scores(queries, "q", "text").collect()}
    expected = {}
    for q, t in [(1, "red fox"), (2, "unknown"), (3, "blue red cat")]:
        for d, text in docs.items():
            s = sum(w * vec(text).get(x, 0) for x, w in vec(t).items())
            if s > 0:
                expected[q, d] = s
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-12 for k in got)
    # the shuffled way gives the same
    vector = index.vector(queries, "q", "text")
    counts = index.counts.join(index.doc_norms.select("id", "norm"), "id")
    far = lookup_join(counts, vector, ["term"], ["id"], limit=0, hot_rows=1).groupBy("q", "id").agg(
        F.sum(F.col("tf") / F.col("norm") * F.col("coef")).alias("score")
    )
    assert {(r["q"], r["id"]): round(r["score"], 12) for r in far.collect()} == {k: round(s, 12) for k, s in got.items()}


@pytest.mark.parametrize("k", [1, 3])
def test_pruned_top_k_is_exact(spark, k):
    rng = random.Random(7)
    words = ["all", "most", *[f"w{i}" for i in range(60)]]
    weights = [40, 25, *[60 / (i + 5) for i in range(60)]]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(3, 25)))) for i in range(400)]
    asked = [(i, " ".join(rng.choices(words, k=rng.randint(1, 5)))) for i in range(80)] + [(80, "all"), (81, "all most")]
    index = tfidf.Index(spark.createDataFrame(docs, "row_idx long, text string"), "row_idx", "text", stops=())
    vector = index.vector(spark.createDataFrame(asked, "q long, text string"), "q", "text")
    best = lambda scored: rows(
        top_k(scored, ["q"], best_first(), k).select("q", "rn", "row_idx", F.round("score", 9))
    )
    pruned = tfidf.top_pairs(index.counts, index.doc_norms, vector, "q", "row_idx", k)
    assert best(pruned) == best(tfidf.cosine_pairs(index.counts, index.doc_norms, vector, "q", "row_idx"))


RESPONSES = [
    ('{"answer":"a","citations":["x"],"answered":true}', True),
    ('```json\n{"answer":"a","citations":[],"answered":false,"reason_if_unanswered":"r"}\n```', True),
    ('{"answer":"a","citations":[],"answered":"true"}', True),
    ('{"answer":"a","citations":[],"answered":1}', True),
    ('{"answer":"a","citations":[],"answered":2}', False),
    ('{"answer":1,"citations":[],"answered":true}', False),
    ('{"answer":"a","citations":[1],"answered":true}', False),
    ('{"answer":"a","citations":["x",null],"answered":true}', False),
    ('{"answer":"a","citations":"x","answered":true}', False),
    ('{"answer":"a","citations":[]}', False),
    ('{"answer":"a","citations":["x"],"answered":true} and {"b":1}', False),
    ('{"answer":"a","citations":["x"],"answered":true},{"b":1}', False),
    ('{"answer":"a","citations":["x"],"answered":true},"z":{}', False),
    ('{"answer":"a","citations":["x"],"answered":true,"reason_if_unanswered":5}', False),
    ("no object here", False), ("} backwards {", False), ("", False),
]


def test_validation(spark):
    df = spark.createDataFrame(
        [(i, t, None, None) for i, (t, _) in enumerate(RESPONSES)],
        "resp_id long, raw_text string, error_type string, error_message string",
    )
    got = {r["resp_id"]: r for r in responses.validate(df).collect()}
    assert [got[i]["valid"] for i in range(len(RESPONSES))] == [ok for _, ok in RESPONSES]
    for i, (text, ok) in enumerate(RESPONSES):
        if not ok:
            r = got[i]
            assert (r["answer"], r["citations"], r["answered"], r["quarantined"]) == ("", [], False, text)
            assert r["reason_if_unanswered"].startswith("Model failed schema validation")


def test_only_texts_that_may_be_json_are_parsed(spark):
    """Trimming and parsing are left out only where they change nothing."""
    starts = [chr(i) for i in range(128)] + ["\x85", "\u2028", "\u3000", "\ufeff", "\u00e9", "\U0001f600"]
    odd = [c + t for c in starts for t in ("", "1", "rue", "ull", "]", "x ", "\n", "}", ' {"a": 1} x', ', "b": {}}')]
    texts = ["I do not know.", '{"answer": "x", "citations": ["R1', *odd]
    d = spark.createDataFrame([(t,) for t in [None, *texts]], "t string")
    spaces = rf"^{text.SP}+|{text.SP}+$"
    plain = F.regexp_replace("t", spaces, "")
    parsed = lambda c: F.to_json(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))))
    found = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    whole = F.when(found != "", found).otherwise(plain)
    mine = responses.json_object(F.col("t"))
    got = d.select(
        "t", plain.alias("plain"), text.strip(F.col("t")).alias("trimmed"), whole.alias("whole"), mine.alias("mine"),
        parsed(whole).alias("parsed"), responses.may_be_json(mine).alias("may"),
    ).collect()
    assert all(r["plain"] == r["trimmed"] and r["whole"] == r["mine"] and (r["may"] or r["parsed"] is None) for r in got)
    may = {r["t"]: r["may"] for r in got}
    assert not any(may[t] for t in texts[:2]) and sum(not m for m in may.values()) > len(odd) / 2


def test_published_cost(spark):
    call = spark.createDataFrame([("gemini-3.1-flash-lite", 1211.5, 132.0, 1.243)], "model string, input_tokens double, output_tokens double, latency_s double")
    r = costs.cost_by_model(costs.with_cost(call)).first()
    assert (r["avg_cost_inr_per_query"], r["cost_inr_per_1000_queries"]) == (0.0436, 43.58)


def test_summary_is_of_the_last_model(spark):
    calls = spark.createDataFrame(
        [(1, "a", 10, 1, 0.5), (2, PRICES[1][0], 20, 2, 1.0), (3, "a", 30, 3, 1.5)],
        "seq long, model string, input_tokens long, output_tokens long, latency_s double",
    )
    got = costs.active_summary(costs.with_cost(calls), "seq").collect()
    assert [(r["model"], r["queries_measured"], r["avg_input_tokens"]) for r in got] == [("a", 2, 20.0)]
    assert costs.active_summary(costs.with_cost(calls.limit(0)), "seq").count() == 0


def test_log_is_tolerant_and_masked(spark, tmp_path):
    entries = spark.createDataFrame(
        [("mail a@b.org", "call 9876543210", [], True, None, "m", 10, 1, 0.5, 0.1),
         ("q2", "a2", ["C1"], False, "from a@b.org", None, None, None, None, None)],
        "question string, answer string, citations array<string>, answered boolean, reason_if_unanswered string,"
        "model string, input_tokens long, output_tokens long, latency_s double, cost_inr double",
    )
    path = str(tmp_path / "log")
    querylog.append_log(entries, path)
    querylog.append_log(entries, path)
    (tmp_path / "log" / "bad.json").write_text(
        '\n  \nnot json\n{"question": "q", "cost": {"input_tokens": 1}}\n{"cost": {"input_tokens": 1, "output_tokens": 1, "latency_s": 1, "model": "m"}}\n'
    )
    read = querylog.read_log(spark, path)
    assert read.where("question = 'mail [EMAIL_MASKED]' AND result.answer = 'call [PHONE_MASKED]'").count() == 2
    assert read.where("result.reason_if_unanswered = 'from [EMAIL_MASKED]'").count() == 2
    assert querylog.measured_calls(read).count() == 2
    assert entries.where("question = 'mail a@b.org'").count() == 1


def test_cost_report_files(spark, tmp_path):
    calls = spark.createDataFrame(
        [(1, "q1", "a", 10, 1, 0.5), (2, "q2", "a", 20, 2, 1.0)],
        "seq long, question string, model string, input_tokens long, output_tokens long, latency_s double",
    )
    costs.save_report(costs.with_cost(calls), "seq", str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "kind=entry")).count() == 2
    assert spark.read.json(str(tmp_path / "report" / "kind=summary")).first()["queries_measured"] == 2


def test_eval_checks(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text(
        '[{"id": "a", "question": "q1", "expected_answered": true, "expected_citations": ["C2", "C1"], "required_substrings": ["Fee"], "note": "n"},\n'
        ' {"id": "b", "question": "q1", "expected_citations": [], "required_substrings": []},\n'
        ' {"id": "c", "question": "q1", "expected_citations_any_of": ["C9"], "forbidden_substrings": ["FEE", "x"]},\n'
        ' {"id": "d", "question": "q2", "expected_answered": false, "expected_citations": []}]'
    )
    answers = spark.createDataFrame(
        [("q1", "The fees", ["C1", "C2", "C1"], True), ("q2", None, None, None)],
        "question string, answer string, citations array<string>, answered boolean",
    )
    scored = evals.score(case_source.read_cases(spark, str(path)), answers, "question")
    got = {r["case_id"]: r["failures"] for r in scored.collect()}
    assert got == {
        "a": [],
        "b": ["citations=['C1', 'C2'], expected=[]"],
        "c": ["citations=['C1', 'C2'] matched none of ['C9']", "contains forbidden substring: 'FEE'"],
        "d": [],
    }
    assert tuple(evals.pass_rate(scored).first()) == (2, 4, 50.0)
    assert tuple(evals.pass_rate(scored.limit(0)).first()) == (0, 0, None)


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("row_idx"))
    plan = top_k(df, ["g"], [F.col("row_idx").asc()], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_cost_stream_equals_batch(spark, tmp_path):
    from citeframe.streaming.costs import cost_stream, keep_latest

    entries = spark.createDataFrame(
        [(f"q{i}", "a", [], True, None, PRICES[i % 3][0], 10 * i, i, i / 10, 0.0) for i in range(30)],
        "question string, answer string, citations array<string>, answered boolean, reason_if_unanswered string,"
        "model string, input_tokens long, output_tokens long, latency_s double, cost_inr double",
    )
    path = str(tmp_path / "log")
    querylog.append_log(entries, path)
    for _ in range(2):
        query = keep_latest(cost_stream(spark, path, 1), str(tmp_path / "out"), str(tmp_path / "ckpt"))
        query.awaitTermination(120)
        assert query.exception() is None
        batch = costs.cost_by_model(costs.with_cost(querylog.measured_calls(querylog.read_log(spark, path))))
        latest = spark.read.parquet(str(tmp_path / "out")).drop("epoch")
        assert rows(latest.select(batch.columns)) == rows(batch)
        querylog.append_log(entries, path)


def test_substrings_by_their_rarest_gram(spark):
    rng = random.Random(8)
    word = lambda a, b: "".join(rng.choices("abc é", k=rng.randint(a, b)))
    texts, patterns = {word(0, 14) for _ in range(150)}, {word(1, 6) for _ in range(120)} | {"zzz", "abcz"}
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    p = spark.createDataFrame([(x,) for x in patterns], "p string")
    assert rows(entities.substring_pairs(t, p)) == sorted((x, y) for x in texts for y in patterns if y in x)
    assert entities.substring_pairs(t, p.limit(0)).count() == 0


def test_a_long_question_makes_rows_for_its_words_not_their_pairs(spark):
    from citeframe.session import cut, store

    names = [f"word{k} word{k + 1} common" for k in range(5000)]
    table = entities.distinct_names(spark.createDataFrame([(x,) for x in names], "name string"), ("of",))
    pairs = cut(entities.name_word_pairs(table).select("w1", "w2").distinct())
    said = store(spark.createDataFrame([(1, f"word{k}") for k in range(5000)] + [(1, "common"), (2, "common")], "n long, word string"), "said")
    led = lookup_join(said.withColumnRenamed("word", "w1"), pairs, ["w1"], ["n"])
    assert led.count() < 4 * 5000
    question = " ".join(f"word{k}" for k in range(0, 5000, 2))
    unique = spark.createDataFrame([(question + " common",), ("common",)], "uq string")
    got = {r["name_key"] for r in entities.match_two_words(unique, table).collect()}
    assert got == set(names[:-1])


def test_blank_and_empty_names(spark):
    records = spark.createDataFrame([("&&",), ("",), (None,), ("  ",), ("a",)], "name string")
    unique = spark.createDataFrame([("x y",), ("x  y",), ("",), ("banana",)], "uq string")
    got = {(r["uq"], r["name_key"]) for r in entities.match_names(unique, records, ("of",)).collect()}
    assert got == {(q, "") for q in ("x y", "x  y", "", "banana")} | {("x  y", "  "), ("banana", "a")}


def test_a_batch_appended_twice_is_read_once(spark, tmp_path):
    schema = (
        "seq long, question string, answer string, citations array<string>, answered boolean, reason_if_unanswered string,"
        "model string, input_tokens long, output_tokens long, latency_s double, cost_inr double"
    )
    entry = lambda k: (k, f"q{k}", "a", [], True, None, "m", 1, 1, 0.5, 0.1)
    one, two = spark.createDataFrame([entry(1), entry(2)], schema), spark.createDataFrame([entry(3)], schema)
    path = str(tmp_path / "log")
    assert querylog.read_batches(spark, path).count() == 0
    assert querylog.append_batch(one, path, "a") and not querylog.append_batch(one, path, "a")
    # an attempt that wrote its rows and died, and one that lost the race to commit
    querylog.log_rows(one).write.json(f"{path}/data/batch=b/try=dead")
    assert querylog.append_batch(two, path, "b")
    assert not querylog.write_once(spark, f"{path}/commits/b", "batch=b/try=dead")
    got = [(r["batch"], r["seq"]) for r in querylog.read_batches(spark, path).orderBy("seq").collect()]
    assert got == [("a", 1), ("a", 2), ("b", 3)]
    assert querylog.measured_calls(querylog.read_batches(spark, path)).count() == 3
    for name in ("", "a/b", "../x", "_x"):
        with pytest.raises(ValueError):
            querylog.append_batch(one, path, name)


def test_rejected_lines_by_reason_and_file(spark, tmp_path):
    good = '{"question": "q", "cost": {"input_tokens": 1, "output_tokens": 1, "latency_s": 1, "model": "m"}}'
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text(f'{good}\n\n \t\nnot json\n{{"question": "q"}}\n')
    (tmp_path / "log" / "b.json").write_text('[1]\n{"question": "q", "cost": {"model": "m"}}\n{"cost": 3}\n"text"\n' + good + "\n")
    found = querylog.rejected(spark, str(tmp_path / "log"))
    got = {(r["file"].rpartition("/")[2], r["reason"]): r["n_lines"] for r in querylog.rejects_by_file(found).collect()}
    assert got[("a.json", "blank")] == 2 and got[("a.json", "malformed")] == 1 and got[("a.json", "no cost")] == 1
    assert got[("b.json", "missing key")] == 1 and sum(n for (f, _), n in got.items() if f == "b.json") == 4
    assert querylog.rejected(spark, str(tmp_path / "none")).count() == 0
    assert sum(got.values()) + querylog.read_log(spark, str(tmp_path / "log")).where("cost.model = 'm' and question = 'q'").count() >= 9


def test_histogram_buckets_hold_about_equal_numbers(spark):
    from citeframe.operators.profile import constraint_histogram

    rows = [(float(k % 40), None, None, 1 + k % 3) for k in range(400)] + [(7.0, 50.0, None, 500)]
    df = spark.createDataFrame(rows, "max_fee double, own_score double, min_placement double, n_questions long")
    got = constraint_histogram(df, 4).orderBy("kind", "bucket").collect()
    budget = [r for r in got if r["kind"] == "budget"]
    assert [r["low"] for r in budget] == sorted(r["low"] for r in budget) and sum(r["n_questions"] for r in budget) == sum(x[3] for x in rows)
    assert all(a["high"] < b["low"] for a, b in zip(budget, budget[1:])) and sum(r["n_values"] for r in budget) == 40
    assert [(r["kind"], r["n_values"], r["n_questions"]) for r in got if r["kind"] != "budget"] == [("cutoff", 1, 500)]
