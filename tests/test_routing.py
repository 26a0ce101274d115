"""Routing and eligibility over the published catalogue, loaded from CSV."""

import csv
from collections import Counter

import pytest
from pyspark.sql import functions as F

import goldens as g
from citeframe.functions.vocab import COLLEGES
from citeframe.operators import context, eligibility, joins
from citeframe.functions import vocab as v
from citeframe.operators.context import context_blocks, paragraph, paragraphs, pool_texts, prompt_parts
from citeframe.operators.retrieve import Retrieval
from citeframe.sources.catalog import CSV_SCHEMA, document, normalise, number_rows, read_catalog_csv


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("catalog") / "colleges.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow([field.name for field in CSV_SCHEMA.fields])
        for i, (cid, name, kind, fee, cutoff, hostel, placement, courses) in enumerate(g.COLLEGES):
            about = f'Said "to be" number {i},\nwith a line break'
            out.writerow([cid, name, "City", "State", kind, courses, fee, cutoff, 100, hostel, "A", placement, 2000, about])
    numbered = number_rows(read_catalog_csv(spark, str(path)), "record_id")
    return normalise(numbered, COLLEGES).cache()


@pytest.fixture(scope="module")
def run(spark, records):
    rows = [(i, q) for i, (q, _, _) in enumerate(g.ROUTES)]
    return Retrieval(records, spark.createDataFrame(rows, "qid long, question string"), COLLEGES)


def test_csv_scan(records):
    rows = {r["record_id"]: r for r in records.collect()}
    assert len(rows) == 15
    assert [rows[f"C{i + 1:03d}"]["row_idx"] for i in range(15)] == list(range(15))
    assert rows["C005"]["flag"] is False and rows["C001"]["flag"] is True
    assert rows["C002"]["course_list"] == ["BBA", "B.Com", "BCA", "MBA"]
    assert rows["C003"]["about"] == 'Said "to be" number 2,\nwith a line break'
    assert rows["C013"]["categories"] == ["diploma", "pharmacy"]


def test_routes(run):
    got = {r["uq"]: r["route"] for r in run.routed.collect()}
    assert got == {q.lower(): route for q, route, _ in g.ROUTES}


def test_pools(run):
    spelled = run.unique.select("uid", "uq")
    pools: dict[str, set[str]] = {}
    for wide in (False, True):
        found = run.pool(wide).join(spelled, "uid").join(run.records, "row_idx")
        for r in found.select("uq", "record_id").collect():
            pools.setdefault(r["uq"], set()).add(r["record_id"])
    for q, _, expected in g.ROUTES:
        assert pools.get(q.lower(), set()) == expected, q


def test_ranking_stays_in_the_pool(run):
    ids = run.records.select("row_idx", "record_id")
    top: dict[str, list[str]] = {}
    for r in run.ranked(5).join(ids, "row_idx").orderBy("uq", "rn").collect():
        top.setdefault(r["uq"], []).append(r["record_id"])
    whole: dict[str, list[str]] = {}
    for r in run.ranked_whole().join(ids, "row_idx").orderBy("uq", "rn").collect():
        whole.setdefault(r["uq"], []).append(r["record_id"])
    for q, _, pool in g.ROUTES:
        if q.lower() in whole:
            assert q.lower() not in top
            assert len(whole[q.lower()]) == len(pool) and set(whole[q.lower()]) == pool
        else:
            got = top.get(q.lower(), [])
            assert len(got) == min(5, len(pool)) and set(got) <= pool, q


def test_prompt_parts_put_together_are_the_prompts(spark, records):
    """Of all questions with records: bounded ones, and exhaustive ones over every kind of pool."""
    asked = [q for q, _, _ in g.ROUTES] + ["any zzz", "Any ZZZ", "every zzz with fees under 2 lakh", "any bca zzz"]
    run = Retrieval(records, spark.createDataFrame(list(enumerate(asked)), "qid long, question string"), COLLEGES)
    texts = {r["row_idx"]: r["text"] for r in records.select("row_idx", paragraph().alias("text")).collect()}
    ranked: dict[int, list[tuple[int, int]]] = {}
    for r in run.ranked_by_question(5).collect():
        ranked.setdefault(r["qid"], []).append((r["rn"], r["row_idx"]))
    places = {(r["pool"], r["place"]): r["text"] for r in pool_texts(run).collect()}
    got: dict[int, list] = {}
    for r in prompt_parts(run, 5).orderBy("qid", "part").collect():
        got.setdefault(r["qid"], []).append(r)
    empty = {i for i, (_, _, pool) in enumerate(g.ROUTES) if not pool}
    assert got.keys() == ranked.keys() == set(range(len(asked))) - empty
    kinds = set()
    for qid, parts in got.items():
        said = ""
        for r in parts:
            kinds.add(r["kind"])
            if r["kind"] == "range":
                own = [places[r["pool"], k] for k in range(r["first"], r["last"] + 1)]
                text = ("\n\n" if r["part"] > 1 else "") + "\n\n".join(own)
            else:
                text = r["text"]
            assert len(text) == r["n_chars"]
            said += text
        context = "\n\n".join(texts[row] for _, row in sorted(ranked[qid]))
        assert said == v.PROMPT_HEAD + context + v.PROMPT_QUESTION + asked[qid] + v.PROMPT_TAIL
    assert kinds == {"head", "record", "range", "question"}


def test_shared_rows_are_repeated_for_askers_last(spark, records):
    """Nothing is shuffled or looked at again once there is a row for each question."""
    asked = [(i, q) for i, q in enumerate(["any zzz", "ANY ZZZ", "hostel", "every zzz with fees under 2 lakh"] * 3)] + [(None, "any zzz"), (0, "any zzz")]
    run = Retrieval(records, spark.createDataFrame(asked, "qid long, question string"), COLLEGES)
    whole = run.ranked_by_question(5, lambda ranked: run.with_ids(ranked, "uid").select("uid", "rn", "record_id"))
    parts = prompt_parts(run, 5, digest=F.md5("text"))
    for found in (whole, parts):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Generate explode(_a" in plan and "Join" not in plan[: plan.index("Generate explode(_a")]
        assert "Exchange" not in plan[: plan.index("Generate explode(_a")]
        assert "md5" not in plan[plan.index("Generate explode(_a") :]
    ids = {r["row_idx"]: r["record_id"] for r in records.collect()}
    plain = sorted(((-1 if r["qid"] is None else r["qid"]), r["rn"], ids[r["row_idx"]]) for r in run.ranked_by_question(5).collect())
    assert sorted(((-1 if r["qid"] is None else r["qid"]), r["rn"], r["record_id"]) for r in whole.collect()) == plain
    # one asks twice, one has no number
    assert sum(r[0] == 0 for r in plain) == 2 * sum(r[0] == 1 for r in plain) == 2 * sum(r[0] == -1 for r in plain) == 30


@pytest.mark.parametrize(("limit", "answers"), [(1 << 26, 4_000_000), (1 << 26, 50), (-1, 4_000_000), (-1, 50)])
def test_each_asker_gets_every_shared_row(spark, tmp_path, limit, answers):
    rows = [(k, n) for k in range(5) for n in range(40 if k == 0 else 3)] + [(9, 0)]
    askers = [(0, i) for i in range(joins.ASKERS + 60)] + [(1, 7), (1, 7), (2, None), (2, 7), (3, 5), (8, 5)]
    shared = spark.createDataFrame(rows, "k long, n long")
    asked = spark.createDataFrame(askers, "k long, who long")
    found = joins.for_each_asker(shared, asked, "k", "who", ["n"], limit, answers).collect()
    wanted = Counter((n, who) for k, n in rows for own, who in askers if k == own)
    assert Counter((r["n"], r["who"]) for r in found) == wanted


def test_pools_are_shared_and_ranges_sparse(spark, records):
    """Many questions over one pool: no row a member, however large the pool."""
    asked = ["show every college", "SHOW EVERY COLLEGE", "list each place", "all with hostel", "all hostel ones", "any zzz", None]
    run = Retrieval(records, spark.createDataFrame(list(enumerate(asked)), "qid long, question string"), COLLEGES)
    sizes = {r["pool"].split(":")[0]: r["n"] for r in run.whole.sizes.collect()}
    assert sizes["open"] == 15 and run.whole.dictionary.count() == sum(r["n"] for r in run.whole.sizes.collect())
    scored, ranges = run.whole.scored.groupBy("uid").count(), run.whole.ranges().groupBy("uid").count()
    counts = ranges.withColumnRenamed("count", "r").join(scored, "uid", "left").fillna(0)
    assert counts.where("r > count + 1").count() == 0
    whole = run.ranked_whole().groupBy("uq").agg(F.count("*").alias("n"), F.countDistinct("rn").alias("d"), F.max("rn").alias("m"))
    assert whole.where("n <> d or n <> m").count() == 0 and whole.count() >= 4


def test_counts_agree_with_pairs(run):
    sigs = eligibility.signatures(run.unique)
    pairs = eligibility.eligible_pairs(sigs, run.records).groupBy("sid").agg(
        F.count("*").alias("n"), F.countDistinct("row_idx").alias("d")
    )
    both = eligibility.eligible_summary(sigs, run.records).join(pairs, "sid", "left")
    assert both.where("n_eligible <> coalesce(n, 0) OR coalesce(n, 0) <> coalesce(d, 0)").count() == 0


LIMITS = [None, 0.0, -0.0, 1.0, 70.0, 82.0, 98_000.0, 1e9, float("inf")]


def test_odd_limits_against_every_pair(spark, records):
    """Zero, infinite and missing limits, alone and together, also for records that lack the figure."""
    from citeframe.operators.profile import WANTS

    sparse = records.withColumns(
        {
            "fee": F.when(F.col("row_idx") % 4 != 1, F.col("fee")),
            "cutoff": F.when(F.col("row_idx") % 5 != 2, F.col("cutoff")),
            "placement": F.when(F.col("row_idx") % 6 != 3, F.col("placement")),
        }
    )
    rows = [(a, b, c) for a in LIMITS for b in LIMITS for c in LIMITS if (a, b, c) != (None, None, None)]
    wanted = spark.createDataFrame(rows, "max_fee double, own_score double, min_placement double")
    for kind, flag, cats in ((None, False, []), ("Private", True, []), (None, False, ["mba", "law"])):
        sigs = wanted.select(
            F.monotonically_increasing_id().alias("sid"), F.lit(kind).cast("string").alias("want_type"),
            F.lit(flag).alias("want_flag"), F.array(*[F.lit(c) for c in cats]).cast("array<string>").alias("want_cats"),
            "max_fee", "own_score", "min_placement",
        ).withColumn("sig", F.to_json(F.struct(*WANTS))).cache()
        plain = sigs.crossJoin(sparse).where(eligibility.is_eligible()).groupBy("sid").agg(
            F.count("*").alias("n"), F.sort_array(F.collect_list("row_idx")).alias("ids")
        )
        plain = {r["sid"]: list(r["ids"]) for r in plain.collect()}
        pairs: dict[int, list[int]] = {}
        for r in eligibility.eligible_pairs(sigs, sparse).collect():
            pairs.setdefault(r["sid"], []).append(r["row_idx"])
        assert {k: sorted(ids) for k, ids in pairs.items()} == plain
        counts = {r["sid"]: r["n_eligible"] for r in eligibility.eligible_summary(sigs, sparse).collect()}
        assert counts == {r["sid"]: len(plain.get(r["sid"], [])) for r in sigs.collect()}
        heads: dict[int, list[int]] = {}
        for r in eligibility.first_eligible(sigs, sparse, 3).collect():
            heads.setdefault(r["sid"], []).append(r["row_idx"])
        assert {k: sorted(ids) for k, ids in heads.items()} == {k: ids[:3] for k, ids in plain.items()}


def test_three_loose_limits_meet_results_only(spark, records):
    """Limits that nearly every record meets, each alone no filter: whatever meets on the keys is a result, and records
    carry no key that nobody asks for."""
    many = records.select(*[c for c in records.columns if c not in ("row_idx", "fee", "cutoff", "placement")]).crossJoin(
        spark.range(200).select(
            F.col("id").alias("row_idx"), (F.col("id") * 7 % 200).cast("double").alias("fee"),
            (F.col("id") * 13 % 200).cast("double").alias("cutoff"), (F.col("id") * 29 % 200).cast("double").alias("placement"),
        )
    ).withColumn("row_idx", F.monotonically_increasing_id())
    sigs = spark.range(60).select(
        F.col("id").alias("sid"), F.lit(None).cast("string").alias("want_type"), F.lit(False).alias("want_flag"),
        F.array().cast("array<string>").alias("want_cats"), (F.col("id") + 120.0).alias("max_fee"),
        (F.col("id") * 2 + 80.0).alias("own_score"), (F.col("id") + 0.0).alias("min_placement"),
    ).cache()
    slotted, slim, reached = eligibility._slotted(sigs, many)
    n_met = eligibility.candidates(slotted, slim, reached, ["row_idx"]).count()
    n_results = sigs.crossJoin(many).where(eligibility.is_eligible()).count()
    assert n_results > 0 and n_met == n_results
    alone = sigs.crossJoin(many).where("fee <= max_fee").count()
    assert alone > 1.5 * n_results
    keyed = eligibility._signature_keys(slotted, reached)
    kept = eligibility._record_keys(slim, keyed, reached, ["row_idx"])
    assert kept.where("k_type <> '*' or k_flag <> '*' or k_cat <> '*'").count() == 0


def test_nothing_eligible_is_never_padded(spark, records):
    rows = [(0, "scored 0 percent overall"), (1, "0 lakh budget"), (2, "budget " + "9" * 400), (3, "placement above " + "9" * 400)]
    asked = Retrieval(records, spark.createDataFrame(rows, "qid long, question string"), COLLEGES)
    found: dict[str, int] = {r["uq"]: r["count"] for r in asked.ranked(5).groupBy("uq").count().collect()}
    assert found == {rows[2][1]: 5}


def test_a_further_constraint_never_widens(spark, records):
    from citeframe.operators.profile import profiled_questions

    base = ["fees under 1.5 lakh", "scored 70", "government colleges", "offer an mba", "placement above 5 lpa"]
    rows = [(0, b) for b in base] + [(1, f"{a}, {b}") for a in base for b in base if a != b]
    qs = spark.createDataFrame(rows, "kind int, question string")
    counts = eligibility.unique_counts(profiled_questions(qs, COLLEGES), records)
    n = {r["uq"]: r["n_eligible"] for r in counts.collect()}
    for a in base:
        for b in base:
            if a != b:
                assert n[f"{a}, {b}".lower()] <= n[a], (a, b)


def test_paragraphs_and_blocks_tell_the_same(run):
    top = run.ranked(5)
    texts: dict[str, list] = {}
    for r in paragraphs(top, run.records).collect():
        texts.setdefault(r["uq"], []).append((r["rn"], r["text"]))
    blocks = {r["uq"]: (r["n_records"], r["context"]) for r in context_blocks(top, run.records).collect()}
    assert blocks == {q: (len(t), "\n\n".join(x for _, x in sorted(t))) for q, t in texts.items()}


def test_digests_of_paragraphs_travel_in_place_of_their_texts(run):
    top = run.ranked(5)
    whole = paragraphs(top, run.records).select("uq", "rn", F.length("text").alias("n"), F.md5("text").alias("m")).collect()
    shown = paragraphs(top, run.records, n=F.length("text"), m=F.md5("text"))
    assert shown.columns == ["uq", "rn", "n", "m"] and sorted(shown.collect()) == sorted(whole)


def test_blocks_write_only_texts_that_are_shown(run, monkeypatch):
    one = run.ranked(5).where("rn = 1").orderBy("uq").limit(1)
    rows = []

    def counted(df, cut=context.cut):
        rows.append((done := cut(df)).count())
        return done

    monkeypatch.setattr(context, "cut", counted)
    assert context_blocks(one, run.records).count() == 1
    assert max(rows) == 1 < run.records.count()


def test_a_record_with_missing_fields_is_kept_and_marked(run):
    bare = run.records.where("record_id = 'C001'").withColumns(
        {c: F.lit(None).cast(t) for c, t in (("about", "string"), ("grade", "string"), ("fee", "long"), ("placement", "double"))}
    )
    text = bare.select(paragraph().alias("t")).first()["t"]
    assert text.count("not stated") == 4 and "last_year_cutoff_pct: " in text and ".0\n" not in text
    assert bare.select(document().alias("d")).first()["d"].count("not stated") == 3
