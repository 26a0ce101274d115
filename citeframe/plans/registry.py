"""Every query by name: a callable from (session, data folder) to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constraints as C
from ..functions import pii
from ..functions.text import tokens
from ..functions.vocab import ENGLISH_STOPS, PARTS
from ..operators import context, costs, dense, eligibility, entities, evals, profile, redact, responses, tfidf
from ..operators.context import context_blocks, contexts_for, no_match_answers, paragraphs, prompts
from ..operators.joins import lookup_join
from ..operators.ranking import best_first, top_k
from ..operators.retrieve import CONSTRAINED, OPEN, Retrieval
from ..session import cut, fresh_path, shuffle_partitions, store
from ..sources import cases as case_source
from ..sources import catalog, querylog, views

K = 5
# Pivots of the pool of all vectors
PIVOTS = 64
# Buckets of a histogram
BUCKETS = 10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


# ---- inputs ----------------------------------------------------------------------------


def _records(spark, sf):
    return catalog.normalise(views.catalog_raw(spark, sf), PARTS)


def _profiled(spark, sf):
    return profile.profiled_questions(views.questions(spark, sf), PARTS)


def _retrieval(spark, sf):
    return Retrieval(_records(spark, sf), views.questions(spark, sf), PARTS)


def _documents(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", "text")


# ---- catalogue ---------------------------------------------------------------------------


@query
def catalog_scan(spark, sf):
    return _records(spark, sf).select(
        "row_idx", "record_id", "name", "city", "state", "type", "fee", "cutoff", "seats", "flag", "grade",
        "placement", "established", F.array_join("course_list", "|").alias("course_list"),
        F.array_join("categories", "|").alias("categories"),
    )


@query
def catalog_csv(spark, sf):
    """The catalogue as a CSV file, read back with its own schema and numbered by business key."""
    path = fresh_path(spark, "catalog-csv")
    views.catalog_raw(spark, sf).select(*[F.col(views.CSV_FROM[f.name]).alias(f.name) for f in catalog.CSV_SCHEMA.fields]).write.option(
        "header", True
    ).option("quote", '"').option("escape", '"').csv(path)
    numbered = catalog.number_rows(catalog.read_catalog_csv(spark, path), "record_id")
    return catalog.normalise(numbered, PARTS).select(
        F.col("row_idx").cast("long").alias("row_idx"), "record_id", "name", "fee", "cutoff", "seats", "flag", "grade", "placement",
        "established", "about", F.array_join("course_list", "|").alias("course_list"),
    )


@query
def catalog_document(spark, sf):
    return catalog.corpus(_records(spark, sf)).select(
        "row_idx", F.length("doc").cast("long").alias("n_chars"), F.md5("doc").alias("doc_md5")
    )


# ---- constraint extraction ---------------------------------------------------------------


@query
def extract_budget(spark, sf):
    return profile.folded_questions(views.questions(spark, sf)).select("qid", C.budget(F.col("_ungrouped")).alias("budget"))


@query
def extract_cutoff(spark, sf):
    return profile.folded_questions(views.questions(spark, sf)).select("qid", C.cutoff(F.col("_folded")).alias("cutoff"))


@query
def extract_placement(spark, sf):
    return profile.folded_questions(views.questions(spark, sf)).select("qid", C.placement(F.col("_folded")).alias("placement"))


@query
def extract_exhaustive(spark, sf):
    return profile.folded_questions(views.questions(spark, sf)).select("qid", C.exhaustive(F.col("_lower")).alias("exhaustive"))


@query
def constraint_profile(spark, sf):
    return profile.constraint_profile(_profiled(spark, sf))


@query
def constraint_values(spark, sf):
    return profile.constraint_values(_profiled(spark, sf))


@query
def constraint_histogram(spark, sf):
    return profile.constraint_histogram(_profiled(spark, sf), BUCKETS)


# ---- eligibility -------------------------------------------------------------------------


def _single_filter(spark, sf, want, shown):
    sigs = eligibility.signatures(eligibility.only_constraint(_profiled(spark, sf), want))
    return eligibility.eligible_summary(sigs, _records(spark, sf)).select(
        shown.alias("wanted"), "n_eligible", "first_row", "row_sum"
    )


@query
def filter_type(spark, sf):
    return _single_filter(spark, sf, "want_type", F.col("want_type"))


@query
def filter_flag(spark, sf):
    return _single_filter(spark, sf, "want_flag", F.col("want_flag"))


@query
def filter_category_or(spark, sf):
    return _single_filter(spark, sf, "want_cats", F.array_join("want_cats", "|"))


@query
def filter_budget(spark, sf):
    return _single_filter(spark, sf, "max_fee", F.col("max_fee"))


@query
def filter_cutoff(spark, sf):
    return _single_filter(spark, sf, "own_score", F.col("own_score"))


@query
def filter_floor(spark, sf):
    return _single_filter(spark, sf, "min_placement", F.col("min_placement"))


@query
def eligibility_join(spark, sf):
    sigs = eligibility.signatures(_profiled(spark, sf))
    pairs = eligibility.eligible_pairs(sigs, _records(spark, sf))
    shown = F.concat_ws(
        "|", F.coalesce("want_type", F.lit("-")), F.col("want_flag").cast("string"), F.array_join("want_cats", ","),
        *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("max_fee", "own_score", "min_placement")],
    )
    return lookup_join(pairs, sigs, ["sid"], ["row_idx"]).select(shown.alias("constraints"), "row_idx")


@query
def eligibility_counts(spark, sf):
    return eligibility.question_counts(views.questions(spark, sf), _profiled(spark, sf), _records(spark, sf)).select(
        "qid", "applied", "n_eligible"
    )


@query
def true_negatives(spark, sf):
    return eligibility.true_negatives(views.questions(spark, sf), _profiled(spark, sf), _records(spark, sf)).select(
        "qid", "question"
    )


def _negatives(retrieval):
    """Questions on the constrained route that nothing satisfies."""
    asked = retrieval.routed.where(F.col("route") == CONSTRAINED)
    counts = eligibility.eligible_summary(eligibility.signatures(asked), retrieval.records)
    empty = cut(asked.join(counts.where("n_eligible = 0").select("sig"), "sig").select("uq"))
    return lookup_join(retrieval.questions, empty, ["uq"], ["qid"]).select("qid", "uq")


@query
def true_negative_answers(spark, sf):
    return no_match_answers(_negatives(_retrieval(spark, sf))).withColumn("citations", F.array_join("citations", "|"))


# ---- named records -----------------------------------------------------------------------


def _named_inputs(spark, sf):
    unique = cut(profile.unique_questions(views.questions(spark, sf)))
    return unique, entities.distinct_names(_records(spark, sf), PARTS.name_stops)


@query
def named_bigram(spark, sf):
    unique, names = _named_inputs(spark, sf)
    return entities.match_bigrams(unique, names, PARTS.name_stops)


@query
def named_two_words(spark, sf):
    unique, names = _named_inputs(spark, sf)
    return entities.match_two_words(unique, names)


@query
def named_full(spark, sf):
    unique, names = _named_inputs(spark, sf)
    return entities.match_full(unique, names, PARTS.name_stops)


@query
def named_match(spark, sf):
    unique = cut(profile.unique_questions(views.questions(spark, sf)))
    records = _records(spark, sf)
    per_name = records.groupBy(entities.name_key(F.col("name")).alias("name_key")).agg(
        F.count("*").alias("n_records"), F.min("row_idx").alias("first_row")
    )
    return entities.match_names(unique, records, PARTS.name_stops).join(per_name, "name_key")


# ---- text index --------------------------------------------------------------------------


@query
def tokens_count(spark, sf):
    found = _documents(spark, sf).select("doc_id", tokens(F.col("text"), ENGLISH_STOPS).alias("t"))
    return found.select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("t")).cast("long").alias("n_distinct"),
        F.md5(F.array_join("t", " ")).alias("tokens_md5"),
    )


def _document_counts(spark, sf):
    docs = _documents(spark, sf)
    dealt = docs.repartition(shuffle_partitions(docs), "doc_id")
    return tfidf.term_counts(tfidf.with_terms(dealt, "text"))


def _document_idf(spark, sf):
    n_docs = _documents(spark, sf).agg(F.count("*").alias("n")).scalar()
    return tfidf.document_frequencies(_document_counts(spark, sf), n_docs)


@query
def ngram_tf(spark, sf):
    counts = _document_counts(spark, sf)
    found = counts.groupBy("doc_id").agg(
        F.count("*").alias("n_terms"), F.sum("tf").alias("n_occurrences"), F.max("tf").alias("max_tf"),
        F.sum(F.when(F.col("term").contains(" "), F.col("tf")).otherwise(0)).alias("n_bigrams"),
        F.max("term").alias("last_term"),
    )
    return tfidf.with_zero_rows(_documents(spark, sf), found, "doc_id", "n_terms", "n_occurrences", "max_tf", "n_bigrams")


@query
def idf_table(spark, sf):
    return _document_idf(spark, sf).select(
        "term", "df", F.round("idf", 9).alias("idf")
    )


@query
def tfidf_norms(spark, sf):
    return tfidf.Index(_documents(spark, sf), "doc_id", "text").norms().select(
        "doc_id", "n_terms", F.round("norm", 6).alias("norm")
    )


def _items(spark, sf):
    return views.table(spark, sf, "benchmark").select("item_id", "text")


@query
def tfidf_cosine(spark, sf):
    index = tfidf.Index(_documents(spark, sf), "doc_id", "text")
    return index.scores(_items(spark, sf), "item_id", "text").groupBy("item_id").agg(
        F.count("*").alias("n_docs"), F.round(F.max("score"), 6).alias("max_score"),
        F.round(F.sum("score"), 6).alias("sum_score"),
    )


@query
def tfidf_topk(spark, sf):
    index = tfidf.Index(_documents(spark, sf), "doc_id", "text")
    scored = index.top_pairs(_items(spark, sf), "item_id", "text", K).withColumnRenamed("doc_id", "row_idx")
    return top_k(scored, ["item_id"], best_first(), K).select(
        "item_id", F.col("rn").cast("long").alias("rn"), F.col("row_idx").alias("doc_id"),
        F.round("score", 6).alias("score"),
    )


@query
def tfidf_saved_topk(spark, sf):
    """Ranking by an index that was fitted, saved and opened again."""
    path = fresh_path(spark, "index")
    tfidf.save_index(tfidf.Index(_documents(spark, sf), "doc_id", "text"), path)
    index = tfidf.SavedIndex(spark, path)
    scored = index.scores(_items(spark, sf), "item_id", "text").withColumnRenamed("doc_id", "row_idx")
    found = store(top_k(scored, ["item_id"], best_first(), K), "top")
    index.close()
    return found.select(
        "item_id", F.col("rn").cast("long").alias("rn"), F.col("row_idx").alias("doc_id"), F.round("score", 6).alias("score")
    )


@query
def tfidf_transform_frozen(spark, sf):
    idf = store(_document_idf(spark, sf), "idf")
    turns = views.table(spark, sf, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("turn_id"), "text"
    )
    counts = tfidf.term_counts(tfidf.with_terms(turns, "text"))
    found = tfidf.norms(tfidf.weigh(counts, idf, "turn_id"), "turn_id")
    return tfidf.with_zero_rows(turns, found, "turn_id", "n_terms", "norm").select(
        "turn_id", F.col("n_terms").alias("n_known"), F.round("norm", 6).alias("norm")
    )


@query
def tfidf_frozen_topk(spark, sf):
    """Conversation turns ranked for benchmark items by weights fitted on the documents."""
    turns = views.table(spark, sf, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("row_idx"), "text"
    )
    index = tfidf.Index(turns, "row_idx", "text", store(_document_idf(spark, sf), "idf"))
    scored = index.top_pairs(_items(spark, sf), "item_id", "text", K)
    return top_k(scored, ["item_id"], best_first(), K).select(
        "item_id", F.col("rn").cast("long").alias("rn"), F.col("row_idx").alias("turn_id"), F.round("score", 6).alias("score")
    )


@query
def dense_cosine_topk(spark, sf):
    vectors = views.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_idx"), F.col("embedding").alias("v"), F.col("label").alias("pool")
    )
    centroids = cut(
        dense.label_centroids(vectors, "pool", "v").select("pool", F.col("pool").alias("label"), F.col("centroid").alias("q"))
    )
    return dense.dense_top_k(vectors, centroids, 2 * K, "label").select(
        F.col("label").cast("long").alias("label"), F.col("rn").cast("long").alias("rn"),
        F.col("row_idx").alias("vec_id"), F.round("score", 6).alias("score"),
    )


@query
def dense_pruned_topk(spark, sf):
    """Each twentieth vector against all, the same rows as without pruning."""
    vectors = views.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_idx"), F.col("embedding").alias("v"), F.lit(0).alias("pool")
    )
    asked = vectors.where("row_idx % 20 = 0").select(F.col("row_idx").alias("query_id"), F.col("v").alias("q"), "pool")
    best, _ = dense.pruned_top_k(dense.pivot_index(vectors, PIVOTS), asked, 2 * K, "query_id")
    return best.select(
        "query_id", F.col("rn").cast("long").alias("rn"), F.col("row_idx").alias("vec_id"), F.round("score", 6).alias("score")
    )


# ---- retrieval ---------------------------------------------------------------------------


def _with_ids(ranked, retrieval, *columns):
    return retrieval.with_ids(ranked).select(
        *columns, F.col("rn").cast("long").alias("rn"), "record_id", F.round("score", 6).alias("score")
    )


@query
def topk_zero_padded(spark, sf):
    run = _retrieval(spark, sf)
    return _with_ids(run.ranked(K, run.asked_as(OPEN)), run, "uq")


@query
def rank_candidates(spark, sf):
    run = _retrieval(spark, sf)
    return _with_ids(run.ranked(K, run.asked_as(CONSTRAINED)), run, "uq")


@query
def retrieve_topk(spark, sf):
    run = _retrieval(spark, sf)
    ranked = cut(_with_ids(run.ranked(K), run, "uq"))
    return lookup_join(run.questions.select("qid", "uq"), ranked, ["uq"], ["qid"]).drop("uq")


@query
def retrieve_exhaustive(spark, sf):
    run = _retrieval(spark, sf)
    return _with_ids(run.ranked_whole(), run, "uq")


@query
def retrieve_route_counts(spark, sf):
    return _retrieval(spark, sf).route_counts()


@query
def context_block(spark, sf):
    run = _retrieval(spark, sf)
    bounded = run.routed.where(~F.col("exhaustive"))
    return contexts_for(bounded, context_blocks(run.ranked(K), run.records)).select(
        "uq", "n_records", F.length("context").cast("long").alias("n_chars"), F.md5("context").alias("context_md5")
    )


@query
def context_paragraphs(spark, sf):
    run = _retrieval(spark, sf)
    digests = {"n_chars": F.length("text").cast("long"), "text_md5": F.md5("text")}
    return paragraphs(run.ranked_whole(), run.records, **digests).withColumn("rn", F.col("rn").cast("long"))


@query
def prompt_rows(spark, sf):
    run = _retrieval(spark, sf)
    return prompts(run.questions, cut(context_blocks(run.ranked(K), run.records))).select(
        "qid", F.length("prompt").cast("long").alias("n_chars"), F.md5("prompt").alias("prompt_md5")
    )


@query
def prompt_parts(spark, sf):
    """Every question that has records: its prompt in parts."""
    return context.prompt_parts(_retrieval(spark, sf), K, text_md5=F.md5("text")).select(
        "qid", "part", "kind", F.col("first").alias("first_place"), F.col("last").alias("last_place"), "n_chars", "text_md5"
    )


@query
def prompt_sizes(spark, sf):
    """The length of every question's prompt, added up from its parts."""
    return context.prompt_sizes(_retrieval(spark, sf), K)


@query
def retrieve_all(spark, sf):
    """Every question's records, bounded or exhaustive."""
    run = _retrieval(spark, sf)

    def shown(ranked):
        return run.with_ids(ranked, "uid").select("uid", "rn", "record_id", F.round("score", 6).alias("score"))

    return run.ranked_by_question(K, shown)


# ---- responses ---------------------------------------------------------------------------


@query
def json_object_extract(spark, sf):
    return views.responses(spark, sf).select("resp_id", responses.json_object(F.col("raw_text")).alias("object"))


@query
def response_validate(spark, sf):
    return responses.validate(views.responses(spark, sf)).select(
        "resp_id", "answer", F.array_join("citations", "|").alias("citations"), "answered", "reason_if_unanswered",
        "valid", "quarantined",
    )


def _checked(spark, sf, run):
    return responses.check_citations(responses.validate(views.responses(spark, sf)), run, K)


@query
def citation_check(spark, sf):
    return _checked(spark, sf, _retrieval(spark, sf)).select(
        "resp_id", F.array_join("citations", "|").alias("citations"), "dropped"
    )


@query
def dropped_citation_stats(spark, sf):
    return responses.dropped_by_model(_checked(spark, sf, _retrieval(spark, sf)))


def _final(spark, sf):
    run = _retrieval(spark, sf)
    return responses.final_answers(_checked(spark, sf, run), no_match_answers(_negatives(run)))


@query
def answer_report(spark, sf):
    return responses.report(_final(spark, sf)).orderBy("qid", "resp_id")


# ---- redaction ---------------------------------------------------------------------------


def _masked(spark, sf, expression):
    masked = views.texts(spark, sf).select("origin", "text_id", "part", expression(F.col("text")).alias("m"))
    return masked.select(
        "origin", "text_id", "part", F.length("m").cast("long").alias("n_chars"), F.md5("m").alias("text_md5")
    )


@query
def redact_email(spark, sf):
    return _masked(spark, sf, lambda c: pii.mask(c, "email"))


@query
def redact_phone(spark, sf):
    return _masked(spark, sf, lambda c: pii.mask(c, "phone"))


@query
def redact_id12(spark, sf):
    return _masked(spark, sf, lambda c: pii.mask(c, "id12"))


@query
def redact_income(spark, sf):
    return _masked(spark, sf, lambda c: pii.mask(c, "income"))


@query
def redact_amount(spark, sf):
    return _masked(spark, sf, lambda c: pii.mask(c, "amount"))


@query
def redact_all(spark, sf):
    return _masked(spark, sf, pii.redact)


@query
def redaction_stats(spark, sf):
    return redact.redaction_stats(views.texts(spark, sf), "text", ["origin", "tag"])


# ---- query log and costs -----------------------------------------------------------------


def _entries(spark, sf):
    calls = views.query_log(spark, sf).withColumns(
        {"citations": F.array().cast("array<string>"), "reason_if_unanswered": F.col("reason")}
    )
    return costs.with_cost(calls)


def _logged(spark, sf):
    path = fresh_path(spark, "querylog")
    querylog.append_log(_entries(spark, sf), path)
    return querylog.read_log(spark, path)


@query
def log_roundtrip(spark, sf):
    return _logged(spark, sf).select(
        "question", "result.answer", "result.answered", "result.reason_if_unanswered", "cost.model",
        "cost.input_tokens", "cost.output_tokens", "cost.latency_s", "cost.cost_inr",
    )


@query
def log_summary_active(spark, sf):
    """Summary of the active model from the log as it lies on disk, bad lines and all."""
    path = fresh_path(spark, "querylog")
    querylog.append_log(_entries(spark, sf), path)
    _entries(spark, sf).select(
        F.when(F.col("seq") % 3 == 0, "").when(F.col("seq") % 3 == 1, F.concat(F.lit('{"seq": '), F.col("seq"), F.lit(", broken")))
        .otherwise(F.concat(F.lit('{"seq": '), F.col("seq") + 10**9, F.lit(', "question": "no cost"}'))).alias("value")
    ).write.mode("append").text(path)
    calls = costs.with_cost(querylog.measured_calls(querylog.read_log(spark, path)))
    return costs.active_summary(calls, "seq")


@query
def log_batches(spark, sf):
    """A log of four batches, two of them written twice by a retry, and a batch that no attempt committed."""
    path = fresh_path(spark, "querylog")
    entries = _entries(spark, sf)
    for batch in (0, 1, 2, 1, 3, 3):
        querylog.append_batch(entries.where(F.col("seq") % 4 == batch), path, f"calls-{batch}")
    querylog.log_rows(entries).write.json(f"{path}/data/batch=lost/try=1")
    return querylog.read_batches(spark, path).select(
        "batch", "seq", "question", "result.answer", "cost.model", "cost.input_tokens", "cost.cost_inr"
    )


@query
def log_rejects(spark, sf):
    """Lines of a log that give no measured call, by reason."""
    path = fresh_path(spark, "querylog")
    entries = _entries(spark, sf)
    querylog.append_log(entries, path)
    seq = F.col("seq")
    bad = (
        F.when(seq % 4 == 0, "").when(seq % 4 == 1, F.concat(F.lit('{"seq": '), seq, F.lit(", broken")))
        .when(seq % 4 == 2, F.concat(F.lit('{"seq": '), seq, F.lit(', "question": "no cost"}')))
        .otherwise(F.concat(F.lit('{"seq": '), seq, F.lit(', "question": "q", "cost": {"model": "m", "latency_s": 1}}')))
    )
    entries.select(bad.alias("value")).write.mode("append").text(path)
    return querylog.rejected(spark, path).groupBy("reason").agg(F.count("*").alias("n_lines"))


@query
def log_missing(spark, sf):
    """A log that was never written has no calls and no summary."""
    rows = querylog.read_log(spark, fresh_path(spark, "no-log"))
    return costs.cost_by_model(costs.with_cost(querylog.measured_calls(rows)))


@query
def pipeline_log(spark, sf):
    """Final answers in the log, read back: no cost where no model was called or the call failed."""
    calls = views.responses(spark, sf).where("error_type IS NULL").select(
        "resp_id", "model", "input_tokens", "output_tokens", "latency_s"
    )
    asked = views.questions(spark, sf)
    # a question's answers: as many as it got responses
    entries = _final(spark, sf).join(calls, "resp_id", "left").join(asked, "qid").withColumn(
        "seq", F.when(F.col("resp_id") < 0, -F.col("qid")).otherwise(F.col("resp_id"))
    )
    path = fresh_path(spark, "querylog")
    querylog.append_log(costs.with_cost(entries), path)
    return querylog.read_log(spark, path).select(
        "seq", "question", "result.answer", F.array_join("result.citations", "|").alias("citations"), "result.answered",
        "result.reason_if_unanswered", "cost.model", "cost.input_tokens", "cost.output_tokens", "cost.cost_inr",
    )


@query
def log_cost_rows(spark, sf):
    calls = costs.with_cost(querylog.measured_calls(_logged(spark, sf)))
    return calls.select(
        "question", "model", "input_tokens", "output_tokens", "latency_s", F.round("cost_inr", 6).alias("cost_inr")
    )


def _measured(spark, sf):
    return costs.with_cost(views.query_log(spark, sf).where("model IS NOT NULL"))


@query
def cost_report_json(spark, sf):
    rows = costs.report_rows(_measured(spark, sf), "seq")
    read = lambda name, kind: F.get_json_object("json", f"$.{name}").cast(kind)
    return rows.select(
        "kind", "seq", read("model", "string").alias("model"), read("question", "string").alias("question"),
        read("input_tokens", "long").alias("input_tokens"), read("latency_s", "double").alias("latency_s"),
        read("queries_measured", "long").alias("queries_measured"),
        read("cost_inr_per_1000_queries", "double").alias("cost_inr_per_1000_queries"),
    )


@query
def cost_report_saved(spark, sf):
    """The saved report, read back from its files."""
    path = fresh_path(spark, "cost-report")
    costs.save_report(_measured(spark, sf), "seq", path)
    read = lambda name, kind: F.get_json_object("value", f"$.{name}").cast(kind)
    return spark.read.text(path).groupBy("kind", read("model", "string").alias("model")).agg(
        F.count("*").alias("n"), F.sum(read("input_tokens", "long")).alias("input_tokens"),
        F.max(read("cost_inr_per_1000_queries", "double")).alias("cost_inr_per_1000_queries"),
    )


@query
def cost_per_query(spark, sf):
    return _measured(spark, sf).select(
        "seq", "model", F.round("cost_usd", 9).alias("cost_usd"), F.round("cost_inr", 6).alias("cost_inr")
    )


@query
def cost_summary_active(spark, sf):
    return costs.active_summary(_measured(spark, sf), "seq")


@query
def cost_by_model(spark, sf):
    return costs.cost_by_model(_measured(spark, sf))


# ---- evaluation --------------------------------------------------------------------------


@query
def cases_json(spark, sf):
    """Cases as a JSON array on disk, absent checks left out, read back."""
    path = fresh_path(spark, "cases")
    wanted = case_source.from_delimited(views.cases(spark, sf))
    renamed = wanted.withColumnsRenamed(
        {"case_id": "id", "any_of": "expected_citations_any_of", "required": "required_substrings", "forbidden": "forbidden_substrings"}
    ).withColumn("question", F.col("qid").cast("string"))
    case_source.write_cases(renamed.drop("qid"), path)
    return case_source.read_cases(spark, path).select(
        "case_id", "question", "expected_answered", F.array_join("expected_citations", "|").alias("expected_citations"),
        F.array_join("any_of", "|").alias("any_of"), *[F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c) for c in ("required", "forbidden")],
    )


@query
def answer_report_saved(spark, sf):
    """The batch report as text in question order, read back."""
    path = fresh_path(spark, "answers")
    responses.save_report(_final(spark, sf), path)
    return spark.read.text(path).groupBy(F.get_json_object("value", "$.answered").cast("boolean").alias("answered")).agg(
        F.count("*").alias("n"), F.sum(F.length("value")).alias("n_chars")
    )


def _scored(spark, sf):
    wanted = case_source.from_delimited(views.cases(spark, sf))
    return evals.score(wanted, _final(spark, sf), "qid")


@query
def eval_score(spark, sf):
    return _scored(spark, sf).select(
        "case_id", "resp_id", "passed", F.array_join("failures", "; ").alias("failures")
    )


@query
def eval_pass_rate(spark, sf):
    return evals.pass_rate(_scored(spark, sf))
