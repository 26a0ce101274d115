"""The operators over the given tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chunk_dedup, decontaminate, exact_dedup, fim, language, licenses, minhash, mixing, pii, repeats, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_license_scans(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


@query
def op2_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, language.learned())
    return language.predict(docs, model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query
def op4_benchmark_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op6_suffix_array_dedup(spark, sf_dir):
    return repeats.report(table(spark, sf_dir, "documents")).drop("starts", "stops")


@query
def op7_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op8_exact_dedup(spark, sf_dir):
    index = exact_dedup.temporary_index(spark)
    found = exact_dedup.dedup(table(spark, sf_dir, "documents"), index)
    index.close()
    return found


@query
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out=toxicity.held_out())
    scored = toxicity.scores(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query
def op10_chunk_dedup(spark, sf_dir):
    return chunk_dedup.report(table(spark, sf_dir, "documents"))


@query
def op11_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op12_cross_tokenizer_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"))[0]


@query
def op13_fill_in_middle(spark, sf_dir):
    made = fim.transform(table(spark, sf_dir, "documents"))
    digest = {"output_sha256": F.col("output"), "restored_sha256": fim.restored(F.col("output"), F.col("form"))}
    made = made.withColumns({name: F.sha2(value.cast("binary"), 256) for name, value in digest.items()})
    return made.drop("output")


# ---- SQL -------------------------------------------------------------------------------------

ORACLES["op8_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents),
g AS (SELECT h, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id, max(n) AS keep_n FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AND n = keep_n AS kept, d.h AS text_sha256 FROM d JOIN g USING (h)
"""

# Windows as joined words: each document's windows of 13 words (and of each shorter item's length) meet
# the benchmark's by equality.
ORACLES["op4_benchmark_decontamination"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(13, len(ws)) AS k,
             array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS win
      FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS i FROM b WHERE len(ws) > 0)),
s AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), (SELECT DISTINCT k FROM p)
      WHERE i + k - 1 <= len(ws)),
h AS (SELECT s.doc_id, s.i, s.k, p.item_id FROM s JOIN p USING (k, win)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

# The restored text is the text itself: the round trip is exact.
ORACLES["op13_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
c AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS UBIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS UBIGINT) % (len(u) + 1) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                       OR CAST('0x' || h[17:24] AS UBIGINT) % 100 >= 50 THEN 'plain'
                  WHEN CAST('0x' || h[25:32] AS UBIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, coalesce(array_to_string(u[1:least(a, b)], ''), '') AS pre,
             coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS mid,
             coalesce(array_to_string(u[greatest(a, b) + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

# Sets meet by their shingles; components by the smallest id reachable.
ORACLES["op11_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 3], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s AS a JOIN s AS b ON a.h = b.h AND a.doc_id <> b.doc_id
      JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id, doc_id AS root FROM documents
      UNION SELECT l.b AS doc_id, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
