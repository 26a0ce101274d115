"""The same results in plain SQL, written the direct way: every pair, every rule, no pruning.

RE2 has no lookarounds and its ``\\b`` is ASCII; the derived questions and seeded texts are ASCII.
"""

from __future__ import annotations

import re

from ..functions import vocab as v
from ..sources import views

_TABLES = {
    t: t
    for t in (
        "region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations"
    ).split()
}


def _view(sql: str) -> str:
    return sql.format(**_TABLES).strip()


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(x) for x in values) + "]"


_P = v.PARTS

RAW = f"raw AS ({_view(views.CATALOG_RAW)})"

REC = f"""rec AS (
  SELECT *, coalesce(lower(trim(flag_text)) = 'yes', false) AS flag,
    list_filter(list_transform(string_split(courses, ';'), lambda x: trim(x)), lambda x: x <> '') AS course_list,
    list_filter([{", ".join(f"CASE WHEN regexp_matches(courses, {_text(p)}, 'i') THEN {_text(w)} END" for w, p in _P.categories)}],
                lambda x: x IS NOT NULL) AS categories,
    regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g') AS name_key
  FROM raw)"""

def _shown(column: str) -> str:
    return f"coalesce(CAST({column} AS VARCHAR), {_text(v.MISSING)})"


_CUTOFF = f"coalesce(CASE WHEN cutoff = floor(cutoff) THEN CAST(CAST(cutoff AS BIGINT) AS VARCHAR) END, {_shown('cutoff')})"

DOC = f"""doc AS (
  SELECT row_idx, concat({_shown('name')}, ' (', record_id, ') in ', {_shown('city')}, ', ', {_shown('state')}, '. Type: ', {_shown('type')},
    '. Courses offered: ', array_to_string(course_list, ', '), '. Annual fees: Rs ', {_shown('fee')},
    ' per year. Last year cutoff: ', {_CUTOFF}, ' percent aggregate (hard minimum). Total seats: ',
    {_shown('seats')}, '. ', CASE WHEN flag THEN 'hostel available' ELSE 'no hostel' END,
    '. NAAC grade: ', {_shown('grade')}, '. ',
    CASE WHEN coalesce(placement, 0) = 0 THEN 'placement not reported / not applicable'
         ELSE concat('average placement ', CAST(placement AS VARCHAR), ' lakhs per annum') END,
    '. Established ', {_shown('established')}, '. ', {_shown('about')}) AS doc
  FROM rec)"""

_HALF = "|".join(v.HALF_YEAR_TERMS)
_PREFIX = v.SCORE_PREFIXES
_LEADS = v.PLACEMENT_LEADS

Q = f"q AS ({_view(views.QUESTIONS)})"

PROF = f"""prof AS (
  SELECT *, want_type IS NOT NULL OR want_flag OR len(want_cats) > 0 OR max_fee IS NOT NULL
         OR own_score IS NOT NULL OR min_placement IS NOT NULL AS applied
  FROM (
    SELECT qid, question, uq,
      CASE {" ".join(f"WHEN contains(uq, {_text(t)}) THEN {_text(x)}" for t, x in _P.types)} END AS want_type,
      contains(uq, 'hostel') AND ({" OR ".join(f"contains(uq, {_text(p)})" for p in v.FLAG_PHRASES)}
        OR regexp_matches(uq, '\\b(?:{v.FLAG_VERBS})\\s+hostels?\\b')) AS want_flag,
      list_filter([{", ".join(f"CASE WHEN regexp_matches(uq, {_text(chr(92) + 'b' + re.escape(w) + chr(92) + 'b')}) THEN {_text(w)} END" for w, _ in _P.categories)}],
                  lambda x: x IS NOT NULL) AS want_cats,
      coalesce(
        TRY_CAST(regexp_extract(uc, '(\\d+(?:\\.\\d+)?)\\s*(?:lakhs?|l)\\b', 1) AS DOUBLE) * {v.LAKH},
        TRY_CAST(regexp_extract(uc, '(\\d+(?:\\.\\d+)?)\\s*k\\b', 1) AS DOUBLE) * 1000,
        TRY_CAST(list_filter(regexp_extract_all(uc, '\\b\\d+\\b'), lambda n: TRY_CAST(n AS DOUBLE) >= {v.PLAIN_BUDGET_MIN})[1] AS DOUBLE)
      ) * CASE WHEN regexp_matches(uc, '{_HALF}') THEN 2 ELSE 1 END AS max_fee,
      coalesce(
        TRY_CAST(regexp_extract(uq, '(\\d+(?:\\.\\d+)?)\\s*(?:%|percent|percentage)\\b', 1) AS DOUBLE),
        CASE WHEN TRY_CAST(regexp_extract(uq, '(?:{_PREFIX})\\s*(\\d+(?:\\.\\d+)?)\\b', 1) AS DOUBLE) BETWEEN 30 AND 100
             THEN TRY_CAST(regexp_extract(uq, '(?:{_PREFIX})\\s*(\\d+(?:\\.\\d+)?)\\b', 1) AS DOUBLE) END,
        CASE WHEN regexp_matches(uq, '{"|".join(v.SCORE_WORDS)}') THEN
          TRY_CAST(list_filter(regexp_extract_all(uq, '\\b\\d+(?:\\.\\d+)?\\b'),
            lambda n: TRY_CAST(n AS DOUBLE) BETWEEN 30 AND 100
              AND NOT regexp_matches(substr(uq, strpos(uq, n) + length(n)), '^\\s*[kl]'))[1] AS DOUBLE) END
      ) AS own_score,
      CASE WHEN contains(uq, 'placement') THEN coalesce(
        TRY_CAST(regexp_extract(substr(uq, strpos(uq, 'placement') + 9),
          '(?:{_LEADS})\\s*(\\d+(?:\\.\\d+)?)\\s*(?:lakhs?|lpa|l)?\\b', 1) AS DOUBLE),
        TRY_CAST(regexp_extract(trim(substr(uq, 1, strpos(uq, 'placement') - 1)), '(\\d+(?:\\.\\d+)?)\\s*(?:lakhs?|lpa|l)?$', 1) AS DOUBLE)
      ) END AS min_placement,
      regexp_matches(uq, '\\b({v.EXHAUSTIVE_WORDS})\\b') AS exhaustive
    FROM (SELECT qid, question, lower(coalesce(question, '')) AS uq,
            regexp_replace(regexp_replace(lower(coalesce(question, '')), '(\\d),(\\d)', '\\1\\2', 'g'), '(\\d),(\\d)', '\\1\\2', 'g') AS uc
          FROM q) t) t)"""

_ELIGIBLE = """(p.want_type IS NULL OR r.type = p.want_type) AND (NOT p.want_flag OR r.flag)
    AND (len(p.want_cats) = 0 OR list_has_any(p.want_cats, r.categories))
    AND (p.max_fee IS NULL OR r.fee <= p.max_fee) AND (p.own_score IS NULL OR r.cutoff <= p.own_score)
    AND (p.min_placement IS NULL OR r.placement >= p.min_placement)"""

COUNTED = f"""counted AS (
  SELECT p.qid, p.question, p.applied, CASE WHEN p.applied THEN e.n END AS n_eligible
  FROM prof p JOIN (
    SELECT p.uq, count(r.row_idx) AS n
    FROM (SELECT DISTINCT uq, want_type, want_flag, want_cats, max_fee, own_score, min_placement FROM prof) p
    LEFT JOIN rec r ON {_ELIGIBLE} GROUP BY p.uq) e ON e.uq = p.uq)"""

_STOPS = _list(_P.name_stops)

NAMES = f"""uqs AS (SELECT DISTINCT lower(coalesce(question, '')) AS uq, regexp_replace(lower(coalesce(question, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g') AS clean FROM q),
names AS (SELECT name_key, words, list_filter(words, lambda w: NOT list_contains({_STOPS}, w)) AS own
  FROM (SELECT DISTINCT name_key, list_filter(regexp_split_to_array(name_key, '\\s+'), lambda w: w <> '') AS words FROM rec) t),
bigrams AS (SELECT name_key, words[i] AS a, words[i + 1] AS b
  FROM (SELECT name_key, words, unnest(range(1, len(words))) AS i FROM names) t
  WHERE NOT (list_contains({_STOPS}, words[i]) AND list_contains({_STOPS}, words[i + 1]))),
hit_bigram AS (SELECT DISTINCT u.uq, b.name_key FROM uqs u JOIN bigrams b ON contains(u.clean, concat(b.a, ' ', b.b))),
hit_words AS (SELECT u.uq, n.name_key FROM uqs u JOIN names n
  ON len(list_filter(n.own, lambda w: list_contains(regexp_split_to_array(u.clean, '\\s+'), w))) >= 2),
hit_full AS (SELECT u.uq, n.name_key FROM uqs u JOIN names n ON contains(u.clean, n.name_key)),
hit AS (SELECT * FROM hit_bigram UNION SELECT * FROM hit_words UNION SELECT * FROM hit_full)"""

_ENGLISH = _list(v.ENGLISH_STOPS)


def _terms(source: str, key: str, text: str, out: str) -> str:
    """Term counts of ``source`` as a CTE named ``out``."""
    return f"""{out}_tok AS (SELECT {key}, list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
    lambda t: NOT list_contains({_ENGLISH}, t)) AS toks FROM {source}),
{out} AS (SELECT {key}, term, count(*) AS tf FROM (
    SELECT {key}, unnest(list_concat(toks, list_transform(range(1, len(toks)), lambda i: concat(toks[i], ' ', toks[i + 1])))) AS term
    FROM {out}_tok) t GROUP BY {key}, term)"""


def _idf(source: str, key: str, counts: str) -> str:
    return f"""idf AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM {source})) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf
  FROM {counts} GROUP BY term)"""


def _norms(counts: str, key: str, out: str) -> str:
    return f"""{out} AS (SELECT {key}, sqrt(sum((tf * idf) * (tf * idf))) AS norm, count(*) AS n_terms
  FROM {counts} JOIN idf USING (term) GROUP BY {key})"""


def _cosine(qkey: str, dkey: str) -> str:
    return f"""cos AS (SELECT qt.{qkey}, dt.{dkey}, sum(qt.tf * idf.idf * dt.tf * idf.idf) / (any_value(qn.norm) * any_value(dn.norm)) AS score
  FROM qt JOIN idf ON idf.term = qt.term JOIN dt ON dt.term = qt.term
  JOIN qn ON qn.{qkey} = qt.{qkey} JOIN dn ON dn.{dkey} = dt.{dkey}
  GROUP BY qt.{qkey}, dt.{dkey})"""


BENCH_INDEX = ",\n".join(
    [
        _terms("documents", "doc_id", "text", "dt"),
        _idf("documents", "doc_id", "dt"),
        _terms("benchmark", "item_id", "text", "qt"),
        _norms("dt", "doc_id", "dn"),
        _norms("qt", "item_id", "qn"),
        _cosine("item_id", "doc_id"),
    ]
)

CATALOG_BASE = ",\n".join([RAW, REC, Q, PROF])
RETRIEVAL = ",\n".join(
    [
        CATALOG_BASE, NAMES, DOC,
        "uprof AS (SELECT DISTINCT uq, want_type, want_flag, want_cats, max_fee, own_score, min_placement, exhaustive, applied FROM prof)",
        """routed AS (SELECT *, CASE WHEN uq IN (SELECT uq FROM hit) THEN 'named' WHEN applied THEN 'constrained' ELSE 'open' END AS route FROM uprof)""",
        _terms("doc", "row_idx", "doc", "dt"),
        _idf("doc", "row_idx", "dt"),
        _terms("uprof", "uq", "uq", "qt"),
        _norms("dt", "row_idx", "dn"),
        _norms("qt", "uq", "qn"),
        _cosine("uq", "row_idx"),
    ]
)


def _ranked(pool: str) -> str:
    """``pool`` selects (uq, row_idx, exhaustive); all of it is scored and ordered."""
    return f"""pool AS ({pool}),
ordered AS (SELECT pool.uq, pool.row_idx, pool.exhaustive, coalesce(cos.score, 0) AS score,
    row_number() OVER (PARTITION BY pool.uq ORDER BY round(coalesce(cos.score, 0), 9) DESC, pool.row_idx) AS rn
  FROM pool LEFT JOIN cos ON cos.uq = pool.uq AND cos.row_idx = pool.row_idx)"""


_ROUTE_POOL = f"""SELECT p.uq, r.row_idx, p.exhaustive FROM routed p JOIN rec r ON p.route = 'open'
  OR (p.route = 'constrained' AND {_ELIGIBLE})
  UNION ALL SELECT p.uq, r.row_idx, p.exhaustive FROM routed p JOIN hit ON hit.uq = p.uq JOIN rec r ON r.name_key = hit.name_key"""
RANKED = RETRIEVAL + ",\n" + _ranked(_ROUTE_POOL)
KEPT = "kept AS (SELECT o.uq, o.rn, o.row_idx, o.score, r.record_id FROM ordered o JOIN rec r USING (row_idx) WHERE o.exhaustive OR o.rn <= 5)"

CONTEXT = f"""para AS (SELECT row_idx, concat('[', record_id, '] ', {_shown('name')}, ' | ', {_shown('city')}, ', ', {_shown('state')}, ' | ', {_shown('type')},
    chr(10), '  courses: ', array_to_string(course_list, ', '),
    chr(10), '  annual_fees_inr: ', {_shown('fee')}, ' (per year)',
    chr(10), '  last_year_cutoff_pct: ', {_CUTOFF},
    chr(10), '  total_seats: ', {_shown('seats')}, ' | hostel_available: ', CASE WHEN flag THEN 'True' ELSE 'False' END,
    chr(10), '  naac_grade: ', {_shown('grade')}, ' | avg_placement_lpa: ', {_shown('placement')},
    chr(10), '  established_year: ', {_shown('established')}, chr(10), '  about: ', {_shown('about')}) AS txt FROM rec),
blocks AS (SELECT kept.uq, count(*) AS n_records, string_agg(txt, concat(chr(10), chr(10)) ORDER BY rn) AS context
  FROM kept JOIN para USING (row_idx) JOIN uprof u ON u.uq = kept.uq AND NOT u.exhaustive GROUP BY kept.uq)"""

# Records that score, one by one; the others of an exhaustive question's pool as ranges of places between those.
PARTS = ",\n".join([KEPT, CONTEXT.split(",\nblocks AS")[0], """laid AS (SELECT k.uq, k.rn, k.row_idx, u.exhaustive, txt,
    NOT u.exhaustive OR round(k.score, 9) > 0 AS alone, row_number() OVER (PARTITION BY k.uq ORDER BY k.row_idx) AS place
  FROM kept k JOIN para USING (row_idx) JOIN uprof u ON u.uq = k.uq),
gapped AS (SELECT *, sum(CASE WHEN alone THEN 1 ELSE 0 END) OVER (PARTITION BY uq ORDER BY place) AS gap FROM laid),
parts AS (SELECT uq, rn AS part, 'record' AS kind, CAST(NULL AS BIGINT) AS first_place, CAST(NULL AS BIGINT) AS last_place,
    length(t) AS n_chars, md5(t) AS text_md5
  FROM (SELECT *, concat(CASE WHEN rn > 1 THEN concat(chr(10), chr(10)) ELSE '' END, txt) AS t FROM gapped WHERE alone) a
  UNION ALL SELECT uq, min(rn), 'range', min(place), max(place),
    CAST(sum(length(txt) + 2) - CASE WHEN min(rn) = 1 THEN 2 ELSE 0 END AS BIGINT), NULL FROM gapped WHERE NOT alone GROUP BY uq, gap)"""])

RESP = f"resp AS ({_view(views.RESPONSES)})"
_TRIMMED = "regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g')"
_OBJECT = f"""CASE WHEN regexp_extract({_TRIMMED}, '(?s)\\{{.*\\}}') <> '' THEN regexp_extract({_TRIMMED}, '(?s)\\{{.*\\}}') ELSE {_TRIMMED} END"""
VALID = f"""parsed AS (SELECT *, CASE WHEN json_valid(obj) THEN CAST(obj AS JSON) END AS j FROM (SELECT *, {_OBJECT} AS obj FROM resp) t),
faulted AS (SELECT *, error_type IS NOT NULL AS failed, CASE WHEN j IS NULL THEN ['not JSON'] ELSE list_filter([
    CASE WHEN json_type(j, '$.answer') IS DISTINCT FROM 'VARCHAR' THEN 'answer' END,
    CASE WHEN json_type(j, '$.citations') IS DISTINCT FROM 'ARRAY' THEN 'citations' END,
    CASE WHEN json_type(j, '$.answered') IS DISTINCT FROM 'BOOLEAN' THEN 'answered' END], lambda x: x IS NOT NULL) END AS faults FROM parsed),
val AS (SELECT resp_id, qid, model, raw_text,
    CASE WHEN failed THEN {_text(v.SERVICE_DOWN_ANSWER)} WHEN len(faults) = 0 THEN json_extract_string(j, '$.answer') ELSE '' END AS answer,
    CASE WHEN NOT failed AND len(faults) = 0 THEN json_extract_string(j, '$.citations[*]') ELSE CAST([] AS VARCHAR[]) END AS citations,
    CASE WHEN NOT failed AND len(faults) = 0 THEN CAST(json_extract_string(j, '$.answered') AS BOOLEAN) ELSE false END AS answered,
    CASE WHEN failed THEN concat('API error (', error_type, '): ', error_message)
         WHEN len(faults) = 0 THEN json_extract_string(j, '$.reason_if_unanswered')
         ELSE concat({_text(v.INVALID_REASON + ": ")}, array_to_string(faults, ', ')) END AS reason_if_unanswered,
    NOT failed AND len(faults) = 0 AS valid,
    CASE WHEN NOT failed AND len(faults) > 0 THEN raw_text END AS quarantined
  FROM faulted)"""

CHECKED = f"""retrieved AS (SELECT p.qid, kept.record_id FROM prof p JOIN kept ON kept.uq = p.uq),
exploded AS (SELECT resp_id, qid, citations[i] AS cid, i FROM (SELECT resp_id, qid, citations, unnest(range(1, len(citations) + 1)) AS i FROM val) t),
firsts AS (SELECT resp_id, qid, cid, min(i) AS i FROM exploded GROUP BY resp_id, qid, cid),
sorted AS (SELECT f.resp_id, string_agg(CASE WHEN r.record_id IS NOT NULL THEN f.cid END, '|' ORDER BY f.i) AS kept_ids,
    list(f.cid ORDER BY f.i) FILTER (WHERE r.record_id IS NOT NULL) AS kept_list,
    count(*) FILTER (WHERE r.record_id IS NULL) AS dropped
  FROM firsts f LEFT JOIN retrieved r ON r.qid = f.qid AND r.record_id = f.cid GROUP BY f.resp_id),
checked AS (SELECT val.* EXCLUDE (citations), coalesce(CASE WHEN answered THEN kept_ids END, '') AS cites,
    coalesce(CASE WHEN answered THEN kept_list END, CAST([] AS VARCHAR[])) AS citations, coalesce(dropped, 0) AS dropped
  FROM val LEFT JOIN sorted USING (resp_id))"""

NEG = "neg AS (SELECT DISTINCT p.qid FROM prof p JOIN routed t ON t.uq = p.uq WHERE t.route = 'constrained' AND p.uq NOT IN (SELECT uq FROM pool))"
FINAL = f"""final AS (SELECT qid, resp_id, answer, citations, answered, reason_if_unanswered FROM checked WHERE qid NOT IN (SELECT qid FROM neg)
  UNION ALL SELECT qid, -1, {_text(v.NO_MATCH_ANSWER)}, CAST([] AS VARCHAR[]), false, {_text(v.NO_MATCH_REASON)} FROM neg)"""
ANSWERS = ",\n".join([RANKED, KEPT, RESP, VALID, CHECKED, NEG, FINAL])

TEXTS = f"""texts AS (SELECT 'documents' AS origin, doc_id AS text_id, 0 AS part, lang AS tag, text FROM documents
  UNION ALL SELECT 'conversations', conv_id, turn, role, text FROM conversations
  UNION ALL SELECT 'seeded', text_id, 0, 'en', text FROM ({_view(views.SEEDED_TEXT)}) s)"""

_SP = "[\\s\\p{Z}]"
_RULES = (
    ("email", "[\\p{L}\\p{N}_.\\-]+@[\\p{L}\\p{N}_.\\-]+\\.[\\p{L}\\p{N}_]+", v.EMAIL_MASK, "g"),
    ("phone", "\\b(?:\\+?[0-9]{1,3}[.\\-\\s]?)?\\(?[0-9]{3}\\)?[.\\-\\s]?[0-9]{3}[.\\-\\s]?[0-9]{4}\\b", v.PHONE_MASK, "g"),
    ("id12", "\\b\\d{4}[\\s-]?\\d{4}[\\s-]?\\d{4}\\b", v.ID_MASK, "g"),
    ("income", "(\\b(?:my\\s+)?(?:family\\s+)?income\\s*)(?:is\\s*)?(?:rs\\.?\\s*)?\\d+(?:\\.\\d+)?\\s*(?:lakhs?|l)?\\b", "\\1" + v.INCOME_MASK, "gi"),
    ("amount", "\\brs\\.?\\s*\\d{5,7}\\b", v.INCOME_MASK, "gi"),
)


def _mask(expr: str, rule: str) -> str:
    _, pattern, replacement, flags = next(r for r in _RULES if r[0] == rule)
    return f"regexp_replace({expr}, {_text(pattern)}, {_text(replacement)}, '{flags}')"


def _redact(expr: str) -> str:
    for rule, *_ in _RULES:
        expr = _mask(expr, rule)
    return expr


def _masked(expr: str) -> str:
    return f"""WITH {TEXTS} SELECT origin, text_id, part, length(m) AS n_chars, md5(m) AS text_md5
FROM (SELECT origin, text_id, part, {expr} AS m FROM texts) t"""


def _stats() -> str:
    stage, columns = "text", []
    for rule, pattern, _, flags in _RULES:
        p = pattern if flags == "g" else "(?i)" + pattern
        columns.append(f"CAST(sum(len(regexp_extract_all({stage}, {_text(p)}))) AS BIGINT) AS n_{rule}")
        stage = _mask(stage, rule)
    return f"""WITH {TEXTS} SELECT origin, tag, count(*) AS n_texts, {", ".join(columns)},
  CAST(sum(CASE WHEN {stage} <> text THEN 1 ELSE 0 END) AS BIGINT) AS n_changed FROM texts GROUP BY origin, tag"""


LOG = f"qlog AS ({_view(views.QUERY_LOG)})"
PRICED = f"""prices(model, usd_in, usd_out) AS (VALUES {", ".join(f"({_text(m)}, CAST({i} AS DOUBLE), CAST({o} AS DOUBLE))" for m, i, o in v.PRICES)}),
priced AS (SELECT l.*, l.input_tokens / 1e6 * coalesce(p.usd_in, d.usd_in) + l.output_tokens / 1e6 * coalesce(p.usd_out, d.usd_out) AS cost_usd
  FROM qlog l LEFT JOIN prices p ON p.model = l.model CROSS JOIN (SELECT * FROM prices WHERE model = {_text(v.DEFAULT_MODEL)}) d
  WHERE l.model IS NOT NULL),
costed AS (SELECT *, cost_usd * {v.USD_TO_INR} AS cost_inr FROM priced)"""



def _half_up(expr: str, digits: int) -> str:
    """Round as decimal text: Spark rounds a double by its shortest decimal form."""
    return f"CAST(round(CAST(round({expr}, 12) AS DECIMAL(38, 12)), {digits}) AS DOUBLE)"


_SUMMARY = f"""count(*) AS queries_measured, {_half_up("avg(input_tokens)", 1)} AS avg_input_tokens,
  {_half_up("avg(output_tokens)", 1)} AS avg_output_tokens, {_half_up("avg(latency_s)", 3)} AS avg_latency_s,
  {_half_up("avg(cost_inr)", 4)} AS avg_cost_inr_per_query, {_half_up("avg(cost_inr) * 1000", 2)} AS cost_inr_per_1000_queries"""
_ACTIVE = "model = (SELECT max_by(model, seq) FROM costed)"


def _split(column: str) -> str:
    return f"list_filter(list_transform(string_split({column}, ';'), lambda x: trim(x)), lambda x: x <> '')"


def _quoted(items: str) -> str:
    return f"concat('[', array_to_string(list_transform(list_sort({items}), lambda x: concat('''', x, '''')), ', '), ']')"


CASES = f"""cases AS (SELECT qid, case_id, expected_answered,
    CASE WHEN expected_citations IS NOT NULL THEN {_split("expected_citations")} END AS expected_citations,
    CASE WHEN any_of IS NOT NULL THEN {_split("any_of")} END AS any_of,
    {_split("coalesce(required, '')")} AS required, {_split("coalesce(forbidden, '')")} AS forbidden
  FROM ({_view(views.CASES)}) c),
scored AS (SELECT case_id, resp_id, list_concat(
    list_filter([
      CASE WHEN answered IS NULL THEN 'no answer' END,
      CASE WHEN expected_answered <> coalesce(answered, false) THEN concat('answered=', CASE WHEN coalesce(answered, false) THEN 'True' ELSE 'False' END,
        ', expected=', CASE WHEN expected_answered THEN 'True' ELSE 'False' END) END,
      CASE WHEN expected_citations IS NOT NULL AND list_sort(expected_citations) <> list_sort(coalesce(citations, CAST([] AS VARCHAR[])))
        THEN concat('citations=', {_quoted("coalesce(citations, CAST([] AS VARCHAR[]))")}, ', expected=', {_quoted("expected_citations")}) END,
      CASE WHEN any_of IS NOT NULL AND NOT list_has_any(any_of, coalesce(citations, CAST([] AS VARCHAR[])))
        THEN concat('citations=', {_quoted("coalesce(citations, CAST([] AS VARCHAR[]))")}, ' matched none of ', {_quoted("any_of")}) END], lambda x: x IS NOT NULL),
    list_transform(list_filter(required, lambda s: NOT contains(lower(coalesce(answer, '')), lower(s))), lambda s: concat('missing required substring: ''', s, '''')),
    list_transform(list_filter(forbidden, lambda s: contains(lower(coalesce(answer, '')), lower(s))), lambda s: concat('contains forbidden substring: ''', s, ''''))
  ) AS failures FROM cases LEFT JOIN (SELECT qid, resp_id, coalesce(answer, '') AS answer, coalesce(citations, CAST([] AS VARCHAR[])) AS citations, answered FROM final) f USING (qid))"""


def _with(*parts: str) -> str:
    *ctes, select = parts
    return "WITH " + ",\n".join(ctes) + "\n" + select


def _single_filter(wanted: str, key: str, test: str, asked: str) -> str:
    return _with(
        CATALOG_BASE,
        f"""SELECT w.wanted, count(r.row_idx) AS n_eligible, min(r.row_idx) AS first_row, CAST(sum(r.row_idx) AS BIGINT) AS row_sum
FROM (SELECT DISTINCT {wanted} AS wanted, {key} AS k FROM prof WHERE {asked}) w LEFT JOIN rec r ON {test} GROUP BY w.wanted""",
    )


ORACLES: dict[str, str] = {
    "catalog_scan": _with(RAW, REC, """SELECT row_idx, record_id, name, city, state, type, fee, cutoff, seats, flag, grade, placement,
  established, array_to_string(course_list, '|') AS course_list, array_to_string(categories, '|') AS categories FROM rec"""),
    "catalog_csv": _with(RAW, REC, """SELECT row_number() OVER (ORDER BY record_id) - 1 AS row_idx, record_id, name, fee, cutoff, seats, flag, grade,
  placement, established, about, array_to_string(course_list, '|') AS course_list FROM rec"""),
    "catalog_document": _with(RAW, REC, DOC, "SELECT row_idx, length(doc) AS n_chars, md5(doc) AS doc_md5 FROM doc"),
    "constraint_values": _with(Q, PROF, """SELECT kind, value, count(*) AS n_questions FROM (
  SELECT 'type' AS kind, want_type AS value FROM prof WHERE want_type IS NOT NULL
  UNION ALL SELECT 'flag', 'yes' FROM prof WHERE want_flag
  UNION ALL SELECT 'category', unnest(want_cats) FROM prof) t GROUP BY kind, value"""),
    "constraint_histogram": _with(Q, PROF, """vals AS (SELECT kind, value, count(*) AS n FROM (
  SELECT 'budget' AS kind, max_fee AS value FROM prof UNION ALL SELECT 'cutoff', own_score FROM prof
  UNION ALL SELECT 'floor', min_placement FROM prof) t WHERE value IS NOT NULL GROUP BY kind, value),
upto AS (SELECT *, sum(n) OVER (PARTITION BY kind ORDER BY value) AS upto, sum(n) OVER (PARTITION BY kind) AS total FROM vals)""",
        """SELECT kind, bucket, min(value) AS low, max(value) AS high, count(*) AS n_values, CAST(sum(n) AS BIGINT) AS n_questions FROM (
  SELECT *, CAST(floor((2 * upto - n) * 10 / (2.0 * total)) AS BIGINT) AS bucket FROM upto) t GROUP BY kind, bucket"""),
    "extract_budget": _with(Q, PROF, "SELECT qid, max_fee AS budget FROM prof"),
    "extract_cutoff": _with(Q, PROF, "SELECT qid, own_score AS cutoff FROM prof"),
    "extract_placement": _with(Q, PROF, "SELECT qid, min_placement AS placement FROM prof"),
    "extract_exhaustive": _with(Q, PROF, "SELECT qid, exhaustive FROM prof"),
    "constraint_profile": _with(Q, PROF, """SELECT want_type IS NOT NULL AS has_type, want_flag AS has_flag, len(want_cats) > 0 AS has_category,
  max_fee IS NOT NULL AS has_budget, own_score IS NOT NULL AS has_cutoff, min_placement IS NOT NULL AS has_floor,
  count(*) AS n_questions, min(max_fee) AS min_budget, max(max_fee) AS max_budget, round(avg(own_score), 4) AS avg_cutoff,
  max(min_placement) AS max_floor, CAST(sum(CASE WHEN exhaustive THEN 1 ELSE 0 END) AS BIGINT) AS n_exhaustive
FROM prof GROUP BY ALL"""),
    "filter_type": _single_filter("want_type", "want_type", "r.type = w.k", "want_type IS NOT NULL"),
    "filter_flag": _single_filter("want_flag", "want_flag", "r.flag", "want_flag"),
    "filter_category_or": _single_filter("array_to_string(want_cats, '|')", "want_cats", "list_has_any(w.k, r.categories)", "len(want_cats) > 0"),
    "filter_budget": _single_filter("max_fee", "max_fee", "r.fee <= w.k", "max_fee IS NOT NULL"),
    "filter_cutoff": _single_filter("own_score", "own_score", "r.cutoff <= w.k", "own_score IS NOT NULL"),
    "filter_floor": _single_filter("min_placement", "min_placement", "r.placement >= w.k", "min_placement IS NOT NULL"),
    "eligibility_join": _with(CATALOG_BASE, f"""SELECT concat_ws('|', coalesce(p.want_type, '-'), CAST(p.want_flag AS VARCHAR), array_to_string(p.want_cats, ','),
  coalesce(CAST(p.max_fee AS VARCHAR), '-'), coalesce(CAST(p.own_score AS VARCHAR), '-'), coalesce(CAST(p.min_placement AS VARCHAR), '-')) AS "constraints", r.row_idx
FROM (SELECT DISTINCT want_type, want_flag, want_cats, max_fee, own_score, min_placement FROM prof WHERE applied) p JOIN rec r ON {_ELIGIBLE}"""),
    "eligibility_counts": _with(CATALOG_BASE, COUNTED, "SELECT qid, applied, n_eligible FROM counted"),
    "true_negatives": _with(CATALOG_BASE, COUNTED, "SELECT qid, question FROM counted WHERE applied AND n_eligible = 0"),
    "true_negative_answers": _with(CATALOG_BASE, NAMES, COUNTED, f"""SELECT qid, {_text(v.NO_MATCH_ANSWER)} AS answer, '' AS citations, false AS answered,
  {_text(v.NO_MATCH_REASON)} AS reason_if_unanswered FROM counted WHERE applied AND n_eligible = 0 AND lower(coalesce(question, '')) NOT IN (SELECT uq FROM hit)"""),
    "named_bigram": _with(RAW, REC, Q, NAMES, "SELECT uq, name_key FROM hit_bigram"),
    "named_two_words": _with(RAW, REC, Q, NAMES, "SELECT uq, name_key FROM hit_words"),
    "named_full": _with(RAW, REC, Q, NAMES, "SELECT uq, name_key FROM hit_full"),
    "named_match": _with(RAW, REC, Q, NAMES, """SELECT hit.uq, hit.name_key, count(*) AS n_records, min(rec.row_idx) AS first_row
FROM hit JOIN rec ON rec.name_key = hit.name_key GROUP BY hit.uq, hit.name_key"""),
    "tokens_count": _with(_terms("documents", "doc_id", "text", "dt"), """SELECT doc_id, len(toks) AS n_tokens, len(list_distinct(toks)) AS n_distinct,
  md5(array_to_string(toks, ' ')) AS tokens_md5 FROM dt_tok"""),
    "ngram_tf": _with(_terms("documents", "doc_id", "text", "dt"), """SELECT doc_id, coalesce(n_terms, 0) AS n_terms, coalesce(n_occurrences, 0) AS n_occurrences, coalesce(max_tf, 0) AS max_tf,
  coalesce(n_bigrams, 0) AS n_bigrams, last_term FROM (SELECT doc_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_occurrences, max(tf) AS max_tf,
  CAST(sum(CASE WHEN contains(term, ' ') THEN tf ELSE 0 END) AS BIGINT) AS n_bigrams, max(term) AS last_term FROM dt GROUP BY doc_id) t RIGHT JOIN documents USING (doc_id)"""),
    "idf_table": _with(_terms("documents", "doc_id", "text", "dt"), _idf("documents", "doc_id", "dt"), "SELECT term, df, round(idf, 9) AS idf FROM idf"),
    "tfidf_norms": _with(_terms("documents", "doc_id", "text", "dt"), _idf("documents", "doc_id", "dt"), _norms("dt", "doc_id", "dn"),
                         "SELECT doc_id, coalesce(n_terms, 0) AS n_terms, round(coalesce(norm, 0), 6) AS norm FROM documents LEFT JOIN dn USING (doc_id)"),
    "tfidf_cosine": _with(BENCH_INDEX, "SELECT item_id, count(*) AS n_docs, round(max(score), 6) AS max_score, round(sum(score), 6) AS sum_score FROM cos GROUP BY item_id"),
    "tfidf_topk": _with(BENCH_INDEX, """SELECT item_id, rn, doc_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rn FROM cos) t WHERE rn <= 5"""),
    "tfidf_transform_frozen": _with(_terms("documents", "doc_id", "text", "dt"), _idf("documents", "doc_id", "dt"),
                                    "turns AS (SELECT concat(CAST(conv_id AS VARCHAR), ':', CAST(turn AS VARCHAR)) AS turn_id, text FROM conversations)",
                                    _terms("turns", "turn_id", "text", "ct"), _norms("ct", "turn_id", "cn"),
                                    "SELECT turn_id, coalesce(n_terms, 0) AS n_known, round(coalesce(norm, 0), 6) AS norm FROM turns LEFT JOIN cn USING (turn_id)"),
    "tfidf_frozen_topk": _with(_terms("documents", "doc_id", "text", "fit"), _idf("documents", "doc_id", "fit"),
                               "turns AS (SELECT concat(CAST(conv_id AS VARCHAR), ':', CAST(turn AS VARCHAR)) AS turn_id, text FROM conversations)",
                               _terms("turns", "turn_id", "text", "dt"), _terms("benchmark", "item_id", "text", "qt"),
                               _norms("dt", "turn_id", "dn"), _norms("qt", "item_id", "qn"), _cosine("item_id", "turn_id"),
                               """SELECT item_id, rn, turn_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, turn_id) AS rn FROM cos) t WHERE rn <= 5"""),
    "dense_cosine_topk": """WITH pos AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
cen AS (SELECT label, list(x ORDER BY i) AS q FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM pos GROUP BY label, i) t GROUP BY label),
sc AS (SELECT CAST(e.label AS BIGINT) AS label, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.q) AS score FROM embeddings e JOIN cen c ON c.label = e.label)
SELECT label, rn, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, vec_id) AS rn FROM sc) t WHERE rn <= 10""",
    "dense_pruned_topk": """WITH sc AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score
  FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)
SELECT query_id, rn, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rn FROM sc) t WHERE rn <= 10""",
    "topk_zero_padded": _with(RETRIEVAL, _ranked("SELECT p.uq, r.row_idx, false AS exhaustive FROM uprof p CROSS JOIN rec r"),
                              "SELECT uq, rn, record_id, round(score, 6) AS score FROM ordered JOIN rec USING (row_idx) WHERE rn <= 5"),
    "rank_candidates": _with(RETRIEVAL, _ranked(f"SELECT p.uq, r.row_idx, false AS exhaustive FROM uprof p JOIN rec r ON p.applied AND {_ELIGIBLE}"),
                             "SELECT uq, rn, record_id, round(score, 6) AS score FROM ordered JOIN rec USING (row_idx) WHERE rn <= 5"),
    "retrieve_topk": _with(RANKED, """SELECT p.qid, o.rn, r.record_id, round(o.score, 6) AS score
FROM prof p JOIN ordered o ON o.uq = p.uq JOIN rec r USING (row_idx) WHERE NOT o.exhaustive AND o.rn <= 5"""),
    "retrieve_exhaustive": _with(RANKED, "SELECT o.uq, o.rn, r.record_id, round(o.score, 6) AS score FROM ordered o JOIN rec r USING (row_idx) WHERE o.exhaustive"),
    "retrieve_route_counts": _with(RETRIEVAL, """SELECT t.route, t.exhaustive, count(*) AS n_questions, count(DISTINCT t.uq) AS n_distinct
FROM prof p JOIN routed t ON t.uq = p.uq GROUP BY t.route, t.exhaustive"""),
    "context_block": _with(RANKED, KEPT, CONTEXT, f"""SELECT u.uq, coalesce(b.n_records, 0) AS n_records,
  length(coalesce(b.context, {_text(v.EMPTY_CONTEXT)})) AS n_chars, md5(coalesce(b.context, {_text(v.EMPTY_CONTEXT)})) AS context_md5
FROM uprof u LEFT JOIN blocks b ON b.uq = u.uq WHERE NOT u.exhaustive"""),
    "context_paragraphs": _with(RANKED, CONTEXT.split(",\nblocks AS")[0], """SELECT o.uq, o.rn, length(txt) AS n_chars, md5(txt) AS text_md5
FROM ordered o JOIN para USING (row_idx) WHERE o.exhaustive"""),
    "prompt_rows": _with(RANKED, KEPT, CONTEXT, f"""SELECT qid, length(t) AS n_chars, md5(t) AS prompt_md5 FROM (
  SELECT p.qid, concat({_text(v.PROMPT_HEAD)}, b.context, {_text(v.PROMPT_QUESTION)}, coalesce(p.question, ''), {_text(v.PROMPT_TAIL)}) AS t
  FROM prof p JOIN blocks b ON b.uq = p.uq) x"""),
    "prompt_parts": _with(RANKED, PARTS, f"""SELECT qid, part, kind, first_place, last_place, n_chars, text_md5 FROM parts JOIN prof p USING (uq)
UNION ALL SELECT p.qid, 0, 'head', NULL, NULL, length({_text(v.PROMPT_HEAD)}), md5({_text(v.PROMPT_HEAD)}) FROM prof p WHERE uq IN (SELECT uq FROM kept)
UNION ALL SELECT qid, n + 1, 'question', NULL, NULL, length(t), md5(t) FROM (
  SELECT p.qid, k.n, concat({_text(v.PROMPT_QUESTION)}, coalesce(p.question, ''), {_text(v.PROMPT_TAIL)}) AS t
  FROM prof p JOIN (SELECT uq, count(*) AS n FROM kept GROUP BY uq) k ON k.uq = p.uq) x"""),
    "prompt_sizes": _with(RANKED, PARTS, f"""SELECT p.qid, length(concat({_text(v.PROMPT_HEAD)}, c.context, {_text(v.PROMPT_QUESTION)}, coalesce(p.question, ''), {_text(v.PROMPT_TAIL)})) AS n_chars, c.n_records
FROM prof p JOIN (SELECT uq, count(*) AS n_records, string_agg(txt, concat(chr(10), chr(10)) ORDER BY rn) AS context FROM laid GROUP BY uq) c ON c.uq = p.uq"""),
    "retrieve_all": _with(RANKED, KEPT, "SELECT p.qid, k.rn, k.record_id, round(k.score, 6) AS score FROM prof p JOIN kept k ON k.uq = p.uq"),
    "json_object_extract": _with(RESP, f"SELECT resp_id, {_OBJECT} AS object FROM resp"),
    "response_validate": _with(RESP, VALID, "SELECT resp_id, answer, array_to_string(citations, '|') AS citations, answered, reason_if_unanswered, valid, quarantined FROM val"),
    "citation_check": _with(ANSWERS, "SELECT resp_id, cites AS citations, dropped FROM checked"),
    "dropped_citation_stats": _with(ANSWERS, """SELECT model, count(*) AS n_responses, CAST(sum(dropped) AS BIGINT) AS n_dropped,
  CAST(sum(CASE WHEN dropped > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_with_dropped, CAST(sum(CASE WHEN valid THEN 0 ELSE 1 END) AS BIGINT) AS n_invalid FROM checked GROUP BY model"""),
    "answer_report": _with(ANSWERS, """SELECT qid, resp_id, CAST(to_json({'answer': answer, 'citations': citations, 'answered': answered,
  'reason_if_unanswered': reason_if_unanswered}) AS VARCHAR) AS json FROM final"""),
    **{f"redact_{rule}": _masked(_mask("text", rule)) for rule, *_ in _RULES},
    "redact_all": _masked(_redact("text")),
    "redaction_stats": _stats(),
    "log_roundtrip": _with(LOG, PRICED, f"""SELECT {_redact("l.question")} AS question, {_redact("l.answer")} AS answer, l.answered,
  {_redact("l.reason")} AS reason_if_unanswered, l.model, CASE WHEN l.model IS NOT NULL THEN l.input_tokens END AS input_tokens,
  CASE WHEN l.model IS NOT NULL THEN l.output_tokens END AS output_tokens, CASE WHEN l.model IS NOT NULL THEN l.latency_s END AS latency_s,
  {_half_up("c.cost_inr", 4)} AS cost_inr FROM qlog l LEFT JOIN costed c USING (seq)"""),
    "log_summary_active": _with(LOG, PRICED, f"SELECT model, {_SUMMARY} FROM costed WHERE {_ACTIVE} GROUP BY model"),
    "log_batches": _with(LOG, PRICED, f"""SELECT concat('calls-', CAST(l.seq % 4 AS VARCHAR)) AS batch, l.seq, {_redact("l.question")} AS question,
  {_redact("l.answer")} AS answer, l.model, CASE WHEN l.model IS NOT NULL THEN l.input_tokens END AS input_tokens, {_half_up("c.cost_inr", 4)} AS cost_inr
FROM qlog l LEFT JOIN costed c USING (seq)"""),
    "log_rejects": _with(LOG, """SELECT reason, count(*) AS n_lines FROM (
  SELECT CASE seq % 4 WHEN 0 THEN 'blank' WHEN 1 THEN 'malformed' WHEN 2 THEN 'no cost' ELSE 'missing key' END AS reason FROM qlog
  UNION ALL SELECT 'no cost' FROM qlog WHERE model IS NULL) t GROUP BY reason"""),
    "log_missing": _with(LOG, PRICED, f"SELECT model, {_SUMMARY} FROM costed WHERE false GROUP BY model"),
    "pipeline_log": _with(ANSWERS, f"""prices(model, usd_in, usd_out) AS (VALUES {", ".join(f"({_text(m)}, CAST({i} AS DOUBLE), CAST({o} AS DOUBLE))" for m, i, o in v.PRICES)})""", f"""SELECT
  CASE WHEN f.resp_id < 0 THEN -f.qid ELSE f.resp_id END AS seq, {_redact("q.question")} AS question, {_redact("f.answer")} AS answer,
  array_to_string(f.citations, '|') AS citations, f.answered, {_redact("f.reason_if_unanswered")} AS reason_if_unanswered, r.model,
  r.input_tokens, r.output_tokens, {_half_up(f"(r.input_tokens / 1e6 * coalesce(p.usd_in, d.usd_in) + r.output_tokens / 1e6 * coalesce(p.usd_out, d.usd_out)) * {v.USD_TO_INR}", 4)} AS cost_inr
FROM final f JOIN q USING (qid) LEFT JOIN resp r ON r.resp_id = f.resp_id AND r.error_type IS NULL
LEFT JOIN prices p ON p.model = r.model CROSS JOIN (SELECT * FROM prices WHERE model = {_text(v.DEFAULT_MODEL)}) d"""),
    "log_cost_rows": _with(LOG, PRICED, f"SELECT {_redact('question')} AS question, model, input_tokens, output_tokens, latency_s, {_half_up('cost_inr', 6)} AS cost_inr FROM costed"),
    "cost_report_json": _with(LOG, PRICED, f"""SELECT 'entry' AS kind, seq, model, question, input_tokens, latency_s,
  CAST(NULL AS BIGINT) AS queries_measured, CAST(NULL AS DOUBLE) AS cost_inr_per_1000_queries FROM costed
UNION ALL SELECT 'summary', -1, model, NULL, NULL, NULL, count(*), {_half_up('avg(cost_inr) * 1000', 2)} FROM costed WHERE {_ACTIVE} GROUP BY model"""),
    "cost_report_saved": _with(LOG, PRICED, f"""SELECT 'entry' AS kind, model, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(NULL AS DOUBLE) AS cost_inr_per_1000_queries FROM costed GROUP BY model
UNION ALL SELECT 'summary', model, 1, NULL, {_half_up('avg(cost_inr) * 1000', 2)} FROM costed WHERE {_ACTIVE} GROUP BY model"""),
    "cost_per_query": _with(LOG, PRICED, f"SELECT seq, model, {_half_up('cost_usd', 9)} AS cost_usd, {_half_up('cost_inr', 6)} AS cost_inr FROM costed"),
    "cost_summary_active": _with(LOG, PRICED, f"SELECT model, {_SUMMARY} FROM costed WHERE {_ACTIVE} GROUP BY model"),
    "cost_by_model": _with(LOG, PRICED, f"SELECT model, {_SUMMARY} FROM costed GROUP BY model"),
    "cases_json": _with(Q, CASES.split(",\nscored AS")[0], """SELECT case_id, CAST(qid AS VARCHAR) AS question, expected_answered,
  array_to_string(expected_citations, '|') AS expected_citations, array_to_string(any_of, '|') AS any_of,
  array_to_string(required, '|') AS required, array_to_string(forbidden, '|') AS forbidden FROM cases"""),
    "answer_report_saved": _with(ANSWERS, """SELECT answered, count(*) AS n, CAST(sum(length(CAST(to_json({'answer': answer, 'citations': citations, 'answered': answered,
  'reason_if_unanswered': reason_if_unanswered}) AS VARCHAR))) AS BIGINT) AS n_chars FROM final GROUP BY answered"""),
    "eval_score": _with(ANSWERS, CASES, "SELECT case_id, resp_id, len(failures) = 0 AS passed, array_to_string(failures, '; ') AS failures FROM scored"),
    "eval_pass_rate": _with(ANSWERS, CASES, """SELECT CAST(coalesce(sum(CASE WHEN len(failures) = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_passed, count(*) AS n_total,
  round(sum(CASE WHEN len(failures) = 0 THEN 1 ELSE 0 END) * 100 / CAST(nullif(count(*), 0) AS DOUBLE), 4) AS pass_pct FROM scored"""),
}
ORACLES["tfidf_saved_topk"] = ORACLES["tfidf_topk"]
