"""Tables derived from the driver's TPC-H-like tables.

Each is one SELECT that both Spark and DuckDB run, so the SQL oracles see the same rows. The
catalogue comes from ``part``/``lineitem``/``nation``, questions from ``customer``/``part``,
responses from ``orders``, the call log from ``events`` and the evaluation cases from
``customer``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CATALOG_RAW = """
SELECT p.p_partkey AS row_idx,
       concat('R', CAST(p.p_partkey AS STRING)) AS record_id,
       CASE WHEN p.p_size = 50 THEN upper(split_part(p.p_name, ' ', 2))
            WHEN p.p_size = 49 THEN concat(upper(p.p_name), ' & ', lower(p.p_type))
            ELSE concat(upper(p.p_name), ' ', lower(p.p_type)) END AS name,
       concat('City ', CAST(p.p_partkey % 97 AS STRING)) AS city,
       n.n_name AS state,
       p.p_type AS type,
       concat(p.p_brand, '; ', p.p_type, ';  ; size ', CAST(p.p_size AS STRING)) AS courses,
       CASE WHEN p.p_partkey % 89 = 7 THEN NULL ELSE CAST(round(p.p_retailprice * 100) AS BIGINT) END AS fee,
       CAST(50 + p.p_size AS DOUBLE) + CASE WHEN p.p_partkey % 9 = 4 THEN 0.5 ELSE 0 END AS cutoff,
       CAST(coalesce(l.n_lines, 0) AS BIGINT) AS seats,
       CASE p.p_partkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN ' yes ' WHEN 2 THEN 'No' END AS flag_text,
       CASE WHEN p.p_partkey % 61 = 5 THEN NULL WHEN p.p_size <= 10 THEN 'A+' WHEN p.p_size <= 30 THEN 'A' ELSE 'B++' END AS grade,
       CASE WHEN p.p_partkey % 71 = 9 THEN NULL WHEN p.p_size = 7 OR l.avg_qty IS NULL THEN CAST(0 AS DOUBLE)
            ELSE round(l.avg_qty / 5, 1) END AS placement,
       CAST(coalesce(l.first_year, 1990) AS BIGINT) AS established,
       CASE WHEN p.p_partkey % 53 = 3 THEN NULL ELSE
         concat('Ships as ', p.p_brand, ' stock in size ', CAST(p.p_size AS STRING),
                ' for the ', lower(p.p_type), ' range.') END AS about
FROM {part} p
JOIN {nation} n ON n.n_nationkey = p.p_partkey % 25
LEFT JOIN (SELECT l_partkey, avg(l_quantity) AS avg_qty, count(*) AS n_lines,
                  min(year(l_shipdate)) AS first_year
           FROM {lineitem} GROUP BY l_partkey) l ON l.l_partkey = p.p_partkey
"""

QUESTIONS = """
SELECT qid,
  CASE template
    WHEN 0 THEN CASE WHEN j % 9 = 4 THEN 'budget 0k' ELSE concat('budget ', CAST(45 + j % 6 AS STRING), 'k per sem') END
    WHEN 1 THEN concat('Fees under 0.9', CAST(j % 10 AS STRING), ' lakh')
    WHEN 2 THEN concat('costing 9', CAST(j % 10 AS STRING), ',', CAST(100 + (j % 8) * 100 AS STRING), ' per year')
    WHEN 3 THEN concat('I scored ', CAST(55 + j % 40 AS STRING), '% and want ', wanted)
    WHEN 4 THEN concat('aggregate ', CAST(60 + j % 30 AS STRING), ', placement above ', CAST(4 + j % 3 AS STRING), '.5 LPA')
    WHEN 5 THEN concat('does any ', wanted, ' have hostel facilities')
    WHEN 6 THEN CASE j % 5
        WHEN 0 THEN concat('Tell me about ', p_name)
        WHEN 1 THEN concat('what about ', p_name, ' & ', lower(p_type), '?')
        WHEN 2 THEN concat('Show every ', p_name)
        WHEN 3 THEN concat('the ', split_part(p_name, ' ', 1), ' and ', lower(p_type), ' ones')
        ELSE concat('more ', split_part(p_name, ' ', 2), 's please') END
    WHEN 7 THEN concat('compare ', CASE j % 3 WHEN 0 THEN 'engineering' WHEN 1 THEN 'B.Tech' ELSE 'law' END,
                       ' with ', CASE j % 4 WHEN 0 THEN 'MBA' WHEN 1 THEN 'medical' WHEN 2 THEN 'design' ELSE 'media' END)
    WHEN 8 THEN CASE j % 8 WHEN 5 THEN NULL WHEN 6 THEN 'scored 0 percent overall' WHEN 7 THEN 'placement above 0, 0 lakh budget'
           ELSE concat('score high, ', CAST(60 + j % 35 AS STRING), ' last year') END
    WHEN 9 THEN concat(CASE WHEN j % 5 = 0 THEN 'all stock in size ' ELSE 'stock in size ' END, CAST(1 + j % 50 AS STRING), ' please')
    WHEN 10 THEN concat('min placement ', CAST(4 + j % 4 AS STRING), ' under ', CAST(92 + j % 8 AS STRING), 'k')
    ELSE 'scored 30% under 10k'
  END AS question
FROM (SELECT c.c_custkey AS qid, c.c_custkey % 12 AS template,
             CAST(floor(c.c_custkey / 12) AS BIGINT) AS j, p.p_name, p.p_type,
             CASE c.c_nationkey % 3 WHEN 0 THEN 'economy' WHEN 1 THEN 'promo' ELSE 'standard' END AS wanted
      FROM {customer} c LEFT JOIN {part} p ON p.p_partkey = c.c_custkey) q
"""

RESPONSES = """
SELECT resp_id, qid, model, error_type, error_message,
  CASE WHEN error_type IS NULL THEN
    CASE CAST(resp_id % 8 AS INT)
      WHEN 0 THEN concat('```json', chr(10), '{{"answer": "', body, '", "citations": ["', own, '", "', low, '"], "answered": true, "reason_if_unanswered": null}}', chr(10), '```')
      WHEN 1 THEN concat('Sure! {{"answer": "', body, '", "citations": ["', low, '", "R999999999999", "', low, '"], "answered": true}} Hope this helps.')
      WHEN 2 THEN concat('{{"answer": "', body, '", "citations": ["', own, '"]}}')
      WHEN 3 THEN concat('{{"answer": "', body, '", "citations": "', own, '", "answered": true}}')
      WHEN 4 THEN concat('{{"answer": "', body, '", "citations": ["', own)
      WHEN 5 THEN concat('{{"answer": "Not in the data.", "citations": ["', own, '"], "answered": false, "reason_if_unanswered": "nothing in context"}}')
      WHEN 6 THEN concat('  {{"confidence": 0.5, "answer": "', body, '", "citations": ["', low, '", "', own, '", "R0", "', low, '"], "answered": true, "reason_if_unanswered": null}}  ')
      ELSE 'I do not know.'
    END END AS raw_text,
  input_tokens, output_tokens, latency_s
FROM (SELECT o.o_orderkey AS resp_id, o.o_custkey AS qid, o.o_orderpriority AS model,
             CASE WHEN o.o_orderkey % 17 = 3 THEN 'TimeoutError' END AS error_type,
             CASE WHEN o.o_orderkey % 17 = 3 THEN 'deadline exceeded' END AS error_message,
             concat('Record ', CAST(o.o_custkey AS STRING), ' depends on fees of ', CAST(CAST(floor(o.o_totalprice) AS BIGINT) AS STRING), ' and size') AS body,
             concat('R', CAST(o.o_custkey AS STRING)) AS own,
             concat('R', CAST(o.o_orderkey % 40 AS STRING)) AS low,
             1000 + o.o_orderkey % 500 AS input_tokens, 100 + o.o_orderkey % 90 AS output_tokens,
             CAST(o.o_orderkey % 300 AS DOUBLE) / 100 AS latency_s
      FROM {orders} o) r
"""

QUERY_LOG = """
SELECT e.event_id AS seq,
       concat('call 98765', CAST(10000 + e.user_id % 90000 AS STRING), ' or mail u', CAST(e.user_id AS STRING), '@mail.example.com about ', e.event_type) AS question,
       concat('Family income is Rs ', CAST(100000 + e.user_id AS STRING), ' noted') AS answer,
       e.event_type <> 'error' AS answered,
       CASE WHEN e.event_type = 'error' THEN concat('asked from u', CAST(e.user_id AS STRING), '@mail.example.com') END AS reason,
       CASE WHEN e.event_type = 'view' THEN NULL
            ELSE CASE e.event_type WHEN 'click' THEN 'gemini-2.5-flash' WHEN 'purchase' THEN 'gemini-3.1-flash-lite'
                 WHEN 'signup' THEN 'unlisted-model' ELSE 'gemini-2.5-flash-lite' END END AS model,
       CAST(regexp_extract(e.props, '([0-9]+)', 1) AS BIGINT) * 20 AS input_tokens,
       CAST(regexp_extract(e.props, '([0-9]+)', 1) AS BIGINT) * 2 AS output_tokens,
       e.value / 100 AS latency_s
FROM {events} e
"""

CASES = """
SELECT c.c_custkey AS qid,
       concat('case', CAST(c.c_custkey AS STRING)) AS case_id,
       CASE WHEN c.c_custkey % 3 = 0 THEN NULL ELSE c.c_custkey % 3 = 1 END AS expected_answered,
       CASE c.c_custkey % 4 WHEN 0 THEN concat('R', CAST(c.c_custkey AS STRING))
                            WHEN 1 THEN '' END AS expected_citations,
       CASE WHEN c.c_custkey % 5 = 2 THEN concat('R', CAST(c.c_custkey AS STRING), ';R0;R1') END AS any_of,
       CASE WHEN c.c_custkey % 2 = 0 THEN 'DEPENDS;size' ELSE '' END AS required,
       CASE WHEN c.c_custkey % 7 = 0 THEN 'fees;worst' END AS forbidden
FROM {customer} c
"""

# Text with the kinds of personal data the documents lack, to go with the corpora.
SEEDED_TEXT = """
SELECT c.c_custkey AS text_id,
  CASE CAST(c.c_custkey % 8 AS INT)
    WHEN 0 THEN concat('my email is ', lower(replace(c.c_name, '#', '.')), '@mail.example.com')
    WHEN 1 THEN concat('contact me at 98765', CAST(10000 + c.c_custkey % 90000 AS STRING), ' immediately')
    WHEN 2 THEN concat('Aadhaar: 1234 5678 ', CAST(1000 + c.c_custkey % 9000 AS STRING), ' or 12345678', CAST(1000 + c.c_custkey % 9000 AS STRING))
    WHEN 3 THEN concat('My family income is ', CAST(c.c_custkey % 9 AS STRING), '.5 lakhs')
    WHEN 4 THEN concat('Income Rs. ', CAST(100000 + c.c_custkey AS STRING), ' and fees Rs ', CAST(10000 + c.c_custkey % 90000 AS STRING))
    WHEN 5 THEN 'fees Rs 98,000 or (987) 654-3210 or +91 9876543210'
    WHEN 6 THEN ''
    ELSE concat('Write to a.b-c@x.org; income is rs 400000. id 1234-5678-9012, ', c.c_mktsegment)
  END AS text
FROM {customer} c
"""


# Fields of the catalogue's CSV file and the columns of the view they come from.
CSV_FROM = {
    "college_id": "record_id", "name": "name", "city": "city", "state": "state", "type": "type", "courses_offered": "courses",
    "annual_fees_inr": "fee", "last_year_cutoff_pct": "cutoff", "total_seats": "seats", "hostel_available": "flag_text",
    "naac_grade": "grade", "avg_placement_lpa": "placement", "established_year": "established", "about": "about",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def catalog_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, CATALOG_RAW, "part", "nation", "lineitem")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, QUESTIONS, "customer", "part")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, RESPONSES, "orders")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, QUERY_LOG, "events")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, CASES, "customer")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, conversation turns and seeded text under one key."""
    docs = table(spark, sf_dir, "documents").selectExpr(
        "'documents' AS origin", "doc_id AS text_id", "0L AS part", "lang AS tag", "text"
    )
    turns = table(spark, sf_dir, "conversations").selectExpr(
        "'conversations' AS origin", "conv_id AS text_id", "turn AS part", "role AS tag", "text"
    )
    seeded = _select(spark, sf_dir, SEEDED_TEXT, "customer").selectExpr(
        "'seeded' AS origin", "text_id", "0L AS part", "'en' AS tag", "text"
    )
    return docs.unionByName(turns).unionByName(seeded)
