"""Queries of source selection, batch reduction and document contracts, and the same in SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from factloom.operators import packages as p
from factloom.sources import facts as src

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


@query("fin1_canonical_sources",
    src.sql("""k AS (SELECT *, CASE field_key WHEN 'REVENUE' THEN 'OPERATE_INCOME' WHEN 'COST' THEN 'OPERATE_COST' ELSE 'TOTAL_ASSETS' END AS k FROM facts)
SELECT security_code, family, report_date, k AS field_key, value_num, CASE WHEN family = 'RPT_F10_FINANCE_GINCOMEQC' THEN 'STANDALONE'
    ELSE 'CUMULATIVE' END AS period_basis, 100::INT AS source_priority FROM k
WHERE (k = 'TOTAL_ASSETS' AND family = 'RPT_F10_FINANCE_GBALANCE') OR (k <> 'TOTAL_ASSETS' AND family IN ('RPT_F10_FINANCE_GINCOME', 'RPT_F10_FINANCE_GINCOMEQC'))"""))
def fin1(spark, d):
    key = F.when(F.col("field_key") == "REVENUE", "operate_income").when(F.col("field_key") == "COST", "OPERATE_COST").otherwise("TOTAL_ASSETS")
    rows = src.facts(spark, d).withColumn("field_key", key)
    return p.canonical_sources(rows.unionByName(rows)).select("security_code", "family", "report_date", "field_key", "value_num", "period_basis",
        "source_priority")


@query("fin12_duplicate_resolution",
    src.sql("SELECT security_code, report_date, field_key, 'CONFLICTING' AS status, 2::BIGINT AS candidate_count, 2::INT AS listed FROM facts_restated WHERE abs(value_num) > 1e-6"))
def fin12(spark, d):
    both = src.facts_cum(spark, d).unionByName(src.facts_restated(spark, d)).withColumn("tier", F.lit(1))
    found = p.duplicate_resolution(both.withColumn("k", F.col("field_key")), ["security_code", "report_date", "k"])
    return found.select("security_code", "report_date", F.col("k").alias("field_key"), "status", "candidate_count",
        F.json_array_length("candidate_values").alias("listed"))


def stocks(spark, d):
    t = F.col("event_type")
    status = (
        F.when(t == "click", "COMPLETED").when(t == "view", "COMPLETED_WITH_GAPS").when(t == "error",
            F.when(F.col("value") > 50, "FAILED_TERMINAL").otherwise("FAILED_RETRYABLE"))
        .when(t == "purchase", "DEFERRED_TIME_BUDGET").otherwise("RUNNING")
    )
    return src.table(spark, d, "events").select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("security_id"), status.alias("status"),
        F.lit("").alias("message"), F.when(t == "error", F.lit("E1")).alias("error_code"))


STOCKS = """s AS (SELECT user_id AS batch_id, event_id AS security_id, CASE event_type WHEN 'click' THEN 'COMPLETED' WHEN 'view' THEN 'COMPLETED_WITH_GAPS'
    WHEN 'purchase' THEN 'DEFERRED_TIME_BUDGET'
  WHEN 'error' THEN CASE WHEN value > 50 THEN 'FAILED_TERMINAL' ELSE 'FAILED_RETRYABLE' END ELSE 'RUNNING' END AS status FROM events)"""


@query("fin16_batch_reports", f"""WITH {STOCKS}, g AS (SELECT batch_id, count(*) AS input_count,
    count(*) FILTER (status LIKE 'COMPLETED%') AS successful_count, count(*) FILTER (status LIKE 'FAILED%') AS failed_count,
  count(*) FILTER (status LIKE 'DEFERRED%') AS deferred_count, count(*) FILTER (status = 'FAILED_TERMINAL') AS t, count(*) FILTER (status = 'COMPLETED_WITH_GAPS') AS w FROM s GROUP BY 1)
SELECT batch_id, input_count, successful_count, failed_count, deferred_count, failed_count + deferred_count AS data_gap_rows,
    successful_count + failed_count + deferred_count = input_count AS conserved,
  CASE WHEN t > 0 THEN 'FAILED_TERMINAL' WHEN failed_count + deferred_count > 0 THEN 'FAILED_RECOVERABLE' WHEN w > 0 THEN 'PASS_WITH_GAPS' ELSE 'PASS' END AS status FROM g""")
def fin16(spark, d):
    rows = stocks(spark, d)
    return p.batch_reports(rows, p.failure_gaps(rows))


@query("fin16_ledgers", f"""WITH {STOCKS} SELECT batch_id, CASE WHEN status LIKE 'COMPLETED%' THEN 'COMPLETED' WHEN status LIKE 'FAILED%' THEN 'FAILED'
    WHEN status LIKE 'DEFERRED%' THEN 'DEFERRED' ELSE 'OPEN' END AS ledger, count(*) AS n FROM s GROUP BY ALL""")
def fin16_ledgers(spark, d):
    return p.ledgers(stocks(spark, d)).groupBy("batch_id", "ledger").agg(F.count(F.lit(1)).alias("n"))


@query("fin17_market_violations", """WITH b AS (SELECT n_name, n_nationkey AS k, n_regionkey AS r FROM nation)
SELECT 'UNKNOWN_BATCH' AS rule, n_name AS id FROM b WHERE k % 7 = 3 UNION ALL SELECT 'BATCH_NOT_SUCCESSFUL', n_name FROM b WHERE r = 0
    UNION ALL SELECT 'CUTOFF_MISMATCH', n_name FROM b WHERE r = 1 AND k % 7 <> 3
UNION ALL SELECT 'NONTERMINAL_SECURITIES', n_name FROM b WHERE k % 5 = 4 UNION ALL SELECT 'MISSING_BATCH', 'NOWHERE'
UNION ALL SELECT 'DUPLICATE_SECURITY', CAST(o_custkey AS VARCHAR) FROM orders GROUP BY o_custkey HAVING count(*) > 1
UNION ALL SELECT 'MISSING_SECURITY', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'EXTRA_SECURITY', CAST(o_custkey AS VARCHAR) FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'DUPLICATE_KEY', o_custkey || '|' || strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE) HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'AVAILABLE_AT_MISSING', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_totalprice < 5000
UNION ALL SELECT DISTINCT 'FUTURE_ROW', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_totalprice >= 5000 AND CAST(o_orderdate AS DATE) + 30 > DATE '2001-06-30'""")
def fin17_market(spark, d):
    n, o = src.table(spark, d, "nation"), src.table(spark, d, "orders")
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    same = [F.lit("p").alias("package_sha256"), F.lit("b").alias("batch_sha256")]
    batches = n.select(F.col("n_name").alias("batch_id"), F.when(r == 0, "FAILED_RECOVERABLE").otherwise("PASS").alias("status"),
        F.when(r == 1, "2024-01-01").otherwise("2024-12-31").alias("as_of_date"), *same, (k % 5 == 4).cast("int").alias("n_failed"))
    expected = n.filter(k % 7 != 3).select(F.col("n_name").alias("batch_id")).unionByName(spark.createDataFrame([("NOWHERE",)],
        "batch_id string")).select("batch_id", F.lit("2024-12-31").alias("as_of_date"), *same)
    completed, requested = o.select(F.col("o_custkey").alias("security_id")), src.table(spark, d, "customer").select(F.col("c_custkey").alias("security_id"))
    date = F.col("o_orderdate").cast("date")
    formal = o.select(F.col("o_custkey").alias("security_id"), F.date_format(date, "yyyy-MM-dd").alias("report_period"),
        F.when(F.col("o_totalprice") >= 5000, F.date_add(date, 30)).alias("available_at"))
    return p.market_violations(batches, expected, completed, requested, formal, F.lit(datetime.date(2001, 6, 30)))


def documents(spark, d):
    n = F.coalesce(F.length("html"), F.lit(0))
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (n % k + 1).cast("int"))
    return src.table(spark, d, "pages").select(
        F.col("page_id").cast("string").alias("document_id"), F.col("url").alias("source_url"),
            pick(["FACT_DIRECT", "NO_MATCH", "PERMISSION_BLOCKED", "SECONDARY_SOURCE"], 4).alias("status"),
        pick(["T0_STATUTORY", "T1_GOV_OFFICIAL", "T2_COMPANY", "T3_AUTHORIZED", "T4_SECONDARY"], 5).alias("source_tier"), F.lit("P1").alias("pack_id"),
            F.when(n % 2 == 1, F.col("url")).alias("query"),
        F.when(n % 3 == 1, "web").alias("search_scope"), F.when(n % 7 < 5, "ask").alias("minimum_human_action"),
            F.when(n % 6 == 0, n.cast("long")).alias("file_size_bytes"),
        F.when(n > 0, F.sha2("html", 256)).alias("sha256"), (n % 3 == 0).alias("raw_original_binary_saved"), (n % 5 > 0).alias("parsed_text_saved"),
    )


DOCUMENTS = """p AS (SELECT CAST(page_id AS VARCHAR) AS document_id, url, html, coalesce(length(html), 0) AS n FROM pages),
d AS (SELECT *, ['FACT_DIRECT', 'NO_MATCH', 'PERMISSION_BLOCKED', 'SECONDARY_SOURCE'][n % 4 + 1] AS status, ['T0_STATUTORY', 'T1_GOV_OFFICIAL', 'T2_COMPANY',
    'T3_AUTHORIZED', 'T4_SECONDARY'][n % 5 + 1] AS tier FROM p)"""


@query("doc5_document_violations", f"""WITH {DOCUMENTS} SELECT document_id, 'FACT_DIRECT_TIER' AS rule FROM d WHERE status = 'FACT_DIRECT' AND n % 5 NOT IN (0,
    1, 3) UNION ALL SELECT document_id, 'SECONDARY_TIER' FROM d WHERE status = 'SECONDARY_SOURCE' AND n % 5 NOT IN (3, 4)
UNION ALL SELECT document_id, 'NO_MATCH_QUERY' FROM d WHERE status = 'NO_MATCH' AND NOT (n % 2 = 1 AND n % 3 = 1 AND coalesce(url, '') <> '')
    UNION ALL SELECT document_id, 'NO_MATCH_FILE' FROM d WHERE status = 'NO_MATCH' AND n % 6 = 0 AND n > 0
UNION ALL SELECT document_id, 'BLOCKED_ACTION' FROM d WHERE status = 'PERMISSION_BLOCKED' AND n % 7 >= 5""")
def doc5(spark, d):
    return p.document_violations(documents(spark, d))


@query("doc6_index_failures", f"""WITH {DOCUMENTS}, t AS (SELECT d.*, d.document_id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents) AS there FROM d)
SELECT document_id, 'missing downloaded source file or hash' AS failure FROM t WHERE n % 3 = 0 AND NOT (there AND n > 0) UNION ALL SELECT document_id,
    'NO_MATCH missing query' FROM t WHERE status = 'NO_MATCH' AND NOT (n % 2 = 1 AND coalesce(url, '') <> '')
UNION ALL SELECT document_id, 'PERMISSION_BLOCKED missing action' FROM t WHERE status = 'PERMISSION_BLOCKED' AND n % 7 >= 5""")
def doc6(spark, d):
    files = src.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"))
    return p.index_failures(documents(spark, d), files)


@query("flt15_documents_found", f"""WITH {DOCUMENTS}, b AS (SELECT CAST(doc_id AS VARCHAR) AS document_id FROM documents WHERE contains(lower(text), 'tion'))
SELECT document_id, url AS source_url FROM d WHERE tier = 'T3_AUTHORIZED' AND (contains(lower(coalesce(url, '') || ' P1 ' || status), 'tion')
    OR document_id IN (SELECT document_id FROM b))""")
def flt15(spark, d):
    bodies = src.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("body"))
    return p.documents_found(documents(spark, d), bodies, "TION", source_tier="T3_AUTHORIZED").select("document_id", "source_url")


@query("agg11_evidence_stats", f"""WITH {DOCUMENTS} SELECT 'status' AS kind, status AS value, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT 'source_tier',
    tier, count(*) FROM d GROUP BY ALL UNION ALL SELECT 'pack', 'P1', count(*) FROM d
UNION ALL SELECT 'all', 'documents', count(*) FROM d UNION ALL SELECT 'saved', 'files', count(*) FROM d WHERE n % 3 = 0 UNION ALL SELECT 'parsed', 'texts',
    count(*) FROM d WHERE n % 5 > 0""")
def agg11(spark, d):
    return p.evidence_stats(documents(spark, d))
