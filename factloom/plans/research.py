"""Queries of research sections, entities and ledgers, and the same in SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from factloom.operators import documents as doc
from factloom.operators import research as r
from factloom.sources import facts as src
from factloom.sources import sinks

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


@query("srt4_best_field", src.sql("""b AS (SELECT *, row_number() OVER (PARTITION BY security_code ORDER BY field_key <> 'COST', report_date DESC,
  CASE family WHEN 'RPT_F10_FINANCE_GBALANCE' THEN 0 WHEN 'RPT_F10_FINANCE_GINCOME' THEN 1 WHEN 'RPT_F10_FINANCE_GINCOMEQC' THEN 7 ELSE 90 END, family,
    dataset) AS n FROM facts WHERE field_key = 'COST')
SELECT security_code, family, report_date, value_num FROM b WHERE n = 1"""))
def srt4(spark, d):
    return r.best_field(src.facts(spark, d), "COST").select("security_code", "family", "report_date", "value_num")


@query("src9_united",
    "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def src9(spark, d):
    a = src.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return r.united([a, src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))], "id")


@query("map8_profit_quality", src.sql("""o AS (SELECT security_code, report_date, event_date, period_type, field_key, value_num FROM facts_cum UNION ALL
  SELECT security_code, report_date, event_date, period_type, field_key, value_num FROM facts_quarter WHERE quarter(report_date) > 1),
w AS (SELECT security_code, report_date, event_date, period_type, max(value_num) FILTER (field_key = 'REVENUE') AS np, max(value_num) FILTER (field_key = 'COST') AS ap,
  max(value_num) FILTER (field_key = 'QTY') AS ocf FROM o GROUP BY 1, 2, 3, 4)
SELECT security_code, report_date, event_date, period_type, m AS metric_id, round(v, 4) AS value_num, CASE WHEN v IS NULL THEN 'UNRESOLVED' ELSE 'FACT_CALCULATED' END AS status FROM (
  SELECT *, 'profit_quality.non_recurring_amount_calculated' AS m, np - ap AS v FROM w UNION ALL SELECT *, 'profit_quality.non_recurring_share', (np - ap) / nullif(abs(np), 0) * 100 FROM w
  UNION ALL SELECT *, 'profit_quality.cfo_to_adjusted_profit', ocf / nullif(ap, 0) FROM w UNION ALL SELECT *, 'profit_quality.simplified_free_cash_flow', NULL FROM w
  UNION ALL SELECT *, 'profit_quality.rd_capitalization_rate', NULL FROM w)"""))
def map8(spark, d):
    """Totals of the year and quarters of one date are periods of their own."""
    name = F.when(F.col("field_key") == "REVENUE", r.PARENT).when(F.col("field_key") == "COST", r.ADJUSTED).otherwise(r.OPERATING)
    rows = src.facts_cum(spark, d).unionByName(src.facts_quarter(spark, d).filter(F.quarter("report_date") > 1)).withColumn("metric_id", name)
    out = r.profit_quality(rows).withColumn("value_num", F.round("value_num", 4))
    return out.select("security_code", "report_date", "event_date", "period_type", "metric_id", "value_num", "status")


@query("map9_segments", """SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS security_code, l_suppkey || '|' || l_returnflag AS record_key,
    l_returnflag AS segment, round(sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE, 2) AS revenue,
  count(*)::DOUBLE AS cost, round(sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE - count(*), 2) AS profit FROM lineitem GROUP BY l_suppkey, l_returnflag""")
def map9(spark, d):
    g = src.table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("q"),
        F.count(F.lit(1)).cast("double").alias("n"))
    each = F.array(*[F.struct(F.lit(k).alias("field_key"), t.alias("value_text"), v.alias("value_num")) for k, t, v in (
        ("ITEM_NAME", F.col("l_returnflag"), F.lit(None).cast("double")), ("MAIN_INCOME", F.lit(None).cast("string"), F.col("q")),
            ("MAIN_COST", F.lit(None).cast("string"), F.col("n")))])
    rows = g.select(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("security_code"),
        F.concat_ws("|", F.col("l_suppkey").cast("string"), "l_returnflag").alias("record_key"), F.explode(each).alias("f"))
    out = r.segments(rows.select("security_code", "record_key", "f.*"), "NAME$", "INCOME$", "COST$")
    return out.select("security_code", "record_key", "segment", "revenue", "cost", "profit")


@query("jon12_entity_matches", """SELECT c_custkey AS id, lpad(CAST(c_custkey % 50 AS VARCHAR), 6, '0') AS security_code, CASE c_custkey % 5 WHEN 0 THEN 'CODE'
    WHEN 1 THEN 'LEGAL_NAME' WHEN 2 THEN 'FORMER_NAME' WHEN 3 THEN 'DOMAIN' ELSE 'SHORT_NAME' END AS rule
FROM customer WHERE c_custkey % 50 IN (SELECT s_suppkey FROM supplier)""")
def jon12(spark, d):
    s = src.table(spark, d, "supplier")
    n = F.lpad(F.col("s_suppkey").cast("string"), 6, "0")
    profiles = s.select(n.alias("security_code"), F.concat(F.lit("legal"), n).alias("legal_name"), F.array(F.concat(F.lit("former"), n)).alias("former_names"),
        F.concat(n, F.lit(".example.org")).alias("domain"), F.concat(F.lit("s"), n, F.lit("s")).alias("short_name"))
    m, k = F.lpad((F.col("c_custkey") % 50).cast("string"), 6, "0"), F.col("c_custkey") % 5
    text = F.when(k == 1, F.concat(F.lit("legal"), m)).when(k == 2, F.concat(F.lit("former"), m)).when(k == 4, F.concat(F.lit("the s"), m, F.lit("s group")))
    mentions = src.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.alias("text"),
        F.when(k == 3, F.concat(m, F.lit(".example.org"))).alias("domain"), F.when(k == 0, m).alias("code"))
    return r.entity_matches(mentions, profiles)


# Reports of all orders: of four kinds and one that has none, of three sources, some without a date of publishing.
METADATA = """d AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS code, CAST(o_orderdate AS DATE) AS t, ['annual', 'q1', 'half', 'q3', 'prospectus'][o_orderkey % 5 + 1] AS kind,
  ['SSE', 'szse', 'OTHER'][o_orderkey % 3 + 1] AS source, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) + 30 END AS p FROM orders),
v(kind, period, name, calculated) AS (VALUES ('annual', 'FY', '年报', false), ('annual', 'Q4', '四季度', true), ('q1', 'Q1', '一季报', false), ('half', 'H1', '中报', false), ('half', 'Q2', '二季度', true),
  ('q3', 'Q3C', '三季报', false), ('q3', 'Q3', '三季度', true)),
j AS (SELECT d.*, coalesce(period, CASE month(t) WHEN 3 THEN 'Q1' WHEN 6 THEN 'H1' WHEN 9 THEN 'Q3C' WHEN 12 THEN 'FY' ELSE 'OTHER' END) AS period, coalesce(name, d.kind) AS name,
  coalesce(calculated, false) AS calculated FROM d LEFT JOIN v USING (kind)),
f AS (SELECT *, CASE field_key WHEN 'SECUCODE' THEN code || CASE source WHEN 'SSE' THEN '.SH' WHEN 'szse' THEN '.SZ' ELSE '' END WHEN 'SECURITY_CODE' THEN code WHEN 'REPORT_DATE' THEN CAST(t AS VARCHAR)
  WHEN 'REPORT_TYPE' THEN name WHEN 'REPORT_DATE_NAME' THEN year(t) || name ELSE CAST(CAST(p AS DATE) AS VARCHAR) END AS value_text
  FROM j, (SELECT unnest(['SECUCODE', 'SECURITY_CODE', 'REPORT_DATE', 'REPORT_TYPE', 'REPORT_DATE_NAME', 'NOTICE_DATE', 'PUBLISH_DATE']) AS field_key))
"""


def metadata(spark, d):
    at = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (F.col("o_orderkey") % n + 1).cast("int"))
    date = F.col("o_orderdate").cast("date")
    docs = src.table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("security_code"), date.alias("report_date"), F.when(F.col("o_orderkey") % 7 > 0, F.date_add(date, 30)).alias("publish_date"),
        at(5, "annual", "q1", "half", "q3", "prospectus").alias("report_kind"), at(3, "SSE", "szse", "OTHER").alias("source"),
        F.col("o_orderkey").cast("string").alias("title"), F.lit("").alias("url"))
    return r.metadata_facts(docs)


@query("rec22_metadata_facts", "WITH " + METADATA + "SELECT code AS security_code, t AS report_date, CAST(k AS VARCHAR) AS dataset, period AS period_type, field_key, value_text FROM f WHERE value_text IS NOT NULL")
def rec22(spark, d):
    return metadata(spark, d).select("security_code", "report_date", "dataset", "period_type", "field_key", "value_text")


@query("rec22_all_metadata_facts", "WITH " + METADATA + """SELECT code || '|' || t || '|metadata|' || period || '|' || field_key AS record_key, k::VARCHAR AS source_document,
  CASE WHEN calculated THEN 'FACT_CALCULATED' ELSE 'FACT_DIRECT' END AS source_status, CAST(CAST(p AS DATE) AS VARCHAR) AS event_date FROM f WHERE value_text IS NOT NULL""")
def rec22_all(spark, d):
    return metadata(spark, d).select("record_key", "source_document", "source_status", "event_date")


@query("doc4_document_status", """SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'NO_MATCH' WHEN 6 THEN 'FACT_DIRECT' WHEN 2 THEN 'UNRESOLVED' ELSE 'PERMISSION_BLOCKED' END AS status,
  CASE page_id % 7 WHEN 0 THEN 'NO_EXACT_HIT' WHEN 1 THEN 'HTTP_403' WHEN 2 THEN 'HTTP_404' WHEN 3 THEN 'JS_REQUIRED' WHEN 4 THEN 'CAPTCHA_REQUIRED' WHEN 5 THEN 'LOGIN_REQUIRED'
    ELSE 'DOWNLOAD_OK' END AS access_status, page_id % 7 IN (1, 3, 4, 5) AS acts,
  'doc_' || left(sha256('600000|web|' || CASE page_id % 7 WHEN 0 THEN 'q' || page_id || '|NO_MATCH' WHEN 1 THEN 'q' || page_id || '|HTTP_403' WHEN 2 THEN url || '|HTTP_404' WHEN 3 THEN 'q' || page_id || '|JS_REQUIRED'
    WHEN 4 THEN 'q' || page_id || '|CAPTCHA_REQUIRED' WHEN 5 THEN 'q' || page_id || '|LOGIN_REQUIRED' ELSE url || '|' || sha256(html) END), 32) AS document_id FROM pages""")
def doc4(spark, d):
    """Stored pages through their gates to a status."""
    k = F.col("page_id") % 7
    code = F.when(k == 1, 403).when(k == 2, 404).otherwise(200)
    html = F.when(k == 3, "<p>Please Enable JavaScript</p>").when(k == 4, "请输入验证码").when(k == 5, "Login required").otherwise(F.col("html"))
    rows = src.table(spark, d, "pages").select("page_id", F.lit("600000").alias("security_code"), F.lit("web").alias("source_id"), doc.gate(code, html).alias("access_status"),
        (k != 0).alias("matched"), "url", F.sha2("html", 256).alias("sha256"), F.lit("FACT_DIRECT").alias("status_on_success"),
        F.concat(F.lit("q"), F.col("page_id").cast("string")).alias("query"), F.lit("").alias("error"))
    return r.document_status(rows).select("page_id", "status", "access_status", (F.col("minimum_human_action") != "").alias("acts"), "document_id")


@query("agg13_conservation", """SELECT user_id AS batch, count(*) AS requested, count(*) FILTER (event_type = 'click') AS success,
    count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'view') AS deferred,
  count(*) = count(*) FILTER (event_type IN ('click', 'error', 'view')) AS conserved FROM events GROUP BY 1""")
def agg13(spark, d):
    t = F.col("event_type")
    status = F.when(t == "click", "SUCCESS").when(t == "error", "FAILED").when(t == "view", "DEFERRED").otherwise("LOST")
    return r.conservation(src.table(spark, d, "events").select(F.col("user_id").alias("batch"), status.alias("status")))


@query("agg14_flag_counts",
    "SELECT CAST(ts AS DATE) AS report_date, event_type AS flag, count(*) AS n FROM events GROUP BY 1, 2 UNION ALL SELECT CAST(ts AS DATE), 'large', count(*) FROM events WHERE value > 50 GROUP BY 1")
def agg14(spark, d):
    flags = F.array_compact(F.array("event_type", F.when(F.col("value") > 50, "large")))
    return r.flag_counts(src.table(spark, d, "events").select(F.col("ts").cast("date").alias("report_date"), flags.alias("flags")))


@query("flt13_with_evidence",
    "SELECT c_custkey AS observation_id FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R' AND l_quantity > 49)")
def flt13(spark, d):
    lineage = src.table(spark, d, "orders").select(F.col("o_custkey").alias("observation_id"), F.col("o_orderkey").alias("source_fact_id"))
    sources = src.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "source_fact_id")
    return r.with_evidence(src.table(spark, d, "customer").select(F.col("c_custkey").alias("observation_id")), lineage, sources,
        (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49))


@query("set3_differences",
    "SELECT c_custkey AS id, 'WITHOUT_ORDER' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def set3(spark, d):
    c, o = src.table(spark, d, "customer").select(F.col("c_custkey").alias("id")), src.table(spark, d,
        "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("id")).distinct()
    return c.exceptAll(o).withColumn("kind", F.lit("WITHOUT_ORDER")).unionByName(o.exceptAll(c).withColumn("kind", F.lit("UNKNOWN")))


ENDS = [datetime.date(1999, 12, 31), datetime.date(2000, 12, 31)]


@query("snk7_period_matrix", src.sql("""SELECT security_code, field_key, max(value_num) FILTER (report_date = DATE '1999-12-31') AS "1999-12-31",
    max(value_num) FILTER (report_date = DATE '2000-12-31') AS "2000-12-31" FROM facts_cum GROUP BY 1, 2"""))
def snk7(spark, d):
    return sinks.period_matrix(src.facts_cum(spark, d), ENDS)
