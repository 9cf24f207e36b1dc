"""Queries of the scan layer over files' contents made of the given tables, and the same in SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from factloom.operators import normalize as n
from factloom.operators import packages
from factloom.sources import facts as src
from factloom.sources import scans

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


def orders(spark, d):
    return src.table(spark, d, "orders")


def code(c):
    return F.lpad(F.col(c).cast("string"), 6, "0")


@query("src1_fact_scan", src.sql("SELECT security_code, report_date, available_at, field_key, value_num, unit FROM facts_cum"))
def src1(spark, d):
    texts = src.facts_cum(spark, d).select(*[F.col(c).cast("string").alias(c) for c in src.COLUMNS])
    rows = scans.typed(texts.withColumn("security_code", F.regexp_replace("security_code", "^0+", "")))
    return rows.select("security_code", "report_date", "available_at", "field_key", "value_num", "unit")


def envelopes(spark, d):
    """A run envelope in JSON for each customer: its orders as a record group, and as sections of a page."""
    record = F.struct(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("REPORT_DATE"), F.col("o_orderkey").cast("string").alias("INFO_CODE"),
            F.col("o_totalprice").alias("AMOUNT"),
        F.col("o_orderpriority").alias("LEVEL"), F.lit("x").alias("_HIDDEN"),
    )
    of = lambda s: F.collect_list(F.when(F.col("o_orderstatus") == s, record))
    per = orders(spark, d).groupBy("o_custkey").agg(F.collect_list(record).alias("records"), of("F").alias("listed"), of("O").alias("nested"),
        F.count(F.lit(1)).cast("string").alias("n"))
    group = F.struct(F.lit("orders").alias("group_id"), F.lit("Trade").alias("theme"), F.lit("RPT_F10_FINANCE_GINCOME").alias("family"), F.col("records"),
        F.array().cast("array<string>").alias("payloads"))
    page = F.to_json(F.struct("listed", F.struct(F.col("nested").alias("data")).alias("nested"), F.struct(F.col("n").alias("INFO_CODE")).alias("single"),
        F.lit(5).alias("scalar")))
    text = F.to_json(F.struct(F.struct(F.struct(code("o_custkey").alias("code")).alias("security")).alias("metadata"), F.array(group).alias("groups")))
    return per.select("o_custkey", text.alias("value"), page.alias("page"))


@query("src2_group_records", """WITH o AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS c, o_orderkey, strftime(CAST(o_orderdate AS DATE),
    '%Y-%m-%d') AS t, month(CAST(o_orderdate AS DATE)) AS m, o_totalprice AS v FROM orders)
SELECT c AS security_code, 'Trade / RPT_F10_FINANCE_GINCOME' AS dataset, c || '|RPT_F10_FINANCE_GINCOME|' || t || '|' || o_orderkey AS record_key, t AS report_date,
  CASE m WHEN 3 THEN 'Q1' WHEN 6 THEN 'Q2' WHEN 9 THEN 'Q3' WHEN 12 THEN 'FY' ELSE 'OTHER' END AS period_type, k AS field_key,
  CASE k WHEN 'AMOUNT' THEN v WHEN 'INFO_CODE' THEN o_orderkey END::DOUBLE AS value_num
FROM o, (SELECT unnest(['REPORT_DATE', 'INFO_CODE', 'AMOUNT', 'LEVEL']) AS k)""")
def src2(spark, d):
    rows = scans.record_facts(scans.records(scans.groups(envelopes(spark, d))))
    return rows.select("security_code", "dataset", "record_key", "report_date", "period_type", "field_key", "value_num")


@query("nrm2_page_sections", """SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'listed' ELSE 'nested' END AS section, CAST(o_orderkey AS VARCHAR) AS info
    FROM orders WHERE o_orderstatus IN ('F', 'O')
UNION ALL SELECT o_custkey, 'single', CAST(count(*) AS VARCHAR) FROM orders GROUP BY 1""")
def nrm2(spark, d):
    rows = scans.sections(envelopes(spark, d).select("o_custkey", F.parse_json("page").alias("payload")))
    return rows.select("o_custkey", "section", F.try_variant_get("record", "$.INFO_CODE", "string").alias("info"))


@query("nrm17_names", """WITH r AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS c, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 3
    ELSE 20 END AS rank, o_orderpriority AS name FROM orders WHERE o_totalprice > 50000),
g AS (SELECT c, rank, name, count(*) AS k FROM r GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY rank, k DESC, name) AS n FROM g)
SELECT c AS security_code, name FROM w WHERE n = 1""")
def nrm17(spark, d):
    # peers have the codes after the customer's own, so that they are others whatever customers there are
    after = lambda n: F.lpad(((code("o_custkey").cast("int") + n) % 1_000_000).cast("string"), 6, "0")
    own = F.when(F.col("o_totalprice") > 50000, F.concat(code("o_custkey"), F.lit(".SZ"))).otherwise(F.concat(F.lit("SH"), after(1)))
    body = F.struct(own.alias("SECUCODE"), F.col("o_orderpriority").alias("SECURITY_NAME"))
    peer = F.struct(F.concat(F.lit("1."), after(2)).alias("f57"), F.lit("a peer").alias("f58"))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.struct(body.alias("own"), peer.alias("peer")))).otherwise(F.to_json(F.struct("o_orderkey",
        own.alias("SECUCODE"), F.col("o_orderpriority").alias("SECURITY_NAME"), peer.alias("peer"))))
    family = F.when(F.col("o_orderstatus") == "F", "RPT_F10_ORG_BASICINFO").when(F.col("o_orderstatus") == "O", "PageAjax").otherwise("RPT_X")
    rows = orders(spark, d).select(code("o_custkey").alias("security_code"), family.alias("family"), F.parse_json(text).alias("record"))
    return scans.names(rows, n.NAME_KEYS)


@query("src6_document_index", """SELECT CAST(page_id AS VARCHAR) AS document_id, url AS source_url, 'f' || page_id AS file_name, 1::BIGINT AS links,
    coalesce(length(html), 0) > 500 AS saved FROM pages""")
def src6(spark, d):
    own = [F.col("page_id").cast("string").alias("document_id"), F.col("url").alias("source_url"),
        (F.coalesce(F.length("html"), F.lit(0)) > 500).alias("raw_original_binary_saved")]
    files, links = F.array(F.struct(F.concat(F.lit("f"), "page_id").alias("file_name"), F.col("url").alias("source_url"))), F.array("url")
    nested = F.to_json(F.struct(*own, files.alias("attachments"), links.alias("links")))
    flat = F.to_json(F.struct(*own, F.to_json(files).alias("attachments"), F.to_json(links).alias("links")))
    lines = src.table(spark, d, "pages").select(F.when(F.col("page_id") % 2 == 0, nested).otherwise(flat).alias("value"))
    rows = scans.document_index(lines)
    return rows.select("document_id", "source_url", F.get("attachments", 0)["file_name"].alias("file_name"), F.size("links").cast("long").alias("links"),
        F.col("raw_original_binary_saved").alias("saved"))


@query("fin18_request_violations", """WITH c AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, ['SSE', 'SZSE', 'BSE',
    'NYSE'][c_nationkey % 4 + 1] AS x, c_acctbal AS b, c_mktsegment AS s FROM customer)
SELECT x || '.' || code AS security_id, r AS rule FROM c, (SELECT unnest(['EXCHANGE_MISMATCH', 'ST_STANDARD_PATH', 'CUTOFF_MISMATCH', 'START_AFTER_CUTOFF',
    'REQUEST_STATUS_INVALID', 'AVAILABLE_AT_NOT_REQUIRED']) AS r)
WHERE CASE r WHEN 'EXCHANGE_MISMATCH' THEN x = 'NYSE' WHEN 'ST_STANDARD_PATH' THEN b < 0 WHEN 'REQUEST_STATUS_INVALID' THEN s = 'MACHINERY'
    WHEN 'AVAILABLE_AT_NOT_REQUIRED' THEN s = 'FURNITURE' ELSE s = 'BUILDING' END""")
def fin18(spark, d):
    exchange = F.element_at(F.array(*map(F.lit, ("SSE", "SZSE", "BSE", "NYSE"))), (F.col("c_nationkey") % 4 + 1).cast("int"))
    segment = F.col("c_mktsegment")
    line = F.concat_ws(
        ",", F.lit("B001"), F.concat_ws(".", exchange, code("c_custkey")), code("c_custkey"),
            F.concat(F.when(F.col("c_acctbal") < 0, "*ST").otherwise(""), "c_name"), exchange,
        F.lit("2020-01-01"), F.lit("2020-01-01"), F.when(segment == "BUILDING", "2024-13-01").otherwise("2024-12-31"),
            F.when(segment == "FURNITURE", "false").otherwise("true"),
        F.when(segment == "MACHINERY", "DONE").otherwise("PENDING"),
    )
    rows = scans.requests(src.table(spark, d, "customer").select(line.alias("value")))
    return packages.request_violations(rows, F.lit(datetime.date(2024, 12, 31)), 1 << 40)
