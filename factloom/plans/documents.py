"""Queries of report texts, profiles, matching details and views, and the same in SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from factloom.operators import documents as doc
from factloom.operators import reconcile as rec
from factloom.operators import research
from factloom.sources import facts as src
from factloom.sources import sinks

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


def lines(spark, d):
    """Orders as lines of their customer's report, a page a year; priorities stand for headings."""
    priority = F.col("o_orderpriority")
    line = F.when(priority == "1-URGENT", "1、合并资产负债表(续)").when(priority == "2-HIGH", "母公司 利润表").when((priority == "3-MEDIUM") & (F.col("o_totalprice") < 50000),
        "财务报表附注").otherwise(priority)
    return src.table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.year("o_orderdate").alias("page"),
        F.col("o_orderkey").alias("line_no"), line.alias("line"))


LINES = """l AS (SELECT o_custkey AS document_id, year(CAST(o_orderdate AS DATE)) AS page, o_orderkey AS line_no, CASE
    WHEN o_orderpriority = '1-URGENT' THEN 'balance_sheet/consolidated' WHEN o_orderpriority = '2-HIGH' THEN 'income_statement/parent'
  WHEN o_orderpriority = '3-MEDIUM' AND o_totalprice < 50000 THEN '/' END AS h FROM orders)"""


@query("doc12_in_statements", f"""WITH {LINES}, m AS (SELECT *, last_value(CASE
    WHEN h IS NOT NULL THEN h || '@' || page END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page, line_no) AS v FROM l),
k AS (SELECT *, CASE WHEN page <= CAST(split_part(v, '@', 2) AS INT) + 5 THEN split_part(v, '@', 1) END AS x FROM m)
SELECT document_id, line_no, nullif(split_part(x, '/', 1), '') AS statement, nullif(split_part(x, '/', 2), '') AS scope FROM k""")
def doc12(spark, d):
    return doc.in_statements(lines(spark, d)).select("document_id", "line_no", "statement", "scope")


@query("doc13_document_scope",
    f"WITH {LINES} SELECT document_id, CASE WHEN count(*) FILTER (h LIKE '%e%') > 0 THEN 'FULL_STATEMENTS' ELSE 'UNRESOLVED' END AS scope FROM l GROUP BY 1")
def doc13(spark, d):
    return doc.document_scope(lines(spark, d))


@query("doc14_signed", """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN abs(c_acctbal) WHEN 'MACHINERY' THEN CASE
    WHEN c_nationkey % 2 = 0 THEN c_acctbal ELSE abs(c_acctbal) END WHEN 'FURNITURE' THEN abs(c_acctbal) ELSE c_acctbal END AS value FROM customer""")
def doc14(spark, d):
    s = F.col("c_mktsegment")
    key = F.when(s == "BUILDING", "OPERATE_COST").when(s == "MACHINERY", "FINANCE_EXPENSE").when(s == "FURNITURE", "PAY_STAFF_CASH").otherwise("NETPROFIT")
    return src.table(spark, d, "customer").select("c_custkey", doc.signed(key, F.col("c_acctbal"),
        F.when(F.col("c_nationkey") % 2 == 0, "sse").otherwise("CNINFO")).alias("value"))


@query("doc15_summary_amounts", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'A' OR l_linestatus = 'F' THEN CAST(l_partkey + 100 AS DOUBLE)
    WHEN l_linenumber > 3 THEN CAST(l_orderkey + 100 AS DOUBLE)
  WHEN l_linenumber = 2 THEN CAST(l_suppkey + 100 AS DOUBLE) ELSE CAST(l_partkey + 100 AS DOUBLE) END AS value FROM lineitem""")
def doc15(spark, d):
    k = F.col("l_linenumber")
    text = F.concat_ws(" ", F.lit("营业收入"), F.col("l_partkey") + 100, F.when(k == 2, "不适用"), F.col("l_suppkey") + 100, F.col("l_orderkey") + 100,
        F.when(k > 3, F.lit("12.5")))
    kind, semantics = F.when(F.col("l_returnflag") == "A", "q3").otherwise("annual"), F.when(F.col("l_linestatus") == "F", "point_in_time").otherwise("flow")
    return src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", doc.summary_amount(text, kind, semantics)["value"].alias("value"))


@query("doc8_profiles",
    """WITH f AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS c, o_orderkey AS n, o_orderstatus AS s, o_orderpriority AS v FROM orders)
SELECT c AS security_code, coalesce(min_by(v, n) FILTER (s = 'F'), min_by(v, n) FILTER (s = 'O')) AS name_abbr, 'https://' || min_by(v, n) FILTER (s = 'P') AS website FROM f GROUP BY 1""")
def doc8(spark, d):
    s = F.col("o_orderstatus")
    key = F.when(s == "F", "SECURITY_NAME_ABBR").when(s == "O", "SECURITY_NAME").otherwise("WEB_SITE")
    rows = src.table(spark, d, "orders").select(F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("security_code"), F.col("o_orderkey").alias("ordinal"),
        key.alias("field_key"), F.col("o_orderpriority").alias("value_text"))
    return doc.profiles(rows).select("security_code", "name_abbr", "website")


PARSED_SQL = r"""WITH t AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
  '<script\b.*?</script\s*>', '', 'gis'), '<style\b.*?</style\s*>', '', 'gis'), '<noscript\b.*?</noscript\s*>', '', 'gis'), '<svg\b.*?</svg\s*>', '', 'gis'), '<!--.*?-->', '', 'gs'), '<!doctype[^>]*>', '', 'gi') AS t FROM pages),
b AS (SELECT page_id, html, regexp_replace(regexp_replace(t, '</?(?:p|div|br|li|tr|h[1-4]|section|article)(?:\s[^>]*)?/?>', chr(10), 'gi'), '<[^>]+>', '', 'g') AS t FROM t),
u AS (SELECT page_id, UNESCAPE(t) AS t, UNESCAPE(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')) AS title FROM b),
w AS (SELECT page_id, TIDY(t) AS t, nullif(TIDY(title), '') AS title FROM u)
SELECT page_id, title, sha256(t) AS text_sha256, CASE WHEN length(t) >= 40 THEN 'good' WHEN t <> '' THEN 'partial' ELSE 'failed' END AS quality FROM w"""


def _spelled(sql: str) -> str:
    """The SQL with the two text functions written out."""
    import re

    def unescape(m):
        out = m[1]
        for name, value in doc.ENTITIES:
            out = f"replace({out}, '{name}', '{value.replace(chr(39), chr(39) * 2)}')"
        return out

    tidy = r"trim(regexp_replace(regexp_replace(regexp_replace(translate(\1, chr(160) || chr(12288) || chr(13), '  ' || chr(10)), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n+', chr(10), 'g'), chr(10) || ' ')"
    return re.sub(r"TIDY\((\w+)\)", tidy, re.sub(r"UNESCAPE\((\w+|regexp_extract\(.*?, 'is'\))\)", unescape, sql))


@query("doc1_parsed_pages", _spelled(PARSED_SQL))
def doc1(spark, d):
    return doc.parsed(src.table(spark, d, "pages")).select("page_id", "title", "text_sha256", "quality")


@query("doc2_attachments", r"""SELECT page_id, list_filter([url || '/a.pdf', url || '/b', url || '/c.XLSX?x=1'], lambda u: regexp_matches(u,
    '(?i)\.(pdf|docx?|xlsx?|zip)($|[?#])')) AS attachments FROM pages WHERE url IS NOT NULL""")
def doc2(spark, d):
    pages = src.table(spark, d, "pages").filter("url is not null")
    html = F.concat(F.lit("<a href='"), "url", F.lit("/a.pdf'>x</a> <a class=y href=\""), "url", F.lit("/b\">y</a> <A HREF='"), "url",
        F.lit("/c.XLSX?x=1'>z</A>"))
    return pages.select("page_id", doc.attachments(doc.links(html, F.col("url"))).alias("attachments"))


@query("rec1_prepared_primary",
    src.sql("SELECT security_code, family, report_date, field_key, period_type, CASE family WHEN 'RPT_F10_FINANCE_GBALANCE' THEN 'balance_sheet' WHEN 'RPT_F10_FINANCE_DUPONT' THEN 'dupont' ELSE 'income_statement' END AS statement_type, 'consolidated' AS scope, unit AS normalized_unit FROM facts"))
def rec1(spark, d):
    rows = src.facts(spark, d).withColumn("period_type", F.when(F.col("period_type") == "Q3C", "三季报").when(F.col("period_type") == "FY",
        "年度").otherwise(F.col("period_type")))
    return rec.prepared_primary(rows).select("security_code", "family", "report_date", "field_key", "period_type", "statement_type", "scope", "normalized_unit")


def official(spark, d):
    code = F.col("security_code").cast("int")
    status = F.when(code % 5 == 0, "PARSE_SUSPECT").when(code % 5 == 1, None).otherwise("FACT_DIRECT")
    statement = F.when(F.col("field_key") == "QTY", "balance_sheet").when(F.col("field_key") == "COST", "income_statement").otherwise("notes")
    return src.facts_point(spark, d).select(
        "security_code", "report_date", "field_key", F.col("value_num").alias("value"), status.alias("source_status"), statement.alias("statement_type"),
            F.col("field_name_cn").alias("field_name_report"),
        F.col("record_key").alias("source_document"), F.lit(None).cast("string").alias("source_url"), F.lit(5.0).alias("precision_tolerance"),
    )


@query("rec2_prepared_official",
    src.sql("""SELECT security_code, report_date, field_key, CASE field_key WHEN 'QTY' THEN '官方披露/资产负债表' WHEN 'COST' THEN '官方披露/利润表' ELSE '官方披露' END AS theme,
  security_code || '|' || CAST(report_date AS VARCHAR) || '|' || CASE field_key WHEN 'QTY' THEN 'balance_sheet' WHEN 'COST' THEN 'income_statement'
    ELSE 'notes' END || '|' || field_key AS record_key, period_type,
  CASE field_key WHEN 'QTY' THEN 'point_in_time' WHEN 'COST' THEN 'flow' ELSE 'event' END AS data_semantics, value_num FROM facts_point WHERE CAST(security_code AS INT) % 5 <> 0"""))
def rec2(spark, d):
    return rec.prepared_official(official(spark, d)).select("security_code", "report_date", "field_key", "theme", "record_key", "period_type", "data_semantics",
        "value_num")


@query("rec6_overridden", src.sql("""SELECT DISTINCT family, field_key, CASE field_key WHEN 'QTY' THEN 'text' ELSE 'numeric' END AS method, CASE field_key
    WHEN 'QTY' THEN 0.5 WHEN 'COST' THEN 7.0 ELSE 1.0 END::DOUBLE AS absolute FROM facts"""))
def rec6(spark, d):
    overrides = spark.createDataFrame([("QTY", "text", None, None), ("COST", None, 7.0, None)],
        "field_key string, method string, absolute double, relative double")
    return rec.overridden(rec.registry(src.facts(spark, d)), overrides).select("family", "field_key", "method", "absolute")


@query("rec12_comparison_keys",
    src.sql("SELECT security_code || '|' || CAST(report_date AS VARCHAR) || '|' || CAST(event_date AS VARCHAR) || '|' || period_type || '|' || family || '|main|' || record_key || '|' || field_key AS comparison_key, value_num FROM facts_cum"))
def rec12(spark, d):
    return src.facts_cum(spark, d).select(rec.comparison_key().alias("comparison_key"), "value_num")


@query("rec16_date_sets", src.sql("""r AS (SELECT DISTINCT security_code, report_date, CAST(security_code AS INT) % 3 AS k FROM facts_cum),
s AS (SELECT *, CASE WHEN year(report_date) < 2001 AND NOT (year(report_date) = 1999 AND quarter(report_date) = 2) THEN CASE WHEN k = 0
    AND quarter(report_date) = 3 THEN 'SUMMARY_ONLY' WHEN k = 1 AND quarter(report_date) = 1 THEN 'ZERO_EXTRACTION' ELSE 'LOADED' END END AS t FROM r)
SELECT security_code, report_date, coalesce(t, CASE WHEN report_date > max(report_date) FILTER (t IS NOT NULL) OVER (PARTITION BY security_code) THEN 'PENDING'
    ELSE 'MISSING' END) AS state FROM s"""))
def rec16(spark, d):
    asked = src.facts_cum(spark, d).select("security_code", "report_date").distinct()
    k, q = F.col("security_code").cast("int") % 3, F.quarter("report_date")
    there = asked.filter("year(report_date) < 2001 and not (year(report_date) = 1999 and quarter(report_date) = 2)")
    return rec.date_sets(asked, there.select("security_code", "report_date", F.when((k == 0) & (q == 3),
        "SUMMARY_ONLY").otherwise("FULL_STATEMENTS").alias("scope"), F.when((k == 1) & (q == 1), 0).otherwise(9).alias("extracted")))


@query("rec17_source_unavailable", src.sql("""g AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS c FROM supplier WHERE s_acctbal < 0)
SELECT security_code, report_date, field_key, CASE WHEN field_key = 'COST' THEN CASE WHEN c IS NULL THEN 'MISSING_OFFICIAL'
    ELSE 'OFFICIAL_SOURCE_UNAVAILABLE' END ELSE 'MISMATCH' END AS status,
  CASE WHEN field_key = 'COST' AND c IS NOT NULL THEN '官方披露来源不可用' END AS notes FROM facts_cum LEFT JOIN g ON security_code = c"""))
def rec17(spark, d):
    gone = src.table(spark, d, "supplier").filter("s_acctbal < 0").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("security_code"),
        F.lit("").alias("message"))
    rows = src.facts_cum(spark, d).withColumn("status", F.when(F.col("field_key") == "COST", "MISSING_OFFICIAL").otherwise("MISMATCH"))
    return rec.source_unavailable(rows, gone).select("security_code", "report_date", "field_key", "status", "notes")


@query("rec18_acceptance", """WITH s AS (SELECT c_custkey AS k, count(*) FILTER (o_orderstatus = 'P') AS conflicts,
    count(*) FILTER (o_orderstatus = 'O') AS unresolved, count(*) AS n, min(c_acctbal) AS b FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT k AS security_code, CASE WHEN conflicts > 0 THEN 'FAIL_SOURCE_CONFLICT' WHEN n < 2 THEN 'FAIL_CLASSIFICATION_COVERAGE'
    WHEN b < 0 THEN 'PARTIAL_OFFICIAL_SOURCE_UNAVAILABLE' WHEN unresolved > 0 THEN 'PASS_WITH_COVERAGE_GAPS' ELSE 'PASS' END AS acceptance_status,
  conflicts > 0 AS manual_review_required FROM s""")
def rec18(spark, d):
    c, o = src.table(spark, d, "customer"), src.table(spark, d, "orders")
    g = c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_custkey").alias("security_code")).agg(
        F.count_if(F.col("o_orderstatus") == "P").alias("conflicts"), F.count_if(F.col("o_orderstatus") == "O").alias("unresolved"),
            F.count(F.lit(1)).alias("n"), F.min("c_acctbal").alias("b"))
    rows = g.withColumns({"classification_coverage": F.when(F.col("n") < 2, 0.5).otherwise(1.0), "source_unavailable": F.col("b") < 0,
        "parse_suspect_count": F.lit(0)})
    return rec.acceptance(rows).select("security_code", "acceptance_status", "manual_review_required")


@query("rec19_thin_slice", src.sql("""a AS (SELECT security_code, report_date, value_num FROM facts_cum WHERE field_key = 'QTY'), p AS (SELECT security_code,
    report_date, value_num AS b, CAST(security_code AS INT) % 5 AS k FROM facts_point WHERE field_key = 'QTY'),
o AS (SELECT * FROM p WHERE k <> 0)
SELECT a.security_code, a.report_date, 'QTY' AS target, value_num, b AS official_value, CASE WHEN b IS NULL THEN 'MISSING_OFFICIAL'
    WHEN abs(value_num - b) <= 1 THEN 'EXACT_MATCH' WHEN abs(value_num - b) <= 5 THEN 'WITHIN_ROUNDING' ELSE 'MISMATCH' END AS status
FROM a LEFT JOIN o USING (security_code, report_date) WHERE (a.security_code, a.report_date) IN (SELECT (security_code, report_date) FROM p)"""))
def rec19(spark, d):
    targets = spark.createDataFrame([("QTY", src.DECOY_FAMILY, 1, "QTY", 0), ("QTY", src.CUMULATIVE_FAMILY, 0, "QTY", 0)],
        "target string, family string, family_rank int, key string, key_rank int")
    facts = src.facts_cum(spark, d).unionByName(src.facts_decoy(spark, d))
    return rec.thin_slice(facts, official(spark, d), targets).select("security_code", "report_date", "target", "value_num", "official_value", "status")


@query("rec20_dynamic_targets", src.sql("""SELECT DISTINCT family, field_key, CASE WHEN field_key = 'COST' AND family = 'RPT_F10_FINANCE_GINCOME' THEN 'Costs'
    ELSE field_name_cn END AS label,
  CASE WHEN field_key = 'COST' AND family = 'RPT_F10_FINANCE_GINCOME' THEN 'Costs,Operating cost' ELSE field_name_cn END AS aliases, CASE family
    WHEN 'RPT_F10_FINANCE_GINCOME' THEN 'income_statement' ELSE 'balance_sheet' END AS statement_type,
  CASE family WHEN 'RPT_F10_FINANCE_GINCOME' THEN 'flow' ELSE 'point_in_time' END AS semantics FROM facts WHERE family IN ('RPT_F10_FINANCE_GINCOME', 'RPT_F10_FINANCE_GBALANCE')"""))
def rec20(spark, d):
    defaults = spark.createDataFrame([(src.CUMULATIVE_FAMILY, "COST", "Costs", ["Costs"], "income_statement", "flow")],
        "family string, field_key string, label string, aliases array<string>, statement_type string, semantics string")
    return rec.dynamic_targets(src.facts(spark, d), defaults).withColumn("aliases", F.array_join("aliases", ","))


@query("flt12_reconciliation_search",
    src.sql("SELECT security_code, family, report_date, field_key FROM facts WHERE (contains(lower(field_name_cn), 'sold') OR contains(lower(family), 'sold')) AND report_date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' AND period_type = 'FY'"))
def flt12(spark, d):
    rows = src.facts(spark, d).withColumn("status", F.col("period_type"))
    return rec.searched(rows, " Sold", status="FY", start=datetime.date(1995, 1, 1), end=datetime.date(1997, 12, 31)).select("security_code", "family",
        "report_date", "field_key")


@query("flt12_search_page", src.sql("""f AS (SELECT security_code, family, report_date, field_key, count(*) OVER () AS total FROM facts WHERE contains(lower(field_name_cn), 'sold') AND period_type = 'FY')
SELECT * FROM f ORDER BY report_date, security_code, family, field_key LIMIT 25 OFFSET 50"""))
def flt12_page(spark, d):
    """The third page of a search, and how much there is in all."""
    rows = src.facts(spark, d).withColumn("status", F.col("period_type"))
    found = rec.searched(rows, " Sold", status="FY").select("security_code", "family", "report_date", "field_key")
    return rec.search_page(found, ["report_date"], 3, 25)


@query("snk5_views", """WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'MISMATCH' WHEN 'O' THEN 'SOURCE_SPECIFIC'
    ELSE 'EXACT_MATCH' END AS status, o_orderpriority AS mode FROM orders)
SELECT 'coverage_summary' AS view, mode AS kind, status, count(*) AS n FROM r GROUP BY 2, 3 UNION ALL SELECT 'true_conflicts', mode, status, count(*) FROM r
    WHERE status = 'MISMATCH' GROUP BY 2, 3
UNION ALL SELECT 'not_in_official_scope', mode, status, count(*) FROM r WHERE status = 'SOURCE_SPECIFIC' GROUP BY 2, 3""")
def snk5(spark, d):
    s = F.col("o_orderstatus")
    rows = src.table(spark, d, "orders").select("o_orderkey", F.when(s == "F", "MISMATCH").when(s == "O",
        "SOURCE_SPECIFIC").otherwise("EXACT_MATCH").alias("status"), F.col("o_orderpriority").alias("mode"))
    views = sinks.reconciliation_views(rows)
    out = views["coverage_summary"].select(F.lit("coverage_summary").alias("view"), F.col("mode").alias("kind"), "status", F.col("fact_count").alias("n"))
    for name in ("true_conflicts", "not_in_official_scope"):
        out = out.unionByName(views[name].groupBy(F.lit(name).alias("view"), F.col("mode").alias("kind"), "status").agg(F.count(F.lit(1)).alias("n")))
    return out


@query("snk6_observation_views",
    "SELECT 'resolved_canonical_facts' AS view, c_custkey AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') UNION ALL SELECT 'canonical_conflicts', c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE'")
def snk6(spark, d):
    s = F.col("c_mktsegment")
    status = F.when(s == "BUILDING", "VERIFIED_MULTI_SOURCE").when(s == "MACHINERY", "SINGLE_SOURCE").when(s == "FURNITURE",
        "SOURCE_CONFLICT").otherwise("UNRESOLVED")
    views = sinks.observation_views(src.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), status.alias("status")))
    return views["resolved_canonical_facts"].select(F.lit("resolved_canonical_facts").alias("view"),
        "id").unionByName(views["canonical_conflicts"].select(F.lit("canonical_conflicts").alias("view"), "id"))


@query("snk8_sections_by_name", """WITH k AS (SELECT l_suppkey AS family, l_linenumber AS p, CASE WHEN l_linenumber = 1 THEN CASE WHEN l_suppkey % 3 = 0 THEN 'CCE_ADDNOTE' ELSE 'K1' END
    WHEN l_linenumber = 2 THEN 'NETPROFIT' WHEN l_linenumber = 3 THEN 'MY_NOTES' WHEN l_linenumber = 4 THEN CASE WHEN l_suppkey % 3 = 1 THEN 'CCE_ADDNOTE' ELSE 'DEFER_TAX' END ELSE 'A_QOQ' END AS key
    FROM lineitem GROUP BY 1, 2, 3),
e AS (SELECT family, key, min(p) AS p FROM k GROUP BY 1, 2),
o AS (SELECT *, min(p) FILTER (key = 'NETPROFIT') OVER (PARTITION BY family) AS a, min(p) FILTER (key = 'CCE_ADDNOTE') OVER (PARTITION BY family) AS z FROM e)
SELECT family, key, CASE WHEN key = 'A_QOQ' THEN 'qoq' WHEN a <= z THEN CASE WHEN p BETWEEN a AND z THEN 'supplement' ELSE 'primary' END
  WHEN key IN ('NETPROFIT', 'DEFER_TAX', 'CCE_ADDNOTE', 'MY_NOTES') THEN 'supplement' ELSE 'primary' END AS section FROM o""")
def snk8_by_name(spark, d):
    """Statements with both ends in order, in the wrong order, and with one of them."""
    k, s = F.col("l_linenumber"), F.col("l_suppkey") % 3
    key = (
        F.when(k == 1, F.when(s == 0, "CCE_ADDNOTE").otherwise("K1")).when(k == 2, "NETPROFIT").when(k == 3, "MY_NOTES")
        .when(k == 4, F.when(s == 1, "CCE_ADDNOTE").otherwise("DEFER_TAX")).otherwise("A_QOQ")
    )
    return research.cash_flow_sections(src.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("family"), key.alias("key"), k.alias("position")))


@query("snk8_cash_flow_sections", """WITH k AS (SELECT l_suppkey AS family, CASE l_linenumber WHEN 2 THEN 'NETPROFIT' WHEN 4 THEN 'CCE_ADDNOTE'
    WHEN 6 THEN 'A_YOY' WHEN 7 THEN 'A_QOQ' ELSE 'K' || l_linenumber END AS key, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2),
e AS (SELECT *, min(p) FILTER (key = 'NETPROFIT') OVER (PARTITION BY family) AS a, min(p) FILTER (key = 'CCE_ADDNOTE') OVER (PARTITION BY family) AS z FROM k)
SELECT family, key, CASE WHEN key = 'A_YOY' THEN 'yoy' WHEN key = 'A_QOQ' THEN 'qoq' WHEN p BETWEEN a AND z THEN 'supplement' ELSE 'primary' END AS section FROM e""")
def snk8(spark, d):
    k = F.col("l_linenumber")
    key = F.when(k == 2, "NETPROFIT").when(k == 4, "CCE_ADDNOTE").when(k == 6, "A_YOY").when(k == 7, "A_QOQ").otherwise(F.concat(F.lit("K"), k))
    return research.cash_flow_sections(src.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("family"), key.alias("key"), k.alias("position")))
