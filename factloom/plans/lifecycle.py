"""Queries over what report dates are for a security and over derived official facts, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import derived, lifecycle
from factloom.operators import reconcile as rec
from factloom.plans.reconcile import OFFICIAL, compared
from factloom.sources import facts as src

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


def listing_facts(spark, d):
    """Dates of a supplier's listing in three families, one of them as a number, and one of its delisting; a fourth of them have none."""
    k, b = F.col("s_suppkey") % 4, F.date_add(F.lit("1995-02-15").cast("date"), (F.col("s_suppkey") * 37 % 1500).cast("int"))
    fact = lambda family, key, date, text=True: F.struct(
        F.lit(family).alias("family"), F.lit(key).alias("field_key"), (F.date_format(date, "yyyy年M月d日") if text else F.lit("")).alias("value_text"),
        (F.lit(None) if text else F.date_format(date, "yyyyMMdd")).cast("double").alias("value_num"))
    first = F.when(k == 0, fact("RPT_F10_ORG_BASICINFO", "Listing-Date", b))
    second = F.when(k <= 1, fact("RPT_PCF10_ORG_ISSUEINFO", "LIST_DATE", F.date_sub(b, 100)))
    third = F.when(k <= 2, fact("RPT_F10_FINANCE_GBALANCE", "A_LIST_DATE", F.date_sub(b, 200), False))
    gone = fact("RPT_F10_ORG_BASICINFO", "DELIST_DATE", F.date_sub(b, 300))
    rows = src.table(spark, d, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("security_code"), F.explode(F.array_compact(F.array(first, second, third, gone))).alias("x"))
    return rows.select("security_code", "x.*")


LISTED = """ls AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS security_code, CASE s_suppkey % 4 WHEN 0 THEN b WHEN 1 THEN b - 100 WHEN 2 THEN b - 200 END AS listed,
  CASE s_suppkey % 4 WHEN 0 THEN 'EASTMONEY:RPT_F10_ORG_BASICINFO:Listing-Date' WHEN 1 THEN 'EASTMONEY:RPT_PCF10_ORG_ISSUEINFO:LIST_DATE'
    WHEN 2 THEN 'EASTMONEY:RPT_F10_FINANCE_GBALANCE:A_LIST_DATE' END AS listing_date_source
  FROM (SELECT s_suppkey, DATE '1995-02-15' + CAST(s_suppkey * 37 % 1500 AS INT) AS b FROM supplier)),
"""
# Reports of every date before 2001 but of one quarter; some only summaries, from some of which nothing came.
STATES = LISTED + """q0 AS (SELECT DISTINCT c.security_code, report_date, ls.listed, listing_date_source, CAST(c.security_code AS INT) % 3 AS k, quarter(report_date) AS q,
    year(report_date) < 2001 AND NOT (year(report_date) = 1999 AND quarter(report_date) = 2) AS there, coalesce(report_date < ls.listed, false) AS before
  FROM facts_cum c LEFT JOIN ls USING (security_code)),
st AS (SELECT *, there AND k = 0 AND q = 3 AS summary, there AND k = 1 AND q = 1 AS zero, max(report_date) FILTER (there) OVER (PARTITION BY security_code) AS latest,
    coalesce(report_date = min(report_date) FILTER (NOT before) OVER (PARTITION BY security_code) AND year(report_date) = year(listed), false) AS transition FROM q0)
"""


def states(spark, d, sold=None):
    asked = src.facts_cum(spark, d, sold).select("security_code", "report_date").distinct()
    k, q = F.col("security_code").cast("int") % 3, F.quarter("report_date")
    there = asked.filter("year(report_date) < 2001 and not (year(report_date) = 1999 and quarter(report_date) = 2)")
    documents = there.select("security_code", "report_date", F.when((k == 0) & (q == 3), "SUMMARY_ONLY").otherwise("FULL_STATEMENTS").alias("scope"),
        F.when((k == 1) & (q == 1), 0).otherwise(9).alias("extracted"))
    return lifecycle.period_states(asked, lifecycle.listing_dates(listing_facts(spark, d)), documents)


@query("rec14_listing_dates", "WITH " + LISTED.rstrip().rstrip(",") + " SELECT * FROM ls WHERE listed IS NOT NULL")
def rec14(spark, d):
    return lifecycle.listing_dates(listing_facts(spark, d))


@query("rec15_lifecycle", src.sql(STATES + """SELECT security_code, listed AS listing_date, coalesce(listing_date_source, '') AS listing_date_source, report_date,
  CASE WHEN before THEN 'PRE_LISTING_PERIOD' WHEN transition THEN 'LISTING_TRANSITION_PERIOD' WHEN NOT there AND report_date > latest THEN 'POST_LISTING_PERIOD_NOT_YET_DISCLOSED'
    ELSE 'POST_LISTING_PERIODIC_EXPECTED' END AS period_class,
  CASE WHEN before THEN 'PRE_LISTING_OFFICIAL_SOURCE_NOT_LOADED' WHEN summary THEN 'OFFICIAL_REPORT_SUMMARY_SCOPE_GAP' WHEN zero THEN 'OFFICIAL_DOCUMENT_EXTRACTION_FAILED'
    WHEN there THEN 'AVAILABLE' WHEN NOT transition AND report_date > latest THEN 'OFFICIAL_REPORT_NOT_YET_DISCLOSED' ELSE 'POST_LISTING_OFFICIAL_REPORT_NOT_FOUND' END AS coverage_status,
  there AS official_document_found, CAST(CASE WHEN there AND NOT (k = 1 AND q = 1) THEN 9 ELSE 0 END AS BIGINT) AS extracted_fact_count FROM st"""))
def rec15(spark, d):
    return lifecycle.period_table(states(spark, d))


@query("rec13_relabelled", src.sql(STATES + ", " + OFFICIAL + """, r AS (SELECT cmp.*, status IN ('MISSING_OFFICIAL', 'OFFICIAL_PERIOD_NOT_LOADED') AS gap, before, summary, zero, there,
    latest FROM cmp JOIN st USING (security_code, report_date))
SELECT security_code, report_date, field_key, family, CASE WHEN before AND gap THEN 'PRE_LISTING_OFFICIAL_SOURCE_NOT_LOADED' WHEN summary AND gap THEN 'OFFICIAL_REPORT_SUMMARY_SCOPE_GAP'
  WHEN report_date > latest AND status = 'OFFICIAL_PERIOD_NOT_LOADED' THEN 'OFFICIAL_REPORT_NOT_YET_DISCLOSED' WHEN zero AND gap THEN 'OFFICIAL_DOCUMENT_EXTRACTION_FAILED'
  WHEN NOT before AND NOT there AND coalesce(report_date <= latest, true) AND gap THEN 'POST_LISTING_OFFICIAL_REPORT_NOT_FOUND' ELSE status END AS status FROM r"""))
def rec13(spark, d):
    sold = src.quarters_once(spark, d)
    return lifecycle.relabelled(compared(spark, d, sold), states(spark, d, sold)).select("security_code", "report_date", "field_key", "family", "status")


NAMES = {"REVENUE": "OPERATE_INCOME", "COST": "OPERATE_COST"}


@query("set2_derived_compared", src.sql("""c AS (SELECT security_code, report_date, period_type, CASE field_key WHEN 'REVENUE' THEN 'OPERATE_INCOME' WHEN 'COST' THEN 'OPERATE_COST'
    ELSE field_key END AS field_key, value_num AS a, value_num * CASE WHEN quarter(report_date) = 3 AND CAST(security_code AS INT) % 5 = 0 THEN 1.05 ELSE 1 END AS b FROM facts_cum),
w AS (SELECT security_code, report_date, max(a) FILTER (field_key = 'OPERATE_INCOME') AS ai, max(a) FILTER (field_key = 'OPERATE_COST') AS ac,
  max(b) FILTER (field_key = 'OPERATE_INCOME') AS bi, max(b) FILTER (field_key = 'OPERATE_COST') AS bc FROM c GROUP BY 1, 2),
x AS (SELECT 'direct' AS kind, security_code, report_date, field_key, a, b, 1.0 AS tol FROM c
  UNION ALL SELECT 'quarters', f.security_code, f.report_date, c.field_key, f.value_num, c.b - p.b, 1.0 FROM facts_quarter f JOIN c ON c.security_code = f.security_code
    AND c.report_date = f.report_date AND c.field_key = CASE f.field_key WHEN 'REVENUE' THEN 'OPERATE_INCOME' WHEN 'COST' THEN 'OPERATE_COST' ELSE f.field_key END
    LEFT JOIN c p ON p.security_code = c.security_code AND p.field_key = c.field_key AND year(p.report_date) = year(c.report_date) AND quarter(p.report_date) = quarter(c.report_date) - 1
    WHERE quarter(f.report_date) > 1
  UNION ALL SELECT 'ratios', security_code, report_date, 'XSMLL', (ai - ac) / ai * 100, (bi - bc) / bi * 100, 0.005 FROM w)
SELECT kind, security_code, report_date, field_key, CASE WHEN b IS NULL THEN 'MISSING_OFFICIAL' WHEN abs(a - b) > greatest(tol, greatest(abs(a), abs(b)) * 1e-10) THEN 'MISMATCH'
  WHEN kind <> 'direct' THEN 'DERIVED_MATCH' WHEN a = b THEN 'EXACT_MATCH' ELSE 'WITHIN_ROUNDING' END AS status FROM x
UNION ALL SELECT DISTINCT 'metadata', security_code, report_date, 'REPORT_TYPE', CASE WHEN year(report_date) >= 2001 THEN 'MISSING_OFFICIAL' WHEN CAST(security_code AS INT) % 2 = 0
  THEN 'MISMATCH' ELSE 'TEXT_MATCH_NORMALIZED' END FROM facts_cum WHERE quarter(report_date) = 4"""))
def set2(spark, d):
    """Facts of four kinds against official ones of which only the first is reported; the others are calculated."""
    key = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), F.col("field_key")), F.col("field_key"))
    number, code = F.lit("numeric"), F.col("security_code").cast("int")
    sold = src.quarters_once(spark, d)
    cum = src.facts_cum(spark, d, sold).withColumns({"field_key": key, "statement_type": F.lit("income_statement"), "mode": F.lit("OFFICIAL_DIRECT"), "method": number,
        "absolute": F.lit(1.0), "relative": F.lit(1e-10), "kind": F.lit("direct")})
    off = F.when((F.quarter("report_date") == 3) & (code % 5 == 0), 1.05).otherwise(1.0)
    official = cum.select("security_code", "report_date", "field_key", "period_type", "statement_type", F.lit("consolidated").alias("scope"), (F.col("value_num") * off).alias("value_num"),
        F.lit(None).cast("string").alias("value_text"), "unit", F.lit(0.5).alias("precision_tolerance"), F.lit("r").alias("document_id"))
    year_ends = cum.filter(F.quarter("report_date") == 4).dropDuplicates(["security_code", "report_date"])
    documents = year_ends.filter("year(report_date) < 2001").select("security_code", "report_date", F.date_add("report_date", 90).alias("publish_date"), F.lit("annual").alias("report_kind"),
        F.lit("SSE").alias("source"), F.lit("title").alias("title"), F.lit("").alias("url"))
    every = derived.appended(official, documents).repartition(sold.rdd.getNumPartitions(), "security_code")  # dealt as the facts are
    as_derived = {"mode": F.lit("OFFICIAL_DERIVED")}
    quarters = src.facts_quarter(spark, d, sold).filter(F.quarter("report_date") > 1).withColumns({"field_key": key, "statement_type": F.lit("income_statement"), "method": number,
        "absolute": F.lit(1.0), "relative": F.lit(1e-10), "kind": F.lit("quarters"), **as_derived})
    wide = cum.groupBy("security_code", "report_date", "period_type").pivot("field_key", list(NAMES.values())).agg(F.first("value_num"))
    ratio = wide.withColumn("value_num", (F.col("OPERATE_INCOME") - F.col("OPERATE_COST")) / F.col("OPERATE_INCOME") * 100).drop(*NAMES.values()).withColumns({
        "family": F.lit("RPT_F10_FINANCE_GRATIO"), "field_key": F.lit("XSMLL"), "statement_type": F.lit("financial_ratio"), "method": number, "absolute": F.lit(0.005),
        "relative": F.lit(1e-10), "kind": F.lit("ratios"), "unit": F.lit("%"), **as_derived})
    text = year_ends.withColumns({"field_key": F.lit("REPORT_TYPE"), "statement_type": F.lit("metadata"), "value_num": F.lit(None).cast("double"), "unit": F.lit(""),
        "value_text": F.when(code % 2 == 0, "中报").otherwise("年报"), "mode": F.lit("OFFICIAL_METADATA"), "method": F.lit("text"), "kind": F.lit("metadata")})
    facts = cum.unionByName(quarters).unionByName(text).unionByName(ratio, allowMissingColumns=True)
    return rec.compared(rec.matched(facts, every), every).select("kind", "security_code", "report_date", "field_key", "status")
