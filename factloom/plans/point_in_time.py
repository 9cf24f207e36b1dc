"""Queries at a cutoff over the derived facts and their report versions, and the same in SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from factloom.operators import point_in_time as p
from factloom.sources import facts as src

QUERIES, SQL = {}, {}
CUTOFF = datetime.date(2000, 10, 1)


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


def cutoff():
    return F.lit(CUTOFF)


def documents(spark, d):
    """An original report of each supplier and year 60 days after its end, and a correction of every fifth supplier's."""
    years = src.facts_cum(spark, d).filter("field_key = 'REVENUE' and month(report_date) = 12").select("security_code", "report_date")
    one = lambda label, days: years.select(
        "security_code", "report_date", F.concat_ws("-", "security_code", F.year("report_date").cast("string"), F.lit(label)).alias("document_id"),
        F.lit(label).alias("version_label"), F.date_add("report_date", days).alias("available_at"),
    )
    return one("original", 60).unionByName(one("corrected", 150).filter(F.col("security_code").cast("int") % 5 == 0))


DOCS = """years AS (SELECT security_code, report_date FROM facts_cum WHERE field_key = 'REVENUE' AND month(report_date) = 12),
docs AS (SELECT security_code, report_date, security_code || '-' || year(report_date) || '-original' AS document_id, 'original' AS version_label,
    CAST(report_date + 60 AS DATE) AS available_at FROM years
  UNION ALL SELECT security_code, report_date, security_code || '-' || year(report_date) || '-corrected', 'corrected', CAST(report_date + 150 AS DATE)
    FROM years WHERE CAST(security_code AS INT) % 5 = 0)
"""


@query("jon6_versions_as_of",
    src.sql(DOCS + """, m AS (SELECT *, available_at <= DATE '2000-04-15' AS known, row_number() OVER (PARTITION BY security_code, report_date
    ORDER BY available_at <= DATE '2000-04-15' DESC, CASE version_label WHEN 'corrected' THEN 3 ELSE 2 END DESC, available_at DESC, document_id DESC) AS n FROM docs),
  l AS (SELECT security_code, report_date, arg_max(document_id, (available_at, document_id)) AS prior FROM m WHERE known AND n > 1 GROUP BY 1, 2)
SELECT security_code, report_date, document_id, CASE WHEN known AND n = 1 THEN 'SELECTED' WHEN known THEN 'ELIGIBLE' ELSE 'BOUNDARY' END AS decision,
  CASE WHEN known AND n = 1 THEN prior END AS supersedes FROM m LEFT JOIN l USING (security_code, report_date)"""))
def jon6(spark, d):
    out = p.versions_as_of(documents(spark, d), F.lit(datetime.date(2000, 4, 15)))
    return out.select("security_code", "report_date", "document_id", "decision", "supersedes")


@query("jon10_missing_periods",
    src.sql(DOCS + "SELECT security_code, report_date FROM docs GROUP BY 1, 2 HAVING count(*) FILTER (available_at <= DATE '2000-04-15') = 0"))
def jon10(spark, d):
    docs = documents(spark, d)
    return p.missing_periods(docs, docs.select("security_code", "report_date").distinct(), F.lit(datetime.date(2000, 4, 15)))


@query("rec24_report_titles", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(year(o_orderdate) + 10 AS VARCHAR) || CASE o_orderkey % 4
    WHEN 0 THEN '-12-31' WHEN 1 THEN '-09-30' ELSE '-06-30' END END AS report_date,
  CASE o_orderkey % 4 WHEN 0 THEN 'annual' WHEN 1 THEN 'q3' WHEN 2 THEN 'half' END AS kind, CASE o_orderkey % 4 WHEN 2 THEN 'corrected' ELSE 'original' END AS version FROM orders""")
def rec24(spark, d):
    year = (F.year("o_orderdate") + 10).cast("string")
    tail = F.element_at(F.array(*map(F.lit, ["年年度报告", "年第三季度报告全文", "年半年度报告（修订版）", "年年度报告摘要"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    title = F.concat(F.lit("某公司 "), year, tail)
    return src.table(spark, d, "orders").select("o_orderkey", p.report_identity(title).alias("i"), p.version_label(title).alias("version")).select("o_orderkey",
        "i.*", "version")


def finance_facts(spark, d):
    """Running totals with restatements, stocks, and single quarters of even suppliers, under the keys that the tables read."""
    key = F.when(F.col("field_key") == "REVENUE", "OPERATE_INCOME").when(F.col("field_key") == "COST", "OPERATE_COST").otherwise("INVENTORY")
    single = F.col("family") == src.QUARTER_FAMILY
    rows = src.finance(spark, d).filter(~single | (F.col("security_code").cast("int") % 2 == 0))
    rows = rows.withColumns({"period_basis": F.when(single, "STANDALONE").otherwise("CUMULATIVE"), "field_key": key, "source_priority": F.lit(None).cast("int")})
    return rows.withColumn("source_status", F.when((F.col("security_code").cast("int") % 11 == 0) & (F.col("field_key") == "OPERATE_COST"),
        "PARSE_SUSPECT").otherwise("FACT_DIRECT"))


FINANCE = """fin AS (SELECT * REPLACE (CASE field_key WHEN 'REVENUE' THEN 'revenue' WHEN 'COST' THEN 'operating_cost' ELSE 'inventory' END AS field_key,
    CASE WHEN CAST(security_code AS INT) % 11 = 0 AND field_key = 'COST' THEN 'PARSE_SUSPECT' ELSE 'FACT_DIRECT' END AS source_status) FROM (
  SELECT *, 'C' AS basis FROM facts_cum WHERE field_key <> 'QTY' UNION ALL SELECT *, 'C' FROM facts_restated WHERE field_key <> 'QTY'
  UNION ALL SELECT *, 'C' FROM facts_point WHERE field_key = 'QTY' UNION ALL SELECT *, 'S' FROM facts_quarter WHERE field_key = 'COST' AND CAST(security_code AS INT) % 2 = 0)),
u AS (SELECT *, row_number() OVER (PARTITION BY security_code, report_date, field_key, basis ORDER BY available_at DESC, record_key) AS n FROM fin WHERE available_at <= DATE '2000-10-01'),
sel AS (SELECT security_code, report_date, field_key AS target, basis, CASE source_status WHEN 'PARSE_SUSPECT' THEN source_status ELSE 'SOURCE_DIRECT' END AS status,
  CASE WHEN source_status <> 'PARSE_SUSPECT' THEN value_num END AS value, CASE WHEN source_status <> 'PARSE_SUSPECT' THEN available_at END AS available_at FROM u WHERE n = 1),
gp AS (SELECT * FROM sel WHERE basis = 'C' UNION ALL SELECT r.security_code, r.report_date, 'gross_profit', 'C', 'DERIVED', r.value - c.value, greatest(r.available_at, c.available_at)
  FROM sel r JOIN sel c USING (security_code, report_date) WHERE r.target = 'revenue' AND c.target = 'operating_cost' AND r.basis = 'C' AND c.basis = 'C' AND r.value - c.value IS NOT NULL)
"""


@query("fin4_selected",
    src.sql(FINANCE + "SELECT security_code, report_date, target, status, round(value, 4) AS value, available_at FROM sel WHERE basis = 'C'"))
def fin4(spark, d):
    out = p.selected(finance_facts(spark, d), cutoff()).withColumn("value", F.round("value", 4))
    return out.select("security_code", "report_date", "target", "status", "value", "available_at")


TARGETS = ", ".join(f"'{t}'" for t in p.FIELDS)
STATUSES = FINANCE + f""", every AS (SELECT DISTINCT security_code, report_date, CASE WHEN CAST(security_code AS INT) % 10 = 0 THEN 'BANK'
    ELSE 'INDUSTRIAL' END AS template FROM sel WHERE basis = 'C'),
st AS (SELECT e.security_code, e.report_date, t.target, e.template,
  CASE WHEN template <> 'INDUSTRIAL' AND t.target IN ('gross_profit', 'accounts_receivable', 'inventory', 'contract_liabilities', 'capex',
    'interest_bearing_debt') THEN 'NOT_APPLICABLE' ELSE coalesce(g.status, 'SOURCE_MISSING') END AS status,
  CASE WHEN template <> 'INDUSTRIAL' AND t.target IN ('gross_profit', 'inventory') THEN NULL ELSE g.value END AS value,
  CASE WHEN template <> 'INDUSTRIAL' AND t.target IN ('gross_profit', 'inventory') THEN NULL ELSE g.available_at END AS available_at
  FROM every e CROSS JOIN (SELECT unnest([{TARGETS}]) AS target) t LEFT JOIN gp g ON g.security_code = e.security_code AND g.report_date = e.report_date AND g.target = t.target)
"""


def template():
    return F.when(F.col("security_code").cast("int") % 10 == 0, p.industry_template(F.lit("某银行"))).otherwise(p.industry_template(F.lit("某科技")))


def statuses(spark, d):
    return p.field_statuses(p.with_gross_profit(p.selected(finance_facts(spark, d), cutoff())), None, template())


@query("fin9_field_statuses", src.sql(STATUSES + "SELECT security_code, report_date, target, status, round(value, 4) AS value, available_at FROM st"))
def fin9(spark, d):
    return statuses(spark, d).withColumn("value", F.round("value", 4)).drop("text")


NUMBERS = [t for t, (_, kind, _) in p.FIELDS.items() if kind != "text"]
TEXTS = [t for t, (_, kind, _) in p.FIELDS.items() if kind == "text"]


@query("fin5_annual",
    src.sql(STATUSES + "SELECT security_code, report_date, " + ", ".join(f"round(max(value) FILTER (target = '{t}'), 4) AS {t}" for t in NUMBERS)
  + ", " + ", ".join(f"CAST(NULL AS VARCHAR) AS {t}" for t in TEXTS) + ", max(available_at) AS available_at FROM st WHERE month(report_date) = 12 GROUP BY 1, 2"))
def fin5(spark, d):
    return p.annual(statuses(spark, d)).withColumns({c: F.round(c, 4) for c in NUMBERS})


@query("fin8_quarterly", src.sql(FINANCE + """, c AS (SELECT *, year(report_date) * 4 + quarter(report_date) AS k FROM sel WHERE basis = 'C'),
s AS (SELECT * FROM sel WHERE basis = 'S' AND status = 'SOURCE_DIRECT'),
f AS (SELECT a.security_code, a.report_date, a.target, CASE WHEN a.target = 'inventory' OR quarter(a.report_date) = 1 THEN a.value ELSE a.value - b.value END AS value,
  CASE WHEN a.target = 'inventory' OR quarter(a.report_date) = 1 THEN a.available_at ELSE greatest(a.available_at, b.available_at) END AS available_at, a.status
  FROM c a LEFT JOIN c b ON a.security_code = b.security_code AND a.target = b.target AND quarter(a.report_date) > 1 AND b.k = a.k - 1)
SELECT security_code, report_date, target, round(coalesce(s.value, f.value), 4) AS value, CASE WHEN s.value IS NOT NULL THEN s.available_at ELSE f.available_at END AS available_at,
  CASE WHEN s.value IS NOT NULL THEN 'SOURCE_DIRECT' WHEN f.value IS NULL THEN CASE WHEN f.status = 'SOURCE_DIRECT' THEN 'SOURCE_MISSING' ELSE f.status END
       WHEN target <> 'inventory' AND quarter(report_date) > 1 THEN 'DERIVED' ELSE f.status END AS status
FROM f FULL JOIN s USING (security_code, report_date, target)"""))
def fin8(spark, d):
    return p.quarters_of(p.selected(finance_facts(spark, d), cutoff(), standalone=None)).withColumn("value", F.round("value", 4))


@query("fin11_gaps", src.sql(STATUSES + """SELECT security_code, report_date, CASE field_key WHEN 'revenue' THEN 'OPERATE_INCOME'
    WHEN 'operating_cost' THEN 'OPERATE_COST' ELSE 'INVENTORY' END AS field, 'FUTURE_EXCLUDED' AS gap
  FROM fin WHERE available_at > DATE '2000-10-01' UNION ALL SELECT security_code, report_date, target, status FROM st WHERE status IN ('SOURCE_MISSING', 'PARSE_SUSPECT', 'CONFLICTING')"""))
def fin11(spark, d):
    return p.gaps(finance_facts(spark, d), statuses(spark, d), cutoff())


@query("agg9_coverage", src.sql(STATUSES + "SELECT template, target, status, count(*) AS n FROM st GROUP BY 1, 2, 3"))
def agg9(spark, d):
    return p.coverage(statuses(spark, d), template())


@query("jon5_disclosures", src.sql("""x AS (SELECT security_code, record_key, field_key, report_date FROM facts_cum)
SELECT x.security_code, x.field_key, x.report_date, CAST(x.report_date + CASE WHEN quarter(x.report_date) = 4 THEN 100 ELSE 40 END AS DATE) AS available_at FROM x"""))
def jon5(spark, d):
    rows = src.facts_cum(spark, d).withColumn("available_at", F.lit(None).cast("date"))
    base = rows.select("security_code", "record_key", "report_date").distinct()
    general = base.select("security_code", F.lit("").alias("record_key"), "report_date", F.date_add("report_date", 40).alias("available_at"))
    exact = base.filter("quarter(report_date) = 4").select("security_code", "record_key", "report_date", F.date_add("report_date", 100).alias("available_at"))
    return p.with_disclosures(rows, general.unionByName(exact)).select("security_code", "field_key", "report_date", "available_at")


@query("fin13_scoped",
    src.sql("SELECT security_code, field_key, report_date, value_num FROM facts_cum WHERE report_date BETWEEN make_date(1996 + CAST(security_code AS INT) % 3, 1, 1) AND DATE '1999-12-31' AND CAST(security_code AS INT) % 4 <> 0"))
def fin13(spark, d):
    code = F.lpad(F.col("s_suppkey").cast("string"), 6, "0")
    requests = src.table(spark, d, "supplier").filter("s_suppkey % 4 <> 0").select(
        code.alias("code"), F.make_date(F.lit(1996) + (F.col("s_suppkey") % 3).cast("int"), F.lit(1), F.lit(1)).alias("request_annual_from"),
            F.lit(datetime.date(1999, 12, 31)).alias("request_through")
    )
    return p.scoped(src.facts_cum(spark, d), requests).select("security_code", "field_key", "report_date", "value_num")


@query("fin15_violations",
    src.sql("""SELECT security_code, field_key, report_date, 'KNOWN_BY_CUTOFF' AS rule FROM facts_cum WHERE available_at > DATE '2000-10-01'
UNION ALL SELECT security_code, field_key, report_date, 'YEAR_END' FROM facts_cum WHERE month(report_date) <> 12"""))
def fin15(spark, d):
    rules = {"KNOWN_BY_CUTOFF": F.col("available_at") <= cutoff(), "YEAR_END": F.month("report_date") == 12, "HAS_VALUE": F.col("value_num").isNotNull()}
    return p.violations(src.facts_cum(spark, d), ["security_code", "field_key", "report_date"], rules)


@query("fin15_formal_violations", src.sql("""f AS (SELECT security_code, field_key, report_date, CASE WHEN quarter(report_date) < 4 OR CAST(security_code AS INT) % 7 > 0 THEN available_at END AS a
    FROM (SELECT * FROM facts_cum UNION ALL SELECT * FROM facts_restated) WHERE field_key = 'REVENUE'),
g AS (SELECT *, count(*) OVER (PARTITION BY security_code, report_date) AS n, CAST(security_code AS INT) % 4 AS k, make_date(1996 + CAST(security_code AS INT) % 3, 1, 1) AS low FROM f)
SELECT DISTINCT security_code AS security_id, report_date AS report_period, unnest(list_filter([CASE WHEN n > 1 THEN 'DUPLICATE_KEY' END, CASE WHEN a IS NULL THEN 'AVAILABLE_AT_MISSING' END,
  CASE WHEN a > DATE '2000-10-01' THEN 'FUTURE_ROW' END, CASE WHEN k = 0 THEN 'UNKNOWN_SECURITY' END,
  CASE WHEN k > 0 AND report_date NOT BETWEEN low AND DATE '1999-12-31' THEN 'PERIOD_OUT_OF_RANGE' END], lambda x: x IS NOT NULL)) AS rule FROM g"""))
def fin15_formal(spark, d):
    """Revenues with their restatements as if they were one table to hand on, some without a date of availability."""
    rows = src.facts_cum(spark, d).unionByName(src.facts_restated(spark, d)).filter("field_key = 'REVENUE'")
    known = F.when((F.quarter("report_date") < 4) | (F.col("security_code").cast("int") % 7 > 0), F.col("available_at"))
    table = rows.select(F.col("security_code").alias("security_id"), F.col("report_date").alias("report_period"), known.alias("available_at"))
    s = F.col("s_suppkey")
    requests = src.table(spark, d, "supplier").select(F.lpad(s.cast("string"), 6, "0").alias("security_id"), F.make_date(F.lit(1996) + (s % 3).cast("int"), F.lit(1), F.lit(1)).alias("request_annual_from"),
        F.lit(datetime.date(1999, 12, 31)).alias("request_through"), F.when(s % 4 == 0, "FAILED").otherwise("SUCCESS").alias("status"))
    return p.formal_violations(table, cutoff(), requests)


@query("fin7_annual_debt", src.sql(STATUSES + """, db AS (SELECT security_code, report_date, sum(value_num) AS debt, max(available_at) AS known FROM facts_point WHERE field_key <> 'QTY'
    AND available_at <= DATE '2000-10-01' GROUP BY 1, 2),
pe AS (SELECT security_code, report_date FROM every UNION SELECT security_code, report_date FROM db)
SELECT pe.security_code, pe.report_date, round(max(st.value) FILTER (st.target = 'revenue'), 4) AS revenue, round(max(CASE WHEN CAST(pe.security_code AS INT) % 10 > 0 THEN debt END), 4) AS interest_bearing_debt,
  greatest(max(st.available_at), max(CASE WHEN CAST(pe.security_code AS INT) % 10 > 0 THEN known END)) AS available_at
FROM pe LEFT JOIN st USING (security_code, report_date) LEFT JOIN db USING (security_code, report_date) WHERE month(pe.report_date) = 12 GROUP BY 1, 2"""))
def fin7_annual(spark, d):
    """The annual table with debt from its parts; banks have none."""
    key = F.when(F.col("field_key") == "REVENUE", "SHORT_LOAN").when(F.col("field_key") == "COST", "BOND_PAYABLE").otherwise("OTHER")
    parts = src.facts_point(spark, d).withColumns({"field_key": key, "period_basis": F.lit("CUMULATIVE"), "source_priority": F.lit(None).cast("int")})
    chosen = p.with_gross_profit(p.selected(finance_facts(spark, d), cutoff()))
    rows = p.field_statuses(p.with_debt_proxy(chosen, p.debt_proxy(parts, cutoff())), None, template())
    out = p.annual(rows).select("security_code", "report_date", "revenue", "interest_bearing_debt", "available_at")
    return out.withColumns({c: F.round(c, 4) for c in ("revenue", "interest_bearing_debt")})


@query("fin17_duplicates",
    src.sql("r AS (SELECT * FROM facts_cum UNION ALL SELECT * FROM facts_restated) SELECT security_code, field_key, report_date, count(*) AS n FROM r GROUP BY 1, 2, 3 HAVING count(*) > 1"))
def fin17(spark, d):
    return p.duplicates(src.facts_cum(spark, d).unionByName(src.facts_restated(spark, d)), ["security_code", "field_key", "report_date"])


@query("fin19_pending", "SELECT CAST(s_suppkey AS VARCHAR) AS security_id FROM supplier WHERE s_suppkey % 3 <> 0")
def fin19(spark, d):
    s = src.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("security_id"),
        F.when(F.col("s_suppkey") % 3 == 0, "SUCCESS").when(F.col("s_suppkey") % 3 == 1, "FAILED").otherwise("RUNNING").alias("status"))
    return p.pending(s.select("security_id"), s)


@query("fin14_templates",
    "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'BANK' WHEN 1 THEN 'INSURANCE' WHEN 2 THEN 'SECURITIES' WHEN 3 THEN 'OTHER_FINANCIAL' ELSE 'INDUSTRIAL' END AS template FROM supplier")
def fin14(spark, d):
    name = F.element_at(F.array(*map(F.lit, ["某银行", "某保险", "某证券", "某信托", "某科技"])), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return src.table(spark, d, "supplier").select("s_suppkey", p.industry_template(name).alias("template"))
