"""Queries over report periods, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import timeseries as ts
from factloom.sources import facts as src

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


def flows(spark, d):
    return src.facts_cum(spark, d).unionByName(src.facts_decoy(spark, d))


def rounded(df, **places):
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


# One row a period from the cumulative facts, whose decoys have the lower priority.
PICK = """flows AS (SELECT * FROM facts_cum UNION ALL SELECT * FROM facts_decoy),
p AS (SELECT security_code, field_key, report_date, value_num, year(report_date) * 4 + quarter(report_date) AS k FROM (
  SELECT *, row_number() OVER (PARTITION BY security_code, field_key, report_date
    ORDER BY CASE family WHEN 'RPT_F10_FINANCE_GINCOME' THEN 1 ELSE 90 END, family, dataset) AS n FROM flows) WHERE n = 1)
"""

# Twelve months of every security and field, from all families: quarters of two families, totals of two others, exact dates.
TWELVE = """sq AS (SELECT security_code, field_key, report_date, arg_min(value_num, family) AS v FROM everything
  WHERE family IN ('RPT_F10_FINANCE_GINCOMEQC', 'RPT_F10_FINANCE_GCASHFLOWQC') GROUP BY 1, 2, 3),
four AS (SELECT security_code, field_key, report_date, ttm FROM (SELECT *, sum(v) OVER w AS ttm, count(*) OVER w AS n FROM sq
  WINDOW w AS (PARTITION BY security_code, field_key ORDER BY report_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE n = 4),
cu AS (SELECT security_code, field_key, report_date, arg_min(value_num, family = 'RPT_F10_FINANCE_GCASHFLOW') AS v FROM everything
  WHERE family IN ('RPT_F10_FINANCE_GINCOME', 'RPT_F10_FINANCE_GCASHFLOW') GROUP BY 1, 2, 3),
cum AS (SELECT a.security_code, a.field_key, a.report_date, a.v AS value_num, y.v AS prior_year, s.v AS prior_same,
  y.report_date AS prior_year_date, CASE WHEN month(a.report_date) = 12 THEN a.v ELSE y.v - s.v + a.v END AS ttm
  FROM cu a LEFT JOIN cu y ON y.security_code = a.security_code AND y.field_key = a.field_key AND y.report_date = make_date(year(a.report_date) - 1, 12, 31)
  LEFT JOIN cu s ON s.security_code = a.security_code AND s.field_key = a.field_key AND s.report_date = CAST(a.report_date - INTERVAL 1 YEAR AS DATE)
  WHERE month(a.report_date) = 12 OR y.v IS NOT NULL AND s.v IS NOT NULL)
"""


@query("win1_latest_numeric", src.sql("""l AS (SELECT *, row_number() OVER (PARTITION BY security_code, family, field_key
  ORDER BY report_date DESC NULLS LAST, event_date DESC NULLS LAST, record_key, dataset) AS n FROM facts WHERE value_num IS NOT NULL)
SELECT security_code, family, field_key, report_date, value_num FROM l WHERE n = 1"""))
def win1(spark, d):
    return ts.latest_numeric(src.facts(spark, d), ["security_code", "family", "field_key", "report_date", "value_num"])


@query("win2_one_per_period", src.sql(PICK + "SELECT security_code, field_key, report_date, value_num FROM p"))
def win2(spark, d):
    return ts.one_per_period(flows(spark, d), ["security_code", "field_key", "report_date", "value_num"])


@query("win3_ttm_quarters", src.sql(TWELVE + "SELECT security_code, field_key, report_date, round(ttm, 4) AS ttm FROM four"))
def win3(spark, d):
    return rounded(ts.ttm_quarters(src.everything(spark, d)).drop("components"), ttm=4)


@query("win4_ttm_cumulative", src.sql(TWELVE + "SELECT security_code, field_key, report_date, round(ttm, 4) AS ttm FROM cum"))
def win4(spark, d):
    return rounded(ts.ttm_cumulative(src.everything(spark, d)).drop("components"), ttm=4)


@query("win5_ttm", src.sql(TWELVE + """SELECT security_code, field_key, report_date, round(coalesce(q.ttm, c.ttm), 4) AS ttm, CASE
    WHEN q.ttm IS NOT NULL THEN 'FOUR_INDEPENDENT_QUARTERS' WHEN month(report_date) = 12 THEN 'FULL_YEAR_EQUALS_TTM' ELSE 'FY_MINUS_PRIOR_SAME_PLUS_CURRENT' END AS method
FROM four q FULL JOIN cum c USING (security_code, field_key, report_date)"""))
def win5(spark, d):
    rows = src.everything(spark, d)
    return rounded(ts.ttm(rows, rows), ttm=4).drop("formula")


@query("win6_value_as_of",
    src.sql(PICK + """, e AS (SELECT security_code, make_date(y, 8, 15) AS "end" FROM (SELECT DISTINCT security_code FROM p), (SELECT unnest([1996, 1998, 2000]) AS y))
SELECT e.security_code, p.field_key, e."end", max(report_date) AS value_date, round(arg_max(value_num, report_date), 2) AS value
FROM e JOIN p ON p.security_code = e.security_code AND p.report_date <= e."end" GROUP BY ALL"""))
def win6(spark, d):
    rows = flows(spark, d)
    years = F.explode(F.array(*[F.make_date(F.lit(y), F.lit(8), F.lit(15)) for y in (1996, 1998, 2000)]))
    return rounded(ts.value_as_of(rows, rows.select("security_code").distinct().select("security_code", years.alias("end"))), value=2)


@query("win7_yoy", src.sql(PICK + """, y AS (SELECT *, year(report_date) * 10000 + month(report_date) * 100 + day(report_date) AS t FROM p)
SELECT security_code, field_key, report_date, round(value_num / nullif(last_value(value_num) OVER (PARTITION BY security_code,
    field_key ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 10000 PRECEDING), 0) - 1, 6) AS yoy FROM y"""))
def win7(spark, d):
    return rounded(ts.yoy(flows(spark, d)), yoy=6).select("security_code", "field_key", "report_date", "yoy")


@query("win8_qoq", src.sql("""SELECT security_code, field_key, family, report_date,
  round(value_num / nullif(lag(value_num) OVER (PARTITION BY security_code, field_key, family ORDER BY report_date, dataset), 0) - 1, 6) AS qoq FROM facts"""))
def win8(spark, d):
    return rounded(ts.qoq(src.facts(spark, d)), qoq=6).select("security_code", "field_key", "family", "report_date", "qoq")


@query("win9_average", src.sql(PICK + """SELECT security_code, field_key, report_date, round(avg(value_num) OVER w, 6) AS average, count(*) OVER w AS periods
FROM p WINDOW w AS (PARTITION BY security_code, field_key ORDER BY report_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"""))
def win9(spark, d):
    return rounded(ts.average(flows(spark, d)), average=6)


@query("win10_cagr", src.sql(PICK + """, y AS (SELECT *, row_number() OVER (PARTITION BY security_code, field_key ORDER BY report_date DESC) AS r FROM p WHERE month(report_date) = 12),
g AS (SELECT security_code, field_key, count(*) - 1 AS intervals, arg_min(value_num, report_date) AS f, arg_max(value_num, report_date) AS l FROM y WHERE r <= 4 GROUP BY 1, 2)
SELECT security_code, field_key, intervals, CASE WHEN intervals > 0 AND f > 0 AND l > 0 THEN round(pow(l / f, 1.0 / intervals) - 1, 6) END AS cagr FROM g"""))
def win10(spark, d):
    return rounded(ts.cagr(flows(spark, d)), cagr=6).select("security_code", "field_key", "intervals", "cagr")


# The fact that each field has on a date, of all families, with the one before of its family; and what is known as of a date.
AS_OF = TWELVE + """, l AS (SELECT *, lag(value_num) OVER (PARTITION BY security_code, field_key, family ORDER BY report_date) AS prior FROM everything),
p2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY security_code, field_key, report_date ORDER BY CASE family
  WHEN 'RPT_F10_FINANCE_GBALANCE' THEN 0 WHEN 'RPT_F10_FINANCE_GINCOME' THEN 1 WHEN 'RPT_F10_FINANCE_GRATIO' THEN 4
  WHEN 'RPT_F10_QTR_MAINFINADATA' THEN 5 WHEN 'RPT_F10_FINANCE_QGRATIO' THEN 6 WHEN 'RPT_F10_FINANCE_GINCOMEQC' THEN 7 ELSE 90 END) AS n FROM l) WHERE n = 1),
rev AS (SELECT * FROM p2 WHERE field_key = 'REVENUE'), cost AS (SELECT * FROM p2 WHERE field_key = 'COST'),
qty AS (SELECT *, avg(value_num) OVER (PARTITION BY security_code ORDER BY report_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean FROM p2 WHERE field_key = 'QTY'),
ye AS (SELECT *, first(value_num) OVER w AS f, count(*) OVER w AS m FROM rev WHERE month(report_date) = 12 AND day(report_date) = 31
  WINDOW w AS (PARTITION BY security_code ORDER BY report_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
tc AS (SELECT security_code, report_date, coalesce(q.ttm, c.ttm) AS ttm FROM (SELECT * FROM four WHERE field_key = 'COST') q
  FULL JOIN (SELECT * FROM cum WHERE field_key = 'COST') c USING (security_code, report_date))
"""


@query("win11_formula", src.sql(AS_OF + """, x AS (SELECT DISTINCT security_code, report_date AS e, CAST(report_date - INTERVAL 1 YEAR AS DATE) AS b,
    DATE '1996-12-31' AS fixed FROM everything),
w AS (SELECT x.security_code, x.e, r.value_num AS v, r.report_date AS v_date, r0.value_num AS v0, c.value_num AS c, c.prior AS c0, c.report_date AS c_date, q.mean,
  pow(CASE WHEN ye.m > 1 AND ye.f > 0 AND ye.value_num > 0 THEN ye.value_num / ye.f END, 1.0 / nullif(ye.m - 1, 0)) - 1 AS growth, q0.value_num AS held, tc.ttm
  FROM x ASOF LEFT JOIN rev r ON x.security_code = r.security_code AND x.e >= r.report_date ASOF LEFT JOIN rev r0 ON x.security_code = r0.security_code AND x.b >= r0.report_date
  ASOF LEFT JOIN cost c ON x.security_code = c.security_code AND x.e >= c.report_date ASOF LEFT JOIN qty q ON x.security_code = q.security_code AND x.e >= q.report_date
  ASOF LEFT JOIN ye ON x.security_code = ye.security_code AND x.e >= ye.report_date ASOF LEFT JOIN qty q0 ON x.security_code = q0.security_code AND x.fixed >= q0.report_date
  LEFT JOIN tc ON x.security_code = tc.security_code AND x.e = tc.report_date)
SELECT security_code, e AS report_date, round(v / nullif(ttm, 0) + (v / nullif(v0, 0) - 1) - (c / nullif(c0, 0) - 1) + mean / nullif(held, 0) + growth * 2, 6) AS value,
  CASE WHEN v IS NULL OR ttm IS NULL OR v / nullif(v0, 0) IS NULL OR c / nullif(c0, 0) IS NULL OR mean IS NULL OR growth IS NULL OR held IS NULL THEN 'MISSING_INPUT'
       WHEN ttm = 0 OR held = 0 THEN 'DIVISION_BY_ZERO' END AS reason, v_date AS value_date, c_date AS qoq_date FROM w"""))
def win11(spark, d):
    text = """F("Operating revenue") / TTM(COST) + YOY("revenue") - QOQ(COST) + AVG(QTY, 3) / VALUE("QTY", "1996-12-31") + CAGR(REVENUE, 2) * 2"""
    found = ts.evaluate(text, src.everything(spark, d))
    dates = {"value_date": F.get("trace", 0)["report_date"], "qoq_date": F.get("trace", 3)["report_date"]}
    return rounded(found.withColumns(dates), value=6).select("security_code", "report_date", "value", "reason", "value_date", "qoq_date")


@query("win11_formula_between_periods", src.sql(AS_OF + """, x AS (SELECT DISTINCT security_code, make_date(y, 8, 15) AS e, make_date(y - 1, 8, 15) AS b
  FROM everything, (SELECT unnest([1993, 1996, 1998]) AS y))
SELECT x.security_code, x.e AS report_date, round((r.value_num / nullif(r0.value_num, 0) - 1) ** 2 - c.value_num / nullif(q.mean, 0), 6) AS value,
  CASE WHEN r.value_num / nullif(r0.value_num, 0) IS NULL OR c.value_num IS NULL OR q.mean IS NULL THEN 'MISSING_INPUT' WHEN q.mean = 0 THEN 'DIVISION_BY_ZERO' END AS reason
FROM x ASOF LEFT JOIN rev r ON x.security_code = r.security_code AND x.e >= r.report_date ASOF LEFT JOIN rev r0 ON x.security_code = r0.security_code AND x.b >= r0.report_date
ASOF LEFT JOIN cost c ON x.security_code = c.security_code AND x.e >= c.report_date ASOF LEFT JOIN qty q ON x.security_code = q.security_code AND x.e >= q.report_date"""))
def win11_between(spark, d):
    rows = src.everything(spark, d)
    years = F.explode(F.array(*[F.make_date(F.lit(y), F.lit(8), F.lit(15)) for y in (1993, 1996, 1998)]))
    # every security of all families has quarters, which need no running sums
    ends = src.facts_quarter(spark, d).select("security_code").distinct().select("security_code", years.alias("report_date"))
    return rounded(ts.evaluate("YOY(REVENUE) ** 2 - COST / AVG(QTY, 3)", rows, ends), value=6).select("security_code", "report_date", "value", "reason")


# Totals through the year in three statements and two scopes, a balance of cash among them.
OFFICIAL = [("income_statement", "consolidated", 1.0), ("income_statement", "parent", 2.0), ("cash_flow", "consolidated", 3.0), ("balance_sheet", "consolidated", 4.0)]


def official(spark, d):
    kinds = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(c).alias("c"), F.lit(f).alias("f")) for s, c, f in OFFICIAL]))
    rows = src.facts_cum(spark, d).withColumn("k", kinds)
    balance = (F.col("k.s") == "cash_flow") & (F.col("field_key") == "QTY")
    return rows.withColumns({
        "statement_type": F.col("k.s"), "scope": F.col("k.c"), "value_num": F.col("value_num") * F.col("k.f"),
        "field_key": F.when(balance, "BEGIN_CCE").otherwise(F.col("field_key")),
    }).drop("k")


@query("win12_independent_quarters", src.sql(f"""o AS (SELECT * REPLACE (CASE WHEN s = 'cash_flow' AND field_key = 'QTY' THEN 'BEGIN_CCE' ELSE field_key END AS field_key, value_num * f AS value_num)
  FROM facts_cum, (VALUES {", ".join(map(str, OFFICIAL))}) k(s, c, f)),
t AS (SELECT security_code, s AS statement_type, c AS scope, field_key, report_date, value_num FROM o WHERE s IN ('income_statement', 'cash_flow')
  AND field_key NOT IN ('BEGIN_CCE', 'END_CCE', 'BEGIN_CASH', 'END_CASH', 'BEGIN_CASH_EQUIVALENTS', 'END_CASH_EQUIVALENTS'))
SELECT a.security_code, a.statement_type, a.scope, a.field_key, a.report_date, 'Q' || CAST(quarter(a.report_date) AS VARCHAR) AS period_type, round(a.value_num - b.value_num, 4) AS value_num,
  a.report_date || '累计值 - ' || b.report_date || '累计值' AS source_row, 'FACT_CALCULATED' AS source_status
FROM t a JOIN t b USING (security_code, statement_type, scope, field_key)
WHERE year(b.report_date) = year(a.report_date) AND month(b.report_date) = month(a.report_date) - 3"""))
def win12(spark, d):
    found = rounded(ts.independent_quarters(official(spark, d)), value_num=4)
    return found.select("security_code", "statement_type", "scope", "field_key", "report_date", "period_type", "value_num", "source_row", "source_status")


# Which field of a supplier stands for which field of a balance or an income statement, and how many times.
STANDS_FOR = [
    ("TOTAL_ASSETS", "REVENUE", 1.0), ("TOTAL_LIABILITIES", "COST", 3.0), ("TOTAL_CURRENT_ASSETS", "REVENUE", 0.5), ("TOTAL_CURRENT_LIAB", "COST", 2.0),
    ("INVENTORY", "QTY", 1.0), ("PREPAYMENT", "QTY", 2.0), ("OTHER_CURRENT_ASSET", "QTY", 3.0), ("CONTRACT_ASSET", "QTY", 4.0), ("FINANCE_RECE", "QTY", 5.0),
    ("CURRENT_ASSET_OTHER", "COST", 0.1), ("NONCURRENT_ASSET_1YEAR", "QTY", 6.0), ("OPERATE_INCOME", "REVENUE", 1.0), ("OPERATE_COST", "COST", 1.0), ("NETPROFIT", "REVENUE", 0.1),
]


def balance_fields(spark, d):
    """Facts of those fields; in December there is no inventory."""
    each = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(b).alias("b"), F.lit(f).alias("f")) for t, b, f in STANDS_FOR])
    rows = src.facts_cum(spark, d).withColumn("k", F.explode(each)).filter("field_key = k.b and not (k.t = 'INVENTORY' and month(report_date) = 12)")
    return rows.withColumns({"field_key": F.col("k.t"), "value_num": F.col("value_num") * F.col("k.f"), "scope": F.lit("consolidated")}).drop("k")


@query("win13_ratio_facts", src.sql(f"""o AS (SELECT security_code, report_date, t, value_num * f AS v FROM facts_cum, (VALUES {", ".join(map(str, STANDS_FOR))}) k(t, b, f)
  WHERE field_key = b AND NOT (t = 'INVENTORY' AND month(report_date) = 12)),
w AS (PIVOT o ON t IN ({", ".join(f"'{t}'" for t, _, _ in STANDS_FOR)}) USING first(v) GROUP BY security_code, report_date),
r AS (SELECT security_code, report_date, unnest([
  {{'k': 'ZCFZL', 'v': TOTAL_LIABILITIES / nullif(TOTAL_ASSETS, 0) * 100, 'u': '%'}}, {{'k': 'CURRENT_RATIO', 'v': TOTAL_CURRENT_ASSETS / nullif(TOTAL_CURRENT_LIAB, 0), 'u': '倍'}},
  {{'k': 'GUARD_SPEED_RATIO', 'v': (TOTAL_CURRENT_ASSETS - INVENTORY - PREPAYMENT - OTHER_CURRENT_ASSET - CONTRACT_ASSET - FINANCE_RECE - CURRENT_ASSET_OTHER - NONCURRENT_ASSET_1YEAR)
    / nullif(TOTAL_CURRENT_LIAB, 0), 'u': '倍'}},
  {{'k': 'XSMLL', 'v': (OPERATE_INCOME - OPERATE_COST) / nullif(OPERATE_INCOME, 0) * 100, 'u': '%'}}, {{'k': 'XSJLL', 'v': NETPROFIT / nullif(OPERATE_INCOME, 0) * 100, 'u': '%'}}]) AS z FROM w)
SELECT security_code, report_date, z.k AS field_key, round(z.v, 6) AS value_num, z.u AS unit, round(greatest(1e-9, abs(z.v) * 1e-8), 9) AS precision_tolerance FROM r WHERE z.v IS NOT NULL"""))
def win13(spark, d):
    found = ts.ratio_facts(balance_fields(spark, d))
    return rounded(found, value_num=6, precision_tolerance=9).select("security_code", "report_date", "field_key", "value_num", "unit", "precision_tolerance")


@query("win14_ttm_check", src.sql(TWELVE + """SELECT security_code, field_key, report_date, round(q.ttm, 4) AS independent, round(c.ttm, 4) AS cumulative,
  CASE WHEN q.ttm IS NULL OR c.ttm IS NULL THEN 'UNRESOLVED' WHEN abs(q.ttm - c.ttm) <= greatest(1.0, greatest(abs(q.ttm), abs(c.ttm)) * 1e-10) THEN 'PASS' ELSE 'FAIL' END AS status
FROM four q FULL JOIN cum c USING (security_code, field_key, report_date)"""))
def win14(spark, d):
    rows = src.everything(spark, d)
    return rounded(ts.ttm_check(rows, rows), independent=4, cumulative=4)


@query("win16_resolved_fields", src.sql("""a AS (SELECT unnest(['revenue', 'Operating cost', 'QTY', 'nothing']) AS asked),
k AS (SELECT DISTINCT field_key, field_name_cn FROM facts),
n AS (SELECT lower(field_key) AS name, field_key, 0 AS r FROM k UNION ALL SELECT lower(field_name_cn), field_key, 1 FROM k)
SELECT asked, arg_min(field_key, (r, field_key)) AS field_key FROM a LEFT JOIN n ON lower(asked) = name GROUP BY asked"""))
def win16(spark, d):
    asked = spark.createDataFrame([("revenue",), ("Operating cost",), ("QTY",), ("nothing",)], "asked string")
    return ts.resolved_fields(src.facts(spark, d), asked)


@query("srt5_last_periods", src.sql(PICK + """SELECT security_code, field_key, report_date, value_num, r AS period_rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY security_code, field_key ORDER BY report_date DESC) AS INT) AS r FROM p) WHERE r <= 3"""))
def srt5(spark, d):
    return ts.last_periods(flows(spark, d), 3).select("security_code", "field_key", "report_date", "value_num", "period_rank")
