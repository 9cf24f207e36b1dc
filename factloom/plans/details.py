"""Queries of details: issues, headlines, gaps, components, names and labels; and the same in SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from factloom.functions import targets
from factloom.operators import documents as doc
from factloom.operators import point_in_time as pit
from factloom.operators import reconcile as rec
from factloom.operators import research, search
from factloom.operators import timeseries as ts
from factloom.plans.timeseries import TWELVE
from factloom.sources import facts as src
from factloom.sources import sinks

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


@query("flt13_issues", """SELECT 'parse_suspect' AS issue, c_custkey AS observation_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders
    WHERE o_orderstatus = 'P' OR o_totalprice < 5000)
UNION ALL SELECT 'source_conflict', c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'unresolved', c_custkey FROM customer
    WHERE c_mktsegment = 'MACHINERY' OR c_acctbal < 0""")
def flt13(spark, d):
    s = F.col("c_mktsegment")
    status = F.when(s == "BUILDING", "SOURCE_CONFLICT").when(s == "MACHINERY", "UNRESOLVED").otherwise("SINGLE_SOURCE")
    observations = src.table(spark, d, "customer").select(F.col("c_custkey").alias("observation_id"), status.alias("status"),
        F.when(F.col("c_acctbal") < 0, 0).otherwise(1).alias("usable"))
    orders = src.table(spark, d, "orders")
    lineage = orders.select(F.col("o_custkey").alias("observation_id"), F.col("o_orderkey").alias("source_fact_id"))
    sources = orders.select(F.col("o_orderkey").alias("source_fact_id"), F.when(F.col("o_orderstatus") == "P", "PARSE_SUSPECT").alias("source_status"),
        (F.col("o_totalprice") < 5000).alias("quarantined"))
    each = [research.with_issue(observations, lineage, sources, i).select(F.lit(i).alias("issue"), "observation_id") for i in ("parse_suspect",
        "source_conflict", "unresolved")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("agg3_headlines", src.sql("""h AS (SELECT *, CASE field_key WHEN 'REVENUE' THEN 'TOTAL_OPERATE_INCOME' WHEN 'QTY' THEN 'TOTAL_ASSETS' END AS k
    FROM facts), l AS (SELECT *, row_number() OVER (PARTITION BY security_code, family, k ORDER BY report_date DESC) AS n FROM h WHERE k IS NOT NULL)
SELECT security_code, family, k AS field_key, report_date, value_num FROM l WHERE n = 1"""))
def agg3_headlines(spark, d):
    key = F.when(F.col("field_key") == "REVENUE", "TOTAL_OPERATE_INCOME").when(F.col("field_key") == "QTY", "TOTAL_ASSETS").otherwise("OTHER")
    return search.headlines(src.facts(spark, d).withColumn("field_key", key), ["security_code", "family", "field_key", "report_date", "value_num"])


@query("agg8_gap_groups", src.sql("""r AS (SELECT *, CASE WHEN quarter(report_date) = 1 THEN 'MISSING_OFFICIAL'
    WHEN quarter(report_date) = 2 THEN 'OFFICIAL_PERIOD_NOT_LOADED' ELSE 'EXACT_MATCH' END AS status,
  CASE family WHEN 'RPT_F10_FINANCE_GINCOME' THEN 'A' ELSE 'FUTURE_FREE_SOURCE_REQUIRED' END AS mode, CASE WHEN year(report_date) > 1996 THEN report_date END AS t FROM facts)
SELECT 'missing_official' AS g, CAST(t AS VARCHAR) AS k, mode, status, count(*) AS n FROM r WHERE status = 'MISSING_OFFICIAL' GROUP BY 2, 3, 4
    UNION ALL SELECT 'unavailable', CAST(t AS VARCHAR), mode, status, count(*) FROM r WHERE status = 'OFFICIAL_PERIOD_NOT_LOADED' GROUP BY 2, 3, 4
UNION ALL SELECT 'by_status', NULL, mode, status, count(*) FROM r GROUP BY 3, 4 UNION ALL SELECT 'event_gaps', family, mode, status, count(*) FROM r
    WHERE t IS NULL AND status = 'MISSING_OFFICIAL' GROUP BY 2, 3, 4
UNION ALL SELECT 'out_of_scope', NULL, mode, NULL, count(DISTINCT (family, field_key)) FROM r WHERE mode <> 'A' GROUP BY 3"""))
def agg8_gaps(spark, d):
    q = F.quarter("report_date")
    rows = src.facts(spark, d).withColumns({
        "status": F.when(q == 1, "MISSING_OFFICIAL").when(q == 2, "OFFICIAL_PERIOD_NOT_LOADED").otherwise("EXACT_MATCH"),
        "mode": F.when(F.col("family") == src.CUMULATIVE_FAMILY, "A").otherwise("FUTURE_FREE_SOURCE_REQUIRED"),
    })
    rows = rows.withColumn("report_date", F.when(F.year("report_date") > 1996, F.col("report_date")))
    g = rec.gap_groups(rows, rows.select("theme", "family", "dataset", "field_key", "mode").distinct())
    total = lambda name, key: g[name].groupBy(F.lit(name).alias("g"), key.cast("string").alias("k"), "mode",
        "status").agg(F.sum("fact_count").alias("n"))
    out = total("missing_official", F.col("report_date")).unionByName(total("unavailable", F.col("report_date"))).unionByName(total("by_status",
        F.lit(None))).unionByName(total("event_gaps", F.col("family")))
    return out.unionByName(g["out_of_scope"].groupBy(F.lit("out_of_scope").alias("g"), F.lit(None).cast("string").alias("k"), "mode",
        F.lit(None).cast("string").alias("status")).agg(F.count(F.lit(1)).alias("n")))


@query("win5_components", src.sql(TWELVE + """SELECT security_code, field_key, report_date, round(coalesce(q.ttm, c.ttm), 4) AS total,
  CASE WHEN q.ttm IS NOT NULL THEN 'add,add,add,add' WHEN month(report_date) = 12 THEN 'current_fy' ELSE 'add_previous_fy,subtract_previous_same,add_current_cumulative' END AS roles,
  CASE WHEN q.ttm IS NULL THEN coalesce(c.prior_year_date, report_date) END AS first_date
FROM four q FULL JOIN cum c USING (security_code, field_key, report_date)"""))
def win5_components(spark, d):
    rows = src.everything(spark, d)
    found = ts.ttm_components(rows, rows)
    total = F.aggregate("components", F.lit(0.0), lambda a, x: a + F.when(x["role"] == "subtract_previous_same", -x["value"]).otherwise(x["value"]))
    first = F.when(F.col("method") != "FOUR_INDEPENDENT_QUARTERS", F.get("components", 0)["report_date"])
    return found.select("security_code", "field_key", "report_date", F.array_join(F.transform("components", lambda x: x["role"]), ",").alias("roles"),
        F.round(total, 4).alias("total"), first.alias("first_date"))


@query("fin7_debt_proxy",
    src.sql("SELECT security_code, report_date, 'DERIVED_PROXY' AS status, round(sum(value_num), 4) AS value, max(available_at) AS available_at FROM facts_point WHERE field_key <> 'QTY' AND available_at <= DATE '2000-10-01' GROUP BY 1, 2"))
def fin7(spark, d):
    key = F.when(F.col("field_key") == "REVENUE", "SHORT_LOAN").when(F.col("field_key") == "COST", "BOND_PAYABLE").otherwise("INVENTORY")
    rows = src.facts_point(spark, d).withColumns({"field_key": key, "period_basis": F.lit("CUMULATIVE"), "source_priority": F.lit(None).cast("int")})
    out = pit.debt_proxy(rows, F.lit(datetime.date(2000, 10, 1)))
    return out.select("security_code", "report_date", "status", F.round("value", 4).alias("value"), "available_at")


@query("doc7_company_names",
    """SELECT c_custkey, CASE c_nationkey % 4 WHEN 3 THEN lower(c_mktsegment) || '集团' ELSE lower(c_mktsegment) END AS name FROM customer""")
def doc7(spark, d):
    k = F.col("c_nationkey") % 4
    text = F.concat(F.lit(" "), "c_mktsegment", F.when(k == 0, "（股份有限公司）").when(k == 1, " Co., Ltd.").when(k == 2, " · 公司").otherwise("集团有限公司"))
    return src.table(spark, d, "customer").select("c_custkey", doc.company_name(text).alias("name"))


@query("doc1_canonical_urls",
    r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/x' WHEN 1 THEN url END AS canonical_url FROM pages""")
def doc1_canonical(spark, d):
    k = F.col("page_id") % 3
    head = F.when(k == 0, F.lit("<LINK href='/x' rel=canonical>")).when(k == 1, F.concat(F.lit('<link data-a rel="canonical"\n href="'), "url",
        F.lit('"/>'))).otherwise(F.lit("<link rel='icon' href='/i'>"))
    return src.table(spark, d, "pages").select("page_id", doc.canonical_url(F.concat(head, F.coalesce("html", F.lit(""))), F.col("url")).alias("canonical_url"))


@query("jon11_label_matches", "SELECT o_orderkey, o_orderpriority AS target FROM orders WHERE o_totalprice > 100000")
def jon11(spark, d):
    words = {"1-URGENT": "营业收入", "2-HIGH": "营业成本", "3-MEDIUM": "净利润", "4-NOT SPECIFIED": "存货", "5-LOW": "总资产"}
    named = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])[F.col("o_orderpriority")]
    label = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "一、其中: ").otherwise("3. "), named,
        F.when(F.col("o_totalprice") > 200000, "（元）(注)").when(F.col("o_totalprice") > 100000, "：").otherwise("合计"))
    targets = spark.createDataFrame([(v, k) for k, v in words.items()], "alias string, target string")
    return doc.label_matches(src.table(spark, d, "orders").select("o_orderkey", label.alias("label")), targets).select("o_orderkey", "target")


PACK = {"orders": ["o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"], "lineitem": ["l_linenumber", "l_orderkey", "l_partkey", "l_returnflag"],
    "customer": ["c_custkey", "c_mktsegment", "c_name"]}


@query("snk9_manifest", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows, CAST(sum(CAST('0x' || left(md5(concat_ws(chr(31), {', '.join(c)})), 15) AS BIGINT)::HUGEINT) AS VARCHAR) AS digest FROM {t}"
    for t, c in PACK.items()))
def snk9(spark, d):
    return sinks.manifest({t: src.table(spark, d, t).select(*c) for t, c in PACK.items()})


@query("jon2_classified", src.sql("""SELECT security_code, family, report_date, field_key, CASE family WHEN 'RPT_F10_FINANCE_GINCOME' THEN 'OFFICIAL_DIRECT'
  WHEN 'RPT_F10_FINANCE_GBALANCE' THEN 'OFFICIAL_DIRECT' ELSE 'OFFICIAL_DERIVED' END AS mode, 'numeric' AS method FROM facts WHERE field_key <> 'QTY'
UNION ALL SELECT security_code, family, report_date, field_key, NULL, NULL FROM facts WHERE field_key = 'QTY'"""))
def jon2(spark, d):
    rows = src.facts(spark, d)
    entries = rec.registry(rows.filter("field_key <> 'QTY'"))
    return rec.classified(rows, entries).select("security_code", "family", "report_date", "field_key", "mode", "method")


# Every order is a page of its customer's report. Labels stand before, after and around their amounts, with references to notes.
LABELS = [("1-URGENT", "营业收入", "OPERATE_INCOME", "income_statement"), ("2-HIGH", "货币资金", "MONETARYFUNDS", "balance_sheet"),
    ("3-MEDIUM", "商誉", "GOODWILL", "balance_sheet"), ("4-NOT SPECIFIED", "营业成本", "OPERATE_COST", "income_statement"),
    ("5-LOW", "经营活动产生的现金流量净额", "NETCASH_OPERATE", "cash_flow")]


@query("doc9_statement_values", f"""WITH l AS (SELECT *, o_orderkey + 100 AS v FROM orders JOIN (VALUES {", ".join(map(str, LABELS))}) k(p, label, field_key, statement) ON o_orderpriority = p),
t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, field_key ORDER BY o_orderkey) AS n FROM l WHERE o_orderstatus <> 'F')
SELECT o_custkey AS document_id, statement, field_key, 'consolidated' AS scope,
  CASE WHEN p = '4-NOT SPECIFIED' OR o_orderkey % 2 = 0 THEN v ELSE -v END * 10000.0::DOUBLE AS value, '万元' AS unit, 5000.0::DOUBLE AS tolerance FROM t WHERE n = 1""")
def doc9_statement_values(spark, d):
    """Orders as pages of five lines: a heading, the unit, and the label before, after or around its amount."""
    of = lambda k: F.element_at(F.create_map(*[F.lit(x) for row in LABELS for x in (row[0], row[k])]), F.col("o_orderpriority"))
    statement = F.element_at(F.create_map(*[F.lit(x) for kv in (("income_statement", "利润表"), ("balance_sheet", "资产负债表"), ("cash_flow", "现金流量表")) for x in kv]), of(3))
    o = src.table(spark, d, "orders")
    head = F.concat(F.when(F.col("o_orderstatus") == "F", "母公司").otherwise("合并"), statement)
    v = (F.col("o_orderkey") + 100).cast("string")
    amount = F.concat_ws(" ", F.when(F.col("o_orderkey") % 2 == 0, v).otherwise(F.concat(F.lit("("), v, F.lit(")"))), F.lit("999"))
    label, note = of(1), F.lit("四(42)")
    k = F.col("o_orderkey") % 4
    rows = (
        F.when(k == 0, F.array(F.concat_ws(" ", note, amount), F.concat(F.lit("一、"), label), F.lit("其他")))
        .when(k == 1, F.array(F.concat_ws(" ", label, note, amount), F.lit("其他"), F.lit("")))
        .when(k == 2, F.array(F.concat(F.lit("加："), label, F.lit(" 四")), amount, F.lit("其他")))
        .otherwise(F.array(F.substr(label, F.lit(1), F.lit(2)), amount, F.substr(label, F.lit(3))))
    )
    each = F.concat(F.array(head, F.lit("单位：人民币万元")), rows)
    lines = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").cast("int").alias("page"), F.posexplode(each).alias("line_no", "line"))
    found = doc.statement_values(lines, targets.labels(spark))
    return found.select("document_id", "statement", "field_key", "scope", "value", "unit", "tolerance")


@query("snk10_affected_strings", """SELECT p_partkey, 'p_name' AS "column", 2 AS removed, 7 AS first_point, p_name AS cleaned FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 'p_type', 1, 31, p_type FROM part WHERE p_partkey % 2 = 0""")
def snk10_affected(spark, d):
    from factloom.operators.normalize import affected_strings

    bad = {"p_name": F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("\x07"), "p_name", F.lit("\x0b"))).otherwise(F.col("p_name")),
        "p_type": F.when(F.col("p_partkey") % 2 == 0, F.concat("p_type", F.lit("\x1f"))).otherwise(F.concat("p_type", F.lit("\t\n")))}
    found = affected_strings(src.table(spark, d, "part").withColumns(bad), ["p_partkey"], ["p_name", "p_type"])
    return found.select("p_partkey", "column", "removed", F.get("code_points", 0).alias("first_point"), "cleaned")
