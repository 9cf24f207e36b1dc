"""Queries that compare two sources, map facts to observations, and walk the graph; and the same in SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from factloom.functions.lineage import kept
from factloom.operators import documents as doc
from factloom.operators import mapping as m
from factloom.operators import reconcile as r
from factloom.sources import facts as src

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


def official(spark, d):
    """Official values of the cumulative facts, disturbed by a digit of the key: absent, off by 0.4, in 万元, off by 5 %, a parent's, of another period."""
    return disturbed(src.facts_cum(spark, d))


def disturbed(rows):
    k = (F.col("security_code").cast("long") * 31 + F.year("report_date") * 4 + F.quarter("report_date")) % 10
    v = F.when(k == 1, F.col("value_num") + 0.4).when(k == 2, F.col("value_num") / 10000).when(k == 3, F.col("value_num") * 1.05).otherwise(F.col("value_num"))
    return rows.withColumn("k", k).filter("k != 0").select(
        "security_code", "report_date", "field_key", F.when(F.col("k") == 5, "Q9").otherwise(F.col("period_type")).alias("period_type"),
            F.lit("income_statement").alias("statement_type"),
        F.when(F.col("k") == 4, "parent").otherwise("consolidated").alias("scope"),
            F.concat_ws("-", "security_code", F.col("report_date").cast("string")).alias("document_id"), v.alias("value_num"),
        F.when(F.col("k") == 2, F.when(F.col("field_key") == "QTY", "股").otherwise("万元")).otherwise(F.col("unit")).alias("unit"),
            F.lit(0.5).alias("precision_tolerance"),
    )


OFFICIAL = """offi AS (SELECT * FROM (SELECT security_code, report_date, field_key, value_num AS v0, unit AS u0, period_type AS p0,
    (CAST(security_code AS BIGINT) * 31 + year(report_date) * 4 + quarter(report_date)) % 10 AS k FROM facts_cum) WHERE k <> 0),
base AS (SELECT security_code, report_date, field_key, family, period_type, value_num, unit, CASE family WHEN 'RPT_F10_FINANCE_GINCOME' THEN 'OFFICIAL_DIRECT'
    ELSE 'OFFICIAL_DERIVED' END AS mode
  FROM (SELECT * FROM facts_cum UNION ALL SELECT * FROM facts_decoy)),
cmp AS (SELECT b.*, o.k, CASE WHEN l.report_date IS NULL THEN 'OFFICIAL_PERIOD_NOT_LOADED'
    WHEN o.k = 4 THEN 'SCOPE_CONFLICT' WHEN o.k IS NULL OR o.k = 5 THEN 'MISSING_OFFICIAL'
    WHEN b.mode = 'OFFICIAL_DERIVED' AND k = 2 AND field_key <> 'QTY' AND abs(b.value_num - v0) <= greatest(1.0, greatest(abs(b.value_num), abs(v0)) * 1e-10) THEN 'DERIVED_MATCH'
    WHEN b.mode = 'OFFICIAL_DERIVED' THEN 'MISMATCH'
    WHEN k = 1 THEN CASE WHEN field_key = 'QTY' THEN 'WITHIN_ROUNDING' ELSE 'WITHIN_ROUNDING' END
    WHEN k = 2 AND field_key = 'QTY' THEN CASE WHEN abs(v0 - v0 / 10000) <= 0.5 THEN 'WITHIN_ROUNDING' ELSE 'MISMATCH' END
    WHEN k = 2 THEN CASE WHEN v0 = v0 / 10000 * 10000.0 THEN 'EXACT_MATCH' ELSE 'WITHIN_ROUNDING' END
    WHEN k = 3 THEN CASE WHEN abs(v0 - v0 * 1.05) <= CASE field_key WHEN 'QTY' THEN 0.5 ELSE 1.0 END THEN 'WITHIN_ROUNDING' ELSE 'MISMATCH' END ELSE 'EXACT_MATCH' END AS status
  FROM base b LEFT JOIN offi o USING (security_code, report_date, field_key) LEFT JOIN (SELECT DISTINCT security_code, report_date FROM offi) l USING (security_code, report_date))
"""


def compared(spark, d, sold=None):
    sold = src.quarters_once(spark, d) if sold is None else sold
    rows = src.facts_cum_and_decoy(spark, d, sold)
    entries = kept(r.registry(rows))
    entries = F.broadcast(entries) if entries.count() <= 100_000 else entries  # a row a context of a field, so rows stay where they are
    facts = r.classified(r.primary(rows), entries).withColumn("statement_type", F.lit("income_statement"))
    offi = disturbed(src.facts_cum(spark, d, sold))
    return r.compared(r.matched(facts, offi), offi)


@query("rec11_compared", src.sql(OFFICIAL + "SELECT security_code, report_date, field_key, family, status FROM cmp"))
def rec11(spark, d):
    return compared(spark, d).select("security_code", "report_date", "field_key", "family", "status")


@query("rec10_text_verdicts", """SELECT lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS security_code, CASE p_partkey % 9 WHEN 0 THEN 'TEXT_MATCH_NORMALIZED'
    WHEN 1 THEN 'MISMATCH' WHEN 2 THEN 'MISSING_EASTMONEY' WHEN 3 THEN 'MISSING_OFFICIAL'
  WHEN 4 THEN 'TEXT_MATCH_NORMALIZED' WHEN 5 THEN 'MISMATCH' WHEN 6 THEN 'SET_MATCH' WHEN 7 THEN 'MISMATCH' ELSE 'MISSING_EASTMONEY' END AS status FROM part""")
def rec10(spark, d):
    k, null = F.col("p_partkey") % 9, F.lit(None).cast("string")
    at = lambda *values: F.element_at(F.array(*values), (k + 1).cast("int"))
    name, date, both = F.col("p_name"), F.lit("2001-03-31"), F.concat("p_name", F.lit("、"), "p_type")
    own = at(F.concat(F.upper("p_name"), F.lit("　（A）")), name, F.lit(" "), name, F.lit("2001/3/31"), date, both, both, null)
    other = at(F.concat("p_name", F.lit("(a)")), F.concat("p_name", F.lit("x")), name, null, date, F.lit("2001-06-30"),
        F.concat("p_type", F.lit("; "), F.upper("p_name")), name, null)
    method = F.when(k < 4, "text").when(k < 6, "date").when(k < 8, "set").otherwise("numeric")
    # matched by the whole key: codes of six digits are the same for parts from a million on
    shared = [F.col("p_partkey").cast("string").alias("security_code"), F.lit("2001-03-31").cast("date").alias("report_date"),
        F.lit("FIELD").alias("field_key"), F.lit("Q1").alias("period_type"), F.lit("").alias("statement_type"), F.lit("").alias("unit")]
    part = src.table(spark, d, "part")
    facts = part.select(*shared, F.lit("BASICINFO").alias("family"), F.lit("OFFICIAL_METADATA").alias("mode"), method.alias("method"),
        F.lit(0.0).alias("absolute"), F.lit(0.0).alias("relative"), own.alias("value_text"), F.lit(None).cast("double").alias("value_num"))
    offi = part.select(*shared, F.lit("consolidated").alias("scope"), F.lit("d").alias("document_id"), other.alias("value_text"),
        F.when(k == 8, 1.5).alias("value_num"), F.lit(0.0).alias("precision_tolerance"))
    return r.compared(r.matched(facts, offi), offi).select(F.lpad("security_code", 6, "0").alias("security_code"), "status")


@query("agg7_summary", src.sql(OFFICIAL + """SELECT security_code, count(*) AS compared, count(*) FILTER (status <> 'OFFICIAL_PERIOD_NOT_LOADED') AS comparable,
  count(*) FILTER (status IN ('EXACT_MATCH', 'WITHIN_ROUNDING', 'DERIVED_MATCH', 'MISMATCH', 'SCOPE_CONFLICT')) AS attempted,
    count(*) FILTER (status IN ('EXACT_MATCH', 'WITHIN_ROUNDING', 'DERIVED_MATCH')) AS matched,
  count(*) FILTER (status IN ('MISMATCH', 'SCOPE_CONFLICT')) AS conflicts, count(*) FILTER (status = 'MISSING_OFFICIAL') AS unresolved,
  round(count(*) FILTER (status IN ('EXACT_MATCH', 'WITHIN_ROUNDING', 'DERIVED_MATCH')) / nullif(count(*) FILTER (status IN ('EXACT_MATCH', 'WITHIN_ROUNDING',
    'DERIVED_MATCH', 'MISMATCH', 'SCOPE_CONFLICT')), 0), 6) AS accuracy
FROM cmp GROUP BY ROLLUP (security_code)"""))
def agg7(spark, d):
    out = r.summary(compared(spark, d))
    return out.select("security_code", "compared", "comparable", "attempted", "matched", "conflicts", "unresolved", F.round("accuracy", 6).alias("accuracy"))


@query("agg8_status_groups", src.sql(OFFICIAL + "SELECT status, mode, family, count(*) AS n FROM cmp GROUP BY 1, 2, 3"))
def agg8(spark, d):
    return r.status_groups(compared(spark, d))


@query("jon4_official_only", src.sql(OFFICIAL + """, more AS (SELECT security_code, report_date, field_key, p0, unnest(CASE WHEN k = 4 THEN ['parent'] WHEN k = 5 THEN ['consolidated']
    WHEN k = 6 THEN ['parent', 'other'] ELSE [] END) AS x, k FROM offi)
SELECT security_code, report_date, CASE WHEN k = 5 THEN 'Q9' ELSE p0 END AS period_type, CASE x WHEN 'other' THEN 'cash_flow' ELSE 'income_statement' END AS statement_type,
  CASE x WHEN 'parent' THEN 'parent' ELSE 'consolidated' END AS scope, field_key, 'MISSING_EASTMONEY' AS status FROM more"""))
def jon4(spark, d):
    """Official rows of another period, of parent companies and of another statement beside the one that is compared."""
    cumulative = kept(src.facts_cum(spark, d))
    key = (F.col("security_code").cast("long") * 31 + F.year("report_date") * 4 + F.quarter("report_date")) % 10
    offi = disturbed(cumulative)
    sixth = offi.filter(key == 6)
    offi = offi.unionByName(sixth.withColumn("scope", F.lit("parent"))).unionByName(sixth.withColumn("statement_type", F.lit("cash_flow")))
    facts = r.classified(r.primary(cumulative), r.registry(cumulative)).withColumn("statement_type", F.lit("income_statement"))
    return r.official_only(offi, r.matched(facts, offi)).select(*r.IDENTITY, "status")


@query("rec4_registry", src.sql("""SELECT theme, family, dataset, field_key, CASE WHEN family LIKE '%GBALANCE' OR family LIKE '%GINCOME' THEN 'OFFICIAL_DIRECT'
    ELSE 'OFFICIAL_DERIVED' END AS mode,
  CASE WHEN family LIKE '%GBALANCE' THEN 'balance_sheet' WHEN family LIKE '%DUPONT' THEN 'dupont' ELSE 'income_statement' END AS statement_type, CASE field_key
    WHEN 'QTY' THEN 'integer' ELSE 'numeric' END AS method,
  CASE field_key WHEN 'QTY' THEN 0.5 ELSE 1.0 END AS absolute, CASE field_key WHEN 'QTY' THEN 0.0 ELSE 1e-10 END AS relative FROM facts GROUP BY 1, 2, 3, 4"""))
def rec4(spark, d):
    return r.registry(src.facts(spark, d))


@query("agg6_registry_coverage",
    src.sql("""SELECT CASE WHEN family LIKE '%GBALANCE' OR family LIKE '%GINCOME' THEN 'OFFICIAL_DIRECT' ELSE 'OFFICIAL_DERIVED' END AS mode,
  CASE field_key WHEN 'QTY' THEN 'integer' ELSE 'numeric' END AS method, count(DISTINCT (family, field_key)) AS contexts FROM facts GROUP BY 1, 2"""))
def agg6(spark, d):
    return r.registry_coverage(r.registry(src.facts(spark, d)))


@query("rec3_primary",
    src.sql("x AS (SELECT * FROM facts_cum UNION ALL SELECT * FROM facts_restated) SELECT security_code, report_date, field_key, round(arg_max(value_num, available_at), 4) AS value_num FROM x GROUP BY 1, 2, 3"))
def rec3(spark, d):
    rows = r.primary(src.facts_cum(spark, d).unionByName(src.facts_restated(spark, d)))
    return rows.select("security_code", "report_date", "field_key", F.round("value_num", 4).alias("value_num"))


# A balance and a cash flow from a supplier's fields: assets, liabilities and equity, whose total is off in first quarters;
# changes of cash, without the effect of rates in even years and off in third quarters; some values are suspect.
@query("rec21_identities", src.sql("""w AS (SELECT security_code, report_date, quarter(report_date) AS q, max(value_num) FILTER (field_key = 'REVENUE') AS rev,
    max(value_num) FILTER (field_key = 'COST') AS cost, max(value_num) FILTER (field_key = 'QTY') AS qty FROM facts_cum GROUP BY 1, 2),
v AS (SELECT *, rev + cost AS assets, CASE WHEN q = 4 THEN NULL ELSE rev END AS liab, cost AS equity, rev + cost + CASE WHEN q = 1 THEN 9 ELSE 0 END AS total,
  rev + cost - qty + CASE WHEN year(report_date) % 2 = 1 THEN 5 ELSE 0 END + CASE WHEN q = 3 THEN 7 ELSE 0 END AS change FROM w)
SELECT security_code, report_date, 'BALANCE_ASSETS_EQ_LIAB_PLUS_EQUITY' AS check_id, round(assets, 4) AS left_value, round(liab + equity, 4) AS right_value, 4.0::DOUBLE AS tolerance,
  CASE WHEN liab IS NULL THEN 'UNRESOLVED' ELSE 'PASS' END AS status FROM v
UNION ALL SELECT security_code, report_date, 'BALANCE_ASSETS_EQ_TOTAL_LIAB_EQUITY', round(assets, 4), round(total, 4), 2.0::DOUBLE, CASE WHEN q = 1 THEN 'FAIL' ELSE 'PASS' END FROM v
UNION ALL SELECT security_code, report_date, 'CASHFLOW_NET_CHANGE', round(change, 4), round(rev + cost - qty + CASE WHEN year(report_date) % 2 = 1 THEN 5 ELSE 0 END, 4), 6.0::DOUBLE,
  CASE WHEN q = 3 THEN 'FAIL' ELSE 'PASS' END FROM v"""))
def rec21(spark, d):
    wide = src.facts_cum(spark, d).groupBy("security_code", "report_date").pivot("field_key", ["REVENUE", "COST", "QTY"]).agg(F.first("value_num"))
    q, odd = F.quarter("report_date"), F.year("report_date") % 2 == 1
    rev, cost, qty = F.col("REVENUE"), F.col("COST"), F.col("QTY")
    change = rev + cost - qty + F.when(odd, 5).otherwise(0) + F.when(q == 3, 7).otherwise(0)
    values = {"TOTAL_ASSETS": rev + cost, "TOTAL_LIABILITIES": rev, "TOTAL_EQUITY": cost, "TOTAL_LIAB_EQUITY": rev + cost + F.when(q == 1, 9).otherwise(0), "CCE_ADD": change,
        "NETCASH_OPERATE": rev, "NETCASH_INVEST": cost, "NETCASH_FINANCE": -qty, "RATE_CHANGE_EFFECT": F.when(odd, F.lit(5.0))}
    suspect = lambda k: F.when((q == 4) & F.lit(k == "TOTAL_LIABILITIES"), "PARSE_SUSPECT").otherwise("FACT_DIRECT")
    each = [F.struct(F.lit(k).alias("field_key"), v.alias("value_num"), suspect(k).alias("source_status")) for k, v in values.items()]
    rows = wide.select("security_code", "report_date", F.inline(F.array(*each))).withColumn("precision_tolerance", F.lit(2.0))
    out = r.identities(rows).select("security_code", "report_date", "check_id", "left_value", "right_value", "tolerance", "status")
    return out.withColumns({"left_value": F.round("left_value", 4), "right_value": F.round("right_value", 4)})


@query("rec23_note_numbers", "SELECT o_orderkey, o_orderkey % 3 = 0 AS suspect FROM orders")
def rec23(spark, d):
    k = F.col("o_orderkey") % 3
    line = F.when(k == 0, "递延所得税资产 七、29").when(k == 1, "递延所得税资产 七、29 1,234.50").otherwise("递延 5,000 七、29")
    return src.table(spark, d, "orders").select("o_orderkey", r.note_as_amount(line, F.lit(29.0), F.lit("balance_sheet")).alias("suspect"))


CUT = datetime.date(2000, 10, 1)


def two_sources(spark, d):
    """Cumulative facts of one source, and the official values of the same, some suspect, some 1 % off."""
    a = src.facts_cum(spark, d).withColumns({"source": F.lit("EASTMONEY"), "scope": F.lit("consolidated")})
    k = F.col("security_code").cast("int") % 4
    b = a.filter(k != 3).withColumns({
        "source": F.lit("OFFICIAL_DISCLOSURE"), "value_num": F.when(k == 1, F.col("value_num") * 1.01).otherwise(F.col("value_num") / 10000),
        "unit": F.when(k == 1, F.col("unit")).otherwise("万元"), "source_status": F.when(k == 2, "PARSE_SUSPECT").otherwise("FACT_DIRECT"),
    })
    # the same fact of another event is another observation
    again = a.withColumns({"event_date": F.date_add("event_date", 7), "value_num": F.col("value_num") * 2})
    return a.unionByName(b).unionByName(again)


def lineage(spark, d):
    metrics = spark.createDataFrame([("REVENUE", "income.revenue"), ("COST", "income.cost")], "field_key string, metric_id string")
    return m.lineage(m.source_facts(two_sources(spark, d), F.lit(CUT), metrics))


OBS = """k AS (SELECT * REPLACE (CASE WHEN later THEN CAST(event_date + 7 AS DATE) ELSE event_date END AS event_date, value_num * CASE WHEN later THEN 2 ELSE 1 END AS value_num),
  CASE WHEN later THEN 3 ELSE CAST(security_code AS INT) % 4 END AS c, CASE field_key WHEN 'REVENUE' THEN 'income.revenue' WHEN 'COST' THEN 'income.cost'
    ELSE 'source.' || family || '.QTY' END AS metric_id FROM facts_cum, (SELECT unnest([false, true]) AS later) WHERE available_at <= DATE '2000-10-01')
"""


@query("map3_observations", src.sql(OBS + """SELECT security_code, metric_id, report_date, event_date, CASE c WHEN 0 THEN 'VERIFIED_MULTI_SOURCE'
    WHEN 1 THEN 'SOURCE_CONFLICT' ELSE 'SINGLE_SOURCE' END AS status,
  CASE c WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS confidence, round(CASE WHEN c <> 1 THEN value_num END, 4) AS value_num, CASE
    WHEN c = 3 THEN 1 ELSE 2 END AS sources FROM k"""))
def map3(spark, d):
    return m.observations(lineage(spark, d)).select("security_code", "metric_id", "report_date", "event_date", "status", "confidence",
        F.round("value_num", 4).alias("value_num"), "sources")


@query("map4_lineage", src.sql(OBS + """SELECT security_code, metric_id, report_date, event_date, 'EASTMONEY' AS source, CASE c WHEN 0 THEN 'SUPPORTING'
    WHEN 1 THEN 'CONFLICTING' ELSE 'SELECTED' END AS role FROM k
UNION ALL SELECT security_code, metric_id, report_date, event_date, 'OFFICIAL_DISCLOSURE', CASE c WHEN 0 THEN 'SELECTED' WHEN 1 THEN 'SUPPORTING' ELSE 'QUARANTINED' END FROM k WHERE c <> 3"""))
def map4(spark, d):
    return lineage(spark, d).select("security_code", "metric_id", "report_date", "event_date", "source", "role")


@query("agg10_mapping_coverage", src.sql(OBS + """SELECT CASE c WHEN 0 THEN 'VERIFIED_MULTI_SOURCE' WHEN 1 THEN 'SOURCE_CONFLICT'
    ELSE 'SINGLE_SOURCE' END AS status, CASE c WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS confidence,
  count(*) AS n, CAST(sum(CASE WHEN c = 3 THEN 1 ELSE 2 END) AS BIGINT) AS sources FROM k GROUP BY 1, 2"""))
def agg10(spark, d):
    return m.mapping_coverage(m.observations(lineage(spark, d)))


@query("map10_topics", """SELECT p_partkey, topic FROM part, (SELECT unnest(['SMALL', 'COLOUR']) AS topic) WHERE (topic = 'SMALL' AND (contains(upper(p_name),
    'SMALL') OR contains(upper(p_type), 'SMALL') OR contains(upper(p_brand), 'SMALL')))
  OR (topic = 'COLOUR' AND (contains(upper(p_name), 'RED') OR contains(upper(p_name), 'BLUE') OR contains(upper(p_type), 'RED') OR contains(upper(p_type), 'BLUE')))""")
def map10(spark, d):
    rows = src.table(spark, d, "part").select("p_partkey", F.col("p_type").alias("field_key"), F.col("p_name").alias("field_name_cn"),
        F.col("p_brand").alias("family"))
    return m.topics(rows, {"SMALL": ["small"], "COLOUR": ["red", "blue"]}).select("p_partkey", "topic")


@query("map10_default_topics", """WITH k AS (SELECT p_partkey, ['RD_INPUT', 'SHARE_CAPITAL', 'DIVIDEND_PLAN', 'X', 'CASH'][p_partkey % 5 + 1] AS key, ['研发人员', '董事会', '诉讼', '收入'][p_partkey % 4 + 1] AS label FROM part)
SELECT p_partkey, topic FROM k, (VALUES ('research_and_development', 'RD_INPUT', '研发人员'), ('capital_structure', 'SHARE_CAPITAL', ''), ('capital_events', 'DIVIDEND_PLAN', ''),
  ('corporate_governance', '', '董事会'), ('risk_events', '', '诉讼')) t(topic, a, b) WHERE key = a OR label = b""")
def map10_default(spark, d):
    at = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (F.col("p_partkey") % n + 1).cast("int"))
    rows = src.table(spark, d, "part").select("p_partkey", at(5, "rd_input", "share_capital", "Dividend_Plan", "X", "CASH").alias("field_key"),
        at(4, "研发人员", "董事会", "诉讼", "收入").alias("field_name_cn"), F.lit("F10").alias("family"))
    return m.topics(rows).select("p_partkey", "topic")


@query("map11_coverage_gaps", """WITH u AS (SELECT DISTINCT user_id FROM events), r(topic, metric, kind) AS (VALUES ('profit_quality', 'financial.parent_net_profit', 'click'),
  ('profit_quality', 'profit_quality.adjusted_parent_net_profit', 'view'), ('profit_quality', 'cashflow.operating_cash_flow', ''), ('profit_quality', 'cashflow.capital_expenditure', ''),
  ('research_and_development', 'research.rd_expense', 'purchase'), ('capital_structure', 'capital.total_shares', ''))
SELECT user_id AS security_code, topic, metric AS required_metric_id, CASE WHEN EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = r.kind) THEN 'PRESENT'
  ELSE 'MISSING' END AS status, 'gap_' || left(sha256(user_id || '|' || topic || '|' || metric), 24) AS gap_id FROM u, r""")
def map11(spark, d):
    kinds = {"click": "financial.parent_net_profit", "view": "profit_quality.adjusted_parent_net_profit", "purchase": "research.rd_expense"}
    metric = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type")), F.lit("other"))
    return m.coverage_gaps(src.table(spark, d, "events").select(F.col("user_id").alias("security_code"), metric.alias("metric_id")))


def edges(spark, d):
    """Order to customer to nation to region."""
    node = lambda kind, c: F.concat(F.lit(f"{kind}-"), F.col(c).cast("string"))
    o = src.table(spark, d, "orders").select(node("order", "o_orderkey").alias("from_id"), node("customer", "o_custkey").alias("to_id"))
    c = src.table(spark, d, "customer").select(node("customer", "c_custkey").alias("from_id"), node("nation", "c_nationkey").alias("to_id"))
    n = src.table(spark, d, "nation").select(node("nation", "n_nationkey").alias("from_id"), node("region", "n_regionkey").alias("to_id"))
    return o.unionByName(c).unionByName(n)


EDGES = """e AS (SELECT 'order-' || o_orderkey AS from_id, 'customer-' || o_custkey AS to_id FROM orders UNION ALL SELECT 'customer-' || c_custkey, 'nation-' || c_nationkey FROM customer
  UNION ALL SELECT 'nation-' || n_nationkey, 'region-' || n_regionkey FROM nation)"""


@query("grf4_traced",
    f"""WITH RECURSIVE {EDGES}, t AS (SELECT 'order-' || o_orderkey AS start, 'order-' || o_orderkey AS node, 0 AS depth FROM orders WHERE o_totalprice > 400000
  UNION ALL SELECT t.start, e.to_id, t.depth + 1 FROM t JOIN e ON t.node = e.from_id WHERE t.depth < 4) SELECT start, node, min(depth) AS depth FROM t GROUP BY 1, 2""")
def grf4(spark, d):
    starts = src.table(spark, d, "orders").filter("o_totalprice > 400000").select(F.concat(F.lit("order-"),
        F.col("o_orderkey").cast("string")).alias("node_id"))
    return m.traced(edges(spark, d), starts)


@query("grf6_graph_quality", f"""WITH {EDGES}, i AS (SELECT DISTINCT from_id FROM e) SELECT DISTINCT 'DANGLING_EDGE' AS problem, from_id || '>' || to_id AS id
    FROM e WHERE to_id NOT IN (SELECT from_id FROM i)
UNION ALL SELECT 'TYPE_COLLISION', 'nation-' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0""")
def grf6(spark, d):
    e = edges(spark, d).withColumn("edge_id", F.concat_ws(">", "from_id", "to_id"))
    kind = F.substring_index("node_id", "-", 1)
    nodes = e.select(F.col("from_id").alias("node_id")).distinct().withColumn("node_type", kind)
    twice = nodes.filter("node_type = 'nation' and cast(substring_index(node_id, '-', -1) as int) % 2 = 0").withColumn("node_type", F.lit("COUNTRY"))
    return m.graph_quality(nodes.unionByName(twice), e)


@query("grf1_first_definitions",
    "SELECT 'customer-' || c_custkey AS node_id, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'BUYER' ELSE 'CUSTOMER' END AS node_type FROM customer")
def grf1(spark, d):
    name = lambda c: F.concat(F.lit("customer-"), F.col(c).cast("string")).alias("node_id")
    a = src.table(spark, d, "orders").select(name("o_custkey"), F.lit("BUYER").alias("node_type"), F.lit("").alias("label"), F.lit(0).alias("precedence"))
    b = src.table(spark, d, "customer").select(name("c_custkey"), F.lit("CUSTOMER").alias("node_type"), F.lit("").alias("label"), F.lit(1).alias("precedence"))
    return m.first_definitions(a.unionByName(b)).select("node_id", "node_type")


@query("doc1_page_titles", "SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1))) AS anchors, 'good' AS quality FROM pages")
def doc1(spark, d):
    out = doc.parsed(src.table(spark, d, "pages"))
    return out.select("page_id", F.size("links").alias("anchors"), "quality")


@query("doc3_gates", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'HTTP_403' WHEN 1 THEN 'HTTP_404' WHEN 2 THEN 'JS_REQUIRED' WHEN 3 THEN 'CAPTCHA_REQUIRED'
    WHEN 4 THEN 'LOGIN_REQUIRED' ELSE 'DOWNLOAD_OK' END AS gate FROM pages""")
def doc3(spark, d):
    k = F.col("page_id") % 6
    status = F.when(k == 0, 403).when(k == 1, 404).otherwise(200)
    html = F.when(k == 2, "<p>Please Enable JavaScript</p>").when(k == 3, "请输入验证码").when(k == 4, "Login required").otherwise(F.col("html"))
    return src.table(spark, d, "pages").select("page_id", doc.gate(status, html).alias("gate"))


@query("doc7_domains", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS domain FROM pages")
def doc7(spark, d):
    return src.table(spark, d, "pages").select("page_id", doc.domain(F.col("url")).alias("domain"))


@query("doc10_amounts", "SELECT o_orderkey, [-CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE), CAST(o_custkey AS DOUBLE)] AS amounts FROM orders")
def doc10(spark, d):
    line = F.concat(F.lit("净额 （"), F.regexp_replace(F.format_number("o_totalprice", 2), ",", "，"), F.lit("） "), F.col("o_custkey").cast("string"))
    return src.table(spark, d, "orders").select("o_orderkey", doc.amounts(line).alias("amounts"))


@query("doc9_extracted", """SELECT CAST(o_custkey AS VARCHAR) AS document_id, 'TOTAL' AS field_key, CAST(CAST(arg_min(o_totalprice,
    o_orderkey) AS DECIMAL(18,2)) AS DOUBLE) AS value FROM orders GROUP BY 1""")
def doc9(spark, d):
    rows = src.table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_totalprice", "o_orderkey").alias("v"))
    k, v = F.col("o_custkey") % 3, F.format_number("v", 2)
    label = F.when(k == 0, "Grand total").when(k == 1, "Grand total (7)\n").otherwise(F.lit(None))
    after = F.when(k == 2, "Grand total（12）\n \n")  # a label after its amount
    text = F.concat_ws("\n", F.lit("Report 2001"), label, F.concat(v, F.lit("  7")), after, F.lit("Other 5"))
    found = doc.extracted(rows.select(F.col("o_custkey").cast("string").alias("document_id"), text.alias("text")),
        spark.createDataFrame([("grand total", "TOTAL")], "label string, field_key string"))
    return found.select("document_id", "field_key", "value")
