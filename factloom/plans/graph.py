"""Queries of the evidence graph over pages, orders and customers, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import graph as g
from factloom.operators import mapping
from factloom.sources import facts as src

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


def inputs(spark, d):
    """Pages as documents, each superseding the one a hundred before; orders as source facts, customers as observations."""
    code = lambda c: F.lpad((F.col(c) % 100).cast("string"), 6, "0").alias("security_code")
    page = F.col("page_id")
    documents = src.table(spark, d, "pages").select(
        code("page_id"), page.cast("string").alias("document_id"), F.col("url").alias("source_url"), F.lit("").alias("source_document"),
            F.lit(None).cast("string").alias("document_title"),
        F.lit("2024-12-31").alias("report_date"), F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), (page % 300).cast("int")),
            "yyyy-MM-dd").alias("available_at"),
        F.when(page >= 100, (page - 100).cast("string")).alias("supersedes_document_id"), F.lit("").alias("parsed_text_path"),
            F.sha2("html", 256).alias("text_sha256"),
        F.when(F.col("url").isNotNull(), F.array(F.struct(F.lit("a.pdf").alias("file_name"), F.col("url").alias("source_url")))).alias("attachments"),
    )
    orders = src.table(spark, d, "orders")
    fact_id, observation = F.concat(F.lit("src_"), "o_orderkey"), F.concat(F.lit("obs_"), "o_custkey")
    facts = orders.select(
        code("o_custkey"), fact_id.alias("source_fact_id"), F.col("o_orderpriority").alias("field_key"), F.col("o_custkey").cast("string").alias("document_id"),
            F.lit("").alias("source_url"),
        F.lit("").alias("source_document"), F.when(F.col("o_orderstatus") == "F", F.year("o_orderdate")).alias("source_page"), F.lit("").alias("source_row"),
    )
    observations = src.table(spark, d, "customer").select(code("c_custkey"), F.concat(F.lit("obs_"), "c_custkey").alias("observation_id"),
        F.col("c_mktsegment").alias("metric_id"))
    role = F.when(F.col("o_orderstatus") == "F", "SELECTED").when(F.col("o_orderstatus") == "O", "CONFLICTING").otherwise("OTHER")
    lineage = orders.select(observation.alias("observation_id"), fact_id.alias("source_fact_id"), role.alias("role"), F.lit(60).alias("priority"))
    return documents, facts, observations, lineage


INPUTS = """d AS (SELECT lpad(CAST(page_id % 100 AS VARCHAR), 6, '0') AS c, 'doc_' || page_id AS id, url, page_id, CASE
    WHEN page_id >= 100 THEN 'doc_' || (page_id - 100) END AS old, sha256(html) AS h FROM pages),
s AS (SELECT lpad(CAST(o_custkey % 100 AS VARCHAR), 6, '0') AS c, 'src_' || o_orderkey AS id, o_orderpriority AS k, 'doc_' || o_custkey AS doc, CASE
    WHEN o_orderstatus = 'F' THEN year(CAST(o_orderdate AS DATE)) END AS page,
  'obs_' || o_custkey AS obs, CASE o_orderstatus WHEN 'F' THEN 'SELECTED_FOR' WHEN 'O' THEN 'CONFLICTS_WITH' ELSE 'SUPPORTS' END AS role FROM orders),
o AS (SELECT lpad(CAST(c_custkey % 100 AS VARCHAR), 6, '0') AS c, 'obs_' || c_custkey AS id, c_mktsegment AS m FROM customer),
n0 AS (SELECT DISTINCT 'security_' || c AS node_id, 'SECURITY' AS node_type, c AS security_code, c AS label, 0 AS p FROM (SELECT c FROM d UNION SELECT c FROM s UNION SELECT c FROM o)
  UNION ALL SELECT id, 'DOCUMENT', c, id, 0 FROM d UNION ALL SELECT old, 'DOCUMENT', c, old, 1 FROM d WHERE old IS NOT NULL
  UNION ALL SELECT 'parsed_' || substr(sha256(id || '||' || h), 1, 24), 'PARSED_TEXT', c, h, 0 FROM d WHERE h IS NOT NULL
  UNION ALL SELECT 'attachment_' || substr(sha256(id || '|' || url || '|a.pdf'), 1, 24), 'ATTACHMENT', c, 'a.pdf', 0 FROM d WHERE url IS NOT NULL
  UNION ALL SELECT id, 'SOURCE_FACT', c, k, 0 FROM s UNION ALL SELECT DISTINCT doc, 'DOCUMENT', c, doc, 2 FROM s
  UNION ALL SELECT DISTINCT 'loc_' || substr(sha256(doc || '|' || page || '|'), 1, 24), 'EVIDENCE_LOCATION', c, doc || ' p.' || page, 0 FROM s WHERE page IS NOT NULL
  UNION ALL SELECT id, 'CANONICAL_OBSERVATION', c, m, 0 FROM o),
nodes AS (SELECT node_id, node_type, security_code, label FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY p, node_type, security_code, label) AS n FROM n0) WHERE n = 1),
edges AS (SELECT DISTINCT * FROM (SELECT id AS from_id, 'security_' || c AS to_id, 'DESCRIBES_SECURITY' AS edge_type FROM d UNION ALL SELECT id, old,
    'SUPERSEDES' FROM d WHERE old IS NOT NULL
  UNION ALL SELECT 'parsed_' || substr(sha256(id || '||' || h), 1, 24), id, 'PARSED_FROM' FROM d WHERE h IS NOT NULL
    UNION ALL SELECT 'attachment_' || substr(sha256(id || '|' || url || '|a.pdf'), 1, 24), id, 'ATTACHED_TO' FROM d WHERE url IS NOT NULL
  UNION ALL SELECT id, 'security_' || c, 'DESCRIBES_SECURITY' FROM s UNION ALL SELECT doc, 'security_' || c, 'DESCRIBES_SECURITY' FROM s UNION ALL SELECT id,
    doc, 'DERIVED_FROM_DOCUMENT' FROM s
  UNION ALL SELECT id, 'loc_' || substr(sha256(doc || '|' || page || '|'), 1, 24), 'LOCATED_AT' FROM s WHERE page IS NOT NULL
    UNION ALL SELECT 'loc_' || substr(sha256(doc || '|' || page || '|'), 1, 24), doc, 'PART_OF_DOCUMENT' FROM s WHERE page IS NOT NULL
  UNION ALL SELECT id, 'security_' || c, 'DESCRIBES_SECURITY' FROM o UNION ALL SELECT obs, id, role FROM s))"""


@query("grf1_nodes", f"WITH {INPUTS} SELECT * FROM nodes")
def grf1_nodes(spark, d):
    documents, facts, observations, _ = inputs(spark, d)
    return g.nodes(documents, facts, observations).select("node_id", "node_type", "security_code", "label")


@query("grf2_edges", f"WITH {INPUTS} SELECT * FROM edges")
def grf2(spark, d):
    return g.edges(*inputs(spark, d)).select("from_id", "to_id", "edge_type")


@query("grf5_versions", """SELECT lpad(CAST(page_id % 100 AS VARCHAR), 6, '0') AS security_code, 'doc_' || page_id AS node_id, CASE
    WHEN page_id >= 100 THEN 'doc_' || (page_id - 100) END AS supersedes,
  row_number() OVER (PARTITION BY page_id % 100 ORDER BY page_id % 300 DESC, 'doc_' || page_id)::INT AS version_rank FROM pages""")
def grf5(spark, d):
    documents, facts, observations, lineage = inputs(spark, d)
    none = facts.limit(0)
    return g.versions(g.nodes(documents, none, observations), g.edges(documents, none, observations, lineage)).select("security_code", "node_id", "supersedes",
        "version_rank")


@query("agg12_graph_quality",
    f"""WITH {INPUTS}, l AS (SELECT DISTINCT from_id AS id FROM edges WHERE edge_type IN ('SELECTED_FOR', 'SUPPORTS', 'CONFLICTS_WITH')),
m AS (SELECT 'nodes' AS measure, node_type AS kind, count(*) AS n, NULL::DOUBLE AS share FROM nodes GROUP BY 2 UNION ALL SELECT 'edges', edge_type, count(*), NULL FROM edges GROUP BY 2
UNION ALL SELECT 'dangling_edges', NULL, (SELECT count(*) FROM edges WHERE from_id NOT IN (SELECT node_id FROM nodes) OR to_id NOT IN (SELECT node_id
    FROM nodes)), NULL UNION ALL SELECT 'duplicate_nodes', NULL, 0, NULL UNION ALL SELECT 'duplicate_edges', NULL, 0, NULL
UNION ALL SELECT x, NULL, (SELECT count(*) FROM o WHERE id IN (SELECT id FROM l)), (SELECT count(*) FROM o WHERE id IN (SELECT id FROM l)) / (SELECT count(*)
    FROM o) FROM (SELECT unnest(['observations_with_lineage', 'observations_with_evidence']) AS x))
SELECT * FROM m UNION ALL SELECT 'status', CASE WHEN (SELECT max(n) FROM m WHERE measure = 'dangling_edges') > 0 OR (SELECT min(share) FROM m) < 1 THEN 'FAIL' ELSE 'PASS' END, NULL, NULL""")
def agg12(spark, d):
    documents, facts, observations, lineage = inputs(spark, d)
    return g.quality(g.nodes(documents, facts, observations), g.edges(documents, facts, observations, lineage))


METRIC = """m AS (SELECT *, CASE field_key WHEN 'REVENUE' THEN 'financial.revenue' WHEN 'COST' THEN 'cashflow.operating_cash_flow' ELSE 'source.' || lower(family) || '.qty' END AS metric_id,
  CASE field_key WHEN 'REVENUE' THEN 'financial_statements' WHEN 'COST' THEN 'profit_quality' ELSE 'coverage_and_gaps' END AS research_module FROM facts)"""


def mapped(spark, d):
    key = F.when(F.col("field_key") == "REVENUE", "OPERATE_INCOME").when(F.col("field_key") == "COST", "netcash_operate").otherwise("QTY")
    return mapping.resolved(src.facts(spark, d).withColumns({"field_key": key, "scope": F.lit("consolidated")}))


@query("map1_resolved",
    src.sql(METRIC + " SELECT security_code, family, report_date, metric_id, research_module, CASE field_key WHEN 'QTY' THEN '股' ELSE '元' END AS unit, CASE field_key WHEN 'QTY' THEN data_semantics ELSE 'flow' END AS data_semantics, field_key <> 'QTY' AS known FROM m"))
def map1(spark, d):
    return mapped(spark, d).select("security_code", "family", "report_date", "metric_id", "research_module", "unit", "data_semantics", "known")


@query("map6_module_views", src.sql(METRIC + """ SELECT security_code, research_module, metric_id, report_date, period_type,
  row_number() OVER (PARTITION BY security_code, research_module ORDER BY metric_id, report_date, period_type)::INT AS module_rank FROM m WHERE family = 'RPT_F10_FINANCE_GINCOME'"""))
def map6(spark, d):
    rows = mapping.module_ranks(mapped(spark, d).filter("family = 'RPT_F10_FINANCE_GINCOME'"))
    return rows.select("security_code", "research_module", "metric_id", "report_date", "period_type", "module_rank")


@query("map7_direct_profit_quality",
    src.sql("SELECT security_code, family, report_date, 'cashflow.operating_cash_flow' AS metric_id, value_num, 'profit_quality' AS topic FROM facts WHERE field_key = 'COST'"))
def map7(spark, d):
    return mapping.direct_topic_rows(mapped(spark, d)).select("security_code", "family", "report_date", "metric_id", "value_num", "topic")


@query("map12_section_summary",
    "SELECT 'orders' AS section, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'lines', l_linestatus, count(*) FROM lineitem GROUP BY 2")
def map12(spark, d):
    return mapping.section_summary({"orders": src.table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"),
        "lines": src.table(spark, d, "lineitem").withColumnRenamed("l_linestatus", "status")})


@query("jon9_lineage_view", """SELECT 'obs_' || c_custkey AS observation_id, 'src_' || o_orderkey AS source_fact_id, CASE WHEN o_orderkey IS NULL THEN NULL
    ELSE CAST(floor(o_totalprice) AS INT) END AS source_priority, o_orderpriority AS field_key,
  row_number() OVER (PARTITION BY c_custkey ORDER BY CAST(floor(o_totalprice) AS INT) DESC NULLS LAST, 'src_' || o_orderkey)::INT AS lineage_rank FROM customer
    LEFT JOIN orders ON o_custkey = c_custkey""")
def jon9(spark, d):
    _, facts, observations, lineage = inputs(spark, d)
    price = src.table(spark, d, "orders").select(F.concat(F.lit("src_"), "o_orderkey").alias("source_fact_id"),
        F.floor("o_totalprice").cast("int").alias("source_priority"))
    rows = mapping.lineage_view(lineage.join(price, "source_fact_id"), facts.drop("security_code"), observations)
    return rows.select("observation_id", "source_fact_id", "source_priority", "field_key", "lineage_rank")
