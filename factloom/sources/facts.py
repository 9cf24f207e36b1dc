"""Fact tables derived from the order tables: the shape of company facts, a security for each supplier.

facts_quarter has independent quarters, facts_cum running sums within the year, facts_point running sums of all time
and facts_decoy tenfold values in a family of low priority; every seventh cumulative fact has a later restatement.
SQL holds the same definitions for another engine, as common table expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.lineage import kept

QUARTER_FAMILY = "RPT_F10_FINANCE_GINCOMEQC"
CUMULATIVE_FAMILY = "RPT_F10_FINANCE_GINCOME"
POINT_FAMILY = "RPT_F10_FINANCE_GBALANCE"
DECOY_FAMILY = "RPT_F10_FINANCE_DUPONT"
OTHER_FAMILIES = ["RPT_F10_FINANCE_QGRATIO", "RPT_F10_QTR_MAINFINADATA", "RPT_F10_FINANCE_GRATIO"]
FIELDS = {"REVENUE": "Operating revenue", "COST": "Operating cost", "QTY": "Quantity sold"}
#: Parts that facts are dealt into, for each part that the items are read in, and the most bytes of items for each of them.
PARTS = 8
SHARE = 1 << 20

COLUMNS = [
    "security_code", "theme", "family", "dataset", "record_key", "report_date", "event_date", "available_at", "period_type",
    "field_key", "field_name_cn", "field_category", "value_text", "value_num", "unit", "source_url", "source_status", "data_semantics",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_bytes(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Bytes of a table's files, by their listing; none is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{sf_dir}/{name}.parquet")
    return files.agg(F.sum("length")).first()[0] or 0


def money(x: Column) -> Column:
    return x.cast("decimal(18,4)")


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(security_code, s, report_date, REVENUE, COST, QTY decimal): what each supplier sold in each quarter, one pass with
    partial sums.

    Dealt by security once, into parts that grow in number with the table's bytes, so that what follows goes by security
    without another shuffle and a task's share stays as it is; left to itself, adaptive execution makes as few parts as
    there are cores of these small rows, which become many wide facts. Splits alone don't tell: up to 128 MB for each core
    their number is that of the cores.
    """
    items = table(spark, sf_dir, "lineitem")
    end = F.last_day(F.make_date(F.year("l_shipdate"), F.quarter("l_shipdate") * 3, F.lit(1)))
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    sums = items.groupBy(F.col("l_suppkey").alias("s"), end.alias("report_date")).agg(
        F.sum(money(price * (1 - discount))).alias("REVENUE"),
        F.sum(money(price * discount)).alias("COST"),
        F.sum(money(F.col("l_quantity"))).alias("QTY"),
    )
    coded = sums.select(F.lpad(F.col("s").cast("string"), 6, "0").alias("security_code"), "*")
    parts = max(PARTS * items.rdd.getNumPartitions(), math.ceil(stored_bytes(spark, sf_dir, "lineitem") / SHARE))
    return coded.repartition(parts, "security_code")


def quarters_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quarters(), computed once for plans that make facts of them several times, and dealt by security as they were."""
    sold = kept(quarters(spark, sf_dir))
    return sold.repartition(sold.rdd.getNumPartitions(), "security_code")


def period_type(date: Column, independent: bool) -> Column:
    names = ["Q1", "Q2", "Q3", "Q4"] if independent else ["Q1", "H1", "Q3C", "FY"]
    return F.element_at(F.array(*map(F.lit, names)), F.quarter(date))


# What each family's values are: of the quarter (q), running within the year (y) or running on (p), times a number.
VALUES = {
    QUARTER_FAMILY: ("q", 1, "flow"),
    CUMULATIVE_FAMILY: ("y", 1, "flow"),
    POINT_FAMILY: ("p", 1, "point_in_time"),
    DECOY_FAMILY: ("y", 10, "flow"),
    **{f: ("q", 1, "flow") for f in OTHER_FAMILIES},
}


def _as_facts(spark: SparkSession, sf_dir: str, *families: str, fields: dict[str, list[str]] | None = None, sold: DataFrame | None = None) -> DataFrame:
    """The facts of these families: running sums beside the quarters, then a row for each family and field.

    fields: of families that only some fields are wanted of, these; sold: quarters(), if they are there already.
    """
    kinds = {VALUES[f][0] for f in families}
    rows = quarters(spark, sf_dir) if sold is None else sold
    rows = rows.select("security_code", "s", "report_date", F.struct(*FIELDS).alias("q"), *FIELDS)
    for kind, keys in (("y", [F.year("report_date")]), ("p", [])):
        if kind in kinds:
            upto = Window.partitionBy("security_code", "s", *keys).orderBy("report_date").rowsBetween(Window.unboundedPreceding, 0)
            rows = rows.withColumn(kind, F.struct(*[F.sum(c).over(upto).alias(c) for c in FIELDS]))
    each = []
    for family in families:
        kind, times, semantics = VALUES[family]
        for field in (fields or {}).get(family, FIELDS):
            v = F.col(f"{kind}.{field}")
            each.append(F.struct(
                F.lit(family).alias("family"), F.lit(field).alias("field_key"), F.lit(FIELDS[field]).alias("field_name_cn"), F.lit(semantics).alias("semantics"),
                F.lit(3 if family in OTHER_FAMILIES else 1).alias("times"), money(v if times == 1 else v * times).alias("v"),
            ))
    rows = rows.select("security_code", "s", "report_date", F.explode(F.array(*each)).alias("x")).select("security_code", "s", "report_date", "x.*")
    independent = F.col("family").isin(QUARTER_FAMILY, *OTHER_FAMILIES)
    return rows.select(
        "security_code",
        F.lit("Finance").alias("theme"),
        "family",
        F.lit("main").alias("dataset"),
        F.concat_ws("|", "security_code", "family", F.col("report_date").cast("string")).alias("record_key"),
        "report_date",
        F.col("report_date").alias("event_date"),
        F.date_add("report_date", (F.col("s") % 60).cast("int")).alias("available_at"),
        F.when(independent, period_type(F.col("report_date"), True)).otherwise(period_type(F.col("report_date"), False)).alias("period_type"),
        "field_key",
        "field_name_cn",
        F.lit("STATEMENT").alias("field_category"),
        F.col("v").cast("string").alias("value_text"),
        (F.col("v").cast("double") * F.col("times")).alias("value_num"),
        F.when(F.col("field_key") == "QTY", "股").otherwise("元").alias("unit"),
        F.lit("").alias("source_url"),
        F.lit("FACT_DIRECT").alias("source_status"),
        F.col("semantics").alias("data_semantics"),
    )


def facts_quarter(spark: SparkSession, sf_dir: str, sold: DataFrame | None = None) -> DataFrame:
    return _as_facts(spark, sf_dir, QUARTER_FAMILY, sold=sold)


def facts_cum(spark: SparkSession, sf_dir: str, sold: DataFrame | None = None) -> DataFrame:
    return _as_facts(spark, sf_dir, CUMULATIVE_FAMILY, sold=sold)


def facts_cum_and_decoy(spark: SparkSession, sf_dir: str, sold: DataFrame | None = None) -> DataFrame:
    return _as_facts(spark, sf_dir, CUMULATIVE_FAMILY, DECOY_FAMILY, sold=sold)


def facts_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_facts(spark, sf_dir, POINT_FAMILY)


def facts_decoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_facts(spark, sf_dir, DECOY_FAMILY)


def _restatement() -> tuple[Column, dict[str, Column]]:
    """Which cumulative facts are restated, and what changes: 1 % higher and known 90 days later."""
    more = money(money(F.col("value_text")) * F.lit("1.01").cast("decimal(4,2)"))
    hit = (F.col("security_code").cast("long") * 31 + F.year("report_date") * 4 + F.quarter("report_date")) % 7 == 0
    return hit, {"value_text": more.cast("string"), "value_num": more.cast("double"), "available_at": F.date_add("available_at", 90)}


def facts_restated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh cumulative fact again, 1 % higher and known 90 days later."""
    hit, new = _restatement()
    return facts_cum(spark, sf_dir).filter(hit).withColumns(new)


def with_restatements(rows: DataFrame) -> DataFrame:
    """Facts of any families, and beside every seventh cumulative one its restatement, where they are."""
    hit, new = _restatement()
    old = F.struct(*new)
    both = F.when(hit & (F.col("family") == CUMULATIVE_FAMILY), F.array(old, F.struct(*[v.alias(c) for c, v in new.items()]))).otherwise(F.array(old))
    each = rows.withColumn("r__x", F.explode(both))
    return each.select(*[F.col(f"r__x.{c}").alias(c) if c in new else F.col(c) for c in rows.columns])


def finance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue and cost running within the year, with restatements, quantities running on, and quarters of cost: one pass."""
    fields = {CUMULATIVE_FAMILY: ["REVENUE", "COST"], POINT_FAMILY: ["QTY"], QUARTER_FAMILY: ["COST"]}
    return with_restatements(_as_facts(spark, sf_dir, *fields, fields=fields))


def facts_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threefold quarters in three families that neither add up to a year nor run through one."""
    return _as_facts(spark, sf_dir, *OTHER_FAMILIES)


def everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    """facts and facts_other."""
    return _as_facts(spark, sf_dir, QUARTER_FAMILY, CUMULATIVE_FAMILY, POINT_FAMILY, DECOY_FAMILY, *OTHER_FAMILIES)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of them but the restatements and the other families."""
    return _as_facts(spark, sf_dir, QUARTER_FAMILY, CUMULATIVE_FAMILY, POINT_FAMILY, DECOY_FAMILY)


def _sql(name: str, source: str, family: str, kinds: str, semantics: str, times: str = "") -> str:
    return f"""{name} AS (
  SELECT lpad(CAST(s AS VARCHAR), 6, '0') AS security_code, 'Finance' AS theme, '{family}' AS family, 'main' AS dataset,
         lpad(CAST(s AS VARCHAR), 6, '0') || '|{family}|' || CAST(report_date AS VARCHAR) AS record_key, report_date,
         report_date AS event_date, CAST(report_date + CAST(s % 60 AS INT) AS DATE) AS available_at,
         ({kinds})[CAST(quarter(report_date) AS INT)] AS period_type, field_key,
         CASE field_key WHEN 'REVENUE' THEN 'Operating revenue' WHEN 'COST' THEN 'Operating cost' ELSE 'Quantity sold' END AS field_name_cn,
         'STATEMENT' AS field_category, CAST(CAST(v{times} AS DECIMAL(18,4)) AS VARCHAR) AS value_text,
         CAST(CAST(v{times} AS DECIMAL(18,4)) AS DOUBLE) AS value_num, CASE field_key WHEN 'QTY' THEN '股' ELSE '元' END AS unit,
         '' AS source_url, 'FACT_DIRECT' AS source_status, '{semantics}' AS data_semantics
  FROM {source})"""


SQL = f"""q3 AS (
  SELECT l_suppkey AS s, last_day(make_date(year(l_shipdate), quarter(l_shipdate) * 3, 1)) AS report_date,
         sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS rev,
         sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))) AS cost, sum(CAST(l_quantity AS DECIMAL(18,4))) AS qty
  FROM lineitem GROUP BY 1, 2),
q1 AS (SELECT s, report_date, 'REVENUE' AS field_key, rev AS v FROM q3 UNION ALL SELECT s, report_date, 'COST', cost FROM q3
       UNION ALL SELECT s, report_date, 'QTY', qty FROM q3),
qc AS (SELECT s, report_date, field_key, sum(v) OVER (PARTITION BY s, field_key, year(report_date) ORDER BY report_date) AS v FROM q1),
qp AS (SELECT s, report_date, field_key, sum(v) OVER (PARTITION BY s, field_key ORDER BY report_date) AS v FROM q1),
{_sql("facts_quarter", "q1", QUARTER_FAMILY, "['Q1','Q2','Q3','Q4']", "flow")},
{_sql("facts_cum", "qc", CUMULATIVE_FAMILY, "['Q1','H1','Q3C','FY']", "flow")},
{_sql("facts_point", "qp", POINT_FAMILY, "['Q1','H1','Q3C','FY']", "point_in_time")},
{_sql("facts_decoy", "qc", DECOY_FAMILY, "['Q1','H1','Q3C','FY']", "flow", " * 10")},
facts_restated AS (
  SELECT * REPLACE (CAST(CAST(CAST(value_text AS DECIMAL(18,4)) * CAST('1.01' AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS VARCHAR) AS value_text,
                    CAST(CAST(CAST(value_text AS DECIMAL(18,4)) * CAST('1.01' AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS DOUBLE) AS value_num,
                    CAST(available_at + 90 AS DATE) AS available_at)
  FROM facts_cum WHERE (CAST(security_code AS BIGINT) * 31 + year(report_date) * 4 + quarter(report_date)) % 7 = 0),
facts AS (SELECT * FROM facts_quarter UNION ALL SELECT * FROM facts_cum UNION ALL SELECT * FROM facts_point UNION ALL SELECT * FROM facts_decoy),
everything AS (SELECT * FROM facts UNION ALL SELECT * EXCLUDE (o) REPLACE (o AS family, value_num * 3 AS value_num) FROM facts_quarter, (SELECT unnest({OTHER_FAMILIES}) AS o))"""


def sql(body: str) -> str:
    """A statement over the fact tables; body begins after WITH, with more common table expressions or a SELECT."""
    return f"WITH {SQL}{' ' if body.lstrip().upper().startswith('SELECT') else ', '}{body}"
