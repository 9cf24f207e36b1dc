"""Search queries over the part catalogue seen as facts, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import search as s
from factloom.sources import facts as src

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


def parts(spark, d):
    """Parts as facts: the name is the label, the type the text, the price the number, the size the year of its date."""
    p = src.table(spark, d, "part")
    return p.select(
        F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("security_code"), F.lit("Part").alias("theme"), F.col("p_brand").alias("family"),
        F.lit("catalogue").alias("dataset"), F.make_date(F.col("p_size") + 1950, F.lit(12), F.lit(31)).alias("report_date"),
        F.lit(None).cast("date").alias("event_date"), F.col("p_type").alias("field_key"), F.col("p_name").alias("field_name_cn"),
        F.col("p_type").alias("value_text"), F.col("p_retailprice").alias("value_num"), F.lit("").alias("unit"), F.lit(None).cast("string").alias("source_url"),
    )


PARTS = """WITH parts AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS security_code, 'Part' AS theme, p_brand AS family, 'catalogue' AS dataset,
  make_date(p_size + 1950, 12, 31) AS report_date, p_type AS field_key, p_name AS field_name_cn, p_type AS value_text, p_retailprice AS value_num,
  '' AS unit, CAST(NULL AS VARCHAR) AS source_url FROM part) """
ROW = ["security_code", "field_name_cn", "family", "value_num"]
FUZZY = """CASE WHEN v = q THEN 100.0 WHEN contains(v, q) THEN 96.0 ELSE round(200.0 * len(list_intersect(b, c)) / (len(b) + len(c))) END"""
GRAMS = "list_distinct(list_transform(range(1, CAST(greatest(length({0}) - 1, 1) AS BIGINT) + 1), lambda i: substr({0}, i, 2)))"

EVERY = (
    s.Filter("family", "in", values=("Brand#1", "Brand#2", "Brand#3")), s.Filter("family", "not_in", values=("Brand#3",)),
        s.Filter("field_name_cn", "not_contains", "ring"),
    s.Filter("value_text", "not_equal", "nothing"), s.Filter("security_code", "prefix", "0000"), s.Filter("value_num", "gte", 905.0),
    s.Filter("value_num", "lte", 1900.0), s.Filter("effective_date", "not_empty"), s.Filter("source_url", "is_empty"), s.Filter("unit", "in"),
)


@query("flt1_filters", PARTS + """SELECT security_code, field_name_cn, family, value_num FROM parts
WHERE family IN ('Brand#1', 'Brand#2', 'Brand#3') AND family NOT IN ('Brand#3') AND NOT contains(lower(field_name_cn), 'ring') AND lower(value_text) <> 'nothing'
  AND starts_with(security_code, '0000') AND value_num >= 905 AND value_num <= 1900 AND report_date IS NOT NULL AND coalesce(source_url, '') = ''""")
def flt1(spark, d):
    return s.results(parts(spark, d), s.Request(EVERY[:-1])).select(ROW)


@query("flt2_effective_date",
    PARTS + "SELECT security_code, field_name_cn, family, value_num FROM parts WHERE report_date BETWEEN DATE '1960-01-01' AND DATE '1970-12-31'")
def flt2(spark, d):
    import datetime

    f = s.Filter("effective_date", "between", lower=datetime.date(1960, 1, 1), upper=datetime.date(1970, 12, 31))
    return s.results(parts(spark, d), s.Request((f,))).select(ROW)


@query("flt3_empty_list", PARTS + "SELECT count(*) FILTER (false) AS nothing, count(*) AS everything FROM parts")
def flt3(spark, d):
    p = parts(spark, d)
    nothing, everything = s.where((s.Filter("unit", "in"),)), s.where((s.Filter("unit", "not_in"),))
    return p.agg(F.count_if(nothing).alias("nothing"), F.count_if(everything).alias("everything"))


@query("flt5_regex_step", PARTS + """SELECT security_code, field_name_cn, family, value_num FROM parts
WHERE regexp_matches(field_name_cn, 'l.*t$', 'i') OR regexp_matches(value_text, 'l.*t$', 'i')""")
def flt5(spark, d):
    return s.results(parts(spark, d), s.Request(base=s.Step("include", "regex", "l.*t$", ("field_name_cn", "value_text")))).select(ROW)


@query("flt7_fuzzy", PARTS + f""", a AS (SELECT security_code, 'blue bolt' AS q, lower(field_name_cn) AS v FROM parts),
b AS (SELECT *, {GRAMS.format("q")} AS b, {GRAMS.format("v")} AS c FROM a),
r AS (SELECT security_code, {FUZZY} AS score FROM b)
SELECT security_code, CAST(score AS DOUBLE) AS score FROM r WHERE score >= 60""")
def flt7(spark, d):
    return s.results(parts(spark, d), s.Request(base=s.Step("include", "fuzzy", "BLUE BOLT"))).select("security_code", "score")


CHAIN = s.Request(
    filters=(s.Filter("value_num", "gte", 902.0),), base=s.Step("include", "contains", "r"),
    steps=(s.Step("include", "contains", "b"), s.Step("exclude", "contains", "ring"), s.Step("or", "exact", "red widget"),
        s.Step("include", "fuzzy", "blue bolt", threshold=30)),
    tiebreak=("security_code",), page=2, page_size=20,
)
CHAIN_SQL = PARTS + f""", f AS (SELECT *, lower(field_name_cn) AS v, 'blue bolt' AS q FROM parts WHERE value_num >= 902),
g AS (SELECT *, {GRAMS.format("q")} AS b, {GRAMS.format("v")} AS c FROM f),
h AS (SELECT *, {FUZZY} AS fz, contains(v, 'r') AS s0, contains(v, 'b') AS h1, contains(v, 'ring') AS h2, v = 'red widget' AS h3 FROM g),
k AS (SELECT *, s0 AND h1 AS a1, s0 AND h1 AND NOT h2 AS a2, (s0 AND h1 AND NOT h2) OR h3 AS a3, ((s0 AND h1 AND NOT h2) OR h3) AND fz >= 30 AS a4,
  CASE WHEN s0 THEN 100.0 END AS base_score,
  (CASE WHEN h1 THEN 100 ELSE 0 END + CASE WHEN h3 THEN 100 ELSE 0 END + CASE WHEN fz >= 30 THEN fz ELSE 0 END) AS t,
  (CASE WHEN h1 THEN 1 ELSE 0 END + CASE WHEN h3 THEN 1 ELSE 0 END + CASE WHEN fz >= 30 THEN 1 ELSE 0 END) AS n FROM h),
z AS (SELECT *, CAST(round(t / nullif(n, 0), 4) AS DOUBLE) AS secondary_score,
  CAST(round((t + coalesce(base_score, 0)) / nullif(n + CASE WHEN s0 THEN 1 ELSE 0 END, 0), 4) AS DOUBLE) AS score FROM k)
"""


@query("flt9_chained_steps", CHAIN_SQL + "SELECT security_code, CAST(base_score AS DOUBLE) AS base_score, secondary_score, score FROM z WHERE a4")
def flt9(spark, d):
    return s.results(parts(spark, d), CHAIN).select("security_code", "base_score", "secondary_score", "score")


@query("flt4_score_filters", CHAIN_SQL + "SELECT security_code, score FROM z WHERE a4 AND score BETWEEN 60 AND 95")
def flt4(spark, d):
    from dataclasses import replace

    return s.results(parts(spark, d), replace(CHAIN, filters=(*CHAIN.filters, s.Filter("score", "between", lower=60.0, upper=95.0)))).select("security_code",
        "score")


@query("flt11_stage_counts", CHAIN_SQL + """SELECT (SELECT count(*) FROM parts) AS raw, count(*) AS filtered, count(*) FILTER (s0) AS base,
  count(*) FILTER (a1) AS step_1, count(*) FILTER (a2) AS step_2, count(*) FILTER (a3) AS step_3, count(*) FILTER (a4) AS step_4 FROM z""")
def flt11(spark, d):
    return s.stage_counts(parts(spark, d), CHAIN)


@query("srt1_sorted_page",
    CHAIN_SQL + "SELECT security_code, score FROM z WHERE a4 ORDER BY score DESC NULLS LAST, report_date DESC NULLS LAST, security_code LIMIT 20 OFFSET 20")
def srt1(spark, d):
    return s.sorted_page(s.results(parts(spark, d), CHAIN), CHAIN).select("security_code", "score")


@query("srt2_page_numbers", CHAIN_SQL + "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS page_count FROM z WHERE a4")
def srt2(spark, d):
    return s.page_numbers(s.results(parts(spark, d), CHAIN), 20)


@query("agg4_facet", PARTS + """, c AS (SELECT family AS value, count(*) AS count FROM parts WHERE value_num >= 905 GROUP BY 1)
SELECT value, count, (SELECT count(*) > 3 FROM c) AS truncated FROM c ORDER BY count DESC, value LIMIT 3""")
def agg4(spark, d):
    r = s.Request((s.Filter("value_num", "gte", 905.0), s.Filter("family", "in", values=("Brand#1",))))
    return s.facet(parts(spark, d), r, "family", 3)


@query("agg5_numeric_facet",
    PARTS + "SELECT min(value_num) AS minimum, max(value_num) AS maximum, count(*) FILTER (value_num IS NULL) AS null_count, count(*) AS total FROM parts WHERE family = 'Brand#1'")
def agg5(spark, d):
    r = s.Request((s.Filter("value_num", "gte", 905.0), s.Filter("family", "in", values=("Brand#1",))))
    return s.numeric_facet(parts(spark, d), r, "value_num")


@query("flt8_shortcut",
    PARTS + "SELECT security_code, field_name_cn, family, value_num FROM parts WHERE report_date >= DATE '1980-01-01' AND theme = 'Part' AND family = 'Brand#2' AND value_num <= 950")
def flt8(spark, d):
    import datetime

    return s.results(parts(spark, d), s.Request(s.shortcut(start=datetime.date(1980, 1, 1), theme="Part", family="Brand#2", high=950.0))).select(ROW)


@query("flt14_any_column_contains",
    "SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE contains(lower(s_name), '00009') OR contains(CAST(s_suppkey AS VARCHAR), '00009') OR contains(CAST(s_nationkey AS VARCHAR), '00009')")
def flt14(spark, d):
    return s.any_column_contains(src.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "00009")


@query("agg1_field_catalogue",
    src.sql("SELECT field_key, field_name_cn, unit, count(*) AS n, min(report_date) AS first_date, max(report_date) AS last_date FROM facts GROUP BY 1, 2, 3"))
def agg1(spark, d):
    return s.field_catalogue(src.facts(spark, d))


@query("agg2_periods", src.sql("SELECT DISTINCT report_date FROM facts WHERE report_date IS NOT NULL"))
def agg2(spark, d):
    return s.periods(src.facts(spark, d))


@query("agg3_overview", src.sql("""SELECT security_code, count(*) AS facts, count(DISTINCT field_key) AS fields, count(DISTINCT family) AS families,
  min(report_date) AS first_date, max(report_date) AS last_date FROM facts GROUP BY 1"""))
def agg3(spark, d):
    return s.overview(src.facts(spark, d))
