"""Queries of the normaliser over the event stream and other tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import normalize as n
from factloom.sources import facts as src

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


def events(spark, d):
    return src.table(spark, d, "events")


def payload(c="props"):
    return F.concat(F.lit('callback({"result":{"pages":[{"data":['), F.col(c), F.lit(',{"k":"1,234","_x":1}]}]}});'))


@query("nrm1_record_to_facts",
    """SELECT event_id, 'k' AS field_key, json_extract_string(props, '$.k') AS value_text, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value_num
FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def nrm1(spark, d):
    return n.facts_of(events(spark, d).select("event_id", F.parse_json("props").alias("record")), ["event_id"])


@query("src4_records_at_path", """SELECT event_id, CAST(0 AS INT) AS ordinal, json_extract_string(props, '$.k') AS k FROM events
UNION ALL SELECT event_id, 1, '1,234' FROM events""")
def src4(spark, d):
    rows = events(spark, d).select("event_id", n.decoded(payload()).alias("v"))
    found = n.records_at(rows, "v", "result.pages[0].data")
    return found.select("event_id", "ordinal", F.try_variant_get("record", "$.k", "string").alias("k"))


@query("src3_jsonp", """SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 3 = 0""")
def src3(spark, d):
    wrapped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.concat(F.lit("cb("), F.col("props"), F.lit(");")))
    return events(spark, d).select("event_id", F.try_variant_get(n.decoded(wrapped), "$.k", "string").alias("k"))


@query("nrm3_dates", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS a, strftime(ts, '%Y-%m-%d') AS b, strftime(ts, '%Y-%m-%d') AS c, strftime(ts,
    '%Y-%m-%d') AS d, 'about 2024' AS e FROM events""")
def nrm3(spark, d):
    ts = F.col("ts")
    seconds = F.unix_timestamp(ts).cast("string")
    return events(spark, d).select(
        "event_id", n.date_of(seconds).alias("a"), n.date_of(F.concat(seconds, F.lit("000"))).alias("b"),
            n.date_of(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).alias("c"),
        n.date_of(F.date_format(ts, "yyyy/M/d")).alias("d"), n.date_of(F.lit("about 2024, or so")).alias("e"),
    )


@query("nrm4_numbers", "SELECT o_orderkey, o_totalprice AS a, CAST(NULL AS DOUBLE) AS b, CAST(NULL AS DOUBLE) AS c FROM orders")
def nrm4(spark, d):
    text = F.format_number("o_totalprice", 2)
    return src.table(spark, d, "orders").select("o_orderkey", n.number_of(text).alias("a"), n.number_of(F.lit("NaN")).alias("b"),
        n.number_of(F.lit("x1")).alias("c"))


@query("nrm5_first_dates",
    """SELECT event_id, strftime(ts, '%Y-%m-%d') AS event_date, CASE WHEN event_id % 2 = 0 THEN '2024-12-31' ELSE '2025-01-01' END AS available_at FROM events""")
def nrm5(spark, d):
    fields = F.create_map(
        F.lit("REPORT_DATE"), F.date_format("ts", "yyyy-MM-dd"), F.lit("NOTICE_DATE"), F.when(F.col("event_id") % 2 == 0, "2024-12-31").otherwise(""),
            F.lit("UPDATE_DATE"), F.lit("2025-01-01")
    )
    return events(spark, d).select("event_id", n.first_of(n.DATE_KEYS, fields).alias("event_date"),
        n.first_of(n.AVAILABILITY_KEYS, fields).alias("available_at"))


@query("nrm6_period_types", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '年报' ELSE CASE month(o_orderdate) WHEN 3 THEN 'Q1' WHEN 6 THEN 'Q2'
    WHEN 9 THEN 'Q3' WHEN 12 THEN 'FY' ELSE 'OTHER' END END AS period_type FROM orders""")
def nrm6(spark, d):
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    return src.table(spark, d, "orders").select("o_orderkey", n.period_type(F.when(F.col("o_orderkey") % 5 == 0, "年报").otherwise(""),
        date).alias("period_type"))


@query("nrm7_canonical_periods", src.sql("SELECT family, report_date, period_type, count(*) AS n FROM facts GROUP BY ALL"))
def nrm7(spark, d):
    from factloom.functions.priority import INDEPENDENT

    p = n.canonical_period(F.col("report_date").cast("string"), F.col("family"), F.lit(None).cast("string"), INDEPENDENT)
    return src.facts(spark, d).withColumn("period_type", p).groupBy("family", "report_date", "period_type").agg(F.count(F.lit(1)).alias("n"))


@query("nrm8_semantics",
    src.sql("SELECT family, CASE WHEN family LIKE '%BALANCE' THEN 'point_in_time' WHEN family LIKE '%DUPONT' THEN 'event_or_static' ELSE 'flow' END AS semantics, count(*) AS n FROM facts GROUP BY ALL"))
def nrm8(spark, d):
    return src.facts(spark, d).select("family", n.semantics(F.col("family")).alias("semantics")).groupBy("family",
        "semantics").agg(F.count(F.lit(1)).alias("n"))


@query("nrm10_labels", src.sql("""SELECT family, field_key, CASE WHEN family LIKE '%BALANCE' AND field_key = 'QTY' THEN 'Stock'
    WHEN field_key = 'COST' THEN 'Cost, revised' WHEN field_key = 'QTY' THEN 'Pieces' ELSE 'REVENUE' END AS label,
  CASE WHEN field_key = 'REVENUE' THEN '' WHEN field_key = 'COST' THEN '元' ELSE '股' END AS unit, CASE WHEN field_key = 'REVENUE' THEN 'PAGE_DISPLAY_FIELD'
    ELSE 'S' END AS category, count(*) AS n FROM facts GROUP BY ALL"""))
def nrm10(spark, d):
    schema = "key string, label string, unit string, category string, layer int"
    general = n.layered(spark.createDataFrame([("COST", "Cost", "元", "S", 0), ("QTY", "Pieces", "股", "S", 0), ("COST", "Cost, revised", "元", "S", 1)], schema))
    context = n.layered(spark.createDataFrame([(f"Finance|{src.POINT_FAMILY}|main|QTY", "Stock", "股", "S", 0)], schema))
    found = n.labelled(src.facts(spark, d).drop("unit"), general, context)
    return found.groupBy("family", "field_key", "label", "unit", "category").agg(F.count(F.lit(1)).alias("n"))


@query("nrm11_record_dedupe",
    "SELECT user_id, event_type, min(event_id) AS event_id, json_extract_string(props, '$.k') AS k FROM events GROUP BY user_id, event_type, props")
def nrm11(spark, d):
    rows = events(spark, d).select("user_id", "event_type", "event_id", F.parse_json("props").alias("record"))
    return n.deduplicated(rows, ["user_id", "event_type"], "record", ["event_id"]).select("user_id", "event_type", "event_id",
        F.try_variant_get("record", "$.k", "string").alias("k"))


@query("nrm12_record_sets",
    """SELECT user_id AS group_id, count(DISTINCT CASE WHEN event_type IN ('click', 'view', 'error', 'purchase') THEN event_type END) / 4.0 AS coverage,
  count(DISTINCT CASE WHEN event_type IN ('click', 'view', 'error', 'purchase') THEN event_type END) >= 0.7 * 4 AND bool_and(value > 0.05) AS accepted FROM events GROUP BY 1""")
def nrm12(spark, d):
    rows = events(spark, d).select(F.col("user_id").alias("group_id"), F.col("event_type").alias("key"), (F.col("value") > 0.05).alias("ok"))
    return n.record_sets(rows, ["click", "view", "error", "purchase"])


@query("nrm13_count_violations", """SELECT o_orderkey AS group_id, n + CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS record_count, n AS n_records
FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1) WHERE o_orderkey % 9 = 0 AND o_orderkey % 5 > 0""")
def nrm13(spark, d):
    """Orders that say they have a line more than they have; some don't say how many."""
    g = src.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("group_id")).agg(F.count(F.lit(1)).alias("n_records"))
    said = F.when(F.col("group_id") % 5 > 0, F.col("n_records") + F.when(F.col("group_id") % 9 == 0, 1).otherwise(0))
    return n.count_violations(g.withColumn("record_count", said))


@query("nrm14_best_copies",
    """SELECT g AS group_id, (b).success AS success, (b).n_records AS n_records, (b).n_payloads AS n_payloads, (b).ordinal AS ordinal FROM (
  SELECT event_id % 50 AS g, arg_max({'success': event_type <> 'error', 'n_records': user_id % 7, 'n_payloads': user_id % 3, 'ordinal': event_id},
    (user_id % 7 = 3, event_type <> 'error', user_id % 7, user_id % 3, -event_id)) AS b FROM events GROUP BY 1)""")
def nrm14(spark, d):
    rows = events(spark, d).select(
        (F.col("event_id") % 50).alias("group_id"), (F.col("event_type") != "error").alias("success"), F.lit(3).alias("record_count"),
        (F.col("user_id") % 7).alias("n_records"), (F.col("user_id") % 3).alias("n_payloads"), F.col("event_id").alias("ordinal"),
    )
    return n.best_copies(rows)


CODE = "lpad(CAST(c_custkey * 7919 % 1000000 AS VARCHAR), 6, '0')"


@query("nrm15_parsed_codes", f"""WITH c AS (SELECT c_custkey, {CODE} AS code FROM customer), e AS (SELECT *, CASE WHEN regexp_matches(code,
    '^(4|8|92)') THEN 'BJ' WHEN regexp_matches(code, '^[0123]') THEN 'SZ' ELSE 'SH' END AS exchange FROM c)
SELECT c_custkey, code, exchange, code || '.' || exchange AS secucode, exchange || code AS page_code, CASE exchange WHEN 'SH' THEN 1 ELSE 0 END AS market_id FROM e""")
def nrm15(spark, d):
    code = F.lpad((F.col("c_custkey") * 7919 % 1000000).cast("string"), 6, "0")
    return src.table(spark, d, "customer").select("c_custkey", n.parsed_code(F.concat(F.lit(" "), code)).alias("p")).select("c_custkey", "p.*")


@query("nrm16_standard_codes", f"""WITH c AS (SELECT c_custkey, {CODE} AS code FROM customer), e AS (SELECT *, CASE WHEN regexp_matches(code,
    '^(4|8|92)') THEN 'BJ' WHEN regexp_matches(code, '^[0123]') THEN 'SZ' ELSE 'SH' END AS exchange FROM c)
SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE code || '.' || exchange END AS secucode FROM e""")
def nrm16(spark, d):
    code = F.lpad((F.col("c_custkey") * 7919 % 1000000).cast("string"), 6, "0")
    k = F.col("c_custkey") % 5
    text = F.when(k == 0, code).when(k == 1, F.concat(code, F.lit(".sh"))).when(k == 2, F.concat(F.lit("SZ"), code)).when(k == 3,
        F.concat(F.lit("1."), code)).otherwise(F.concat(code, F.lit("x")))
    return src.table(spark, d, "customer").select("c_custkey", n.standard_code(text).alias("secucode"))


@query("nrm18_unit_scaling",
    """SELECT o_orderkey, round(o_totalprice * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 10000 ELSE 1 END, 2) AS value,
  CASE o_orderkey % 4 WHEN 3 THEN '股' ELSE '元' END AS unit FROM orders""")
def nrm18(spark, d):
    from factloom.functions.priority import canonical_unit, scaled

    unit = F.element_at(F.array(F.lit("元"), F.lit("千元"), F.lit("万元"), F.lit("股")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = src.table(spark, d, "orders").withColumn("u", unit)
    return rows.select("o_orderkey", F.round(scaled("o_totalprice", "u"), 2).alias("value"), canonical_unit("u").alias("unit"))


@query("nrm19_plain_text", "SELECT p_partkey, replace(lower(p_name), ' ', '') || '(x),' AS t FROM part")
def nrm19(spark, d):
    return src.table(spark, d, "part").select("p_partkey", n.plain_text(F.concat(F.upper("p_name"), F.lit("　（X） ，"))).alias("t"))


@query("nrm20_report_labels", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'q4' WHEN 1 THEN 'q3' WHEN 2 THEN 'q1' WHEN 3 THEN 'h1' WHEN 4 THEN 'fy'
    ELSE 'other' END AS label FROM orders""")
def nrm20(spark, d):
    text = F.element_at(F.array(*map(F.lit, ["2024第四季度", "三季度报告", "一季报", "半年报", "2023年报", "other"])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return src.table(spark, d, "orders").select("o_orderkey", n.report_label(text).alias("label"))


@query("nrm21_sets", "SELECT p_partkey, list_sort(list_distinct(list_transform(string_split(p_name || ' ' || p_type, ' '), lambda x: lower(x)))) AS s FROM part")
def nrm21(spark, d):
    return src.table(spark, d, "part").select("p_partkey", n.set_of(F.concat(F.translate("p_name", " ", "；"), F.lit("、 "),
        F.translate("p_type", " ", "|"))).alias("s"))


@query("nrm22_stable_ids", "SELECT c_custkey, 'cus_' || left(sha256(CAST(c_custkey AS VARCHAR) || '|' || c_mktsegment || '|'), 24) AS id FROM customer")
def nrm22(spark, d):
    return src.table(spark, d, "customer").select("c_custkey", n.stable_id("cus", F.col("c_custkey"), F.col("c_mktsegment"), F.lit(None)).alias("id"))


@query("nrm23_language_tags",
    """SELECT language, count(*) AS n FROM (SELECT CASE WHEN zh AND en THEN 'mixed' WHEN zh THEN 'zh' WHEN en THEN 'en' ELSE 'unknown' END AS language
FROM (SELECT coalesce(regexp_matches(text, '[一-鿿]'), false) AS zh, coalesce(regexp_matches(text, '[A-Za-z]'), false) AS en FROM documents)) GROUP BY 1""")
def nrm23(spark, d):
    return src.table(spark, d, "documents").select(n.language_tag(F.col("text")).alias("language")).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query("nrm23_all_language_tags", """SELECT doc_id, CASE WHEN zh AND en THEN 'mixed' WHEN zh THEN 'zh' WHEN en THEN 'en' ELSE 'unknown' END AS language
FROM (SELECT doc_id, coalesce(regexp_matches(text, '[一-鿿]'), false) AS zh, coalesce(regexp_matches(text, '[A-Za-z]'), false) AS en FROM documents)""")
def nrm23_all(spark, d):
    return src.table(spark, d, "documents").select("doc_id", n.language_tag(F.col("text")).alias("language"))


@query("nrm24_listing_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS listed FROM orders")
def nrm24(spark, d):
    f = lambda p: F.date_format("o_orderdate", p)
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, f("yyyy年M月d日")).when(k == 1, f("yyyy/MM/dd")).when(k == 2, f("yyyy.M.d")).when(k == 3, f("yyyyMMdd")).otherwise("soon")
    return src.table(spark, d, "orders").select("o_orderkey", n.listing_date(text).alias("listed"))


@query("snk10_forbidden_characters",
    "SELECT CAST(k AS INT) AS code_point, count(*) AS removed FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 31 END AS k FROM orders) WHERE k IS NOT NULL GROUP BY 1")
def snk10(spark, d):
    text = F.concat(F.lit("a"), F.char(F.when(F.col("o_orderkey") % 3 == 0, 1).when(F.col("o_orderkey") % 3 == 1, 31).otherwise(65)), F.lit("\n"))
    return n.forbidden_characters(src.table(spark, d, "orders").select(text.alias("t")), "t")


@query("src5_pages_audit", """SELECT user_id AS request, greatest(max(event_id % 3 + 1), max(CAST(ceil((event_id % 40) / 10.0) AS BIGINT)), 1) AS expected,
    count(DISTINCT event_id % 5) AS present,
  count(DISTINCT event_id % 5) >= greatest(max(event_id % 3 + 1), max(CAST(ceil((event_id % 40) / 10.0) AS BIGINT)), 1) AS complete FROM events GROUP BY 1""")
def src5(spark, d):
    e = F.col("event_id")
    return n.pages_audit(events(spark, d).select(F.col("user_id").alias("request"), (e % 3 + 1).alias("pages"), (e % 40).alias("total"),
        F.lit(10).alias("page_size"), (e % 5).alias("page")))
