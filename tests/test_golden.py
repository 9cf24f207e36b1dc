"""Small literal cases with known answers."""

import datetime

import pytest
from pyspark.sql import functions as F

from factloom.operators import documents, mapping, normalize, point_in_time, reconcile, search, timeseries
from factloom.sources import facts as src
from factloom.sources import sinks
from factloom.streaming import ingestion

D = datetime.date
FACT = ", ".join(f"{c} {'date' if c in ('report_date', 'event_date', 'available_at') else 'double' if c == 'value_num' else 'string'}" for c in src.COLUMNS)


def fact(key, date, value, family=src.QUARTER_FAMILY, label="x", theme="t", code="000001", text=None):
    return (code, theme, family, "main", f"{code}|{date}", date, date, None, "", key, label, "", text or str(value), value, "元", "", "FACT_DIRECT", "flow")


def facts(spark, rows):
    return spark.createDataFrame(rows, FACT)


def test_four_quarters_sum_up(spark):
    rows = facts(spark, [fact("R", d, v) for d, v in ((D(2025, 6, 30), 20.0), (D(2025, 9, 30), 30.0), (D(2025, 12, 31), 40.0), (D(2026, 3, 31), 10.0))])
    (found,) = timeseries.ttm(rows, rows).collect()
    assert (found.ttm, found.method, found.report_date) == (100.0, "FOUR_INDEPENDENT_QUARTERS", D(2026, 3, 31))
    gap = facts(spark, [fact("R", d, 1.0) for d in (D(2024, 12, 31), D(2025, 6, 30), D(2025, 9, 30), D(2025, 12, 31))])
    assert timeseries.ttm_quarters(gap, strict=True).count() == 0 and timeseries.ttm_quarters(gap).count() == 1


def test_formula_prefers_the_statement(spark):
    d = D(2025, 12, 31)
    rows = facts(spark, [fact("CIP", d, 25.0, src.POINT_FAMILY), fact("ASSETS", d, 100.0, src.POINT_FAMILY), fact("CIP", d, 999.0, src.DECOY_FAMILY),
        fact("ASSETS", d, 1000.0, src.DECOY_FAMILY)])
    (found,) = timeseries.evaluate(timeseries.VALUE("CIP") / timeseries.VALUE("ASSETS"), rows).collect()
    assert found.value == 0.25
    (none,) = timeseries.evaluate(timeseries.VALUE("CIP") / (timeseries.VALUE("ASSETS") - 100), rows).collect()
    assert none.value is None and none.reason == "DIVISION_BY_ZERO"


def test_quarters_from_running_totals(spark):
    ends = [D(2025, 3, 31), D(2025, 6, 30), D(2025, 9, 30), D(2025, 12, 31)]
    rows = facts(spark, [fact("R", d, v, src.CUMULATIVE_FAMILY) for d, v in zip(ends, (100.0, 250.0, 450.0, 800.0))])
    assert {r.period_type: r.value_num for r in timeseries.independent_quarters(rows).collect()} == {"Q2": 150.0, "Q3": 200.0, "Q4": 350.0}


@pytest.fixture(scope="module")
def four(spark):
    d = D(2025, 12, 31)
    labels = ["购建固定资产支付的现金", "购建同比", "经营现金流量", "经营收入"]
    families = [src.QUARTER_FAMILY, src.QUARTER_FAMILY, src.CUMULATIVE_FAMILY, src.POINT_FAMILY]
    return facts(spark, [fact(f"K{k}", d, float(k), f, n) for k, (n, f) in enumerate(zip(labels, families))])


def test_search_chain_counts_each_stage(spark, four):
    base = search.Request(filters=(search.Filter("field_name_cn", "contains", "购建"),),
        steps=(search.Step("include", "contains", "现金"), search.Step("exclude", "contains", "同比")))
    r = search.stage_counts(four, base).first()
    assert (r.filtered, r.step_1, r.step_2) == (2, 1, 1)
    either = search.Request(base=search.Step("include", "contains", "购建"), steps=(search.Step("or", "contains", "经营"),))
    assert search.results(four, either).count() == 4


def test_facets_ignore_their_own_filter(spark, four):
    request = search.Request((search.Filter("family", "in", values=(src.POINT_FAMILY,)),))
    assert sorted(r["count"] for r in search.facet(four, request, "family").collect()) == [1, 1, 2]


def test_unknown_names_are_rejected():
    with pytest.raises(ValueError):
        search.column("value_num; DROP TABLE facts")
    with pytest.raises(ValueError):
        search.matched(search.Step("include", "regex", "(a+)+$"))


def test_wildcards_in_a_filter_are_ordinary_characters(spark, four):
    assert search.results(four, search.Request((search.Filter("field_name_cn", "contains", "%"),))).count() == 0


def test_availability_never_comes_from_the_report_date(spark):
    record = '{"REPORT_DATE": "2026-03-31 00:00:00", "NOTICE_DATE": "2026-04-25", "UPDATE_DATE": "2026-04-26"}'
    fields = F.from_json(F.lit(record), "map<string,string>")
    row = spark.range(1).select(
        normalize.date_of(normalize.first_of(normalize.AVAILABILITY_KEYS, fields)).alias("a"),
            normalize.date_of(normalize.first_of(normalize.DATE_KEYS, fields)).alias("e"),
        normalize.first_of(normalize.AVAILABILITY_KEYS, F.create_map(F.lit("REPORT_DATE"), F.lit("2026-03-31"))).alias("none"),
    ).first()
    assert (row.a, row.e, row.none) == ("2026-04-25", "2026-03-31", None)


def test_codes(spark):
    rows = spark.createDataFrame([("688521",), ("688521.SH",), ("SH688521",), ("1.688521",), ("x",)], "c string")
    assert [r.s for r in rows.select(normalize.standard_code(F.col("c")).alias("s")).collect()] == ["688521.SH"] * 4 + [None]


def documents_of(spark):
    rows = [("1", D(2025, 12, 31), "a", "original", D(2026, 3, 20)), ("1", D(2025, 12, 31), "b", "corrected", D(2026, 4, 1)),
        ("1", D(2025, 12, 31), "c", "withdrawn", D(2026, 1, 1))]
    return spark.createDataFrame(rows, "security_code string, report_date date, document_id string, version_label string, available_at date")


@pytest.mark.parametrize(("day", "want"), [(D(2026, 3, 31), {"a": "SELECTED", "b": "BOUNDARY"}), (D(2026, 4, 2), {"a": "ELIGIBLE", "b": "SELECTED"}),
    (D(2026, 3, 1), {"a": "BOUNDARY", "b": "BOUNDARY"})])
def test_versions_at_a_cutoff(spark, day, want):
    found = point_in_time.versions_as_of(documents_of(spark), F.lit(day)).collect()
    assert {r.document_id: r.decision for r in found} == want
    assert {r.supersedes for r in found if r.decision == "SELECTED"} <= {None, "a"}


def finance(spark):
    ends = [D(2025, 3, 31), D(2025, 6, 30), D(2025, 9, 30), D(2025, 12, 31)]
    rows = []
    for key, values in {"OPERATE_INCOME": (100, 230, 360, 500), "OPERATE_COST": (60, 135, 210, 300), "ACCOUNTS_RECE": (30, 35, 40, 45),
        "SHORT_LOAN": (10, 20, 25, 30), "LONG_LOAN": (5, 10, 12, 15)}.items():
        rows += [("1", "F", f"{key}{d}", d, key, float(v), str(v), "元", "FACT_DIRECT", None, d + datetime.timedelta(20), "CUMULATIVE") for d,
            v in zip(ends, values)]
    rows.append(("1", "F", "later", ends[3], "OPERATE_INCOME", 999.0, "999", "元", "FACT_DIRECT", None, D(2027, 1, 1), "CUMULATIVE"))
    rows += [("2", "F", f"k{v}", ends[3], "OPERATE_INCOME", v, "", "元", "FACT_DIRECT", None, D(2026, 1, 20), "CUMULATIVE") for v in (1.0, 2.0)]
    schema = "security_code string, family string, record_key string, report_date date, field_key string, value_num double, value_text string, unit string, source_status string, source_priority int, available_at date, period_basis string"
    return spark.createDataFrame(rows, schema)


def test_finance_tables(spark):
    rows, cut = finance(spark), F.lit(D(2026, 6, 30))
    chosen = point_in_time.selected(rows, cut)
    full = point_in_time.with_gross_profit(chosen).unionByName(point_in_time.debt_proxy(rows, cut))
    quarters = {(r.report_date.month, r.target): (r.value, r.status) for r in point_in_time.quarterly(full,
        point_in_time.selected(rows, cut, standalone=True)).filter("security_code = '1'").collect()}
    assert quarters[6, "revenue"] == (130.0, "DERIVED") and quarters[12, "revenue"] == (140.0, "DERIVED")
    assert quarters[6, "gross_profit"][0] == 55.0 and quarters[6, "accounts_receivable"] == (35.0, "SOURCE_DIRECT")
    assert quarters[6, "interest_bearing_debt"][0] == 30.0
    periods = rows.select("security_code", "report_date").distinct()
    statuses = point_in_time.field_statuses(full, periods, F.lit("INDUSTRIAL"))
    year = {r.security_code: r for r in point_in_time.annual(statuses).collect()}
    assert year["1"].revenue == 500.0 and year["2"].revenue is None
    assert statuses.filter("security_code = '2' and target = 'revenue'").first().status == "CONFLICTING"
    assert point_in_time.gaps(rows, statuses, cut).filter("gap = 'FUTURE_EXCLUDED'").count() == 1
    bank = point_in_time.field_statuses(full, periods, F.lit("BANK"))
    assert {r.status for r in bank.filter("target = 'gross_profit'").collect()} == {"NOT_APPLICABLE"}


def test_two_sources_make_one_observation(spark):
    columns = "security_code string, source string, family string, dataset string, record_key string, report_date date, period_type string, data_semantics string, scope string, field_key string, value_num double, value_text string, unit string, source_status string, available_at date"
    d = D(2025, 12, 31)
    rows = [("1", s, "F", "m", "k", d, p, "flow", "consolidated", "R", v, None, u, "FACT_DIRECT", d) for s, p, v,
        u in (("OFFICIAL_DISCLOSURE", "FY", 1e9, "元"), ("EASTMONEY", "FY", 100000.0, "万元"), ("EASTMONEY", "Q4", 3e8, "元"))]
    lineage = mapping.lineage(mapping.source_facts(spark.createDataFrame(rows, columns), F.lit(D(2026, 6, 1)),
        spark.createDataFrame([("R", "income.revenue")], "field_key string, metric_id string")))
    found = {r.period_type: r for r in mapping.observations(lineage).collect()}
    assert found["FY"].status == "VERIFIED_MULTI_SOURCE" and found["FY"].value_num == 1e9 and found["Q4"].status == "SINGLE_SOURCE"
    assert sorted(r.role for r in lineage.filter("period_type = 'FY'").collect()) == ["SELECTED", "SUPPORTING"]


def test_modes_and_policies(spark):
    row = spark.createDataFrame([("RPT_F10_FINANCE_GBALANCE", "TOTAL_ASSETS", "", "资产", "元"), ("/api/qt/stock", "PRICE", "", "价", ""),
        ("X_PREDICT", "EPS", "", "每股收益", "元"), ("Y", "_K", "", "", "")], "f string, k string, c string, n string, u string")
    found = row.select(reconcile.validation_mode(F.col("f"), F.col("k"), F.col("c")).alias("m"),
        reconcile.policy(F.col("k"), F.col("n"), F.col("u"), F.lit(""))["method"].alias("p")).collect()
    assert [r.m for r in found] == ["OFFICIAL_DIRECT", "NOT_IN_PERIODIC_REPORT_SCOPE", "EASTMONEY_SOURCE_SPECIFIC", "EASTMONEY_SOURCE_SPECIFIC"]
    assert [r.p for r in found] == ["numeric", "text", "per_share", "text"]


def test_pages(spark):
    html = "<html><head><title>A &amp; B</title><style>p{}</style></head><body><script>var t='</p>';</script><p>One  two</p><div>three<br>four</div><a href='/x.pdf'>f</a><a href=\"http://o.org/y\">g</a></body></html>"
    pages = spark.createDataFrame([(1, "https://www.s.org/a?b", html), (2, None, None)], "page_id long, url string, html string")
    one, two = documents.parsed(pages).orderBy("page_id").collect()
    assert one.title == "A & B" and one.text == "A & B\nOne two\nthree\nfour\nfg"
    assert one.links == ["https://www.s.org/x.pdf", "http://o.org/y"] and one.attachments == ["https://www.s.org/x.pdf"]
    assert two.quality == "failed" and two.title is None


def test_incremental_ingestion_equals_the_batch(spark, tmp_path):
    keys, schema = ["code", "field"], "code string, field string, value double"
    landed, table = f"{tmp_path}/landed", f"{tmp_path}/facts"
    first = [("1", "a", 1.0), ("1", "b", 2.0)]
    second = [("1", "a", 1.0), ("2", "a", 3.0)]
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{landed}/{k}")
        ingestion.ingest(spark, f"{landed}/*", schema, table, f"{tmp_path}/checkpoint", keys)
    ingestion.ingest(spark, f"{landed}/*", schema, table, f"{tmp_path}/checkpoint", keys)
    found = sorted((r.code, r.field, r.value) for r in spark.read.parquet(table).collect())
    assert found == sorted({*first, *second})


def test_sinks(spark, tmp_path, four):
    sinks.write_facts(four, f"{tmp_path}/facts")
    assert spark.read.parquet(f"{tmp_path}/facts").filter("report_year = 2025").count() == 4
    matrix = sinks.period_matrix(four, [D(2025, 12, 31)]).collect()
    assert {r.field_key: r["2025-12-31"] for r in matrix} == {f"K{k}": float(k) for k in range(4)}
    assert sinks.fingerprint(four).first() == sinks.fingerprint(four.repartition(3)).first()
    sinks.write_pack({"pack_facts": four}, f"{tmp_path}/pack")
    assert spark.sql("select count(*) from pack_facts").first()[0] == 4


def test_entry_imports_without_a_session():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
