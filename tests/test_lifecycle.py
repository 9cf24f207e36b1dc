"""Listing dates, states of report dates, relabelled comparisons, official-only rows, derived facts and metadata with known answers."""

import datetime

import pytest
from pyspark.sql import functions as F

from factloom.operators import derived, lifecycle, mapping, normalize, reconcile, research


def day(text):
    return datetime.date.fromisoformat(text)


def test_listing_dates_come_from_keys_that_say_so(spark):
    rows = [
        ("1", "REPORT_DATE", "2016-12-31", None, "RPT_F10_FINANCE_GBALANCE"), ("1", "LISTING_DATE", "2020-08-18", None, "RPT_F10_BASIC_ORGINFO"),
        ("2", "LISTING_DATE", "2010年1月5日", None, "RPT_F10_ORG_BASICINFO"), ("2", "LIST-DATE", "2001/1/1", None, "RPT_F10_FINANCE_GBALANCE"),
        ("3", "DELIST_DATE", "2001-01-01", None, "x"), ("4", "ListDate", "", 20200818.0, "x"), ("5", "LISTING_DATE", "not-a-date", None, "x"),
    ]
    facts = spark.createDataFrame(rows, "security_code string, field_key string, value_text string, value_num double, family string")
    assert {r.security_code: (str(r.listed), r.listing_date_source) for r in lifecycle.listing_dates(facts).collect()} == {
        "1": ("2020-08-18", "EASTMONEY:RPT_F10_BASIC_ORGINFO:LISTING_DATE"), "2": ("2010-01-05", "EASTMONEY:RPT_F10_ORG_BASICINFO:LISTING_DATE"),
        "4": ("2020-08-18", "EASTMONEY:x:ListDate"),
    }


def states(spark, requested, listed, documents):
    return lifecycle.period_states(
        spark.createDataFrame([("688521", day(x)) for x in requested], "security_code string, report_date date"),
        spark.createDataFrame([("688521", day(listed), "SSE")] if listed else [], "security_code string, listed date, listing_date_source string"),
        spark.createDataFrame([("688521", day(x), s, n) for x, s, n in documents], "security_code string, report_date date, scope string, extracted int"),
    )


def test_periods_before_the_listing_and_nothing_extracted(spark):
    s = states(spark, ["2019-12-31", "2020-09-30", "2020-12-31"], "2020-08-18", [("2020-09-30", "FULL_STATEMENTS", 0), ("2020-12-31", "FULL_STATEMENTS", 91)])
    got = {str(r.report_date): (r.period_class, r.coverage_status, r.official_document_found, r.extracted_fact_count) for r in lifecycle.period_table(s).collect()}
    assert got == {
        "2019-12-31": ("PRE_LISTING_PERIOD", "PRE_LISTING_OFFICIAL_SOURCE_NOT_LOADED", False, 0),
        "2020-09-30": ("LISTING_TRANSITION_PERIOD", "OFFICIAL_DOCUMENT_EXTRACTION_FAILED", True, 0),
        "2020-12-31": ("POST_LISTING_PERIODIC_EXPECTED", "AVAILABLE", True, 91),
    }


def test_summaries_missing_and_pending(spark):
    s = states(spark, ["2020-12-31", "2021-03-31", "2021-06-30", "2026-06-30"], None, [("2021-03-31", "SUMMARY_ONLY", 0), ("2026-03-31", "FULL_STATEMENTS", 5)])
    got = {str(r.report_date): (r.period_class, r.coverage_status) for r in lifecycle.period_table(s).collect()}
    expected = "POST_LISTING_PERIODIC_EXPECTED"
    assert got == {
        "2020-12-31": (expected, "POST_LISTING_OFFICIAL_REPORT_NOT_FOUND"), "2021-03-31": (expected, "OFFICIAL_REPORT_SUMMARY_SCOPE_GAP"),
        "2021-06-30": (expected, "POST_LISTING_OFFICIAL_REPORT_NOT_FOUND"), "2026-06-30": ("POST_LISTING_PERIOD_NOT_YET_DISCLOSED", "OFFICIAL_REPORT_NOT_YET_DISCLOSED"),
    }


@pytest.mark.parametrize("date,status,new,grade", [
    ("2019-12-31", "OFFICIAL_PERIOD_NOT_LOADED", "PRE_LISTING_OFFICIAL_SOURCE_NOT_LOADED", "N/A"), ("2019-12-31", "PERIOD_CONFLICT", "PRE_LISTING_OFFICIAL_SOURCE_NOT_LOADED", "N/A"),
    ("2020-09-30", "MISSING_OFFICIAL", "OFFICIAL_DOCUMENT_EXTRACTION_FAILED", "E"), ("2021-06-30", "OFFICIAL_PERIOD_NOT_LOADED", "POST_LISTING_OFFICIAL_REPORT_NOT_FOUND", "E"),
    ("2021-03-31", "MISSING_OFFICIAL", "OFFICIAL_REPORT_SUMMARY_SCOPE_GAP", "N/A"), ("2030-06-30", "OFFICIAL_PERIOD_NOT_LOADED", "OFFICIAL_REPORT_NOT_YET_DISCLOSED", "N/A"),
    ("2030-06-30", "MISSING_OFFICIAL", "MISSING_OFFICIAL", None), ("2019-12-31", "EXACT_MATCH", "EXACT_MATCH", None),
])
def test_relabelled(spark, date, status, new, grade):
    s = states(spark, ["2019-12-31", "2020-09-30", "2021-03-31", "2021-06-30"], "2020-08-18",
        [("2020-09-30", "FULL_STATEMENTS", 0), ("2021-03-31", "SUMMARY_ONLY", 0), ("2026-03-31", "FULL_STATEMENTS", 9)])
    rows = spark.createDataFrame([("688521", day(date), status)], "security_code string, report_date date, status string")
    r = lifecycle.relabelled(rows, s).first()
    assert (r.status, r.verification_grade) == (new, grade)


def official(spark, rows):
    return spark.createDataFrame(rows, "security_code string, report_date date, period_type string, statement_type string, scope string, field_key string, value_num double, unit string, "
        "precision_tolerance double, document_id string")  # fmt: skip


def test_official_rows_keep_their_six_parts(spark):
    base = ("1", day("2025-12-31"), "FY")
    rows = official(spark, [(*base, s, c, "NETPROFIT", 1.0, "元", 0.5, "d") for s, c in (("income_statement", "consolidated"), ("income_statement", "parent"), ("cash_flow", "consolidated"))])
    facts = spark.createDataFrame([(*base, "income_statement", "NETPROFIT", 1.0, "RPT_F10_FINANCE_GINCOME", "OFFICIAL_DIRECT")],
        "security_code string, report_date date, period_type string, statement_type string, field_key string, value_num double, family string, mode string")
    left = reconcile.official_only(rows, reconcile.matched(facts, rows)).collect()
    assert sorted((r.statement_type, r.scope) for r in left) == [("cash_flow", "consolidated"), ("income_statement", "parent")]
    parent = rows.filter("scope = 'parent'")
    assert reconcile.official_only(parent, reconcile.matched(facts, parent)).count() == 1


def test_metadata_of_an_annual_report(spark):
    document = [("SSE", "688521", "芯原股份2025年年度报告", day("2026-04-01"), day("2025-12-31"), "annual", "u")]
    columns = "source string, security_code string, title string, publish_date date, report_date date, report_kind string, url string"
    facts = research.metadata_facts(spark.createDataFrame(document, columns)).collect()
    by = {(r.period_type, r.field_key): r for r in facts}
    assert {p for p, _ in by} == {"FY", "Q4"} and len(by) == 14
    assert (by["Q4", "REPORT_TYPE"].value_text, by["Q4", "REPORT_TYPE"].source_status) == ("四季度", "FACT_CALCULATED")
    assert (by["FY", "REPORT_DATE_NAME"].value_text, by["FY", "REPORT_DATE_NAME"].source_status) == ("2025年报", "FACT_DIRECT")
    assert by["FY", "SECUCODE"].value_text == "688521.SH"


def test_stable_ids_take_null_as_empty(spark):
    r = spark.range(1).select(normalize.stable_id("x", F.lit("a"), F.lit(None)).alias("a"), normalize.stable_id("x", F.lit("a"), F.lit("")).alias("b")).first()
    assert r.a == r.b


def test_periods_of_one_date_have_profit_quality_of_their_own(spark):
    rows = [("1", day("2025-06-30"), None, p, m, v) for p, x in (("Q2", 10.0), ("H1", 30.0)) for m, v in ((research.PARENT, x), (research.ADJUSTED, x - (1 if p == "Q2" else 5)))]
    got = research.profit_quality(spark.createDataFrame(rows, "security_code string, report_date date, event_date date, period_type string, metric_id string, value_num double"))
    calculated = got.filter("metric_id = 'profit_quality.non_recurring_amount_calculated'").collect()
    assert {r.period_type: r.value_num for r in calculated} == {"Q2": 1.0, "H1": 5.0}
    assert got.filter("status = 'UNRESOLVED' and value_num is null").count() == 6


def test_events_without_a_report_date_are_observations_of_their_own(spark):
    rows = [("1", "m", None, day(d), "", "event", "", v, None, str(v), 60, False, d) for d, v in (("2025-01-01", 1.0), ("2025-02-01", 2.0))]
    sources = spark.createDataFrame(rows, "security_code string, metric_id string, report_date date, event_date date, period_type string, data_semantics string, scope string, value_num double, "
        "available_at date, value_text string, priority int, quarantined boolean, source_fact_id string").withColumn("unit", F.lit(""))  # fmt: skip
    got = mapping.observations(mapping.lineage(sources)).collect()
    assert sorted((r.value_num, r.status) for r in got) == [(1.0, "SINGLE_SOURCE"), (2.0, "SINGLE_SOURCE")]


def test_statuses_of_documents(spark):
    rows = [("HTTP_403", True), ("LOGIN_REQUIRED", True), ("HTTP_404", True), ("DOWNLOAD_OK", True), ("DOWNLOAD_OK", False)]
    attempts = spark.createDataFrame([("1", "s", a, m, "u", "hash", "FACT_DIRECT", "q", "") for a, m in rows], "security_code string, source_id string, access_status string, matched boolean, "
        "url string, sha256 string, status_on_success string, query string, error string")  # fmt: skip
    got = [(r.status, bool(r.minimum_human_action)) for r in research.document_status(attempts).collect()]
    assert got == [("PERMISSION_BLOCKED", True), ("PERMISSION_BLOCKED", True), ("UNRESOLVED", False), ("FACT_DIRECT", False), ("NO_MATCH", False)]


def test_only_changed_securities_are_written_again(spark, tmp_path):
    rows = [(c, day(f"2025-{m}"), p, "income_statement", "consolidated", k, v, "元", 0.5, "d") for c in "abc" for m, p, v in (("03-31", "Q1", 10.0), ("06-30", "H1", 30.0))
        for k in ("OPERATE_INCOME", "NETPROFIT")]
    none = spark.createDataFrame([], "security_code string, report_date date, publish_date date, report_kind string, source string, title string, url string")
    folder = str(tmp_path / "derived")
    first = official(spark, rows)
    assert {r.security_code for r in derived.published(first, none, folder).collect()} == {"a", "b", "c"}
    read = lambda: spark.read.parquet(f"{folder}/facts")
    assert {r.kind: r["count"] for r in read().groupBy("kind").count().collect()} == {"direct": 12, "quarters": 6, "ratios": 6}
    before = {(r.security_code, r.f) for r in read().select("security_code", F.input_file_name().alias("f")).distinct().collect()}
    assert derived.published(first, none, folder).collect() == []
    changed = official(spark, [(*r[:6], 70.0, *r[7:]) if r[0] == "b" and r[2] == "H1" else r for r in rows])
    assert [r.security_code for r in derived.published(changed, none, folder).collect()] == ["b"]
    after = {(r.security_code, r.f) for r in read().select("security_code", F.input_file_name().alias("f")).distinct().collect()}
    assert {s for s, _ in before ^ after} == {"b"} and read().count() == 24
    assert read().filter("kind = 'quarters' and security_code = 'b'").select("value_num").distinct().first()[0] == 60.0


def test_source_facts_take_the_ontology(spark):
    d = day("2025-12-31")
    rows = [("1", "EASTMONEY", "RPT_F10_FINANCE_GINCOME", "m", "k", d, d, "FY", "flow", "consolidated", key, key, 1.0, None, "万元", "FACT_DIRECT", None) for key in ("OPERATE_INCOME", "UNKNOWN_KEY")]
    facts = spark.createDataFrame(rows, "security_code string, source string, family string, dataset string, record_key string, report_date date, event_date date, period_type string, "
        "data_semantics string, scope string, field_key string, field_name_cn string, value_num double, value_text string, unit string, source_status string, available_at date")  # fmt: skip
    got = {r.metric_id: (r.value_num, r.unit, r.priority) for r in mapping.source_facts(facts, F.lit(day("2026-01-01"))).collect()}
    assert got["financial.revenue"] == (10_000.0, "元", 60) and len(got) == 2
