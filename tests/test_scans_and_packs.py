"""Files in and out: scans with schemas, packs with views; and rules of reports that have no table here."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import documents as doc
from factloom.operators import mapping, packages, reconcile, timeseries
from factloom.sources import facts as src
from factloom.sources import scans, sinks
from tests.test_golden import fact, facts

D = datetime.date


def test_facts_from_csv_keep_leading_zeros(spark, tmp_path):
    (tmp_path / "a.csv").write_text("security_code,report_date,field_key,value_num\n1,2024-12-31,R,5.5\n688521,,R,x\n0000012,2024-01-01,Q,1\n")
    rows = {r.security_code: r for r in scans.fact_scan(spark, f"{tmp_path}/a.csv", "csv").collect()}
    assert set(rows) == {"000001", "688521", "0000012"} and rows["000001"].report_date == D(2024, 12, 31) and rows["000001"].value_num == 5.5
    assert rows["688521"].value_num is None and rows["688521"].theme is None and len(rows["688521"]) == 18
    facts(spark, [fact("R", D(2024, 12, 31), 1.0)]).write.parquet(f"{tmp_path}/p")
    assert scans.fact_scan(spark, f"{tmp_path}/p").columns == src.COLUMNS


def test_groups_and_page_sections_become_records(spark):
    run = {
        "metadata": {"security": {"code": "688521"}},
        "groups": [
            {"group_id": "a", "theme": "T", "family": "RPT_F10_FINANCE_GBALANCE",
                "records": [{"REPORT_DATE": "2024-12-31", "X": "1,5", "_P": 1, "RANK": 3}, 7, None]},
            {"group_id": "b", "theme": "P", "family": "PageAjax", "records": [{"LOST": 1}],
                "payloads": [{"s1": [{"A": 1}, 2], "s2": {"data": [{"B": True}]}, "s3": {"C": {"d": [1]}}, "s4": 5}, 9]},
            {"group_id": "c", "theme": "P", "family": "PageAjax", "records": [{"KEPT": 1}], "payloads": []},
        ],
    }
    texts = spark.createDataFrame([(json.dumps(run),), ("no json",), (None,)], "value string")
    found = {(r.dataset, r.field_key): r for r in scans.record_facts(scans.records(scans.groups(texts))).collect()}
    assert set(found) == {
        ("T / RPT_F10_FINANCE_GBALANCE", "REPORT_DATE"), ("T / RPT_F10_FINANCE_GBALANCE", "X"), ("T / RPT_F10_FINANCE_GBALANCE", "RANK"),
        ("PageAjax/s1", "A"), ("PageAjax/s2", "B"), ("PageAjax/s3", "C"), ("P / PageAjax", "KEPT"),
    }
    x = found["T / RPT_F10_FINANCE_GBALANCE", "X"]
    assert (x.value_num, x.period_type, x.data_semantics, x.record_key) == (15.0, "FY", "point_in_time", "688521|RPT_F10_FINANCE_GBALANCE|2024-12-31|3")
    assert found["PageAjax/s2", "B"].value_num == 1.0 and found["PageAjax/s3", "C"].value_text == '{"d":[1]}' and found["PageAjax/s3", "C"].theme == "页面汇总/s3"


def test_names_come_from_objects_with_the_own_code(spark):
    rows = [
        ("688521", "PageAjax", {"peer": {"code": "600000", "name": "Peer"}, "own": {"secucode": "688521.SH", "short_name": "Own"}}),
            ("688521", "RPT_F10_ORG_BASICINFO", {"SECURITY_CODE": "688521", "ORG_NAME_ABBR": "688521", "name": "Better"}),
        ("000001", "X", {"SECUCODE": "SZ000001", "SECURITY_NAME": "--", "name": "A"}), ("000001", "X", {"code": "0.000001", "name": "B"}),
            ("000001", "X", {"code": "1", "name": "C"}), ("000001", "X", {"f57": "000001", "f58": "B"}),
    ]
    df = spark.createDataFrame([(c, f, json.dumps(r)) for c, f, r in rows], "security_code string, family string, r string").withColumn("record",
        F.parse_json("r"))
    from factloom.operators.normalize import NAME_KEYS

    assert {r.security_code: r.name for r in scans.names(df, NAME_KEYS).collect()} == {"688521": "Better", "000001": "B"}


def test_requests_that_do_not_fit_are_named(spark):
    good = "B001,SSE.600000,600000,Bank,SSE,2020-01-01,2020-01-01,2024-12-31,true,PENDING"
    lines = ["batch_id,security_id,code", good, good.replace("600000", "600001").replace("SSE.", "SZSE."), good.replace("600000", "6000"),
        good.replace("600000", "600003").replace("2024-12-31", "31.12.2024"), ""]
    rows = scans.requests(spark.createDataFrame([(x,) for x in lines], "value string"))
    found = {(r.security_id, r.rule) for r in packages.request_violations(rows, F.lit(D(2024, 12, 31)), 3).collect()}
    assert found == {
        ("SZSE.600001", "EXCHANGE_MISMATCH"), ("SSE.6000", "SECURITY_ID_INVALID"), ("SSE.600003", "CUTOFF_MISMATCH"), ("SSE.600003", "START_AFTER_CUTOFF"),
            ("B001", "BATCH_TOO_LARGE"),
    }


def test_search_export_and_packs(spark, tmp_path):
    rows = facts(spark, [fact("R", D(2024, 12, 31), 1.0), fact("S", D(2024, 12, 31), 2.0)])
    sinks.export_rows(rows, f"{tmp_path}/csv")
    (file,) = (tmp_path / "csv").glob("part-*.csv")
    header = file.read_bytes().split(b"\n")[0].strip()
    assert header == b"\xef\xbb\xbf" + ",".join(sinks.EXPORTED).encode()
    r = spark.createDataFrame([("MISMATCH", "A"), ("EXACT_MATCH", "A"), ("SOURCE_SPECIFIC", "B")], "status string, mode string")
    sinks.validation_pack({"reconciliation": r, "facts": rows}, f"{tmp_path}/pack")
    assert spark.table("true_conflicts").count() == 1 and spark.table("coverage_summary").count() == 3 and spark.table("not_in_official_scope").count() == 1
    m = {x.name: (x.rows, x.digest) for x in sinks.manifest({"reconciliation": r, "facts": rows}).collect()}
    again = {x.name: (x.rows, x.digest) for x in sinks.manifest({"facts": rows.repartition(3)}).collect()}
    assert m["facts"] == again["facts"] and m["reconciliation"][0] == 3


def test_growth_reads_the_year_before_as_of(spark):
    rows = facts(spark, [fact("R", D(2023, 9, 30), 5.0), fact("R", D(2024, 12, 31), 10.0), fact("Z", D(2023, 12, 31), 0.0), fact("Z", D(2024, 12, 31), 3.0)])
    found = {(r.field_key, r.report_date): r.yoy for r in timeseries.yoy(rows).collect()}
    assert found == {("R", D(2023, 9, 30)): None, ("R", D(2024, 12, 31)): 1.0, ("Z", D(2023, 12, 31)): None, ("Z", D(2024, 12, 31)): None}
    (value,) = [r.value for r in timeseries.evaluate(timeseries.YOY("R") * 100, rows).collect() if r.report_date == D(2024, 12, 31)]
    assert value == 100.0


def test_finance_expense_takes_the_income_statement(spark):
    d = D(2024, 12, 31)
    pair = [("FINANCE_EXPENSE", "RPT_F10_FINANCE_DUPONT", "OFFICIAL_DERIVED"), ("RESEARCH_EXPENSE", "RPT_F10_BUSINESS_RDEXPENSE", "OFFICIAL_DOCUMENT_EVENT"),
        ("OTHER", "RPT_X", "OFFICIAL_DOCUMENT_EVENT")]
    rows = spark.createDataFrame([("c", d, k, f, m, "FY", "none", 1.0) for k, f, m in pair],
        "security_code string, report_date date, field_key string, family string, mode string, period_type string, statement_type string, value_num double")
    official = spark.createDataFrame([("c", d, k, s, "FY", "consolidated", f"{k}-{s}", v, "元", 0.5) for k, _, _ in pair for s,
        v in (("cash_flow", 7.0), ("income_statement", 9.0))],
                                     "security_code string, report_date date, field_key string, statement_type string, period_type string, scope string, document_id string, value_num double, unit string, precision_tolerance double")
    found = {r.field_key: (r.o.v if r.o else None, r.diagnosis) for r in reconcile.matched(rows, official).collect()}
    assert found == {"FINANCE_EXPENSE": (9.0, None), "RESEARCH_EXPENSE": (None, None), "OTHER": (7.0, None)}


def test_treasury_shares_are_money(spark):
    rows = spark.createDataFrame([("RPT_F10_FINANCE_GBALANCE", "TREASURY_SHARES", "股", "2024-06-30", "k", None), ("X", "A", None, "2024-06-30", "k", None)],
        "family string, field_key string, unit string, report_date string, record_key string, period_type string")
    found = {r.field_key: (r.unit, r.normalized_unit, r.scope, r.period_type) for r in reconcile.prepared_primary(rows).collect()}
    assert found == {"TREASURY_SHARES": ("元", "元", "consolidated", "H1"), "A": (None, "", "entity", "H1")}


@pytest.mark.parametrize(
    "line, kind, semantics, value",
    [
        ("营业收入 100.5 (7) 20% 300.25 5%", "q3", "flow", 300.25), ("营业收入 1,200 不适用 3,400 5", "q3", "flow", 3400.0), ("营业收入 1,200 3,400 5", "q3", "flow", 1200.0),
        ("总资产 1 2 3 4", "q3", "point_in_time", 1.0), ("营业收入 1 2 3 4", "annual", "flow", 1.0), ("营业收入 无", "q3", "flow", None),
    ],
)
def test_amounts_of_summary_rows(spark, line, kind, semantics, value):
    row = spark.createDataFrame([(line, kind, semantics)], "a string, b string, c string").select(doc.summary_amount(F.col("a"), F.col("b"),
        F.col("c"))["value"].alias("v")).first()
    assert row.v == value


def test_headings_hold_for_pages(spark):
    text = ["合并资产负债表", "a", "b", "财务报表附注", "c", "2、母公司现金流量表（续）", "d"]
    pages = [1, 1, 6, 6, 6, 7, 13]
    rows = spark.createDataFrame([("x", p, k, t) for k, (p, t) in enumerate(zip(pages, text))], "document_id string, page int, line_no int, line string")
    found = [(r.statement, r.scope) for r in doc.in_statements(rows).orderBy("line_no").collect()]
    balance, none = ("balance_sheet", "consolidated"), (None, None)
    assert found == [balance, balance, balance, none, none, ("cash_flow", "parent"), none]
    assert {r.document_id: r.scope for r in doc.document_scope(rows.unionByName(spark.createDataFrame([("y", 1, 1, "主要 财务数据"), ("z", 1, 1, None)],
        rows.schema))).collect()} == {"x": "FULL_STATEMENTS", "y": "SUMMARY_ONLY", "z": "UNRESOLVED"}


def test_profiles_take_the_first_key_then_record(spark):
    rows = [("c", 2, "SECURITY_NAME", "second"), ("c", 1, "SECURITY_NAME", "first"), ("c", 9, "SECURITY_NAME_ABBR", "abbr"), ("c", 1, "SECURITY_NAME_ABBR", ""),
        ("c", 1, "FORMER_NAME", "a， b;c"), ("c", 1, "ORG_WEB", "x.cn"), ("c", 1, "BOARD_NAME_1LEVEL", "abbr")]
    (r,) = doc.profiles(spark.createDataFrame(rows, "security_code string, ordinal int, field_key string, value_text string")).collect()
    assert (r.name_abbr, r.company_name, r.former_names, r.website, r.industry_keywords, r.brand_keywords) == ("abbr", "abbr", ["a", "b", "c"], "https://x.cn",
        ["abbr"], ["abbr"])


def test_module_views_and_metrics(spark):
    rows = spark.createDataFrame([("operate_income", "F", "n", "元", "flow", "x", D(2024, 1, 1), "FY"), ("R&D_EXPENSE", "F", "", "", "", "", None, "FY"),
        ("other key!", "RPT-A", None, None, None, None, None, "FY")],
                                 "field_key string, family string, field_name_cn string, unit string, data_semantics string, scope string, report_date date, period_type string")
    found = mapping.resolved(rows)
    assert {(r.metric_id, r.research_module, r.known) for r in found.collect()} == {("financial.revenue", "financial_statements", True),
        ("research.rd_investment", "segments_and_kpis", True), ("source.rpt_a.other_key", "coverage_and_gaps", False)}
    assert {k: v.count() for k, v in mapping.module_views(found).items() if v.count()} == {"financial_statements": 1, "segments_and_kpis": 1,
        "coverage_and_gaps": 1}
