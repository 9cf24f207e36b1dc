"""Operators and queries on what their first versions left out."""

from pyspark.sql import functions as F

from factloom.operators import documents, reconcile, research
from factloom.plans import catalog

SMALL = "/root/testdata/sf0.001"


def test_short_names_meet_texts_by_the_whole_name(spark, monkeypatch):
    profiles = spark.createDataFrame([(f"{k:06d}", f"legal{k}", [f"former{k}"], f"{k}.org", f"s{k:06d}s") for k in range(200)] + [("x", "lx", ["fx"], "x.org",
        "ab")], "security_code string, legal_name string, former_names array<string>, domain string, short_name string")
    mentions = spark.createDataFrame([(k, f"the s{k:06d}s group", None, None) for k in range(0, 200, 7)] + [(900, "ab", None, None), (901, "a", None, None),
        (902, None, None, None)], "id long, text string, domain string, code string")
    out = research.entity_matches(mentions, profiles)
    assert {r.id: r.security_code for r in out.collect()} == {k: f"{k:06d}" for k in range(0, 200, 7)} | {900: "x"}
    # texts and names are brought together by runs of characters, never each with each
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entities_take_all_suppliers(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(research, "entity_matches", lambda mentions, profiles: taken.append(profiles))
    catalog.queries()["jon12_entity_matches"](spark, "/root/testdata/sf0.01")
    assert taken[0].count() == spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").count()


def test_metadata_and_tags_take_whole_tables(spark):
    found = catalog.queries()["rec22_all_metadata_facts"](spark, SMALL)
    assert found.select("source_document").distinct().count() == spark.read.parquet(f"{SMALL}/orders.parquet").count()
    texts = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert catalog.queries()["nrm23_all_language_tags"](spark, SMALL).count() == texts.count()


def test_texts_dates_and_sets_have_verdicts(spark):
    rows = [
        ("NAME", "text", "A  Ｂ（x）", "aＢ(X)", "TEXT_MATCH_NORMALIZED"), ("N2", "text", "a", "b", "MISMATCH"), ("N3", "text", None, "b", "MISSING_EASTMONEY"),
            ("N4", "text", "a", "  ", "MISSING_OFFICIAL"),
        ("SECURITY_CODE", "text", "688521.SH", "SH688521", "TEXT_MATCH_NORMALIZED"), ("REPORT_TYPE", "text", "2024年 年报", "2024年度报告", "TEXT_MATCH_NORMALIZED"),
            ("LIST_DATE", "date", "2024/1/5", "2024-01-05", "TEXT_MATCH_NORMALIZED"),
        ("MEMBERS", "set", "a、B", "b;A", "SET_MATCH"), ("M2", "set", "a", "a,b", "MISMATCH"),
    ]
    facts = spark.createDataFrame([("1", "d", f, "Q1", "", "x", "OFFICIAL_METADATA", m, 0.0, 0.0, None, a, "") for f, m, a, *_ in rows],
        "security_code string, report_date string, field_key string, period_type string, statement_type string, family string, mode string, method string, absolute double, relative double, value_num double, value_text string, unit string")
    official = spark.createDataFrame([("1", "d", f, "Q1", "", "consolidated", "doc", None, b, "", 0.0) for f, _, _, b, _ in rows],
        "security_code string, report_date string, field_key string, period_type string, statement_type string, scope string, document_id string, value_num double, value_text string, unit string, precision_tolerance double")
    out = reconcile.compared(reconcile.matched(facts, official), official)
    assert {r.field_key: r.status for r in out.collect()} == {f: s for f, *_, s in rows}
    whole = reconcile.summary(out).filter("security_code is null").first()
    assert (whole.matched, whole.conflicts, whole.unresolved) == (5, 2, 2)


def test_values_are_found_over_blank_lines_notes_and_units(spark):
    texts = {
        "note": "Revenue (7) 1,234.50", "blank": "Revenue\n\n \n1,234.50", "third": "Revenue\n(7)\n\n5,000", "fourth": "Revenue\n(1)\n(2)\n5,000", "other": "Revenue\nof the year\n5,000",
            "small": "Revenue 7 1,234.50 1,000",
        "negative": "Revenue （1，234.50）", "page": "单位：人民币 万元\nRevenue 12.5", "row": "单位：千元\nRevenue（元／股） 0.25", "own": "Revenue（亿元） 2", "none": "Revenue (7)",
    }
    rows = spark.createDataFrame(list(texts.items()), "document_id string, text string")
    targets = spark.createDataFrame([("revenue", "R", False), ("revenue", "S", True)], "label string, field_key string, summary boolean")
    found = {(r.document_id, r.field_key): (r.value, r.unit, r.tolerance) for r in documents.extracted(rows, targets).collect()}
    want = {
        "note": (1234.5, "元", 1.0), "blank": (1234.5, "元", 1.0), "third": (5000.0, "元", 1.0), "small": (1234.5, "元", 1.0), "negative": (-1234.5, "元", 1.0),
        "page": (125000.0, "万元", 500.0), "row": (0.25, "元/股", 0.005), "own": (2e8, "亿元", 5e7),
    }
    assert found == {(k, f): v for k, v in want.items() for f in "RS"} | {("fourth", "S"): (5000.0, "元", 1.0), ("small", "S"): (7.0, "元", 1.0)}
    assert spark.range(1).select(documents.amounts(F.lit("营业收入 七（29） （1，234.50） ( 250 ) 12")).alias("a")).first().a == [-1234.5, -250.0, 12.0]
