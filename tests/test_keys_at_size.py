"""Results that only keys and amounts of larger tables bring out."""

import datetime

from pyspark.sql import functions as F

from factloom.operators import documents
from factloom.plans import catalog


def test_a_second_amount_may_repeat_the_end_of_the_first(spark):
    lines = {"营业收入 1234 不适用 234 5000": 234.0, "营业收入 1234 234 不适用 5000": 1234.0, "营业收入 234 不适用 234 12.5": 234.0}
    rows = spark.createDataFrame(list(lines.items()), "line string, want double")
    value = documents.summary_amount(F.col("line"), F.lit("q3"), F.lit("flow"))["value"]
    assert all(r.value == r.want for r in rows.withColumn("value", value).collect())


def test_parts_from_a_million_on_have_verdicts_of_their_own(spark, tmp_path):
    keys = [120_000, 120_001, *range(1_200_000, 1_200_018)]
    spark.createDataFrame([(k, f"name {k}", f"type {k}") for k in keys], "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    of = ["TEXT_MATCH_NORMALIZED", "MISMATCH", "MISSING_EASTMONEY", "MISSING_OFFICIAL", "TEXT_MATCH_NORMALIZED", "MISMATCH", "SET_MATCH", "MISMATCH", "MISSING_EASTMONEY"]
    found = catalog.queries()["rec10_text_verdicts"](spark, str(tmp_path)).collect()
    assert sorted((r.security_code, r.status) for r in found) == sorted((str(k)[:6], of[k % 9]) for k in keys)


def test_no_customer_has_the_name_of_a_peer(spark, tmp_path):
    keys = [7, 8, 888_888, 999_999]
    rows = [(10 * k + n, k, s, price, f"{n}-OWN", datetime.datetime(2001, 3, 1)) for k in keys for n, (s, price) in enumerate([("F", 40_000.0), ("O", 60_000.0), ("P", 70_000.0)])]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    found = catalog.queries()["nrm17_names"](spark, str(tmp_path)).collect()
    assert sorted((r.security_code, r.name) for r in found) == [(f"{k:06d}", "1-OWN") for k in keys]


def test_rows_of_reports_are_not_dealt_by_their_label(spark):
    rows = [("d", 1, 0, "合并利润表"), ("d", 1, 1, "一、营业（A）收入 四(42)"), ("d", 1, 2, "（120）"), ("d", 1, 3, "营业"), ("d", 1, 4, "成本（元）( B) 7,000"), ("d", 1, 5, "其他 5")]
    lines = spark.createDataFrame(rows, "document_id string, page int, line_no int, line string")
    targets = spark.createDataFrame([("R", "营业收入", "income_statement"), ("C", "营业成本", "income_statement"), ("N", "（一）", "income_statement")], "field_key string, label string, statement string")
    found = documents.statement_values(lines, targets)
    assert {r.field_key: r.value for r in found.collect()} == {"R": -120.0, "C": 7000.0}
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()  # a handful of labels would be as many tasks
    # only windows whose text can have a label get as far as having one made
    windows = spark.createDataFrame([("营业收入", False, 1), ("营业收入其他", False, 1), ("营业收入其他", True, 1), ("营业收入", False, 4), ("其他", True, 1), ("", False, 1)], "d__bare string, d__open boolean, w int")
    named = spark.createDataFrame([("营业收入", 3)], "d__a string, d__reach int")
    assert documents._could_match(windows.withColumn("id", F.monotonically_increasing_id()), named).count() == 2


def test_the_latest_facts_are_sorted_without_columns_that_nobody_wants(spark):
    for name in ("win1_latest_numeric", "agg3_headlines"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        sorts = [line for line in plan.splitlines() if "SortAggregate" in line]
        assert sorts and not any(c in line for line in sorts for c in ("field_name_cn", "value_text", "source_url", "theme"))
