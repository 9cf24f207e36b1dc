"""Work that is done once, however many results need it, and shares of tasks that stay as they are on larger tables."""

import json
import os
import re

from pyspark.sql import functions as F

from factloom.operators import graph, point_in_time, reconcile, timeseries
from factloom.plans import catalog
from factloom.sources import facts as src
from factloom.sources import scans

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_facts_are_made_in_one_pass_and_dealt_by_security_once(spark):
    found = src.everything(spark, SMALL)
    assert plan(found).count("FileScan") == 1 and "REPARTITION_BY_NUM" in plan(found)
    assert found.rdd.getNumPartitions() == src.PARTS * src.table(spark, SMALL, "lineitem").rdd.getNumPartitions()
    by_security = found.groupBy("security_code", "family").agg(F.max("value_num"))
    assert plan(by_security).count("Exchange") == 2  # the sums of quarters, and the deal


def test_parts_of_facts_grow_with_bytes_and_not_with_splits_alone(spark):
    folder, whole = "/root/testdata/sf0.1", "spark.sql.files.minPartitionNum"
    spark.conf.set(whole, "1")
    try:
        assert src.table(spark, folder, "lineitem").rdd.getNumPartitions() == 1
        dealt = re.search(r"hashpartitioning\(security_code#\d+, (\d+)\), REPARTITION_BY_NUM", plan(src.everything(spark, folder)))
    finally:
        spark.conf.unset(whole)
    assert os.path.getsize(f"{folder}/lineitem.parquet") / int(dealt[1]) <= 1 << 20


def test_ends_between_periods_need_no_running_sums(spark):
    found = plan(catalog.queries()["win11_formula_between_periods"](spark, SMALL))
    assert found.count("- Window") == 4  # two running sums of the facts, their means, and the last before each end


def test_copies_of_facts_are_dropped_within_few_tables_scans(spark):
    found = catalog.queries()["fin1_canonical_sources"](spark, SMALL)
    assert plan(found).count("FileScan") == 2  # the facts and their copies


def test_a_formula_reads_its_facts_a_few_times_only(spark):
    rows = [("A", "COST", "Cost", "RPT_F10_FINANCE_GINCOME", "d", f"200{y}-12-31", float(y), "元") for y in range(5)]
    facts = spark.createDataFrame(rows, "security_code string, field_key string, field_name_cn string, family string, dataset string, report_date string, value_num double, unit string")
    facts = facts.withColumn("report_date", F.col("report_date").cast("date"))
    found = timeseries.evaluate('COST + YOY(COST) + AVG("Cost", 2) + CAGR(COST, 2) + VALUE(COST, "2001-12-31")', facts)
    assert plan(found).count("Scan ExistingRDD") == 1
    last = max(found.collect(), key=lambda r: r.report_date)
    assert abs(last.value - (4 + 1 / 3 + 3.5 + (2**0.5 - 1) + 1)) < 1e-9


def test_texts_of_records_are_read_once(spark):
    run = {"metadata": {"security": {"code": "1"}}, "groups": [{"theme": "T", "family": "F", "records": [{"A": True, "END_DATE": "2024-06-30"}]}]}
    texts = spark.createDataFrame([(json.dumps(run),)], "value string")
    found = scans.record_facts(scans.records(scans.groups(texts)))
    assert plan(found).count("Scan ExistingRDD") == 1
    assert sorted((r.field_key, r.value_num, r.event_date, r.record_key) for r in found.collect()) == [("A", 1.0, "2024-06-30", "1|F|2024-06-30"), ("END_DATE", None, "2024-06-30", "1|F|2024-06-30")]


def test_quality_reads_a_graph_once_for_each_measure(spark):
    nodes = spark.createDataFrame([("o1", "CANONICAL_OBSERVATION"), ("o2", "CANONICAL_OBSERVATION"), ("s", "SOURCE_FACT"), ("s", "DOCUMENT")], "node_id string, node_type string")
    edges = spark.createDataFrame([("e1", "o1", "s", "SUPPORTS"), ("e1", "o1", "s", "SUPPORTS"), ("e2", "s", "x", "LOCATED_AT")], "edge_id string, from_id string, to_id string, edge_type string")
    found = graph.quality(nodes, edges)
    assert plan(found).count("Scan ExistingRDD") <= 7
    assert {(r.measure, r.kind): (r.n, r.share) for r in found.collect()} == {
        ("nodes", "CANONICAL_OBSERVATION"): (2, None), ("nodes", "SOURCE_FACT"): (1, None), ("nodes", "DOCUMENT"): (1, None), ("edges", "SUPPORTS"): (2, None),
        ("edges", "LOCATED_AT"): (1, None), ("dangling_edges", None): (1, None), ("duplicate_nodes", None): (1, None), ("duplicate_edges", None): (1, None),
        ("observations_with_lineage", None): (1, 0.5), ("observations_with_evidence", None): (1, 0.5), ("status", "FAIL"): (None, None),
    }


def test_finance_facts_are_made_and_chosen_in_one_pass_without_joins(spark):
    for name, scans, deals in (("agg9_coverage", 1, 3), ("fin8_quarterly", 1, 2), ("fin7_annual_debt", 2, 4)):  # the two of fin7 are the same, so one is reused
        found = plan(catalog.queries()[name](spark, SMALL))
        assert found.count("FileScan") == scans and found.count("Exchange") == deals and "Join" not in found, name


def test_quarters_stand_beside_totals_of_their_date_alone(spark):
    rows = [("1", "2000-03-31", 10.0, False, "SOURCE_DIRECT"), ("1", "2000-06-30", 30.0, False, "SOURCE_DIRECT"), ("1", "2000-06-30", 21.0, True, "SOURCE_DIRECT"),
        ("1", "2000-09-30", 60.0, False, "SOURCE_DIRECT"), ("1", "2000-09-29", 7.0, True, "SOURCE_DIRECT"), ("1", "2000-12-31", 5.0, True, "CONFLICTING"),
        (None, "2000-03-31", 1.0, False, "SOURCE_DIRECT"), (None, "2000-03-31", 2.0, True, "SOURCE_DIRECT")]
    chosen = spark.createDataFrame(rows, "security_code string, report_date string, value double, single boolean, status string").selectExpr(
        "security_code", "date(report_date) as report_date", "'revenue' as target", "'flow' as kind", "status", "value", "string(null) as text", "date(report_date) as available_at", "single")
    found = sorted((r.security_code or "", str(r.report_date), r.value, r.status) for r in point_in_time.quarters_of(chosen).collect())
    assert found == [("", "2000-03-31", 1.0, "SOURCE_DIRECT"), ("", "2000-03-31", 2.0, "SOURCE_DIRECT"), ("1", "2000-03-31", 10.0, "SOURCE_DIRECT"),
        ("1", "2000-06-30", 21.0, "SOURCE_DIRECT"), ("1", "2000-09-29", 7.0, "SOURCE_DIRECT"), ("1", "2000-09-30", 30.0, "DERIVED")]


def test_comparisons_of_facts_go_by_the_security_that_they_are_dealt_by(spark):
    for name in ("set2_derived_compared", "rec13_relabelled"):
        found = plan(catalog.queries()[name](spark, SMALL))
        assert "SortMergeJoin" not in found and "lineitem" not in found, name  # the items are read once, before


def test_what_stands_beside_a_row_has_its_keys(spark):
    rows = spark.createDataFrame([("1", "a", 1), ("1", "a", 2), ("1", "b", 3), ("2", "a", 4), (None, "a", 5)], "security_code string, field_key string, n int").withColumn("there", F.lit(False))
    other = spark.createDataFrame([("1", "a", "x"), (None, "a", "y")], "security_code string, field_key string, v string")
    found = reconcile.beside(rows, other, ["security_code", "field_key"], ["v"], ["security_code"], "there")
    assert sorted((r.n, r.v, r.there) for r in found.collect()) == [(1, "x", True), (2, "x", True), (3, None, True), (4, None, False), (5, None, False)]
