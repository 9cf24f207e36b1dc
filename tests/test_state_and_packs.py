"""Ingestion with keyed state, packs that are published whole, names within texts, hubs, identities and gaps."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from factloom.operators import mapping, reconcile, research
from factloom.sources import sinks
from factloom.streaming import ingestion

SCHEMA = "code string, field string, available string, value double"
FILES = {
    "a": [("1", "x", "2025-01-01", 1.0), ("1", "y", "2025-01-01", 2.0), ("1", "y", "2025-01-01", 2.0)],
    "b": [("1", "x", "2025-01-01", 1.0), ("2", "x", "2025-01-01", 3.0)],
    "late": [("1", "x", "2025-02-01", 9.0), ("2", "x", "2024-01-01", 0.0)],
}
KEYS = ["code", "field"]


@pytest.mark.parametrize("order", [["a", "b", "late"], ["late", "b", "a"]])
def test_ingestion_in_any_order_equals_the_batch(spark, tmp_path, order):
    landed, table, checkpoint = (f"{tmp_path}/{x}" for x in ("landed", "facts", "checkpoint"))
    for name in order:
        spark.createDataFrame(FILES[name], SCHEMA).coalesce(1).write.json(f"{landed}/{name}")
        ingestion.ingest(spark, f"{landed}/*", SCHEMA, table, checkpoint, KEYS, versions=True)
    rows = spark.read.parquet(table)
    assert rows.count() == len({r for f in FILES.values() for r in f})
    got = {(r.code, r.field): (r.available, r.value) for r in ingestion.current(rows, KEYS, ["available"]).collect()}
    assert got == {("1", "x"): ("2025-02-01", 9.0), ("1", "y"): ("2025-01-01", 2.0), ("2", "x"): ("2025-01-01", 3.0)}


def test_a_batch_that_is_tried_again_changes_nothing(spark, tmp_path):
    landed, table, checkpoint = (f"{tmp_path}/{x}" for x in ("landed", "facts", "checkpoint"))
    for name in ("a", "b"):
        spark.createDataFrame(FILES[name], SCHEMA).coalesce(1).write.json(f"{landed}/{name}")
        ingestion.ingest(spark, f"{landed}/*", SCHEMA, table, checkpoint, KEYS)
    before = sorted(map(tuple, spark.read.parquet(table).collect()))
    last = max(glob.glob(f"{checkpoint}/commits/[0-9]*"), key=lambda x: int(os.path.basename(x)))
    os.remove(last)  # as if the run had ended after writing and before committing
    crc = f"{checkpoint}/commits/.{os.path.basename(last)}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    ingestion.ingest(spark, f"{landed}/*", SCHEMA, table, checkpoint, KEYS)
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == before and len(before) == 3


def test_packs_are_published_whole(spark, tmp_path):
    folder = str(tmp_path / "pack")
    one, two = spark.range(5).withColumn("v", F.lit("a")), spark.range(3).withColumnRenamed("id", "k")
    first = sinks.publish({"one": one, "two": two}, folder).collect()
    assert {(r.version, r.name, r.rows) for r in first} == {(1, "one", 5), (1, "two", 3)}
    broken = two.withColumn("k", F.when(F.col("k") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("k")))
    with pytest.raises(Exception, match="lost"):
        sinks.publish({"one": one.limit(1), "two": broken}, folder)
    assert sinks.opened(spark, folder)["one"].count() == 5  # the pack before is still the pack
    sinks.publish({"one": one.limit(2), "two": two.limit(0)}, folder)
    assert {n: df.count() for n, df in sinks.opened(spark, folder).items()} == {"one": 2, "two": 0}
    assert sinks.opened(spark, folder, 1)["one"].count() == 5
    digests = sinks.file_digests(spark, folder).collect()
    assert all(len(r.sha256) == 64 and r.bytes > 0 for r in digests) and len(digests) >= 5
    with pytest.raises(FileNotFoundError):
        sinks.opened(spark, str(tmp_path / "none"))


def test_names_within_texts(spark):
    texts = spark.createDataFrame([(1, "we met ABCD Corp and 芯原股份 today"), (2, "aaaa"), (3, None), (4, ""), (5, "x"), (6, "😀😀 emoji 😀é")], "id long, text string")
    names = spark.createDataFrame([("ABCD", "1"), ("芯原", "2"), ("aa", "3"), ("aab", "4"), ("x", "5"), ("😀é", "6"), ("BCD C", "7"), ("ABCD", "8")], "name string, found string")
    got = sorted((r.id, r.name, r.found) for r in research.names_within(texts, names).collect())
    assert got == sorted([(1, "ABCD", "1"), (1, "ABCD", "8"), (1, "BCD C", "7"), (1, "芯原", "2"), (2, "aa", "3"), (6, "😀é", "6")])


def test_a_long_text_costs_its_length(spark):
    text = "".join(chr(97 + k * k % 26) for k in range(1_000_000)) + " Needle "
    texts = spark.createDataFrame([(1, text)], "id long, text string")
    names = spark.createDataFrame([("Needle", "1"), ("Nothing", "2")], "name string, found string")
    began = time.time()
    assert [r.name for r in research.names_within(texts, names).collect()] == ["Needle"]
    assert time.time() - began < 60


def test_a_hub_is_dealt_over_tasks(spark):
    leaves = spark.range(6000).select(F.lit("hub").alias("from_id"), F.concat(F.lit("n"), "id").alias("to_id"))
    chain = spark.range(12_000).select(F.concat(F.lit("n"), "id").alias("from_id"), F.concat(F.lit("m"), F.col("id") % 100).alias("to_id"))
    edges = leaves.unionByName(chain).unionByName(spark.createDataFrame([("start", "hub")], "from_id string, to_id string"))
    starts = spark.createDataFrame([("start",), ("hub",)], "node_id string")
    got = mapping.traced(edges, starts, 3)
    assert {(r.start, r.depth): r["count"] for r in got.groupBy("start", "depth").count().collect()} == {
        ("start", 0): 1, ("start", 1): 1, ("start", 2): 6000, ("start", 3): 100, ("hub", 0): 1, ("hub", 1): 6000, ("hub", 2): 100,
    }
    assert mapping.traced(edges.limit(0), starts, 2).count() == 2


def test_identities_take_their_tolerance_from_the_facts(spark):
    rows = [("1", "d", "TOTAL_ASSETS", 100.0, 2.0, ""), ("1", "d", "TOTAL_LIABILITIES", 60.0, 1.0, ""), ("1", "d", "TOTAL_EQUITY", 36.0, 1.0, ""),
        ("1", "d", "TOTAL_LIAB_EQUITY", 97.9, 1.0, ""), ("1", "d", "CCE_ADD", 5.0, 1.0, ""), ("1", "d", "NETCASH_OPERATE", 5.0, 1.0, "PARSE_SUSPECT")]
    facts = spark.createDataFrame(rows, "security_code string, report_date string, field_key string, value_num double, precision_tolerance double, source_status string")
    got = {r.check_id: (r.status, r.tolerance) for r in reconcile.identities(facts).collect()}
    assert got == {"BALANCE_ASSETS_EQ_LIAB_PLUS_EQUITY": ("PASS", 4.0), "BALANCE_ASSETS_EQ_TOTAL_LIAB_EQUITY": ("FAIL", 2.0), "CASHFLOW_NET_CHANGE": ("UNRESOLVED", 3.0)}


def test_gaps_of_a_security_without_observations_of_them(spark):
    got = mapping.coverage_gaps(spark.createDataFrame([("1", "research.rd_expense"), ("2", "x")], "security_code string, metric_id string")).collect()
    assert len(got) == 12 and {(r.security_code, r.required_metric_id) for r in got if r.status == "PRESENT"} == {("1", "research.rd_expense")}
