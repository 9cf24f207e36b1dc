"""Incremental ingestion of landed files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest(spark: SparkSession, landed: str, schema: str, facts: str, checkpoint: str, keys: list[str], versions: bool = False) -> None:
    """Files that landed since the last call join the fact table once each; facts that are there already aren't added.

    What is there is known by keyed state, partitioned by key and kept in RocksDB beside the checkpoint, so a micro-batch costs its
    own rows and the state of their keys; the table isn't read. Each micro-batch is a folder of the table that is written over
    when the batch is tried again, and the state goes back with it, so a retry neither loses nor repeats rows. Of rows with the
    same keys the first one that lands stays. With versions, rows of one key that differ in anything else all stay, so that
    current() gives the same facts whatever the order in which files land.
    """
    if ROCKSDB.rpartition(".")[2] not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)
    stream = spark.readStream.schema(schema).json(landed)
    if versions:
        digest = F.unhex(F.sha2(F.to_json(F.struct(*stream.columns)), 256))
        new = stream.withColumn("row_digest", digest).dropDuplicates([*keys, "row_digest"])
    else:
        new = stream.dropDuplicates(keys)

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{facts}/batch={number}")

    new.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(facts: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """One row of each key of a table that was ingested with versions: the greatest in `newest`, then by its digest."""
    rest = [c for c in facts.columns if c not in keys]
    best = facts.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*newest, "row_digest")).alias("t__b"))
    return best.select(*keys, *[F.col(f"t__b.{c}") for c in rest])
