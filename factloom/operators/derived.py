"""Official facts with what is calculated from them: quarters, ratios and metadata, appended and kept up to date."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.research import metadata_facts
from factloom.operators.timeseries import independent_quarters, ratio_facts

#: What a row is: as it was reported, or calculated.
KINDS = ["direct", "quarters", "ratios", "metadata"]


def parts(official: DataFrame, documents: DataFrame | None = None, formulas: dict[str, str] | None = None, names: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The official facts and the three kinds that are calculated, by kind; suspect rows stay, but nothing is calculated from them."""
    sound = official.filter(~F.coalesce("source_status", F.lit("")).isin("PARSE_SUSPECT", "UNRESOLVED")) if "source_status" in official.columns else official
    out = {"direct": official, "quarters": independent_quarters(sound), "ratios": ratio_facts(sound, formulas, names)}
    return out | ({"metadata": metadata_facts(documents)} if documents is not None else {})


def appended(official: DataFrame, documents: DataFrame | None = None, formulas: dict[str, str] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """All of parts() in one table, with a column `kind`; columns that a kind lacks are null."""
    out = None
    for kind, rows in parts(official, documents, formulas, names).items():
        rows = rows.withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def digests(official: DataFrame, documents: DataFrame, formulas: dict[str, str] | None = None) -> DataFrame:
    """(security_code, digest) of all that a security's rows are calculated from, whatever the order of its rows."""
    rows = official.select("security_code", F.xxhash64(F.lit("facts"), *official.columns).alias("h")).unionByName(
        documents.select("security_code", F.xxhash64(F.lit("documents"), *documents.columns).alias("h")))
    sums = rows.groupBy("security_code").agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.select("security_code", F.sha2(F.concat_ws("|", "s", "n", F.lit(repr(sorted((formulas or {}).items())))), 256).alias("digest"))


def published(official: DataFrame, documents: DataFrame, folder: str, formulas: dict[str, str] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Write appended() to folder/facts, a partition a security, and return the securities that were written.

    Only securities are calculated and written whose rows, documents or formulas differ from those of the last run, by the
    digests in folder/digests; their partitions are replaced, the others aren't touched. Digests follow the facts, so a run
    that was cut off between them is done again. A security that is gone keeps its partitions.
    """
    spark = official.sparkSession
    now = digests(official, documents, formulas)
    try:
        old = spark.read.schema("digest string, security_code string").parquet(f"{folder}/digests")
        changed = now.join(old, ["security_code", "digest"], "left_anti")
    except AnalysisException:  # nothing there yet
        changed = now
    changed = changed.select("security_code", "digest").checkpoint() if spark.sparkContext.getCheckpointDir() else changed.cache()
    only = F.broadcast(changed.select("security_code")) if changed.count() <= 100_000 else changed.select("security_code")
    facts = appended(official.join(only, "security_code", "left_semi"), documents.join(only, "security_code", "left_semi"), formulas, names)
    for rows, name in ((facts.repartition("security_code"), "facts"), (changed.repartition("security_code"), "digests")):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("security_code").parquet(f"{folder}/{name}")
    return changed.select("security_code")
