"""Writing fact tables and packs, period matrices and fingerprints."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_facts(facts: DataFrame, folder: str) -> None:
    """Facts as Parquet, a folder a report year."""
    facts.withColumn("report_year", F.year("report_date")).repartition("report_year",
        F.pmod(F.xxhash64("security_code"), F.lit(8))).write.mode("overwrite").partitionBy("report_year").parquet(folder)


def write_pack(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table of a pack, published whole (see publish), with a view of its name over what was written."""
    spark = next(iter(tables.values())).sparkSession
    publish(tables, folder)
    for name, df in opened(spark, folder).items():
        df.createOrReplaceTempView(name)


POINTER = "version long, folder string, name string, rows long, digest string"


def publish(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """A pack written beside the ones before it, checked, and only then pointed at: its manifest (version, folder, name, rows, digest).

    Each table goes to a folder of its own version. Rows and digest of what is written are taken while it is written and again
    from what was read back; if they differ, the pack isn't published. The pointer is a table that versions are added to, by
    one file that appears whole, so readers see the old pack until they see the new one, and a run that fails leaves the old
    one as it was. Older versions stay until someone removes their folders.
    """
    spark = next(iter(tables.values())).sparkSession
    versions = published(spark, folder)
    version = 1 + (versions.agg(F.max("version")).first()[0] or 0 if versions is not None else 0)
    at = f"{folder}/versions/{version}-{uuid.uuid4().hex}"
    rows = []
    for name, df in tables.items():
        seen = Observation()
        # a pass of its own over the rows, inside the write
        measured = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(_row_number(df)).cast("string").alias("digest"))
        measured.write.parquet(f"{at}/{name}")
        written = fingerprint(spark.read.schema(df.schema).parquet(f"{at}/{name}")).first()
        if (written["rows"], _text(written["digest"])) != (seen.get["rows"], _text(seen.get["digest"])):
            raise OSError(f"{name} isn't what was written: {written} instead of {seen.get}")
        rows.append((version, at, name, written["rows"], _text(written["digest"])))
    spark.createDataFrame(rows, POINTER).coalesce(1).write.mode("append").parquet(f"{folder}/pointer")
    return published(spark, folder).filter(F.col("version") == version)


def published(spark: SparkSession, folder: str) -> DataFrame | None:
    """The manifests of all versions of a pack, None if there is none."""
    try:
        return spark.read.schema(POINTER).parquet(f"{folder}/pointer")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def opened(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version of a pack, of the latest by default. Of two that were published at the same time under one
    number, the one whose folder is greatest counts."""
    manifests = published(spark, folder)
    rows = [] if manifests is None else manifests.filter(F.col("version") == version).collect() if version else manifests.collect()
    if not rows:
        raise FileNotFoundError(f"no pack is published in {folder}")
    newest = max((r["version"], r["folder"]) for r in rows)
    return {r["name"]: spark.read.parquet(f"{r['folder']}/{r['name']}") for r in rows if (r["version"], r["folder"]) == newest}


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder, digested where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


# Columns of an exported search.
EXPORTED = [
    "security_code", "theme", "family", "dataset", "report_date", "event_date", "field_key", "field_name_cn", "value_text", "value_num", "unit", "source_url",
    "base_score", "secondary_score", "score",
]


def export_rows(found: DataFrame, folder: str, kind: str = "csv", most: int = 500_000) -> None:
    """At most `most` rows of a search, as sorted, as CSV with fixed columns and a byte-order mark, or as JSON lines.

    Columns that the rows lack are empty. The mark, for spreadsheets, is part of each file's header.
    """
    rows = found.limit(min(most, 500_000))
    if kind != "csv":
        rows.write.mode("overwrite").json(folder)
        return
    columns = [F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in EXPORTED]
    wide = rows.select(*columns).withColumnRenamed(EXPORTED[0], "\ufeff" + EXPORTED[0])
    wide.write.mode("overwrite").option("header", True).csv(folder)


def validation_pack(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """A cross-validation pack written and registered: facts, official_facts, reconciliation, registry, checks, documents, lifecycle.

    Its views are coverage_summary, true_conflicts and not_in_official_scope over the written reconciliation.
    """
    write_pack(tables, folder)
    views = reconciliation_views(tables["reconciliation"].sparkSession.table("reconciliation"))
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return views


def reconciliation_views(rows: DataFrame) -> dict[str, DataFrame]:
    """Views of compared rows: counts by mode and status, real conflicts, and what no official report holds."""
    return {
        "coverage_summary": rows.groupBy("mode", "status").agg(F.count(F.lit(1)).alias("fact_count")),
        "true_conflicts": rows.filter(F.col("status").isin("MISMATCH", "VERSION_CONFLICT", "SCOPE_CONFLICT", "PERIOD_CONFLICT", "UNIT_CONFLICT")),
        "not_in_official_scope": rows.filter(F.col("status").isin("NOT_IN_OFFICIAL_SCOPE", "SOURCE_SPECIFIC", "FUTURE_FREE_SOURCE_REQUIRED",
            "OFFICIAL_PERIOD_NOT_LOADED")),
    }


def observation_views(rows: DataFrame) -> dict[str, DataFrame]:
    """Views of observations: those with one agreed value, and conflicts."""
    return {
        "resolved_canonical_facts": rows.filter(F.col("status").isin("VERIFIED_MULTI_SOURCE", "SINGLE_SOURCE")),
        "canonical_conflicts": rows.filter(F.col("status") == "SOURCE_CONFLICT"),
    }


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, digest) of every table of a pack; the digest is one that other engines can compute as well.

    A row is its columns in order of name as texts, nulls as nothing, joined by 0x1F; the digest is the sum of the first 15
    hexadecimal digits of the rows' MD5, so it doesn't depend on their order.
    """
    out = None
    for name, df in tables.items():
        text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns)])
        number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
        part = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("digest")).select(F.lit(name).alias("name"), "rows", "digest")
        out = part if out is None else out.unionByName(part)
    return out


def period_matrix(facts: DataFrame, periods: list) -> DataFrame:
    """A row for each security and field, a column for each of the given periods."""
    return facts.groupBy("security_code", "field_key").pivot("report_date", periods).agg(F.max("value_num"))


def _row_number(df: DataFrame):
    return F.xxhash64(*df.columns).cast("decimal(38,0)")


def _text(digest) -> str:
    return "" if digest is None else str(digest)


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and an order-free digest of a table."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(_row_number(df)).alias("digest"))
