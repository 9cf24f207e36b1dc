"""What the operators of this subpackage share: reading tables, cutting lineage, numbering rows."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space that separates words in every contract here.
SPACE = r"\x20\x09-\x0D"
#: Rows of a few short columns that are broadcast at most; rows in a bucket of numbered(), about.
SMALL = 100_000
BUCKET = 5_000
#: A key is frequent if more than one in so many rows has it.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, one of our own, on a single machine only."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there or tempfile.mkdtemp(prefix="factloom-checkpoint-"))
    return there or spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(parts))


def plainly_named(df: DataFrame, needed: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with all columns but the needed ones under plain names, as any column may have any name; and what names them back."""
    inner = df.toDF(*[n if n in needed else f"c{k}" for k, n in enumerate(df.columns)])
    return inner, lambda out: out.select(*inner.columns).toDF(*df.columns)


def small(df: DataFrame, rows: int, most: int = SMALL) -> DataFrame:
    """df, marked for a broadcast if its known number of rows is at most `most`; else Spark picks the join."""
    return F.broadcast(df) if rows <= most else df


def joined(rows: DataFrame, other: DataFrame, key: str, total: int) -> DataFrame:
    """rows, of which there are `total`, joined to other, which has a row for each key and in `n` how many rows have it.

    Keys with more than one in HOT of the rows, fewer than HOT of them, are broadcast; so no task of the shuffled rest
    gets a frequent key. Both are read twice, so keep them first. Up to SMALL rows are joined as they are.
    """
    if total <= SMALL:
        return rows.join(other.drop("n"), key)
    frequent = F.col("n") * HOT > F.lit(total)
    hot = other.filter(frequent).drop("n")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(other.filter(~frequent).drop("n"), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def numbered(df: DataFrame, keys: list[str], order: list[str], into: str) -> DataFrame:
    """df with a gapless number from 0 within keys, in column `into`; df is read three times, so keep it first.

    Rows of a key are spread over buckets of about `BUCKET` rows by a hash of `order`, numbered within their bucket, and
    moved on by what the buckets before hold. So a key with a third of all rows is shared by many tasks; only the counts,
    one a key and bucket, meet. Rows that are equal in `order` get their numbers in any order.
    """
    buckets = max(1, -(-df.count() // BUCKET))
    b, n, base = f"{into}__bucket", f"{into}__n", f"{into}__base"
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        *[F.col(k).alias(f"{k}__r") for k in keys], F.col(b).alias(f"{b}__r"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base)
    )
    inside = Window.partitionBy(*keys, b).orderBy(*order)
    same = [dealt[k].eqNullSafe(bases[f"{k}__r"]) for k in keys] + [dealt[b] == bases[f"{b}__r"]]
    on = same[0]
    for x in same[1:]:
        on = on & x
    ranked = dealt.withColumn(n, F.row_number().over(inside) - 1)
    return (
        ranked.join(bases, on)
        .withColumn(into, (F.col(n) + F.col(base)).cast("long"))
        .drop(b, n, base, f"{b}__r", *[f"{k}__r" for k in keys])
    )


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without a copy; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the text in each has at most `most` bytes, or is one row."""
    for batch in batches:
        _, at = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(at, at[start] + most, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
